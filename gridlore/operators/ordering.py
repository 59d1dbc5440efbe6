"""Row order without a single-task window.

A DataFrame has no order, so every order-dependent operator works on an explicit row number
column, ``ROW``. Three tools build on it:

* files: row number = rows in earlier files + row index inside the file; no shuffle;
* ``positions``: dense positions of a subset in row order, by fixed blocks of row numbers;
* ``sorted_positions``: dense positions under any sort keys, by range partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlore.session import materialize, observed

ROW = "_row"
BLOCK_ROWS = 1 << 18
OFFSET_ROW_BYTES, MAX_OFFSET_BYTES = 64, 256 << 20  # a row of three longs in a hash table, and what may be broadcast
SLOT_BITS = 33  # monotonically_increasing_id keeps the partition above these bits
PATH_KEYS = ["_path_a", "_path_b"]


def data_columns(df: DataFrame) -> list[str]:
    """All columns but the row number."""
    return [c for c in df.columns if c != ROW]


def free_name(label: str, taken: list[str]) -> str:
    """A helper column's name that no column in ``taken`` has."""
    name, known = f"_{label}", {c.lower() for c in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def require_row(df: DataFrame) -> DataFrame:
    if ROW not in df.columns:
        raise ValueError(f"This operator depends on row order and needs the {ROW} column; see with_row().")
    return df


def with_row(df: DataFrame, order_by: list[str | Column] | None = None) -> DataFrame:
    """Attach ``ROW`` to a table that has none: in the order of ``order_by``, else as read.

    The order a table is read in is only fixed once it is written down, so that case stores a
    copy and numbers its rows densely.
    """
    if ROW in df.columns:
        return df
    if order_by:
        return sorted_positions(df, order_by, ROW)
    stored = materialize(df.withColumn("_slot", F.monotonically_increasing_id()), "rows")
    return _densely(stored, ROW, freeze(_parts(stored)))


def _parts(stored: DataFrame) -> DataFrame:
    """Rows before each task of a table whose ``_slot`` a task counted up."""
    sizes = stored.groupBy(F.shiftright("_slot", SLOT_BITS).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    return running_offsets(sizes, "_part", "_n").select("_part", "_before")


def _densely(stored: DataFrame, name: str, offsets: DataFrame) -> DataFrame:
    """``_slot`` as a dense position."""
    return (
        stored.withColumn("_part", F.shiftright("_slot", SLOT_BITS))
        .join(offsets, "_part")
        .withColumn(name, F.col("_before") + F.col("_slot").bitwiseAND(F.lit((1 << SLOT_BITS) - 1)))
        .drop("_slot", "_part", "_before")
    )


def file_rows(df: DataFrame) -> DataFrame:
    """Attach ``ROW`` to a Parquet scan from file name and row index, without a shuffle.

    Files are matched by two hashes of their path, so no path is broadcast. A table that was staged
    with its row numbers keeps them.
    """
    if ROW in df.columns:
        return df
    if len(df._jdf.inputFiles()) <= 1:  # counted in the JVM, no path reaches Python
        return df.select("*", F.col("_metadata.row_index").alias(ROW))
    path = F.col("_metadata.file_path")
    counts = df.select(path.alias("_file")).groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_offsets(counts.withColumns(path_keys("_file")), "_file", "_n").select(*PATH_KEYS, "_before")
    return (
        df.select("*", path.alias("_file"), F.col("_metadata.row_index").alias("_index"))
        .withColumns(path_keys("_file"))
        .join(freeze(offsets), PATH_KEYS)
        .withColumn(ROW, F.col("_before") + F.col("_index"))
        .drop("_file", "_index", *PATH_KEYS, "_before")
    )


def path_keys(path: str) -> dict[str, Column]:
    """Two hashes that stand for a path."""
    return {k: F.xxhash64(F.lit(i), path) for i, k in enumerate(PATH_KEYS)}


def freeze(offsets: DataFrame) -> DataFrame:
    """Write an offset table of longs once, and broadcast it up to ``MAX_OFFSET_BYTES``.

    That is four million files or splits; a larger table is joined by shuffle.
    """
    stored = materialize(offsets, "offsets")
    return F.broadcast(stored) if stored.count() * OFFSET_ROW_BYTES <= MAX_OFFSET_BYTES else stored


def running_offsets(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Prefix sums over a table of one row per file, block or partition."""
    earlier = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum(n).over(earlier), F.lit(0).cast("long")))


def block_of(block_rows: int = BLOCK_ROWS) -> Column:
    return F.floor(F.col(ROW) / F.lit(block_rows))


def positions(df: DataFrame, name: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Dense 0-based positions of the rows of ``df`` in row order.

    Rows are numbered inside blocks of ``block_rows`` row numbers, so no task sorts more than
    one block, and a block table of one row per block supplies the offsets.
    """
    blocked = require_row(df).withColumn("_block", block_of(block_rows))
    sizes = blocked.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_offsets(sizes, "_block", "_n").select("_block", "_before")
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(ROW)) - 1
    return (
        blocked.withColumn("_inside", inside)
        .join(offsets, "_block")
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_block", "_inside", "_before")
    )


def sorted_positions(df: DataFrame, keys: list[str | Column], name: str) -> DataFrame:
    """Dense 0-based positions of the rows of ``df`` sorted by ``keys``.

    Range partitioning splits a frequent key only if ``keys`` end in something unique, such as
    ``ROW``. Its boundaries come from sampling, so the numbered slots are written before they
    are counted.
    """
    slots = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    stored = materialize(slots, "sorted")
    # one row per range partition: bounded by spark.sql.shuffle.partitions
    return _densely(stored, name, F.broadcast(_parts(stored)))


def fill_both_ways(df: DataFrame, columns: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Fill nulls with the last earlier value in row order; those before any value get the first.

    Inside a block a window carries values forward. Across blocks, each block's last value is
    carried over a table of one row per block, which also holds the table's first value.
    """
    blocked = require_row(df).withColumn("_block", block_of(block_rows))
    at = {c: F.when(F.col(c).isNotNull(), F.col(ROW)) for c in columns}
    edges = blocked.groupBy("_block").agg(
        *[F.max_by(F.col(c), at[c]).alias(f"_last_{i}") for i, c in enumerate(columns)],
        *[F.min_by(F.col(c), at[c]).alias(f"_first_{i}") for i, c in enumerate(columns)],
    )
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carry = edges.select(
        "_block",
        *[
            F.coalesce(F.last(f"_last_{i}", True).over(earlier), F.first(f"_first_{i}", True).over(whole)).alias(f"_carry_{i}")
            for i in range(len(columns))
        ],
    )
    upto = Window.partitionBy("_block").orderBy(ROW).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = {c: F.coalesce(F.last(c, True).over(upto), F.col(f"_carry_{i}")) for i, c in enumerate(columns)}
    return blocked.join(carry, "_block").withColumns(filled).select(*df.columns)


FILLED_ROWS = 1 << 20
"""Filled values (a row number and one value per column) are broadcast up to this number of rows."""


def fill_gaps(df: DataFrame, columns: list[str]) -> DataFrame:
    """``fill_both_ways``, but only row numbers and the columns concerned are shuffled while gaps are few.

    Rows with a gap are written with their values, which a broadcast join puts in place, so nothing else
    moves. With more gaps than FILLED_ROWS whole rows are sorted by block.
    """
    require_row(df)
    numbered = df.select(ROW, *[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])
    names = [f"v{i}" for i in range(len(columns))]
    gap = reduce(Column.__or__, [F.col(n).isNull() for n in names])
    some, facts = observed(numbered.where(gap).select(ROW), "gaps", {"n": "count(*)"})
    if facts["n"] > FILLED_ROWS:
        return fill_both_ways(df, columns)
    filled = fill_both_ways(numbered, names).join(F.broadcast(some), ROW, "left_semi").select(F.col(ROW).alias("at"), *names)
    taken = [*df.columns]
    helpers = {n: free_name(n, taken) for n in ["at", *names]}
    found = materialize(filled, "filled").select(*[F.col(n).alias(h) for n, h in helpers.items()])
    joined = df.join(F.broadcast(found), F.col(ROW) == F.col(helpers["at"]), "left")
    put = {c: F.coalesce(F.col(c), F.col(helpers[n])).alias(c) for c, n in zip(columns, names)}
    return joined.select(*[put.get(c, F.col(c)) for c in df.columns])
