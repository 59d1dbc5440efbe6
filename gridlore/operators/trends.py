"""Linear trends over time or row order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridlore.functions import exprs as X
from gridlore.operators.ordering import ROW, SLOT_BITS, positions, require_row, running_offsets, sorted_positions
from gridlore.operators.profile import columns_of, per_column
from gridlore.session import materialize, small_frame

STEEP = 0.08
POSITION = "_position"
COLUMNS_PER_SORT = 8
"""Columns that are added up while they are sorted, so that an aggregate's buffers stay under spark.sql.codegen.maxFields."""


def trend_basis(df: DataFrame, columns: list[str] | None = None, basis: str | None = None) -> tuple[DataFrame, str]:
    """Numeric columns with each row's position 0..n-1 by the first datetime column or row order.

    Rows without a time come last. Ties in time keep row order, which also lets a frequent
    time spread over several partitions.
    """
    keyed, basis, keys = _keyed(df, columns, basis)
    if basis is None:
        return positions(keyed, POSITION), "row_order"
    return sorted_positions(keyed, keys, POSITION), basis


def _keyed(df: DataFrame, columns: list[str] | None, basis: str | None = None) -> tuple[DataFrame, str | None, list]:
    """Numeric columns as doubles, the datetime column that orders them, if any, and the sort keys for it."""
    require_row(df)
    columns = columns_of(df, X.NUMERIC) if columns is None else columns
    times = columns_of(df, X.DATETIME)
    basis = basis or (times[0] if times else None)
    dtypes = X.types_of(df)
    values = [f"{X.double(X.quote(c), dtypes[c])} AS {X.quote(c)}" for c in columns]
    if basis is None:
        return df.selectExpr(ROW, *values), None, [F.col(ROW)]
    return df.selectExpr(ROW, f"{X.quote(basis)} AS _time", *values), basis, [F.col("_time").asc_nulls_last(), F.col(ROW)]


def _fits_over_time(keyed: DataFrame, keys: list, columns: list[str]) -> DataFrame:
    """(column, fit, span, steps) of columns over positions by ``keys``.

    Each range partition of the sort adds up its own rows by their places in it, in the job that sorts them, and
    moments of partitions are put together with the rows before them; sorted rows aren't written.
    """
    slots = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_slot", F.monotonically_increasing_id())
    place = f"CAST(_slot & {(1 << SLOT_BITS) - 1}L AS DOUBLE)"
    aggs = ["count(*) AS _n"]
    for i, c in enumerate(columns):
        v = X.quote(c)
        at = f"CASE WHEN {v} IS NOT NULL THEN {place} END"
        aggs += [
            f"count({v}) AS n{i}", f"sum({at}) AS x{i}", f"sum({v}) AS y{i}", f"var_pop({at}) AS xx{i}", f"covar_pop({v}, {place}) AS xy{i}",
            f"min({v}) AS lo{i}", f"max({v}) AS hi{i}",
        ]
    summed = slots.groupBy(F.shiftright("_slot", SLOT_BITS).alias("_part")).agg(*[F.expr(a) for a in aggs])
    # one row per range partition: bounded by spark.sql.shuffle.partitions
    parts = materialize(summed, "fits")
    parts = running_offsets(parts, "_part", "_n")
    cells = ", ".join(
        f"struct({X.text(c)} AS column, n{i} AS n, x{i} / nullif(n{i}, 0) + _before AS x, y{i} / nullif(n{i}, 0) AS y, xx{i} AS xx, xy{i} AS xy, lo{i} AS lo, hi{i} AS hi)" for i, c in enumerate(columns)
    )
    rows = parts.selectExpr("_before + _n - 1 AS last", f"inline(array({cells}))")
    # every column has a row, also one without values
    whole = rows.groupBy("column").agg(
        F.max("last").alias("steps"), F.sum("n").alias("all"), (F.sum(F.expr("n * x")) / F.expr("nullif(sum(n), 0)")).alias("mx"),
        (F.sum(F.expr("n * y")) / F.expr("nullif(sum(n), 0)")).alias("my"), (F.max("hi") - F.min("lo")).alias("span"),
    )
    joined = rows.join(F.broadcast(whole), "column")
    spread = joined.groupBy("column").agg(
        F.sum(F.expr("n * (xy + (x - mx) * (y - my))")).alias("c"), F.sum(F.expr("n * (xx + (x - mx) * (x - mx))")).alias("v"),
        F.first("span").alias("span"), F.first("steps").alias("steps"),
    )
    return spread.selectExpr("column", "CASE WHEN v > 0 THEN c / v END AS fit", "span", "steps")


def trends(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per numeric column: least-squares slope on position, and its direction.

    The slope is scaled by positions and value range: above 0.08 upward, below -0.08 downward.
    A column with fewer than two distinct values is stable and has no slope.
    """
    columns = columns_of(df, X.NUMERIC) if columns is None else columns
    schema = "column string, position int, direction string, basis string, slope double, description string"
    if not columns:
        return small_frame(df.sparkSession, [], schema)
    keyed, basis, keys = _keyed(df, columns)

    def aggregates(c):
        v = X.quote(c)
        return [
            f"regr_slope({v}, CAST({POSITION} AS DOUBLE))",
            f"max({v}) - min({v})",
            f"max({POSITION})",
        ]

    if basis is None or len(columns) > COLUMNS_PER_SORT:
        placed = positions(keyed, POSITION) if basis is None else sorted_positions(keyed, keys, POSITION)
        basis = basis or "row_order"
        fitted = per_column(placed, columns, aggregates, ["fit", "span", "steps"])
    else:
        fitted = _fits_over_time(keyed, keys, columns)
    steepness = "fit * greatest(steps, 1) / span"
    order = small_frame(df.sparkSession, list(zip(columns, range(len(columns)))), "column string, position int")
    where = f"when records are ordered by {basis}" if basis != "row_order" else "across the dataset order"
    return (
        order.join(fitted, "column", "left")  # one row per column
        .selectExpr(
            "column",
            "position",
            "coalesce(span, 0D) = 0 AS flat",
            f"CASE WHEN coalesce(span, 0D) = 0 THEN 'stable' WHEN {steepness} > {STEEP} THEN 'upward' "
            f"WHEN {steepness} < -{STEEP} THEN 'downward' ELSE 'stable' END AS direction",
            f"{X.text(basis)} AS basis",
            "CASE WHEN span > 0 THEN round(fit, 4) END AS slope",
        )
        .selectExpr(
            "column",
            "position",
            "direction",
            "basis",
            "slope",
            "CASE WHEN flat THEN concat(column, ' stays mostly stable across the available records.') "
            "ELSE concat(column, ' shows ', CASE direction WHEN 'stable' THEN 'a ' ELSE 'an ' END, direction, "
            f"{X.text(f' trend {where}.')}) END AS description",
        )
    )
