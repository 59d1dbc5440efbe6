"""Column profiles and summary statistics.

Per-column work is written as one branch per column over the same table: on columnar storage
each branch reads its own column only, so the branches together cost one scan. Results hold one
row per column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from gridlore.functions import exprs as X
from gridlore.functions.names import unique_names
from gridlore.operators.ordering import ROW, data_columns, require_row
from gridlore.operators.quantiles import exact_quantiles
from gridlore.session import run_parts, run_sql, small_frame

AGGREGATES_PER_SCAN = 48  # keeps an aggregate's buffers under spark.sql.codegen.maxFields
HEAD_ROWS = 1000
MODES = ("clean", "raw")


@dataclass(frozen=True)
class ColumnSpec:
    original: str
    name: str
    kind: str
    dtype: str
    position: int


def column_specs(df: DataFrame) -> list[ColumnSpec]:
    originals = data_columns(df)
    dtypes = X.types_of(df)
    return [
        ColumnSpec(original, name, X.kind_of(dtypes[original]), dtypes[original].simpleString(), i)
        for i, (original, name) in enumerate(zip(originals, unique_names(originals)))
    ]


def describe_columns(df: DataFrame) -> DataFrame:
    """One row per column: position, original and normalised name, type, kind."""
    rows = [(s.position, s.original, s.name, s.dtype, s.kind) for s in column_specs(df)]
    return small_frame(
        df.sparkSession, rows, "position int, original_name string, column string, dtype string, kind string"
    )


def columns_of(df: DataFrame, kind: str) -> list[str]:
    return [s.original for s in column_specs(df) if s.kind == kind]


def select_kind(df: DataFrame, kind: str) -> DataFrame:
    """Project onto the columns of one kind."""
    return df.select(*[F.col(X.quote(c)) for c in columns_of(df, kind)])


def shape(df: DataFrame) -> DataFrame:
    """One row: row_count, column_count."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(data_columns(df))))


def _chunks(items: list, size: int):
    return [items[i : i + size] for i in range(0, len(items), size)]


def _present(c: str, dtype: T.DataType, mode: str) -> str:
    """The value where it is not missing under the mode's rule, else null."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return X.double(c, dtype)
    if mode == "raw":
        return f"CASE WHEN NOT {X.missing(c, dtype)} THEN {c} END" if X.kind_of(dtype) == X.CATEGORICAL else c
    return c


def _hashable(c: str, dtype: T.DataType) -> str:
    return X.as_text(c, dtype) if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)) else c


def per_column(df: DataFrame, columns: list[str], aggregates, fields: list[str]) -> DataFrame:
    """Run several aggregates for every column in one scan and lay them out as rows.

    ``aggregates(name)`` returns one SQL aggregate per field; the result has columns
    ``column`` and ``fields``.
    """
    parts = []
    for chunk in _chunks(columns, max(1, AGGREGATES_PER_SCAN // len(fields))):
        aggs, cells = [], []
        for i, name in enumerate(chunk):
            aggs += [f"{a} AS {f}_{i}" for f, a in zip(fields, aggregates(name))]
            cells.append(f"struct({X.text(name)} AS column, " + ", ".join(f"{f}_{i} AS {f}" for f in fields) + ")")
        parts.append(f"SELECT inline(array({', '.join(cells)})) FROM (SELECT {', '.join(aggs)} FROM {{t}})")
    return run_parts(df.sparkSession, parts, t=df)


def missing_counts(df: DataFrame, mode: str = "clean") -> DataFrame:
    """Per column: row_count, missing_count, missing_percentage; blanks count in raw mode."""
    dtypes = X.types_of(df)
    counted = per_column(
        df,
        data_columns(df),
        lambda c: ["count(*)", f"count({_present(X.quote(c), dtypes[c], mode)})"],
        ["row_count", "present_count"],
    )
    return counted.selectExpr(
        "column",
        "row_count",
        "present_count",
        "row_count - present_count AS missing_count",
        "coalesce(round(try_divide((row_count - present_count) * 100.0D, row_count), 2), 0D) AS missing_percentage",
    )


def missing_totals(df: DataFrame, mode: str = "clean") -> DataFrame:
    """One row: missing values over all columns."""
    return missing_counts(df, mode).agg(F.sum("missing_count").alias("missing_values"))


def value_groups(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: exact distinct count, and for text columns the most frequent value.

    Each column is grouped by its value, which combines on the map side, so a value holding a
    large share of the rows costs one row per task. Ties go to the smallest value.
    """
    columns = data_columns(df) if columns is None else columns
    dtypes = X.types_of(df)
    branches = []
    for name in columns:
        c, dtype = X.quote(name), dtypes[name]
        value = _hashable(_present(c, dtype, "clean"), dtype)
        best = "CAST(NULL AS STRING) AS top_value, CAST(NULL AS BIGINT) AS top_frequency"
        if X.kind_of(dtype) == X.CATEGORICAL:
            value = X.as_text(c, dtype)
            best = "min(struct(-n AS m, value)).value AS top_value, -min(struct(-n AS m, value)).m AS top_frequency"
        branches.append(
            f"""SELECT {X.text(name)} AS column, count(*) AS unique_values, {best}
            FROM (SELECT value, count(*) AS n FROM (SELECT {value} AS value FROM {{t}})
                  WHERE value IS NOT NULL GROUP BY value)"""
        )
    return run_parts(df.sparkSession, branches, t=df)


def approximate_distinct(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: approximate distinct count of the non-missing values, in one scan."""
    dtypes = X.types_of(df)
    columns = data_columns(df) if columns is None else columns
    return per_column(
        df,
        columns,
        lambda c: [f"approx_count_distinct({_hashable(_present(X.quote(c), dtypes[c], 'raw'), dtypes[c])})"],
        ["unique_values"],
    )


def first_values(df: DataFrame, columns: list[str] | None = None, k: int = 3, mode: str = "clean") -> DataFrame:
    """Per column: the first ``k`` present values in row order, as report text.

    The first rows of the table nearly always suffice. Columns with too few values there are
    searched over all rows, with ``k`` rows kept per task.
    """
    require_row(df)
    columns = data_columns(df) if columns is None else columns
    dtypes = X.types_of(df)

    def value(c):
        shown = X.report_form(_present(X.quote(c), dtypes[c], mode), dtypes[c])
        return f"CAST({shown} AS STRING)"

    found: dict[str, list[str]] = {}
    head = df.where(F.col(ROW) < HEAD_ROWS)
    early = per_column(
        head,
        columns,
        lambda c: [
            f"transform(slice(array_sort(collect_list(CASE WHEN {value(c)} IS NOT NULL "
            f"THEN struct({ROW} AS r, {value(c)} AS v) END)), 1, {k}), x -> x.v)"
        ],
        ["sample_values"],
    )
    for r in early.collect():
        found[r["column"]] = list(r["sample_values"])
    short = [c for c in columns if len(found[c]) < k]
    if short:
        branches = " UNION ALL ".join(
            f"(SELECT {X.text(c)} AS column, {ROW} AS r, {value(c)} AS v FROM {{t}} "
            f"WHERE {value(c)} IS NOT NULL ORDER BY {ROW} LIMIT {k})"
            for c in short
        )
        found.update({c: [] for c in short})
        for r in sorted(run_sql(df.sparkSession, branches, t=df).collect(), key=lambda r: r["r"]):
            found[r["column"]].append(r["v"])
    return small_frame(df.sparkSession, list(found.items()), "column string, sample_values array<string>")


def _specs_frame(df: DataFrame) -> DataFrame:
    rows = [(s.original, s.position, s.dtype, s.kind) for s in column_specs(df)]
    return small_frame(df.sparkSession, rows, "column string, position int, dtype string, kind string")


def distinct_counts(df: DataFrame, mode: str = "clean") -> DataFrame:
    """What a profile says of distinct values: approximate in raw mode, else exact and with each text column's most frequent value."""
    return approximate_distinct(df) if mode == "raw" else value_groups(df)


def profile(
    df: DataFrame, mode: str = "clean", samples: bool = True, distinct: DataFrame | None = None, missing: DataFrame | None = None
) -> DataFrame:
    """One row per column: dtype, missing count and %, distinct count, first three values.

    ``clean`` counts nulls as missing and distinct values exactly; ``raw`` counts blanks as
    missing too and distinct values approximately. ``distinct`` and ``missing`` pass ``distinct_counts`` and
    ``missing_counts`` when the caller has them already.
    """
    distinct = (distinct_counts(df, mode) if distinct is None else distinct).select("column", "unique_values")
    missing = missing_counts(df, mode) if missing is None else missing
    out = _specs_frame(df).join(missing, "column", "left").join(distinct, "column", "left")
    if samples:
        out = out.join(first_values(df, mode=mode), "column", "left")
    return out.drop("present_count", "row_count")


@dataclass(frozen=True)
class NumericStats:
    count: int
    mean: float | None
    std: float | None
    low: float | None
    high: float | None


def numeric_stats(df: DataFrame, columns: list[str]) -> dict[str, NumericStats]:
    """Count, mean, population deviation, minimum and maximum of numeric columns, in one scan."""
    if not columns:
        return {}
    dtypes = X.types_of(df)

    def aggregates(c):
        v = X.double(X.quote(c), dtypes[c])
        return [f"{f}({v})" for f in ("count", "avg", "stddev_pop", "min", "max")]

    rows = per_column(df, columns, aggregates, ["n", "mean", "std", "low", "high"]).collect()
    found = {r["column"]: NumericStats(r.n, r.mean, r.std, r.low, r.high) for r in rows}
    return {c: found[c] for c in columns}


NUMERIC_SUMMARY_SCHEMA = (
    "column string, count long, mean double, median double, std double, min double, max double, q1 double, q3 double"
)


def numeric_facts(df: DataFrame, columns: list[str] | None = None) -> list[tuple]:
    """Unrounded rows of :func:`numeric_summary`."""
    columns = columns_of(df, X.NUMERIC) if columns is None else columns
    stats = numeric_stats(df, columns)
    known = {i: (stats[c].count, stats[c].low, stats[c].high) for i, c in enumerate(columns)}
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75], known=known)
    return [
        (c, s.count, s.mean, quartiles[c][1], s.std, s.low, s.high, quartiles[c][0], quartiles[c][2])
        for c, s in stats.items()
    ]


def numeric_summary(df: DataFrame, columns: list[str] | None = None, digits: int | None = 4) -> DataFrame:
    """Per numeric column: count, mean, median, population std, min, max, q1, q3."""
    table = small_frame(df.sparkSession, numeric_facts(df, columns), NUMERIC_SUMMARY_SCHEMA)
    if digits is None:
        return table
    return table.selectExpr(
        "column", "count", *[f"round({f}, {digits}) AS {f}" for f in table.columns if f not in ("column", "count")]
    )


def datetime_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per datetime column: earliest and latest value as ISO text."""
    columns = columns_of(df, X.DATETIME) if columns is None else columns
    dtypes = X.types_of(df)
    if not columns:
        return small_frame(df.sparkSession, [], "column string, min_time string, max_time string")

    def aggregates(c):
        v = X.timestamp(X.quote(c), dtype=dtypes[c]) if X.kind_of(dtypes[c]) == X.DATETIME else X.timestamp(X.quote(c))
        return [f"min({v})", f"max({v})"]

    ranges = per_column(df, columns, aggregates, ["low", "high"])
    return ranges.selectExpr("column", f"{X.iso('low')} AS min_time", f"{X.iso('high')} AS max_time")


def categorical_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per text column: most frequent value and its frequency; ties go to the smallest value."""
    columns = columns_of(df, X.CATEGORICAL) if columns is None else columns
    if not columns:
        return small_frame(df.sparkSession, [], "column string, top_value string, top_frequency long")
    return value_groups(df, columns).select("column", "top_value", "top_frequency")


def summary_statistics(
    df: DataFrame, mode: str = "clean", facts: DataFrame | None = None, distinct: DataFrame | None = None, missing: DataFrame | None = None
) -> DataFrame:
    """One row per column: counts, plus the statistics of its kind (others null).

    ``castable_count`` is the number of values that are numbers, for numeric columns. ``facts``, ``distinct`` and
    ``missing`` pass what the caller has already.
    """
    numeric = numeric_summary(df) if facts is None else facts
    numeric = numeric.withColumnRenamed("count", "castable_count")
    missing = missing_counts(df, mode) if missing is None else missing
    counts = missing.select("column", F.col("present_count").alias("non_null_count"))
    groups = distinct_counts(df, mode) if distinct is None else distinct
    if mode == "raw":
        texts = columns_of(df, X.CATEGORICAL)
        groups = groups.join(categorical_summary(df, texts), "column", "left")
    return (
        _specs_frame(df)
        .join(counts, "column", "left")
        .join(groups, "column", "left")
        .join(numeric, "column", "left")
        .join(datetime_summary(df), "column", "left")
    )


def preview(df: DataFrame, n: int = 12) -> DataFrame:
    """The first ``n`` rows in row order."""
    return require_row(df).orderBy(ROW).limit(n)
