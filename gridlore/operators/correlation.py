"""Pearson correlation of numeric columns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from gridlore.functions import exprs as X
from gridlore.operators.gram import products
from gridlore.operators.profile import NumericStats, _chunks, columns_of, numeric_stats
from gridlore.session import run_parts, small_frame

PAIR_SCHEMA = "left_column string, right_column string, left_position int, right_position int, correlation double"
# pairs per scan, so that an aggregate's buffers stay under spark.sql.codegen.maxFields
PAIRS_PER_SCAN = 80
GAPPY_PAIRS_PER_SCAN = 8
WIDE_PAIRS = 640


def correlation_pairs(
    df: DataFrame,
    columns: list[str] | None = None,
    max_columns: int | None = None,
    null_as_zero: bool = False,
    stats: dict[str, NumericStats] | None = None,
    rows: int | None = None,
    digits: int | None = 3,
) -> DataFrame:
    """One row per column pair (left before right), over the rows where both have a value.

    A column that is constant on those rows has no correlation: null, or 0 on request. Two
    columns without nulls need one sum of products around their known means; a pair with nulls
    keeps its own deviations (``corr`` would fail on a constant column). More than WIDE_PAIRS pairs are
    computed by blocks of columns, see ``gram``. ``stats`` and ``rows``
    pass what an earlier scan found.
    """
    columns = columns_of(df, X.NUMERIC) if columns is None else columns
    columns = columns[:max_columns] if max_columns else columns
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    if not pairs:
        return small_frame(df.sparkSession, [], PAIR_SCHEMA)
    dtypes = X.types_of(df)
    stats = numeric_stats(df, columns) if stats is None else stats
    rows = df.count() if rows is None else rows
    known = [stats[c] for c in columns]
    if len(pairs) > WIDE_PAIRS:
        return _wide(df, columns, known, null_as_zero, digits)
    full = [s.count == rows and s.mean is not None and math.isfinite(s.mean) for s in known]

    def shared(i, j):
        if known[i].low == known[i].high or known[j].low == known[j].high:
            return "CAST(NULL AS DOUBLE)"
        products = f"sum((v{i} - {X.number(known[i].mean)}) * (v{j} - {X.number(known[j].mean)}))"
        return f"try_divide({products}, {X.number(rows)} * {X.number(known[i].std)} * {X.number(known[j].std)})"

    def own(i, j):
        left, right = f"CASE WHEN v{j} IS NOT NULL THEN v{i} END", f"CASE WHEN v{i} IS NOT NULL THEN v{j} END"
        return f"try_divide(covar_pop(v{i}, v{j}), stddev_pop({left}) * stddev_pop({right}))"

    complete = [p for p in pairs if full[p[0]] and full[p[1]]]
    gappy = [p for p in pairs if not (full[p[0]] and full[p[1]])]
    parts = []
    for formula, chunk in [
        *[(shared, c) for c in _chunks(complete, PAIRS_PER_SCAN)],
        *[(own, c) for c in _chunks(gappy, GAPPY_PAIRS_PER_SCAN)],
    ]:
        used = sorted({k for pair in chunk for k in pair})
        values = ", ".join(f"{X.double(X.quote(columns[k]), dtypes[columns[k]])} AS v{k}" for k in used)
        aggs = ", ".join(f"nullif({formula(i, j)}, CAST('NaN' AS DOUBLE)) AS r_{i}_{j}" for i, j in chunk)
        cells = []
        for i, j in chunk:
            r = f"CASE WHEN r_{i}_{j} > 1 THEN 1D WHEN r_{i}_{j} < -1 THEN -1D ELSE r_{i}_{j} END"
            r = f"round({r}, {digits})" if digits is not None else r
            r = f"coalesce({r}, 0D)" if null_as_zero else r
            cells.append(
                f"struct({X.text(columns[i])} AS left_column, {X.text(columns[j])} AS right_column, "
                f"{i} AS left_position, {j} AS right_position, {r} AS correlation)"
            )
        parts.append(f"SELECT inline(array({', '.join(cells)})) FROM (SELECT {aggs}, count(*) FROM (SELECT {values} FROM {{t}}))")
    return run_parts(df.sparkSession, parts, t=df)


def _wide(df: DataFrame, columns: list[str], known: list[NumericStats], null_as_zero: bool, digits: int | None) -> DataFrame:
    """The pairs of many columns, from sums of products by blocks of columns."""
    centres = [s.mean if s.mean is not None and math.isfinite(s.mean) else 0.0 for s in known]
    flat = [s.low == s.high for s in known]
    names = [(i, c, f) for i, (c, f) in enumerate(zip(columns, flat))]
    named = small_frame(df.sparkSession, names, "k int, name string, flat boolean")
    left = F.broadcast(named.toDF("i", "left_column", "left_flat"))
    right = F.broadcast(named.toDF("j", "right_column", "right_flat"))
    # what rounding leaves of a constant column's spread is no spread
    spread = "CASE WHEN q{0} - s{0} * s{0} / n > 1e-12 * q{0} THEN q{0} - s{0} * s{0} / n END"
    r = f"CASE WHEN NOT left_flat AND NOT right_flat THEN (p - sl * sr / n) / sqrt({spread.format('l')}) / sqrt({spread.format('r')}) END"
    cells = products(df, columns, centres).withColumn("n", F.expr("nullif(n, 0D)")).join(left, "i").join(right, "j")
    found = cells.withColumn("r", F.expr(f"nullif({r}, CAST('NaN' AS DOUBLE))"))
    r = "CASE WHEN r > 1 THEN 1D WHEN r < -1 THEN -1D ELSE r END"
    r = f"round({r}, {digits})" if digits is not None else r
    r = f"coalesce({r}, 0D)" if null_as_zero else r
    return found.selectExpr("left_column", "right_column", "i AS left_position", "j AS right_position", f"{r} AS correlation")


def heatmap(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """All cells (x, y, correlation) of the matrix: the pairs, their mirror, and a diagonal of 1."""
    diagonal = small_frame(
        pairs.sparkSession, [(c, c, i, i, 1.0) for i, c in enumerate(columns)], PAIR_SCHEMA
    )
    mirrored = pairs.selectExpr(
        "right_column AS left_column",
        "left_column AS right_column",
        "right_position AS left_position",
        "left_position AS right_position",
        "correlation",
    )
    return (
        pairs.unionByName(mirrored)
        .unionByName(diagonal)
        .selectExpr(
            "left_column AS x", "right_column AS y", "left_position AS x_position", "right_position AS y_position", "correlation"
        )
    )


def correlation_matrix(
    df: DataFrame,
    columns: list[str] | None = None,
    max_columns: int | None = None,
    null_as_zero: bool = False,
    stats: dict[str, NumericStats] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """The whole matrix as (x, y, correlation); empty with fewer than two numeric columns.

    In the null-as-null form a constant column has no diagonal value either.
    """
    columns = columns_of(df, X.NUMERIC) if columns is None else columns
    columns = columns[:max_columns] if max_columns else columns
    if len(columns) < 2:
        return heatmap(correlation_pairs(df, []), [])
    stats = numeric_stats(df, columns) if stats is None else stats
    matrix = heatmap(correlation_pairs(df, columns, None, null_as_zero, stats, rows), columns)
    flat = [c for c in columns if stats[c].low == stats[c].high]
    if null_as_zero or not flat:
        return matrix
    own = F.col("x") == F.col("y")
    return matrix.withColumn("correlation", F.when(~(own & F.col("x").isin(flat)), F.col("correlation")))


def strongest_pairs(pairs: DataFrame, k: int = 6) -> DataFrame:
    """The ``k`` pairs of largest absolute correlation; no correlation ranks as 0."""
    return pairs.orderBy(
        F.abs(F.coalesce("correlation", F.lit(0.0))).desc(), "left_position", "right_position"
    ).limit(k)
