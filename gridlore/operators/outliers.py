"""Interquartile-range outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridlore.functions import exprs as X
from gridlore.operators.profile import NUMERIC_SUMMARY_SCHEMA, numeric_facts, per_column
from gridlore.session import small_frame

FENCE = 1.5
MIN_VALUES = 4
BOUNDS_SCHEMA = (
    "column string, non_null_count long, q1 double, q3 double, lower_bound double, upper_bound double"
)


def fences(facts: list[tuple]) -> dict[str, tuple[int, float, float, float, float]]:
    """Bounds by column from unrounded numeric facts; columns too short or too flat are left out."""
    names = [f.split()[0] for f in NUMERIC_SUMMARY_SCHEMA.split(", ")]
    bounds = {}
    for fact in (dict(zip(names, row)) for row in facts):
        if fact["count"] < MIN_VALUES:
            continue
        spread = fact["q3"] - fact["q1"]
        if spread != 0 and spread == spread:
            low, high = fact["q1"] - FENCE * spread, fact["q3"] + FENCE * spread
            bounds[fact["column"]] = (fact["count"], fact["q1"], fact["q3"], low, high)
    return bounds


def iqr_bounds(df: DataFrame, columns: list[str] | None = None, facts: list[tuple] | None = None) -> DataFrame:
    """Per numeric column with at least four values and a spread: quartiles and fences."""
    facts = numeric_facts(df, columns) if facts is None else facts
    rows = [(c, *bound) for c, bound in fences(facts).items()]
    return small_frame(df.sparkSession, rows, BOUNDS_SCHEMA)


def _outside(c: str, low: float, high: float) -> str:
    return f"{c} < {X.number(low)} OR {c} > {X.number(high)}"


def outliers(df: DataFrame, columns: list[str] | None = None, facts: list[tuple] | None = None) -> DataFrame:
    """Per column that has any: outlier count, percentage of its values, fences (4 dp).

    The fences, two numbers per column, go into the counting scan as constants.
    """
    facts = numeric_facts(df, columns) if facts is None else facts
    bounds = fences(facts)
    dtypes = X.types_of(df)
    schema = "column string, count long, percentage double, lower_bound double, upper_bound double"
    if not bounds:
        return small_frame(df.sparkSession, [], schema)

    def aggregates(c):
        total, _, _, low, high = bounds[c]
        return [
            f"count_if({_outside(X.double(X.quote(c), dtypes[c]), low, high)})",
            f"first({total}L)",
            f"first(round({X.number(low)}, 4))",
            f"first(round({X.number(high)}, 4))",
        ]

    counted = per_column(df, list(bounds), aggregates, ["count", "total", "lower_bound", "upper_bound"])
    return counted.where("count > 0").selectExpr(
        "column", "count", "round(count * 100.0D / total, 2) AS percentage", "lower_bound", "upper_bound"
    )


def outlier_rows(df: DataFrame, column: str, facts: list[tuple] | None = None) -> DataFrame:
    """The rows whose value in ``column`` lies outside its fences."""
    facts = numeric_facts(df, [column]) if facts is None else facts
    bound = fences(facts).get(column)
    if bound is None:
        return df.limit(0)
    value = X.double(X.quote(column), X.types_of(df)[column])
    return df.where(_outside(value, bound[3], bound[4]))


def top_outlier(table: DataFrame) -> DataFrame:
    """The column with the most outliers; ties go to the smaller name."""
    return table.orderBy(F.col("count").desc(), "column").limit(1)
