"""The numbers behind each chart, computed over all rows and small once aggregated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gridlore.functions import exprs as X
from gridlore.operators import correlation as C
from gridlore.operators.ordering import BLOCK_ROWS, ROW, require_row, sorted_positions
from gridlore.operators.outliers import fences, outlier_rows
from gridlore.operators.profile import columns_of, numeric_facts, numeric_stats
from gridlore.operators.sampling import cap_rows
from gridlore.session import run_sql, small_frame

# Chart sizes.
BAR_VALUES = 10
PIE_VALUES = 5
LINE_POINTS = 180
DENSITY_BINS = 28
MIN_BINS, MAX_BINS = 10, 30
CHART_ROWS = 5_000

HISTOGRAM_SCHEMA = "bin long, left_edge double, right_edge double, label string, count long"


def category_counts(df: DataFrame, column: str, mode: str = "raw") -> DataFrame:
    """(category, count) of the non-missing values; sorting is left to the consumer."""
    dtype = X.types_of(df)[column]
    c = X.quote(column)
    present = f"{c} IS NOT NULL" if mode == "clean" else f"NOT ({X.missing(c, dtype)})"
    return df.where(present).groupBy(F.expr(X.as_text(c, dtype)).alias("category")).count()


def bar(df: DataFrame, column: str, k: int = BAR_VALUES, mode: str = "raw") -> DataFrame:
    """The ``k`` most frequent categories; ties in label order."""
    return category_counts(df, column, mode).orderBy(F.desc("count"), "category").limit(k)


def pie(df: DataFrame, column: str, k: int = PIE_VALUES, mode: str = "raw") -> DataFrame:
    """The ``k`` most frequent categories and the rest as ``Other`` (left out when empty)."""
    counts = category_counts(df, column, mode)
    top = counts.orderBy(F.desc("count"), "category").limit(k)
    rest = (
        counts.select("count")
        .unionByName(top.select((-F.col("count")).alias("count")))
        .agg(F.sum("count").alias("count"))
        .where("count > 0")
    )
    return top.unionByName(rest.select(F.lit("Other").alias("category"), "count"))


def _limits(df: DataFrame, columns: list[str], rounded: bool) -> dict[str, tuple[int, float, float]]:
    stats = numeric_stats(df, columns)
    if rounded:
        return {c: (s.count, s.low and round(s.low, 4), s.high and round(s.high, 4)) for c, s in stats.items()}
    return {c: (s.count, s.low, s.high) for c, s in stats.items()}


def histogram(
    df: DataFrame, column: str, bins: int | None = None, rounded: bool = False, known: tuple | None = None
) -> DataFrame:
    """Equal-width bins with their edges, label and count; empty bins count 0.

    ``rounded`` takes the edges from the minimum and maximum rounded to four decimals.
    ``known`` passes (count, minimum, maximum) when the caller has them.
    """
    spark = df.sparkSession
    n, low, high = known or _limits(df, [column], rounded)[column]
    if not n:
        return small_frame(spark, [], HISTOGRAM_SCHEMA)
    bins = bins or min(MAX_BINS, max(MIN_BINS, n))
    width = (high - low) / bins
    if low == high or not width > 0:
        return small_frame(spark, [(0, low, high, f"{low:.4g}", n)], HISTOGRAM_SCHEMA)
    value = X.double(X.quote(column), X.types_of(df)[column])
    counted = (
        df.selectExpr(f"{value} AS v")
        .where("v IS NOT NULL")
        .groupBy(F.expr(X.equal_width_bin("v", low, width, bins)).alias("bin"))
        .count()
    )
    lefts = [low + b * width for b in range(bins)]
    rights = [left + width for left in lefts[:-1]] + [high]
    rows = [(b, lo, hi, f"{lo:.4g} to {hi:.4g}") for b, (lo, hi) in enumerate(zip(lefts, rights))]
    edges = small_frame(spark, rows, "bin long, left_edge double, right_edge double, label string")
    return edges.join(counted, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))


def sampled_histogram(df: DataFrame, column: str, n: int = CHART_ROWS) -> DataFrame:
    """Histogram of at most ``n`` sampled rows, with a fifth as many bins, 10 to 30."""
    drawn = cap_rows(df.select(ROW, X.quote(column)), n)
    size = drawn.count()
    return histogram(drawn, column, bins=min(MAX_BINS, max(MIN_BINS, size // 5)))


BOX_SCHEMA = (
    "column string, q1 double, median double, q3 double, min double, max double, lower_bound double, upper_bound double"
)


def box(df: DataFrame, column: str, facts: list[tuple] | None = None) -> DataFrame:
    """Quartiles and whiskers; whiskers end at the last values inside the fences."""
    facts = numeric_facts(df, [column]) if facts is None else facts
    fact = next(f for f in facts if f[0] == column)
    _, n, _, median, _, low, high, q1, q3 = fact
    if not n:
        return small_frame(
            df.sparkSession,
            [],
            "column string, q1 double, median double, q3 double, lower_fence double, upper_fence double",
        )
    _, _, _, lower, upper = fences([fact]).get(column, (n, q1, q3, low, high))
    value = X.double(X.quote(column), X.types_of(df)[column])
    return (
        df.selectExpr(f"{value} AS v")
        .selectExpr(
            f"coalesce(min(v) FILTER (WHERE v >= {X.number(lower)}), {X.number(low)}) AS lower_fence",
            f"coalesce(max(v) FILTER (WHERE v <= {X.number(upper)}), {X.number(high)}) AS upper_fence",
        )
        .selectExpr(
            f"{X.text(column)} AS column",
            f"{X.number(q1)} AS q1",
            f"{X.number(median)} AS median",
            f"{X.number(q3)} AS q3",
            "lower_fence",
            "upper_fence",
        )
    )


def sampled_box(df: DataFrame, column: str, n: int = CHART_ROWS) -> tuple[DataFrame, DataFrame]:
    """Box of at most ``n`` sampled rows, and the sampled values outside its fences."""
    drawn = cap_rows(df.select(ROW, X.quote(column)), n)
    facts = numeric_facts(drawn, [column])
    return box(drawn, column, facts), outlier_rows(drawn, column, facts)


def density(
    df: DataFrame, x: str, y: str, bins: int = DENSITY_BINS, rounded: bool = False, known: dict | None = None
) -> DataFrame:
    """Counts on a ``bins`` × ``bins`` grid, labelled by cell centres; empty cells count 0."""
    spark = df.sparkSession
    schema = "x_bin long, y_bin long, x_label string, y_label string, count long"
    known = known or _limits(df, [x, y], rounded)
    (nx, x_low, x_high), (ny, y_low, y_high) = known[x], known[y]
    if not nx or not ny or x_low == x_high or y_low == y_high:
        return small_frame(spark, [], schema)
    dx, dy = (x_high - x_low) / bins, (y_high - y_low) / bins
    dtypes = X.types_of(df)
    counted = (
        df.selectExpr(f"{X.double(X.quote(x), dtypes[x])} AS xv", f"{X.double(X.quote(y), dtypes[y])} AS yv")
        .where("xv IS NOT NULL AND yv IS NOT NULL")
        .groupBy(
            F.expr(X.equal_width_bin("xv", x_low, dx, bins)).alias("x_bin"),
            F.expr(X.equal_width_bin("yv", y_low, dy, bins)).alias("y_bin"),
        )
        .count()
    )
    cells = [
        (i, j, f"{x_low + (i + 0.5) * dx:.4g}", f"{y_low + (j + 0.5) * dy:.4g}") for i in range(bins) for j in range(bins)
    ]
    grid = small_frame(spark, cells, "x_bin long, y_bin long, x_label string, y_label string")
    return grid.join(counted, ["x_bin", "y_bin"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))


def scatter(df: DataFrame, x: str, y: str, n: int = CHART_ROWS) -> DataFrame:
    """At most ``n`` sampled (x, y) points."""
    drawn = cap_rows(df.select(ROW, X.quote(x), X.quote(y)), n)
    return drawn.select(F.col(X.quote(x)).alias("x"), F.col(X.quote(y)).alias("y"))


def _timed(df: DataFrame, time: str, column: str) -> DataFrame:
    dtypes = X.types_of(df)
    t = X.timestamp(X.quote(time), dtype=dtypes[time]) if X.kind_of(dtypes[time]) == X.DATETIME else X.timestamp(X.quote(time))
    v = X.double(X.quote(column), dtypes[column])
    return df.selectExpr(f"{t} AS x", f"{v} AS y").where("x IS NOT NULL AND y IS NOT NULL").groupBy("x").agg(F.avg("y").alias("y"))


def line_time(df: DataFrame, time: str, column: str, points: int = LINE_POINTS) -> DataFrame:
    """Mean per time, then dealt in time order into ``points`` buckets: first time, mean of means."""
    placed = sorted_positions(_timed(df, time, column), ["x"], "_position")
    bucket = X.ntile_of("_position", "total", points)
    return run_sql(
        df.sparkSession,
        f"""
        SELECT min(x) AS x, avg(y) AS y
        FROM (SELECT *, (SELECT max(_position) + 1 FROM {{p}}) AS total FROM {{p}})
        GROUP BY {bucket}
        """,
        p=placed,
    )


def line_order(
    df: DataFrame, column: str, points: int = LINE_POINTS, dense: bool = False, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Non-null values dealt in row order into ``points`` buckets: first record index, mean value.

    Values are counted and summed per block of row numbers. Only a block that a bucket boundary
    cuts through, at most one per boundary, has its rows numbered; the others go to their bucket
    whole. ``dense`` counts record indexes over the present values instead of source rows.
    """
    value = X.double(X.quote(column), X.types_of(df)[column])
    pairs = require_row(df).selectExpr(ROW, f"{ROW} div {block_rows} AS block", f"{value} AS y").where("y IS NOT NULL")
    blocks = run_sql(
        df.sparkSession,
        """
        SELECT *, coalesce(sum(n) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS before,
               sum(n) OVER () AS total
        FROM (SELECT block, count(*) AS n, sum(y) AS s, min(_row) AS first_row FROM {pairs} GROUP BY block)
        """,
        pairs=pairs,
    )
    first, last = X.ntile_of("before", "total", points), X.ntile_of("(before + n - 1)", "total", points)
    placed = blocks.withColumns({"bucket": F.expr(first), "end_bucket": F.expr(last)})
    index = "min(position) + 1" if dense else "min(first_row) + 1"
    inside = "before + row_number() OVER (PARTITION BY block ORDER BY _row) - 1"
    return run_sql(
        df.sparkSession,
        f"""
        SELECT {index} AS record_index, sum(s) / sum(n) AS y FROM (
            SELECT bucket, n, s, first_row, before AS position FROM {{placed}} WHERE bucket = end_bucket
            UNION ALL
            SELECT {X.ntile_of('position', 'total', points)}, 1L, y, _row, position FROM (
                SELECT /*+ BROADCAST(cut) */ _row, y, cut.total, {inside} AS position
                FROM {{pairs}} JOIN (SELECT block, before, total FROM {{placed}} WHERE bucket <> end_bucket) cut
                USING (block)))
        GROUP BY bucket
        """,
        pairs=pairs,
        placed=placed,
    )


def sampled_line(df: DataFrame, column: str, time: str | None = None, n: int = CHART_ROWS) -> DataFrame:
    """Line over at most ``n`` sampled rows: mean per time, or record index 1..n."""
    drawn = cap_rows(df.select(ROW, X.quote(column), *([X.quote(time)] if time else [])), n)
    if time:
        return _timed(drawn, time, column).orderBy("x")
    # at most n rows
    value = X.double(X.quote(column), X.types_of(df)[column])
    return drawn.selectExpr(f"row_number() OVER (ORDER BY {ROW}) AS record_index", f"{value} AS y")


CHART_COLUMNS = ["chart_id", "chart_type", "title", "position", "x", "y", "value"]


def charts(df: DataFrame, mode: str = "clean", facts: list[tuple] | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """All charts of a table as one tidy frame, for its first text, numeric and datetime columns.

    ``raw`` shows two numeric columns as a density grid, ``clean`` as a sampled scatter.
    """
    texts, numbers, times = (columns_of(df, k) for k in (X.CATEGORICAL, X.NUMERIC, X.DATETIME))
    facts = (numeric_facts(df, numbers) if facts is None else facts) if numbers else []
    known = {f[0]: (f[1], f[5], f[6]) for f in facts}
    parts: list[tuple[str, str, str, DataFrame]] = []

    def add(chart_id, kind, title, frame, position, x, y, value):
        columns = [f"CAST({e} AS {t}) AS {n}" for e, t, n in zip(
            (position, x, y, value), ("LONG", "STRING", "STRING", "DOUBLE"), CHART_COLUMNS[3:])]
        parts.append((chart_id, kind, title, frame.selectExpr(*columns)))

    if texts:
        c = texts[0]
        place = "row_number() OVER (ORDER BY count DESC, category)"  # at most ten categories
        last = "row_number() OVER (ORDER BY category = 'Other', count DESC, category)"
        add(f"bar-{c}", "bar", f"Bar chart for {c}", bar(df, c, mode=mode), place, "category", "NULL", "count")
        add(f"pie-{c}", "pie", f"Pie chart for {c}", pie(df, c, mode=mode), last, "category", "NULL", "count")
    if numbers:
        c = numbers[0]
        if known[c][0]:
            add(f"histogram-{c}", "histogram", f"Histogram for {c}", histogram(df, c, known=known[c]), "bin", "label", "NULL", "count")
            whiskers = box(df, c, facts).selectExpr(
                "stack(5, 1, 'lower_fence', lower_fence, 2, 'q1', q1, 3, 'median', median, 4, 'q3', q3, "
                "5, 'upper_fence', upper_fence) AS (place, part, value)"
            )
            add(f"box-{c}", "box", f"Box plot for {c}", whiskers, "place", "part", "NULL", "value")
    if len(numbers) > 1:
        x, y = numbers[:2]
        if mode == "raw":
            grid = density(df, x, y, known=known)
            add(f"density-{x}-{y}", "heatmap", f"Density map for {x} and {y}", grid, "x_bin + 28 * y_bin", "x_label", "y_label", "count")
        else:
            add(f"scatter-{x}-{y}", "scatter", f"Scatter plot for {x} and {y}", scatter(df, x, y), "NULL", "x", "y", "NULL")
    if numbers:
        c = numbers[0]
        if times:
            add(f"line-{c}", "line", f"Line chart for {c}", line_time(df, times[0], c), "NULL", X.iso("x"), "NULL", "y")
        else:
            add(f"line-{c}", "line", f"Line chart for {c}", line_order(df, c, dense=mode == "clean"), "record_index", "record_index", "NULL", "y")
    if len(numbers) > 1:
        pairs = C.correlation_pairs(df, numbers, null_as_zero=mode == "raw") if pairs is None else pairs
        cells = C.heatmap(pairs, numbers)
        add("heatmap-correlations", "heatmap", "Correlation heatmap", cells, "NULL", "x", "y", "correlation")
    frames = [
        frame.select(F.lit(i).alias("chart_id"), F.lit(k).alias("chart_type"), F.lit(t).alias("title"), "*")
        for i, k, t, frame in parts
    ]
    if not frames:
        return small_frame(df.sparkSession, [], "chart_id string, chart_type string, title string, position long, x string, y string, value double")
    return reduce(DataFrame.unionByName, frames)
