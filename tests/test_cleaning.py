"""Names, inference, duplicates, imputation and the edge tables."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from gridlore.functions import exprs as X
from gridlore.functions.names import make_unique, normalize_name, unique_names
from gridlore.operators import cleaning as C
from gridlore.operators.ordering import ROW
from gridlore.session import small_frame


def texts(spark, values, name="c"):
    return small_frame(spark, [(v, i) for i, v in enumerate(values)], f"{name} string, {ROW} long")


def test_names():
    assert unique_names(["Event ID", "Event-Day", "event day", "Amount ($)", "%%%"]) == [
        "event_id", "event_day", "event_day_2", "amount", "column",
    ]
    assert make_unique(["x", "x", "x_2", "x"]) == ["x", "x_3", "x_2", "x_4"]
    assert normalize_name("  __A  b__ ") == "a_b"


def test_numbers(spark):
    values = ["1e3", "1,000", "1d", "5f", "inf", "nan", "", " 7 ", "-.5", "+2.", "0x10", None]
    got = texts(spark, values).orderBy(ROW).selectExpr(f"{X.double('c')} AS v").collect()
    assert [r.v for r in got] == [1000.0, None, None, None, float("inf"), None, None, 7.0, -0.5, 2.0, None, None]


def test_dates(spark):
    def kind(values):
        return C.inspect_text(texts(spark, values), ["c"])["c"]

    assert kind(["2025-01-03", "2025-1-4", "2025-01-05T10:11:12"]).date_format == "iso"
    assert kind(["01/03/2025", "02/28/2025"]).date_format == "M/d/yyyy"
    assert kind(["13/03/2025", "28/02/2025"]).date_format == "d/M/yyyy"
    for text, fmt, day, hour in [
        ("01/23/25", "M/d/yy", 23, 0), ("23/01/25", "d/M/yy", 23, 0), ("1/23/2025 4:05 PM", "M/d/yyyy h:mm a", 23, 16),
        ("23-Jan-25", "d-MMM-yy", 23, 0), ("Jan 23, 2025 10:00", "MMM d, yyyy H:mm", 23, 10),
        ("2025/01/23 10:00", "yyyy/M/d H:mm", 23, 10), ("23-jan-2025 10:00", "d-MMM-yyyy H:mm", 23, 10),
        ("2025-01-23T02:00:00+02:00", "iso", 23, 0), ("2025-01-23T00:30:00+0100", "iso", 22, 23),
    ]:
        found = kind([text, text, None])
        assert found.date_format == fmt and found.kind() == X.DATETIME
        read = C.infer_types(texts(spark, [text])).first().c
        assert (read.year, read.day, read.hour) == (2025, day, hour)
    assert C.infer_types(texts(spark, ["01/23/92"])).first().c.year == 1992
    assert kind(["2025", "2024"]).kind() == X.NUMERIC  # bare years are numbers
    assert kind(["-1.5", "-2"]).kind() == X.NUMERIC  # a minus looks like a date but does not parse as one
    assert kind(["2025-01-03", "03 Jan", "x", "y"]).kind() == X.CATEGORICAL
    assert kind([None, None]).kind() == X.CATEGORICAL


def test_inference_threshold(spark):
    mostly = C.infer_types(texts(spark, ["1"] * 17 + ["x"] * 3))
    assert X.kind_of(mostly.schema["c"].dataType) == X.NUMERIC and mostly.where("c IS NULL").count() == 3
    assert C.infer_types(texts(spark, ["1"] * 16 + ["x"] * 4)).schema["c"].dataType.simpleString() == "string"
    assert C.infer_types(texts(spark, ["1", "2"])).schema["c"].dataType.simpleString() == "bigint"
    assert C.infer_types(texts(spark, ["1", None])).schema["c"].dataType.simpleString() == "double"


def test_mode_ties_take_the_smallest(spark):
    df = texts(spark, ["b", "a", "b", "a", None, "c"])
    assert {r.c for r in C.impute(df).where(f"{ROW} = 4").collect()} == {"a"}


def test_clean_small_table(spark):
    rows = [
        (" x ", "2025-01-01", "1", None, 0),
        ("x", "2025-01-01", "1", None, 1),
        (None, None, None, None, 2),
        ("y", None, "4", None, 3),
        (None, "2025-01-03", None, None, 4),
        ("y", "2025-01-03", "10", None, 5),
        ("z", "2025-01-04", "11", None, 6),
    ]
    df = small_frame(spark, rows, f"`A b` string, `When` string, N string, E string, {ROW} long")
    cleaned, s = C.clean(df)
    assert (s.original_rows, s.original_columns, s.cleaned_rows, s.cleaned_columns) == (7, 4, 5, 3)
    assert (s.empty_rows_dropped, s.duplicate_rows_removed, s.removed_columns) == (1, 1, ["e"])
    assert (s.missing_values_before, s.missing_values_after) == (3, 0)
    assert [(r.a_b, r.when.day, r.n) for r in cleaned.orderBy(ROW).collect()] == [
        ("x", 1, 1.0), ("y", 1, 4.0), ("y", 3, 7.0), ("y", 3, 10.0), ("z", 4, 11.0),
    ]


def test_clean_keeps_an_untouched_table(spark, folder):
    from gridlore.sources.readers import read_parquet

    orders = read_parquet(spark, f"{folder}/orders.parquet")
    cleaned, s = C.clean(orders)
    assert s.duplicate_rows_removed == 0 and s.missing_values_before == 0
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "orders.parquet" in plan


def test_duplicates_do_not_depend_on_partitions(spark):
    df = spark.range(600).selectExpr("id % 7 AS a", "CASE WHEN id % 3 = 0 THEN NULL ELSE id % 5 END AS b", f"id AS {ROW}")
    one, two = (sorted(map(tuple, C.drop_duplicates(d).collect()), key=str) for d in (df, df.repartition(13)))
    assert one == two and len(one) == df.select("a", "b").distinct().count()


def test_kinds(spark):
    df = spark.sql(
        "SELECT true AS b, CAST(1.5 AS DECIMAL(5,2)) AS d, DATE'2025-01-01' AS t, array(1, 2) AS a, "
        "named_struct('x', 1) AS s, INTERVAL 1 DAY AS i, 1 AS n, 0 AS _row"
    )
    kinds = {f.name: X.kind_of(f.dataType) for f in df.schema.fields}
    assert kinds["d"] == kinds["n"] == X.NUMERIC and kinds["t"] == X.DATETIME
    assert all(kinds[c] == X.CATEGORICAL for c in "basi")
    cleaned, s = C.clean(df.drop("i"))
    assert s.types["a"] == s.types["s"] == "string" and cleaned.first().a == "[1,2]"


def test_blank_text_counts_by_mode(spark):
    from gridlore.operators.profile import missing_counts

    df = texts(spark, ["a", " ", None, "b"])
    assert missing_counts(df).first().missing_count == 1
    assert missing_counts(df, "raw").first().missing_count == 2


def test_all_blank_column_survives_cleaning(spark):
    cleaned, s = C.clean(small_frame(spark, [(" ", 1, 0), (" ", 2, 1)], f"c string, n int, {ROW} long"))
    assert s.removed_columns == [] and {r.c for r in cleaned.collect()} == {""}


def test_integer_median_may_be_fractional(spark):
    df = small_frame(spark, [(1, 0), (2, 1), (None, 2)], f"n long, {ROW} long")
    assert [r.n for r in C.impute(df).orderBy(ROW).collect()] == [1.0, 2.0, 1.5]


def test_row_order_is_required(spark):
    with pytest.raises(ValueError):
        C.clean(spark.range(3))


def test_time_fill_uses_row_order(spark):
    days = [None, dt.datetime(2025, 1, 5), None, dt.datetime(2025, 1, 1), None]
    df = small_frame(spark, [(d, i) for i, d in enumerate(days)], f"t timestamp_ntz, {ROW} long").repartition(5)
    assert [r.t.day for r in C.impute(df).orderBy(ROW).collect()] == [5, 5, 5, 1, 1]
    assert C.impute(df).where(F.col("t").isNull()).count() == 0


def test_only_possible_copies_are_shuffled(spark):
    """Rows whose hash is their own stay where they are."""
    df = spark.range(0, 20_000, 1, 8).selectExpr("CASE WHEN id < 60 THEN id % 20 ELSE id END AS a", "repeat('x', 40) AS b", f"id AS {ROW}")
    unique = C.drop_duplicates(df)
    assert unique.count() == 19_960 and sorted(r[ROW] for r in unique.where("a < 20").collect()) == list(range(20))
    plan = unique._jdf.queryExecution()
    unique.collect()
    shuffled = [int(n) for n in re.findall(r"shuffle records written: ([0-9,]+)", _metrics(plan))]
    assert sum(shuffled) < 2_000


def _metrics(execution):
    """Numbers of rows that exchanges of a plan that has run wrote."""
    found, plans = [], [execution.executedPlan()]
    while plans:
        plan = plans.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            plans.append(plan.plan())
            continue
        if name == "ShuffleExchangeExec":
            found.append(f"shuffle records written: {plan.metrics().apply('shuffleRecordsWritten').value()}")
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
    return "\n".join(found)


def test_inference_is_one_scan_for_any_width(spark):
    """The plan doesn't grow with the number of text columns, and the table is read once."""
    sizes = []
    for width in (10, 100):
        df = spark.range(50).selectExpr(*[f"CAST(id + {i} AS STRING) AS c{i}" for i in range(width)], f"id AS {ROW}")
        noted = C.materialize(df)
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
        found = C.inspect_text(noted, [f"c{i}" for i in range(width)])
        sizes.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - before)
        assert all(f.numbers == f.integers == f.values == 50 for f in found.values()) and len(found) == width
    assert sizes[0] == sizes[1]


def test_copies_and_gaps_are_counted_as_they_are_written(spark):
    rows = [("a", None, 1.0, 0), ("a", None, 1.0, 1), ("b", dt.datetime(2025, 1, 1), None, 2), ("b", dt.datetime(2025, 1, 1), None, 3), ("b", dt.datetime(2025, 1, 1), None, 4), ("c", None, 2.0, 5)]
    cleaned, s = C.clean(small_frame(spark, rows, f"s string, t timestamp_ntz, n double, {ROW} long"))
    assert (s.cleaned_rows, s.duplicate_rows_removed, s.missing_values_before, s.missing_values_after) == (3, 3, 6, 0)
    assert [(r.s, r.t.day, r.n, r[ROW]) for r in cleaned.orderBy(ROW).collect()] == [("a", 1, 1.0, 0), ("b", 1, 1.5, 2), ("c", 1, 2.0, 5)]


def test_many_filled_dates_are_put_in_once(spark):
    """Later scans of a table of many gaps neither join nor sort rows."""
    df = spark.range(140_000).selectExpr("id AS n", "CASE WHEN id % 2 = 1 THEN timestamp_ntz'2025-01-01' + make_interval(0, 0, 0, id % 28) END AS t", f"id AS {ROW}")
    cleaned, s = C.clean(df)
    assert (s.missing_values_before, s.missing_values_after) == (70_000, 0)
    assert cleaned.where(f"day(t) <> 1 + CASE WHEN n = 0 THEN 1 WHEN n % 2 = 1 THEN n % 28 ELSE (n - 1) % 28 END OR n <> {ROW}").count() == 0
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    assert cleaned.count() == 140_000 and not any(w in plan for w in ("Join", "Window", "Exchange"))


def test_gaps_are_filled_the_same_either_way(spark, monkeypatch):
    from gridlore.operators import ordering as H

    df = spark.range(500).selectExpr("CASE WHEN id % 7 < 5 THEN id END AS t", "CASE WHEN id % 11 = 3 THEN id END AS u", "id AS v0", f"id AS {ROW}").repartition(4)
    few = sorted(map(tuple, H.fill_gaps(df, ["t", "u"]).collect()), key=lambda r: r[3])
    monkeypatch.setattr(H, "FILLED_ROWS", 0)
    assert few == sorted(map(tuple, H.fill_gaps(df, ["t", "u"]).collect()), key=lambda r: r[3]) and all(r[0] is not None for r in few)
