"""Correlation, outliers, trends, charts, samples and splits on edge tables."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from gridlore.operators import charts as V, ordering
from gridlore.operators import correlation as R
from gridlore.operators import modeling as M
from gridlore.operators import outliers as O
from gridlore.operators import profile as D
from gridlore.operators import quantiles as Q
from gridlore.operators import sampling as K
from gridlore.operators import trends as T
from gridlore.operators.ordering import ROW
from gridlore.plans import report
from gridlore.session import small_frame
from gridlore.sources.readers import read_parquet

FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def numbers(spark, **columns):
    names = list(columns)
    rows = [(*values, i) for i, values in enumerate(zip(*columns.values()))]
    return small_frame(spark, rows, ", ".join(f"{n} double" for n in names) + f", {ROW} long")


@FEW
@given(st.lists(st.tuples(*[st.none() | st.floats(-1e6, 1e6)] * 3), min_size=2, max_size=40))
def test_correlation_matches_numpy(spark, rows):
    df = small_frame(spark, [(*r, i) for i, r in enumerate(rows)], f"a double, b double, c double, {ROW} long")
    for pair in R.correlation_pairs(df, ["a", "b", "c"], digits=None).collect():
        both = [(r[pair.left_position], r[pair.right_position]) for r in rows]
        both = np.array([p for p in both if None not in p], dtype=float).reshape(-1, 2)
        spread = both.std(axis=0) if len(both) else np.zeros(2)
        if (spread == 0).any():
            assert pair.correlation is None
        elif pair.correlation is not None and (spread > 1e-3).all():
            assert pair.correlation == pytest.approx(np.corrcoef(both.T)[0, 1], abs=1e-6)
            assert -1 <= pair.correlation <= 1


def test_constant_column(spark):
    df = numbers(spark, a=[1.0, 2.0, 3.0, 4.0], k=[0.1] * 4)
    assert R.correlation_pairs(df).first().correlation is None
    assert R.correlation_pairs(df, null_as_zero=True).first().correlation == 0.0
    cells = {(r.x, r.y): r.correlation for r in R.correlation_matrix(df).collect()}
    assert cells == {("a", "a"): 1.0, ("k", "k"): None, ("a", "k"): None, ("k", "a"): None}
    assert R.correlation_matrix(df.select("a", ROW)).count() == 0
    assert O.outliers(df.select("k", ROW)).count() == 0
    trend = {r["column"]: r for r in T.trends(df).collect()}
    assert trend["k"].direction == "stable" and trend["k"].slope is None and trend["a"].direction == "upward"
    single = V.histogram(df, "k").collect()
    assert [(r.label, r["count"]) for r in single] == [("0.1", 4)]
    assert V.density(df, "a", "k").count() == 0


def test_short_and_flat_columns_have_no_outliers(spark):
    assert O.iqr_bounds(numbers(spark, a=[1.0, 2.0, 300.0])).count() == 0
    assert O.iqr_bounds(numbers(spark, a=[5.0, 5.0, 5.0, 5.0, 99.0])).count() == 0
    found = O.outliers(numbers(spark, a=[1.0, 2.0, 3.0, 4.0, 100.0])).first()
    assert (found["count"], found.percentage) == (1, 20.0)


def test_summary_of_an_empty_numeric_column(spark):
    row = D.numeric_summary(numbers(spark, a=[None, None])).first()
    assert row["count"] == 0 and row.mean is None and row.median is None
    assert V.histogram(numbers(spark, a=[None, None]), "a").count() == 0
    assert V.box(numbers(spark, a=[None, None]), "a").count() == 0


def test_wide_tables(spark):
    columns = [f"CAST(id * {i % 7 + 1} % {i + 2} AS DOUBLE) AS c{i}" for i in range(60)]
    df = spark.range(200).selectExpr(*columns, f"id AS {ROW}")
    assert D.numeric_summary(df).count() == 60
    assert {r["column"]: r.unique_values for r in D.value_groups(df).collect()}["c0"] == 2
    for small_rows in (0, 10**6):  # both quantile paths, in batches of columns
        assert len(Q.exact_quantiles(df, df.columns[:-1], [0.5], small_rows=small_rows)) == 60
    assert R.correlation_pairs(df).count() == 60 * 59 // 2
    assert D.missing_counts(df).count() == 60


@FEW
@given(st.lists(st.none() | st.floats(-1e9, 1e9), min_size=1, max_size=80))
def test_histogram_holds_every_value(spark, values):
    df = numbers(spark, a=values)
    present = sum(v is not None for v in values)
    assert sum(r["count"] for r in V.histogram(df, "a").collect()) == present


def test_density_holds_every_point(spark, folder):
    lines = read_parquet(spark, f"{folder}/lineitem.parquet")
    grid = V.density(lines, "l_quantity", "l_tax")
    assert grid.count() == 28 * 28 and grid.agg({"count": "sum"}).first()[0] == lines.count()


@pytest.mark.parametrize("n", [1, 5, 179, 180, 181, 900])
@pytest.mark.parametrize("block", [7, 1000])
def test_line_over_rows(spark, n, block):
    df = spark.range(n).selectExpr("CASE WHEN id % 4 = 3 THEN NULL ELSE CAST(id * id AS DOUBLE) END AS v", f"id AS {ROW}")
    kept = [(i + 1, float(i * i)) for i in range(n) if i % 4 != 3]
    parts = [p for p in np.array_split(np.array(kept), 180) if len(p)]
    got = sorted((r.record_index, r.y) for r in V.line_order(df, "v", block_rows=block).collect())
    assert np.allclose(got, [(p[0][0], p[:, 1].mean()) for p in parts])


def test_samples_are_exact_and_stable(spark, folder):
    lines = read_parquet(spark, f"{folder}/lineitem.parquet").select("l_orderkey", ROW)
    for n in (0, 1, 100, 5_999, 10**6):
        assert K.sample_n(lines, n).count() == min(n, lines.count())
    one, two = (sorted(r[ROW] for r in K.sample_n(d, 500).collect()) for d in (lines, lines.repartition(13)))
    assert one == two and one != sorted(r[ROW] for r in K.sample_n(lines, 500, seed=7).collect())
    assert abs(np.mean(one) / lines.count() - 0.5) < 0.1


def test_sample_of_copies(spark):
    same = spark.range(1000).selectExpr("CASE WHEN id < 900 THEN 1 ELSE id END AS v")
    assert K.sample_n(same, 50).count() == 50


def test_pages(spark, folder):
    orders = read_parquet(spark, f"{folder}/orders.parquet")
    assert [r.o_orderkey for r in K.page(orders, 2, 10).collect()] == list(range(10, 20))
    assert K.page(orders, 0, 1000).count() == 100
    assert K.page(orders, 10**6).count() == 0
    assert K.page_info(orders.limit(0), 1).first().total_pages == 1


@FEW
@given(st.integers(8, 400), st.integers(1, 4))
def test_split_is_exact(spark, n, classes):
    df = spark.range(n).selectExpr(f"id % {classes} AS c", f"id AS {ROW}")
    for stratify in (None, "c"):
        train, test = M.split(df, stratify=stratify)
        tested = [r[ROW] for r in test.collect()]
        assert len(tested) == -(-n // 5) and sorted(tested + [r[ROW] for r in train.collect()]) == list(range(n))
    counts = [r["count"] for r in test.groupBy("c").count().collect()]
    assert max(counts) - min(counts) <= 1 or n < 5 * classes


def test_rows_are_hashed_once_for_a_split(spark):
    df = spark.range(1000).selectExpr("id % 3 AS c", f"id AS {ROW}")
    parts = M.split(df, stratify="c")
    assert sum(p.count() for p in parts) == 1000
    assert not any("md5" in p._jdf.queryExecution().executedPlan().toString() for p in parts)


def test_model_guards(spark):
    few = spark.range(7).selectExpr("id AS a", "id * 2 AS b", f"id AS {ROW}")
    assert M.model(few, "a").mode == "insufficient_data"
    many = spark.range(100).selectExpr("CAST(id AS STRING) AS a", "id AS b", "'x' AS c", f"id AS {ROW}")
    assert M.model(many, "gone").mode == "target_missing"
    assert M.model(many.select("a", ROW), "a").mode == "missing_features"
    assert M.model(many, "a").status == "skipped" and M.model(many, "c").status == "skipped"
    classes = spark.range(1000).selectExpr("concat('k', id % 41) AS a", "id AS b", f"id AS {ROW}")
    assert M.model(classes, "a").status == "skipped"
    assert M.cluster(few.limit(4)).status == "skipped"


def test_models_learn(spark):
    df = spark.range(600).selectExpr(
        "id % 20 AS x", "concat('g', id % 3) AS g", "concat('w', id) AS wide", "CAST((id % 20) * 5 + id % 3 AS DOUBLE) AS y",
        "CASE WHEN id % 20 < 10 THEN 'low' ELSE 'high' END AS side", f"id AS {ROW}",
    ).repartition(3)
    found = M.regress(df.drop("side", "wide"), "y", trees=8, depth=6)
    assert found.metrics["r2"] > 0.9 and found.importance.first().feature == "x"
    predicted = found.predictions.toPandas()
    assert found.metrics["mae"] == pytest.approx((predicted.label - predicted.prediction).abs().mean(), abs=1e-4)
    named = M.classify(df.drop("y"), "side", trees=8, depth=6)
    assert named.metrics["accuracy"] > 0.9 and named.classes.count() == 2
    assert named.predictions.where("label = prediction").count() / 120 == pytest.approx(named.metrics["accuracy"], abs=1e-4)


def test_clusters_and_silhouettes(spark):
    df = spark.range(90).selectExpr("(id % 3) * 100 + (id % 5) * 0.1 AS x", f"id AS {ROW}")
    found = M.cluster(df)
    assert found.metrics["clusters"] == 3 and found.metrics["silhouette_score"] > 0.95
    assert sorted(r["count"] for r in found.clusters.collect()) == [30, 30, 30]


def test_every_level_has_its_slot(spark):
    df = spark.range(260).selectExpr("concat('k', id % 130) AS t", "concat('h', id) AS h", "id AS n", f"id AS {ROW}")
    features = M.feature_pipeline(df.drop("h"))
    seen = {r.t: tuple(r.features.indices[r.features.indices > 0]) for r in features.transform(df).collect()}
    assert len(set(seen.values())) == 130 and features.size == 131
    assert all(features.names(slots)[slots[0]] == f"t_{t}" for t, slots in seen.items())
    unknown = features.transform(spark.range(1).selectExpr("'new' AS t", "id AS n")).first().features
    assert unknown.size == 131 and set(unknown.indices) <= {0}
    assert M.feature_pipeline(df, hashed=["h"]).size == 1 + 130 + M.HASHED_FEATURES


def test_wide_correlation_equals_the_narrow_one(spark, folder, monkeypatch):
    """Blocks of columns give what one aggregate per pair gives, gaps and constant columns included."""
    from gridlore.operators import correlation as R, gram

    events = spark.read.parquet(f"{folder}/events.parquet").selectExpr(
        "value", "CAST(user_id AS DOUBLE) AS user_id", "CASE WHEN event_id % 3 = 0 THEN value * user_id END AS gappy", "5.0D AS flat",
        "CASE WHEN event_id % 4 = 1 THEN 2.0D WHEN event_id % 4 = 2 THEN value END AS mixed", "1e9 + event_id AS large", "CASE WHEN event_id = 3 THEN 1.0D END AS once",
    )
    narrow = {tuple(r)[:2]: r.correlation for r in R.correlation_pairs(events).collect()}
    monkeypatch.setattr(R, "WIDE_PAIRS", 1)
    monkeypatch.setattr(gram, "BLOCK_COLUMNS", 3)
    monkeypatch.setattr(gram, "BLOCKS_PER_SCAN", 2)
    wide = {tuple(r)[:2]: r.correlation for r in R.correlation_pairs(events).collect()}
    assert wide == narrow and sum(v is None for v in wide.values()) >= 6


def test_wide_correlation_has_a_plan_of_fixed_size(spark):
    from gridlore.operators import gram

    def size(width):
        df = spark.range(20).selectExpr(*[f"id % {k + 2} AS c{k}" for k in range(width)])
        return gram.products(df, df.columns, [0.0] * width)._jdf.queryExecution().executedPlan().toString().count("MapInArrow")

    assert size(20) == size(300) > 0


def test_kmeans_finds_separate_groups_in_any_order(spark):
    from gridlore.operators import kmeans
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(4)
    middles = np.array([[0, 0, 0], [9, 0, 0], [0, 9, 0], [0, 0, 9]], dtype=float)
    points = np.concatenate([m + rng.normal(0, 0.3, (40, 3)) for m in middles])
    rows = [(Vectors.dense(p.tolist()) if i % 2 else Vectors.sparse(3, list(enumerate(p.tolist()))), i) for i, p in enumerate(points)]
    table = spark.createDataFrame(rows, ["features", "key"])
    fits = kmeans.fit_all(table.repartition(3), 3, [2, 4], 3, 42)
    found, cost = fits[4]
    assert sorted(np.round(found).tolist()) == sorted(middles.tolist()) and cost < 160 and fits[2][1] > cost
    near = {r["key"]: r["nearest"][0] for r in kmeans.predict_all(table, [found], 3).collect()}
    assert all(len({near[i] for i in range(g * 40, g * 40 + 40)}) == 1 for g in range(4)) and len(set(near.values())) == 4


def test_cells_with_and_without_gaps():
    """Sums of one column come from that column alone, but where the other one has gaps."""
    import numpy as np
    import pyarrow as pa
    from gridlore.operators import gram

    raw = np.random.default_rng(2).normal(size=(4, 50))
    batch = pa.record_batch([pa.array(v) for v in raw], names=[f"v{k}" for k in range(4)])
    cells = list(gram._summed([(range(4), range(4))], [0, 1, 2, 3], [0.0] * 4)(iter([batch])))
    full = [p for p in cells[0].to_pylist() if (p["i"], p["j"]) == (1, 3)][0]
    assert full["n"] == 50 and full["p"] == pytest.approx(raw[1] @ raw[3]) and full["sl"] == pytest.approx(raw[1].sum()) and full["qr"] == pytest.approx((raw[3] ** 2).sum())
    gap = pa.record_batch([pa.array([1.0, None, 3.0]), pa.array([2.0, 5.0, None])], names=["v0", "v1"])
    (row,) = [r for b in gram._summed([(range(2), range(2))], [0, 1], [0.0, 0.0])(iter([gap])) for r in b.to_pylist()]
    assert [row[c] for c in gram.CELLS] == [1, 2, 1, 2, 1, 4]


def test_merged_sketches_do_not_multiply_rows(spark, folder, monkeypatch):
    from gridlore.plans import queries as P

    seen = []
    monkeypatch.setattr(P.F, "count_distinct", lambda *a: seen.append(a))
    assert P.merged_sketches(spark, folder).where("distinct_close AND ranks_close").count() == len(P.NUMBERS) and not seen


def test_trends_over_time_write_no_sorted_rows(spark, monkeypatch):
    """Slopes over a sort come from sums of its partitions, gaps and rows without a time included."""
    n = 700
    rng = np.random.default_rng(4)
    day, gap = rng.integers(0, 40, n), rng.random(n) < 0.3
    order = np.argsort(np.where(day < 3, 99, day), kind="stable")
    at = np.empty(n)
    at[order] = np.arange(n)
    x, y = rng.normal(size=n), 3.0 * day + rng.normal(size=n)
    rows = [(i, None if d < 3 else dt.datetime(2020, 1, 1) + dt.timedelta(days=int(d)), float(a), None if g else float(b)) for i, (d, g, a, b) in enumerate(zip(day, gap, x, y))]
    frame = small_frame(spark, rows, f"{ROW} long, t timestamp, x double, y double").repartition(5)
    written = []
    for module in (ordering, T):
        plain = getattr(module, "materialize", ordering.materialize)
        monkeypatch.setattr(module, "materialize", lambda *a, _plain=plain: written.append(_plain(*a)) or written[-1], raising=False)
    found = {r["column"]: r for r in T.trends(frame).collect()}
    assert found["x"].slope == pytest.approx(np.polyfit(at, x, 1)[0], abs=1e-4) and found["x"].basis == "t"
    assert found["y"].slope == pytest.approx(np.polyfit(at[~gap], y[~gap], 1)[0], abs=1e-4)
    assert written and max(w.count() for w in written) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("mode", ["clean", "raw"])
def test_sections_share_counts(spark, monkeypatch, mode):
    frame = small_frame(spark, [(i, float(i % 7), "ab"[i % 2]) for i in range(60)], f"{ROW} long, n double, k string")
    made = report.analyze(frame, "t", mode=mode, modeling=False)
    calls = []
    for name in ("missing_counts", "approximate_distinct", "value_groups"):
        plain = getattr(D, name)
        monkeypatch.setattr(D, name, lambda *a, _name=name, _plain=plain: calls.append((_name, len(a))) or _plain(*a))
    shown = {r["column"]: r for r in made.columns().collect()}
    told = {r["column"]: r for r in made.summary_statistics().collect()}
    assert calls.count(("missing_counts", 2)) == 1 and shown["n"].unique_values == told["n"].unique_values == 7
    assert [c for c, _ in calls].count("approximate_distinct" if mode == "raw" else "value_groups") == 1
    kept = 14 if mode == "clean" else 60  # cleaning drops copies
    assert told["k"].top_value == "a" and told["k"].top_frequency == kept // 2 and told["k"].non_null_count == kept
