"""Node tables of forests against a walk of their nodes, row by row, and against the fitted models."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from gridlore.operators import forest as W, forest_fit
from gridlore.operators.forest_fit import fit
from gridlore.session import small_frame


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x, y, kind = rng.normal(size=300), rng.integers(0, 5, 300), rng.integers(0, 4, 300)
    label = np.where(kind % 2, 2.0, 0.0) + (x > 0.3) + (y == 3)
    data = [(f"k{i}", float(a), float(b), float(c), float(d)) for i, (a, b, c, d) in enumerate(zip(x, y, kind, label))]
    frame = small_frame(spark, data, "key string, x double, y double, kind double, label double")
    frame = frame.withMetadata("kind", {"ml_attr": {"type": "nominal", "num_vals": 4}})
    return VectorAssembler(inputCols=["x", "y", "kind"], outputCol="features").transform(frame)


def leaf(nodes, tree, values):
    node = nodes[tree, 0]
    while node.slot is not None:
        v = values[node.slot]
        left = v <= node.cut if node.cut is not None else v in node.left_values
        node = nodes[tree, node.left if left else node.right]
    return node


def walked(table, rows):
    nodes = {(n.tree, n.node): n for n in table.collect()}
    trees = {t for t, _ in nodes}
    vectors = rows.select("key", vector_to_array("features").alias("v")).collect()
    return {r.key: [leaf(nodes, t, r.v) for t in sorted(trees)] for r in vectors}


def test_regression(spark, rows):
    model = RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=7, maxDepth=6, seed=3).fit(rows)
    table = W.node_table(model)
    assert table.where("left_values IS NOT NULL").count() and table.where("cut IS NOT NULL").count()
    assert table.count() == model.totalNumNodes and table.agg(F.max("level")).first()[0] == max(t.depth for t in model.trees)
    found = {r.key: r.prediction for r in W.score(rows, table, "key").collect()}
    assert found == pytest.approx({k: np.mean([n.prediction for n in leaves]) for k, leaves in walked(table, rows).items()})
    assert found == pytest.approx({r.key: r.prediction for r in model.transform(rows).collect()})
    weights = {r.slot: r.importance for r in W.importance(table).collect()}
    assert [weights.get(i, 0.0) for i in range(3)] == pytest.approx(list(model.featureImportances.toArray()))


def test_classification_with_weights(spark, rows):
    weighted = rows.withColumn("w", F.col("label") + 0.5)
    model = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="w", numTrees=5, maxDepth=5, seed=3).fit(weighted)
    table = W.node_table(model)
    found = {r.key: r for r in W.score(rows, table, "key", model.numClasses).collect()}
    for key, leaves in walked(table, rows).items():
        votes = sum(np.array(n.stats) / sum(n.stats) for n in leaves)
        assert found[key].votes == pytest.approx(list(votes)) and found[key].votes[int(found[key].prediction)] == max(found[key].votes)
    for r in model.transform(rows).collect():
        assert found[r.key].votes == pytest.approx(list(r.rawPrediction))
    weights = {r.slot: r.importance for r in W.importance(table).collect()}
    assert [weights.get(i, 0.0) for i in range(3)] == pytest.approx(list(model.featureImportances.toArray()))


def test_single_leaves_and_no_rows(spark, rows):
    flat = rows.withColumn("label", F.lit(4.0))
    table = W.node_table(RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=3, seed=3).fit(flat))
    assert table.count() == 3 and W.importance(table).count() == 0
    assert {r.prediction for r in W.score(flat, table, "key").collect()} == {4.0}
    assert W.score(rows.limit(0), table, "key").count() == 0
    with pytest.raises(ValueError):
        W.score(rows, table.limit(0), "key")


def test_trees_stay_with_their_rows(spark, rows):
    """Scoring shuffles one row of sums per row, however many trees there are."""
    table = W.node_table(RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=7, maxDepth=4, seed=3).fit(rows))
    plan = W.score(rows, table, "key")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "SortMergeJoin" not in physical and physical.count("Exchange hashpartitioning(_key") == 1


def test_many_nodes_are_joined_by_shuffle(spark, rows, monkeypatch):
    model = RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=3, maxDepth=3, seed=3).fit(rows)
    table = W.node_table(model)
    monkeypatch.setattr(W, "BROADCAST_NODES", 0)
    found = {r.key: r.prediction for r in W.score(rows, table, "key").collect()}
    assert found == pytest.approx({r.key: r.prediction for r in model.transform(rows).collect()})


def test_small_tables_are_walked_without_joins(spark, rows):
    """Rows aren't multiplied by trees, and unknown categories and numbers beyond the cuts go where the model sends them."""
    model = RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=5, maxDepth=6, seed=3).fit(rows)
    table = W.node_table(model)
    plan = W.score(rows, table, "key")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "Join" not in physical and "Generate" not in physical
    odd = small_frame(spark, [("a", 9e9, -3.0, 0.0), ("b", -9e9, 2.5, 3.0), ("c", 0.3, float("inf"), 1.0)], "key string, x double, y double, kind double")
    odd = VectorAssembler(inputCols=["x", "y", "kind"], outputCol="features").transform(odd)
    found = {r.key: r.prediction for r in W.score(odd, table, "key").collect()}
    assert found == pytest.approx({r.key: r.prediction for r in model.transform(odd).collect()})
    twice = {r.key: r.prediction for r in W.score(odd.union(odd), table, "key").collect()}
    assert twice == pytest.approx(found)


def grown(spark, classes=0, **kwargs):
    rng = np.random.default_rng(8)
    x, p = rng.integers(0, 9, 900), rng.integers(0, 4, 900)
    label = (p == 2) * 1.0 + (x > 4) * (1.0 if classes else 10.0)
    data = list(zip(x.astype(float).tolist(), p.tolist(), label.tolist(), [1.0] * 900))
    frame = small_frame(spark, data, "_n0 double, _p0 int, _label double, _weight double")
    return x, p, label, fit(frame, ["_n0"], [("_p0", 4)], 5, 4, 3, classes, **kwargs)


def test_grown_regression_finds_the_steps(spark):
    """One cell per column and row: a number and a level are both asked for, at the place of the step."""
    x, p, label, forest = grown(spark)
    nodes = forest.nodes.to_pandas()
    roots = nodes[nodes.node == 0]
    assert forest.slots == 5 and set(roots.slot) == {0} and set(roots.cut) == {4.0}
    assert set(nodes[nodes.level == 1].slot) == {3} and nodes.level.max() == 2  # pure after two splits
    inner = nodes[nodes.slot.notna()]
    for n in inner.itertuples():
        below = nodes[(nodes.tree == n.tree) & nodes.node.isin([n.left, n.right])]
        assert np.allclose(np.sum(below.stats.to_list(), axis=0), n.stats)
    rows = small_frame(spark, [(i, float(a), *[float(b == k) for k in range(4)]) for i, (a, b) in enumerate(zip(x, p))], "key int, x double, a double, b double, c double, d double")
    rows = VectorAssembler(inputCols=["x", "a", "b", "c", "d"], outputCol="features").transform(rows)
    said = {r.key: r.prediction for r in forest.transform(rows).select("key", "prediction").collect()}
    assert [said[i] for i in range(900)] == pytest.approx(label.tolist())
    by_table = {r.key: r.prediction for r in W.score(rows, W.node_table(forest), "key").collect()}
    assert by_table == pytest.approx(said)


@pytest.mark.parametrize("classes", [0, 3])
def test_passes_and_blocks_change_nothing(spark, monkeypatch, classes):
    *_, whole = grown(spark, classes, subset=3)
    monkeypatch.setattr(forest_fit, "PASS_BYTES", 1)
    monkeypatch.setattr(forest_fit, "BLOCK_BYTES", 1)
    monkeypatch.setattr(forest_fit, "CHUNK_ROWS", 100)
    *_, parts = grown(spark, classes, subset=3)
    a, b = (f.nodes.sort_by([("tree", "ascending"), ("node", "ascending")]).to_pylist() for f in (whole, parts))
    tell = lambda n: (n["tree"], n["node"], n["slot"], n["cut"], n["left"], n["right"], n["weight"])
    assert [tell(n) for n in a] == [tell(n) for n in b] and len(a) > 15


@pytest.mark.parametrize("classes", [0, 2])
def test_rows_of_equal_bins_are_summed_before_the_passes(spark, monkeypatch, classes):
    """What passes read follows the combinations of bins, and merged rows grow what single ones do."""
    x, p, k = (np.arange(40_000) // n % m for n, m in ((1, 4), (4, 3), (12, 2)))
    label = 1.0 * (x + p > 2) if classes else np.where(x > 1, 5.0, 0.0) + p + k / 8
    data = list(zip(x.astype(float).tolist(), p.tolist(), label.tolist(), np.where(label > 0, 1.0, 1.5).tolist()))
    frame = small_frame(spark, data, "_n0 double, _p0 int, _label double, _weight double")
    written, plain = [], forest_fit.materialize
    monkeypatch.setattr(forest_fit, "materialize", lambda *a: written.append(plain(*a)) or written[-1])
    merged = fit(frame, ["_n0"], [("_p0", 3)], 4, 5, 3, classes)
    monkeypatch.setattr(forest_fit, "MERGED_ROWS", 1 << 40)
    single = fit(frame, ["_n0"], [("_p0", 3)], 4, 5, 3, classes)
    assert written[0].count() < 200 and written[1].count() == 40_000
    a, b = (f.nodes.to_pandas().query("node == 0") for f in (merged, single))
    total = sum(w for *_, w in data)
    assert len(a) == 4 and a.weight.tolist() == pytest.approx([total] * 4, rel=0.05) and b.weight.tolist() == pytest.approx([total] * 4, rel=0.05)
    rows = small_frame(spark, [(i, float(i % 4), *[float(i // 4 == q) for q in range(3)]) for i in range(12)], "key int, x double, a double, b double, c double")
    rows = VectorAssembler(inputCols=["x", "a", "b", "c"], outputCol="features").transform(rows)
    one, other = ({r.key: r.prediction for r in f.transform(rows).collect()} for f in (merged, single))
    assert one == pytest.approx(other, abs=0.05)
    whole = {(i, j): np.mean(label[(x == i) & (p == j)]) for i in range(4) for j in range(3)}
    assert one == pytest.approx({i + 4 * j: v for (i, j), v in whole.items()}, abs=0.05)


def test_wide_columns_walk_as_narrow_ones(spark, monkeypatch):
    *_, narrow = grown(spark, subset=3)
    monkeypatch.setattr(forest_fit, "STEP_BINS", 0)
    *_, wide = grown(spark, subset=3)
    assert narrow.nodes.equals(wide.nodes) and narrow.nodes.num_rows > 15


def test_grown_classes_with_weights(spark):
    *_, label, forest = grown(spark, 3)
    nodes = forest.nodes.to_pandas()
    leaves = nodes[nodes.slot.isna()]
    assert forest.numClasses == 3 and all(max(s) == sum(s) for s in leaves.stats)
    assert list(forest.featureImportances.toArray()[[1, 2, 4]]) == [0, 0, 0]
