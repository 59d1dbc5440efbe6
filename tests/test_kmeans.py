"""K-means on vectors of few entries against dense arithmetic."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from gridlore.operators import kmeans


@pytest.mark.parametrize("size", [7, 5_000])
def test_wide_rows_meet_centres_by_their_entries(spark, size):
    """Sparse, dense and empty vectors; slices take as much memory as their entries need."""
    rng = np.random.default_rng(size)
    rows = np.zeros((400, size))
    for r in range(1, 400):
        rows[r, rng.choice(size, 4, replace=False)] = rng.normal(size=4)
    vectors = [Vectors.dense(x) if i % 50 == 7 else Vectors.sparse(size, {int(j): x[j] for j in np.flatnonzero(x)}) for i, x in enumerate(rows)]
    table = spark.createDataFrame([(v, i) for i, v in enumerate(vectors)], ["features", "key"]).repartition(3)
    sets = [rows[:3], rows[5:9] / 2]
    counts, sums, costs = kmeans._assigned(table, sets, size)
    near = {r["key"]: r["nearest"] for r in kmeans.predict_all(table, sets, size).collect()}
    for k, centres in enumerate(sets):
        apart = ((rows[:, None] - centres) ** 2).sum(axis=2)
        own = apart.argmin(axis=1)
        assert [near[i][k] for i in range(400)] == own.tolist()
        assert counts[k].tolist() == np.bincount(own, minlength=len(centres)).tolist()
        assert np.allclose(sums[k], [rows[own == c].sum(axis=0) for c in range(len(centres))])
        assert costs[k] == pytest.approx(apart.min(axis=1).sum())
    found = {(r["key"], r["at"]): r["v"] for r in kmeans.entries(table, size, ["key"]).collect()}
    wanted = {(i, int(j)): rows[i, j] for i, j in zip(*np.nonzero(rows))} | {(i, -1): 1.0 for i in range(400)}
    assert found == wanted
    batch = table.limit(100).toArrow().to_batches()[0]
    assert len(list(kmeans._slices(batch, 5_000_000, 10))) == 1


def _rows_of_wide_columns(spark, seed):
    """Vectors of two numbers and one slot of each of three columns: levels of one row, of a few, of many."""
    rng, n = np.random.default_rng(seed), 240
    group = rng.integers(0, 4, n)
    numbers = np.stack([group % 2 * 3, group // 2 * 2], axis=1) + rng.normal(0, 0.6, (n, 2))
    names, towns = rng.permutation(n), np.where(rng.random(n) < 0.4, 0, rng.integers(1, 60, n))
    ends = np.cumsum([2, n, 60, 70])
    streets = np.where(rng.random(n) < 0.1, rng.integers(20, 70, n), (group * 5 + rng.integers(0, 6, n)) % 70)
    places = np.stack([ends[0] + names, ends[1] + towns, ends[2] + streets], axis=1)
    vectors = [Vectors.sparse(int(ends[-1]), [0, 1, *map(int, p)], [*map(float, x), 1.0, 1.0, 1.0]) for x, p in zip(numbers, places)]
    table = spark.createDataFrame([(v, i * 7 + 3) for i, v in enumerate(vectors)], ["features", "key"]).repartition(3)
    return table, int(ends[-1]), list(zip(ends[:-1].tolist(), ends[1:].tolist())), np.array([v.toArray() for v in vectors])


@pytest.mark.parametrize("seed", [1, 2])
def test_centres_of_wide_columns_stay_with_the_rows(spark, monkeypatch, seed):
    """Sizes, costs, centres and silhouettes are those of centres that the driver holds as a whole."""
    from gridlore.operators import modeling as M

    table, size, columns, rows = _rows_of_wide_columns(spark, seed)
    whole = kmeans.fit_all(table, size, [2, 3, 5], 4, 42)
    assert len(whole.common) == size
    monkeypatch.setattr(kmeans, "COMMON", 16)
    split = kmeans.fit_all(table, size, [2, 3, 5], 4, 42, columns)
    assert split.shared == 2 and len(split.common) < 80
    scores, wanted = split.silhouettes([2, 3, 5]), whole.silhouettes([2, 3, 5])
    for k in (2, 3, 5):
        assert split[k][1] == pytest.approx(whole[k][1]) and scores[k] == pytest.approx(wanted[k])
        near = {r["key"]: r["prediction"] for r in split.assigned(k).collect()}
        assert near == {r["key"]: r["prediction"] for r in whole.assigned(k).collect()}
        assert split.sizes(k).tolist() == np.bincount(list(near.values()), minlength=k).tolist()
        centres = np.zeros((k, size))
        for r in split.centres(k).collect():
            centres[r["cluster"], r["at"]] += r["value"]
        assert np.allclose(centres, whole[k][0])
        apart = ((rows[:, None] - centres) ** 2).sum(axis=2)
        assert apart.argmin(axis=1).tolist() == [near[i * 7 + 3] for i in range(len(rows))]
        assert split[k][1] == pytest.approx(apart.min(axis=1).sum())
        assert scores[k] == pytest.approx(M.silhouette(split.assigned(k).withColumn("prediction", F.col("prediction").cast("double"))))


def test_a_centre_without_rows_stays_where_it_was(spark, monkeypatch):
    """Steps of a fit with a centre that loses its rows, and with one that never has any, against dense arithmetic."""
    table, size, columns, rows = _rows_of_wide_columns(spark, 3)
    monkeypatch.setattr(kmeans, "COMMON", 16)
    far = rows[9] + 0.0
    far[:2] = 50
    # the second centre starts as a point that a single row is nearest to, the last as one that no row is
    starts = np.stack([rows[:40].mean(axis=0), rows[5] * 1.5, rows[60:90].mean(axis=0), far])
    monkeypatch.setattr(kmeans, "_reduced", lambda points, *_: starts[:, kept[0]])
    kept = []
    embedded = kmeans._embedded

    def noted(sets, slots, more):
        more = [[*points, *[(np.flatnonzero(s), s[s != 0]) for s in starts]] for points in more]
        out = embedded(sets, slots, more)
        kept[:] = [out[1]]
        return out

    monkeypatch.setattr(kmeans, "_embedded", noted)
    split = kmeans.fit_all(table, size, [4], 1, 42, columns)
    centres = starts
    for step in range(kmeans.STEPS + 1):
        near = ((rows[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([rows[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(4)])
        if step == kmeans.STEPS or np.sqrt(((moved - centres) ** 2).sum(axis=1)).max() <= kmeans.TOLERANCE:
            break
        centres = moved
    assert split.shared == 2 and split.sizes(4).tolist() == np.bincount(near, minlength=4).tolist() and split.sizes(4)[3] == 0
    found = np.zeros((4, size))
    for r in split.centres(4).collect():
        found[r["cluster"], r["at"]] += r["value"]
    assert np.allclose(found, centres)


def test_features_do_not_name_their_slots(spark):
    """The schema of a vector doesn't grow with the levels, and both forms of a vector are Spark's own."""
    from gridlore.operators import modeling as M
    from gridlore.operators.ordering import ROW

    df = spark.range(300).selectExpr("concat('n', id) AS name", "id % 7 AS x", f"id AS {ROW}")
    features = M.feature_pipeline(df)
    made = features.transform(df)
    assert made.schema["features"].metadata == {}
    rows = {r["name"]: r["features"] for r in made.collect()}
    levels = {r["_c"]: int(r["_i"]) for r in features.levels[0].collect()}
    x = (np.arange(300) % 7 - features.scale["x"][0]) / features.scale["x"][1]
    assert all(rows[f"n{i}"] == Vectors.sparse(301, {0: x[i], 1 + levels[f"n{i}"]: 1.0}) for i in range(300))
    few = df.where(f"{ROW} < 2")
    dense = M.feature_pipeline(few).transform(few).first()["features"]
    assert type(dense).__name__ == "DenseVector" and len(dense) == 3


def test_equal_rows_do_not_separate(spark):
    """One cluster of all rows, whether vectors are all zero or not."""
    from gridlore.operators import modeling as M
    from gridlore.operators.ordering import ROW

    for columns in (["5 AS x"], ["5 AS x", "'a' AS t"]):
        found = M.cluster(spark.range(40).selectExpr(*columns, f"id AS {ROW}"))
        assert found.status == "skipped" and "separate" in found.reason
