"""Row order, positions, fills and order statistics against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gridlore.functions import exprs as X
from gridlore.operators import ordering as H
from gridlore.operators import quantiles as Q
from gridlore.operators import sampling as K
from gridlore.operators.ordering import ROW
from gridlore.session import scratch_path, small_frame
from gridlore.sources.readers import read_parquet

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_rows_of_many_files_are_dense(spark, folder):
    path = scratch_path(spark, "many")
    spark.read.parquet(f"{folder}/orders.parquet").repartitionByRange(7, "o_orderkey").sortWithinPartitions(
        "o_orderkey"
    ).write.parquet(path)
    rows = read_parquet(spark, path)
    assert rows.where(F.col(ROW) != F.col("o_orderkey")).count() == 0
    assert rows.count() == spark.read.parquet(f"{folder}/orders.parquet").count()


def test_row_from_sort_keys_and_as_read(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet").repartition(13)
    by_key = H.with_row(orders, ["o_orderkey"])
    assert by_key.where(F.col(ROW) != F.col("o_orderkey")).count() == 0
    as_read = H.with_row(orders)
    assert sorted(r[ROW] for r in as_read.select(ROW).collect()) == list(range(orders.count()))


def test_pages_of_sparse_rows(spark, folder):
    orders = read_parquet(spark, f"{folder}/orders.parquet").where("o_orderkey % 3 = 1")
    assert [r.o_orderkey for r in K.page(orders, 3, 10).collect()] == [3 * i + 1 for i in range(20, 30)]


def test_offsets_never_move_the_table(spark, folder):
    path = scratch_path(spark, "files")
    spark.read.parquet(f"{folder}/orders.parquet").repartition(5).write.parquet(path)
    plan = read_parquet(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_positions_do_not_depend_on_partitions(spark, folder):
    events = read_parquet(spark, f"{folder}/events.parquet").where("event_id % 3 <> 1")
    one, two = (H.positions(e, "p", block_rows=100).orderBy("event_id") for e in (events, events.repartition(13)))
    expected = list(range(events.count()))
    assert [r.p for r in one.collect()] == expected == [r.p for r in two.collect()]


def test_sorted_positions_split_a_hot_key(spark):
    rows = spark.range(5000).selectExpr("id AS _row", "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k").repartition(9)
    placed = H.sorted_positions(rows, ["k", ROW], "p").orderBy("k", ROW).collect()
    assert [r.p for r in placed] == list(range(5000))


@FEW
@given(st.integers(0, 1500), st.integers(1, 200))
def test_ntile(spark, n, k):
    closed = spark.range(n).selectExpr("id", f"{X.ntile_of('id', f'{n}L', k)} AS b")
    expected, start = [], 0
    for bucket in range(k):
        size = n // k + (bucket < n % k)
        expected += [bucket + 1] * size
        start += size
    assert [r.b for r in closed.orderBy("id").collect()] == expected


@pytest.mark.parametrize("n", [1, 179, 180, 181, 360])
def test_ntile_edges(spark, n):
    test_ntile.hypothesis.inner_test(spark, n, 180)


@FEW
@given(st.lists(st.one_of(st.none(), st.integers(0, 9)), min_size=1, max_size=60), st.integers(1, 20))
def test_fill_both_ways(spark, values, block):
    df = small_frame(spark, [(i, v) for i, v in enumerate(values)], f"{ROW} long, v long")
    filled = [r.v for r in H.fill_both_ways(df, ["v"], block_rows=block).orderBy(ROW).collect()]
    expected, last = [], next((v for v in values if v is not None), None)
    for v in values:
        last = v if v is not None else last
        expected.append(last)
    assert filled == expected


@FEW
@given(
    st.lists(st.floats(-1e12, 1e12) | st.sampled_from([0.0, 1.0, 1e300, -1e300, 5e-324]), min_size=1, max_size=200),
    st.lists(st.floats(0, 1), min_size=1, max_size=5),
)
def test_quantiles_by_narrowing(spark, values, probabilities):
    df = small_frame(spark, [(v,) for v in values], "v double")
    known = Q.extent(df, ["v"])
    ranks = sorted({int((len(values) - 1) * p) for p in probabilities})
    found = Q.pick_ranks(df, ["v"], {0: ranks}, {0: known[0][1:]}, cells=8, fine_rows=4)
    assert [found[0, r] for r in ranks] == [sorted(values)[r] for r in ranks]


def test_quantiles_agree_on_both_paths(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    columns, probs = ["l_extendedprice", "l_linenumber", "l_tax"], [0.0, 0.33, 0.5, 0.999, 1.0]
    small, large = (Q.exact_quantiles(lines, columns, probs, small_rows=r) for r in (10**9, 0))
    for c in columns:
        assert np.allclose(small[c], large[c], rtol=1e-12)


def test_quantiles_with_gaps_and_infinity(spark):
    df = small_frame(spark, [(v,) for v in (None, float("nan"), float("inf"), 1.0, 2.0, 3.0)], "v double")
    assert Q.exact_quantiles(df, ["v"], [0.0, 0.5, 1.0], small_rows=0)["v"] == [1.0, 2.5, float("inf")]
    empty = small_frame(spark, [(None,)], "v double")
    assert Q.exact_quantiles(empty, ["v"], [0.5], small_rows=0)["v"] == [None]
