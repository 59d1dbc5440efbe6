"""Every registered query against its SQL twin on the small tables."""

from __future__ import annotations

import pytest
from compare import connect, differences

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SLOW = {"n1_analyze_clean", "m4_regression", "m5_classification", "m7_clusters", "m9_feature_importance"}


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, folder, con):
    assert differences(QUERIES[name](spark, folder), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(name, spark, folder):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 11
