"""Sketches of parts against exact figures of the whole."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from gridlore.operators import sketches as H
from gridlore.session import small_frame


def found(table, probabilities=(0.25, 0.5)):
    return {r["column"]: r for r in H.described(table, list(probabilities)).collect()}


def test_edges(spark):
    rows = [(1.0, "a", None), (math.nan, "a", None), (math.inf, None, None), (3.0, "b", None)]
    df = small_frame(spark, rows, "x double, `a b` string, gap long")
    got = found(H.merge(H.sketch(df)))
    assert (got["x"].min, got["x"].max, got["x"].quantiles, got["x"].missing_count) == (1.0, 3.0, [1.0, 1.0], 0)
    assert (got["a b"].unique_values, got["a b"].missing_count, got["a b"].quantiles) == (2, 1, None)
    assert (got["gap"].unique_values, got["gap"].missing_count, got["gap"].row_count, got["gap"].quantiles) == (0, 4, 4, None)
    empty = found(H.merge(H.sketch(df.limit(0))))
    assert empty["x"].row_count == 0 and empty["x"].quantiles is None


def test_grown_table_reads_new_files_alone(spark, tmp_path):
    data, folder = str(tmp_path / "data"), str(tmp_path / "sketches")
    spark.range(0, 6000, 1, 3).selectExpr("id AS v", "id % 100 AS g").write.parquet(data)
    first = found(H.of_files(spark, data, folder))
    assert first["v"].row_count == 6000 and spark.read.parquet(folder).count() == 6
    spark.range(6000, 10000, 1, 2).selectExpr("id AS v", "id % 100 AS g").write.mode("append").parquet(data)
    grown = found(H.of_files(spark, data, folder))
    stored = spark.read.parquet(folder)
    assert stored.count() == 10 and stored.agg(F.sum("row_count")).first()[0] == 20000  # each file once
    assert H.of_files(spark, data, folder).count() == 2 and spark.read.parquet(folder).count() == 10
    assert (grown["v"].row_count, grown["v"].min, grown["v"].max, grown["g"].unique_values) == (10000, 0.0, 9999.0, 100)
    assert grown["v"].unique_values == pytest.approx(10000, rel=0.03)
    assert grown["v"].quantiles == pytest.approx([2500, 5000], abs=150)
    spark.read.parquet(data).where("v < 2000").write.parquet(str(tmp_path / "other"))
    assert found(H.of_files(spark, str(tmp_path / "other"), folder))["v"].row_count == 2000
