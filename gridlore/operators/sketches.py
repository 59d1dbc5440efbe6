"""Profiles from sketches that merge: one small row per file and column, kept, so that a grown table reads its new files alone.

Counts, minima and maxima are exact. Distinct counts come from HyperLogLog sketches (standard error about 0.8 %),
quantiles of numbers from KLL sketches (rank error about 0.5 % of the rows). A sketch is some kilobytes, whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridlore.functions import exprs as X
from gridlore.operators.ordering import data_columns

DISTINCT_BITS = 14
RANK_SIZE = 800
FACTS = ["row_count", "present_count", "low", "high", "distinct_sketch", "value_sketch"]
FILE = ["file", "size", "modified"]


def _facts(df: DataFrame, name: str) -> Column:
    c, dtype = X.quote(name), X.types_of(df)[name]
    number = F.expr(X.double(c, dtype)) if X.kind_of(dtype) == X.NUMERIC else F.lit(None).cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    return F.struct(
        F.lit(name).alias("column"),
        F.count(F.lit(1)).alias("row_count"),
        F.count(F.expr(c)).alias("present_count"),
        F.min(finite).alias("low"),
        F.max(finite).alias("high"),
        F.hll_sketch_agg(F.expr(X.as_text(c, dtype)), DISTINCT_BITS).alias("distinct_sketch"),
        F.kll_sketch_agg_double(finite, F.lit(RANK_SIZE)).alias("value_sketch"),
    )


def sketch(df: DataFrame, columns: list[str] | None = None, by: dict[str, Column] | None = None) -> DataFrame:
    """One row per column: column, row_count, present_count, low, high, distinct_sketch, value_sketch.

    ``by`` names groups that get rows of their own, such as files. Low, high and value_sketch cover the finite
    values of numeric columns. An empty table without groups gives rows of zero counts.
    """
    columns = data_columns(df) if columns is None else columns
    keys = [c.alias(k) for k, c in (by or {}).items()]
    each = [_facts(df, c).alias(f"_{i}") for i, c in enumerate(columns)]
    wide = df.groupBy(*keys).agg(*each).withColumn("_all", F.explode(F.array(*[f"_{i}" for i in range(len(columns))])))
    return wide.select(*(by or {}), "_all.*")


def merge(sketches: DataFrame) -> DataFrame:
    """The sketches of each column as one, combined in the tasks before they are shuffled."""
    return sketches.groupBy("column").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("present_count").alias("present_count"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("value_sketch").alias("value_sketch"),
    )


def described(sketches: DataFrame, probabilities: list[float]) -> DataFrame:
    """Merged sketches as (column, row_count, missing_count, unique_values, min, max, quantiles); quantiles are
    null for columns without finite numbers."""
    wanted = [F.kll_sketch_get_quantile_double("value_sketch", F.lit(float(p))) for p in probabilities]
    return sketches.select(
        "column",
        "row_count",
        (F.col("row_count") - F.col("present_count")).alias("missing_count"),
        F.hll_sketch_estimate("distinct_sketch").alias("unique_values"),
        F.col("low").alias("min"),
        F.col("high").alias("max"),
        F.when(F.col("low").isNotNull(), F.array(*wanted)).alias("quantiles"),
    )


def of_files(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Merged sketches of the Parquet table at ``path``; ``folder`` keeps those of each file.

    Files are known by name, size and time of change, so only new or changed ones are read. What a file held
    before it changed or went is left out. The table's columns must stay the same.
    """
    table = spark.read.parquet(path)
    known_by = {"file": F.col("_metadata.file_path"), "size": F.col("_metadata.file_size"), "modified": F.col("_metadata.file_modification_time")}
    files = table.select(*[c.alias(k) for k, c in known_by.items()]).distinct()  # reads no column
    kept = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if kept.getFileSystem(spark._jsc.hadoopConfiguration()).exists(kept):
        new = [r.file for r in files.join(spark.read.parquet(folder).select(*FILE), FILE, "left_anti").select("file").collect()]
        fresh = table.where(F.col("_metadata.file_path").isin(new)) if new else None
    else:
        fresh = table
    if fresh is not None:
        sketch(fresh, data_columns(table), known_by).write.mode("append").parquet(folder)
    stored = spark.read.parquet(folder).join(files, FILE, "left_semi")
    return merge(stored.dropDuplicates(["file", "column"]))  # two writers may have read the same file
