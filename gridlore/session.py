"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

PARTS_PER_JOB = 32


def configure(spark: SparkSession) -> SparkSession:
    """Pin the one setting results depend on: timestamps are read and shown in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder intermediate tables go to.

    A cluster names it in ``spark.checkpoint.dir``. A session whose tasks run in this process may
    leave that unset and gets a temporary folder until it exits; a cluster may not, since a
    machine-local folder would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("Set spark.checkpoint.dir to a folder every executor can reach.")
    folder = tempfile.mkdtemp(prefix="gridlore-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage, so a lost executor never replays the shuffle behind it, and
    later jobs read only the columns they use.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more, as soon as it is replaced by a later one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def observed(df: DataFrame, label: str, facts: dict[str, Column | str]) -> tuple[DataFrame, dict[str, object]]:
    """``materialize`` that also returns aggregates of the rows written, taken by the writing job itself."""
    noted = Observation()
    exprs = [(F.expr(v) if isinstance(v, str) else v).alias(k) for k, v in facts.items()]
    stored = materialize(df.observe(noted, *exprs), label)
    return stored, dict(noted.get)


def small_frame(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A DataFrame over a bounded driver-side list: one row per column, bin or metric.

    Handed over as Arrow it becomes a local table scan, without a Python RDD behind it.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    columns = list(zip(*rows)) if rows else [()] * len(schema.fields)
    arrow = to_arrow_schema(schema)
    arrays = [pa.array(list(values), type=field.type) for values, field in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)


def run_sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """Run SQL in which ``{name}`` stands for a DataFrame; every other brace is literal."""
    text = text.replace("{", "{{").replace("}", "}}")
    for name in frames:
        text = text.replace("{{" + name + "}}", "{" + name + "}")
    return spark.sql(text, **frames)


def run_parts(spark: SparkSession, parts: list[str], **frames: DataFrame) -> DataFrame:
    """The union of many small aggregate queries over the same tables.

    Up to ``PARTS_PER_JOB`` stay one lazy plan. More, as very wide tables need, are run in
    batches, so that no plan grows with the number of columns; the parts' results are small.
    """
    if len(parts) <= PARTS_PER_JOB:
        return run_sql(spark, " UNION ALL ".join(parts), **frames)
    rows, schema = [], None
    for i in range(0, len(parts), PARTS_PER_JOB):
        batch = run_sql(spark, " UNION ALL ".join(parts[i : i + PARTS_PER_JOB]), **frames)
        schema = schema or batch.schema
        rows += [tuple(r) for r in batch.collect()]
    return small_frame(spark, rows, schema)
