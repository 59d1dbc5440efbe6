"""Staging to Parquet and content fingerprints."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, types as T

from gridlore.functions import exprs as X
from gridlore.operators.ordering import ROW


def fingerprint(df: DataFrame) -> str:
    """Content hash of a table: schema, row count and order-free sums over the rows' hashes.

    Sums combine on the map side and do not depend on partitioning. When the table carries row
    numbers they are part of the row, so the same rows in another order differ.
    """
    dtypes = X.types_of(df)
    values = [f"to_json({X.quote(c)})" if isinstance(dtypes[c], T.MapType) else X.quote(c) for c in df.columns]
    # the hash skips nulls, so their places are hashed too, as bits of one number for every 60 columns
    words = [df.columns[i : i + 60] for i in range(0, len(df.columns), 60)]
    places = [" + ".join(f"IF({X.quote(c)} IS NULL, {1 << i}L, 0L)" for i, c in enumerate(word)) for word in words]
    # sixteen bits at a time, so that sums of longs hold the rows of any table
    parts = [f"sum(shiftrightunsigned({x}, {k}) & 65535L) AS {x}{k}" for x in ("h", "g") for k in (0, 16, 32, 48)]
    row = (
        df.selectExpr(f"xxhash64({', '.join([*places, *values])}) AS h")
        .selectExpr("h", "xxhash64(h) AS g")
        .selectExpr("count(*) AS n", *parts)
        .first()
    )
    schema = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return hashlib.sha256(repr((schema, *row)).encode()).hexdigest()


def staged_path(folder: str, content_hash: str) -> str:
    return f"{folder.rstrip('/')}/{content_hash}.parquet"


def stage(df: DataFrame, folder: str, content_hash: str | None = None) -> DataFrame:
    """Write a table once as Zstandard Parquet and return the staged copy.

    A finished copy already there under the same content hash is reused; a half-written one is
    replaced. Row numbers are kept as a column; rows are written in the order they are scanned,
    so row-number ranges stay together and later range filters skip most row groups.
    """
    path = staged_path(folder, content_hash or fingerprint(df))
    spark = df.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    finished = done.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(done)
    if not finished:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def as_cells(df: DataFrame) -> DataFrame:
    """Every column as trimmed text, dates in ISO form, blanks null; the row number stays."""
    return df.selectExpr(
        *[
            f"{X.cell_text(X.quote(f.name), f.dataType)} AS {X.quote(f.name)}"
            for f in df.schema.fields
            if f.name != ROW
        ],
        *([ROW] if ROW in df.columns else []),
    )
