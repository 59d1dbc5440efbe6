"""Joins of long texts to a list of ids without shuffling the texts that don't match."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BITMAP_WORDS = 1 << 17
"""Size bound of the bitmap: 1 MB of bits. What it lets through in excess is dropped by the join."""


def of_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose ``key`` is in ``ids`` (column id, distinct).

    A bitmap over hashed ids, at most BITMAP_WORDS rows of 16 bytes, is broadcast to the scan; the
    rows that it can't rule out then take part in an ordinary join. Null keys match nothing.
    """
    bit = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(BITMAP_WORDS * 64))
    words = (
        ids.select(bit(F.col("id")).alias("_b"))
        .groupBy(F.expr("_b div 64").alias("_w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_b % 64 as int))")).alias("_bits"))
    )
    chosen = (
        docs.withColumn("_b", bit(F.col(key)))
        .withColumn("_w", F.expr("_b div 64"))
        .join(F.broadcast(words), "_w")
        .where("(shiftright(_bits, cast(_b % 64 as int)) & 1) = 1")
        .drop("_b", "_w", "_bits")
    )
    # an inner join: the planner would move a semi join below the bitmap
    return chosen.join(ids.select(F.col("id").alias(key)), key)
