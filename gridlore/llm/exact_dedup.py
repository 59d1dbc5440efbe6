"""Exact duplicates by a content sort, in DataFrame operations only.

Texts are equal when they are identical without ``[\\x20\\x09-\\x0D]``. Rows are range-partitioned
by splitters sampled from their content, sorted, and neighbours are compared in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gridlore.session import materialize

SPLITTER_CHARS = 48
"""Leading characters that splitters use; what they don't tell apart, a fingerprint deals out."""
HOT_PER_PARTITION = 16
"""A text is split over several ranges if it has more rows than a partition's share by this."""


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def content_sort(docs: DataFrame, payload: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, then ``payload``.

    Of equal texts the row with most code points in the original stays, then the smallest doc_id
    (null last); exactly one row of a group is kept, also among repeated rows. Null text counts as
    empty. Columns other than doc_id, text and the payload are ignored, so their names can't clash;
    an empty table gives an empty result.

    Splitters are taken from a bounded prefix and a fingerprint, so the sample on the driver stays
    small whatever the length of texts. A frequent text gets a salt as last sort key, so it is cut
    into runs in neighbouring ranges, of which only the leaders (bounded by the number of
    partitions) are compared once more. Texts are shuffled once.
    """
    spark = docs.sparkSession
    payload = payload or []
    base = docs.select(
        F.col("doc_id").alias("_id"),
        F.length(F.coalesce("text", F.lit(""))).alias("_n"),
        normalised(F.col("text")).alias("_norm"),
        F.struct(*[F.col(f"`{c}`") for c in payload]).alias("_row") if payload else F.lit(None).cast("int").alias("_row"),
    ).withColumn("_h", F.xxhash64("_norm"))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    limit = max(2, docs.count() // (HOT_PER_PARTITION * partitions))
    hot = (
        base.groupBy("_h").count().where(F.col("count") > limit)
        .select("_h", F.ceil(F.col("count") / limit).cast("int").alias("_salts"))
    )
    # at most HOT_PER_PARTITION * partitions rows of 12 bytes, by the choice of the limit
    dealt = base.join(F.broadcast(hot), "_h", "left").select(
        "_id", "_n", "_norm", "_row", "_h", F.substring("_norm", 1, SPLITTER_CHARS).alias("_p"),
        F.coalesce("_salts", F.lit(1)).alias("_salts"),
        F.pmod(F.xxhash64("_id", F.spark_partition_id()), F.coalesce("_salts", F.lit(1))).cast("int").alias("_salt"),
    )
    ranged = dealt.repartitionByRange("_p", "_h", "_salt")
    order = Window.partitionBy("_p", "_h", "_salt", "_norm").orderBy(F.desc("_n"), F.asc_nulls_last("_id"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = ranged.select(
        "*",
        F.row_number().over(order).alias("_place"),
        F.first("_id").over(whole).alias("_lead"),
        F.first("_n").over(whole).alias("_lead_n"),
        F.count(F.lit(1)).over(whole).alias("_size"),
    )
    runs = materialize(
        runs.select(
            "_id", "_row", "_salt", "_salts", "_place", "_lead", "_lead_n", "_size",
            F.sha2("_norm", 256).alias("_sha"),
            F.when((F.col("_salts") > 1) & (F.col("_place") == 1), F.col("_norm")).alias("_leader"),
        ),
        "content-sort",
    )
    best = F.min(F.struct(-F.col("_lead_n"), F.col("_lead").isNull(), F.col("_lead").alias("id"), F.col("_salt").alias("salt")))
    joined = (
        runs.where(F.col("_leader").isNotNull())
        .groupBy("_leader", "_sha")
        .agg(best.alias("b"), F.sum("_size").alias("_all"))
        .select("_sha", F.col("b.id").alias("_best"), F.col("b.salt").alias("_best_salt"), "_all")
    )  # one row per frequent text, see above
    out = runs.drop("_leader").join(F.broadcast(joined), "_sha", "left")
    cut = F.col("_all").isNotNull()
    return out.select(
        F.col("_id").alias("doc_id"),
        F.when(cut, F.col("_best")).otherwise(F.col("_lead")).alias("keep_id"),
        F.coalesce("_all", "_size").alias("group_size"),
        ((F.col("_place") == 1) & (~cut | (F.col("_salt") == F.col("_best_salt")))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        *([F.col("_row").alias("_row")] if payload else []),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without exact copies: all its columns, one row of each group of equal texts."""
    out = content_sort(docs, docs.columns).where("kept")
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
