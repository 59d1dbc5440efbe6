"""Cross-entropy difference between a target and a background n-gram model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridlore.llm import ngrams
from gridlore.session import materialize


def cross_entropy_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, target_loss, background_loss, score.

    The target model counts the documents named in ``target`` (doc_id), the background model all of
    ``docs``; both have the same order and vocabulary, so losses compare token by token. Losses are
    means in nats per token (a character); score is target minus background, and a lower score is
    closer to the target. Null or empty text has no token and scores 0; without any target text all
    characters are as likely to the target model. Texts of any length are scored whole. Repeated rows
    are counted and scored each; ids without a document and null ids add nothing; further columns are
    ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = materialize(target.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct(), "target")
    near = ngrams.count(ngrams.texts_of(rows, ids).withColumn("part", F.lit(0)), "target-ngrams")
    far = ngrams.count(rows.withColumn("part", F.lit(1)), "background-ngrams")
    models = ngrams.fit(near.union(far).select(F.col("part").alias("m"), "g", "c"))
    scored = ngrams.score(rows, models, 2)
    # + 0.0 turns the negative zero of texts without tokens into zero
    losses = [(-F.col(f"mean{i}") + F.lit(0.0)).alias(name) for i, name in enumerate(("target_loss", "background_loss"))]
    return scored.select("doc_id", "n_tokens", *losses).withColumn("score", F.col("target_loss") - F.col("background_loss"))
