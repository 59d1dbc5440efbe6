"""Quality by perplexity under a Kneser-Ney model of trusted text, with a threshold per language."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridlore.llm import ngrams
from gridlore.session import materialize

QUANTILE = 0.99
"""Share of a language's trusted documents that the threshold keeps."""
ACCURACY = 100_000
FOLDS = 3
"""Parts of the trusted texts; each is scored by a model of the others."""


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, perplexity, threshold, kept.

    Trusted are documents labelled quality 1; labels without a document, null labels and repeated
    labels add nothing. A trusted document's perplexity is that under a model of the other folds, since
    a model that has counted a text finds it easier than any other; copies of a text share a fold. A
    language's threshold is the given quantile of its trusted documents' perplexities. Documents above
    it are rejected; a language without trusted documents has a null threshold and rejects nothing
    but null or empty text, which has perplexity 1 and is always rejected. A null lang is a language of its
    own. Texts of any length are scored whole. Further columns are ignored; an empty table gives an empty result.
    """
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct()
    trusted = materialize(trusted, "trusted")
    fold = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FOLDS)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    counts = ngrams.count(ngrams.texts_of(rows.select("doc_id", "text", fold.alias("part")), trusted), "ngrams")
    # model 0 counts all folds, model k all but fold k - 1
    models = F.explode(F.filter(F.sequence(F.lit(0), F.lit(FOLDS)), lambda m: m != F.col("part") + 1))
    counts = materialize(counts.select(models.alias("m"), "g", "c").groupBy("m", "g").agg(F.sum("c").alias("c")), "model-counts")
    scored = ngrams.score(rows.withColumn("fold", fold), ngrams.fit(counts), FOLDS + 1)
    held = F.element_at(F.array(*[f"mean{i}" for i in range(1, FOLDS + 1)]), F.col("fold") + 1)
    scored = materialize(scored.select("doc_id", "lang", "n_tokens", "mean0", held.alias("held")), "scores")
    scored = scored.join(trusted.select(F.col("id").alias("doc_id"), F.lit(True).alias("_trusted")), "doc_id", "left")
    scored = scored.withColumn("perplexity", F.exp(-F.when(F.col("_trusted"), F.col("held")).otherwise(F.col("mean0"))))
    scored = materialize(scored, "perplexity")
    limits = scored.where("_trusted and n_tokens > 0").groupBy(F.col("lang").alias("_lang")).agg(F.percentile_approx("perplexity", quantile, ACCURACY).alias("threshold"))
    # one row per language
    out = scored.join(materialize(limits, "limits"), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    kept = (F.col("n_tokens") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "perplexity", "threshold", kept.alias("kept"))
