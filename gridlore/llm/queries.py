"""Registered queries: each operator over its whole table, with its SQL twin where SQL has one."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlore.llm import ball_tree, exact_dedup, html_extract, lm_scoring, near_dedup, neighbours, nnls_packing, packing, piece_codec, quality, secret_scan, token_links, toxicity

PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
BYTE_BPE = os.environ.get("BYTE_BPE", "/opt/tokenizers/byte_bpe_50k.json")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_kneser_ney_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@query
def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.best_fit(_table(spark, folder, "documents"))


@query
def op3_minmax_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.link_documents(_table(spark, folder, "documents"), width=4)


@query
def op4_style_tree_extract(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.main_text(_table(spark, folder, "pages"))


@query
def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, folder, "documents")).drop("bounds")


@query
def op6_adaptive_scan_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(_table(spark, folder, "embeddings"))


@query
def op7_ordinal_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return toxicity.grade(docs, toxicity.fit(docs, _table(spark, folder, "labels")))


@query
def op8_sentencepiece_codec(spark: SparkSession, folder: str) -> DataFrame:
    """The model file lies on the driver and goes to the tasks from there."""
    return piece_codec.encode(_table(spark, folder, "documents"), Path(PIECE_MODEL).read_bytes())


@query
def op9_content_sort_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.content_sort(_table(spark, folder, "documents"))


@query
def op10_cross_entropy_difference(spark: SparkSession, folder: str) -> DataFrame:
    """The target is the text labelled good and not toxic; the background is everything."""
    wanted = _table(spark, folder, "labels").where((F.col("quality") == 1) & (F.col("toxic") == 0))
    return lm_scoring.cross_entropy_difference(_table(spark, folder, "documents"), wanted)


@query
def op11_ball_tree_search(spark: SparkSession, folder: str) -> DataFrame:
    return ball_tree.ranked_search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@query
def op12_nnls_packing(spark: SparkSession, folder: str) -> DataFrame:
    """The vocabulary file lies on the driver and goes to the tasks from there."""
    return nnls_packing.pack(_table(spark, folder, "documents"), Path(BYTE_BPE).read_bytes(), digest=True)


@query
def op13_lockstep_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_links.align_tokenizers(_table(spark, folder, "documents"), Path(BYTE_BPE).read_bytes(), Path(PIECE_MODEL).read_bytes())


ORACLES["op9_content_sort_dedup"] = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
"""

ORACLES["op11_ball_tree_search"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
whole AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark),
tf AS (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d),
f AS (SELECT doc_id, n, t, count(*) AS tf FROM tf WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * whole.n + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM f GROUP BY t), whole),
s AS (
  SELECT item_id, doc_id, sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * f.n * whole.n) // whole.l))))::BIGINT AS score
  FROM q JOIN f USING (t) JOIN w USING (t), whole GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
"""
