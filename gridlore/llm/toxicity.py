"""Severity of toxic language by cumulative-link ordinal regression.

``P(grade <= k) = sigmoid(t_k - w.x)``: one weight vector for all ordered thresholds. Features are the
distinct words of a text and their beginnings, which carry inflected forms; only those that the labels
single out get a weight. The result is the expected grade.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gridlore.llm.preselect import of_ids
from gridlore.llm.textkit import slices
from gridlore.session import materialize

FIT_ROWS = 10_000
"""Labelled rows, of smallest hash, that the model is fitted on."""
FEATURES = 8_192
LEAST_DOCUMENTS = 5
BUCKETS = 1 << 24
GRADES = 4
"""Grade 0 is not toxic; toxic documents are graded by thirds of the density of toxic features."""
LEXICON_ODDS = 3.0
RIDGE = 1.0
STEPS = 200
DECISION = 0.5
MEMO = 1 << 17
_EDGES = string.punctuation + "¡¿«»„“”‘’…–—"


def word_features(word: str) -> list[int]:
    """Feature numbers of one lower-cased word: itself, and its first four and five letters."""
    bare = word.strip(_EDGES)
    if not bare:
        return []
    parts = [f"w{bare}", *(f"p{bare[:k]}" for k in (4, 5) if len(bare) > k)]
    return [xxhash.xxh64_intdigest(p) % BUCKETS for p in parts]


def words_of(text: str | None) -> set[str]:
    return set((text or "").lower().split())


@dataclass
class Model:
    weights: dict[int, float]
    thresholds: np.ndarray

    def word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in word_features(word))

    def grades(self, x: np.ndarray) -> np.ndarray:
        """P(grade = k) for each linear score."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - x[:, None], -35, 35)))
        return np.diff(np.column_stack([np.zeros(len(x)), below, np.ones(len(x))]), axis=1)


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grade: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of least penalised loss, by Adam on the whole sparse sample."""
    n, k = len(grade), GRADES - 1
    share = np.clip(np.cumsum(np.bincount(grade, minlength=GRADES))[:k] / n, 1e-3, 1 - 1e-3)
    t = np.log(share / (1 - share))
    raw = np.concatenate([[t[0]], np.log(np.maximum(np.diff(t), 0.1))])
    w = np.zeros(width)
    moments = [np.zeros(width + k), np.zeros(width + k)]
    upper, lower = grade < k, grade > 0
    for step in range(1, STEPS + 1):
        t = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        x = np.bincount(rows, weights=values * w[columns], minlength=n)
        a = np.where(upper, 1 / (1 + np.exp(-np.clip(t[np.minimum(grade, k - 1)] - x, -35, 35))), 1.0)
        b = np.where(lower, 1 / (1 + np.exp(-np.clip(t[np.maximum(grade - 1, 0)] - x, -35, 35))), 0.0)
        p = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a) / p, b * (1 - b) / p  # d log p / d upper and lower threshold
        slope = (da - db) / n  # of the loss by x
        by_t = -np.bincount(grade[upper], weights=da[upper], minlength=k)[:k] / n
        by_t += np.bincount(grade[lower] - 1, weights=db[lower], minlength=k)[:k] / n
        by_raw = np.cumsum(by_t[::-1])[::-1].copy()
        by_raw[1:] *= np.exp(raw[1:])
        gradient = np.concatenate([np.bincount(columns, weights=values * slope[rows], minlength=width) + RIDGE * w / n, by_raw])
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.999 * moments[1] + 0.001 * gradient**2
        move = 0.1 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-9)
        w -= move[:width]
        raw = raw - move[width:]
    return w, np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("features", pa.list_(pa.int32())), ("n_words", pa.int64())])
    for whole in batches:
        for batch in slices(whole, "text"):
            found, size = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                found.append([f for w in words for f in word_features(w)])
                size.append(len(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found, schema.field(1).type), pa.array(size, pa.int64())], schema=schema)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from at most FIT_ROWS labelled rows; None without examples of both kinds.

    Repeated or contradictory labels of a document count as toxic if one of them does.
    """
    marked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("toxic"))
    sample = materialize(marked.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS), "label-sample")
    texts = of_ids(docs.select("doc_id", "text"), sample.select("id"))
    seen = materialize(texts.mapInArrow(_extract, "doc_id long, features array<int>, n_words long").join(sample.withColumnRenamed("id", "doc_id"), "doc_id"), "features")
    sizes = {bool(r["toxic"]): r["count"] for r in seen.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    if len(sizes) < 2:
        return None
    single = seen.select((F.col("toxic") > 0).alias("toxic"), F.explode(F.array_distinct("features")).alias("f"))
    with_, without = F.count(F.when(F.col("toxic"), 1)), F.count(F.when(~F.col("toxic"), 1))
    odds = F.log((with_ + 0.5) / (sizes[True] + 1)) - F.log((without + 0.5) / (sizes[False] + 1))
    ranked = single.groupBy("f").agg(odds.alias("odds"), F.count(F.lit(1)).alias("n"), with_.alias("hits")).where(F.col("n") >= LEAST_DOCUMENTS)
    chosen = ranked.orderBy(F.desc(F.abs("odds") * F.sqrt("n")), "f").limit(FEATURES).toArrow()
    features, odds_of, hits = (chosen.column(c).to_numpy() for c in ("f", "odds", "hits"))
    order = np.argsort(features)
    features, lexicon = features[order], ((odds_of >= LEXICON_ODDS) & (hits >= LEAST_DOCUMENTS))[order]
    data = seen.select("features", "n_words", "toxic").toArrow()  # FIT_ROWS rows at most
    lists = data.column("features").combine_chunks()
    flat, lengths = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    rows = np.repeat(np.arange(len(lengths)), lengths)
    at = np.minimum(np.searchsorted(features, flat), len(features) - 1) if len(features) else np.zeros(len(flat), int)
    known = features[at] == flat if len(features) else np.zeros(len(flat), bool)
    rows, columns = rows[known], at[known]
    toxic = data.column("toxic").to_numpy() > 0
    density = np.bincount(rows, weights=lexicon[columns], minlength=len(toxic)) / np.maximum(data.column("n_words").to_numpy(), 1)
    cuts = np.quantile(density[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
    grade = np.where(toxic, 1 + np.searchsorted(cuts, density, side="left"), 0)
    w, thresholds = fit_ordinal(rows, columns, np.ones(len(rows)), grade.astype(np.int64), len(features))
    return Model({int(f): float(x) for f, x in zip(features, w) if abs(x) > 1e-4}, thresholds)


def grade(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, severity (expected grade), grade (the likeliest), p_toxic, toxic.

    Null or empty text has no feature and gets the grade of the thresholds alone. Without a model
    everything has severity 0. Repeated rows get equal results; an empty table gives an empty one;
    further columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("grade", pa.int32()), ("p_toxic", pa.float64()), ("toxic", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for whole in batches:
            for batch in slices(whole, "text"):
                p = _probabilities(model, batch.column("text").to_pylist(), memo)
                toxic = 1 - p[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array(p @ np.arange(GRADES)), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(toxic), pa.array(toxic >= DECISION)],
                    schema=schema,
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def _probabilities(model: Model | None, texts: list[str | None], memo: dict[str, float]) -> np.ndarray:
    if model is None:
        return np.tile(np.eye(1, GRADES), (len(texts), 1))
    x = np.empty(len(texts))
    for i, text in enumerate(texts):
        words, total = words_of(text), 0.0
        for word in words:
            value = memo.get(word)
            if value is None:
                if len(memo) >= MEMO:
                    memo.clear()
                value = memo[word] = model.word(word)
            total += value
        x[i] = total
    return model.grades(x)


def drop_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without the rows judged toxic; all its columns, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for whole in batches:
            for batch in slices(whole, "text"):
                p = _probabilities(model, batch.column("text").to_pylist(), memo)
                yield batch.filter(pa.array(1 - p[:, 0] < DECISION))

    return docs.mapInArrow(run, docs.schema)
