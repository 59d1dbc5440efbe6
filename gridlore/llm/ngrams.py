"""Character n-gram models of any size: interpolated modified Kneser-Ney, as tables sharded by n-gram.

A token is a character as it is, before a text stand marks. Models of one call share a vocabulary, all
Unicode characters, so an unseen one has a probability too. Counts, context sums, probabilities and
scores are joined by n-gram in Spark; no table goes through the driver or to every task. Texts are cut
into blocks: a block asks once for each distinct n-gram in it, and its texts meet the answers again
in one group of bounded size, so rows shuffled follow distinct n-grams of blocks and not characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gridlore.llm.preselect import of_ids
from gridlore.llm.textkit import SLICE_BYTES, slices, text_buffers
from gridlore.session import materialize

ORDER = 4
VOCABULARY = 1_112_064
"""Unicode characters; each has this share of the probability that order 1 frees."""
BEFORE = "￿"
"""Stands before a text; no character of Unicode."""
BLOCK_BYTES = 1 << 25
"""Text of a block; a longer text is a block alone."""
BROADCAST_IDS = 1 << 21
"""Ids, counted first, that are sent to every task (some 50 MB); more are joined by shuffle."""


def windows(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Texts laid end to end, in runs of about ``limit`` bytes: characters, place of each in its text
    (exact below ORDER - 1), its text, and how many at the start were in the run before."""
    first, size = 0, len(data)
    while first < size:
        end = min(first + limit, size)
        while end < size and data[end] & 0xC0 == 0x80:
            end += 1
        back = first
        for _ in range(ORDER - 1):
            back = max(back - 1, 0)
            while data[back] & 0xC0 == 0x80:
                back -= 1
        run = data[back:end]
        lead = np.concatenate([[0], np.cumsum((run & 0xC0) != 0x80)])
        starts = lead[np.clip(offsets, back, end) - back]
        lengths = np.diff(starts)
        points = np.frombuffer(run.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        begun = np.where(offsets[:-1] < back, ORDER - 1, 0)
        place = np.arange(len(points)) - np.repeat(starts[:-1] - begun, lengths)
        yield points, place, np.repeat(np.arange(len(lengths)), lengths), int(lead[first - back])
        first = end


def distinct_grams(points: np.ndarray, place: np.ndarray, skip: int) -> tuple[np.ndarray, pa.Array]:
    """The n-gram that ends at each character from ``skip`` on, as an index into the distinct ones."""
    letters, alphabet = pd.factorize(points)
    n = len(points)
    before = np.zeros(n, np.int64)
    before[1:] = letters[:-1] + 1
    before[place < 1] = 0
    pairs, seen = pd.factorize(before * (len(alphabet) + 1) + letters)
    earlier = np.zeros(n, np.int64)
    earlier[2:] = pairs[:-2] + 1
    earlier[place < 2] = 0
    index, grams = pd.factorize((earlier * len(seen) + pairs)[skip:])
    where = np.empty(len(grams), np.int64)
    where[index] = np.arange(skip, n)
    spelled = np.full((len(grams), ORDER), ord(BEFORE), dtype=np.uint32)
    for k in range(ORDER):
        real = place[where] >= k
        spelled[real, ORDER - 1 - k] = points[where[real] - k]
    text = np.frombuffer(spelled.tobytes().decode("utf-32-le").encode("utf-8"), dtype=np.uint8)
    ends = np.append(np.flatnonzero((text & 0xC0) != 0x80)[::ORDER], len(text)).astype(np.int32)
    return index, pa.Array.from_buffers(pa.string(), len(grams), [None, pa.py_buffer(ends), pa.py_buffer(text)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in pc.unique(whole.column("part")):
            for batch in slices(whole.filter(pc.equal(whole.column("part"), part)), "text"):
                for points, place, _, skip in windows(*text_buffers(batch.column("text"))):
                    index, grams = distinct_grams(points, place, skip)
                    counts = pa.array(np.bincount(index, minlength=len(grams)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), part.as_py(), np.int32)), grams, counts], names=["part", "g", "c"])


def count(texts: DataFrame, label: str) -> DataFrame:
    """(part, g, c): how often each n-gram of ORDER occurs in all of ``texts`` (text, part) of each part."""
    counted = texts.select("text", F.col("part").cast("int").alias("part")).mapInArrow(_count, "part int, g string, c long")
    return materialize(counted.groupBy("part", "g").agg(F.sum("c").alias("c")), label)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids`` (id, distinct, written out)."""
    if ids.count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(ids.select(F.col("id").alias("doc_id"))), "doc_id")
    return of_ids(docs, ids)


def _discounts(level: DataFrame) -> DataFrame:
    """Per model the discounts for counts of 1, 2 and 3 or more, from the numbers of n-grams seen 1 to 4 times."""
    seen = level.groupBy("m").agg(*[F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)])
    usual = {1: 0.5, 2: 0.75, 3: 0.9}
    cut = [
        F.expr(
            f"CASE WHEN n1 > 0 AND n2 > 0 AND n3 > 0 THEN least(greatest({k} - {k + 1} * (n1 / (n1 + 2D * n2)) * n{k + 1} / n{k}, 0.05D), {k - 0.05}D) ELSE {usual[k]}D END"
        ).alias(f"d{k}")
        for k in usual
    ]
    return seen.select("m", *cut)


def fit(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Models from counts (m, g, c) of n-grams of ORDER: per order from 1 the discounted shares of
    n-grams (m, g, own) and the shares that contexts leave to the order below (m, context, rest).

    Lower orders count the distinct characters before an n-gram.
    """
    levels = [counts]
    for k in range(ORDER - 1, 0, -1):
        shorter = levels[-1].groupBy("m", F.substring("g", 2, k).alias("g")).agg(F.count(F.lit(1)).alias("c"))
        levels.append(materialize(shorter, f"order{k}"))
    orders = []
    for k, level in enumerate(reversed(levels), start=1):
        # one row per model
        cut = level.join(F.broadcast(_discounts(level)), "m").withColumn("cut", F.expr("CASE c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END"))
        cut = cut.select("m", "g", "c", "cut", F.substring("g", 1, k - 1).alias("context"))
        sums = cut.groupBy("m", "context").agg(F.sum("c").alias("all"), F.sum("cut").alias("freed"))
        sums = materialize(sums, f"contexts{k}")
        own = cut.join(sums, ["m", "context"]).select("m", "g", ((F.col("c") - F.col("cut")) / F.col("all")).alias("own"))
        orders.append((own, sums.select("m", "context", (F.col("freed") / F.col("all")).alias("rest"))))
    return orders


def log_probabilities(orders: list[tuple[DataFrame, DataFrame]], grams: DataFrame, models: int) -> DataFrame:
    """(g, p0, p1, ...): natural log of the probability of the last character of each of ``grams``
    (g, of ORDER characters, distinct) after the others, per model from 0."""
    wanted = [grams.select("g")]
    for k in range(ORDER - 1, 0, -1):
        wanted.append(wanted[-1].select(F.substring("g", 2, k).alias("g")).distinct())
    lower = None
    for k, (asked, (own, rest)) in enumerate(zip(reversed(wanted), orders), start=1):
        rows = asked.select("g", F.explode(F.sequence(F.lit(0), F.lit(models - 1))).alias("m"))
        rows = rows.select("m", "g", F.substring("g", 1, k - 1).alias("context"), F.substring("g", 2, k - 1).alias("suffix"))
        rows = rows.join(own, ["m", "g"], "left").join(rest, ["m", "context"], "left")
        if lower is None:
            rows = rows.withColumn("below", F.lit(1 / VOCABULARY))
        else:
            rows = rows.join(lower.select("m", F.col("g").alias("suffix"), F.col("p").alias("below")), ["m", "suffix"])
        p = F.coalesce("own", F.lit(0.0)) + F.coalesce("rest", F.lit(1.0)) * F.col("below")
        lower = materialize(rows.select("m", "g", p.alias("p")), f"probabilities{k}")
    each = [F.max(F.when(F.col("m") == i, F.ln("p"))).cast("float").alias(f"p{i}") for i in range(models)]
    return materialize(lower.groupBy("g").agg(*each), "resolved")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The task's rows in blocks: number, slices."""
    number, held, size = TaskContext.get().partitionId() << 32, [], 0
    for whole in batches:
        for batch in slices(whole, "text"):
            more = len(text_buffers(batch.column("text"))[0])
            if held and size + more > BLOCK_BYTES:
                yield number, held
                number, held, size = number + 1, [], 0
            held.append(batch)
            size += more
    if held:
        yield number, held


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, held in _blocks(batches):
        found = [pa.array([], pa.string())]
        for batch in held:
            for points, place, _, skip in windows(*text_buffers(batch.column("text"))):
                found.append(distinct_grams(points, place, skip)[1])
            found = [pc.unique(pa.chunked_array(found))]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), number)), found[0]], names=["block", "g"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))
    for number, held in _blocks(batches):
        for batch in held:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])


def _score(models: int, packed: pa.Table, answers: pa.Table) -> pa.Table:
    known = answers.column("g").combine_chunks()
    logs = [answers.column(f"p{i}").to_numpy().astype(np.float64) for i in range(models)]
    out = []
    for rows in packed.column("rows"):
        with pa.ipc.open_stream(rows.as_buffer()) as stream:
            batch = stream.read_next_batch()
        sums, length = np.zeros((models, batch.num_rows)), np.zeros(batch.num_rows, np.int64)
        for points, place, text, skip in windows(*text_buffers(batch.column("text"))):
            index, grams = distinct_grams(points, place, skip)
            at = pc.index_in(grams, value_set=known)
            if at.null_count:  # blocks are cut alike as long as the rows come alike
                raise ValueError("the documents changed between two reads of them")
            at = at.to_numpy()[index]
            length += np.bincount(text[skip:], minlength=batch.num_rows)
            for i in range(models):
                sums[i] += np.bincount(text[skip:], logs[i][at], minlength=batch.num_rows)
        means = sums / np.maximum(length, 1)
        kept = [batch.column(c) for c in batch.schema.names if c != "text"]
        names = [c for c in batch.schema.names if c != "text"]
        out.append(pa.RecordBatch.from_arrays([*kept, pa.array(length), *map(pa.array, means)], names=[*names, "n_tokens", *(f"mean{i}" for i in range(models))]))
    if not out:  # answers to a block that no longer is there
        raise ValueError("the documents changed between two reads of them")
    return pa.Table.from_batches(out)


def score(docs: DataFrame, orders: list[tuple[DataFrame, DataFrame]], models: int) -> DataFrame:
    """The columns of ``docs`` without text, n_tokens (characters), and per model mean0, mean1, ...: the
    mean log probability of the characters, 0 for null or empty text."""
    asked = materialize(docs.mapInArrow(_ask, "block long, g string"), "asked")
    answers = log_probabilities(orders, asked.select("g").distinct(), models)
    answers = asked.join(answers, "g")
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + ["n_tokens long"] + [f"mean{i} double" for i in range(models)])
    packed = docs.mapInArrow(_pack, "block long, rows binary")

    def apply(rows: pa.Table, found: pa.Table) -> pa.Table:
        return _score(models, rows, found)

    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(apply, schema)
