"""Exact ranked search with sparse ball trees.

A document is the sparse vector of its terms' integer scores, restricted to terms that some item
asks for; an item is the sparse vector of term weights; rank is their inner product. Tasks build
ball trees over their documents: each node has the centroid and radius of the vectors below it, and
no inner product with q exceeds q.centroid + |q| * radius. Vectors of texts spread over many terms, so
a node also has a radius along each term, r, and the bound is q.centroid + min(|q| * radius, q.r). Nodes are taken best-first per item and a
subtree is left out once its bound, raised by more than all rounding, is below the 50th score so
far. Leaves are scored in integers, so results are exact. A first search of a bounded sample gives
each item a score that 50 documents reach, which all other tasks start from.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F

from gridlore.llm.textkit import slices
from gridlore.session import materialize

TOP = 50
BLOCK_TERMS = 1 << 13
BLOCK_ITEMS = 512
"""Items, and terms with repeats over items, searched for in one pass over the documents; an item with more terms is a block of its own."""
TREE_DOCS = 4096
LEAF_DOCS = 32
DIRECTIONS = 24
"""Random directions that documents are projected on to choose splits; any split is right, these keep near documents together."""
SAMPLE = 20_000
"""Documents searched first for a bar."""
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
VECTORS = "doc_id long, n long, term array<int>, tf array<int>"
FOUND = "item int, doc_id long, score long"


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased."""
    return TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


def _vectors(wanted: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.get
        for whole in batches:
            for batch in slices(whole, "text"):
                sizes, held, counts, n = [], [], [], []
                for text in batch.column("text").to_pylist():
                    all_terms = terms(text)
                    ids = np.array([k for k in map(known, all_terms) if k is not None], dtype=np.int32)
                    ids, tf = np.unique(ids, return_counts=True)
                    n.append(len(all_terms))
                    sizes.append(len(ids))
                    held.append(ids)
                    counts.append(tf.astype(np.int32))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, np.concatenate(x).astype(np.int32)) for x in (held, counts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "term", "tf"])

    return run


class BallTree:
    """A tree over sparse rows: ``starts`` delimits each row's terms and values."""

    def __init__(self, starts: np.ndarray, term: np.ndarray, value: np.ndarray, width: int):
        self.starts, self.term, self.value, self.width = starts, term, value, width
        rows = len(starts) - 1
        self.order = np.arange(rows)
        exact = value.astype(np.float64)
        sizes = np.diff(starts)
        owner = np.repeat(np.arange(rows), sizes)
        self.norms = np.bincount(owner, exact * exact, minlength=rows)
        directions = np.random.default_rng(7).standard_normal((width, DIRECTIONS))
        self.shadow = np.stack([np.bincount(owner, exact * directions[term, k], minlength=rows) for k in range(DIRECTIONS)], axis=1)
        self.nodes: list[tuple[int, int, int, int]] = []  # first row, end, left child, right child
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.spans: list[np.ndarray] = []
        if rows:
            self._grow()

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows' entries, and how many each row has."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(sizes)
        return np.arange(ends[-1]) + np.repeat(self.starts[rows] - ends + sizes, sizes), sizes

    def _grow(self) -> None:
        self.nodes.append((0, len(self.order), -1, -1))
        at = 0
        while at < len(self.nodes):
            first, end, _, _ = self.nodes[at]
            rows = self.order[first:end]
            places, sizes = self._entries(rows)
            term, value = self.term[places], self.value[places].astype(np.float64)
            centre = np.bincount(term, value, minlength=self.width) / len(rows)
            dots = np.bincount(np.repeat(np.arange(len(rows)), sizes), value * centre[term], minlength=len(rows))
            squares = self.norms[rows] - 2 * dots + centre @ centre
            self.centres.append(centre)
            # the radius along each term: how far the largest value lies above the centre; scores only grow with values
            top = np.zeros(self.width)
            np.maximum.at(top, term, value)
            self.spans.append(np.maximum(top - centre, 0))
            # rounding of the squares is below 1e-9 of the terms they are made of
            self.radii.append(math.sqrt(max(float(squares.max()), 0.0) + 1e-9 * float(self.norms[rows].max() + centre @ centre)))
            if len(rows) > LEAF_DOCS:
                shadow = self.shadow[rows]
                far = shadow[np.argmax(((shadow - shadow.mean(axis=0)) ** 2).sum(axis=1))]
                other = shadow[np.argmax(((shadow - far) ** 2).sum(axis=1))]
                # halves along the line through two distant rows, so depth is bounded also for equal rows
                side = np.argsort(shadow @ (other - far), kind="stable")
                self.order[first:end] = rows[side]
                middle = first + len(rows) // 2
                self.nodes[at] = (first, end, len(self.nodes), len(self.nodes) + 1)
                self.nodes += [(first, middle, -1, -1), (middle, end, -1, -1)]
            at += 1

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner product of each node's rows with each query (dense rows of weights from 0 up)."""
        if not self.nodes:
            return np.zeros((0, len(queries)))
        exact = queries.astype(np.float64)
        middle, length = np.stack(self.centres) @ exact.T, np.sqrt((exact * exact).sum(axis=1))
        bound = middle + np.minimum(np.array(self.radii)[:, None] * length, np.stack(self.spans) @ exact.T)
        return bound * (1 + 1e-9) + 1

    def scores(self, node: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a leaf and their inner products, in 64-bit integers."""
        first, end, _, _ = self.nodes[node]
        rows = self.order[first:end]
        places, sizes = self._entries(rows)
        sums = np.concatenate([[0], np.cumsum(query[self.term[places]] * self.value[places])])
        ends = np.cumsum(sizes)
        return rows, sums[ends] - sums[ends - sizes]


class Best:
    """The best ``top`` (score, id) so far: highest score, then smallest id. ``floor`` is a score that many others reach."""

    def __init__(self, top: int, floor: int):
        self.top, self.floor, self.heap = top, max(floor, 1), []

    @property
    def bar(self) -> int:
        """Below it nothing is taken."""
        return max(self.floor, self.heap[0][0]) if len(self.heap) == self.top else self.floor

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for k in np.flatnonzero(scores >= self.bar).tolist():
            entry = (int(scores[k]), -int(ids[k]))
            if len(self.heap) < self.top:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)


def search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, best: list[Best]) -> int:
    """Offer to each query's best all rows of the tree that its bounds don't rule out; the number of rows scored."""
    bounds, scored = tree.bounds(queries), 0
    for q in range(len(queries) if len(bounds) else 0):
        query, found, column = queries[q], best[q], bounds[:, q]
        heap = [(-column[0], 0)]
        while heap and -heap[0][0] >= found.bar:
            node = heapq.heappop(heap)[1]
            _, _, left, right = tree.nodes[node]
            if left < 0:
                rows, scores = tree.scores(node, query)
                scored += len(rows)
                found.offer(scores, ids[rows])
            else:
                for child in (left, right):
                    if column[child] >= found.bar:
                        heapq.heappush(heap, (-column[child], child))
    return scored


NULL_ID = (1 << 63) - 1
"""Stands for a null id inside a search, so that it comes after all others."""


def _search(queries: np.ndarray, floors: np.ndarray, documents: int, length: int, top: int):
    """Search of a task's documents; ``documents`` and ``length`` are the corpus's number of documents and of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top, int(f)) for f in floors]
        for whole in batches:
            for at in range(0, whole.num_rows, TREE_DOCS):
                batch = whole.slice(at, TREE_DOCS)
                ids = batch.column("doc_id").fill_null(NULL_ID).to_numpy()
                lists, tf = batch.column("term"), batch.column("tf").flatten().to_numpy().astype(np.int64)
                sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                n = batch.column("n").to_numpy()
                m = np.repeat(50 + (50 * n * documents) // max(length, 1), sizes)
                # rows without any wanted term score 0 and take no part
                used = np.flatnonzero(sizes)
                starts = np.concatenate([[0], np.cumsum(sizes[used])])
                tree = BallTree(starts, lists.flatten().to_numpy().astype(np.int64), 1_000_000_000 * tf // (1000 * tf + 20 * m), queries.shape[1])
                search(tree, ids[used], queries, best)
        rows = [(q, -i, s) for q, b in enumerate(best) for s, i in b.heap]
        item, doc, score = (np.array(c, dtype=np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
        columns = [pa.array(item.astype(np.int32)), pa.array(doc, mask=doc == NULL_ID), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The best rows of each item, first within shards of ids, so that no item's rows meet in one task unreduced."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", shard).orderBy(*order))).where(F.col("rank") <= top).drop("rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, set[bytes]]]]:
    """Items that have terms, with them, in blocks of bounded size; one block at a time is on the driver."""
    block: list[tuple[int | None, set[bytes]]] = []
    size = 0
    for item, rows in groupby(items.select(F.col("item_id").cast("long").alias("item_id"), "text").sort("item_id").toLocalIterator(), key=lambda r: r["item_id"]):
        found = {t for r in rows for t in terms(r["text"])}
        if block and (size + len(found) > BLOCK_TERMS or len(block) == BLOCK_ITEMS):
            yield block
            block, size = [], 0
        if found:
            block.append((item, found))
            size += len(found)
    if block:
        yield block


def _search_block(spark: SparkSession, docs: DataFrame, block: list[tuple[int | None, set[bytes]]], top: int) -> DataFrame:
    names = sorted(set().union(*(found for _, found in block)))
    wanted = {t: k for k, t in enumerate(names)}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vectors = materialize(texts.mapInArrow(_vectors(wanted), VECTORS), "vectors")
    whole: Row = vectors.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length"), F.count(F.lit(1)).alias("rows")).first()
    holders = np.zeros(len(names), dtype=np.int64)
    for r in vectors.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():  # one row per wanted term
        holders[r["term"]] = r["df"]
    n = whole["documents"]
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in holders.tolist()], dtype=np.int64)
    queries = np.zeros((len(block), len(names)), dtype=np.int64)
    for q, (_, found) in enumerate(block):
        at = [wanted[t] for t in found]
        queries[q, at] = weights[at]
    find = lambda rows, floors: rows.mapInArrow(_search(queries, floors, n, whole["length"], top), FOUND)
    floors = np.zeros(len(block), dtype=np.int64)
    if whole["rows"] > 2 * SAMPLE:
        sample = vectors.where(F.pmod(F.xxhash64("doc_id", "n", "term"), F.lit(whole["rows"])) < SAMPLE)
        for r in _ranked(find(sample, floors), top).where(F.col("rank") == top).collect():  # one row per item of the block
            floors[r["item"]] = r["score"]
    ids = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], "item int, item_id long")
    found = _ranked(find(vectors, floors), top)
    return found.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` documents of each item by score, above 0: item_id, rank (from 1), doc_id, score.

    ``items`` has item_id and text; rows that share an item_id, null included, are one item with the terms of all its rows.
    Equal scores rank by ascending doc_id, null last; repeated documents count and rank each, in no
    order among themselves. Null text has no terms, and an item without terms, or whose terms no document holds, has
    no rows. Texts of any length are read whole; further columns are ignored; without documents or items the
    result is empty. Items are searched in blocks of bounded size, each one pass over the documents.
    """
    spark, out = docs.sparkSession, None
    for block in _blocks(items):
        part = _search_block(spark, docs, block, top)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
