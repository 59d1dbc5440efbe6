"""Packing by non-negative least squares over the histogram of piece lengths.

Documents become token ids and are cut at multiples of the window; what is left over has a length
below it. All that the plan needs is how many pieces each length has, at most one number per length.
Combinations of two or three lengths that fill a window exactly are enumerated, their repeat counts
solved by least squares under x >= 0, and rounded. Pieces that no combination takes are packed
greedily, again by counts: longest first, filled with the longest that fits, and where nothing fits
a piece is cut to the room left, so that only the last sequence can have padding.

The plan says, for ranges of ranks within a length, which sequence and offset they get. Ranks come
from counts per task and length, so no length, however frequent, has its pieces in one place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from gridlore.llm.byte_bpe import encoder
from gridlore.llm.textkit import slices
from gridlore.session import materialize

WINDOW = 2048
END_ID = 1
"""Token that closes each document."""
SWEEPS = 2_000
"""Bound on the solver's sweeps. Whatever it leaves is packed greedily, so it decides on speed alone."""
BROADCAST_ROWS = 1 << 18
"""Rank offsets (some 100 bytes each) are broadcast up to this number of rows and joined by shuffle beyond it."""
PLACED_ROWS = 512
"""Pieces placed at once inside a task."""
PIECES = "doc_id long, start long, length int, doc_tokens long, ids array<int>, part int, nth long"
PLACED = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long"


def combinations(counts: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths, in ascending order, that add up to ``window``; 0 stands for no piece. Only lengths that occur."""
    present = counts > 0
    present[window:] = False
    lengths = np.flatnonzero(present)
    found = []
    for a in [0, *lengths[lengths <= window // 3].tolist()]:
        b = lengths[(lengths >= max(a, 1)) & (2 * lengths <= window - a)]
        b = b[present[window - a - b]]
        found.append(np.stack([np.full(len(b), a), b, window - a - b], axis=1))
    return np.concatenate(found).astype(np.int64)


def solve(counts: np.ndarray, combos: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|, by block coordinate descent.

    Each sweep ranks combinations by what their exact step would gain and takes the best ones that share no
    length, whose steps don't touch each other. It ends when no step would change a count by half a sequence.
    """
    x = np.zeros(len(combos))
    left = counts.astype(np.float64)
    left[0] = 0
    a, b, c = combos.T
    norm = ((a > 0) + 1.0 + 1.0) + 2.0 * (((a == b) & (a > 0)).astype(float) + (b == c) + ((a == c) & (a > 0)))
    for _ in range(SWEEPS if len(combos) else 0):
        step = np.maximum((left[a] + left[b] + left[c]) / norm, -x)
        gain = step * step * norm
        gain[np.abs(step) < 0.5] = 0
        top = np.flatnonzero(gain)
        if not len(top):
            break
        if len(top) > 4096:
            top = top[np.argpartition(-gain[top], 4096)[:4096]]
        taken, chosen = set(), []
        for s in top[np.argsort(-gain[top], kind="stable")].tolist():
            row = {v for v in combos[s].tolist() if v}
            if taken.isdisjoint(row):
                taken |= row
                chosen.append(s)
        moved = step[chosen]
        x[chosen] += moved
        for column in (a, b, c):
            np.subtract.at(left, column[chosen], moved)
        left[0] = 0
    return x


class _Pools:
    """Pieces not yet placed, per length, as ranges of ranks: (length they had, first, end, start of what is left)."""

    def __init__(self, counts: np.ndarray):
        self.count = {int(n): int(counts[n]) for n in np.flatnonzero(counts) if n}
        self.ranges: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list, {n: [(n, 0, c, 0)] for n, c in self.count.items()})
        self.lengths = sorted(self.count)

    def take(self, length: int, n: int) -> list[tuple[int, int, int, int]]:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            self.lengths.remove(length)
        out, ranges = [], self.ranges[length]
        while n:
            old, first, end, start = ranges.pop()
            if end - first > n:
                ranges.append((old, first, end - n, start))
                first = end - n
            out.append((old, first, end, start))
            n -= end - first
        return out

    def put(self, length: int, pieces: list[tuple[int, int, int, int]]) -> None:
        if length not in self.count:
            self.count[length] = 0
            self.lengths.insert(bisect_right(self.lengths, length), length)
        self.count[length] += sum(end - first for _, first, end, _ in pieces)
        self.ranges[length] += pieces


def plan(counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rows (length, first rank, end rank, start, fragment's length, sequence, offset), of all pieces.

    The fragment [start, start + its length) of the piece with rank r goes to sequence + r - first rank.
    ``counts`` has the number of pieces of each length up to ``window``.
    """
    pools, rows, made = _Pools(counts), [], 0

    def lay(slots: list[tuple[int, int]], n: int) -> None:
        """n sequences of the same slots; a slot is the length of its piece and how much of it goes in."""
        nonlocal made
        offset = 0
        for length, used in slots:
            pieces, at = pools.take(length, n), made
            for old, first, end, start in pieces:
                rows.append((old, first, end, start, used, at, offset))
                at += end - first
            if used < length:
                pools.put(length - used, [(old, first, end, start + used) for old, first, end, start in pieces])
            offset += used
        made += n

    if window in pools.count:
        lay([(window, window)], pools.count[window])
    combos = combinations(counts, window)
    x = np.floor(solve(counts, combos) + 0.5).astype(np.int64)
    for s in sorted(np.flatnonzero(x).tolist(), key=lambda s: (-x[s], s)):
        row = [v for v in combos[s].tolist() if v]
        n = min(int(x[s]), *(pools.count.get(v, 0) // row.count(v) for v in row))
        if n:
            lay([(v, v) for v in row], n)
    while pools.count:
        # the longest, then what fills the room best; when all that is left is longer than the room, the shortest of it is cut
        slots, held, room = [], defaultdict(int), window
        while room:
            k = bisect_right(pools.lengths, room) - 1
            while k >= 0 and pools.count[pools.lengths[k]] == held[pools.lengths[k]]:
                k -= 1
            if k >= 0:
                v = pools.lengths[k]
                times = min(room // v, pools.count[v] - held[v]) if slots else 1
                slots += [(v, v)] * times
                held[v] += times
                room -= times * v
                continue
            v = next((v for v in pools.lengths if v > room and pools.count[v] > held[v]), None)
            if v is None:
                break
            slots.append((v, room))
            held[v] += 1
            room = 0
        lay(slots, min(pools.count[v] // n for v, n in held.items() if n))
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 7)


def _cut(tokenizer: bytes, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(tokenizer, False).encode, TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = [np.append(encode(t or ""), np.uint32(END_ID)) for t in batch.column("text").to_pylist()]
                tokens = np.array([len(x) for x in ids], dtype=np.int64)
                cuts = -(-tokens // window)
                doc = np.repeat(np.arange(len(ids)), cuts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * window
                length = np.minimum(tokens[doc] - start, window)
                order = np.argsort(length, kind="stable")
                sizes = np.bincount(length, minlength=window + 1)
                nth = np.empty(len(doc), dtype=np.int64)
                nth[order] = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + seen[length[order]]
                seen += sizes
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(length)]).astype(np.int32), np.concatenate(ids).astype(np.int32))
                columns = [batch.column("doc_id").take(pa.array(doc)), start, length.astype(np.int32), tokens[doc], lists, np.full(len(doc), part, np.int32), nth]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["doc_id", "start", "length", "doc_tokens", "ids", "part", "nth"])

    return run


def _place(rows: np.ndarray, digest: bool):
    """Fragments of each piece by its length and rank: one search per start within a piece."""
    keys = rows[:, 0] * (1 << 48) + rows[:, 1]
    # a piece has one fragment per start at most, so ranges of one start are disjoint
    by_start = [np.flatnonzero(rows[:, 3] == s) for s in sorted(set(rows[:, 3].tolist()))]

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length = batch.column("length").to_numpy().astype(np.int64)
        rank = batch.column("nth").to_numpy() + batch.column("base").to_numpy()
        wanted, hits, at = length * (1 << 48) + rank, [], []
        for chosen in by_start:
            k = np.searchsorted(keys[chosen], wanted, side="right") - 1
            row = chosen[np.maximum(k, 0)]
            ok = np.flatnonzero((k >= 0) & (rows[row, 0] == length) & (rank < rows[row, 2]))
            hits.append(row[ok])
            at.append(ok)
        row, piece = np.concatenate(hits), np.concatenate(at)
        lists, size = batch.column("ids"), rows[row, 4]
        first, values = lists.offsets.to_numpy()[piece] + rows[row, 3], lists.values.to_numpy()
        parts = [values[a : a + n] for a, n in zip(first.tolist(), size.tolist())]
        if digest:
            last = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in parts], pa.int64())
        else:
            last = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), np.concatenate(parts))
        numbers = [batch.column("start").to_numpy()[piece] + rows[row, 3], size, batch.column("doc_tokens").to_numpy()[piece], rows[row, 5] + rank[piece] - rows[row, 1], rows[row, 6]]
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32" if digest else "ids"]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(piece)), *map(pa.array, numbers), last], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PLACED_ROWS):
                yield place(batch.slice(at, PLACED_ROWS))

    return run


def pack(docs: DataFrame, tokenizer: bytes, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    With ``digest`` the last column is ids_crc32, the CRC-32 of the ids as unsigned little-endian 32-bit numbers.

    ``start`` counts the document's ids before the piece, ``doc_tokens`` all of its ids with the closing
    one. Sequences hold at most ``window`` ids without gaps; all but one are full. Null or empty text is
    the closing id alone. Repeated rows and null ids are packed each; a text of any length is cut, never
    shortened; which of several pieces of equal length goes where follows from the table as read.
    Further columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialize(texts.mapInArrow(_cut(tokenizer, window), PIECES), "pieces")
    counted = materialize(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = np.zeros(window + 1, dtype=np.int64)
    for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row per length at most
        counts[r["length"]] = r["n"]
    if counted.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    ranked = pieces.join(bases, ["part", "length"]).select("doc_id", "start", "length", "doc_tokens", "ids", "nth", "base")
    return ranked.mapInArrow(_place(plan(counts, window), digest), PLACED + (", ids_crc32 long" if digest else ", ids array<int>"))
