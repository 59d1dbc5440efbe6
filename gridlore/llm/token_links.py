"""Alignment of two tokenizers' tokens over the same bytes, many documents at a time.

One NumPy state vector holds a pointer into A's and one into B's tokens for every lane. Each step
emits the link between the two tokens pointed at, emits a cut where both end at the same byte, and
advances whichever ends first (both at a cut); finished lanes are dropped from the vector. A lane
is a document, or LANE of A's tokens of a longer one, so that a step count follows the lane, not the
longest document: links are dealt by their A token, so lanes share none.

Corpus-wide counts of linked pairs are joined in Spark: a block of documents asks once for each
distinct pair that it holds, and gets the counts back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gridlore.llm.byte_bpe import encoder
from gridlore.llm.textkit import slices
from gridlore.session import materialize

LANE = 512
BLOCK_BYTES = 2 << 20
"""Text of a block; a longer text is a block of its own."""
BLOCK = (
    "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "held array<int>, local array<int>, times array<int>, pair array<long>, holders array<int>"
)
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@lru_cache(maxsize=2)
def _pieces(data: bytes) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """A piece model, and the bytes of each of its pieces."""
    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    table = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        table.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return model, table


def merge(ends_a: np.ndarray, ends_b: np.ndarray, first: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (A token, B token) in order, and the tokens at which cuts are, (A token, B token).

    Tokens of all documents lie end to end, with their end bytes; ``first`` has each document's first A token and
    the number of A tokens at the end. Both sides of each document end at the same byte.
    """
    n = np.diff(first)
    lanes = -(-n // lane)
    doc = np.repeat(np.arange(len(n)), lanes)
    i = first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * lane
    stop = np.minimum(i + lane, first[doc + 1])
    start = np.concatenate([[0], ends_a])[i]
    j = np.searchsorted(ends_b, start, side="right")
    who = np.arange(len(i))
    steps = []
    lengths = np.zeros(len(i), dtype=np.int64)
    while len(i):
        a, b = ends_a[i], ends_b[j]
        steps.append((who, i, j, a == b))
        lengths[who] += 1
        i, j = i + (a <= b), j + (b <= a)
        alive = i < stop
        if not alive.all():
            i, j, stop, who = i[alive], j[alive], stop[alive], who[alive]
    base = np.cumsum(lengths) - lengths
    link_a, link_b, cut = np.empty(lengths.sum(), np.int64), np.empty(lengths.sum(), np.int64), np.empty(lengths.sum(), bool)
    for k, (who, i, j, both) in enumerate(steps):
        at = base[who] + k
        link_a[at], link_b[at], cut[at] = i, j, both
    return link_a, link_b, link_a[cut], link_b[cut]


@lru_cache(maxsize=1)
def _decimals(size: int) -> np.ndarray:
    """Each number below ``size`` in decimal, left-justified, with a zero byte at least after it."""
    width = len(str(size)) + 1
    return np.array([str(i).encode() for i in range(size)], dtype=f"S{width}").view(np.uint8).reshape(size, width)


def _digits(ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id in decimal with the mark after it, as bytes end to end, and where each starts."""
    table = _decimals(1 << max(int(ids.max()), 1).bit_length())
    cells = table[ids]
    used = np.count_nonzero(table, axis=1)[ids]
    cells[np.arange(len(ids)), used] = marks
    return cells[cells != 0], np.concatenate([[0], np.cumsum(used + 1)])


def _spell(a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray, last: np.ndarray) -> list[bytes]:
    """Groups of each document as ``a1,a2|b1;a3|b2,b3``; ``last`` are the numbers of the documents' last groups."""
    size_a, size_b = np.diff(cuts_a, prepend=-1), np.diff(cuts_b, prepend=-1)
    at_a = np.arange(len(a)) + np.repeat(cuts_b + 1 - size_b, size_a)
    at_b = np.arange(len(b)) + np.repeat(cuts_a + 1, size_b)
    ids, marks = np.empty(len(a) + len(b), dtype=np.int64), np.full(len(a) + len(b), ord(","), dtype=np.uint8)
    ids[at_a], ids[at_b] = a, b
    marks[at_a[cuts_a]] = ord("|")
    marks[at_b[cuts_b]] = ord(";")
    text, starts = _digits(ids, marks)
    ends = starts[at_b[cuts_b[last]] + 1].tolist()
    raw = text.tobytes()
    return [raw[x : y - 1] for x, y in zip([0, *ends], ends)]


def align(a_ids: list[np.ndarray], b_ids: list[np.ndarray], a_sizes: np.ndarray, b_sizes: np.ndarray) -> dict[str, np.ndarray | list[bytes]]:
    """Links and groups of documents whose tokens, A's and B's, spell the same bytes; each has at least one."""
    a, b = np.concatenate(a_ids).astype(np.int64), np.concatenate(b_ids).astype(np.int64)
    first = np.concatenate([[0], np.cumsum([len(x) for x in a_ids])])
    link_a, link_b, cuts_a, cuts_b = merge(np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b]), first)
    groups = np.searchsorted(cuts_a, first[1:] - 1) + 1
    doc = np.repeat(np.arange(len(a_ids)), np.diff(first))[link_a]
    return {
        "doc": doc, "a": a[link_a], "b": b[link_b], "n_links": np.bincount(doc, minlength=len(a_ids)), "n_groups": np.diff(groups, prepend=0),
        "groups": _spell(a, b, cuts_a, cuts_b, groups - 1), "link_a": link_a - first[doc], "link_b": link_b,
    }


def _blocks(bpe: bytes, model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, table_a = encoder(bpe, True).encode, encoder(bpe, True).table
        pieces, table_b = _pieces(model)
        a_sizes, b_sizes = (np.array([len(x) for x in table], dtype=np.int64) for table in (table_a, table_b))
        block = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in slices(whole, "text", BLOCK_BYTES):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                n = len(texts)
                n_a, n_b, n_groups, n_links = (np.zeros(n, np.int64) for _ in range(4))
                sha, known, a_ids, b_ids = [""] * n, [], [], []
                for k, (text, b) in enumerate(zip(texts, pieces.encode(texts, num_threads=1))):
                    if not text:
                        continue
                    a, b, raw = encode(" " + text), np.array(b, dtype=np.int64), b" " + text.encode()
                    if b"".join([table_a[i] for i in a.tolist()]) == raw and b"".join([table_b[i] for i in b.tolist()]) == raw:
                        known.append(k)
                        a_ids.append(a)
                        b_ids.append(b)
                held, none = np.zeros(n, np.int64), np.zeros(0, np.int64)
                pair = holders = local = times = none
                if known:
                    found = align(a_ids, b_ids, a_sizes, b_sizes)
                    n_a[known], n_b[known] = [len(x) for x in a_ids], [len(x) for x in b_ids]
                    n_links[known], n_groups[known] = found["n_links"], found["n_groups"]
                    for k, groups in zip(known, found["groups"]):
                        sha[k] = hashlib.sha256(groups).hexdigest()
                    pairs = len(a_sizes) * len(b_sizes)
                    # once per document and pair, with the number of its links
                    entry, times = np.unique(found["doc"] * pairs + found["a"] * len(b_sizes) + found["b"], return_counts=True)
                    pair = np.unique(entry % pairs)
                    local = np.searchsorted(pair, entry % pairs)
                    holders = np.bincount(local, minlength=len(pair))
                    held[known] = np.bincount(entry // pairs, minlength=len(known))
                one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
                longs, ints = pa.int64(), pa.int32()
                ids = batch.column("doc_id")
                columns = [
                    pa.array([block], longs), pa.ListArray.from_arrays(pa.array([0, n], ints), ids if ids.offset == 0 else pa.concat_arrays([ids])), *(one(x, longs) for x in (n_a, n_b, n_groups, n_links)),
                    one(sha, pa.string()), one(held, ints), one(local, ints), one(times, ints), one(pair, longs), one(holders, ints),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held", "local", "times", "pair", "holders"])
                block += 1

    return run


def _score(block: pa.Table, answers: pa.Table) -> pa.Table:
    """Documents of one block with the counts of its pairs."""
    row = block.slice(0, 1)
    flat = lambda c: row.column(c).combine_chunks().flatten()
    held, local, times = (flat(c).to_numpy() for c in ("held", "local", "times"))
    size = len(flat("pair"))
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    at = answers.column("at").to_numpy()
    count[at] = answers.column("count").to_numpy()
    best[at] = answers.column("best").to_numpy().astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(held)])
    sums = [np.concatenate([[0], np.cumsum(x[local] * times, dtype=np.int64)]) for x in (best, count)]
    n_best, count_sum = (s[ends[1:]] - s[ends[:-1]] for s in sums)
    columns = [*(flat(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(n_best), pa.array(count_sum), flat("groups_sha256")]
    return pa.Table.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def link_counts(blocks: DataFrame, width: int) -> DataFrame:
    """(pair, count, best): in how many documents each pair is linked, and whether none of its A id's pairs is in more."""
    entries = blocks.select(F.explode(F.arrays_zip("pair", "holders")).alias("e")).select("e.pair", F.col("e.holders").cast("long").alias("n"))
    counts = materialize(entries.groupBy("pair").agg(F.sum("n").alias("count")), "link-counts")
    a = F.expr(f"pair div {width}").alias("a")
    most = counts.groupBy(a).agg(F.max("count").alias("most"))  # one row per id of A's vocabulary at most
    return counts.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_tokenizers(docs: DataFrame, bpe: bytes, model: bytes) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level BPE file on a space and the text, B a piece model on the text. Null or empty text, and
    text that either side doesn't spell back byte by byte, has zeros and an empty digest. Repeated rows
    count each, as do null ids; texts of any length are aligned whole; further columns are ignored; an
    empty table gives an empty result. ``n_best`` are links whose pair is in as many documents as
    any pair of the same A id, ties included.
    """
    width = len(_pieces(model)[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = materialize(texts.mapInArrow(_blocks(bpe, model), BLOCK), "link-blocks")
    asked = blocks.select(F.col("block").alias("asker"), F.posexplode("pair").alias("at", "pair"))
    answers = asked.join(link_counts(blocks, width), "pair").select("asker", "at", "count", "best")
    kept = blocks.drop("holders")
    return kept.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(_score, ALIGNED)
