"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces of at most the largest length. Pieces go, largest first, into the
open bin that they fill best; a new bin takes the length of least cost per token it can expect to
hold; at the end each bin shrinks to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridlore.session import materialize

CAPACITIES = (512, 1024, 2048, 4096)
SHARD_ROWS = 20_000
"""Pieces packed together. More shards than needed cost one partly filled bin each."""
OVERHEAD = 64.0
"""Fixed cost of a sequence, in tokens; it speaks for long sequences."""
QUADRATIC = 1 / 32_768
"""Cost of attention: a sequence of length c costs OVERHEAD + c + QUADRATIC * c * c; it speaks for short ones."""
PIECES = "doc_id long, piece int, start long, n_tokens int"
PLACED = "doc_id long, piece int, start long, n_tokens int, bin_id long, capacity int, position int"


def sequence_cost(capacity: int) -> float:
    return OVERHEAD + capacity + QUADRATIC * capacity * capacity


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Bin and position of each length (given largest first), and the final capacity of each bin."""
    costs = [(c, sequence_cost(c)) for c in sorted(capacities)]
    left = sum(lengths)
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set while a bin with room r is open
    bins, places, used, size = [], [], [], []
    for n in lengths:
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            b, capacity = len(used), min((x for x in costs if x[0] >= n), key=lambda x: (x[1] / min(x[0], left), x[0]))[0]
            used.append(0)
            size.append(capacity)
            room = capacity
        bins.append(b)
        places.append(used[b])
        used[b] += n
        left -= n
        room -= n
        if room:
            by_room.setdefault(room, []).append(b)
            rooms |= 1 << room
    return bins, places, [next(c for c, _ in costs if c >= u) for u in used]


def _packer(capacities: tuple[int, ...]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable")
        bins, places, sizes = pack(rows["n_tokens"].tolist(), capacities)
        return rows.drop(columns="shard").assign(
            bin_id=[(int(s) << 32) + b for s, b in zip(rows["shard"], bins)], capacity=[sizes[b] for b in bins], position=places
        )

    return run


def word_count(text: str | Column = "text") -> Column:
    """Words of a text, the default measure of length; null text has none."""
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def best_fit(docs: DataFrame, length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bin_id, capacity, position.

    ``start`` is the piece's first token in the document, ``position`` its place in the bin. A
    document longer than the largest capacity becomes several pieces, in order and without gaps; one
    without tokens, or with null text, keeps one row with zero tokens and no bin. Repeated rows are
    packed each; ties are broken by doc_id, piece. Further columns are ignored; an empty table gives
    an empty result. Lengths, not texts, are shuffled, in shards of bounded size whatever the keys; which
    rows share a shard follows from their place in the table as read.
    """
    top = max(capacities)
    n = F.col("n")
    pieces = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), (length if length is not None else word_count()).cast("long").alias("n"))
        .withColumn("n", F.coalesce(n, F.lit(0)))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / top), F.lit(0)).cast("int"))))
        .select("doc_id", "piece", (F.col("piece").cast("long") * top).alias("start"), F.least(n - F.col("piece").cast("long") * top, F.lit(top)).cast("int").alias("n_tokens"))
    )
    # written with its place, which no later run of a task can change
    pieces = materialize(pieces.withColumn("place", F.monotonically_increasing_id()), "pieces")
    full = pieces.where("n_tokens > 0")
    shards = max(1, -(-full.count() // SHARD_ROWS))
    # a fixed function of the row's place, so that repeated and null keys are spread and a lost task repeats its work
    dealt = full.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards))).drop("place")
    packed = dealt.groupBy("shard").applyInPandas(_packer(tuple(capacities)), PLACED)
    bare = pieces.where("n_tokens = 0").drop("place").select("*", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("capacity"), F.lit(None).cast("int").alias("position"))
    return packed.union(bare)


def sequences(docs: DataFrame, placed: DataFrame, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """The packed sequences themselves: bin_id, capacity, doc_ids, words, one row per bin.

    ``placed`` comes from ``best_fit`` with its default lengths; each bin holds at most its capacity.
    """
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    pieces = placed.where("bin_id is not null").join(docs.select("doc_id", words.alias("w")), "doc_id")
    pieces = pieces.select("bin_id", "capacity", "position", "doc_id", F.slice("w", F.col("start").cast("int") + 1, F.col("n_tokens")).alias("w"))
    rows = F.array_sort(F.collect_list(F.struct("position", "doc_id", "w")))
    return pieces.groupBy("bin_id", "capacity").agg(rows.alias("r")).select("bin_id", "capacity", F.col("r.doc_id").alias("doc_ids"), F.flatten("r.w").alias("words"))
