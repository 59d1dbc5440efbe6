"""Approximate nearest neighbours by largest inner product: probed lists with an adaptive dimension scan.

Vectors get one more component, so that inner products rank like distances, and a random rotation.
Each list stores rotated vectors in column blocks. A query walks the blocks of a probed list; after
each, a hypothesis test on the partial distances drops the candidates that are unlikely to be among its
nearest. What is left is scored exactly, in double precision on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridlore.session import materialize

FIT_ROWS = 20_000
"""Rows, of smallest hash, that the lists' centres are fitted on; every row is indexed."""
ROWS_PER_LIST = 160
MAX_LISTS = 64
"""Bound of the lists, and so of the partial answers that a query gathers."""
PROBED_SHARE = 0.65
LEAST_PROBED = 12
BLOCK_DIMENSIONS = 16
SIGNIFICANCE = 2.1
"""How far, in units of 1 / sqrt(scanned dimensions), a partial distance must be off to drop a candidate."""
ROUNDING = 1e-5
"""Share of the squared norms by which a distance may be off in single precision; smaller differences drop nothing."""
SPARSE = 0.1
"""Share of candidates left below which they are picked one by one."""
QUERY_ROWS = 256
"""Queries scanned together."""
CHUNK_ROWS = 8_192
"""Vectors of a list held by one task; larger lists are cut, and queries visit every part."""


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def rotation(dimensions: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def fit_centres(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """K-means over a bounded sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), size=min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest_centres(sample, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        count = np.bincount(near, minlength=len(centres))
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def _nearest_centres(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), dtype=np.int32)
    square = (centres**2).sum(axis=1)
    for a in range(0, len(x), 1024):
        d = square - 2 * x[a : a + 1024] @ centres.T
        out[a : a + 1024] = np.argsort(d, axis=1, kind="stable")[:, :k] if k > 1 else d.argmin(axis=1)[:, None]
    return out


def scan_list(queries: np.ndarray, blocks: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) of one list in which the row may be among the query's ``k`` nearest.

    ``blocks`` holds the rows' rotated components, some columns each. A query's k nearest by the
    first block are measured in full; their worst distance is the bar that partial distances are
    tested against, block by block. They are never dropped themselves, and no test is finer than rounding.
    """
    total, at, n = sum(b.shape[1] for b in blocks), blocks[0].shape[1], len(blocks[0])
    if n <= k:
        return np.repeat(np.arange(len(queries)), n), np.tile(np.arange(n), len(queries))
    head = queries[:, :at]
    partial = (blocks[0] ** 2).sum(axis=1) - 2 * head @ blocks[0].T + (head**2).sum(axis=1)[:, None]
    first = np.argpartition(partial, k - 1, axis=1)[:, :k]
    bar, start = np.take_along_axis(partial, first, axis=1), at
    for b in blocks[1:]:
        bar = bar + ((b[first] - queries[:, None, start : start + b.shape[1]]) ** 2).sum(axis=2)
        start += b.shape[1]
    bar = bar.max(axis=1)
    sure = np.zeros(partial.shape, dtype=bool)
    np.put_along_axis(sure, first, True, axis=1)
    noise = ROUNDING * ((queries**2).sum(axis=1) + sum((b**2).sum(axis=1) for b in blocks).max())
    likely = lambda x, limit, e: (x - e) * (total / at) <= limit * (1 + SIGNIFICANCE / np.sqrt(at)) ** 2
    final = bar * (1 + 1e-4) + noise
    rest = blocks[1:]
    while rest:
        keep = likely(partial, bar[:, None], noise[:, None]) | sure
        if keep.mean() < SPARSE:
            break
        # while most candidates are left, a product of whole blocks is cheaper than picking rows
        partial[~keep] = np.inf
        b, own = rest[0], queries[:, at : at + rest[0].shape[1]]
        partial += (b**2).sum(axis=1) - 2 * own @ b.T + (own**2).sum(axis=1)[:, None]
        at, rest = at + b.shape[1], rest[1:]
    query, row = np.nonzero(keep if rest else (partial <= final[:, None]) | sure)
    partial = partial[query, row]
    for b in rest:
        partial = partial + ((b[row] - queries[query, at : at + b.shape[1]]) ** 2).sum(axis=1)
        at += b.shape[1]
        keep = likely(partial, bar[query], noise[query]) if at < total else partial <= final[query]
        keep |= sure[query, row]
        query, row, partial = query[keep], row[keep], partial[keep]
    return query, row


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score.

    Its ``k`` nearest other rows by inner product, nearest first, ties to the smaller vec_id. Vectors
    that are null, zero, of another length than the first row's majority, or hold null or non-finite
    components take no part. Rows with equal vectors are searched once: at most ``k + 1`` of them, of
    smallest vec_id, can be in an answer, and queries with equal vectors share their search. A repeated row counts once. An id with
    several vectors has an answer for each, in which its rows don't appear and leave as many places empty as there are further ones. Other columns are ignored; fewer candidates give shorter answers, an empty table an empty one.
    """
    spark = vectors.sparkSession
    value = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("v")).where("v is not null and vec_id is not null and size(v) > 0")
    good = good.where(finite & F.exists("v", lambda x: x != 0)).withColumn("d", F.size("v"))
    # -0.0 and 0.0 are one value; the key is compared in full
    good = good.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).dropDuplicates(["vec_id", "v"])
    by_length = good.groupBy("d").count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not by_length:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, rows = by_length[0]["d"], by_length[0]["count"]
    good = good.where(F.col("d") == d).drop("d")
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = materialize(good.withColumn("place", place).where(F.col("place") <= k + 1), "candidates")
    queries = good.where(F.col("vec_id") % every == 0)
    longest = few.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    lists = int(min(max(rows // ROWS_PER_LIST, 1), MAX_LISTS))
    probed = min(lists, max(LEAST_PROBED, round(PROBED_SHARE * lists)))
    sample = few.where("place = 1").select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).toArrow()
    turn = rotation(d + 1)

    def placed(x: np.ndarray, query: bool = False) -> np.ndarray:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest - (x**2).sum(axis=1), 0))
        return np.column_stack([x, rest]) @ turn

    centres = fit_centres(placed(_matrix(sample.column("v"))), lists)
    held = spark.sparkContext.broadcast(centres)

    def to_lists(query: bool, count: int):
        schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("list", pa.int32())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 2048):
                    part = batch.slice(a, 2048)
                    near = _nearest_centres(placed(_matrix(part.column("v")), query), held.value, count)
                    at = pa.array(np.repeat(np.arange(part.num_rows), count))
                    yield pa.RecordBatch.from_arrays([part.column("vec_id").take(at), part.column("v").take(at), pa.array(near.reshape(-1))], schema=schema)

        return run

    form = "vec_id long, v array<double>, list int"
    indexed = materialize(few.select("vec_id", "v").mapInArrow(to_lists(False, 1), form), "index")
    # searches have numbers of their own, since several ids may share a vector and one id may have several
    one = materialize(queries.select("v").distinct().withColumn("vec_id", F.monotonically_increasing_id()), "searches")
    asked = materialize(one.select("vec_id", "v").mapInArrow(to_lists(True, probed), form), "asked")
    cut = lambda df, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias(name))
    parts = materialize(cut(indexed, "parts").join(cut(asked, "turns"), "list"), "lists")  # one row per list, MAX_LISTS at most
    # every part of a list meets every part of its queries
    own = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = indexed.join(F.broadcast(parts), "list").select("list", own("parts").alias("part"), every_one("turns").alias("turn"), "vec_id", "v")
    asked = asked.join(F.broadcast(parts), "list").select("list", every_one("parts").alias("part"), own("turns").alias("turn"), "vec_id", "v")

    def search(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asking):
            return pd.DataFrame({"asked": [], "vec_id": [], "score": []})
        own = own.sort_values("vec_id", ignore_index=True)
        x, ids, q = np.stack(own["v"].to_numpy()), own["vec_id"].to_numpy(), np.stack(asking["v"].to_numpy())
        rotated = placed(x).astype(np.float32)  # the scan only selects; scores are exact
        blocks = [np.ascontiguousarray(rotated[:, a : a + BLOCK_DIMENSIONS]) for a in range(0, d + 1, BLOCK_DIMENSIONS)]
        asked_ids, out = asking["vec_id"].to_numpy(), []
        for at in range(0, len(q), QUERY_ROWS):
            query, row = scan_list(placed(q[at : at + QUERY_ROWS], True).astype(np.float32), blocks, k + 1)
            score = (x[row] * q[at + query]).sum(axis=1)
            order = np.lexsort((ids[row], -score, query))
            query, row, score = query[order], row[order], score[order]
            keep = np.arange(len(query)) - np.searchsorted(query, query) <= k
            out.append((asked_ids[at + query[keep]], ids[row[keep]], score[keep]))
        return pd.DataFrame({name: np.concatenate(column) for name, column in zip(("asked", "vec_id", "score"), zip(*out))})

    place = ("list", "part", "turn")
    found = stored.groupBy(*place).cogroup(asked.groupBy(*place)).applyInPandas(search, "asked long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("place", best).where(F.col("place") <= k + 1)
    members = queries.join(one.select("v", F.col("vec_id").alias("asked")), "v").select(F.col("vec_id").alias("query_id"), "asked")
    out = members.join(found, "asked").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
