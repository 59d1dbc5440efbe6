"""Sums of products of many columns at once, by blocks of columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridlore.functions import exprs as X

BLOCK_COLUMNS = 128
BLOCKS_PER_SCAN = 64
"""Pairs of blocks that a task keeps sums for at once: six sums of 128 x 128 numbers each, 0.8 MB."""
CELLS = ("n", "p", "sl", "sr", "ql", "qr")
"""Per pair of columns, over rows where both have a value: rows, products, sums and squares of the left and of the right one."""


def products(df: DataFrame, columns: list[str], centres: list[float]) -> DataFrame:
    """One row per pair of columns, left before right: i, j and CELLS of the values less their column's centre.

    A task multiplies blocks of columns and keeps one sum per cell over all its rows, so what is shuffled is a
    row per task and pair, and the plan has the same size for any number of columns. Up to 1,400 columns
    take one scan. Sums of one column are shared by all its pairs; only columns with gaps in a batch are
    multiplied by the presence of others.
    """
    dtypes = X.types_of(df)
    blocks = [range(a, min(a + BLOCK_COLUMNS, len(columns))) for a in range(0, len(columns), BLOCK_COLUMNS)]
    pairs = [(a, b) for a in range(len(blocks)) for b in range(a, len(blocks))]
    out = None
    for at in range(0, len(pairs), BLOCKS_PER_SCAN):
        chosen = pairs[at : at + BLOCKS_PER_SCAN]
        used = sorted({k for pair in chosen for b in pair for k in blocks[b]})
        values = df.selectExpr(*[f"{X.double(X.quote(columns[k]), dtypes[columns[k]])} AS v{k}" for k in used])
        found = values.mapInArrow(_summed([(blocks[a], blocks[b]) for a, b in chosen], used, centres), "i int, j int, " + ", ".join(f"{c} double" for c in CELLS))
        out = found if out is None else out.union(found)
    return out.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in CELLS])


def _summed(pairs: list[tuple[range, range]], used: list[int], centres: list[float]):
    place = {k: i for i, k in enumerate(used)}
    centre = np.array([centres[k] for k in used])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(CELLS), len(a), len(b))) for a, b in pairs]
        for batch in batches:
            raw = np.stack([c.fill_null(np.nan).to_numpy(zero_copy_only=False) for c in batch.columns])
            known = ~np.isnan(raw)
            counts = known.sum(axis=1).astype(np.float64)
            x = raw - centre[:, None]
            if batch.num_rows and counts.min() < batch.num_rows:
                x[~known] = 0.0
            squares = x * x
            first, second = x.sum(axis=1), squares.sum(axis=1)
            gappy = counts < batch.num_rows
            here = known[gappy].astype(np.float64)
            at = np.cumsum(gappy) - 1  # the row of ``here`` that a column with gaps has
            for total, (left, right) in zip(sums, pairs):
                a, b = slice(place[left[0]], place[left[-1]] + 1), slice(place[right[0]], place[right[-1]] + 1)
                ga, gb = np.flatnonzero(gappy[a]), np.flatnonzero(gappy[b])
                ha, hb = here[at[a][ga]], here[at[b][gb]]
                n = np.minimum(counts[a, None], counts[None, b])  # one of the two has all rows, but where both have gaps
                n[np.ix_(ga, gb)] = ha @ hb.T
                total[0] += n
                total[1] += x[a] @ x[b].T
                # sums of one side over the rows where the other has a value: all rows, but where that has gaps
                for k, values, own in ((2, x, first), (4, squares, second)):
                    lefts = np.repeat(own[a, None], len(right), axis=1)
                    lefts[:, gb] = values[a] @ hb.T
                    total[k] += lefts
                    rights = np.repeat(own[None, b], len(left), axis=0)
                    rights[ga] = ha @ values[b].T
                    total[k + 1] += rights
        for total, (left, right) in zip(sums, pairs):
            i, j = (g.ravel() for g in np.meshgrid(np.array(left), np.array(right), indexing="ij"))
            upper = i < j
            cells = [c.ravel()[upper] for c in total]
            yield pa.RecordBatch.from_arrays([pa.array(i[upper].astype(np.int32)), pa.array(j[upper].astype(np.int32)), *map(pa.array, cells)], names=["i", "j", *CELLS])

    return run
