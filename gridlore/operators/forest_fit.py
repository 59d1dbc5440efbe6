"""Random forests grown level by level from sums per node, column and bin.

Rows are kept as one bin number per column: numbers in up to BINS ranges, a text column by its level, so a row
adds to one cell per column however many slots the column's levels have. A pass over the rows grows one
level of all trees: tasks walk their rows through the trees so far and add up the open nodes' cells, whose sums are
shuffled by blocks of nodes, and each block's task picks its nodes' splits. A task holds sums of at most PASS_BYTES;
nodes beyond that take further passes. There are no more tasks than cores, so sums don't grow with the rows. Where there
are far fewer combinations of bins than rows, rows of equal bins are summed per tree first, and passes read these sums.
What reaches the driver is a row per node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlore.operators.forest import Forest, nodes_of
from gridlore.session import materialize

BINS = 32
CHUNK_ROWS = 1 << 18
SLICE_ROWS = 1 << 14
TASK_ROWS = 1 << 15
PASS_BYTES = 1 << 28
BLOCK_BYTES = 1 << 20
STEP_BINS = 64
"""Columns of at most that many bins are walked by a table of a node's following node per bin."""
MERGED_ROWS = 4
"""Rows there have to be per combination of bins, and class, for sums of equal rows to be worth their width."""
LEAST_GAIN = 1e-12
"""A split has to gain this share of what its node has; less is rounding."""


def fit(rows: DataFrame, numbers: list[str], places: list[tuple[str, int]], trees: int, depth: int, seed: int, classes: int = 0, subset: int | None = None) -> Forest:
    """A forest of ``rows`` (_label, _weight, ``numbers``, ``places``) of bootstrap samples.

    ``places`` are columns of level numbers and their level counts; a number of that count or more is no level. Slots are the
    numbers, then each column's levels. ``classes`` 0 is a regression, else labels are class numbers. ``subset``
    slots, drawn per node, are looked at; without it all.
    """
    cuts = _cuts(rows, numbers)
    sizes = [*[len(c) + 1 for c in cuts], *[n + 1 for _, n in places]]
    centre = 0.0 if classes else rows.agg(F.avg("_label")).first()[0]
    count, combined = rows.count(), max(classes, 1)
    for n in [*[len(c) + 1 for c in cuts], *[n for _, n in places]]:
        combined *= max(n, 1)
    merged = combined * MERGED_ROWS <= count
    binned = _binned(rows, count, numbers, [p for p, _ in places], cuts, sizes, trees, seed, classes, centre, merged)
    shape = _Shape(len(cuts), sizes, classes, centre, subset, seed)
    grown = _Grown(trees)
    opened, total = list(range(trees)), {}  # total: sums by node
    for level in range(depth):
        found = {}
        step = max(1, PASS_BYTES // (8 * shape.cells * shape.sums))
        for at in range(0, len(opened), step):
            found |= _pass(binned, merged, grown, shape, opened[at : at + step], level)
        opened = grown.split(found, level, cuts, shape, total)
    return Forest(nodes_of(grown.rows(total, shape)), shape.slots, classes)


class _Shape:
    """Cells and slots of the columns."""

    def __init__(self, numbers: int, sizes: list[int], classes: int, centre: float, subset: int | None, seed: int):
        self.numbers, self.sizes, self.classes, self.centre, self.seed = numbers, sizes, classes, centre, seed
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        self.cells, self.sums = int(self.starts[-1]), classes or 3
        # a number is one slot, a level another; the last bin of a text column is no level
        self.first = np.concatenate([[0], np.cumsum([1 if j < numbers else n - 1 for j, n in enumerate(sizes)])]).astype(int)
        self.slots = int(self.first[-1])
        self.subset = subset if subset and subset < self.slots else None

    def weight(self, s: np.ndarray) -> np.ndarray:
        return s.sum(axis=-1) if self.classes else s[..., 0]

    def power(self, s: np.ndarray) -> np.ndarray:
        """Weight times what is explained by a mean, or by class shares."""
        w = self.weight(s)
        top = (s * s).sum(axis=-1) if self.classes else s[..., 1] ** 2
        return np.divide(top, w, out=np.zeros_like(top), where=w > 0)

    def best(self, sums: np.ndarray, names: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
        """Per node of ``sums`` (node, cell, sum): gain, column, bin, and the sums of all, left and right rows."""
        n = len(sums)
        whole = sums[:, self.starts[0] : self.starts[1]].sum(axis=1)
        gain, column, at = np.zeros(n), np.full(n, -1), np.zeros(n, int)
        left = np.zeros_like(whole)
        allowed = None
        if self.subset:
            allowed = np.zeros((n, self.slots), bool)
            for i, (tree, node) in enumerate(names):
                allowed[i, np.random.default_rng([self.seed, tree, node]).choice(self.slots, self.subset, replace=False)] = True
        base = self.power(whole)
        floor = LEAST_GAIN * np.maximum(base, 0)
        for j, size in enumerate(self.sizes):
            if size < 2:
                continue
            cell = sums[:, self.starts[j] : self.starts[j + 1]]
            if j < self.numbers:
                near = np.cumsum(cell, axis=1)[:, :-1]
            else:
                near = whole[:, None] - cell[:, :-1]  # a level goes right, the others left
            far = whole[:, None] - near
            # weights are sums of whole counts times class weights, so what rounding leaves of nothing is far below one row
            valid = (self.weight(near) > LEAST_GAIN * self.weight(whole)[:, None]) & (self.weight(far) > LEAST_GAIN * self.weight(whole)[:, None])
            score = np.where(valid, self.power(near) + self.power(far) - base[:, None], 0.0)
            if allowed is not None:
                span = allowed[:, self.first[j] : self.first[j + 1]]
                score = np.where(span, score, 0.0)
            k = score.argmax(axis=1)
            here = score[np.arange(n), k]
            better = (here > gain) & (here > floor)
            gain[better], column[better], at[better] = here[better], j, k[better]
            left[better] = near[better, k[better]]
        w = self.weight(whole)
        return np.divide(gain, w, out=np.zeros(n), where=w > 0), column, at, whole, left, whole - left


class _Grown:
    """The trees so far: nodes of all trees in one list, roots first; right are bins in (low, high]."""

    def __init__(self, trees: int):
        self.trees = trees
        self.tree, self.node, self.level = list(range(trees)), [0] * trees, [0] * trees
        self.column, self.low, self.high, self.children, self.said = [0] * trees, [0] * trees, [0] * trees, [], [None] * trees
        for i in range(trees):
            self.children += [i, i]
        self.count = [1] * trees

    def split(self, found: dict, level: int, cuts: list[np.ndarray], shape: _Shape, total: dict) -> list[int]:
        """Splits nodes by what was found; their children are open next."""
        opened = []
        for i, (gain, column, at, whole, left, right) in sorted(found.items()):
            total[i] = whole
            if column < 0:
                continue
            number = column < shape.numbers
            self.column[i], self.low[i], self.high[i] = column, at if number else at - 1, 1 << 30 if number else at
            slot = int(shape.first[column]) + (0 if number else at)
            kids = []
            for s in (left, right):
                k, t = len(self.tree), self.tree[i]
                self.tree.append(t), self.node.append(self.count[t]), self.level.append(level + 1), self.said.append(None)
                self.column.append(0), self.low.append(0), self.high.append(0), self.children.extend([k, k])
                self.count[t] += 1
                total[k] = s
                kids.append(k)
            self.children[2 * i], self.children[2 * i + 1] = kids[1], kids[0]  # by whether a row goes left
            self.said[i] = (slot, float(cuts[column][at]) if number else 0.5, gain, self.node[kids[0]], self.node[kids[1]])
            opened += kids
        return opened

    def rows(self, total: dict, shape: _Shape) -> list[tuple]:
        """Rows of the node table."""
        out = []
        for i, said in enumerate(self.said):
            slot, cut, gain, left, right = said or (None,) * 5
            s = np.asarray(total[i], float)
            if shape.classes:
                weight, prediction = float(s.sum()), float(s.argmax())
            else:
                weight, c = float(s[0]), shape.centre
                prediction = c + s[1] / s[0] if s[0] else c
                s = np.array([s[0], s[1] + c * s[0], s[2] + 2 * c * s[1] + c * c * s[0]])
            out.append((self.tree[i], self.node[i], self.level[i], slot, cut, None, left, right, gain, weight, float(prediction), s.tolist()))
        return out

    def walk(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(a, np.int32) for a in (self.column, self.low, self.high, self.children))


def _cuts(rows: DataFrame, numbers: list[str]) -> list[np.ndarray]:
    """Upper ends of all but the last range of each number: quantiles of all rows, in one scan."""
    if not numbers:
        return []
    shares = F.array(*[F.lit(i / BINS) for i in range(BINS)])
    found = rows.agg(*[F.percentile_approx(n, shares).alias(n) for n in numbers], *[F.max(n).alias(f"{n}_top") for n in numbers]).first()
    return [np.array([v for v in sorted(set(found[n] or [])) if v < found[f"{n}_top"]]) for n in numbers]


def _binned(
    rows: DataFrame, count: int, numbers: list[str], places: list[str], cuts: list[np.ndarray], sizes: list[int], trees: int, seed: int, classes: int, centre: float, merged: bool
) -> DataFrame:
    """(b0.., y, w, bag): bins, label, weight and one count per tree, written once; ``merged`` (b0.., bag), sums per tree of equal rows."""
    names = [f"b{j}" for j in range(len(sizes))]
    kinds = ", ".join(f"{n} int" for n in names)

    def bins_of(batch: pa.RecordBatch) -> list[pa.Array]:
        bins = [np.searchsorted(c, batch.column(n).to_numpy(zero_copy_only=False)) for n, c in zip(numbers, cuts)]
        bins += [np.minimum(batch.column(p).to_numpy(zero_copy_only=False), n - 1) for p, n in zip(places, sizes[len(cuts) :])]
        return [pa.array(b.astype(np.int32)) for b in bins]

    def packed(values: np.ndarray) -> pa.Array:
        width = values.itemsize * int(np.prod(values.shape[1:]))
        return pa.Array.from_buffers(pa.binary(width), len(values), [None, pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())

    def drawn(rng: np.random.Generator, n: int) -> np.ndarray:
        return np.minimum(rng.poisson(1.0, (n, trees)), 255).astype(np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*bins_of(batch), batch.column("_label"), batch.column("_weight"), packed(drawn(rng, batch.num_rows))], names=[*names, "y", "w", "bag"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*bins_of(batch), batch.column("_label"), batch.column("_weight"), pa.array(np.arange(batch.num_rows, dtype=np.int32))], names=[*names, "y", "w", "at"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for t in _chunks(batches, CHUNK_ROWS // 8):
            bins = np.column_stack([t.column(n).to_numpy() for n in names])
            first = np.flatnonzero(np.concatenate([[True], (bins[1:] != bins[:-1]).any(axis=1)]))
            y, weight = t.column("y").to_numpy(), drawn(rng, len(bins)) * t.column("w").to_numpy()[:, None]
            parts = [weight * (y == k)[:, None] for k in range(classes)] if classes else [weight * ((y - centre) ** k)[:, None] for k in range(3)]
            sums = np.stack([np.add.reduceat(p, first, axis=0) for p in parts], axis=1)
            yield pa.RecordBatch.from_arrays([*[pa.array(b) for b in np.ascontiguousarray(bins[first].T)], packed(sums)], names=[*names, "bag"])

    # every task sends sums of its own, so there are no more than cores
    parts = _tasks(rows.sparkSession, count)
    chosen = rows.select("_label", "_weight", *numbers, *places)
    if merged:
        # frequent combinations are cut between tasks by ``at``
        even = chosen.mapInArrow(spread, f"{kinds}, y double, w double, at int").repartitionByRange(parts, *names, "at")
        return materialize(even.sortWithinPartitions(*names, "y", "w").mapInArrow(merge, f"{kinds}, bag binary"), "bins").coalesce(parts)
    return materialize(chosen.repartition(parts).mapInArrow(run, f"{kinds}, y double, w double, bag binary"), "bins").coalesce(parts)


def _tasks(spark: SparkSession, rows: int) -> int:
    return min(spark.sparkContext.defaultParallelism, 1 + rows // TASK_ROWS)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= size:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


class _Steps:
    """The nodes of one tree, numbered from its root, for rows to walk."""

    def __init__(self, nodes: np.ndarray, column: np.ndarray, low: np.ndarray, high: np.ndarray, children: np.ndarray, widest: int):
        self.column = column[nodes].astype(np.int64)
        kids = np.searchsorted(nodes, children.reshape(-1, 2)[nodes])
        self.low, self.high, self.children, self.widest = low[nodes], high[nodes], kids.ravel(), widest
        self.following = None
        if widest <= STEP_BINS:
            bins = np.arange(widest)
            left = (bins <= self.low[:, None]) | (bins > self.high[:, None])
            self.following = np.where(left, kids[:, 1:], kids[:, :1]).ravel()

    def walk(self, flat: np.ndarray, first: np.ndarray, level: int) -> np.ndarray:
        """The nodes that rows, which begin at ``first`` of ``flat``, reach after ``level`` steps."""
        at = np.zeros(len(first), np.int64)
        for _ in range(level):
            seen = flat[first + self.column[at]]
            if self.following is not None:
                at = self.following[at * self.widest + seen]
            else:
                left = (seen <= self.low[at]) | (seen > self.high[at])
                at = self.children[2 * at + left]
        return at


def _bytes(cells: pa.Array) -> memoryview:
    """What binary values without nulls hold, one after the other."""
    ends = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]
    return memoryview(cells.buffers()[2])[ends[0] : ends[-1]]


def _pass(binned: DataFrame, merged: bool, grown: _Grown, shape: _Shape, opened: list[int], level: int) -> dict[int, tuple]:
    """What ``_Shape.best`` says of the open nodes, by node."""
    column, low, high, children = grown.walk()
    wanted = sorted({grown.tree[i] for i in opened})
    # nodes of a tree follow each other, so a tree adds to one run of places
    opened = sorted(opened, key=lambda i: (grown.tree[i], i))
    place = np.full(len(grown.tree), -1, np.int64)
    place[opened] = np.arange(len(opened))
    trees_of = np.array([grown.tree[i] for i in opened])
    spans = {t: (int(np.searchsorted(trees_of, t)), int(np.searchsorted(trees_of, t, side="right"))) for t in wanted}
    names = [(grown.tree[i], grown.node[i]) for i in opened]
    block = max(1, BLOCK_BYTES // (8 * shape.cells * shape.sums))
    width, cells, sums, trees, classes, centre = len(shape.sizes), shape.cells, shape.sums, grown.trees, shape.classes, shape.centre
    starts, sizes, tree_of = shape.starts, shape.sizes, np.array(grown.tree, np.int32)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(opened), cells, sums))
        widest = max(sizes)
        kind = np.uint8 if widest <= 256 else np.int32
        steps = {}
        for tree in wanted:
            nodes = np.flatnonzero(tree_of == tree)
            steps[tree] = _Steps(nodes, column, low, high, children, widest), place[nodes]
        # a slice stays in a core's cache while a tree has few open nodes, and outweighs their cells later
        most = max(b - a for a, b in spans.values())
        for t in _chunks(batches, min(CHUNK_ROWS // (sums if merged else 1), max(SLICE_ROWS, SLICE_ROWS * most // 256))):
            columns = [t.column(f"b{j}").to_numpy().astype(kind) for j in range(width)]
            flat = np.column_stack(columns).ravel()
            bag = b"".join(_bytes(c) for c in t.column("bag").chunks)
            if merged:
                bag = np.frombuffer(bag, np.float64).reshape(-1, sums, trees)
            else:
                bag, y, w = np.frombuffer(bag, np.uint8).reshape(-1, trees), t.column("y").to_numpy(), t.column("w").to_numpy()
                y = y.astype(np.int64) if classes else y - centre
            for tree in wanted:
                a, b = spans[tree]
                mine = np.ascontiguousarray(bag[..., tree])
                row = np.flatnonzero((mine.any(axis=1) if classes else mine[:, 0]) if merged else mine)
                walked, places = steps[tree]
                here = places[walked.walk(flat, row * width, level)]
                open_ = np.flatnonzero((here >= a) & (here < b))
                if not len(open_):
                    continue
                row, here = row[open_], here[open_] - a
                if merged:
                    parts, label = [mine[row, k] for k in range(sums)], None
                else:
                    weight, label = mine[row] * w[row], y[row]
                    parts = [weight] if classes else [weight, weight * label, weight * label * label]
                for j, size in enumerate(sizes):
                    cell = here * size + columns[j][row]
                    into = total[a:b, starts[j] : starts[j + 1]]
                    if classes and not merged:
                        into += np.bincount(cell * classes + label, weights=weight, minlength=(b - a) * size * classes).reshape(b - a, size, classes)
                    else:
                        for s, part in enumerate(parts):
                            into[:, :, s] += np.bincount(cell, weights=part, minlength=(b - a) * size).reshape(b - a, size)
        for k in range(0, len(opened), block):
            part = total[k : k + block]
            if part[:, : sizes[0]].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // block], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "sums"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def said() -> pa.RecordBatch:
            first = now * block
            gain, col, at, whole, left, right = shape.best(total.reshape(-1, cells, sums), names[first : first + block])
            lists = [pa.array(list(x), pa.list_(pa.float64())) for x in (whole, left, right)]
            return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(gain))), pa.array(gain), pa.array(col), pa.array(at), *lists], names=["place", "gain", "col", "at", "whole", "l", "r"])

        for batch in batches:
            for k, b in enumerate(batch.column("block").to_pylist()):
                part = np.frombuffer(batch.column("sums")[k].as_buffer(), np.float64)
                if b == now:
                    total += part
                    continue
                if now is not None:
                    yield said()
                now, total = b, part.copy()
        if now is not None:
            yield said()

    added = binned.mapInArrow(add, "block int, sums binary").repartition("block").sortWithinPartitions("block")
    schema = "place long, gain double, col long, at long, whole array<double>, l array<double>, r array<double>"
    # a row per open node
    found = {opened[r.place]: (r.gain, r.col, r["at"], r.whole, r.l, r.r) for r in added.mapInArrow(pick, schema).collect()}
    nothing = [0.0] * sums
    return {i: found.get(i, (0.0, -1, 0, nothing, nothing, nothing)) for i in opened}
