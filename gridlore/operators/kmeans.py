"""K-means for several cluster counts and starts at once: every fit shares every scan.

Seeding is k-means||: rounds in which each row is drawn with a chance in proportion to its squared
distance from the centres so far, all starts in the same scan. The rows drawn, a few times the largest
count, are weighted by the rows nearest to them and reduced to centres on the driver. Each Lloyd
step is one scan in which every row meets the centres of all fits.

Centres are as wide as the vectors, so the driver holds them at common slots only: those of narrow columns and of
frequent levels. At any other slot a centre is the mean of its rows, and rows remember which centres they were
taken into: a slot that one row has is known from that row, and rows that share a slot of a wide column
are brought together by it in every step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, functions as F, types as T

from gridlore.session import discard, materialize, scratch_path, small_frame

OVERSAMPLING, ROUNDS = 2.0, 3
STEPS, TOLERANCE = 20, 1e-4
CELLS_AT_ONCE = 1 << 21
"""Numbers that a slice of rows takes inside a task."""
DENSE = 128
"""Vectors of up to this size are multiplied as dense rows, longer ones entry by entry."""
COMMON = 1 << 10
"""Columns of up to so many slots, and slots that more than one in so many rows have, are common."""


class _Slice:
    """Some rows of a batch: their entries (row, at, v), their keys and squared lengths."""

    def __init__(self, lengths: np.ndarray, at: np.ndarray, v: np.ndarray, keys: np.ndarray, size: int):
        self.n, self.size, self.at, self.v, self.keys = len(lengths), size, at, v, keys
        self.row = np.repeat(np.arange(self.n), lengths)
        self.squared = np.bincount(self.row, v * v, minlength=self.n)
        self.filled = np.flatnonzero(lengths)
        self.first = (np.cumsum(lengths) - lengths)[self.filled]

    def dense(self) -> np.ndarray:
        rows = np.zeros((self.n, self.size))
        rows[self.row, self.at] = self.v
        return rows

    def times(self, across: np.ndarray) -> np.ndarray:
        """Inner products with the columns of ``across``."""
        if self.size <= DENSE:
            return self.dense() @ across
        products = np.zeros((self.n, across.shape[1]))
        if len(self.filled):
            products[self.filled] = np.add.reduceat(across[self.at] * self.v[:, None], self.first, axis=0)
        return products

    def within(self, slots: np.ndarray) -> _Slice:
        """The entries at some slots, in order, numbered by these; lengths of the rows stay."""
        if len(slots) == self.size:
            return self
        place = np.minimum(np.searchsorted(slots, self.at), len(slots) - 1)
        hit = slots[place] == self.at if len(slots) else np.zeros(len(self.at), bool)
        found = _Slice(np.bincount(self.row[hit], minlength=self.n), place[hit], self.v[hit], self.keys, len(slots))
        found.squared = self.squared
        return found

    def squares(self, across: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Squared distances, rows by centres, which are the columns of ``across``."""
        return np.maximum(self.squared[:, None] - 2 * self.times(across) + lengths, 0)


def _slices(batch: pa.RecordBatch, size: int, centres: int) -> Iterator[_Slice]:
    """Slices of a batch's vectors that meet so many centres at once; their work follows the entries that aren't zero."""
    vectors, keys = batch.column("features"), batch.column("key").to_numpy()
    kind, indices, values = vectors.field("type").to_numpy(), vectors.field("indices"), vectors.field("values")
    ends, at = values.offsets.to_numpy().astype(np.int64), indices.offsets.to_numpy()
    data, where = values.values.to_numpy()[ends[0] : ends[-1]], indices.values.to_numpy()
    ends = ends - ends[0]
    lengths = np.diff(ends)
    places = np.arange(len(data)) - np.repeat(ends[:-1], lengths)
    places[np.repeat(kind == 0, lengths)] = where[at[0] : at[-1]]
    wide = max(1.0, len(data) / max(batch.num_rows, 1)) * max(centres, 1)
    step = max(1, int(CELLS_AT_ONCE / max(wide, size if size <= DENSE else 1)))
    for first in range(0, batch.num_rows, step):
        last = min(first + step, batch.num_rows)
        a, b = ends[first], ends[last]
        yield _Slice(lengths[first:last], places[a:b], data[a:b], keys[first:last], size)


def _squares(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centres."""
    apart = (rows**2).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(axis=1)
    return np.maximum(apart, 0)


def _beside(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """All centres as columns of one matrix, their squared lengths, and the columns of each set."""
    edges = np.cumsum([0, *map(len, sets)]).tolist()
    whole = np.vstack(sets)
    return np.ascontiguousarray(whole.T), (whole**2).sum(axis=1), list(zip(edges, edges[1:]))


def entries(table: DataFrame, size: int, kept: list[str]) -> DataFrame:
    """(kept columns, at, v): the entries of ``features`` that aren't zero, and for each row one at -1 that holds 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.append_column("key", pa.array(np.arange(batch.num_rows)))
            for part in _slices(whole, size, 1):
                row = np.concatenate([part.keys[part.row], part.keys])
                at, v = np.concatenate([part.at, np.full(part.n, -1)]), np.concatenate([part.v, np.ones(part.n)])
                some = np.flatnonzero(v)
                columns = [batch.column(f"_{c}").take(pa.array(row[some])) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(at[some], pa.int32()), pa.array(v[some])], names=[*kept, "at", "v"])

    schema = table.select(*kept).schema.add("at", T.IntegerType()).add("v", T.DoubleType())
    return table.select("features", *[F.col(c).alias(f"_{c}") for c in kept]).mapInArrow(run, schema)


def _chance(keys: np.ndarray, salt: int) -> np.ndarray:
    """A uniform number of each row, the same however often a task runs."""
    x = keys.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def _embedded(sets: list[np.ndarray], slots: np.ndarray, more: list[list[tuple]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Sets of points at ``slots`` and further points of each, (at, v), without repeats at all slots that one of them has."""
    wider = np.unique(np.concatenate([slots, *[at for points in more for at, _ in points]]).astype(np.int64))
    wider = wider if len(wider) else np.zeros(1, np.int64)
    place, out = np.searchsorted(wider, slots), []
    for points, further in zip(sets, more):
        whole = np.zeros((len(points) + len(further), len(wider)))
        whole[: len(points), place] = points
        for i, (at, v) in enumerate(further, start=len(points)):
            whole[i, np.searchsorted(wider, at)] = v
        out.append(np.unique(whole, axis=0))
    return out, wider


def _drawn(table: DataFrame, sets: list[np.ndarray], slots: np.ndarray, costs: np.ndarray, wanted: float, size: int, turn: int) -> tuple[list[list[tuple]], np.ndarray]:
    """Further centres of each set, about ``wanted`` rows as (at, v), and its cost, in one scan.

    ``costs`` come from the scan before, with fewer centres, so a few rows less than wanted are drawn.
    """
    schema = pa.schema([("fit", pa.int32()), ("at", pa.list_(pa.int64())), ("v", pa.list_(pa.float64())), ("cost", pa.float64())])
    across, lengths, places = _beside(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sets))
        for batch in batches:
            for rows in _slices(batch, size, len(lengths)):
                apart = rows.within(slots).squares(across, lengths)
                for fit, (a, b) in enumerate(places):
                    near = apart[:, a:b].min(axis=1)
                    total[fit] += near.sum()
                    for r in np.flatnonzero(_chance(rows.keys, turn * len(sets) + fit + 1) * costs[fit] < wanted * near).tolist():
                        own = (rows.row == r) & (rows.v != 0)
                        yield pa.RecordBatch.from_pylist([{"fit": fit, "at": rows.at[own].tolist(), "v": rows.v[own].tolist(), "cost": None}], schema=schema)
        yield pa.RecordBatch.from_pylist([{"fit": fit, "at": None, "v": None, "cost": c} for fit, c in enumerate(total)], schema=schema)

    more, now = [[] for _ in sets], np.zeros(len(sets))
    drawn = table.mapInArrow(run, "fit int, at array<long>, v array<double>, cost double")
    # a few times the largest cluster count per start, and a number per start and task
    for r in drawn.collect():
        if r["at"] is None:
            now[r["fit"]] += r["cost"]
        else:
            more[r["fit"]].append((np.array(r["at"], np.int64), np.array(r["v"])))
    return more, now


def _assigned(table: DataFrame, sets: list[np.ndarray], size: int, slots: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per set of centres: rows and sums of the rows nearest to each, and the cost; in one scan.

    Centres that are zero but at ``slots`` are given at these, and sums are taken there.
    """
    across, lengths, places = _beside(sets)
    slots = np.arange(size) if slots is None else slots
    numbers = len(slots)
    width = numbers + 2  # a centre's sums, rows and cost

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(lengths), width))
        flat = found.ravel()
        for batch in batches:
            for whole in _slices(batch, size, len(lengths)):
                rows = whole.within(slots)
                apart = rows.squares(across, lengths)
                for a, b in places:
                    near = apart[:, a:b].argmin(axis=1)
                    least = apart[np.arange(rows.n), a + near]
                    np.add.at(flat, (a + near)[rows.row] * width + rows.at, rows.v)
                    found[a:b, numbers] += np.bincount(near, minlength=b - a)
                    found[a:b, numbers + 1] += np.bincount(near, least, minlength=b - a)
        some = np.flatnonzero(flat)
        for at in range(0, len(some), 1 << 16):
            part = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(flat[part])], names=["i", "v"])

    # as many numbers as all centres have, without zeros
    summed = table.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    whole = np.zeros(len(lengths) * width)
    whole[summed["i"].to_numpy()] = summed["v"].to_numpy()
    whole = whole.reshape(-1, width)
    parts = [whole[a:b] for a, b in places]
    return [p[:, numbers] for p in parts], [p[:, :numbers] for p in parts], np.array([p[:, numbers + 1].sum() for p in parts])


def _reduced(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres of a few weighted points: k-means++ and Lloyd steps on the driver."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    while len(chosen) < min(k, len(points)):
        chance = _squares(points, points[chosen]).min(axis=1) * weights
        if chance.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(points), p=chance / chance.sum())))
    centres = points[chosen]
    for _ in range(STEPS):
        near = _squares(points, centres).argmin(axis=1)
        centres = np.array([np.average(points[near == c], axis=0, weights=weights[near == c]) if weights[near == c].sum() else centres[c] for c in range(len(centres))])
    return centres


def _schema(table: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in table.schema])


def _common(table: DataFrame, size: int, columns: Sequence[tuple[int, int]]) -> tuple[DataFrame, np.ndarray, int]:
    """The common slots, and rows with the slot of each wide column that they share with few others, s0.. .

    In other rows s is below zero, by the key. Columns in which no rows share a slot that isn't common get none.
    """
    wide = [(a, b) for a, b in columns if b - a > COMMON]
    common = [np.arange(a, b) for a, b in zip([0, *[b for _, b in wide]], [*[a for a, _ in wide], size])]
    if not wide:
        return table.select("features", "key"), np.arange(size), 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, first = np.full((len(wide), batch.num_rows), -1), 0
            for rows in _slices(batch, size, 1):
                for c, (a, b) in zip(found, wide):
                    own = (rows.at >= a) & (rows.at < b) & (rows.v != 0)
                    c[first + rows.row[own]] = rows.at[own]
                first += rows.n
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.int32()) for c in found]], names=[*batch.schema.names, *[f"c{j}" for j in range(len(wide))]])

    schema = _schema(table.select("features", "key"))
    for j in range(len(wide)):
        schema = schema.add(f"c{j}", T.IntegerType())
    rows = materialize(table.select("features", "key").mapInArrow(run, schema), "slots")
    spread = -1 - F.pmod(F.col("key"), F.lit(4 * COMMON)).cast("int")
    many, shared = F.lit(rows.count()), 0
    for j in range(len(wide)):
        counts = materialize(rows.where(f"c{j} >= 0").groupBy(F.col(f"c{j}").alias("at")).agg(F.count(F.lit(1)).alias("n")), "counts")
        often = [r["at"] for r in counts.where(F.col("n") * COMMON > many).collect()]
        common.append(np.array(often, np.int64))
        some = counts.where((F.col("n") > 1) & (F.col("n") * COMMON <= many)).select("at")
        if some.isEmpty():
            rows = rows.drop(f"c{j}")
            continue
        own = F.col(f"c{j}")
        rows = rows.withColumn("at", F.when((own >= 0) & ~own.isin(often), own).otherwise(spread)).drop(f"c{j}")
        rows = rows.join(some.withColumn("_shared", F.lit(True)), "at", "left").withColumn(f"s{shared}", F.when(F.col("_shared"), F.col("at")).otherwise(spread)).drop("at", "_shared")
        shared += 1
    return rows, np.sort(np.concatenate(common)), shared


def _bytes(numbers: np.ndarray) -> pa.Array:
    """A binary value for each row of an array."""
    width = numbers.shape[1] * numbers.itemsize
    ends = np.arange(len(numbers) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(numbers).tobytes())])


def _numbers(column: pa.Array, dtype: np.dtype) -> np.ndarray:
    """The rows ``_bytes`` was given."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(dtype).reshape(len(column), -1)


@dataclass
class _Sent:
    """The centres of some fits as tasks get them.

    A centre is its column of ``across`` at ``slots`` and, where these aren't ``common``, the mean of the rows it was
    made of besides: ``share`` is one by their number. Such rows are those last nearest to it, if ``taken``, and where ``kept`` says
    so, as no row was, those it had before.
    """

    fits: np.ndarray
    edges: np.ndarray
    slots: np.ndarray
    common: np.ndarray
    across: np.ndarray
    lengths: np.ndarray
    share: np.ndarray
    kept: np.ndarray
    taken: bool
    dtype: np.dtype

    def __post_init__(self):
        sizes = np.diff(self.edges)
        self.places = list(zip(self.edges.tolist(), self.edges[1:].tolist()))
        self.fit_of = np.repeat(self.fits, sizes)
        self.bit_of = np.concatenate([np.arange(n) for n in sizes])

    def made_of(self, mask: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Whether a centre is made of a row, rows by centres."""
        own = (near[:, self.fit_of] == self.bit_of) if self.taken else np.zeros((len(near), len(self.fit_of)), bool)
        if self.kept.any():
            own |= ((mask[:, self.fit_of] >> self.bit_of.astype(self.dtype)) & 1).astype(bool) & self.kept
        return own


class _Chunk:
    """Rows of a batch with all rows that share a slot of column ``by``, and their products with centres there."""

    def __init__(self, batch: pa.RecordBatch, size: int, sent: _Sent, shared: int, by: int | None):
        self.batch, self.sent, self.by, self.shared = batch, sent, by, shared
        self.mask, self.near = _numbers(batch.column("mask"), sent.dtype), _numbers(batch.column("near"), np.dtype(np.uint8))
        self.slots = [batch.column(f"s{j}").to_numpy() for j in range(shared)]
        parts = list(_slices(batch, size, len(sent.lengths)))
        ends = np.cumsum([0, *[p.n for p in parts]]).tolist()
        self.parts = [(slice(a, b), p) for a, b, p in zip(ends, ends[1:], parts)]
        if by is not None:
            s = self.slots[by]
            self.group = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
            self.worth = np.zeros(batch.num_rows)
            for where, rows in self.parts:
                own = rows.at == s[where][rows.row]
                self.worth[where] = np.bincount(rows.row[own], rows.v[own], minlength=rows.n)
            self.sums = self.grouped()
            for where, _ in self.parts:
                self.add(self.sums, where, sent.made_of(self.mask[where], self.near[where]))

    def grouped(self) -> np.ndarray:
        return np.zeros((self.group[-1] + 1, len(self.sent.lengths)))

    def add(self, sums: np.ndarray, where: slice, made_of: np.ndarray) -> None:
        """Add to the sums of each shared slot the rows that centres are made of."""
        group = self.group[where]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sums[group[first]] += np.add.reduceat(made_of * self.worth[where][:, None], first, axis=0)

    def products(self, where: slice) -> np.ndarray:
        """Rows' products with the centres at the shared slot."""
        return self.worth[where][:, None] * self.sums[self.group[where]] * self.sent.share

    def alone(self, where: slice, rows: _Slice) -> np.ndarray:
        """The squared length of the entries at slots that only the row itself has."""
        common = self.sent.common
        other = np.ones(len(rows.at), bool)
        if len(common):
            other = common[np.minimum(np.searchsorted(common, rows.at), len(common) - 1)] != rows.at
        for s in self.slots:
            other &= s[where][rows.row] != rows.at
        return np.bincount(rows.row[other], rows.v[other] ** 2, minlength=rows.n)

    def meet(self) -> Iterator[tuple]:
        """Slice by slice: where it is, its rows, their entries at the slots, what is at slots of their own, whether centres are made of them, and products with the centres."""
        sent = self.sent
        carried = _numbers(self.batch.column("carried"), np.dtype(float)) if "carried" in self.batch.schema.names else None
        for where, rows in self.parts:
            made_of, alone, known = sent.made_of(self.mask[where], self.near[where]), self.alone(where, rows), rows.within(sent.slots)
            products = known.times(sent.across) + made_of * (alone[:, None] * sent.share)
            if self.by is not None:
                products += self.products(where)
            if carried is not None:
                products += carried[where]
            yield where, rows, known, alone, made_of, products


def _together(batches: Iterator[pa.RecordBatch], by: str | None) -> Iterator[pa.RecordBatch]:
    """Batches cut where ``by``, which rows are sorted by, changes."""
    if by is None:
        yield from (b for b in batches if b.num_rows)
        return
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(by).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last or (held and held[0].column(by)[0].as_py() != keys[0]):
            if held or last:
                yield pa.concat_batches([*held, *([batch.slice(0, last)] if last else [])])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.concat_batches(held)


def _brought(rows: DataFrame, shared: int, size: int, sent: _Sent) -> DataFrame:
    """Rows that share a slot of the last wide column next to each other; of the others, products with the centres are carried along."""
    for j in range(shared - 1):

        def run(batches: Iterator[pa.RecordBatch], j: int = j) -> Iterator[pa.RecordBatch]:
            for batch in _together(batches, f"s{j}"):
                chunk = _Chunk(batch, size, sent, shared, j)
                sums = np.concatenate([chunk.products(where) for where, _ in chunk.parts])
                if j:
                    sums += _numbers(batch.column("carried"), np.dtype(float))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in plain], _bytes(sums)], names=[*plain, "carried"])

        plain = [c for c in rows.columns if c != "carried"]
        schema = _schema(rows.select(*plain)).add("carried", T.BinaryType())
        rows = rows.repartition(f"s{j}").sortWithinPartitions(f"s{j}").mapInArrow(run, schema)
    return rows.repartition(f"s{shared - 1}").sortWithinPartitions(f"s{shared - 1}") if shared else rows


def _stepped(rows: DataFrame, shared: int, size: int, sent: _Sent) -> tuple[DataFrame, str, np.ndarray]:
    """Rows with the centres nearest to them, where they were written, and per centre of its rows: sums at the slots, number, cost, squared
    lengths, squared length of the sums at other slots, and the product of these with those of the rows it was made of."""
    kept = [c for c in rows.columns if c not in ("mask", "near")]
    schema = _schema(rows.select(*kept, "mask", "near")).add("i", T.LongType()).add("v", T.DoubleType())
    numbers, by = len(sent.slots), shared - 1 if shared else None
    width = numbers + 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(sent.lengths), width))
        flat, types = found.ravel(), None
        for batch in _together(batches, f"s{by}" if shared else None):
            chunk = _Chunk(batch, size, sent, shared, by)
            mask, near = chunk.mask.copy(), chunk.near.copy()
            sums = chunk.grouped() if shared else None
            for where, rows, known, alone, made_of, products in chunk.meet():
                apart = np.maximum(rows.squared[:, None] - 2 * products + sent.lengths, 0)
                across = np.ascontiguousarray(apart.T)
                for f, (a, b) in zip(sent.fits, sent.places):
                    near[where, f] = across[a:b].argmin(axis=0)
                taken = near[where][:, sent.fit_of] == sent.bit_of
                now = taken.astype(float)
                if numbers > DENSE:
                    for f, (a, b) in zip(sent.fits, sent.places):
                        np.add.at(flat, (a + near[where, f].astype(np.int64))[known.row] * width + known.at, known.v)
                else:
                    found[:, :numbers] += now.T @ known.dense()
                if sent.kept.any():
                    bits = made_of.astype(sent.dtype) << sent.bit_of.astype(sent.dtype)
                    mask[where, sent.fits] = np.add.reduceat(bits, sent.edges[:-1], axis=1)
                elif sent.taken:
                    mask[where, sent.fits] = sent.dtype.type(1) << chunk.near[where][:, sent.fits].astype(sent.dtype)
                found[:, numbers] += now.sum(axis=0)
                found[:, numbers + 1] += np.einsum("rc,rc->c", now, apart)
                found[:, numbers + 2] += rows.squared @ now
                found[:, numbers + 3] += alone @ now
                found[:, numbers + 4] += alone @ (taken & made_of)
                if shared:
                    chunk.add(sums, where, now)
            if shared:
                found[:, numbers + 3] += (sums**2).sum(axis=0)
                found[:, numbers + 4] += (sums * chunk.sums).sum(axis=0)
            columns = [*[batch.column(c) for c in kept], _bytes(mask), _bytes(near)]
            types = [c.type for c in columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(near), pa.int64()), pa.nulls(len(near), pa.float64())], names=schema.names)
        some = np.flatnonzero(flat) if types else []
        for at in range(0, len(some), 1 << 16):
            part = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(part), t) for t in types], pa.array(part), pa.array(flat[part])], names=schema.names)

    path = scratch_path(rows.sparkSession, "step")
    _brought(rows, shared, size, sent).mapInArrow(run, schema).write.parquet(path)
    written = rows.sparkSession.read.schema(schema).parquet(path)
    whole = _whole(written.where("i IS NOT NULL"), len(sent.lengths) * width).reshape(-1, width)
    now = written.where("i IS NULL").drop("i", "v")
    for j in range(shared - 1):
        whole[:, numbers + 3 :] += _at_shared(now, shared, size, sent, j)
    return now, path, whole


def _at_shared(rows: DataFrame, shared: int, size: int, sent: _Sent, by: int) -> np.ndarray:
    """What ``_stepped`` finds last, at slots of a wide column that rows aren't brought together by when they are assigned."""
    every = np.ones(len(sent.lengths), bool)
    before, after = replace(sent, taken=False, kept=every), replace(sent, taken=True, kept=~every)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(sent.lengths), 2))
        for batch in _together(batches, f"s{by}"):
            was, now = _Chunk(batch, size, before, shared, by).sums, _Chunk(batch, size, after, shared, by).sums
            found += np.stack([(now**2).sum(axis=0), (now * was).sum(axis=0)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(found.size)), pa.array(found.ravel())], names=["i", "v"])

    summed = rows.repartition(f"s{by}").sortWithinPartitions(f"s{by}").mapInArrow(run, "i long, v double")
    return _whole(summed, 2 * len(sent.lengths)).reshape(-1, 2)


def _whole(parts: DataFrame, size: int) -> np.ndarray:
    """An array whose numbers are sums of (i, v): as many as all centres have, without zeros."""
    summed = parts.groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    whole = np.zeros(size)
    whole[summed["i"].to_numpy()] = summed["v"].to_numpy()
    return whole


@dataclass
class _Fit:
    """One fit: its centres at the driver's slots, their squared lengths elsewhere and the rows they are made of."""

    centres: np.ndarray
    rare: np.ndarray
    made_of: np.ndarray
    kept: np.ndarray
    cost: float = np.inf
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0))
    sums: np.ndarray = field(default_factory=lambda: np.zeros(0))
    squared: np.ndarray = field(default_factory=lambda: np.zeros(0))


class Fits(dict):
    """Per cluster count the best centres at ``slots`` and their cost; at other slots centres are known from ``rows``."""

    def __init__(self, rows: DataFrame, slots: np.ndarray, common: np.ndarray, shared: int, size: int, best: dict[int, int], fits: list[_Fit], dtype: np.dtype):
        super().__init__({k: (fits[f].centres, fits[f].cost) for k, f in best.items()})
        self.rows, self.slots, self.common, self.shared, self.size, self.best, self.fits, self.dtype = rows, slots, common, shared, size, best, fits, dtype

    def sizes(self, k: int) -> np.ndarray:
        """Rows nearest to each centre."""
        return self.fits[self.best[k]].rows

    def assigned(self, k: int) -> DataFrame:
        """(features, key, prediction): the centre nearest to each row, the first on ties."""
        near = F.conv(F.hex(F.substring("near", self.best[k] + 1, 1)), 16, 10).cast("int")
        return self.rows.select("features", "key", near.alias("prediction"))

    def centres(self, k: int) -> DataFrame:
        """(cluster, at, value): centres at all of the driver's slots and where else they aren't zero."""
        spark, fit, f = self.rows.sparkSession, self.fits[self.best[k]], self.best[k]
        known = [(c, int(at), float(v)) for c, centre in enumerate(fit.centres) for at, v in zip(self.slots, centre)]
        held = small_frame(spark, known, "cluster int, at int, value double")
        if len(self.common) == self.size:
            return held
        common, size, dtype, kinds = self.common, self.size, self.dtype, len(fit.centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                first, masks = 0, _numbers(batch.column("mask"), dtype)[:, f] if batch.num_rows else None
                for rows in _slices(batch, size, kinds):
                    rare = ~np.isin(rows.at, common) & (rows.v != 0)
                    at, v, mask = rows.at[rare], rows.v[rare], masks[first + rows.row[rare]]
                    first += rows.n
                    for c in range(kinds):
                        own = (mask >> dtype.type(c)) & 1 == 1
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(own.sum(), c), pa.int32()), pa.array(at[own], pa.int32()), pa.array(v[own])], names=["cluster", "at", "v"])

        counts = F.create_map(*[F.lit(int(x)) for c, n in enumerate(fit.made_of) for x in (c, n)])
        summed = self.rows.select("features", "key", "mask").mapInArrow(run, "cluster int, at int, v double").groupBy("cluster", "at")
        rare = summed.agg((F.sum("v") / F.element_at(counts, F.col("cluster"))).alias("value"))
        # the driver holds a zero where a centre is the mean of its rows, which have no number there in turn if it never had rows
        return held.unionByName(rare).groupBy("cluster", "at").agg(F.sum("value").alias("value"))

    def silhouettes(self, counts: Sequence[int]) -> dict[int, float]:
        """Mean silhouettes under squared Euclidean distance of the best fits, in one scan.

        Distances to a cluster follow from its count, sum and sum of squares, so no pairs are formed.
        """
        if not counts:
            return {}
        fits = [self.fits[self.best[k]] for k in counts]
        edges = np.cumsum([0, *[len(x.rows) for x in fits]])
        rows = np.concatenate([x.rows for x in fits])
        share = np.where(rows > 0, 1 / np.maximum(rows, 1), 0.0)
        own_slots = np.searchsorted(self.slots, self.common)
        across = np.ascontiguousarray((np.vstack([x.sums[:, own_slots] for x in fits]) * share[:, None]).T)
        spread = np.concatenate([x.squared for x in fits]) * share
        sent = _Sent(np.array([self.best[k] for k in counts]), edges, self.common, self.common, across, spread, share, np.zeros(len(rows), bool), True, self.dtype)
        size, shared = self.size, self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(fits))
            for batch in _together(batches, f"s{shared - 1}" if shared else None):
                for _, part, _, _, made_of, products in _Chunk(batch, size, sent, shared, shared - 1 if shared else None).meet():
                    apart = np.maximum(part.squared[:, None] - 2 * products + spread, 0)
                    for i, (a, b) in enumerate(sent.places):
                        own, d, n = made_of[:, a:b], apart[:, a:b], rows[a:b]
                        others = (own * n).sum(axis=1) - 1
                        inside = (own * d * n).sum(axis=1) / np.maximum(others, 1)
                        outside = np.where(own | (n == 0), np.inf, d).min(axis=1)
                        most = np.maximum(inside, outside)
                        total[i] += np.where((others > 0) & (most > 0), (outside - inside) / np.where(most > 0, most, 1), 0).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

        whole = _whole(_brought(self.rows, shared, size, sent).mapInArrow(run, "i long, v double"), len(fits))
        return {k: float(v / x.rows.sum()) for k, v, x in zip(counts, whole, fits)}


def _moved(fit: _Fit, found: np.ndarray, common: np.ndarray) -> tuple[_Fit, float]:
    """The fit with each centre at the mean of its rows, where it has any, and how far the farthest moved.

    ``found`` is what ``_stepped`` says of its centres, ``common`` which of the slots are common.
    """
    n, rare, cross = found[:, -5], found[:, -2], found[:, -1]
    some, parts = n > 0, np.maximum(n, 1)
    means = found[:, :-5] / parts[:, None]
    centres = np.where(some[:, None], np.where(common, means, 0), fit.centres)
    # at other slots: squares and product of the new and the old centre
    product = cross / (parts * np.maximum(fit.made_of, 1)) + (means * fit.centres)[:, ~common].sum(axis=1)
    elsewhere = np.where(some, rare / parts**2, fit.rare)
    apart = ((centres - fit.centres)[:, common] ** 2).sum(axis=1) + elsewhere + fit.rare - 2 * product
    moved = _Fit(centres, elsewhere, np.where(some, n, fit.made_of), ~some & (fit.made_of > 0))
    return moved, float(np.sqrt(np.where(some, np.maximum(apart, 0), 0).max()))


def fit_all(table: DataFrame, size: int, counts: list[int], starts: int, seed: int, columns: Sequence[tuple[int, int]] = ()) -> Fits:
    """Per cluster count the best centres over all starts, and their cost.

    ``table`` has features (vectors of ``size`` numbers) and key (a long that names the row). The number of scans
    doesn't depend on counts or starts; centres of all fits go to the tasks together. ``columns`` are ranges of
    slots, from the first to before the last, of which a row has one; slots of wide ones stay with the rows.
    """
    first = [r["features"] for r in table.orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(starts).collect()]
    first = [(x := np.array(v.toArray())).nonzero() + (x[x != 0],) if isinstance(v, DenseVector) else (v.indices[v.values != 0].astype(np.int64), v.values[v.values != 0]) for v in first]
    seeds, slots = _embedded([np.zeros((0, 0))] * starts, np.zeros(0, np.int64), [[first[s % len(first)]] for s in range(starts)])
    costs = _assigned(table, seeds, size, slots)[2]
    for turn in range(ROUNDS):
        more, costs = _drawn(table, seeds, slots, costs, OVERSAMPLING * max(counts), size, turn)
        seeds, slots = _embedded(seeds, slots, more)
    weights = _assigned(table, seeds, size, slots)[0]
    reduced = [_reduced(p, w, k, seed + s) for s, (p, w) in enumerate(zip(seeds, weights)) for k in counts]
    of = [k for _ in range(starts) for k in counts]
    rows, common, shared = _common(table, size, columns)
    slots, points = np.union1d(slots, common), slots
    is_common, fits = np.isin(slots, common), []
    for c in reduced:
        whole = np.zeros((len(c), len(slots)))
        whole[:, np.searchsorted(slots, points)] = c
        fits.append(_Fit(whole, (whole[:, ~is_common] ** 2).sum(axis=1), np.zeros(len(c)), np.zeros(len(c), bool)))
    dtype, moving, path = np.min_scalar_type((1 << max(counts)) - 1), list(range(len(fits))), None
    rows = rows.withColumns({"mask": F.lit(bytes(len(fits) * dtype.itemsize)), "near": F.lit(bytes(len(fits)))})
    for step in range(STEPS + 1):
        some = [fits[f] for f in moving]
        used = is_common | np.any([(x.centres != 0).any(axis=0) for x in some], axis=0)
        across = np.ascontiguousarray(np.vstack([x.centres[:, used] for x in some]).T)
        made_of = np.concatenate([x.made_of for x in some])
        sent = _Sent(
            np.array(moving), np.cumsum([0, *[len(x.centres) for x in some]]), slots[used], common, across,
            (across**2 * is_common[used][:, None]).sum(axis=0) + np.concatenate([x.rare for x in some]),
            np.where(made_of > 0, 1 / np.maximum(made_of, 1), 0.0), np.concatenate([x.kept for x in some]), step > 0, dtype,
        )
        rows, written, found = _stepped(rows, shared, size, sent)
        if path:
            discard(rows.sparkSession, path)
        path, still = written, []
        for f, (a, b) in zip(moving, sent.places):
            whole = np.zeros((b - a, len(slots) + 5))
            whole[:, np.concatenate([np.flatnonzero(used), len(slots) + np.arange(5)])] = found[a:b]
            fit, (moved, far) = fits[f], _moved(fits[f], whole, is_common)
            fit.sums, fit.rows, fit.cost, fit.squared = whole[:, :-5], whole[:, -5], whole[:, -4].sum(), whole[:, -3]
            if step < STEPS and far > TOLERANCE:
                fits[f] = moved
                still.append(f)
        moving = still
        if not moving:
            break
    best: dict[int, int] = {}
    for f, k in enumerate(of):
        if k not in best or fits[f].cost < fits[best[k]].cost:
            best[k] = f
    return Fits(rows, slots, common, shared, size, best, fits, dtype)


def predict_all(table: DataFrame, centres: list[np.ndarray], size: int) -> DataFrame:
    """The table with ``nearest``: per set of centres the number of the nearest one, the first on ties."""

    across, lengths, places = _beside(centres)

    def nearest(rows: _Slice) -> np.ndarray:
        apart = rows.squares(across, lengths)
        return np.stack([apart[:, a:b].argmin(axis=1) for a, b in places], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = np.concatenate([nearest(rows) for rows in _slices(batch, size, len(lengths))])
            for at in range(0, batch.num_rows, 4096):
                part = found[at : at + 4096].astype(np.int32)
                lists = pa.ListArray.from_arrays(np.arange(0, part.size + 1, len(centres), dtype=np.int32), part.ravel())
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(at, 4096), lists], names=["key", "nearest"])

    return table.select("features", "key").mapInArrow(run, "key long, nearest array<int>")
