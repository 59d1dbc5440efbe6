"""Near duplicates by min-max hashing.

Every permutation of a document's shingles gives two signature values, its minimum and its maximum,
so ``2 * PERMUTATIONS`` values cost ``PERMUTATIONS`` hashes per shingle. Bands of ``2 * BAND_PERMUTATIONS``
values name candidate buckets; a candidate link counts only if it holds on the full shingle sets.

At a similarity of 0.8 a pair shares none of the 32 bands with probability (1 - 0.8**4)**32 = 5e-8,
and its estimate rules it out with probability 8e-11 more (binomial, 128 bytes): 5e-8 together.

No step lists all pairs of a bucket. Documents with equal sets are one node. In each bucket all nodes
are first compared with one of them, the best connected. Only buckets whose nodes are then still in several
components are searched further, for pairs across components, and large ones in blocks of bounded
size that report no more links than join their components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridlore.llm.preselect import of_ids
from gridlore.llm.textkit import mix, shingle_sets, slices, text_buffers
from gridlore.session import materialize

PERMUTATIONS = 64
BAND_PERMUTATIONS = 2
BANDS = PERMUTATIONS // BAND_PERMUTATIONS
SLACK = 0.25
"""A pair is dropped unverified if its estimate, from 128 signature bytes, is this much under the threshold (7 standard deviations)."""
SMALL = 64
"""Buckets of up to this many nodes report candidates; larger ones are searched with full sets at hand."""
BLOCK = 512
"""Nodes of a large bucket that a task holds at a time, from either side."""

_FACTORS = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = mix(np.arange(1001, 1001 + PERMUTATIONS, dtype=np.uint64))

SIGNATURE = "doc_id long, n long, set_key binary, bands array<long>, sig binary"
_SIGNATURE = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())]
)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum under every permutation, in turn."""
    low, high = None, None
    for at in range(0, len(shingles), 2048):
        values = shingles[at : at + 2048, None] * _FACTORS + _SHIFTS
        a, b = values.min(axis=0), values.max(axis=0)
        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    return np.stack([low, high], axis=1).reshape(-1)


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, with the number of the band mixed in."""
    groups = mix(values).reshape(BANDS, -1)
    out = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for k in range(groups.shape[1]):
        out = mix(out ^ groups[:, k])
    return out.view(np.int64)


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(*text_buffers(batch.column("text")), width)
                keys, bands, sigs = [], [], []
                for s in sets:
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    values = signature(s) if len(s) else None
                    bands.append(band_keys(values) if len(s) else np.zeros(0, np.int64))
                    sigs.append((mix(values) & np.uint64(255)).astype(np.uint8).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, bands)]), pa.int32()), pa.array(np.concatenate(bands), pa.int64())),
                        pa.array(sigs, pa.binary()),
                    ],
                    schema=_SIGNATURE,
                )

    return run


def _sets(width: int):
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(*text_buffers(batch.column("text")), width)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64()),
                        pa.ListArray.from_arrays(
                            pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64), pa.int64())
                        ),
                    ],
                    schema=schema,
                )

    return run


def _sets_of(docs: DataFrame, ids: DataFrame, width: int, label: str) -> DataFrame:
    """Shingle sets of the documents in ``ids`` (id), written once."""
    sets = of_ids(docs, ids).mapInArrow(_sets(width), "id long, shingles array<long>")
    return materialize(sets.dropDuplicates(["id"]), label)


def _estimates(threshold: float):
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            na, nb = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            keep = ((left == right).mean(axis=1) >= threshold - SLACK) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _overlap(sets: list[np.ndarray], one: np.ndarray) -> np.ndarray:
    """How many elements each of ``sets`` shares with the sorted ``one``."""
    joined = np.concatenate(sets)
    at = np.searchsorted(one, joined)
    at[at == len(one)] = 0
    hit = one[at] == joined
    return np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *map(len, sets[:-1])]))


def _search_group(g: dict, exact: bool, threshold: float) -> list[tuple[int, int]]:
    """Pairs across components within one group of a bucket.

    ``exact``: the links that join its components, checked on full sets. Else all pairs whose
    estimate doesn't rule them out. A pair is left to the first band that it shares.
    """
    percent, n, comp, bands, sig, side = round(threshold * 100), g["n"], g["comp"], g["bands"], g["sig"], g["side"]
    out, root = [], {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for i in range(len(n)):
        # side 0 meets side 1; within a block (side 2) each pair once
        if side[i] == 1:
            continue
        others = np.flatnonzero(side == 1) if side[i] == 0 else np.arange(i + 1, len(n))
        if not len(others):
            continue
        ok = (comp[others] != comp[i]) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))
        others = others[ok]
        others = others[(sig[others] == sig[i]).mean(axis=1) >= threshold - SLACK]
        if not len(others):
            continue
        same = bands[others] == bands[i]
        others = others[same.argmax(axis=1) == g["band"]]
        if not exact:
            out += [(int(g["rep"][i]), int(g["rep"][j])) for j in others]
            continue
        others = others[[find(comp[j]) != find(comp[i]) for j in others]] if len(others) else others
        if len(others):
            shared = _overlap([g["sets"][j] for j in others], g["sets"][i])
            union = n[others] + n[i] - shared
            for j in others[100 * shared >= percent * union]:
                a, b = find(comp[i]), find(comp[j])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((int(g["rep"][i]), int(g["rep"][j])))
    return out


def _search(exact: bool, threshold: float):
    """Rows come sorted by group; groups are handled as they end, so memory holds one of bounded size."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(t: pa.Table) -> list[tuple[int, int]]:
        rows = t.num_rows
        comp = t.column("comp").to_numpy()
        if rows < 2 or (comp == comp[0]).all():
            return []
        bands = np.concatenate([x.values.to_numpy(zero_copy_only=False) for x in t.column("bands")]).reshape(rows, -1)
        g = {
            "rep": t.column("rep").to_numpy(), "n": t.column("n").to_numpy(), "comp": comp, "side": t.column("side").to_numpy(), "bands": bands,
            "sig": np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(rows, -1), "band": int((bands[0] == t.column("key")[0].as_py()).argmax()),
        }
        if exact:
            g["sets"] = [np.sort(x.values.to_numpy(zero_copy_only=False).view(np.uint64)) for x in t.column("shingles")]
        return _search_group(g, exact, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None and held.num_rows else t
            marks = [t.column(c).to_numpy() for c in ("key", "i", "j")]
            new = np.flatnonzero(np.logical_or.reduce([m[1:] != m[:-1] for m in marks])) + 1
            found, starts = [], [0, *new.tolist()]
            for a, b in zip(starts, starts[1:]):
                found += solve(t.slice(a, b - a))
            held = t.slice(starts[-1])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], schema=schema)
        found = solve(held) if held is not None else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], schema=schema)

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable, for every node of ``links`` (a, b).

    Every round takes the smallest label among neighbours, then the label's own label, so the
    number of rounds is about the logarithm of the longest path. Labels are written each round.
    """
    edges = materialize(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = materialize(labels.join(near, "node", "left").select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("comp")), "labels")
        up = step.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        after = materialize(step.join(up, "comp", "left").select("node", "was", F.least("comp", "up").alias("comp")), "labels")
        if after.where("comp <> was").isEmpty():
            return after.select("node", "comp")
        labels = after.select("node", "comp")


def link_documents(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents whose sets of ``width``-word shingles have a Jaccard similarity of ``threshold`` or
    more are linked; component_id is the smallest doc_id reachable, and the document that bears it
    is kept. A document without words, or with null text, has an empty set, is linked with nothing
    and kept. Rows that share a doc_id are one document, so repeated rows are kept or dropped
    together. A null doc_id is never linked, has a null component_id and is kept. Further columns are
    ignored; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    percent = round(threshold * 100)
    sig = materialize(docs.mapInArrow(_signatures(width), SIGNATURE), "signatures")
    first = F.min(F.struct(F.col("doc_id").alias("rep"), "n", "bands", "sig")).alias("r")
    classes = materialize(sig.where("n > 0 and doc_id is not null").groupBy("set_key").agg(first).select("set_key", "r.*"), "classes")
    entries = classes.select("rep", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    entries = materialize(entries.join(shared, "key"), "buckets")
    # the node that shares buckets with most others is the likeliest centre of its group
    weight = entries.groupBy("rep").agg(F.sum("c").alias("weight"))
    lead = entries.join(weight, "rep").groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("m"))).alias("x"))
    entries = materialize(entries.join(lead.select("key", (-F.col("x.m")).alias("lead")), "key"), "buckets")
    tested = entries.where("rep <> lead").select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()

    brief = classes.select("rep", "n", "sig")
    side = lambda x: brief.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that hold on full sets."""
        pairs = materialize(pairs, "candidates")
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        sets = _sets_of(docs, ids, width, "sets")
        own = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s_{x}"))
        inter = F.size(F.array_intersect("s_a", "s_b"))
        both = pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", inter.alias("i"), (F.size("s_a") + F.size("s_b")).alias("t"))
        return both.where(100 * F.col("i") >= percent * (F.col("t") - F.col("i"))).select("a", "b")

    near = tested.join(side("a"), "a").join(side("b"), "b").mapInArrow(_estimates(threshold), "a long, b long")
    links = materialize(confirmed(near), "links")
    labels = components(links)

    marked = entries.where("c > 2").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    marked = materialize(marked, "buckets")
    main = F.max(F.when(F.col("rep") == F.col("lead"), F.col("comp"))).alias("main")
    open_keys = marked.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), main).where("x <> y").select("key", "main")
    rest = materialize(marked.join(open_keys, "key").withColumn("out", F.col("comp") != F.col("main")), "open-buckets")
    many = rest.where(F.col("c") > SMALL).groupBy("key").agg(*[F.ceil(F.sum((F.col("out") == o).cast("int")) / BLOCK).cast("int").alias(n) for o, n in ((False, "mains"), (True, "outs"))])
    payload = classes.select("rep", "n", "bands", "sig")
    order = ["key", "i", "j"]
    small = rest.where(F.col("c") <= SMALL).select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"), "rep", "comp").join(payload, "rep")
    found = small.repartition(*order).sortWithinPartitions(*order).mapInArrow(_search(False, threshold), "a long, b long").distinct()
    more = confirmed(found)
    large = rest.join(many, "key")
    sets = _sets_of(docs, large.select(F.col("rep").alias("id")).distinct(), width, "sets").withColumnRenamed("id", "rep")
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    # nodes outside the leader's component, in blocks, meet its blocks (numbered from -1 down) and each other's
    inner = large.where("not out").select("key", (-1 - block("mains")).alias("i"), F.explode(F.expr("sequence(0, outs - 1)")).alias("j"), F.lit(0).alias("side"), "rep", "comp")
    outer = large.where("out").withColumn("own", block("outs")).withColumn("other", F.explode(F.expr("sequence(-mains, outs - 1)")))
    outer = outer.select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.expr("case when own = other then 2 when own < other then 0 else 1 end").alias("side"), "rep", "comp",
    )
    met = inner.union(outer).join(payload, "rep").join(sets, "rep").repartition(*order).sortWithinPartitions(*order)
    links = materialize(links.union(more).union(met.mapInArrow(_search(True, threshold), "a long, b long")).distinct(), "links")
    labels = components(links)

    of_class = classes.select("set_key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = materialize(of_class.select("set_key", F.coalesce("comp", "rep").alias("comp")), "classes")
    comp = F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("doc_id"))
    out = sig.select("doc_id", "n", "set_key").join(of_class, "set_key", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), comp).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_group(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without near duplicates: all its columns, one document of each group."""
    dropped = materialize(link_documents(docs, width, threshold).where("not kept").select("doc_id").distinct(), "dropped")
    return docs.join(dropped, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

