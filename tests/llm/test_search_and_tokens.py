"""Ranked search, least-squares packing and tokenizer alignment against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from compare import connect, differences
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridlore.llm import ball_tree, byte_bpe, nnls_packing, queries, token_links

BPE, MODEL = Path(queries.BYTE_BPE).read_bytes(), Path(queries.PIECE_MODEL).read_bytes()
ODD = [
    None, "", " ", "a", "The the THE thé", "one two  three\n\n four\t", "<|endoftext|> inside <s> </s> <0x41> <unk>", "▁marked▁ text", "naïve café 中文字符 ½²٣ 😀", "x" * 3000,
    "alpha beta " * 2500, "\x00\x01\x1c\x85　", "it's we'll I'd 12345 !!??", "one two", "one two", " " * 700,
]
DOCS = "doc_id long, text string, score long, rank int, part string, base long, block long, pair long, term string, n long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 7, 7, "clash", 7, 7, 7, "clash", 7) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], (None, "the id is missing", *rows[0][2:])], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ["op11_ball_tree_search"])
def test_matches_sql(name, spark):
    folder = "/root/testdata/sf0.01"
    assert differences(queries.QUERIES[name](spark, folder), connect(folder), queries.ORACLES[name]) == ""


def _search(documents, items, top):
    """Every score of every pair, straight from the formula."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(d, Counter(split(t))) for d, t in documents]
    n, length = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    wanted: dict = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(split(t))
    out = []
    for i, found in wanted.items():
        scored = []
        for d, b in bags:
            m = 50 + (50 * sum(b.values()) * n) // max(length, 1)
            df = {t: sum(1 for _, x in bags if t in x) for t in found}
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in found if t in b)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return sorted(out, key=str)


def test_search_of_awkward_rows(spark, docs, empty):
    rows = [(1, "The one", 3), (2, None, 3), (3, "...", 3), (4, "absent", 3), (5, "two café one 中文字符", 3), (5, "alpha", 3), (None, "the", 3)]
    items = spark.createDataFrame(rows, "item_id long, text string, score long")
    got = sorted(map(tuple, ball_tree.ranked_search(docs, items, 3).collect()), key=str)
    assert got == _search(_texts(docs), [r[:2] for r in rows], 3)
    assert ball_tree.ranked_search(empty, items).count() == 0 == ball_tree.ranked_search(docs, items.limit(0)).count()


def test_search_in_blocks_and_from_a_sample(spark, monkeypatch):
    """Several blocks of items, a bar from a sample, trees of several levels, ties and a third of the rows equal."""
    for name, value in {"BLOCK_TERMS": 8, "BLOCK_ITEMS": 3, "SAMPLE": 60, "TREE_DOCS": 128, "LEAF_DOCS": 4}.items():
        monkeypatch.setattr(ball_tree, name, value)
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(25)], size=rng.integers(1, 12))) for _ in range(260)] + ["w1 w2 same"] * 130
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = [(k, " ".join(rng.choice([f"w{k}" for k in range(25)], size=5))) for k in range(8)]
    got = ball_tree.ranked_search(docs, spark.createDataFrame(rows, "item_id long, text string"), 7).collect()
    assert sorted(map(tuple, got), key=str) == _search(_texts(docs), rows, 7)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_tree_never_loses_a_row_and_prunes(seed):
    rng = np.random.default_rng(seed)
    rows, width, near = int(rng.integers(1, 400)), int(rng.integers(1, 30)), int(rng.integers(0, 2))
    dense = rng.integers(0, 10**6, (rows, width)) * (rng.random((rows, width)) < 0.3)
    if near:  # well separated groups, where whole subtrees can be left out
        dense = np.repeat(dense, 3, axis=0)[:rows]
    starts = np.concatenate([[0], np.cumsum((dense > 0).sum(axis=1))])
    tree = ball_tree.BallTree(starts, np.nonzero(dense)[1], dense[dense > 0], width)
    queries_ = rng.integers(0, 20_000, (4, width))
    best = [ball_tree.Best(5, 0) for _ in queries_]
    ball_tree.search(tree, np.arange(rows), queries_, best)
    for q, b in zip(queries_, best):
        exact = sorted(((-int(s), i) for i, s in enumerate(dense @ q) if s > 0))[:5]
        assert sorted((-s, -i) for s, i in b.heap) == exact


def test_tree_leaves_out_distant_rows():
    rng = np.random.default_rng(1)
    dense = np.zeros((2000, 40), dtype=np.int64)
    for k in range(2000):
        group = k % 8
        dense[k, group * 5 : group * 5 + 5] = 400_000 + rng.integers(0, 5_000, 5)
    starts = np.arange(2001) * 5
    tree = ball_tree.BallTree(starts, np.nonzero(dense)[1], dense[dense > 0], 40)
    query = np.zeros((1, 40), dtype=np.int64)
    query[0, :5] = 9_000
    best = [ball_tree.Best(10, 0)]
    assert ball_tree.search(tree, np.arange(2000), query, best) < 600 and len(best[0].heap) == 10


def _encode(text):
    tokenizer = Tokenizer.from_str(BPE.decode())
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("window", [2048, 64])
def test_packing(docs, empty, window):
    got = nnls_packing.pack(docs, BPE, window).collect()
    whole = Counter((d, tuple(_encode(t))) for d, t in _texts(docs))
    pieces: dict = {}
    for r in got:
        assert len(r.ids) == r.length <= window
        pieces.setdefault(r.doc_id, []).append(r)
    assert sum(len(r.ids) for r in got) == sum(len(ids) * n for (_, ids), n in whole.items())
    for (doc, ids), n in whole.items():
        mine = sorted(pieces[doc], key=lambda r: r.start)
        assert Counter(k for r in mine for k in range(r.start, r.start + r.length)) == {k: n for k in range(len(ids))}
        assert all(list(ids[r.start : r.start + r.length]) == r.ids and r.doc_tokens == len(ids) for r in mine)
    used: dict = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    ends = []
    for slots in used.values():
        slots.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(slots, slots[1:])) and slots[0][0] == 0
        ends.append(sum(slots[-1]))
    assert sum(e < window for e in ends) <= 1 and max(ends) <= window and sorted(used) == list(range(len(used)))
    for r in nnls_packing.pack(docs, BPE, window, digest=True).collect():
        ids = next(ids for d, ids in whole if d == r.doc_id)[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    assert nnls_packing.pack(empty, BPE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=33, max_size=33), st.booleans())
def test_plan_covers_every_piece_once(counts, sparse):
    counts = np.array([c if not sparse or c % 5 == 0 else 0 for c in counts], dtype=np.int64)
    counts[0] = 0
    rows = nnls_packing.plan(counts, 32)
    cells, placed = Counter(), Counter()
    for length, first, end, start, size, sequence, offset in rows.tolist():
        for r in range(first, end):
            cells.update((length, r, k) for k in range(start, start + size))
            placed.update((sequence + r - first, k) for k in range(offset, offset + size))
    assert cells == Counter({(n, r, k): 1 for n in range(33) for r in range(counts[n]) for k in range(n)})
    assert set(placed.values()) <= {1}
    full = Counter(s for s, _ in placed)
    assert sum(v < 32 for v in full.values()) <= 1


def test_solver_finds_an_exact_solution():
    counts = np.zeros(65, dtype=np.int64)
    for row, n in {(10, 54): 300, (20, 44): 120, (7, 15, 42): 500}.items():
        for v in row:
            counts[v] += n
    combos = nnls_packing.combinations(counts, 64)
    x = nnls_packing.solve(counts, combos)
    fitted = np.zeros(65)
    for column in combos.T:
        np.add.at(fitted, column, x)
    assert (x >= 0).all() and np.abs(fitted[1:] - counts[1:]).max() < 2
    assert len({r[5] for r in nnls_packing.plan(counts, 64).tolist()}) and nnls_packing.plan(counts, 64)[:, 3].max() == 0  # nothing cut


def test_byte_bpe_equals_the_library():
    for plain in (False, True):
        ours, library = byte_bpe.ByteBpe(BPE, plain), Tokenizer.from_str(BPE.decode())
        library.encode_special_tokens = plain
        assert ours.fast is not None
        for text in [*(t or "" for t in ODD), "a" + " " * 400_000 + "b"]:
            ids = library.encode(text, add_special_tokens=False).ids
            assert ours.encode(text).tolist() == ids
            if plain:
                assert b"".join(ours.table[i] for i in ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_byte_bpe_on_any_text(text):
    ours = byte_bpe.encoder(BPE, True)
    assert ours.encode(text).tolist() == ours.library.encode(text, add_special_tokens=False).ids


def _align(text):
    """Ids, links and groups of one text, token by token."""
    bpe, (model, table) = byte_bpe.encoder(BPE, True), token_links._pieces(MODEL)
    if not text:
        return None
    a, b, raw = bpe.library.encode(" " + text, add_special_tokens=False).ids, model.encode(text), b" " + text.encode()
    if b"".join(bpe.table[i] for i in a) != raw or b"".join(table[i] for i in b) != raw:
        return None
    spans = []
    for ids, pieces in ((a, bpe.table), (b, table)):
        ends = np.cumsum([len(pieces[i]) for i in ids]).tolist()
        spans.append(list(zip([0, *ends], ends, ids)))
    links = [(x, y) for s, e, x in spans[0] for u, v, y in spans[1] if s < v and u < e]
    groups, cuts = [], sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    for low, high in zip([0, *cuts], cuts):
        groups.append("|".join(",".join(str(i) for s, e, i in side if low <= s and e <= high) for side in spans))
    return len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def test_alignment(spark, docs, empty, monkeypatch):
    short = docs.where("text is null or length(text) < 5000")
    texts = _texts(short)
    found = [(d, _align(t)) for d, t in texts]
    count = Counter(p for _, x in found if x for p in set(x[3]))
    most: dict = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    want = [
        (d, x[0], x[1], x[2], len(x[3]), sum(count[p] == most[p[0]] for p in x[3]), sum(count[p] for p in x[3]), x[4]) if x else (d, 0, 0, 0, 0, 0, 0, "") for d, x in found
    ]
    got = token_links.align_tokenizers(short, BPE, MODEL)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(x is not None for _, x in found) > 10 and token_links.align_tokenizers(empty, BPE, MODEL).count() == 0
    assert token_links.align_tokenizers(docs, BPE, MODEL).where("n_links > 0").agg(F.max("n_a")).first()[0] > 4900


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 6), min_size=1, max_size=40), st.integers(0, 10**6)), min_size=1, max_size=6), st.integers(1, 9))
def test_merge_does_not_depend_on_lanes(sides, lane):
    a_sizes, b_sizes, first = [], [], [0]
    for sizes, seed in sides:
        cuts = np.unique(np.append(np.random.default_rng(seed).integers(1, sum(sizes) + 1, 5), sum(sizes)))
        a_sizes += sizes
        b_sizes += np.diff(cuts, prepend=0).tolist()
        first.append(len(a_sizes))
    ends_a, ends_b = np.cumsum(a_sizes), np.cumsum(b_sizes)
    link_a, link_b, cut_a, cut_b = token_links.merge(ends_a, ends_b, np.array(first), lane)
    want = [(i, j) for i in range(len(ends_a)) for j in range(len(ends_b)) if ends_a[i] - a_sizes[i] < ends_b[j] and ends_b[j] - b_sizes[j] < ends_a[i]]
    assert list(zip(link_a.tolist(), link_b.tolist())) == want
    assert ends_a[cut_a].tolist() == ends_b[cut_b].tolist() == sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
