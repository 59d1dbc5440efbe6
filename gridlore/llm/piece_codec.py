"""SentencePiece models on the Tokenizers library: encoding, decoding and parity.

The model file is read field by field: pieces with scores and types, the normaliser, byte fallback. Text is
normalised, spaces become the metaspace mark, and runs of the mark start a new segment; no piece
reaches over such a start, so segments are encoded independently and each distinct one once.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer, decoders, models, normalizers

from gridlore.llm.textkit import slices

MARK = "▁"
MEMO = 1 << 20
"""Distinct segments that a task remembers; beyond it, it starts afresh."""
BATCH = 1 << 14
"""Segments encoded in one call."""
# Fixed values of the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields in order."""
    out, at = [], 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                if kind != 2:
                    raise ValueError(f"wire type {kind} in a model file")
                size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("the model file ends early")
            value, at = data[at : at + size], at + size
        out.append((key >> 3, value))
    return out


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]]
    kind: int
    unknown: int
    byte_fallback: bool
    charsmap: bytes
    add_prefix: bool
    drop_extra_spaces: bool

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        pieces, trainer, normaliser = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        kind = trainer.get(3, UNIGRAM)
        if kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {kind} is neither unigram nor BPE")
        if any(t == USER_DEFINED for _, _, t in pieces):
            raise ValueError("models with user-defined pieces aren't supported")
        if trainer.get(24, 0):
            raise ValueError("models with white space as suffix aren't supported")
        if not normaliser.get(5, 1):
            raise ValueError("models that keep plain spaces aren't supported")
        unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0)
        return cls(
            pieces, kind, unknown, bool(trainer.get(35, 0)), normaliser.get(2, b""), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1))
        )

    def splits(self) -> bool:
        """Whether every piece has its marks, if any, at its start, so that segments are independent."""
        return not any(MARK in p.lstrip(MARK) for p, _, t in self.pieces if t == NORMAL)

    def tokenizer(self) -> Tokenizer:
        """Encoder of normalised segments, and decoder."""
        unknown = self.pieces[self.unknown][0]
        if self.kind == UNIGRAM:
            # control and unused pieces never come from text, so they get names that no text has; byte pieces must
            # keep theirs, and a text that spells one out may differ, as parity then shows
            low = min((s for _, s, t in self.pieces if t == NORMAL), default=0.0)
            hidden = lambda i, p, t: f"\0{i}\0{p}" if t in (CONTROL, UNUSED) else p
            vocabulary = [(hidden(i, p, t), s if t == NORMAL else low) for i, (p, s, t) in enumerate(self.pieces)]
            model = models.Unigram(vocabulary, unk_id=self.unknown, byte_fallback=self.byte_fallback)
        else:
            ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            usable = {p for p, _, t in self.pieces if t == NORMAL}
            ranked = []
            for i, (piece, score, kind) in enumerate(self.pieces):
                if kind == NORMAL:
                    cuts = ((piece[:k], piece[k:]) for k in range(1, len(piece)))
                    ranked += [(-score, i, a, b) for a, b in cuts if a in usable and b in usable]
            ranked.sort(key=lambda m: m[:2])
            merges = [(a, b) for _, _, a, b in ranked]
            model = models.BPE(ids, merges, unk_token=unknown, byte_fallback=self.byte_fallback, fuse_unk=True)
        out = Tokenizer(model)
        steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        out.decoder = decoders.Sequence(steps)
        return out


class Codec:
    """Encoder and decoder of one model file; one per task."""

    def __init__(self, data: bytes):
        self.model = PieceModel.parse(data)
        self.tokenizer = self.model.tokenizer()
        self.charsmap = normalizers.Precompiled(self.model.charsmap) if self.model.charsmap else None
        self.independent = self.model.splits()
        self.memo: dict[str, bytes] = {}
        self.lossy: set[str] = set()
        self.control = {i for i, (_, _, t) in enumerate(self.model.pieces) if t == CONTROL}

    def normalise(self, text: str) -> str:
        if self.charsmap is not None:
            text = self.charsmap.normalize_str(text)
        if self.model.drop_extra_spaces:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (MARK if self.model.add_prefix else "") + text.replace(" ", MARK)

    def _learn(self, segments: list[str]) -> None:
        """Encode distinct segments as one batch, remember their ids as bytes, and whether they decode to themselves."""
        found = self.tokenizer.encode_batch([segments], is_pretokenized=True, add_special_tokens=False)[0]
        ids, starts = np.array(found.ids, dtype=np.int32), np.searchsorted(np.array(found.word_ids), np.arange(len(segments) + 1)).tolist()
        pieces, raw, flat, doubtful = self.model.pieces, ids.tobytes(), ids.tolist(), []
        for segment, a, b in zip(segments, starts, starts[1:]):
            self.memo[segment] = raw[4 * a : 4 * b]
            if "".join([pieces[i][0] for i in flat[a:b]]) != segment:
                doubtful.append((segment, flat[a:b]))
        back = self.tokenizer.decode_batch([ids for _, ids in doubtful], skip_special_tokens=False)
        self.lossy.update(s for (s, _), text in zip(doubtful, back) if text != s.replace(MARK, " "))

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether they decode to its normalised form."""
        cut = [_SEGMENT.findall(t) if self.independent else [t] * bool(t) for t in (self.normalise(t or "") for t in texts)]
        missing = list({s for parts in cut for s in parts if s not in self.memo})
        if missing:
            if len(self.memo) + len(missing) > MEMO:
                self.memo.clear()
                self.lossy.clear()
                missing = list({s for parts in cut for s in parts})
            # the library deals batches out to its own threads
            for at in range(0, len(missing), BATCH):
                self._learn(missing[at : at + BATCH])
        known = self.memo.__getitem__
        out = [np.frombuffer(b"".join(map(known, parts)), dtype=np.int32) for parts in cut]
        return out, [self.lossy.isdisjoint(parts) for parts in cut] if self.lossy else [True] * len(cut)

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of id lists; control pieces are silent, the space that encoding put first is dropped."""
        texts = self.tokenizer.decode_batch([[i for i in x if i not in self.control] for x in ids], skip_special_tokens=False)
        if self.model.add_prefix:
            texts = [t[1:] if t[:1] == " " else t for t in texts]
        return texts


@lru_cache(maxsize=2)
def _codec(data: bytes) -> Codec:
    return Codec(data)


@lru_cache(maxsize=2)
def _reference(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def read_model(spark: SparkSession, path: str) -> bytes:
    """The model file, by Spark's own reader, so any store will do."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids, round_trip, parity.

    ``round_trip``: the ids decode to the normalised text. ``parity``: they equal those of the
    SentencePiece library on the same text. Null or empty text has no ids. Repeated rows are encoded
    each; further columns are ignored; an empty table gives an empty result. No shuffle; the model, a
    file of a few MB, is sent to every task.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_()), ("parity", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, reference = _codec(held.value), _reference(held.value)
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids, same = codec.encode(texts)
                parity = [a.tolist() == b for a, b in zip(ids, reference.encode(texts, num_threads=1))]
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets).astype(np.int64)), lists, pa.array(same), pa.array(parity)],
                    schema=schema,
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean, parity boolean")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id and text of rows with ids (doc_id, ids); null ids decode to empty text."""
    held = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = codec.decode([x or [] for x in part.column("ids").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
