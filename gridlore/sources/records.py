"""Records of text files, cut by all tasks at once even where a line end doesn't end a record.

Spark deals a file out in byte ranges. Whether a range begins inside a quoted field (CSV) or inside a
string or an object (JSON) depends on all the text before it, so a first scan works out for every
range where it leads to from either state; the true states follow from a table of one row per
range. A second scan then cuts and parses the records of each range. What is left over at its ends
is put together by ranges, one record at a time. No file and no record kind is read by one task.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridlore.operators.ordering import MAX_OFFSET_BYTES, OFFSET_ROW_BYTES
from gridlore.session import materialize

RECORD, HEAD, TAIL, CLOSING = 0, 1, 2, 3
"""Kinds of cut rows: a whole record; text that ends, or that begins, one of another range; a range's verdict on what lies between records."""
CUT = "key long, start long, kind int, place long, width int, fields array<string>, text string"
_ROWS = 4096
_BLANK = " \t\r"


@contextmanager
def same_ranges(spark: SparkSession) -> Iterator[None]:
    """Scans of the same files inside are dealt out in the same ranges, though executors come or go between them."""
    name = "spark.sql.files.minPartitionNum"
    free = spark.conf.get(name, None) is None
    if free:
        spark.conf.set(name, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        if free:
            spark.conf.unset(name)


TASK_BYTES, TASKS_PER_CORE = 128 << 20, 8


def in_tasks(scan: DataFrame) -> DataFrame:
    """A scan of files in as few tasks as its bytes need, one range after the other, however small the ranges are."""
    spark = scan.sparkSession
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if size >= TASK_BYTES:
        return scan
    most = -(-scan.rdd.getNumPartitions() * size // TASK_BYTES)
    return scan.coalesce(max(most, TASKS_PER_CORE * spark.sparkContext.defaultParallelism))


def chunks(spark: SparkSession, path: str | list[str], end: str) -> DataFrame:
    """Text between ``end``s: file, key (its hash), start of the range, text, and whether it is valid UTF-8; in file order within a range."""
    read = spark.read.text(path, lineSep=end)
    valid = F.is_valid_utf8("value")
    found = read.select(
        F.col("_metadata.file_path").alias("file"),
        F.xxhash64("_metadata.file_path").alias("key"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"),
        F.when(valid, F.col("value")).alias("text"),
        valid.alias("valid"),
        F.octet_length("value").alias("bytes"),
    )
    return in_tasks(found)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Iterator[pa.RecordBatch]]]:
    """A task's rows by range, in order."""

    def pieces():
        for batch in batches:
            if not batch.num_rows:
                continue
            key, start = (batch.column(c).to_numpy() for c in ("key", "start"))
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (start[1:] != start[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                yield (int(key[a]), int(start[a])), batch.slice(a, b - a)

    for ident, group in groupby(pieces(), key=lambda p: p[0]):
        yield ident, (piece for _, piece in group)


class Quotes:
    """Where one line of delimited text leads to: into an open quoted field or not."""

    def __init__(self, sep: str):
        inside, field = r'[^"]*+(?:""[^"]*+)*+', f"[^{re.escape(sep)}]*+"
        open_field = rf'(?:(?:"{inside}"{field}|(?!"){field}){re.escape(sep)})*+"{inside}'
        self._opens = re.compile(open_field, re.S)
        self._stays = re.compile(rf'{inside}(?:"{field}{re.escape(sep)}{open_field})?', re.S)

    def opens(self, line: str) -> bool:
        """From outside a field, a quote at a field's start is still open at the end."""
        return self._opens.fullmatch(line) is not None

    def stays(self, line: str) -> bool:
        """From inside a quoted field, a quoted field, this or another, is open at the end."""
        return self._stays.fullmatch(line) is not None

    def after(self, line: str, inside: bool) -> bool:
        return self.stays(line) if inside else self.opens(line)


def csv_ranges(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    """One row per range: file, key, start, valid, first (its first line that isn't blank), opens (some line leaves a quote
    open), after_out and after_in (where the range leads from either state)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes = Quotes(sep)
        for (key, start), pieces in _ranges(batches):
            file, first, valid, opens, after = None, None, True, False, [False, True]
            for piece in pieces:
                lines = piece.column("text")
                file = file or piece.column("file")[0].as_py()
                valid = valid and bool(pc.all(piece.column("valid")).as_py())
                if first is None:
                    first = next((x for x in lines.to_pylist() if x and x.strip(_BLANK)), None)
                for line in lines.filter(pc.fill_null(pc.match_substring(lines, '"'), False)).to_pylist():
                    open_from_out = quotes.opens(line)
                    opens = opens or open_from_out
                    after = [quotes.stays(line) if inside else open_from_out for inside in after]
            yield pa.RecordBatch.from_pylist([{"file": file, "key": key, "start": start, "valid": valid, "first": first, "opens": opens, "after_out": after[0], "after_in": after[1]}], schema=schema)

    schema = pa.schema([("file", pa.string()), ("key", pa.int64()), ("start", pa.int64()), ("valid", pa.bool_()), ("first", pa.string()), ("opens", pa.bool_()), ("after_out", pa.bool_()), ("after_in", pa.bool_())])
    spelled = "file string, key long, start long, valid boolean, first string, opens boolean, after_out boolean, after_in boolean"
    return materialize(chunks(spark, path, "\n").mapInArrow(scan, spelled), "csv-ranges")


def with_states(lines: DataFrame, states: DataFrame) -> DataFrame:
    """Lines with their range's state, still in order: by broadcast up to a measured size, else by shuffle and sort.

    A range that has no state, because the scans cut a file differently, is an error: its lines would be lost.
    """
    known = states.withColumn("known", F.lit(True))
    if states.count() * OFFSET_ROW_BYTES <= MAX_OFFSET_BYTES:
        joined = lines.join(F.broadcast(known), ["key", "start"], "left")
    else:
        numbered = lines.withColumn("at", F.monotonically_increasing_id())
        joined = numbered.join(known, ["key", "start"], "left").repartition("key", "start").sortWithinPartitions("key", "start", "at").drop("at")
    moved = F.raise_error(F.lit("A file was dealt out in other ranges than before."))
    return joined.where(F.coalesce("known", moved.cast("boolean"))).drop("known")


def csv_records(spark: SparkSession, path: str | list[str], sep: str, ranges: DataFrame) -> DataFrame:
    """Records of files with line breaks inside quotes (CUT), written once; ``start`` is twice the byte its range begins at.

    ``ranges`` come from a scan of the same files, no more and no less: others would be dealt out in other ranges.
    """

    def states(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start")
        inside, found = False, []
        for after_out, after_in in zip(rows["after_out"], rows["after_in"]):
            found.append(inside)
            inside = bool(after_in if inside else after_out)
        # a quote that is never closed shows at the last range of the file
        return rows[["key", "start"]].assign(inside=found, unclosed=[False] * (len(found) - 1) + [inside])

    # one row per range of a file, which is its size over that of a range
    known = materialize(ranges.groupBy("key").applyInPandas(states, "key long, start long, inside boolean, unclosed boolean"), "csv-states")
    if known.where("unclosed").limit(1).count():
        raise ValueError("A quoted field is not closed before the end of the file.")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        quotes, out = Quotes(sep), _Out()
        for (key, start), pieces in _ranges(batches):
            lines = _lines(pieces)
            inside, head, place = None, [], 0
            for state, line in lines:
                inside = state
                if not inside:
                    lines = _chain(line, lines)
                    break
                head.append(line)
                if not quotes.stays(line):
                    break
            if head:
                yield from out.add(key, 2 * start, HEAD, 0, text="\n".join(head))
            taken: list[str] = []
            whole = True

            def feed():
                nonlocal whole
                for _, line in lines:
                    if not taken and not line.strip(_BLANK):
                        continue
                    taken.append(line)
                    yield line + "\n"
                whole = not taken  # asked for more inside a record

            for fields in csv.reader(feed(), delimiter=sep):
                if whole:
                    yield from out.add(key, 2 * start, RECORD, place, fields=fields)
                    place += 1
                else:
                    yield from out.add(key, 2 * start, TAIL, place, text="\n".join(taken))
                taken.clear()
        yield from out.flush()

    lines = chunks(spark, path, "\n").select("key", "start", "text")
    parsed = materialize(with_states(lines, known.select("key", "start", "inside")).mapInArrow(cut, CUT), "csv-records")
    parsed = in_tasks(parsed)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        out = _Out()
        for batch in batches:
            for row in batch.to_pylist():
                fields = next(csv.reader([x + "\n" for x in row["text"].split("\n")], delimiter=sep))
                yield from out.add(row["key"], row["start"], RECORD, 0, fields=fields)
        yield from out.flush()

    return parsed.where(F.col("kind") == RECORD).union(stitched(parsed, "\n").mapInArrow(parse, CUT))


def stitched(cut: DataFrame, between: str) -> DataFrame:
    """Records that reach over ranges: key, start (one more than that of the range they begin in), text.

    Ranges leave at most two texts each; a tail and the heads up to the next tail are one record.
    """
    ends = cut.where(F.col("kind").isin(HEAD, TAIL)).select("key", "start", "kind", "text")
    order = Window.partitionBy("key").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = ends.withColumn("record", F.count_if(F.col("kind") == TAIL).over(order))
    parts = F.array_sort(F.collect_list(F.struct("start", "kind", "text")))
    joined = numbered.groupBy("key", "record").agg((F.min("start") + 1).alias("start"), parts.alias("parts"))
    return joined.select("key", "start", F.array_join("parts.text", between).alias("text"))


def _lines(pieces: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, str]]:
    """Lines of a range, each with the state that the range begins in."""
    for piece in pieces:
        state = piece.column("inside")[0].as_py()
        for line in piece.column("text").to_pylist():
            yield state, line


def _chain(first: str, rest: Iterator):
    yield False, first
    yield from rest


class _Out:
    """Cut rows, handed on in batches."""

    SCHEMA = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("kind", pa.int32()), ("place", pa.int64()), ("width", pa.int32()), ("fields", pa.list_(pa.string())), ("text", pa.string())])

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, key: int, start: int, kind: int, place: int, fields: list[str] | None = None, text: str | None = None) -> Iterator[pa.RecordBatch]:
        self.rows.append((key, start, kind, place, None if fields is None else len(fields), fields, text))
        if len(self.rows) >= _ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.SCHEMA)], schema=self.SCHEMA)
            self.rows = []


class Braces:
    """Running state of JSON text: inside a string or not, and how many objects are open."""

    def __init__(self, in_string: bool, depth: int):
        self.in_string, self.depth = in_string, depth

    def advance(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of braces outside strings, and how many objects are open after each."""
        quotes = np.flatnonzero(data == ord('"'))
        if (data == ord("\\")).any():
            plain = np.flatnonzero(data != ord("\\"))
            before = np.searchsorted(plain, quotes) - 1
            run = quotes - 1 - np.where(before >= 0, plain[np.maximum(before, 0)], -1)
            quotes = quotes[run % 2 == 0]
        braces = np.flatnonzero((data == ord("{")) | (data == ord("}")))
        braces = braces[(np.searchsorted(quotes, braces) + self.in_string) % 2 == 0]
        depth = self.depth + np.cumsum(np.where(data[braces] == ord("{"), 1, -1))
        self.in_string ^= bool(len(quotes) % 2)
        self.depth = int(depth[-1]) if len(depth) else self.depth
        return braces, depth


# What may stand between records: documents are objects or arrays of objects. Each token leads from one state to the next.
OUTSIDE, OPENED, AFTER, COMMA, WRONG = range(5)
_STEPS = {
    "{": (OUTSIDE, AFTER, WRONG, AFTER, WRONG), "[": (OPENED, WRONG, WRONG, WRONG, WRONG),
    "]": (WRONG, OUTSIDE, OUTSIDE, WRONG, WRONG), ",": (WRONG, WRONG, COMMA, WRONG, WRONG),
}


def _piece(texts: pa.Array, closed: bool) -> bytes:
    return b"}".join((x or "").encode() for x in texts.to_pylist()) + b"}" * closed


def json_records(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Objects of JSON files, whether they follow each other or are elements of arrays, as text (CUT), written once; and (key, file)."""
    schema = pa.schema([("file", pa.string()), ("key", pa.int64()), ("start", pa.int64()), ("valid", pa.bool_()), ("bytes", pa.int64()), ("size", pa.int64()), ("string_out", pa.bool_()), ("depth_out", pa.int64()), ("string_in", pa.bool_()), ("depth_in", pa.int64())])
    spelled = "file string, key long, start long, valid boolean, bytes long, size long, string_out boolean, depth_out long, string_in boolean, depth_in long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, start), pieces in _ranges(batches):
            sides, valid, read, size, file = (Braces(False, 0), Braces(True, 0)), True, 0, 0, None
            for piece in pieces:
                file = file or piece.column("file")[0].as_py()
                valid = valid and bool(pc.all(piece.column("valid")).as_py())
                read += pc.sum(piece.column("bytes")).as_py() + piece.num_rows
                size = piece.column("size")[0].as_py()
                data = np.frombuffer(_piece(piece.column("text"), True), dtype=np.uint8)
                for side in sides:
                    side.advance(data)
            row = {"file": file, "key": key, "start": start, "valid": valid, "bytes": read, "size": size, "string_out": sides[0].in_string, "depth_out": sides[0].depth, "string_in": sides[1].in_string, "depth_in": sides[1].depth}
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    def states(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start")
        in_string, depth, found = False, 0, []
        for side in rows[["string_out", "depth_out", "string_in", "depth_in"]].itertuples(index=False):
            found.append((in_string, depth))
            in_string, depth = (side.string_in, depth + side.depth_in) if in_string else (side.string_out, depth + side.depth_out)
        # every chunk counts as closed by a brace; if the last one isn't, one brace too many was counted, and the bytes say so
        bare = depth == -1
        size, read = int(rows["size"].iloc[0]), int(rows["bytes"].sum())
        broken = in_string or depth not in (0, -1) or size - read in ((0, 3) if bare else (-1, 2)) or not rows["valid"].all()
        last = [False] * (len(found) - 1)
        return rows[["file", "key", "start"]].assign(in_string=[s for s, _ in found], depth=[d for _, d in found], bare=[*last, bare], broken=[*last, bool(broken)])

    ranges = chunks(spark, path, "}").mapInArrow(scan, spelled)
    known = materialize(ranges.groupBy("key").applyInPandas(states, "file string, key long, start long, in_string boolean, depth long, bare boolean, broken boolean"), "json-states")
    if known.where("broken").limit(1).count():
        raise ValueError("A file is not valid UTF-8, or ends inside a record.")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out()
        for (key, start), pieces in _ranges(batches):
            state, held, place, closing = None, [], 0, list(range(5))
            for piece, final in _last(pieces):
                if state is None:
                    state = Braces(piece.column("in_string")[0].as_py(), piece.column("depth")[0].as_py())
                    kind = HEAD if state.depth else RECORD
                raw = _piece(piece.column("text"), not (final and piece.column("bare")[0].as_py()))
                before = state.depth
                braces, depth = state.advance(np.frombuffer(raw, dtype=np.uint8))
                previous = np.concatenate([[before], depth[:-1]])
                begins = braces[(previous == 0) & (depth == 1)].tolist()
                ends = (braces[(previous == 1) & (depth == 0)] + 1).tolist()
                at = 0
                if before:  # in the middle of a record
                    if not ends:
                        held.append(raw)
                        continue
                    at = ends.pop(0)
                    yield from out.add(key, 2 * start, kind, place, text=b"".join([*held, raw[:at]]).decode())
                    closing = _then(closing, "{")
                    held, kind, place = [], RECORD, place + 1
                for a, b in zip(begins, [*ends, len(raw)]):
                    closing = _then(closing, raw[at:a].decode())
                    if len(ends) < len(begins) and a == begins[-1]:
                        held = [raw[a:]]
                        break
                    yield from out.add(key, 2 * start, kind, place, text=raw[a:b].decode())
                    closing = _then(closing, "{")
                    place, at = place + 1, b
                else:
                    closing = _then(closing, raw[at:].decode())
            if held:
                yield from out.add(key, 2 * start, HEAD if kind == HEAD else TAIL, place, text=b"".join(held).decode())
            yield from out.add(key, 2 * start, CLOSING, place, text="".join(map(str, closing)))
        yield from out.flush()

    lines = chunks(spark, path, "}").select("key", "start", "text")
    parsed = materialize(with_states(lines, known.drop("file", "broken")).mapInArrow(cut, CUT), "json-records")
    parsed = in_tasks(parsed)

    def verdict(rows: pd.DataFrame) -> pd.DataFrame:
        state = OUTSIDE
        for steps in rows.sort_values("start")["text"]:
            state = int(steps[state])
        return pd.DataFrame({"key": rows["key"].iloc[:1], "ends": [state]})

    wrong = parsed.where(F.col("kind") == CLOSING).groupBy("key").applyInPandas(verdict, "key long, ends int").where(F.col("ends") != OUTSIDE)
    if wrong.limit(1).count():
        raise ValueError("A file holds something else than objects and arrays of objects.")
    whole = stitched(parsed, "").selectExpr("key", "start", f"{RECORD} AS kind", "0L AS place", "NULL AS width", "NULL AS fields", "text")
    return parsed.where(F.col("kind") == RECORD).union(whole), known.select("key", "file").distinct()


def _then(steps: list[int], text: str) -> list[int]:
    """Where each state leads to after the tokens of ``text`` too."""
    for c in text:
        if not c.isspace():
            step = _STEPS.get(c, (WRONG,) * 5)
            steps = [step[s] for s in steps]
    return steps


def _last(items: Iterator) -> Iterator[tuple]:
    """Items, and whether each is the last."""
    item = next(items)
    for following in items:
        yield item, False
        item = following
    yield item, True
