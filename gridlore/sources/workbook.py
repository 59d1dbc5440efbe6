"""Folders of workbooks: the first sheet of each file, its first row as header.

Spark lists the files and hands one file to a task; the task reads the sheet row by row from
the zipped XML, so a workbook is never held as a table in memory.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlore.functions import exprs as X
from gridlore.operators.ordering import PATH_KEYS, ROW, freeze, path_keys, running_offsets
from gridlore.session import materialize

BATCH_ROWS = 10_000
# Number-format ids and letters that mark a cell as a date.
DATE_FORMAT_IDS = {*range(14, 23), *range(45, 48)}
DATE_LETTERS = re.compile(r"[dmyhs]", re.IGNORECASE)
EPOCH_1900 = dt.datetime(1899, 12, 30)
EPOCH_1904 = dt.datetime(1904, 1, 1)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(node) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def _column_index(reference: str) -> int:
    index = 0
    for letter in reference:
        if not letter.isalpha():
            break
        index = index * 26 + ord(letter.upper()) - 64
    return index - 1


class _Book:
    """What cells need from the rest of the file: shared texts, date styles, the date epoch."""

    def __init__(self, archive: zipfile.ZipFile):
        names = set(archive.namelist())
        self.shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for _, node in ElementTree.iterparse(archive.open("xl/sharedStrings.xml")):
                if _local(node.tag) == "si":
                    self.shared.append(_texts(node))
                    node.clear()
        self.date_styles = self._date_styles(archive) if "xl/styles.xml" in names else set()
        self.epoch, self.sheet = self._first_sheet(archive)

    @staticmethod
    def _date_styles(archive) -> set[int]:
        root = ElementTree.parse(archive.open("xl/styles.xml")).getroot()
        dates = set(DATE_FORMAT_IDS)
        for node in root.iter():
            if _local(node.tag) == "numFmt":
                code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", node.get("formatCode", ""))
                if DATE_LETTERS.search(code):
                    dates.add(int(node.get("numFmtId")))
        formats = next((n for n in root if _local(n.tag) == "cellXfs"), [])
        return {i for i, xf in enumerate(formats) if int(xf.get("numFmtId", "0")) in dates}

    @staticmethod
    def _first_sheet(archive) -> tuple[dt.datetime, str]:
        root = ElementTree.parse(archive.open("xl/workbook.xml")).getroot()
        from_1904 = any(_local(n.tag) == "workbookPr" and n.get("date1904") in ("1", "true") for n in root.iter())
        first = next(n for n in root.iter() if _local(n.tag) == "sheet")
        relation = next(v for k, v in first.attrib.items() if _local(k) == "id")
        links = ElementTree.parse(archive.open("xl/_rels/workbook.xml.rels")).getroot()
        target = next(n.get("Target") for n in links if n.get("Id") == relation)
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        return (EPOCH_1904 if from_1904 else EPOCH_1900), path

    def cell(self, node) -> str | None:
        kind, style = node.get("t", "n"), int(node.get("s", "0"))
        if kind == "inlineStr":
            return _texts(node)
        raw = next((n.text for n in node if _local(n.tag) == "v"), None)
        if raw is None:
            return None
        if kind == "s":
            return self.shared[int(raw)]
        if kind == "b":
            return "True" if raw == "1" else "False"
        if kind == "n" and style in self.date_styles:
            return (self.epoch + dt.timedelta(days=float(raw))).isoformat()
        return raw


def _sheet_rows(content: bytes) -> Iterator[tuple[int, list[str | None]]]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        book = _Book(archive)
        expected = 1
        for _, node in ElementTree.iterparse(archive.open(book.sheet)):
            if _local(node.tag) != "row":
                continue
            number = int(node.get("r", expected))
            while expected < number:
                yield expected - 1, []
                expected += 1
            cells: dict[int, str | None] = {}
            for place, cell in enumerate(c for c in node if _local(c.tag) == "c"):
                at = _column_index(cell.get("r")) if cell.get("r") else place
                cells[at] = book.cell(cell)
            yield number - 1, [cells.get(i) for i in range(max(cells, default=-1) + 1)]
            expected = number + 1
            node.clear()


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            held: list[tuple] = []
            for number, cells in _sheet_rows(content):
                held.append((path, number, cells))
                if len(held) == BATCH_ROWS:
                    yield pd.DataFrame(held, columns=["path", "number", "cells"])
                    held = []
            if held:
                yield pd.DataFrame(held, columns=["path", "number", "cells"])


def read_workbooks(spark: SparkSession, path: str | list[str], glob: str = "*.xl[st][xm]") -> DataFrame:
    """First sheets of all workbooks under ``path`` as one all-text table with ``ROW``.

    The header of the first file (by path) names the columns; a blank header becomes
    ``Unnamed: {i}``. Short rows are padded with nulls, long rows cut. All files must share the
    header. A file whose sheet is empty is an error. Each workbook is parsed once, by one task,
    and its cells are written to the shared folder.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    parsed = files.mapInPandas(_parse, "path string, number long, cells array<string>")
    cells = materialize(parsed.withColumns(path_keys("path")), "cells")
    headers = cells.where("number = 0").select("path", "cells")
    first = headers.orderBy("path").limit(1).collect()
    if not first:
        raise ValueError("The workbook has no rows.")
    header = F.array(*[F.lit(c).cast("string") for c in first[0].cells])
    other = headers.where(~F.col("cells").eqNullSafe(header)).limit(1).collect()
    if other:
        raise ValueError(f"{other[0].path} has another header than {first[0].path}.")
    names = [c if c and c.strip() else f"Unnamed: {i}" for i, c in enumerate(first[0].cells)]
    body = cells.where("number > 0")
    counts = body.groupBy("path", *PATH_KEYS).agg(F.count(F.lit(1)).alias("_n"))
    placed = body.join(freeze(running_offsets(counts, "path", "_n").select(*PATH_KEYS, "_before")), PATH_KEYS)
    columns = [f"nullif({X.strip(f'get(cells, {i})')}, '') AS {X.quote(n)}" for i, n in enumerate(names)]
    return placed.selectExpr(*columns, f"_before + number - 1 AS {ROW}")
