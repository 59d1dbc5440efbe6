"""Readers. Each returns the table with its source order in the ``ROW`` column."""

from __future__ import annotations

import csv
import json
import re
import sys
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from gridlore.functions import exprs as X
from gridlore.operators.ordering import ROW, SLOT_BITS, file_rows, free_name, freeze
from gridlore.session import materialize, scratch_path, small_frame
from gridlore.sources import records

# Texts that stand for a missing value in delimited files.
NA_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Parquet scan; row numbers come from file metadata, so there is no shuffle."""
    return file_rows(spark.read.parquet(*([path] if isinstance(path, str) else path)))


def read_csv(
    spark: SparkSession, path: str | list[str], multi_line: bool | None = None, sep: str = ","
) -> DataFrame:
    """Delimited text with a header row, every column as text, missing-value texts as null.

    Columns of several files are matched by name; files whose names differ are an error. A blank name
    becomes ``Unnamed: {i}``, a repeated one gets ``.1``. Missing fields at a row's end are null; a row of more fields
    than the header, bytes that aren't UTF-8 and a quote that is never closed are errors. Files with line breaks
    inside quotes (``multi_line``, found out per file by default) are cut into records by all tasks, others are
    split at line ends. A file without any content is an error; a header alone gives an empty
    table. The parsed rows are written once to the shared folder.
    """
    with records.same_ranges(spark):
        return _read_csv(spark, path, multi_line, sep)


def _read_csv(spark: SparkSession, path: str | list[str], multi_line: bool | None, sep: str) -> DataFrame:
    ranges = records.csv_ranges(spark, path, sep)
    first = F.min_by("first", F.when(F.col("first").isNotNull(), F.col("start")))
    files = materialize(ranges.groupBy("file", "key").agg(first.alias("first"), F.bool_or("opens").alias("opens"), F.bool_and("valid").alias("valid")), "csv-files")
    broken = files.where("NOT valid").select("file").first()
    if broken:
        raise ValueError(f"{broken.file} is not UTF-8 text.")
    files = files.where("first IS NOT NULL")
    whole = F.col("opens") if multi_line is None else F.lit(multi_line)
    scans = [_plain_lines(spark, path, paths, names, sep) for names, paths in _headers(files.where(~whole), sep)]
    quoted = [f.path for f in files.where(whole).select(_path_of("file")).orderBy("path").collect()]
    if quoted:
        if len(spark.read.text(path)._jdf.inputFiles()) > len(quoted):  # fewer files may be dealt out in smaller ranges
            ranges = records.csv_ranges(spark, quoted, sep)
        scans.append(_quoted_records(spark, path, quoted, sep, ranges))
    if not scans:
        raise ValueError("The file has no content.")
    if len({frozenset(s.columns[: -len(ORIGIN)]) for s in scans}) > 1:
        raise ValueError("The files do not have the same columns.")
    return number_rows(scans, sep)


def _path_of(file: str) -> Column:
    """A path as readers take it: they come percent-encoded, and some characters would be patterns."""
    plain = F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, r"([\[\]{}*?\\])", r"\\$1").alias("path")


def _base(spark: SparkSession, path: str | list[str]) -> dict[str, str]:
    """Options under which columns that folder names hold stay columns."""
    if not isinstance(path, str) or re.search(r"[\[\]{}*?]", path):
        return {}
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = place.getFileSystem(spark._jsc.sc().hadoopConfiguration()).getFileStatus(place).isDirectory()
    return {"basePath": path} if folder else {}


def header_names(fields: list[str]) -> list[str]:
    """Column names from a header: blank ones numbered, repeated ones (of either case, as Spark sees names) with ``.1``, ``.2``."""
    taken, names = {ROW}, []
    for i, field in enumerate(fields):
        name = wanted = field if field.strip() else f"Unnamed: {i}"
        k = 0
        while name.lower() in taken:
            k += 1
            name = f"{wanted}.{k}"
        taken.add(name.lower())
        names.append(name)
    return names


def _headers(files: DataFrame, sep: str) -> list[tuple[list[str], list[str]]]:
    """Files with the same columns in the same order: (names, paths). One row per file reaches the driver, which lists them for the scan anyway."""
    forms: dict[tuple[str, ...], list[str]] = {}
    for f in files.select("first", _path_of("file")).orderBy("path").collect():
        fields = next(csv.reader([f["first"].removeprefix("\ufeff").rstrip("\r")], delimiter=sep))
        forms.setdefault(tuple(header_names(fields)), []).append(f["path"])
    return [(list(names), paths) for names, paths in forms.items()]


def _texts(columns: dict[str, str]) -> list[str]:
    """Columns by name from expressions, missing-value texts as null."""
    na = ", ".join(X.text(t) for t in NA_TEXTS)
    return [f"CASE WHEN {value} NOT IN ({na}) THEN {value} END AS {X.quote(name)}" for name, value in columns.items()]


def _plain_lines(spark: SparkSession, path: str | list[str], paths: list[str], names: list[str], sep: str) -> DataFrame:
    """Files in which each line is a record."""
    odd = free_name("odd", names)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, odd]])
    raw = spark.read.options(**_base(spark, path)).schema(schema).csv(
        paths, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=odd, sep=sep, escape='"', quote='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    folders = [X.quote(c) for c in raw.columns if c not in (*names, odd)]
    return _with_origin(raw, [*_texts({c: X.quote(c) for c in names}), *folders], odd, len(names))


def _quoted_records(spark: SparkSession, path: str | list[str], paths: list[str], sep: str, ranges: DataFrame) -> DataFrame:
    """Files with line breaks inside quotes."""
    cut = records.csv_records(spark, paths, sep, ranges)
    firsts = cut.where("place = 0").groupBy("key").agg(F.min_by("fields", "start").alias("header"), F.min("start").alias("top"))
    named = ranges.select("key", "file").distinct()
    heads = materialize(firsts.join(named, "key"), "csv-headers")
    forms = {}
    for row in heads.select("header").distinct().collect():  # one row per distinct header
        fields = [row.header[0].removeprefix("\ufeff"), *row.header[1:]]
        forms[tuple(row.header)] = header_names(fields)
    columns = next(iter(forms.values()))
    if any(set(names) != set(columns) for names in forms.values()):
        raise ValueError("The files do not have the same columns.")
    if cut.agg(F.max("width")).first()[0] > len(columns):
        raise ValueError("A row has more fields than the header.")
    order = F.coalesce(*[F.when(F.col("header") == F.array(*map(F.lit, header)), F.array(*[F.lit(names.index(c)) for c in columns])) for header, names in forms.items()])
    heads = heads.withColumn("order", order).drop("header")
    folders = _folder_columns(spark, path, paths)
    if folders is not None:
        heads = heads.join(folders, "file")
    rows = cut.join(F.broadcast(heads) if heads.count() <= MAX_FILES else heads, "key").where("NOT (start = top AND place = 0)")
    data, extra = {c: f"get(fields, order[{i}])" for i, c in enumerate(columns)}, folders.columns[1:] if folders is not None else []
    return rows.selectExpr(*_texts(data), *map(X.quote, extra), *_origin([*columns, *extra], "file", "start", "place"))


def _folder_columns(spark: SparkSession, path: str | list[str], paths: list[str]) -> DataFrame | None:
    """(file, columns that folder names hold), or None if there are none."""
    text = spark.read.options(**_base(spark, path)).text(paths)
    extra = [c for c in text.columns if c != "value"]
    if not extra:
        return None
    return text.select(F.col("_metadata.file_path").alias("file"), *[F.col(X.quote(c)) for c in extra]).distinct()


def read_json(spark: SparkSession, path: str | list[str], multi_line: bool | None = None) -> DataFrame:
    """JSON records: objects that follow each other, over as many lines as they like, and arrays of objects.

    Nested values become JSON text. Any number of documents may stand in a file; each file is cut
    into records by all tasks. Text that is no record, a file that ends inside one and bytes that aren't UTF-8
    are errors. A column whose type differs between records is a double if all are numbers,
    else text as written. The parsed rows are written once to the shared folder. ``multi_line`` is
    accepted and makes no difference.
    """
    try:
        with records.same_ranges(spark):
            cut, files = records.json_records(spark, path)
        strict = {"mode": "FAILFAST"}
        schema = _schema_of(spark, cut.select("text"), strict)
        if not schema.fields:
            raise ValueError("no columns")
        names = [f.name for f in schema.fields]
        folders = _folder_columns(spark, path, [path] if isinstance(path, str) else path)
        if folders is not None:
            files = files.join(folders, "file")
        extra = [c for c in files.columns if c not in ("key", "file")]
        files = materialize(files, "json-files")
        # the reader of JSON lines keeps values as written, so records become lines, with where they come from in their text
        helpers = {c: free_name(c, [*names, *extra]) for c in ("key", "start", "place", "file")}
        origin = {c: helpers[c] for c in ("key", "start", "place")}
        lead = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f"{json.dumps(n)}:"), F.col(c)) for c, n in origin.items()]))
        rest = F.expr("ltrim(' \t\r\n', substr(text, 2))")
        lines = scratch_path(spark, "json-lines")
        cut.select(F.translate(F.concat(lead, F.when(rest.startswith("}"), F.lit("")).otherwise(F.lit(",")), rest), "\r\n", "  ")).write.text(lines)
        whole = T.StructType([*schema.fields, *[T.StructField(n, T.LongType()) for n in origin.values()]])
        found = files.toDF(*[helpers.get(c, c) for c in files.columns])
        rows = records.in_tasks(spark.read.options(**strict).schema(whole).json(lines)).join(F.broadcast(found) if found.count() <= MAX_FILES else found, helpers["key"])
        nested = (T.ArrayType, T.MapType, T.StructType)
        kept = header_names(names)
        flat = [f"{f'to_json({X.quote(f.name)})' if isinstance(f.dataType, nested) else X.quote(f.name)} AS {X.quote(name)}" for f, name in zip(schema.fields, kept)]
        return number_rows([rows.selectExpr(*flat, *map(X.quote, extra), *_origin([*kept, *extra], *[X.quote(helpers[c]) for c in ("file", "start", "place")]))])
    except AnalysisException:
        raise
    except Exception as error:
        raise ValueError("The JSON cannot be parsed.") from error


def _schema_of(spark: SparkSession, texts: DataFrame, options: dict[str, str]) -> T.StructType:
    """What JSON texts, one record each, hold."""
    values = getattr(texts._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(spark.read.options(**options)._jreader.json(values), spark).schema


MAX_FILES = 1 << 20
"""Files whose names (some 200 bytes each) are broadcast; more are joined by shuffle."""
ORIGIN = ("file", "start", "part", "slot", "odd", "width")
"""What rows carry until they are numbered: where they come from, and the whole line if it hasn't as many fields as the header."""


def _origin(columns: list[str], file: str, start: str, place: str) -> list[str]:
    """Origin of rows that a table already numbers within their range."""
    values = {"file": file, "start": start, "part": "-1L", "slot": place, "odd": "CAST(NULL AS STRING)", "width": "0"}
    return [f"{values[c]} AS {X.quote(free_name(c, columns))}" for c in ORIGIN]


def _with_origin(raw: DataFrame, columns: list[str], odd: str, width: int) -> DataFrame:
    """``columns`` of a scan with the file and split each row comes from, and its place in the task that writes it."""
    taken = [c for c in raw.columns if c != odd]
    slot = "monotonically_increasing_id()"
    values = {"file": "_metadata.file_path", "start": "_metadata.file_block_start", "part": f"shiftright({slot}, {SLOT_BITS})", "slot": slot, "odd": X.quote(odd), "width": f"{width}"}
    return raw.selectExpr(*columns, *[f"{values[c]} AS {X.quote(free_name(c, taken))}" for c in ORIGIN])


def number_rows(scans: list[DataFrame], sep: str = ",") -> DataFrame:
    """Write scans of text files, which have no row index, and attach ``ROW`` to the copy.

    File, split and place are captured by the job that writes the rows, so it does not matter how a
    later scan of the text would cut it. A table of one row per split gives the rows before it; it
    is matched by task and a hash of the split, so no path is broadcast.
    """
    named = [scan.columns[: -len(ORIGIN)] for scan in scans]
    columns = list(dict.fromkeys(c for names in named for c in names))
    file, start, part, slot, odd, width = origin = [free_name(c, columns) for c in ORIGIN]
    scans = [scan.toDF(*names, *origin) for scan, names in zip(scans, named)]
    merged = reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), scans)
    stored = materialize(merged, "text-rows")
    _no_long_lines(stored.where(F.col(odd).isNotNull()).select(F.col(odd).alias("line"), F.col(width).alias("width")), sep)
    split, before, shift, first, n = (free_name(c, [*columns, *stored.columns]) for c in ("split", "before", "shift", "first", "n"))
    keyed = stored.drop(odd, width).withColumn(split, F.xxhash64(file, start))
    splits = records.in_tasks(keyed).groupBy(part, split, file, start).agg(F.count(F.lit(1)).alias(n), F.min(slot).alias(first))
    earlier = Window.orderBy(file, start).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(n).over(earlier), F.lit(0).cast("long"))
    offsets = splits.select(part, split, (offset - F.col(first)).alias(shift))
    return keyed.join(freeze(offsets), [part, split]).withColumn(ROW, F.col(slot) + F.col(shift)).select(*[F.col(X.quote(c)) for c in columns], ROW)


def _no_long_lines(lines: DataFrame, sep: str = ",") -> None:
    """An error if one of the lines that differ from the header in length has more fields."""

    def longer(batches):
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            rows = batch.to_pylist()
            wide = [len(next(csv.reader([r["line"].rstrip("\r\n")], delimiter=sep), [])) > r["width"] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["line"][:200] for r, w in zip(rows, wide) if w], pa.string())], names=["line"])

    found = lines.mapInArrow(longer, "line string").first()
    if found:
        raise ValueError(f"A row has more fields than the header: {found.line}")


def from_rows(spark: SparkSession, columns: list[str], rows: list[dict]) -> DataFrame:
    """Typed-in rows: the named columns in order, absent ones null, blank rows left out.

    Without column names the keys are used in order of first appearance. A blank name becomes
    ``column_{i}``. Values keep their type when a column has one type, else become text.
    """
    asked = columns or list(dict.fromkeys(k for row in rows for k in row))
    names = [c.strip() or f"column_{i}" for i, c in enumerate(asked, start=1)]
    blank = (None, "")

    def tidy(value):
        return value.strip() if isinstance(value, str) else value

    kept = [[tidy(row.get(c)) for c in asked] for row in rows]
    kept = [values for values in kept if any(v not in blank for v in values)]
    if not kept:
        raise ValueError("At least one row with a value is needed.")
    fields = []
    for i, name in enumerate(names):
        kinds = {type(values[i]) for values in kept} - {type(None)}
        types = {frozenset({bool}): T.BooleanType(), frozenset({int}): T.LongType()}
        numeric = T.DoubleType() if kinds and kinds <= {int, float} else T.StringType()
        dtype = types.get(frozenset(kinds), numeric)
        cast = {T.DoubleType: float, T.StringType: _plain}.get(type(dtype), lambda v: v)
        for values in kept:
            values[i] = None if values[i] is None else cast(values[i])
        fields.append(T.StructField(name, dtype))
    schema = T.StructType([*fields, T.StructField(ROW, T.LongType())])
    return small_frame(spark, [(*values, i) for i, values in enumerate(kept)], schema)


def _plain(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value, default=str)
