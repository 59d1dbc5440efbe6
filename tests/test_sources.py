"""Readers, staging and fingerprints."""

from __future__ import annotations

import csv
import json
import os
import random
import zipfile

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gridlore.operators.ordering import ROW
from gridlore.operators.profile import describe_columns
from gridlore.plans.queries import write_workbook
from gridlore.session import scratch_path
from gridlore.sources import readers, records, staging
from gridlore.sources.workbook import read_workbooks


def write(tmp_path, name, content):
    (tmp_path / name).write_text(content)
    return str(tmp_path / name)


def test_csv_missing_texts_and_order(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'a,b c\n1,"x, y"\nNA,nan\n , z \nNULL,"say ""hi"""\n')
    df = readers.read_csv(spark, path).orderBy(ROW)
    assert [tuple(r) for r in df.collect()] == [
        ("1", "x, y", 0), (None, None, 1), (" ", " z ", 2), (None, 'say "hi"', 3),
    ]


def test_csv_line_breaks_inside_quotes(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'a,b\n1,"two\nlines"\n2,x\n')
    assert [r.b for r in readers.read_csv(spark, path).orderBy(ROW).collect()] == ["two\nlines", "x"]


def test_csv_without_rows(spark, tmp_path):
    header = readers.read_csv(spark, write(tmp_path, "h.csv", "a,b\n"))
    assert header.columns == ["a", "b", ROW] and header.count() == 0
    with pytest.raises(ValueError):
        readers.read_csv(spark, write(tmp_path, "e.csv", ""))


def test_csv_rows_across_splits(spark, tmp_path):
    path = write(tmp_path, "a.csv", "n,pad\n" + "".join(f"{i},{'x' * 90}\n" for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 40_000)
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 3
        df = readers.read_csv(spark, path)
        assert df.where(F.col(ROW) != F.col("n").cast("long")).count() == 0 and df.count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize(
    "content",
    ['[{"a": 1, "b": {"c": [1]}},\n {"a": 2, "b": null}]', '{"a": 1, "b": {"c": [1]}}\n{"a": 2, "b": null}\n'],
    ids=["array", "lines"],
)
def test_json(spark, tmp_path, content):
    df = readers.read_json(spark, write(tmp_path, "a.json", content)).orderBy(ROW)
    assert [(r.a, r.b) for r in df.collect()] == [(1, '{"c":[1]}'), (2, None)]


def test_json_broken(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.read_json(spark, write(tmp_path, "a.json", "not json at all")).collect()


def test_json_forms_may_differ_by_file(spark, tmp_path):
    write(tmp_path, "1.json", '[{"a": 1, "b": 1.50},\n {"a": 2},\n {"a": 3, "c": {"d": 1}}]')
    write(tmp_path, "2.json", '\n{"a": 4.5}\n{"a": 5, "b": "x"}\n\t{"a": 6, "c": [1]} \n')
    df = readers.read_json(spark, str(tmp_path)).orderBy(ROW)
    assert [(r.a, r.b, r.c, r[ROW]) for r in df.collect()] == [
        (1.0, "1.50", None, 0), (2.0, None, None, 1), (3.0, None, '{"d": 1}', 2),
        (4.5, None, None, 3), (5.0, "x", None, 4), (6.0, None, "[1]", 5),
    ]


def test_json_bad_record_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.read_json(spark, write(tmp_path, "a.json", '{"a": 1}\n{"a": \n{"a": 3}\n'))


def test_csv_columns_are_matched_by_name(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "1 [x]+%.csv", "a,b c\n10,20\n")
    write(tmp_path / "in", "2.csv", "b c,a\n21,11\n")
    write(tmp_path / "in", "3.csv", 'a,b c\n12,"2\n2"\n13,2" pipe\n')
    df = readers.read_csv(spark, str(tmp_path / "in")).orderBy(ROW)
    assert [tuple(r) for r in df.collect()] == [
        ("10", "20", 0), ("11", "21", 1), ("12", "2\n2", 2), ("13", '2" pipe', 3),
    ]
    write(tmp_path / "in", "4.csv", "a,z\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "in"))


def test_csv_rows_survive_other_split_settings(spark, tmp_path):
    path = write(tmp_path, "a.csv", "n,pad\n" + "".join(f"{i},{'x' * 90}\n" for i in range(4000)))
    df = readers.read_csv(spark, path)
    spark.conf.set("spark.sql.files.minPartitionNum", 11)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        assert df.where(F.col(ROW) == F.col("n").cast("long")).count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.fixture
def small_ranges(spark):
    """Files are dealt out in ranges of 4,000 bytes."""
    settings = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def awkward_rows(n, seed):
    """Cells with line breaks, quotes, separators and texts longer than a range."""
    pick = random.Random(seed)
    kinds = ["plain", "two\nlines", 'say "hi"', "a,b", 'x"', "\n", '"\n"', "\r\n", "é", '","', "long " * 1000, 'q"\n' * 1500, " spaced ", "0"]
    return [[str(i), *(pick.choice(kinds) for _ in range(3))] for i in range(n)]


@pytest.fixture()
def no_open_cost(spark):
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_quoted_files_beside_larger_ones(spark, tmp_path, no_open_cost):
    """The quoted file alone is dealt out in smaller ranges than beside a file of plain lines or an empty one."""
    write(tmp_path, "a.csv", "a,b\n" + "".join(f"{i},plain {i}\n" for i in range(60_000)))
    write(tmp_path, "b.csv", "a,b\n" + "".join(f'q{i},"two\nlines"\n' for i in range(4_000)))
    write(tmp_path, "c.csv", "")
    read = readers.read_csv(spark, str(tmp_path))
    assert read.count() == read.select("a").distinct().count() == 64_000
    assert read.where("b = 'two\nlines'").count() == 4_000
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_ranges_without_a_state_are_errors(spark, tmp_path, no_open_cost):
    path = write(tmp_path, "b.csv", "a,b\n" + "".join(f'q{i},"two\nlines"\n' for i in range(4_000)))
    ranges = records.csv_ranges(spark, path, ",")
    assert ranges.count() > 1
    with pytest.raises(Exception, match="other ranges"):
        records.csv_records(spark, path, ",", ranges.where("start = 0").withColumn("after_out", F.lit(False)))


@pytest.mark.parametrize("seed", range(2))
def test_csv_records_over_ranges(spark, tmp_path, small_ranges, seed):
    rows = awkward_rows(60, seed)
    with open(tmp_path / "a.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n" if seed else "\r\n").writerows([["n", "a", "b", "c"], *rows])
    ranges = records.csv_ranges(spark, str(tmp_path / "a.csv"), ",")
    assert ranges.count() > 5 and records.chunks(spark, str(tmp_path / "a.csv"), "\n").rdd.getNumPartitions() > 5
    got = readers.read_csv(spark, str(tmp_path)).orderBy(ROW).collect()
    assert [tuple(r)[:4] for r in got] == [tuple(r) for r in rows] and [r[ROW] for r in got] == list(range(60))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='",\na ', max_size=40), st.text(alphabet='",a ', max_size=12))
def test_quote_states_agree_with_the_parser(before, line):
    """A line leaves a quote open just when the parser asks for more."""

    def open_after(lines):
        asked = []

        def feed():
            for x in lines:
                asked.append(x)
                yield x + "\n"
            asked.append(None)

        count = 0
        for _ in csv.reader(feed()):
            if asked[-1] is None:
                return True
            count = len(asked)
        return count < len(lines)

    quotes, inside = records.Quotes(","), False
    lines = [*before.split("\n"), line]
    for k, x in enumerate(lines):
        inside = quotes.after(x, inside)
        assert inside == open_after(lines[: k + 1])


def test_csv_faults_are_errors(spark, tmp_path):
    def read(name, content):
        (tmp_path / name).write_bytes(content)
        return readers.read_csv(spark, str(tmp_path / name))

    for name, content in {"wide": b"a,b\n1,2,3\n", "wide_quoted": b'a,b\n"1\n1",2,3\n', "wide_stray": b'a,b\n2" x,y,3" z\n', "latin": b"a,b\nx,caf\xe9\n", "unclosed": b'a,b\n1,"x\n2,y\n'}.items():
        with pytest.raises(ValueError):
            read(name, content)
    assert [tuple(r) for r in read("short", b"a,b,c\n1,2\n1,,\n\n  \n3\n").orderBy(ROW).collect()] == [("1", "2", None, 0), ("1", None, None, 1), ("3", None, None, 2)]
    assert [tuple(r) for r in read("short2", b'a,b,c\n1,"2\n2"\n\n3\n').orderBy(ROW).collect()] == [("1", "2\n2", None, 0), ("3", None, None, 1)]


@pytest.mark.parametrize("row", ["1,2,3,4,5,6", '1,"2\n",3,4,5,6'])
def test_csv_names(spark, tmp_path, row):
    df = readers.read_csv(spark, write(tmp_path, "a.csv", "a,a,,_file,_row,_slot\n" + row + "\n"))
    assert df.columns == ["a", "a.1", "Unnamed: 2", "_file", "_row.1", "_slot", ROW] and df.count() == 1
    assert [x.strip() for x in df.first()[:6]] == ["1", "2", "3", "4", "5", "6"]


def test_csv_folder_columns_and_forms_mix(spark, tmp_path):
    for year, text in {"2020": 'b,a\n"x\ny",1\n', "2021": "a,b\n2,z\n", "2022": 'a,b\n3,"u\nv"\n'}.items():
        (tmp_path / f"year={year}").mkdir()
        write(tmp_path / f"year={year}", "f.csv", text)
    df = readers.read_csv(spark, str(tmp_path)).orderBy(ROW)
    assert [(r.a, r.b, str(r.year), r[ROW]) for r in df.collect()] == [("1", "x\ny", "2020", 0), ("2", "z", "2021", 1), ("3", "u\nv", "2022", 2)]


JSON_ROWS = [{"a": i, "t": t, "o": {"x": [i], "y": {"z": "}"}}} for i, t in enumerate(['"', "\\", "{[,", "}\\\\" * 70, "é", "x" * 5000, "a\nb", '\\"', ""] * 9)]


@pytest.mark.parametrize("form", ["array", "line", "pretty", "documents", "arrays", "lines"])
def test_json_records_over_ranges(spark, tmp_path, small_ranges, form):
    one = [json.dumps(r, ensure_ascii=form == "lines") for r in JSON_ROWS]
    content = {
        "array": json.dumps(JSON_ROWS, indent=1), "line": json.dumps(JSON_ROWS), "pretty": "\n".join(json.dumps(r, indent=2) for r in JSON_ROWS),
        "documents": "".join(one), "arrays": f"[{','.join(one[:9])}]\n[] [{','.join(one[9:])}]", "lines": "\n".join(one) + "\n",
    }[form]
    path = write(tmp_path, "a.json", content)
    assert records.chunks(spark, path, "}").rdd.getNumPartitions() > 5
    got = readers.read_json(spark, path).orderBy(ROW).collect()
    assert [(r.a, r.t, json.loads(r.o)) for r in got] == [(r["a"], r["t"], r["o"]) for r in JSON_ROWS] and [r[ROW] for r in got] == list(range(81))


@pytest.mark.parametrize(
    "content",
    ['[{"a":1}] x', '[{"a":1},]', '[{"a":1} {"a":2}]', '{"a":1},{"a":2}', '[{"a":1}', '{"a":1', '{"a":{"b":1}', '[[{"a":1}]]', '{"a":1}}', '[{"a":1}]]', '{"a": x}', '{"a":"b}', '[1, 2]', '{"a":1} 5'],
)
def test_json_faults_are_errors(spark, tmp_path, content):
    with pytest.raises(ValueError):
        readers.read_json(spark, write(tmp_path, "a.json", content))


def test_json_documents_and_names(spark, tmp_path):
    path = write(tmp_path, "a.json", '{"a":4,\n"b":1}\n{"a":5,\n"b":2}')
    assert [(r.a, r.b) for r in readers.read_json(spark, path).orderBy(ROW).collect()] == [(4, 1), (5, 2)]
    path = write(tmp_path, "b.json", '{"_file":1,"_row":2}{"_file":3,"_row":4,"part":5}')
    df = readers.read_json(spark, path).orderBy(ROW)
    assert df.columns == ["_file", "_row.1", "part", ROW] and [tuple(r) for r in df.collect()] == [(1, 2, None, 0), (3, 4, 5, 1)]


def test_parquet_keeps_its_row_numbers(spark, tmp_path):
    spark.createDataFrame([(5, "x"), (6, "y")], f"{ROW} long, v string").coalesce(1).write.parquet(str(tmp_path / "p"))
    assert [(r[ROW], r.v) for r in readers.read_parquet(spark, str(tmp_path / "p")).orderBy(ROW).collect()] == [(5, "x"), (6, "y")]


def test_manual_rows(spark):
    rows = [{"region": " North ", "sales": "12"}, {"region": "", "sales": " "}, {"sales": "9", "extra": "x"}]
    df = readers.from_rows(spark, ["region", "sales", " "], rows)
    assert df.columns == ["region", "sales", "column_3", ROW]
    assert [tuple(r) for r in df.collect()] == [("North", "12", None, 0), (None, "9", None, 1)]
    typed = readers.from_rows(spark, [], [{"a": 1, "b": 1.5, "c": True, "d": [1]}, {"a": 2, "b": 2, "c": None, "d": None}])
    assert [f.dataType.simpleString() for f in typed.schema.fields] == ["bigint", "double", "boolean", "string", "bigint"]
    with pytest.raises(ValueError):
        readers.from_rows(spark, ["a"], [{"a": ""}])


def test_workbooks(spark, tmp_path):
    write_workbook(str(tmp_path / "1.xlsx"), ["a", None, "c"], [["1", " x ", "3", "cut"], ["2"]])
    write_workbook(str(tmp_path / "2.xlsx"), ["a", None, "c"], [[None, None, ""], ["9", "8", "7"]])
    df = read_workbooks(spark, str(tmp_path)).orderBy(ROW)
    assert df.columns == ["a", "Unnamed: 1", "c", ROW]
    assert [tuple(r) for r in df.collect()] == [
        ("1", "x", "3", 0), ("2", None, None, 1), (None, None, None, 2), ("9", "8", "7", 3),
    ]


def test_workbook_headers_must_agree(spark, tmp_path):
    write_workbook(str(tmp_path / "1.xlsx"), ["a"], [["1"]])
    write_workbook(str(tmp_path / "2.xlsx"), ["b"], [["1"]])
    with pytest.raises(ValueError):
        read_workbooks(spark, str(tmp_path))


def test_workbook_cell_types(spark, tmp_path):
    path = tmp_path / "t.xlsx"
    write_workbook(str(path), ["x"], [])
    with zipfile.ZipFile(path) as book:
        parts = {n: book.read(n).decode() for n in book.namelist()}
    parts["xl/sharedStrings.xml"] = "<sst><si><t>head</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>"
    parts["xl/styles.xml"] = (
        '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>'
    )
    parts["xl/worksheets/sheet1.xml"] = (
        '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>B</t></is></c></row>'
        '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" s="1"><v>45660.5</v></c></row>'
        '<row r="4"><c r="B4" t="b"><v>1</v></c></row><row r="5"><c r="A5"><v>1.5</v></c></row></sheetData></worksheet>'
    )
    with zipfile.ZipFile(path, "w") as book:
        for name, content in parts.items():
            book.writestr(name, content)
    df = read_workbooks(spark, str(tmp_path)).orderBy(ROW)
    assert [(r.head, r.B) for r in df.collect()] == [
        ("rich", "2025-01-03T12:00:00"), (None, None), (None, "True"), ("1.5", None),
    ]


def test_stage_is_written_once(spark, folder):
    nation = readers.read_parquet(spark, f"{folder}/nation.parquet")
    target = scratch_path(spark, "stage")
    staged = staging.stage(nation, target)
    files = sorted(staged.inputFiles())
    again = staging.stage(nation.repartition(4), target)
    assert sorted(again.inputFiles()) == files and again.count() == 25
    assert len(os.listdir(target)) == 1


def test_fingerprint(spark, folder):
    nation = readers.read_parquet(spark, f"{folder}/nation.parquet")
    same = staging.fingerprint(nation.repartition(7))
    assert staging.fingerprint(nation) == same
    assert staging.fingerprint(nation.where("n_nationkey > 0")) != same
    assert staging.fingerprint(nation.withColumn(ROW, 24 - F.col(ROW))) != same
    assert staging.fingerprint(nation.withColumnRenamed("n_name", "name")) != same


def test_as_cells(spark):
    df = spark.sql("SELECT ' a ' AS s, ' ' AS e, DATE'2025-01-02' AS d, TIMESTAMP_NTZ'2025-01-02 03:04:05' AS t, 1.5D AS n")
    assert tuple(staging.as_cells(df).first()) == ("a", None, "2025-01-02", "2025-01-02T03:04:05", "1.5")


def test_describe(spark, folder):
    kinds = [r.kind for r in describe_columns(readers.read_parquet(spark, f"{folder}/events.parquet")).collect()]
    assert kinds == ["numeric", "datetime", "numeric", "categorical", "numeric", "categorical"]


def test_fingerprint_sees_where_nulls_are(spark):
    from gridlore.sources.staging import fingerprint

    a, b = (spark.createDataFrame([row], "a string, b string") for row in (("x", None), (None, "x")))
    assert fingerprint(a) != fingerprint(b)


def test_stage_replaces_a_half_written_copy(spark, tmp_path):
    from gridlore.sources.staging import fingerprint, stage, staged_path

    df = spark.range(2)
    path = staged_path(str(tmp_path), fingerprint(df))
    df.limit(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    assert stage(df, str(tmp_path)).count() == 2 and stage(df, str(tmp_path)).count() == 2


def test_small_ranges_share_tasks(spark, tmp_path, no_open_cost):
    """Tasks follow the bytes and the cores, not the number of ranges."""
    path = write(tmp_path, "b.csv", "a,b\n" + "".join(f'q{i},"two\nlines"\n' for i in range(9_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 300
        lines = records.chunks(spark, path, "\n")
        assert lines.rdd.getNumPartitions() <= records.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
        assert lines.select("start").distinct().count() > 300
        read = readers.read_csv(spark, path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.a, r.b) for r in read.orderBy(ROW).collect()] == [(f"q{i}", "two\nlines") for i in range(9_000)]
