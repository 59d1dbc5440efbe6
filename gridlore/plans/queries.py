"""Registered queries: each runs one operator over the driver's tables, with its SQL twin."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlore.functions import exprs as X
from gridlore.functions import names as N
from gridlore.operators import charts as V
from gridlore.operators import cleaning as C
from gridlore.operators import correlation as R
from gridlore.operators import forest as W
from gridlore.operators import kmeans as KM
from gridlore.operators import modeling as M
from gridlore.operators import ordering as H
from gridlore.operators import outliers as O
from gridlore.operators import profile as D
from gridlore.operators import quantiles as Q
from gridlore.operators import sampling as K
from gridlore.operators import sketches as L
from gridlore.operators import trends as T
from gridlore.operators.ordering import ROW
from gridlore.plans import report, store
from gridlore.session import materialize, scratch_path, small_frame
from gridlore.sources import readers, staging
from gridlore.sources.workbook import read_workbooks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _sample_hash_sql(row: str) -> str:
    """The sample hash of a row number, as DuckDB writes it."""
    return f"CAST(concat('0x', substr(md5(concat('42-', {row})), 1, 15)) AS BIGINT)"


def _sampled_sql(n: int, columns: str = "*", source: str = "lineitem") -> str:
    numbered = f"SELECT {columns}, row_number() OVER () - 1 AS r FROM {source}"
    return f"SELECT * FROM ({numbered}) ORDER BY {_sample_hash_sql('r')}, r LIMIT {n}"


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *MEASURES]


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return readers.read_parquet(spark, f"{folder}/{name}.parquet")


def _dirty(string: str, row: str) -> str:
    """Events made dirty, as SQL text for both engines: gaps, blanks, copies, empty rows."""
    return f"""
    d AS (
      SELECT event_id AS id,
             CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(CAST(ts AS DATE) AS {string}) END AS day,
             CASE WHEN event_id % 5 = 0 THEN NULL
                  WHEN event_id % 19 = 0 THEN '  ' ELSE concat(' ', event_type, ' ') END AS kind,
             CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 29 = 0 THEN 'bad'
                  ELSE concat(' ', CAST(value AS {string})) END AS amount,
             CAST(NULL AS {string}) AS nothing
      FROM events),
    dirty AS (
      SELECT id * 2 AS {row}, * FROM d
      UNION ALL SELECT id * 2 + 1, * FROM d WHERE id % 10 = 0
      UNION ALL SELECT 1000000000000 + r_regionkey, NULL, NULL, NULL, NULL, NULL FROM region)"""


DIRTY = f"WITH {_dirty('VARCHAR', 'r')}"
TYPED = f"""{DIRTY},
    filled AS (SELECT * FROM dirty WHERE id IS NOT NULL),
    typed AS (SELECT r, id, TRY_CAST(trim(day) AS TIMESTAMP) AS day, trim(kind) AS kind,
                     TRY_CAST(trim(amount) AS DOUBLE) AS amount FROM filled),
    firsts AS (SELECT min(r) AS r, id, day, kind, amount FROM typed GROUP BY id, day, kind, amount)"""
CLEANED = f"""{TYPED},
    med AS (SELECT quantile_cont(amount, 0.5) AS m FROM firsts),
    mode AS (SELECT kind AS m FROM firsts WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1),
    cleaned AS (SELECT r, id,
        coalesce(last_value(day IGNORE NULLS) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 first_value(day IGNORE NULLS) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS day,
        coalesce(kind, (SELECT m FROM mode)) AS kind,
        coalesce(amount, (SELECT m FROM med)) AS amount
        FROM firsts)"""


def dirty_events(spark: SparkSession, folder: str) -> DataFrame:
    events = spark.read.parquet(f"{folder}/events.parquet")
    region = spark.read.parquet(f"{folder}/region.parquet")
    text = _dirty("STRING", ROW).replace("FROM events", "FROM {events}").replace("FROM region", "FROM {region}")
    return spark.sql(f"WITH {text} SELECT * FROM dirty", events=events, region=region)


def typed_events(spark: SparkSession, folder: str) -> DataFrame:
    return C.infer_types(C.drop_empty_columns(C.drop_empty_rows(dirty_events(spark, folder))))


# --- sources and staging ---------------------------------------------------------------------


@query(
    "s1_csv_scan",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey,
       CASE WHEN c_custkey % 3 = 2 THEN concat(c_name, chr(10), '"2"') ELSE c_name END AS c_name,
       CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_acctbal, c_mktsegment FROM customer""",
)
def s1(spark, folder):
    """Files of one header, of another column order, and with line breaks inside quotes."""
    path = scratch_path(spark, "customer-csv")
    customer = spark.read.parquet(f"{folder}/customer.parquet")
    thirds = [customer.where(f"c_custkey % 3 = {i}") for i in range(3)]
    thirds[1] = thirds[1].select(*reversed(customer.columns))
    thirds[2] = thirds[2].withColumn("c_name", F.expr("concat(c_name, char(10), '\"2\"')"))
    for third in thirds:
        third.write.mode("append").options(header=True, escape='"').csv(path)
    return readers.read_csv(spark, path).withColumn("c_acctbal", F.expr(X.double("c_acctbal"))).drop(ROW)


@contextmanager
def _ranges_of(spark, size):
    """Files are dealt out in ranges of this size meanwhile, so that small ones have several too."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@query(
    "s1_quoted_line_breaks",
    """SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus || chr(10) || '"' || o_orderpriority || '",' || chr(10) AS note,
              o_orderpriority FROM orders""",
)
def s1_quoted(spark, folder):
    """One file of several ranges, where most line ends stand inside quotes."""
    path = scratch_path(spark, "orders-csv")
    note = """concat(o_orderstatus, '\n"', o_orderpriority, '",\n') AS note"""
    orders = spark.read.parquet(f"{folder}/orders.parquet").selectExpr("o_orderkey", note, "o_orderpriority")
    orders.coalesce(1).write.csv(path, header=True, escape='"', ignoreTrailingWhiteSpace=False)
    with _ranges_of(spark, "64k"):
        return readers.read_csv(spark, path).drop(ROW)


@query("s2_json_documents", "SELECT event_id, kind, amount FROM (SELECT event_id, event_type AS kind, value AS amount FROM events)")
def s2_documents(spark, folder):
    """One file that holds an array of all even events on one line, and one of the odd ones as objects without line ends."""
    path = scratch_path(spark, "events-json")
    events = spark.read.parquet(f"{folder}/events.parquet").selectExpr("event_id", "event_type AS kind", "value AS amount")
    text = events.select("event_id", F.to_json(F.struct("*")).alias("value"))
    text.where("event_id % 2 = 0").coalesce(1).select("value").mapInPandas(_as_array, "value string").write.option("lineSep", " ").text(path)
    text.where("event_id % 2 = 1").coalesce(1).select("value").write.mode("append").option("lineSep", " ").text(path)
    with _ranges_of(spark, "64k"):
        return readers.read_json(spark, path).select("event_id", "kind", "amount")


def _as_array(batches):
    """Records of one task as the lines of one JSON array."""
    lead = "["
    for batch in batches:
        lines = [(lead if i == 0 else ",") + record for i, record in enumerate(batch["value"])]
        if lines:
            lead = ","
            yield pd.DataFrame({"value": lines})
    yield pd.DataFrame({"value": ["]" if lead == "," else "[]"]})


@query("s2_json_scan", "SELECT * FROM events")
def s2(spark, folder):
    """Files of one record a line and files of one array each."""
    path = scratch_path(spark, "events-json")
    style = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    events = spark.read.parquet(f"{folder}/events.parquet")
    events.where("event_id % 2 = 0").write.option("timestampNTZFormat", style).json(path)
    odd = events.where("event_id % 2 = 1").select(F.to_json(F.struct("*"), {"timestampNTZFormat": style}).alias("value"))
    odd.mapInPandas(_as_array, "value string").write.mode("append").text(path)
    return readers.read_json(spark, path).withColumn("ts", F.col("ts").cast("timestamp_ntz")).select(*events.columns)


@query(
    "s4_cell_text",
    f"""{DIRTY} SELECT id, nullif(trim(kind), '') AS kind, nullif(trim(amount), '') AS amount, nullif(trim(day), '') AS day
       FROM dirty""",
)
def s4(spark, folder):
    cells = staging.as_cells(dirty_events(spark, folder))
    return cells.selectExpr("CAST(id AS BIGINT) AS id", "kind", "amount", "day")


@query(
    "s6_parquet_scan",
    "SELECT o_orderkey AS row_index, * FROM orders",
)
def s6(spark, folder):
    return table(spark, folder, "orders").withColumnRenamed(ROW, "row_index")


@query("s7_stage_round_trip", "SELECT * FROM orders")
def s7(spark, folder):
    return staging.stage(table(spark, folder, "orders"), scratch_path(spark, "staged")).drop(ROW)


@query(
    "s9_describe_columns",
    """SELECT CAST(ordinal - 1 AS INTEGER) AS position, column_name AS original_name, column_name AS "column",
       CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
            WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS dtype,
       CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric'
            WHEN column_type = 'VARCHAR' THEN 'categorical' ELSE 'datetime' END AS kind
       FROM (SELECT *, row_number() OVER () AS ordinal FROM (DESCRIBE lineitem))""",
)
def s9(spark, folder):
    return D.describe_columns(table(spark, folder, "lineitem"))


@query("s10_fingerprint")
def s10(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    return lineitem.agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "content_hash", F.lit(staging.fingerprint(lineitem))
    )


@query(
    "s10_fingerprint_rules",
    """SELECT count(*) AS row_count, true AS same_in_other_partitions, true AS moved_null_differs,
       true AS changed_value_differs, true AS other_order_differs FROM orders""",
)
def s10_rules(spark, folder):
    orders = table(spark, folder, "orders")
    known = staging.fingerprint(orders)
    left = staging.fingerprint(orders.selectExpr("o_orderpriority AS a", "CAST(NULL AS STRING) AS b"))
    right = staging.fingerprint(orders.selectExpr("CAST(NULL AS STRING) AS a", "o_orderpriority AS b"))
    changed = orders.withColumn("o_totalprice", F.expr("o_totalprice + CAST(o_orderkey = 7 AS INT)"))
    moved = orders.withColumn(ROW, F.col(ROW) + 1)
    return orders.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count",
        F.lit(staging.fingerprint(orders.repartition(7)) == known).alias("same_in_other_partitions"),
        F.lit(left != right).alias("moved_null_differs"),
        F.lit(staging.fingerprint(changed) != known).alias("changed_value_differs"),
        F.lit(staging.fingerprint(moved) != known).alias("other_order_differs"),
    )


SHEET = (
    '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{rows}</sheetData></worksheet>'
)
BOOK_PARTS = {
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
    '<sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" '
    'Target="worksheets/sheet1.xml"/></Relationships>',
}


def write_workbook(path: str, header: list, rows: list) -> None:
    """A minimal workbook with inline texts; empty cells are left out."""

    def cell(value):
        if value is None:
            return "<c/>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    lines = "".join(f"<row>{''.join(map(cell, row))}</row>" for row in [header, *rows])
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        for name, content in BOOK_PARTS.items():
            book.writestr(name, content)
        book.writestr("xl/worksheets/sheet1.xml", SHEET.format(rows=lines))
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    system.create_dir(inner.rsplit("/", 1)[0])
    with system.open_output_stream(inner) as out:
        out.write(buffer.getvalue())


@query(
    "s3_workbook_scan",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
       c_mktsegment, c_custkey AS row_index FROM customer""",
)
def s3(spark, folder):
    path = scratch_path(spark, "workbooks")

    def save(group: pd.DataFrame) -> pd.DataFrame:  # at most 300 customers
        group = group.sort_values("c_custkey")
        book = int(group["book"].iloc[0])
        columns = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
        write_workbook(f"{path}/book-{book:09d}.xlsx", columns, group[columns].astype(str).values.tolist())
        return pd.DataFrame({"book": [book]})

    customers = spark.read.parquet(f"{folder}/customer.parquet").withColumn("book", F.expr("c_custkey div 300"))
    customers.groupBy("book").applyInPandas(save, "book long").agg(F.count("*")).collect()
    read = read_workbooks(spark, path)
    return read.withColumnRenamed(ROW, "row_index")


# --- names, projections, predicates, casts -----------------------------------------------------


def _normal_sql(c: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower(trim({c})), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'column')"


@query(
    "p1_normalize_names",
    f"SELECT p_partkey, {_normal_sql('p_brand')} AS brand, {_normal_sql('p_name')} AS name, "
    f"{_normal_sql('''concat(' %', p_type, ' (', p_brand, ')% ')''')} AS label FROM part",
)
def p1(spark, folder):
    label = "concat(' %', p_type, ' (', p_brand, ')% ')"
    return table(spark, folder, "part").selectExpr(
        "p_partkey", f"{N.normalized('p_brand')} AS brand", f"{N.normalized('p_name')} AS name", f"{N.normalized(label)} AS label"
    )


@query(
    "p2_number_repeated_names",
    """SELECT p_partkey, p_type, CASE WHEN n = 1 THEN p_type ELSE concat(p_type, '_', n) END AS unique_name
       FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part)""",
)
def p2(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_type")
    return N.numbered_names(parts, "p_type", "p_partkey").select("p_partkey", "p_type", "unique_name")


@query("p3_rename_projection", "SELECT o_orderkey AS order_key, o_totalprice AS total, o_orderstatus AS status FROM orders")
def p3(spark, folder):
    mapping = {"o_orderkey": "order_key", "o_totalprice": "total", "o_orderstatus": "status"}
    return N.apply_names(table(spark, folder, "orders"), mapping)


@query("p4_numeric_cast", f"{DIRTY} SELECT id, TRY_CAST(trim(amount) AS DOUBLE) AS amount FROM dirty")
def p4(spark, folder):
    return dirty_events(spark, folder).selectExpr("CAST(id AS BIGINT) AS id", f"{X.double('amount')} AS amount")


@query(
    "p5_timestamp_cast",
    f"""{DIRTY} SELECT id, strftime(TRY_CAST(trim(day) AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') AS day,
        strftime(TRY_CAST(trim(amount) AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') AS not_a_day FROM dirty""",
)
def p5(spark, folder):
    day, other = X.iso(X.timestamp("day")), X.iso(X.timestamp("amount"))
    return dirty_events(spark, folder).selectExpr("CAST(id AS BIGINT) AS id", f"{day} AS day", f"{other} AS not_a_day")


@query(
    "p6_missing_predicate",
    f"""{DIRTY} SELECT CAST(sum(CASE WHEN kind IS NULL OR trim(kind) = '' THEN 1 ELSE 0 END) AS BIGINT) AS kind_missing,
        CAST(sum(CASE WHEN amount IS NULL OR trim(amount) = '' THEN 1 ELSE 0 END) AS BIGINT) AS amount_missing,
        CAST(sum(CASE WHEN id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS id_missing FROM dirty""",
)
def p6(spark, folder):
    names = ("kind", "amount", "id")
    return dirty_events(spark, folder).selectExpr(*[f"count_if({X.missing(c)}) AS {c}_missing" for c in names])


@query(
    "p7_date_like",
    f"""{DIRTY} SELECT count(day) AS days, CAST(sum(CASE WHEN regexp_matches(day, '[-/:T]') THEN 1 ELSE 0 END) AS BIGINT) AS day_like,
        CAST(sum(CASE WHEN regexp_matches(amount, '[-/:T]') THEN 1 ELSE 0 END) AS BIGINT) AS amount_like FROM dirty""",
)
def p7(spark, folder):
    return dirty_events(spark, folder).selectExpr(
        "count(day) AS days", f"count_if({X.date_like('day')}) AS day_like", f"count_if({X.date_like('amount')}) AS amount_like"
    )


@query("p8_select_kind", f"SELECT {', '.join(NUMBERS)} FROM lineitem")
def p8(spark, folder):
    return D.select_kind(table(spark, folder, "lineitem"), X.NUMERIC)


@query(
    "p9_sanitize",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, event_type, round(value, 4) AS value
       FROM events WHERE microsecond(ts) % 1000000 <> 0
       UNION ALL SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S'), event_type, round(value, 4)
       FROM events WHERE microsecond(ts) % 1000000 = 0""",
)
def p9(spark, folder):
    return X.sanitize(table(spark, folder, "events")).select("event_id", "ts", "event_type", "value")


# --- cleaning ----------------------------------------------------------------------------------


@query("c1_drop_empty_rows", f"{DIRTY} SELECT id, day, kind, amount FROM dirty WHERE id IS NOT NULL")
def c1(spark, folder):
    kept = C.drop_empty_rows(dirty_events(spark, folder))
    return kept.selectExpr("CAST(id AS BIGINT) AS id", "day", "kind", "amount")


@query("c2_drop_empty_columns", f"{DIRTY} SELECT id, day, kind, amount FROM dirty")
def c2(spark, folder):
    return C.drop_empty_columns(dirty_events(spark, folder)).drop(ROW).withColumn("id", F.col("id").cast("long"))


@query("c3_trim_strings", f"{DIRTY} SELECT id, trim(kind) AS kind, trim(amount) AS amount, trim(day) AS day FROM dirty")
def c3(spark, folder):
    return C.trim_strings(dirty_events(spark, folder)).selectExpr("CAST(id AS BIGINT) AS id", "kind", "amount", "day")


@query(
    "c4_infer_types",
    f"{TYPED} SELECT id, strftime(day, '%Y-%m-%d') AS day, kind, amount FROM typed",
)
def c4(spark, folder):
    return typed_events(spark, folder).selectExpr(
        "CAST(id AS BIGINT) AS id", "date_format(day, 'yyyy-MM-dd') AS day", "kind", "amount"
    )


US_DATES = "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' ELSE {f} END AS placed FROM orders"


@query(
    "c5_detect_date_format",
    f"""WITH o AS ({US_DATES.format(f="strftime(o_orderdate, '%m/%d/%Y')")})
        SELECT o_orderkey, strftime(try_strptime(placed, '%m/%d/%Y'), '%Y-%m-%d') AS placed FROM o""",
)
def c5(spark, folder):
    text = US_DATES.format(f="date_format(o_orderdate, 'MM/dd/yyyy')").replace("FROM orders", "FROM {orders}")
    orders = spark.sql(text, orders=spark.read.parquet(f"{folder}/orders.parquet"))
    fmt = C.detect_format(orders, "placed")
    day = X.timestamp("placed", fmt)
    return orders.selectExpr("o_orderkey", f"date_format({day}, 'yyyy-MM-dd') AS placed")


@query(
    "c5_everyday_dates",
    """SELECT o_orderkey, date_trunc('day', o_orderdate) AS short, date_trunc('minute', o_orderdate) + INTERVAL 754 MINUTE AS clock,
       date_trunc('day', o_orderdate) AS named, o_orderdate - INTERVAL 2 HOUR AS zoned FROM orders""",
)
def c5_everyday(spark, folder):
    """Two-digit years, half-day clocks, month names and offsets, all found by inference."""
    orders = spark.read.parquet(f"{folder}/orders.parquet").selectExpr(
        "o_orderkey",
        "date_format(o_orderdate, 'MM/dd/yy') AS short",
        "date_format(date_trunc('minute', o_orderdate) + INTERVAL 754 MINUTE, 'M/d/yyyy h:mm a') AS clock",
        "date_format(o_orderdate, 'dd-MMM-yy') AS named",
        "concat(date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss'), '+02:00') AS zoned",
    )
    return C.infer_types(orders)


@query("c6_drop_duplicates", f"{TYPED} SELECT r, id, strftime(day, '%Y-%m-%d') AS day, kind, amount FROM firsts")
def c6(spark, folder):
    kept = C.drop_duplicates(typed_events(spark, folder))
    return kept.selectExpr(
        f"{ROW} AS r", "CAST(id AS BIGINT) AS id", "date_format(day, 'yyyy-MM-dd') AS day", "kind", "amount"
    )


@query(
    "c7_median_imputation",
    f"{TYPED} SELECT r, coalesce(amount, (SELECT quantile_cont(amount, 0.5) FROM typed)) AS amount FROM typed",
)
def c7(spark, folder):
    return C.impute(typed_events(spark, folder), (X.NUMERIC,)).selectExpr(f"{ROW} AS r", "amount")


@query(
    "c8_fill_datetimes",
    f"""{TYPED} SELECT r, strftime(coalesce(
        last_value(day IGNORE NULLS) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(day IGNORE NULLS) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), '%Y-%m-%d') AS day
        FROM typed""",
)
def c8(spark, folder):
    filled = C.impute(typed_events(spark, folder), (X.DATETIME,))
    return filled.selectExpr(f"{ROW} AS r", "date_format(day, 'yyyy-MM-dd') AS day")


@query(
    "c9_mode_imputation",
    f"""{TYPED}, mode AS (SELECT kind AS m FROM typed WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)
        SELECT r, coalesce(kind, (SELECT m FROM mode)) AS kind FROM typed""",
)
def c9(spark, folder):
    return C.impute(typed_events(spark, folder), (X.CATEGORICAL,)).selectExpr(f"{ROW} AS r", "kind")


@query(
    "c10_missing_totals",
    f"""{TYPED} SELECT CAST(sum(CASE WHEN id IS NULL THEN 1 ELSE 0 END + CASE WHEN day IS NULL THEN 1 ELSE 0 END
        + CASE WHEN kind IS NULL THEN 1 ELSE 0 END + CASE WHEN amount IS NULL THEN 1 ELSE 0 END) AS BIGINT)
        AS missing_values FROM typed""",
)
def c10(spark, folder):
    return D.missing_totals(typed_events(spark, folder))


@query(
    "c11_clean",
    f"{CLEANED} SELECT r, id, strftime(day, '%Y-%m-%d') AS day, kind, amount FROM cleaned",
)
def c11(spark, folder):
    cleaned, _ = C.clean(dirty_events(spark, folder))
    return cleaned.selectExpr(
        f"{ROW} AS r", "CAST(id AS BIGINT) AS id", "date_format(day, 'yyyy-MM-dd') AS day", "kind", "amount"
    )


@query(
    "c11_cleaning_summary",
    f"""{CLEANED} SELECT (SELECT count(*) FROM dirty) AS original_rows, CAST(5 AS BIGINT) AS original_columns,
        (SELECT count(*) FROM cleaned) AS cleaned_rows, CAST(4 AS BIGINT) AS cleaned_columns,
        (SELECT count(*) FROM dirty) - (SELECT count(*) FROM typed) AS empty_rows_dropped,
        (SELECT count(*) FROM typed) - (SELECT count(*) FROM firsts) AS duplicate_rows_removed,
        (SELECT 4 * count(*) - count(id) - count(day) - count(kind) - count(amount) FROM typed) AS missing_values_before,
        (SELECT 4 * count(*) - count(id) - count(day) - count(kind) - count(amount) FROM cleaned) AS missing_values_after""",
)
def c11_summary(spark, folder):
    return C.clean(dirty_events(spark, folder))[1].table(spark)


# --- profiling ---------------------------------------------------------------------------------


@query("d1_shape", "SELECT count(*) AS row_count, CAST(11 AS INTEGER) AS column_count FROM lineitem")
def d1(spark, folder):
    return D.shape(table(spark, folder, "lineitem"))


EVENT_COLUMNS = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}
EVENT_TEXT = {
    "ts": "CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END",
    "value": "CAST(round(value, 4) AS VARCHAR)",
}


@query(
    "d2_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({i} AS INTEGER) AS position, '{t}' AS dtype, count(*) - count({c}) AS missing_count,
        round((count(*) - count({c})) * 100.0 / count(*), 2)::DOUBLE AS missing_percentage, count(DISTINCT {c}) AS unique_values,
        (SELECT string_agg(v, '|' ORDER BY event_id) FROM (SELECT event_id, CAST({EVENT_TEXT.get(c, c)} AS VARCHAR) AS v
         FROM events WHERE {c} IS NOT NULL ORDER BY event_id LIMIT 3)) AS sample_values FROM events"""
        for i, (c, t) in enumerate(EVENT_COLUMNS.items())
    ),
)
def d2(spark, folder):
    return (
        D.profile(table(spark, folder, "events"))
        .withColumn("sample_values", F.concat_ws("|", "sample_values"))
        .select("column", "position", "dtype", "missing_count", "missing_percentage", "unique_values", "sample_values")
    )


@query(
    "d3_profile_raw_missing",
    DIRTY
    + " "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(sum(CASE WHEN {c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '' THEN 1 ELSE 0 END) AS BIGINT)
        AS missing_count, round(sum(CASE WHEN {c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '' THEN 1 ELSE 0 END) * 100.0 / count(*), 2)::DOUBLE
        AS missing_percentage FROM dirty"""
        for c in ("id", "day", "kind", "amount", "nothing")
    ),
)
def d3(spark, folder):
    found = D.missing_counts(dirty_events(spark, folder), "raw")
    return found.select("column", "missing_count", "missing_percentage")


@query("d3_approximate_distinct")
def d3_distinct(spark, folder):
    return D.approximate_distinct(table(spark, folder, "lineitem"))


LINE_COLUMNS = [*NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]


@query(
    "d3_approximate_distinct_bound",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS exact, true AS within_bound FROM lineitem""" for c in LINE_COLUMNS
    ),
)
def d3_bound(spark, folder):
    """Approximate counts lie within three standard errors (5 % each) of the exact ones."""
    lines = table(spark, folder, "lineitem")
    exact = D.profile(lines, "clean").select("column", F.col("unique_values").alias("exact"))
    near = "abs(unique_values - exact) <= 0.15 * exact AS within_bound"
    return exact.join(D.approximate_distinct(lines), "column").selectExpr("column", "exact", near)


def _summary_sql(columns: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median,
        round(stddev_pop({c}), 4) AS std, round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max,
        round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.75), 4) AS q3 FROM {source}"""
        for c in columns
    )


@query("d4_numeric_summary", _summary_sql(NUMBERS, "lineitem"))
def d4(spark, folder):
    return D.numeric_summary(table(spark, folder, "lineitem"))


PROBABILITIES = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


@query(
    "d5_exact_quantiles",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({p} AS DOUBLE) AS probability, round(quantile_cont({c}, {p}), 4) AS value FROM lineitem"""
        for c in MEASURES
        for p in PROBABILITIES
    ),
)
def d5(spark, folder):
    found = Q.quantiles(table(spark, folder, "lineitem"), MEASURES, PROBABILITIES, small_rows=0)
    return found.withColumn("value", F.round("value", 4))


@query("d5_approximate_quantiles")
def d5_approximate(spark, folder):
    return Q.approximate_quantiles(table(spark, folder, "lineitem"), MEASURES, PROBABILITIES)


@query(
    "d5_approximate_quantiles_bound",
    f"""SELECT c AS "column", p::DOUBLE AS probability, true AS within_bound
        FROM (VALUES {", ".join(f"('{c}')" for c in MEASURES)}) a(c), (VALUES {", ".join(f"({p})" for p in PROBABILITIES)}) b(p)""",
)
def d5_bound(spark, folder):
    """Each value's ranks reach within a ten-thousandth of the rows around the wanted one."""
    lines = table(spark, folder, "lineitem")
    found = Q.approximate_quantiles(lines, MEASURES, PROBABILITIES).collect()  # columns times probabilities
    counts = lines.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(r["column"]) < r.value).alias(f"below{i}") for i, r in enumerate(found)],
        *[F.count_if(F.col(r["column"]) <= r.value).alias(f"upto{i}") for i, r in enumerate(found)],
    ).first()
    slack = counts.n / 10_000 + 1
    rows = [
        (r["column"], r.probability, counts[f"below{i}"] - slack <= r.probability * counts.n <= counts[f"upto{i}"] + slack)
        for i, r in enumerate(found)
    ]
    return small_frame(spark, rows, "column string, probability double, within_bound boolean")


@query(
    "d3_merged_sketches",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS row_count, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
            true AS distinct_close, true AS ranks_close FROM lineitem"""
        for c in NUMBERS
    ),
)
def merged_sketches(spark, folder):
    """Sketches of two halves, merged: distinct counts within 4 %, ranks of the quartiles within 2 % of the rows."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select(*NUMBERS)
    odd = F.pmod("l_orderkey", F.lit(2)) == 1
    halves = L.sketch(lines.where(odd)).unionByName(L.sketch(lines.where(~odd)))
    quartiles = [0.25, 0.5, 0.75]
    found = L.described(L.merge(halves), quartiles).collect()  # one row per column
    # a branch per column: distinct counts in one aggregate would multiply the rows by the columns
    values = [lines.select(F.col(r["column"]).alias("v")).where("v IS NOT NULL").distinct().agg(F.lit(i).alias("i"), F.count(F.lit(1)).alias("n")) for i, r in enumerate(found)]
    distincts = {r.i: r.n for r in reduce(DataFrame.union, values).collect()}
    exact = lines.agg(
        *[F.count_if(F.col(r["column"]) < v).alias(f"below{i}_{k}") for i, r in enumerate(found) for k, v in enumerate(r.quantiles)],
        *[F.count_if(F.col(r["column"]) <= v).alias(f"upto{i}_{k}") for i, r in enumerate(found) for k, v in enumerate(r.quantiles)],
    ).first()
    rows = []
    for i, r in enumerate(found):
        distinct = abs(r.unique_values - distincts[i]) <= 0.04 * distincts[i]
        slack = 0.02 * r.row_count + 1
        ranks = all(exact[f"below{i}_{k}"] - slack <= p * r.row_count <= exact[f"upto{i}_{k}"] + slack for k, p in enumerate(quartiles))
        rows.append((r["column"], r.row_count, r.min, r.max, distinct, ranks))
    return small_frame(spark, rows, "column string, row_count long, min double, max double, distinct_close boolean, ranks_close boolean")


@query(
    "d6_datetime_summary",
    """SELECT 'l_shipdate' AS "column", strftime(min(l_shipdate), '%Y-%m-%dT%H:%M:%S') AS min_time,
       strftime(max(l_shipdate), '%Y-%m-%dT%H:%M:%S') AS max_time FROM lineitem""",
)
def d6(spark, folder):
    return D.datetime_summary(table(spark, folder, "lineitem"))


def _top_sql(columns: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS "column", {c} AS top_value, count(*) AS top_frequency FROM {source}
        WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""
        for c in columns
    )


@query("d7_categorical_summary", _top_sql(["l_returnflag", "l_linestatus"], "lineitem"))
def d7(spark, folder):
    return D.categorical_summary(table(spark, folder, "lineitem"))


def _statistics_sql(numbers: list[str], texts: list[str], time: str, source: str) -> str:
    counted = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS non_null_count, count(DISTINCT {c}) AS unique_values FROM {source}"""
        for c in (*numbers, *texts, time)
    )
    return f"""num AS ({_summary_sql(numbers, source)}), txt AS ({_top_sql(texts, source)}),
        tim AS (SELECT '{time}' AS "column", strftime(min({time}), '%Y-%m-%dT%H:%M:%S') AS min_time,
                strftime(max({time}), '%Y-%m-%dT%H:%M:%S') AS max_time FROM {source}),
        cnt AS ({counted})
        SELECT "column", non_null_count, unique_values, mean, median, std, min, max, q1, q3, min_time, max_time, top_value, top_frequency
        FROM cnt LEFT JOIN num USING ("column") LEFT JOIN txt USING ("column") LEFT JOIN tim USING ("column")"""


@query(
    "d8_summary_statistics",
    "WITH "
    + _statistics_sql(["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"], "o_orderdate", "orders"),
)
def d8(spark, folder):
    return D.summary_statistics(table(spark, folder, "orders")).drop("position", "dtype", "kind", "castable_count")


@query("d9_preview", "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 12")
def d9(spark, folder):
    return D.preview(table(spark, folder, "events")).select("event_id", "user_id", "event_type", "value")


# --- correlation -------------------------------------------------------------------------------


def _pairs(columns: list[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]


def _pair_sql(columns: list[str], source: str = "lineitem") -> str:
    return " UNION ALL ".join(
        f"""SELECT '{columns[i]}' AS left_column, '{columns[j]}' AS right_column, {i} AS lp, {j} AS rp,
        round(corr({columns[i]}, {columns[j]}), 3) AS correlation FROM {source}"""
        for i, j in _pairs(columns)
    )


MATRIX_SQL = f"""WITH p AS ({_pair_sql(NUMBERS)})
    SELECT left_column AS x, right_column AS y, correlation FROM p
    UNION ALL SELECT right_column, left_column, correlation FROM p
    UNION ALL SELECT c, c, 1.0 FROM (VALUES {", ".join(f"('{c}')" for c in NUMBERS)}) v(c)"""


@query("r1_correlation_matrix", MATRIX_SQL)
def r1(spark, folder):
    return R.correlation_matrix(table(spark, folder, "lineitem")).select("x", "y", "correlation")


REMAINDERS = [f"user_id % {k} AS rest_{k}" for k in (3, 5, 7, 11, 13)]
FLAT = f"""SELECT event_id, value, user_id, 7 AS constant, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value * user_id END AS gappy,
    {", ".join(REMAINDERS)} FROM events"""
FLAT_COLUMNS = ["event_id", "value", "user_id", "constant", "gappy", *[p.split()[-1] for p in REMAINDERS]]


@query(
    "r2_correlation_raw",
    f"""WITH e AS ({FLAT}), p AS ({_pair_sql(FLAT_COLUMNS, "e")})
        SELECT left_column, right_column, CASE WHEN correlation IS NULL OR isnan(correlation) THEN 0.0 ELSE correlation END AS correlation FROM p""",
)
def r2(spark, folder):
    events = spark.sql(FLAT.replace("FROM events", "FROM {e}"), e=spark.read.parquet(f"{folder}/events.parquet"))
    pairs = R.correlation_pairs(events, null_as_zero=True)
    return pairs.select("left_column", "right_column", "correlation")


def _strongest_sql(k: int) -> str:
    return f"""SELECT left_column, right_column, correlation FROM ({_pair_sql(NUMBERS)})
        ORDER BY abs(correlation) DESC, lp, rp LIMIT {k}"""


@query("r3_strongest_pairs", _strongest_sql(6))
def r3(spark, folder):
    pairs = R.correlation_pairs(table(spark, folder, "lineitem"))
    return R.strongest_pairs(pairs).select("left_column", "right_column", "correlation")


@query("r4_strongest_pair", _strongest_sql(1))
def r4(spark, folder):
    pairs = R.correlation_pairs(table(spark, folder, "lineitem"))
    return R.strongest_pairs(pairs, 1).select("left_column", "right_column", "correlation")


# --- outliers ----------------------------------------------------------------------------------

SKEWED = """SELECT l_orderkey, l_linenumber, l_quantity * l_quantity * l_quantity AS cubed,
    l_extendedprice / (0.5 + l_quantity) AS unit, l_tax, CAST(3.5 AS DOUBLE) AS flat"""
SKEWED_COLUMNS = ["cubed", "unit", "l_tax", "flat"]


def skewed_lines(spark, folder):
    return spark.sql(f"{SKEWED}, {ROW} FROM {{lines}}", lines=table(spark, folder, "lineitem"))


_SKEWED_SQL = f"WITH s AS ({SKEWED} FROM lineitem)"


def _bounds_sql(columns: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3,
        quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo,
        quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {source}"""
        for c in columns
    )


_BOUNDED = f"{_SKEWED_SQL}, b AS (SELECT * FROM ({_bounds_sql(SKEWED_COLUMNS, 's')}) WHERE n >= 4 AND q3 <> q1)"
_OUTLIERS = (
    f"{_BOUNDED}, o AS ("
    + " UNION ALL ".join(
        f"""SELECT b."column", count(*) AS count, round(count(*) * 100.0 / any_value(b.n), 2)::DOUBLE AS percentage,
        round(any_value(lo), 4) AS lower_bound, round(any_value(hi), 4) AS upper_bound
        FROM s JOIN b ON b."column" = '{c}' WHERE {c} < lo OR {c} > hi GROUP BY b."column" """
        for c in SKEWED_COLUMNS
    )
    + ")"
)


@query(
    "o1_iqr_bounds",
    f"""{_BOUNDED} SELECT "column", n AS non_null_count, round(q1, 4) AS q1, round(q3, 4) AS q3,
        round(lo, 4) AS lower_bound, round(hi, 4) AS upper_bound FROM b""",
)
def o1(spark, folder):
    bounds = O.iqr_bounds(skewed_lines(spark, folder), SKEWED_COLUMNS)
    rounded = [f"round({c}, 4) AS {c}" for c in ("q1", "q3", "lower_bound", "upper_bound")]
    return bounds.selectExpr("column", "non_null_count", *rounded)


@query("o2_outliers", f"{_OUTLIERS} SELECT * FROM o")
def o2(spark, folder):
    return O.outliers(skewed_lines(spark, folder), SKEWED_COLUMNS)


@query(
    "o3_outlier_rows",
    f"""{_BOUNDED} SELECT l_orderkey, l_linenumber, round(unit, 4) AS unit FROM s, (SELECT lo, hi FROM b WHERE "column" = 'unit')
        WHERE unit < lo OR unit > hi""",
)
def o3(spark, folder):
    found = O.outlier_rows(skewed_lines(spark, folder), "unit")
    return found.selectExpr("l_orderkey", "l_linenumber", "round(unit, 4) AS unit")


@query("o4_top_outlier", f'{_OUTLIERS} SELECT * FROM o ORDER BY count DESC, "column" LIMIT 1')
def o4(spark, folder):
    return O.top_outlier(O.outliers(skewed_lines(spark, folder), SKEWED_COLUMNS))


# --- trends ------------------------------------------------------------------------------------


@query(
    "t1_trend_basis",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders",
)
def t1(spark, folder):
    placed, _ = T.trend_basis(table(spark, folder, "orders"), ["o_orderkey"])
    return placed.selectExpr("CAST(o_orderkey AS BIGINT) AS o_orderkey", f"{T.POSITION} AS position")


_ORDER_TREND = """WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS p FROM orders)"""


def _slope_sql(columns: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", regr_slope({c}::DOUBLE, p::DOUBLE) AS s, max({c}) - min({c}) AS span, max(p) AS steps FROM {source}"""
        for c in columns
    )


@query(
    "t2_trend_slope",
    f"""{_ORDER_TREND} SELECT "column", round(s, 4) AS slope FROM ({_slope_sql(["o_orderkey", "o_custkey", "o_totalprice"], "o")})""",
)
def t2(spark, folder):
    return T.trends(table(spark, folder, "orders")).select("column", "slope")


_ROW_TREND = """WITH e AS (SELECT event_id, user_id, value, 5 AS constant, event_id % 5 AS fifth, event_id * value AS sixth,
    event_id AS p FROM events)"""


@query(
    "t3_trends",
    f"""{_ROW_TREND}, f AS ({_slope_sql(["event_id", "user_id", "value", "constant", "fifth", "sixth"], "e")})
        SELECT "column", 'row_order' AS basis, CASE WHEN span > 0 THEN round(s, 4) END AS slope,
        CASE WHEN span = 0 THEN 'stable' WHEN s * steps / span > 0.08 THEN 'upward'
             WHEN s * steps / span < -0.08 THEN 'downward' ELSE 'stable' END AS direction FROM f""",
)
def t3(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "value", F.lit(5).alias("constant"),
        F.expr("event_id % 5").alias("fifth"), F.expr("event_id * value").alias("sixth"), ROW)
    return T.trends(events).select("column", "basis", "slope", "direction")


# --- chart data --------------------------------------------------------------------------------


@query("v1_category_counts", "SELECT p_type AS category, count(*) AS count FROM part WHERE trim(p_type) <> '' GROUP BY 1")
def v1(spark, folder):
    return V.category_counts(table(spark, folder, "part"), "p_type")


@query(
    "v2_bar",
    "SELECT p_name AS category, count(*) AS count FROM part GROUP BY 1 ORDER BY count DESC, category LIMIT 10",
)
def v2(spark, folder):
    return V.bar(table(spark, folder, "part"), "p_name")


@query(
    "v3_pie",
    """WITH c AS (SELECT p_name AS category, count(*) AS count FROM part GROUP BY 1),
       t AS (SELECT * FROM c ORDER BY count DESC, category LIMIT 5)
       SELECT * FROM t UNION ALL
       SELECT 'Other', CAST((SELECT sum(count) FROM c) - (SELECT sum(count) FROM t) AS BIGINT) WHERE (SELECT sum(count) FROM c) > (SELECT sum(count) FROM t)""",
)
def v3(spark, folder):
    return V.pie(table(spark, folder, "part"), "p_name")


_HISTOGRAM = """WITH b AS (SELECT min({c}) AS lo, max({c}) AS hi, (max({c}) - min({c})) / 30 AS w FROM {t}),
    n AS (SELECT least(29, greatest(0, CAST(floor(({c} - lo) / w) AS BIGINT))) AS bin, count(*) AS count FROM {t}, b GROUP BY 1),
    e AS (SELECT r.range AS bin, lo + r.range * w AS left_edge, CASE WHEN r.range = 29 THEN hi ELSE lo + r.range * w + w END AS right_edge
          FROM range(30) r, b)
    SELECT bin, round(left_edge, 4) AS left_edge, round(right_edge, 4) AS right_edge,
           format('{{:.4g}} to {{:.4g}}', left_edge, right_edge) AS label, coalesce(count, 0) AS count FROM e LEFT JOIN n USING (bin)"""


@query("v4_histogram", _HISTOGRAM.format(c="l_extendedprice", t="lineitem"))
def v4(spark, folder):
    bins = V.histogram(table(spark, folder, "lineitem"), "l_extendedprice")
    return bins.selectExpr("bin", "round(left_edge, 4) AS left_edge", "round(right_edge, 4) AS right_edge", "label", "count")


@query("v5_sampled_histogram", _HISTOGRAM.format(c="l_extendedprice", t=f"({_sampled_sql(V.CHART_ROWS)})"))
def v5(spark, folder):
    bins = V.sampled_histogram(table(spark, folder, "lineitem"), "l_extendedprice")
    return bins.selectExpr("bin", "round(left_edge, 4) AS left_edge", "round(right_edge, 4) AS right_edge", "label", "count")


@query(
    "v6_box",
    f"""{_BOUNDED} SELECT 'unit' AS "column", (SELECT round(q1, 4) FROM b WHERE "column" = 'unit') AS q1,
        round(quantile_cont(unit, 0.5), 4) AS median, (SELECT round(q3, 4) FROM b WHERE "column" = 'unit') AS q3,
        round(min(unit) FILTER (WHERE unit >= (SELECT lo FROM b WHERE "column" = 'unit')), 4) AS lower_fence,
        round(max(unit) FILTER (WHERE unit <= (SELECT hi FROM b WHERE "column" = 'unit')), 4) AS upper_fence FROM s""",
)
def v6(spark, folder):
    found = V.box(skewed_lines(spark, folder), "unit")
    return found.selectExpr("column", *[f"round({c}, 4) AS {c}" for c in found.columns[1:]])


@query(
    "v7_sampled_box_points",
    f"""{_SKEWED_SQL}, d AS ({_sampled_sql(V.CHART_ROWS, source="s")}), b AS ({_bounds_sql(["unit"], "d")})
        SELECT r AS {ROW}, unit FROM d, b WHERE unit < lo OR unit > hi""",
)
def v7(spark, folder):
    return V.sampled_box(skewed_lines(spark, folder), "unit")[1]


@query(
    "v8_density",
    """WITH b AS (SELECT min(l_quantity) AS xl, (max(l_quantity) - min(l_quantity)) / 28 AS xw,
                         min(l_extendedprice) AS yl, (max(l_extendedprice) - min(l_extendedprice)) / 28 AS yw FROM lineitem),
       n AS (SELECT least(27, greatest(0, CAST(floor((l_quantity - xl) / xw) AS BIGINT))) AS x_bin,
                    least(27, greatest(0, CAST(floor((l_extendedprice - yl) / yw) AS BIGINT))) AS y_bin, count(*) AS count
             FROM lineitem, b GROUP BY 1, 2),
       g AS (SELECT x.range AS x_bin, y.range AS y_bin, format('{:.4g}', xl + (x.range + 0.5) * xw) AS x_label,
                    format('{:.4g}', yl + (y.range + 0.5) * yw) AS y_label FROM range(28) x, range(28) y, b)
       SELECT x_bin, y_bin, x_label, y_label, coalesce(count, 0) AS count FROM g LEFT JOIN n USING (x_bin, y_bin)""",
)
def v8(spark, folder):
    return V.density(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice")


@query("v9_scatter", f"SELECT l_quantity AS x, l_extendedprice AS y FROM ({_sampled_sql(V.CHART_ROWS)})")
def v9(spark, folder):
    return V.scatter(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice")


@query(
    "v10_line_over_time",
    """WITH g AS (SELECT l_shipdate AS x, avg(l_extendedprice) AS y FROM lineitem GROUP BY 1),
       b AS (SELECT *, ntile(180) OVER (ORDER BY x) AS bucket FROM g)
       SELECT strftime(min(x), '%Y-%m-%d') AS x, round(avg(y), 4) AS y FROM b GROUP BY bucket""",
)
def v10(spark, folder):
    points = V.line_time(table(spark, folder, "lineitem"), "l_shipdate", "l_extendedprice")
    return points.selectExpr("date_format(x, 'yyyy-MM-dd') AS x", "round(y, 4) AS y")


@query(
    "v11_line_over_rows",
    """WITH o AS (SELECT event_id + 1 AS record_index, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS y FROM events),
       b AS (SELECT *, ntile(180) OVER (ORDER BY record_index) AS bucket FROM o WHERE y IS NOT NULL)
       SELECT min(record_index) AS record_index, round(avg(y), 4) AS y FROM b GROUP BY bucket""",
)
def v11(spark, folder):
    events = table(spark, folder, "events")
    gappy = events.selectExpr("CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS value", ROW)
    return V.line_order(gappy, "value", block_rows=1000).selectExpr("record_index", "round(y, 4) AS y")


@query(
    "v12_sampled_line",
    f"SELECT l_shipdate AS x, round(avg(l_extendedprice), 4) AS y FROM ({_sampled_sql(V.CHART_ROWS)}) GROUP BY 1",
)
def v12(spark, folder):
    points = V.sampled_line(table(spark, folder, "lineitem"), "l_extendedprice", "l_shipdate")
    return points.select(F.col("x").cast("timestamp_ntz").alias("x"), F.round("y", 4).alias("y"))


@query("v13_heatmap", MATRIX_SQL)
def v13(spark, folder):
    pairs = R.correlation_pairs(table(spark, folder, "lineitem"), NUMBERS)
    return R.heatmap(pairs, NUMBERS).select("x", "y", "correlation")


@query("v14_charts_raw")
def v14(spark, folder):
    return V.charts(table(spark, folder, "lineitem"), "raw")


@query("v14_charts_clean")
def v14_clean(spark, folder):
    return V.charts(table(spark, folder, "events"), "clean")


# --- samples, sorts, pages, windows -------------------------------------------------------------


@query("k1_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 3000")
def k1(spark, folder):
    return K.head(table(spark, folder, "orders"), 3000).select("o_orderkey", "o_totalprice")


@query("k2_reservoir_sample", f"SELECT * EXCLUDE r FROM ({_sampled_sql(3000)})")
def k2(spark, folder):
    return K.sample_n(table(spark, folder, "lineitem"), 3000).drop(ROW)


@query("k3_capped_sample", f"SELECT * EXCLUDE r FROM ({_sampled_sql(5000)})")
def k3(spark, folder):
    return K.cap_rows(table(spark, folder, "lineitem"), 5000).drop(ROW)


@query(
    "k4_order_by",
    "SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM orders",
)
def k4(spark, folder):
    ordered = K.order_by(table(spark, folder, "orders"), "o_orderdate").select("o_orderkey", "o_orderdate", ROW)
    # partitions of a sorted table follow each other, so ids ascend in its order
    slots = materialize(ordered.withColumn("_slot", F.monotonically_increasing_id()), "ordered")
    placed = H.sorted_positions(slots, ["_slot"], "place")
    return placed.selectExpr("o_orderkey", "o_orderdate", "place + 1 AS place")


@query("k5_page", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 75 AND 99")
def k5(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", ROW)
    return K.page(orders, 4)


@query(
    "k5_page_info",
    """SELECT CAST(4 AS BIGINT) AS page, CAST(25 AS BIGINT) AS page_size, count(*) AS total_rows,
       CAST(greatest(ceil(count(*) / 25.0), 1) AS BIGINT) AS total_pages FROM orders""",
)
def k5_info(spark, folder):
    return K.page_info(table(spark, folder, "orders"), 4)


@query(
    "k6_top_k",
    """SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_suppkey
       ORDER BY total DESC, l_suppkey LIMIT 8""",
)
def k6(spark, folder):
    totals = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return K.top_k(totals, 8, "total", ["l_suppkey"])


@query("u2_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def u2(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", ROW)
    return C.drop_duplicates(lines).drop(ROW)


@query(
    "w1_ntile",
    """SELECT o_orderkey, ntile(180) OVER (ORDER BY o_totalprice, o_orderkey) AS bucket FROM orders""",
)
def w1(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", ROW)
    placed = H.sorted_positions(orders, ["o_totalprice", "o_orderkey"], "position")
    return spark.sql(
        f"SELECT o_orderkey, {X.ntile_of('position', 'total', 180)} AS bucket FROM {{p}}, (SELECT count(*) AS total FROM {{p}})",
        p=placed,
    )


@query(
    "w2_row_number",
    "SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE event_type = 'click'",
)
def w2(spark, folder):
    clicks = table(spark, folder, "events").where("event_type = 'click'").select("event_id", ROW)
    return H.positions(clicks, "position", block_rows=1000).selectExpr("event_id", "position + 1 AS n")


@query(
    "w3_carry_values",
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 1 THEN value END AS value FROM events)
       SELECT event_id, coalesce(
         last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM e""",
)
def w3(spark, folder):
    events = table(spark, folder, "events").selectExpr("event_id", "CASE WHEN event_id % 3 = 1 THEN value END AS value", ROW)
    return H.fill_both_ways(events, ["value"], block_rows=1000).select("event_id", "value")


# --- models ------------------------------------------------------------------------------------


@query(
    "m2_target_mode",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS target, count({c}) AS present, count(DISTINCT {c}) AS distinct,
        CASE WHEN {fractional} OR (count(DISTINCT {c}) >= 20 AND count(DISTINCT {c}) / count({c}) >= 0.005)
             THEN 'regression' ELSE 'classification' END AS mode FROM lineitem"""
        for c, fractional in (("l_linenumber", "false"), ("l_partkey", "false"), ("l_tax", "true"), ("l_suppkey", "false"))
    ),
)
def m2(spark, folder):
    lines = table(spark, folder, "lineitem")
    targets = ("l_linenumber", "l_partkey", "l_tax", "l_suppkey")
    return M.target_table(lines, targets[0]).unionByName(M.target_table(lines, targets[1])).unionByName(
        M.target_table(lines, targets[2])).unionByName(M.target_table(lines, targets[3]))


@query(
    "m3_features",
    """SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) /
         (SELECT stddev_pop(o_totalprice) FROM orders), 4) AS total_scaled,
       round((epoch(o_orderdate) - (SELECT avg(epoch(o_orderdate)) FROM orders)) /
         (SELECT stddev_pop(epoch(o_orderdate)) FROM orders), 4) AS date_scaled,
       CAST(o_orderstatus = 'F' AS DOUBLE) AS is_f, CAST(o_orderstatus = 'O' AS DOUBLE) AS is_o,
       CAST(o_orderstatus = 'P' AS DOUBLE) AS is_p FROM orders""",
)
def m3(spark, folder):
    orders = table(spark, folder, "orders").select("o_totalprice", "o_orderdate", "o_orderstatus", "o_orderkey")
    features = M.feature_pipeline(orders.drop("o_orderkey"))
    rows = features.transform(M.times_as_seconds(orders)).select("o_orderkey", vector_to_array("features").alias("v"))
    return rows.selectExpr(
        "o_orderkey", "round(v[0], 4) AS total_scaled", "round(v[1], 4) AS date_scaled", "v[2] AS is_f", "v[3] AS is_o", "v[4] AS is_p"
    )


@query(
    "m3_one_hot_levels",
    """WITH p AS (SELECT p_partkey, concat(p_brand, '/', p_type, '/', p_size) AS kind FROM part)
       SELECT p_partkey, dense_rank() OVER (ORDER BY kind) AS level, 1 + (SELECT count(DISTINCT kind) FROM p) AS slots,
       kind AS name FROM p""",
)
def m3_levels(spark, folder):
    """The slot of each part's kind among all kinds, behind one number, and the name that belongs to it."""
    part = spark.read.parquet(f"{folder}/part.parquet").selectExpr(
        "p_partkey", "concat(p_brand, '/', p_type, '/', p_size) AS kind", "p_retailprice"
    )
    features = M.feature_pipeline(part.drop("p_partkey"))
    # a sparse vector prints as (size,[slots],[values]); the level has the last slot
    rows = features.transform(part).selectExpr("p_partkey", "CAST(features AS STRING) AS v")
    found = rows.selectExpr(
        "p_partkey",
        r"CAST(regexp_extract(v, '([0-9]+)\\],', 1) AS BIGINT) AS level",
        r"CAST(regexp_extract(v, '^.([0-9]+),', 1) AS BIGINT) AS slots",
    )
    names = features.levels[0].selectExpr("CAST(_i AS BIGINT) + 1 AS level", "_c AS name")
    return found.join(names, "level")


@query("m4_regression")
def m4(spark, folder):
    return M.model(table(spark, folder, "orders"), "o_totalprice").table(spark)


@query("m5_classification")
def m5(spark, folder):
    return M.model(table(spark, folder, "orders"), "o_orderstatus").table(spark)


@query("m5_class_counts", "SELECT o_orderstatus AS class, count(*) AS count FROM orders GROUP BY 1")
def m5_counts(spark, folder):
    return M.class_counts(table(spark, folder, "orders"), "o_orderstatus")


@query(
    "m6_split",
    """SELECT 'test' AS part, CAST(ceil(count(*) * 0.2) AS BIGINT) AS rows FROM orders
       UNION ALL SELECT 'train', count(*) - CAST(ceil(count(*) * 0.2) AS BIGINT) FROM orders""",
)
def m6(spark, folder):
    train, test = M.split(table(spark, folder, "orders"), stratify="o_orderpriority")
    sized = [p.agg(F.count(F.lit(1)).alias("rows")).withColumn("part", F.lit(n)) for n, p in (("train", train), ("test", test))]
    return sized[0].unionByName(sized[1])


@query(
    "m6_split_members",
    f"""WITH o AS (SELECT o_orderkey, o_orderpriority AS c, {_sample_hash_sql("o_orderkey")} >> 8 AS key FROM orders),
        s AS (SELECT c, count(*) AS n, CAST(floor(count(*) * 0.2::DOUBLE) AS BIGINT) AS k FROM o GROUP BY c),
        w AS (SELECT c, k + CAST(row_number() OVER (ORDER BY k - n * 0.2::DOUBLE, c) <=
                    (SELECT ceil(sum(n) * 0.2::DOUBLE) - sum(k) FROM s) AS INT) AS wanted FROM s),
        p AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY key) AS place FROM o)
        SELECT o_orderkey, CASE WHEN place <= wanted THEN 'test' ELSE 'train' END AS part FROM p JOIN w USING (c)""",
)
def m6_members(spark, folder):
    """Row numbers of orders are their keys."""
    train, test = M.split(table(spark, folder, "orders"), stratify="o_orderpriority")
    named = [p.select("o_orderkey", F.lit(n).alias("part")) for n, p in (("train", train), ("test", test))]
    return named[0].unionByName(named[1])


GUESSED = """SELECT l_returnflag AS label, CASE WHEN l_linenumber <= 3 THEN l_returnflag
    WHEN l_linestatus = 'O' THEN 'N' ELSE 'A' END AS prediction FROM lineitem"""


@query(
    "m5_metrics",
    f"""WITH g AS ({GUESSED}), n AS (SELECT count(*) AS n FROM g),
        c AS (SELECT label, count(*) AS actual, CAST(sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS DOUBLE) AS hit,
              any_value(said) AS said FROM g LEFT JOIN (SELECT prediction AS p, count(*) AS said FROM g GROUP BY 1) ON label = p GROUP BY label),
        r AS (SELECT actual / n AS share, hit / actual AS recall, coalesce(hit / said, 0) AS prec, hit, n FROM c, n),
        m AS (SELECT round(sum(hit) / any_value(n), 4) AS accuracy, round(sum(share * prec), 4) AS "precision",
              round(sum(share * recall), 4) AS recall,
              round(sum(share * CASE WHEN prec + recall > 0 THEN 2 * prec * recall / (prec + recall) ELSE 0 END), 4) AS f1_score FROM r)
        UNPIVOT m ON accuracy, "precision", recall, f1_score INTO NAME metric VALUE "value" """,
)
def m5_metrics(spark, folder):
    guessed = spark.sql(GUESSED.replace("FROM lineitem", "FROM {lines}"), lines=table(spark, folder, "lineitem"))
    return small_frame(spark, list(M.classification_metrics(guessed).items()), "metric string, value double")


@query(
    "m4_metrics",
    """WITH g AS (SELECT l_extendedprice AS label, l_quantity * 1000 AS prediction FROM lineitem),
       m AS (SELECT round(sqrt(avg((label - prediction) ** 2)), 4) AS rmse, round(avg(abs(label - prediction)), 4) AS mae,
             round(1 - sum((label - prediction) ** 2) / (var_pop(label) * count(*)), 4) AS r2 FROM g)
       UNPIVOT m ON rmse, mae, r2 INTO NAME metric VALUE "value" """,
)
def m4_metrics(spark, folder):
    guessed = table(spark, folder, "lineitem").selectExpr("l_extendedprice AS label", "l_quantity * 1000 AS prediction")
    return small_frame(spark, list(M.regression_metrics(guessed).items()), "metric string, value double")


WIDE = {f"w{k}": (1 + k % 7, 3 + k % 11, 11 + k) for k in range(210)}
WIDE_COLUMNS = [f"CAST((l_orderkey * {a} + l_partkey * {b} + l_linenumber) % {m} AS DOUBLE) AS {c}" for c, (a, b, m) in WIDE.items()]
WIDE_COLUMNS[5] = "CASE WHEN l_linenumber > 2 THEN l_quantity END AS w5"
WIDE_COLUMNS[6] = "7.0 AS w6"
WIDE_SHOWN = ["w0", "w5", "w6", "w100"]


@query(
    "r1_wide_matrix",
    f"""WITH t AS (SELECT {", ".join(WIDE_COLUMNS)} FROM lineitem),
        r AS ({" UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, corr({x}, {y}) AS r FROM t" for x in WIDE_SHOWN for y in WIDE if x != y)})
        SELECT x, y, CASE WHEN isnan(r) THEN NULL ELSE round(r, 3) END AS correlation FROM r""",
)
def r1_wide(spark, folder):
    """The matrix of 210 columns, one with gaps and one constant; the SQL repeats four of its rows."""
    wide = spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr(*WIDE_COLUMNS)
    matrix = R.correlation_matrix(wide)
    return matrix.where(F.col("x").isin(WIDE_SHOWN) & (F.col("x") != F.col("y"))).select("x", "y", "correlation")


@query("m7_assignment", "SELECT count(*) AS row_count, count(*) AS nearest, true AS enough_starts FROM customer")
def m7_assignment(spark, folder):
    """Rows whose cluster has the nearest of the returned centres, recomputed by SQL."""
    found = M.cluster(table(spark, folder, "customer"))
    size = len(found.features.select("features").first()["features"])
    rows = materialize(KM.entries(found.features, size, ["key", "prediction"]), "entries")
    # a row's squared distance is its own square less twice its product with the centre, from which half the centre's square is taken
    halves = found.centres.groupBy("cluster").agg((-F.sum(F.col("value") ** 2) / 2).alias("value")).select("cluster", F.lit(-1).alias("at"), "value")
    centres = materialize(found.centres.where("value <> 0").unionByName(halves), "centres")
    # slots of more than a thousandth of the rows are few: their centres go to every task, those of all others meet rows by the slot
    many = found.features.count()
    often = F.broadcast(rows.groupBy("at").count().where(F.col("count") * KM.COMMON > many).select("at"))
    near, far = (rows.join(F.broadcast(centres.join(often, "at", "left_semi")), "at"), rows.join(often, "at", "left_anti").join(centres, "at"))
    products = near.unionByName(far).groupBy("key", "prediction", "cluster").agg(F.sum(F.col("v") * F.col("value")).alias("p"))
    squares = rows.where("at >= 0").groupBy("key").agg(F.sum(F.col("v") ** 2).alias("s"))
    apart = products.join(squares, "key", "left").withColumn("d", F.greatest(F.coalesce("s", F.lit(0.0)) - 2 * F.col("p"), F.lit(0.0)))
    best = apart.groupBy("key", "prediction").agg(F.min("d").alias("least"), F.min(F.when(F.col("cluster") == F.col("prediction"), F.col("d"))).alias("own"))
    close = F.count_if(F.col("own") <= F.col("least") * (1 + 1e-9) + 1e-9)
    return best.agg(F.count(F.lit(1)).alias("row_count"), close.alias("nearest")).withColumn("enough_starts", F.lit(M.STARTS >= 10))


@query("m7_clusters")
def m7(spark, folder):
    return M.cluster(table(spark, folder, "customer")).clusters


@query(
    "m8_silhouette",
    """WITH p AS (SELECT c_mktsegment AS g, CAST(c_nationkey AS DOUBLE) AS x, c_acctbal / 1000 AS y FROM customer),
       s AS (SELECT g, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x + y * y) AS ss FROM p GROUP BY g),
       d AS (SELECT p.x, p.y, p.g, s.g = p.g AS own,
                    n * (p.x * p.x + p.y * p.y) + ss - 2 * (p.x * sx + p.y * sy) AS total, n FROM p, s),
       m AS (SELECT x, y, g, max(CASE WHEN own THEN total / (n - 1) END) AS inside, min(CASE WHEN NOT own THEN total / n END) AS nearest
             FROM d GROUP BY ALL)
       SELECT round(avg((nearest - inside) / greatest(nearest, inside)), 6) AS silhouette FROM m""",
)
def m8(spark, folder):
    """Customers grouped by segment; segments differ in their first letter."""
    customers = spark.read.parquet(f"{folder}/customer.parquet").selectExpr(
        "c_nationkey AS x", "c_acctbal / 1000 AS y", "CAST(ascii(c_mktsegment) AS DOUBLE) AS prediction"
    )
    grouped = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(customers)
    return small_frame(spark, [(round(M.silhouette(grouped), 6),)], "silhouette double")


@query("m9_feature_importance")
def m9(spark, folder):
    return M.regress(table(spark, folder, "part"), "p_retailprice").importance


def _scored_both_ways(found: M.ModelResult, rows: DataFrame, key: str) -> DataFrame:
    """Rows scored by the fitted model and, level by level, by its node table."""
    classes = getattr(found.fitted, "numClasses", 0)
    scored = materialize(found.inputs.transform(M.times_as_seconds(rows)).select(key, "features"), "scored")
    by_nodes = W.score(scored, W.node_table(found.fitted), key, classes)
    by_model = found.fitted.transform(scored).select(key, F.col("prediction").alias("said"))
    return by_nodes.join(by_model, key)


@query("m4_node_table", "SELECT o_orderkey, true AS agrees FROM orders")
def m4_nodes(spark, folder):
    """Whether the node table of the regression gives each order the model's prediction."""
    orders = table(spark, folder, "orders")
    both = _scored_both_ways(M.regress(orders, "o_totalprice"), orders, "o_orderkey")
    return both.select("o_orderkey", (F.abs(F.col("prediction") - F.col("said")) <= 1e-9 * F.abs("said")).alias("agrees"))


@query("m5_node_table", "SELECT o_orderkey, true AS agrees FROM orders")
def m5_nodes(spark, folder):
    """Whether the class the model gives each order has the most votes by the node table."""
    orders = table(spark, folder, "orders")
    both = _scored_both_ways(M.classify(orders, "o_orderstatus"), orders, "o_orderkey")
    ahead = F.array_max("votes") - F.get("votes", F.col("said").cast("int"))
    return both.select("o_orderkey", (ahead <= 1e-9).alias("agrees"))


@query(
    "m9_node_gains",
    """SELECT 'p_partkey' AS feature, true AS agrees UNION ALL SELECT 'p_size', true
       UNION ALL SELECT DISTINCT concat('p_brand_', p_brand), true FROM part""",
)
def m9_gains(spark, folder):
    """Whether the gains of the node table give each slot the model's importance."""
    part = table(spark, folder, "part").select(ROW, "p_partkey", "p_size", "p_brand", "p_retailprice")
    found = M.regress(part, "p_retailprice")
    weights, names = found.fitted.featureImportances.toArray(), found.inputs.names(range(found.inputs.size))
    slots = small_frame(spark, [(i, names[i], float(w)) for i, w in enumerate(weights)], "slot int, feature string, said double")
    both = slots.join(W.importance(W.node_table(found.fitted)), "slot", "left")
    return both.select("feature", (F.abs(F.coalesce("importance", F.lit(0.0)) - F.col("said")) <= 1e-9).alias("agrees"))


# --- reports and the report store ----------------------------------------------------------------


@query("n1_analyze_clean")
def n1(spark, folder):
    return report.analyze(dirty_events(spark, folder), "events", target="amount").records()


@query("n2_raw_sections")
def n2_sections(spark, folder):
    return report.analyze(table(spark, folder, "lineitem"), "lines", mode="raw", modeling=False).records()


@query("n2_analyze_raw")
def n2(spark, folder):
    return report.analyze(table(spark, folder, "lineitem"), "lines", mode="raw", modeling=False).columns()


@query(
    "n3_preview",
    f"WITH drawn AS MATERIALIZED ({_sampled_sql(1500)}), "
    + _statistics_sql(NUMBERS, ["l_returnflag", "l_linestatus"], "l_shipdate", "drawn"),
)
def n3(spark, folder):
    statistics = report.preview(table(spark, folder, "lineitem"), "lines").summary_statistics()
    return statistics.drop("position", "dtype", "kind", "castable_count")


@query(
    "n4_narrative",
    f"""{CLEANED}, n AS (SELECT (SELECT count(*) FROM dirty) AS o, (SELECT count(*) FROM typed) AS t, (SELECT count(*) FROM cleaned) AS c,
        (SELECT 4 * count(*) - count(id) - count(day) - count(kind) - count(amount) FROM typed) AS m)
        SELECT CAST(1 AS INTEGER) AS place, concat('The dataset was cleaned from ', o, ' rows to ', c,
               ' rows and now contains 4 usable columns.') AS text FROM n
        UNION ALL SELECT 2, concat(t - c, ' duplicate rows were removed before analysis.') FROM n WHERE t > c
        UNION ALL SELECT 3, concat('The pipeline handled ', m, ' missing values automatically.') FROM n""",
)
def n4(spark, folder):
    told = report.analyze(dirty_events(spark, folder), "events", modeling=False).narrative()
    return told.where("section = 'insights' AND place <= 3").select("place", "text")


def stored_orders(spark, folder) -> DataFrame:
    """Orders in the columns of the reports table."""
    return spark.read.parquet(f"{folder}/orders.parquet").selectExpr(
        "o_orderkey AS report_id", "o_custkey AS user_id", "o_orderdate AS created_at", "o_orderstatus AS status"
    )


@query(
    "n5_history",
    """SELECT o_orderkey AS report_id, o_custkey AS user_id, o_orderdate AS created_at, o_orderstatus AS status
       FROM orders WHERE o_custkey = 7""",
)
def n5(spark, folder):
    return store.history(stored_orders(spark, folder), 7)


@query(
    "n6_snapshot",
    """WITH s AS (
        SELECT 0 AS position, 'o_orderkey' AS "column", 'bigint' AS type, count(DISTINCT o_orderkey) AS unique_values,
          concat('mean: ', round(avg(o_orderkey), 4), ', min: ', min(o_orderkey)::DOUBLE, ', max: ', max(o_orderkey)::DOUBLE) AS highlights FROM orders
        UNION ALL SELECT 1, 'o_custkey', 'bigint', count(DISTINCT o_custkey),
          concat('mean: ', round(avg(o_custkey), 4), ', min: ', min(o_custkey)::DOUBLE, ', max: ', max(o_custkey)::DOUBLE) FROM orders
        UNION ALL SELECT 2, 'o_orderstatus', 'string', count(DISTINCT o_orderstatus), concat('top_value: ',
          (SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) FROM orders
        UNION ALL SELECT 3, 'o_totalprice', 'double', count(DISTINCT o_totalprice),
          concat('mean: ', round(avg(o_totalprice), 4), ', min: ', round(min(o_totalprice), 4), ', max: ', round(max(o_totalprice), 4)) FROM orders
        UNION ALL SELECT 4, 'o_orderdate', 'timestamp_ntz', count(DISTINCT o_orderdate), concat('min: ',
          strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S'), ', max: ', strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S')) FROM orders
        UNION ALL SELECT 5, 'o_orderpriority', 'string', count(DISTINCT o_orderpriority), concat('top_value: ',
          (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) FROM orders)
       SELECT CAST(position AS INTEGER) AS position, "column", type, unique_values, highlights FROM s""",
)
def n6(spark, folder):
    return report.snapshot(D.summary_statistics(table(spark, folder, "orders")))


@query(
    "n7_kpis",
    """WITH r AS (SELECT 'o_orderkey' AS a, 'o_custkey' AS b, corr(o_orderkey, o_custkey) AS r, 1 AS i FROM orders
        UNION ALL SELECT 'o_orderkey', 'o_totalprice', corr(o_orderkey, o_totalprice), 2 FROM orders
        UNION ALL SELECT 'o_custkey', 'o_totalprice', corr(o_custkey, o_totalprice), 3 FROM orders),
       best AS (SELECT a, b, round(r, 3) AS r FROM r ORDER BY abs(round(r, 3)) DESC, i LIMIT 1)
       SELECT 'Rows' AS label, format('{:,}', count(*)) AS value, '6 columns profiled' AS note FROM orders
       UNION ALL SELECT 'Missing values', '0', 'Across the current analytics profile'
       UNION ALL SELECT 'Strongest pair', format('{:.2f}', r), concat(a, ' x ', b) FROM best""",
)
def n7(spark, folder):
    return report.analyze(table(spark, folder, "orders"), "orders", modeling=False).kpis()


@query(
    "s11_report_round_trip",
    """SELECT "column", count AS castable_count, mean, median, std, min, max, q1, q3 FROM ("""
    + _summary_sql(["o_orderkey", "o_custkey", "o_totalprice"], "orders")
    + ")",
)
def s11(spark, folder):
    reports = store.ReportStore(spark, scratch_path(spark, "store"))
    orders = table(spark, folder, "orders")
    done = report.analyze(orders, "orders", modeling=False)
    report_id = reports.save(done, "analyst", staging.fingerprint(orders))
    fields = "column string, castable_count long, mean double, median double, std double, min double, max double, q1 double, q3 double"
    records = reports.load(report_id, "summary_statistics").select(F.from_json("record", fields).alias("r"))
    return records.select("r.*").where("castable_count IS NOT NULL")


@query(
    "s11_all_sections",
    f"""SELECT section, true AS same FROM (VALUES {", ".join(f"('{s}')" for s in report.SECTIONS)}) s(section)""",
)
def s11_sections(spark, folder):
    """Whether each stored section holds the report's records, no more and no less."""
    reports = store.ReportStore(spark, scratch_path(spark, "store"))
    orders = table(spark, folder, "orders")
    done = report.analyze(orders, "orders", modeling=False)
    report_id = reports.save(done, "analyst", staging.fingerprint(orders))
    stored = [reports.load(report_id, s).select(F.lit(s).alias("section"), "record", F.lit(-1).alias("n")) for s in report.SECTIONS]
    shown = done.records().select("section", "record", F.lit(1).alias("n"))
    both = reduce(DataFrame.unionByName, stored, shown).groupBy("section", "record").agg(F.sum("n").alias("n"))
    same = both.groupBy("section").agg(F.bool_and(F.col("n") == 0).alias("same"))
    sections = small_frame(spark, [(s,) for s in report.SECTIONS], "section string")
    return sections.join(same, "section", "left").select("section", F.coalesce("same", F.lit(True)).alias("same"))  # empty on both sides


@query(
    "j1_report_status",
    """SELECT c_custkey AS report_id, c_mktsegment AS status, o_orderkey AS entry_id, o_orderstatus AS entry_status,
       o_orderpriority AS content_hash FROM customer JOIN orders ON c_custkey = o_custkey
       JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey""",
)
def j1(spark, folder):
    reports = spark.read.parquet(f"{folder}/customer.parquet").selectExpr("c_custkey AS report_id", "c_mktsegment AS status")
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    returned = spark.read.parquet(f"{folder}/lineitem.parquet").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("entry_id")).distinct()
    links = orders.selectExpr("o_custkey AS report_id", "o_orderkey AS entry_id")
    entries = orders.selectExpr("o_orderkey AS entry_id", "o_orderstatus AS status", "o_orderpriority AS content_hash")
    return store.report_status(reports, links.join(returned, "entry_id"), entries)
