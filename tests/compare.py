"""Run registered queries next to their SQL twins: ``python tests/compare.py [folder] [name part...]``."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, (float, decimal.Decimal)):
        return repr(float(value) + 0.0)
    if isinstance(value, int):
        return repr(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> str:
    """Empty when both sides hold the same rows under the same names, else what differs first."""
    ours, ours_rows = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    theirs, their_rows = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if ours != theirs:
        return f"columns {ours} != {theirs}"
    if len(ours_rows) != len(their_rows):
        return f"{len(ours_rows)} rows != {len(their_rows)}"
    wrong = [(a, b) for a, b in zip(ours_rows, their_rows) if a != b]
    return f"{len(wrong)} rows differ, e.g. {wrong[0]}" if wrong else ""


def main() -> int:
    from conftest import build_session

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session()
    con = connect(folder)
    oracle, failed = entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            result = differences(df, con, oracle[name]) if name in oracle else f"rows={df.count()}"
        except Exception as error:
            result = f"{type(error).__name__}: {str(error)[:600]}"
        bad = bool(result) and not result.startswith("rows=")
        failed += [name] if bad else []
        print(f"{'FAIL' if bad else 'ok  '} {name} {time.time() - start:.2f}s {result}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
