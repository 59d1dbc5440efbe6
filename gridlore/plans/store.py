"""Finished reports as Parquet tables: reports, cache entries, the links between them, sections."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridlore.functions.names import normalize_name
from gridlore.plans.report import SECTIONS, Report, analyze
from gridlore.session import small_frame
from gridlore.sources.staging import fingerprint

PUBLISH_TRIES = 5
SCHEMAS = {
    "reports": "report_id string, user_id string, dataset_name string, target_column string, status string, "
    "row_count long, column_count long, created_at timestamp",
    "entries": "entry_id string, content_hash string, target_column string, mode string, status string, "
    "row_count long, column_count long, created_at timestamp",
    "links": "report_id string, entry_id string",
    "sections": "section string, place long, record string, entry_id string",
}


def report_status(reports: DataFrame, links: DataFrame, entries: DataFrame) -> DataFrame:
    """Each report with the state of the cache entry behind it."""
    entry = entries.select("entry_id", F.col("status").alias("entry_status"), "content_hash")
    return reports.join(links, "report_id").join(entry, "entry_id")


def history(reports: DataFrame, user_id) -> DataFrame:
    """Reports of one user, newest first."""
    return reports.where(F.col("user_id") == user_id).orderBy(F.col("created_at").desc(), "report_id")


class ReportStore:
    """Append-only tables under one folder. A section's records are stored once per cache entry,
    in that entry's partition; reports on the same data and target link to the same entry. An entry is one
    file, published once its sections are complete: there is one per data, target and mode at most,
    whatever fails or runs at the same time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def table(self, name: str) -> DataFrame:
        schema = T._parse_datatype_string(SCHEMAS[name])
        empty = small_frame(self.spark, [], schema)
        files, path = self._files(self._path(name))
        if not files.exists(path):
            return empty
        reader = self.spark.read.schema(schema)
        return reader.option("mode", "DROPMALFORMED").json(self._path(name)) if name == "entries" else reader.parquet(self._path(name))

    def _files(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _published(self, path: str) -> dict | None:
        files, place = self._files(path)
        stream = files.open(place)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text) if text.endswith("\n") else None

    def _publish(self, entry: dict) -> dict:
        """Make an entry visible, unless one for the same data, target and mode is: the one that is there.

        The entry's file is named by these three and only made if there is none, so one of several writers
        wins. A file without a full line is left from a crash and shows nothing.
        """
        key = hashlib.sha256(json.dumps([entry["content_hash"], entry["target_column"], entry["mode"]]).encode()).hexdigest()
        path = f"{self._path('entries')}/{key}.json"
        files, place = self._files(path)
        for _ in range(PUBLISH_TRIES):
            try:
                out = files.create(place, False)
            except Py4JJavaError:
                found = self._published(path) if files.exists(place) else None
                if found:
                    return found
                files.delete(place, False)
                continue
            out.write(bytearray((json.dumps(entry) + "\n").encode()))
            out.close()
            # whoever took the file for a crash's remains has replaced it
            found = self._published(path)
            if found:
                return found
        raise RuntimeError("The report cannot be published.")

    def _append(self, name: str, rows: list[tuple]) -> None:
        small_frame(self.spark, rows, SCHEMAS[name]).coalesce(1).write.mode("append").parquet(self._path(name))

    def save(self, report: Report, user_id: str, content_hash: str, sections: tuple[str, ...] = SECTIONS) -> str:
        """Store the sections of a finished report as a new cache entry, and a report on it."""
        entry_id, now = uuid.uuid4().hex, dt.datetime.now(dt.timezone.utc)
        parts = report.records(sections).withColumn("entry_id", F.lit(entry_id))
        parts.coalesce(1).write.mode("append").partitionBy("entry_id").parquet(self._path("sections"))
        s = report.summary
        values = (entry_id, content_hash, report.target, report.mode, "completed", s.cleaned_rows, s.cleaned_columns, now.isoformat())
        # sections are invisible until their entry is published, and a report until its link is written
        entry = self._publish(dict(zip(T._parse_datatype_string(SCHEMAS["entries"]).names, values)))
        return self._attach(entry["entry_id"], user_id, report.name, report.target, s.cleaned_rows, s.cleaned_columns)

    def _attach(self, entry_id, user_id, name, target, rows, columns) -> str:
        report_id, now = uuid.uuid4().hex, dt.datetime.now(dt.timezone.utc)
        self._append("links", [(report_id, entry_id)])
        self._append("reports", [(report_id, user_id, name, target, "completed", rows, columns, now)])
        return report_id

    def find(self, content_hash: str, target: str | None, mode: str = "clean") -> DataFrame:
        """Finished cache entries for the same data, target and mode, newest first."""
        wanted = (
            (F.col("content_hash") == content_hash)
            & F.col("target_column").eqNullSafe(F.lit(target))
            & (F.col("mode") == mode)
            & (F.col("status") == "completed")
        )
        return self.table("entries").where(wanted).orderBy(F.col("created_at").desc())

    def reuse_or_run(
        self, df: DataFrame, name: str, user_id: str, target: str | None = None, mode: str = "clean", **options
    ) -> tuple[str, bool]:
        """(report id, reused): link to the finished analysis of the same data, or run and store one."""
        content_hash = fingerprint(df)
        if options:  # another choice of options makes another report
            content_hash += "-" + hashlib.sha256(repr(sorted(options.items())).encode()).hexdigest()[:16]
        wanted = normalize_name(target) if target else None
        known = self.find(content_hash, wanted, mode).first()
        if known:
            return self._attach(known.entry_id, user_id, name, wanted, known.row_count, known.column_count), True
        return self.save(analyze(df, name, target, mode, **options), user_id, content_hash), False

    def status(self, report_id: str) -> DataFrame:
        reports = self.table("reports").where(F.col("report_id") == report_id)
        return report_status(reports, self.table("links"), self.table("entries"))

    def history(self, user_id: str) -> DataFrame:
        return history(self.table("reports"), user_id)

    def load(self, report_id: str, section: str) -> DataFrame:
        """One stored section as JSON records; only its entry's partition is read."""
        link = self.table("links").where(F.col("report_id") == report_id).first()
        if link is None:
            raise ValueError("Unknown report.")
        stored = self.table("sections").where((F.col("entry_id") == link.entry_id) & (F.col("section") == section))
        return stored.orderBy("place").select("place", "record")
