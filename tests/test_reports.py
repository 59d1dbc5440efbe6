"""Whole analyses, the store and plan shapes."""

from __future__ import annotations

import json

import pytest

import gridlore
from gridlore.operators import charts, cleaning, correlation, outliers, profile, sampling
from gridlore.operators.ordering import ROW
from gridlore.plans import store
from gridlore.plans.report import SECTIONS, analyze
from gridlore.session import scratch_path, small_frame
from gridlore.sources.readers import from_rows, read_parquet


@pytest.fixture(scope="module")
def events(spark, folder):
    return read_parquet(spark, f"{folder}/events.parquet")


def test_manual_rows_to_report(spark):
    rows = [
        {"port": "Aalborg", "cargo": "10", "crew": "3", "flag": "red"},
        {"port": "Bergen", "cargo": "20", "crew": "7", "flag": "blue"},
        {"port": "Cadiz", "cargo": "40", "crew": "9", "flag": "red"},
    ]
    report = gridlore.analyze(from_rows(spark, ["port", "cargo", "crew", "flag"], rows), "manual")
    assert report.summary.types["cargo"] == report.summary.types["crew"] == "bigint"
    assert report.model.status == "skipped"
    document = json.loads(report.to_json())
    assert set(SECTIONS) <= set(document)
    assert document["strongest_pairs"][0]["correlation"] == 0.929  # 260 / sqrt(1400 * 56)
    assert {c["chart_type"] for c in document["charts"]} == {"bar", "pie", "histogram", "box", "scatter", "line", "heatmap"}
    advice = [r["text"] for r in document["narrative"] if r["section"] == "recommendations"]
    assert any("target column" in a for a in advice)


def test_raw_mode(spark, events):
    report = gridlore.analyze(events, "events", mode="raw", modeling=False)
    counts = report.cleaning().first()
    assert counts.duplicate_rows_removed is None and counts.cleaned_rows == events.count()
    assert report.correlations().count() == 9
    assert "density-event_id-user_id" in {r.chart_id for r in report.charts().select("chart_id").distinct().collect()}


def test_errors(spark, events):
    with pytest.raises(ValueError):
        gridlore.analyze(events.limit(0), "none")
    with pytest.raises(ValueError):
        gridlore.analyze(events, "e", target="nothing")
    with pytest.raises(ValueError):
        gridlore.analyze(events, "e", mode="fast")
    with pytest.raises(ValueError):
        gridlore.analyze(spark.sql("SELECT CAST(NULL AS STRING) AS a"), "nulls")
    with pytest.raises(ValueError):
        gridlore.analyze(events, "e", modeling=False).section("nothing")


def test_preview_is_a_sample(events):
    report = gridlore.preview(events, "events", rows=100)
    assert report.overview().first().row_count == 100
    assert report.charts().count() == 0 and report.model.mode == "preview_deferred"


def test_store_reuses_the_same_data(spark, events):
    store = gridlore.ReportStore(spark, scratch_path(spark, "store"))
    assert store.history("ann").count() == 0
    first, reused = store.reuse_or_run(events, "events", "ann", modeling=False)
    assert not reused
    second, reused = store.reuse_or_run(events.repartition(5), "again", "bob", modeling=False)
    assert reused and second != first
    _, reused = store.reuse_or_run(events.where("event_id > 0"), "other", "ann", modeling=False)
    assert not reused
    assert store.status(second).first().entry_status == "completed"
    assert [r.dataset_name for r in store.history("ann").collect()] == ["other", "events"]
    assert store.load(second, "summary_statistics").count() == 6
    assert store.load(second, "preview_rows").count() == 12
    with pytest.raises(ValueError):
        store.load("gone", "overview")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_use(spark, folder):
    lines = read_parquet(spark, f"{folder}/lineitem.parquet")
    text = plan(outliers.outlier_rows(lines.select("l_tax", ROW), "l_tax"))
    assert "l_comment" not in text and "l_quantity" not in text
    text = plan(correlation.correlation_pairs(lines, ["l_tax", "l_quantity"]))
    assert "ReadSchema: struct<l_quantity:double,l_tax:double" in text and "l_orderkey" not in text


def test_rows_are_never_gathered_in_one_task(spark, folder):
    """Windows without a partition key may only run over block, file or partition tables."""
    lines = read_parquet(spark, f"{folder}/lineitem.parquet")
    for df in (
        cleaning.drop_duplicates(lines),
        profile.value_groups(lines, ["l_shipdate"]),
        charts.category_counts(lines, "l_returnflag"),
        sampling.page(lines, 3),
    ):
        assert "Window" not in plan(df)


def test_parquet_rows_need_no_shuffle(spark, folder):
    assert "Exchange" not in plan(read_parquet(spark, f"{folder}/lineitem.parquet"))


def test_a_save_that_breaks_off_shows_nothing(spark, tmp_path, monkeypatch):
    df = small_frame(spark, [(float(i % 4), i) for i in range(12)], f"n double, {ROW} long")
    kept = store.ReportStore(spark, str(tmp_path))
    with monkeypatch.context() as broken:
        broken.setattr(store.ReportStore, "_publish", lambda self, entry: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            kept.reuse_or_run(df, "t", "ann", charts=False, modeling=False)
    assert kept.table("entries").count() == kept.history("ann").count() == 0 and kept.table("sections").count() > 0
    (tmp_path / "entries").mkdir()
    report_id, reused = kept.reuse_or_run(df, "t", "ann", charts=False, modeling=False)
    assert not reused and kept.status(report_id).count() == kept.history("ann").count() == 1
    # what a crash while publishing leaves is no entry, and is replaced
    (entry,) = (p for p in (tmp_path / "entries").iterdir() if p.suffix == ".json")
    entry.write_text("")
    (tmp_path / "entries" / f".{entry.name}.crc").unlink(missing_ok=True)
    assert kept.table("entries").count() == 0
    assert not kept.reuse_or_run(df, "t", "ann", charts=False, modeling=False)[1] and kept.table("entries").count() == 1


def test_two_writers_share_one_entry(spark, tmp_path):
    df = small_frame(spark, [(float(i % 4), i) for i in range(12)], f"n double, {ROW} long")
    report = analyze(df, "t", charts=False, modeling=False)
    one, two = (store.ReportStore(spark, str(tmp_path)) for _ in range(2))
    ids = [s.save(report, user, "same-data") for s, user in ((one, "ann"), (two, "bob"))]
    assert one.table("entries").count() == 1 and len({one.status(i).first().entry_id for i in ids}) == 1
    assert all(one.load(i, "overview").count() for i in ids) and one.find("same-data", None).count() == 1
