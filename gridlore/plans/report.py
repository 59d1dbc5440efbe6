"""A whole analysis of one table, each section computed when first asked for."""

from __future__ import annotations

import json
from functools import cached_property, reduce

from pyspark.sql import DataFrame, functions as F

from gridlore.functions import exprs as X
from gridlore.functions.names import normalize_name
from gridlore.operators import charts as charting
from gridlore.operators import cleaning, correlation, modeling, outliers, profile, trends
from gridlore.operators.ordering import ROW, with_row
from gridlore.operators.sampling import SAMPLE_SIZES, sample_n
from gridlore.plans.narrative import narrative, narrative_table
from gridlore.session import small_frame

SECTIONS = (
    "overview", "columns", "preview_rows", "cleaning", "summary_statistics", "correlations", "strongest_pairs",
    "outliers", "trends", "charts", "modeling", "narrative", "kpis", "snapshot",
)
# Section sizes and card texts.
SNAPSHOT_COLUMNS = 8
PREVIEW_ROWS = 12
ROWS_CARD, MISSING_CARD, PAIR_CARD = "Rows", "Missing values", "Strongest pair"
ROWS_NOTE = "{:,} columns profiled"
MISSING_NOTE = "Across the current analytics profile"
NO_PAIR_VALUE, NO_PAIR_NOTE = "N/A", "Need two numeric columns"


class Report:
    """Sections as DataFrames of bounded size over ``frame``, the analysed table.

    What several sections need (moments, quartiles, pairs) is computed once and shared.
    """

    def __init__(self, frame, summary, name, target, mode, with_charts=True, with_model=True):
        self.frame: DataFrame = frame
        self.summary: cleaning.CleaningSummary = summary
        self.name, self.target, self.mode = name, target, mode
        self.with_charts, self.with_model = with_charts, with_model
        self.spark = frame.sparkSession
        self.numbers = profile.columns_of(frame, X.NUMERIC)

    @cached_property
    def facts(self) -> list[tuple]:
        return profile.numeric_facts(self.frame, self.numbers) if self.numbers else []

    @cached_property
    def _stats(self) -> dict[str, profile.NumericStats]:
        return {f[0]: profile.NumericStats(f[1], f[2], f[4], f[5], f[6]) for f in self.facts}

    @cached_property
    def _pairs(self) -> DataFrame:
        raw = self.mode == "raw"
        found = correlation.correlation_pairs(
            self.frame, self.numbers, null_as_zero=raw, stats=self._stats, rows=self.summary.cleaned_rows
        )
        return small_frame(self.spark, [tuple(r) for r in found.collect()], correlation.PAIR_SCHEMA)

    def overview(self) -> DataFrame:
        s = self.summary
        row = (self.name, self.target, s.cleaned_rows, s.cleaned_columns, s.original_rows, s.original_columns)
        schema = (
            "dataset_name string, target_column string, row_count long, column_count long, "
            "original_row_count long, original_column_count long"
        )
        return small_frame(self.spark, [row], schema)

    @cached_property
    def _distinct(self) -> DataFrame:
        return self._kept(profile.distinct_counts(self.frame, self.mode))

    @cached_property
    def _missing(self) -> DataFrame:
        return self._kept(profile.missing_counts(self.frame, self.mode))

    def _kept(self, found: DataFrame) -> DataFrame:
        """A table of one row per column, worked out now."""
        return small_frame(self.spark, [tuple(r) for r in found.collect()], found.schema)

    def columns(self) -> DataFrame:
        return profile.profile(self.frame, self.mode, distinct=self._distinct, missing=self._missing)

    def preview_rows(self) -> DataFrame:
        return X.sanitize(profile.preview(self.frame, PREVIEW_ROWS)).drop(ROW)

    def cleaning(self) -> DataFrame:
        return self.summary.table(self.spark)

    @cached_property
    def _statistics(self) -> DataFrame:
        rounded = small_frame(self.spark, self.facts, profile.NUMERIC_SUMMARY_SCHEMA)
        names = [f.split()[0] for f in profile.NUMERIC_SUMMARY_SCHEMA.split(", ")]
        rounded = rounded.selectExpr(*names[:2], *[f"round({n}, 4) AS {n}" for n in names[2:]])
        found = profile.summary_statistics(self.frame, self.mode, rounded, self._distinct, self._missing)
        return self._kept(found)

    def summary_statistics(self) -> DataFrame:
        return self._statistics

    def correlations(self) -> DataFrame:
        return correlation.heatmap(self._pairs, self.numbers if len(self.numbers) > 1 else [])

    def strongest_pairs(self, k: int = 6) -> DataFrame:
        return correlation.strongest_pairs(self._pairs, k)

    @cached_property
    def _outliers(self) -> DataFrame:
        found = outliers.outliers(self.frame, self.numbers, self.facts)
        return small_frame(self.spark, [tuple(r) for r in found.collect()], found.schema)

    def outliers(self) -> DataFrame:
        return self._outliers

    @cached_property
    def _trends(self) -> DataFrame:
        found = trends.trends(self.frame)
        return small_frame(self.spark, [tuple(r) for r in found.collect()], found.schema)

    def trends(self) -> DataFrame:
        return self._trends

    def charts(self) -> DataFrame:
        if not self.with_charts:
            return charting.charts(self.frame.select(ROW))
        return charting.charts(self.frame, self.mode, self.facts, self._pairs)

    @cached_property
    def model(self) -> modeling.ModelResult:
        if not self.with_model:
            return modeling.skipped("preview_deferred", "Previews leave out modelling.", self.target)
        return modeling.model(self.frame, self.target)

    def modeling(self) -> DataFrame:
        return self.model.table(self.spark)

    @cached_property
    def _narrative(self) -> list[tuple[str, int, str]]:
        def first(df):
            row = df.first()
            return row.asDict() if row else None

        return narrative(
            self.summary,
            first(self.strongest_pairs(1).withColumn("correlation", F.coalesce("correlation", F.lit(0.0)))),
            first(outliers.top_outlier(self._outliers)),
            first(self._trends.orderBy("position")),
            self.model,
        )

    def narrative(self) -> DataFrame:
        return narrative_table(self.spark, self._narrative)

    def kpis(self) -> DataFrame:
        """Rows, missing values and the strongest pair, one row each."""
        s, best = self.summary, self.strongest_pairs(1).first()
        value, note = NO_PAIR_VALUE, NO_PAIR_NOTE
        if best:
            value, note = f"{best.correlation or 0.0:.2f}", f"{best.left_column} x {best.right_column}"
        rows = [
            (ROWS_CARD, f"{s.cleaned_rows:,}", ROWS_NOTE.format(s.cleaned_columns)),
            (MISSING_CARD, f"{s.missing_values_before:,}", MISSING_NOTE),
            (PAIR_CARD, value, note),
        ]
        return small_frame(self.spark, rows, "label string, value string, note string")

    def snapshot(self) -> DataFrame:
        return snapshot(self._statistics)

    def section(self, name: str) -> DataFrame:
        if name not in SECTIONS:
            raise ValueError("There is no such section.")
        return getattr(self, name)()

    def records(self, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
        """Sections as one table (section, place, record), each record as JSON text."""
        parts = []
        for name in sections:
            record = X.sanitize(self.section(name)).select(F.to_json(F.struct("*")).alias("record"))
            # bounded tables, whose ids ascend with their rows
            numbered = record.withColumn("place", F.monotonically_increasing_id())
            parts.append(numbered.select(F.lit(name).alias("section"), "place", "record"))
        return reduce(DataFrame.unionByName, parts)

    def payload(self, sections: tuple[str, ...] = SECTIONS) -> dict[str, list[dict]]:
        """Sections as lists of plain records."""
        return {s: [_plain(r.asDict(recursive=True)) for r in X.sanitize(self.section(s)).collect()] for s in sections}

    def to_json(self, sections: tuple[str, ...] = SECTIONS) -> str:
        return json.dumps({"dataset_name": self.name, "mode": self.mode, **self.payload(sections)})


def _plain(record: dict) -> dict:
    return {k: v.isoformat() if hasattr(v, "isoformat") else v for k, v in record.items()}


def snapshot(statistics: DataFrame, n: int = SNAPSHOT_COLUMNS) -> DataFrame:
    """The first ``n`` columns with a one-line highlight each."""

    def part(label: str, value: str) -> str:
        return f"CASE WHEN {value} IS NOT NULL THEN concat('{label}: ', {value}) END"

    low, high = (f"coalesce({X.plain_number(f)}, {f}_time)" for f in ("min", "max"))
    highlights = [part("mean", X.plain_number("mean")), part("top_value", "top_value"), part("min", low), part("max", high)]
    return statistics.orderBy("position").limit(n).selectExpr(
        "position",
        "column",
        "dtype AS type",
        "unique_values",
        f"coalesce(nullif(concat_ws(', ', {', '.join(highlights)}), ''), 'n/a') AS highlights",
    )


def analyze(
    df: DataFrame,
    name: str,
    target: str | None = None,
    mode: str = "clean",
    charts: bool = True,
    modeling: bool = True,
    order_by: list | None = None,
) -> Report:
    """Analyse a table: ``clean`` cleans it first, ``raw`` profiles it as it is.

    ``order_by`` gives the row order of a table that has no source order.
    """
    if mode not in profile.MODES:
        raise ValueError(f"mode is one of {profile.MODES}")
    source = with_row(df, order_by)
    if source.isEmpty():
        raise ValueError("The table has no rows.")
    if mode == "clean":
        frame, summary = cleaning.clean(source)
        if not summary.cleaned_rows or not summary.cleaned_columns:
            raise ValueError("Cleaning leaves no values.")
    else:
        counts = profile.missing_counts(source, "raw").collect()
        missing = {r["column"]: r.missing_count for r in counts}
        summary = cleaning.raw_summary(source, missing, counts[0].row_count)
        frame = cleaning.normalize_columns(source).drop(*summary.removed_columns)
    wanted = normalize_name(target) if target else None
    if wanted and wanted not in frame.columns:
        raise ValueError(f"There is no column '{target}' to model.")
    return Report(frame, summary, name, wanted, mode, charts, modeling)


def preview(df: DataFrame, name: str, size: str = "large", rows: int | None = None) -> Report:
    """A quick report on a fixed-size sample, without charts and modelling."""
    rows = SAMPLE_SIZES["preview"][size] if rows is None else rows
    return analyze(sample_n(with_row(df), rows), name, charts=False, modeling=False)
