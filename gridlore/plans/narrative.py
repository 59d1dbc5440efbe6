"""Plain-English insights and recommendations from report metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlore.session import small_frame

LIMIT = 6

# Sentence forms.
INSIGHTS = {
    "shape": "The dataset was cleaned from {original_rows} rows to {cleaned_rows} rows and now contains "
    "{cleaned_columns} usable columns.",
    "duplicates": "{duplicate_rows_removed} duplicate rows were removed before analysis.",
    "missing": "The pipeline handled {handled} missing values automatically.",
    "correlation": "{left_column} and {right_column} move together with a correlation of {correlation}.",
    "outliers": "{column} contains {count} potential outliers ({percentage}% of records).",
    "regression": "{model} achieved an R2 score of {r2} on the held-out test split.",
    "classification": "{model} reached {accuracy} accuracy on the held-out test split.",
    "clustering": "KMeans found {clusters} segments with a silhouette score of {silhouette_score}.",
}
RECOMMENDATIONS = {
    "missing": "Review the columns with imputed values and strengthen data collection rules upstream.",
    "correlation": "Use the strongest correlated features when prioritizing KPI drivers or dashboard alerts.",
    "outliers": "Inspect the largest outlier columns to confirm whether extreme values are real events or data "
    "quality issues.",
    "regression": "If you need stronger forecasts, add more business context columns and compare the recommended "
    "regressors.",
    "classification": "Validate class imbalance and consider threshold tuning before operationalizing predictions.",
    "clustering": "Review cluster segments with domain experts and label them for sales, customer, or operational "
    "actions.",
    "no_model": "Provide a target column when you want supervised model evaluation for forecasting or classification.",
    "ready": "The dataset is analysis-ready. Review the charts and model recommendations for next steps.",
}


def narrative(cleaning, pair=None, outlier=None, trend=None, model=None) -> list[tuple[str, int, str]]:
    """(section, place, text) rows: up to six insights and six recommendations.

    Arguments are the cleaning summary, the strongest pair, the column with most outliers and
    the first trend as dicts, and the model result; each but the first may be absent.
    """
    counts = vars(cleaning)
    topics: list[tuple[str, dict]] = [("shape", counts)]
    if cleaning.duplicate_rows_removed:
        topics.append(("duplicates", counts))
    if cleaning.missing_values_before:
        handled = cleaning.missing_values_before - cleaning.missing_values_after
        topics.append(("missing", {"handled": handled}))
    topics += [("correlation", pair)] if pair else []
    topics += [("outliers", outlier)] if outlier else []
    topics += [("trend", trend)] if trend else []
    if model is not None and model.status == "completed":
        shown = dict(model.metrics)
        if "clusters" in shown:
            shown["clusters"] = int(shown["clusters"])
        topics.append((model.mode, {"model": model.model, **shown}))
    else:
        topics.append(("no_model", {}))
    insights = [facts["description"] if t == "trend" else INSIGHTS[t].format(**facts) for t, facts in topics if t in (*INSIGHTS, "trend")]
    advice = [RECOMMENDATIONS[t] for t, _ in topics if t in RECOMMENDATIONS] or [RECOMMENDATIONS["ready"]]
    return [
        (section, place, text)
        for section, texts in (("insights", insights), ("recommendations", advice))
        for place, text in enumerate(texts[:LIMIT], start=1)
    ]


def narrative_table(spark: SparkSession, rows: list[tuple[str, int, str]]) -> DataFrame:
    return small_frame(spark, rows, "section string, place int, text string")
