"""Baseline models over all rows: regression, classification or clustering."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import FeatureHasher
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridlore.functions import exprs as X
from gridlore.operators import forest_fit, kmeans
from gridlore.operators.cleaning import fill_values
from gridlore.operators.ordering import ROW, data_columns, sorted_positions
from gridlore.operators.profile import columns_of, numeric_stats
from gridlore.operators.sampling import HASH_BITS, SEED, cap_rows, sample_hash
from gridlore.session import materialize, run_sql, small_frame

# Model sizes and guards.
TREES, DEPTH = 48, 12
TEST_SHARE = 0.2
MIN_ROWS, MIN_CLUSTER_ROWS = 8, 5
MAX_CLUSTERS = 6
MAX_CLASSES, MAX_CLASS_SHARE = 40, 0.08
FLOAT_LIKE_DISTINCT, FLOAT_LIKE_SHARE = 20, 0.005
TOP_FEATURES = 8
STARTS = 10

HASHED_FEATURES = 256
KEY_BITS, STEP_BITS = 52, 13
REGRESSION, CLASSIFICATION, CLUSTERING = "regression", "classification", "clustering"


@dataclass
class ModelResult:
    """Outcome of a model run; tables are DataFrames of bounded size, but for ``predictions``."""

    status: str
    mode: str
    target: str | None = None
    reason: str | None = None
    model: str | None = None
    metrics: dict[str, float] = field(default_factory=dict)
    importance: DataFrame | None = None
    classes: DataFrame | None = None
    clusters: DataFrame | None = None
    predictions: DataFrame | None = None
    centres: DataFrame | None = None
    features: DataFrame | None = None
    fitted: object | None = None
    inputs: FeaturePipeline | None = None
    notes: str | None = None

    def table(self, spark) -> DataFrame:
        """Metrics as rows."""
        rows = [(self.status, self.mode, self.target, m, v) for m, v in self.metrics.items()]
        rows = rows or [(self.status, self.mode, self.target, None, None)]
        return small_frame(spark, rows, "status string, mode string, target string, metric string, value double")


def skipped(mode: str, reason: str, target: str | None = None) -> ModelResult:
    return ModelResult("skipped", mode, target, reason)


def target_facts(df: DataFrame, target: str) -> tuple[int, int]:
    """Present values and distinct values of the target."""
    c, dtype = X.quote(target), X.types_of(df)[target]
    value = X.double(c, dtype) if X.kind_of(dtype) == X.NUMERIC else X.as_text(c, dtype)
    groups = df.selectExpr(f"{value} AS v").where("v IS NOT NULL").groupBy("v").count()
    row = groups.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("d")).first()
    return row.n, row.d


def target_mode(df: DataFrame, target: str, facts: tuple[int, int] | None = None) -> str:
    """Regression for fractional numbers and for whole numbers of many values, else classification."""
    dtype = X.types_of(df)[target]
    if X.kind_of(dtype) != X.NUMERIC:
        return CLASSIFICATION
    if not isinstance(dtype, T.IntegralType):
        return REGRESSION
    n, distinct = facts or target_facts(df, target)
    many = distinct >= FLOAT_LIKE_DISTINCT and distinct / max(n, 1) >= FLOAT_LIKE_SHARE
    return REGRESSION if many else CLASSIFICATION


def target_table(df: DataFrame, target: str) -> DataFrame:
    """One row: target, present and distinct values, mode."""
    facts = target_facts(df, target)
    rows = [(target, *facts, target_mode(df, target, facts))]
    return small_frame(df.sparkSession, rows, "target string, present long, distinct long, mode string")


def times_as_seconds(df: DataFrame) -> DataFrame:
    """Datetimes as whole seconds since 1970."""
    times = {c: F.expr(f"unix_timestamp(CAST({X.quote(c)} AS TIMESTAMP))") for c in columns_of(df, X.DATETIME)}
    return df.withColumns(times) if times else df


def split(df: DataFrame, share: float = TEST_SHARE, stratify: str | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(train, test) with exactly ``ceil(share * n)`` test rows, by class when ``stratify`` is given.

    A row is in the test part if its hash is at most a cut-off. The cut-off that leaves the exact
    count is found from counts alone, thirteen bits of the hash per scan, so no class is ever
    sorted or gathered. Rows are written once with their hash, which these scans and both parts
    read. Give ``stratify`` only for a target of bounded class count.
    """
    group = F.col(X.quote(stratify)).cast("string") if stratify else F.lit("all")
    keyed = df.withColumn("_key", F.shiftright(sample_hash(df, seed), HASH_BITS - KEY_BITS)).withColumn("_class", group)
    keyed = materialize(keyed, "keyed")
    sizes = {r["_class"]: r["count"] for r in keyed.groupBy("_class").count().collect()}
    wanted = _shares(sizes, share)
    cuts = _cut_offs(keyed, wanted)
    cut = F.element_at(F.create_map(*[F.lit(v) for item in cuts.items() for v in item]), F.col("_class"))
    in_test = F.col("_key") <= cut
    return keyed.where(~in_test).drop("_key", "_class"), keyed.where(in_test).drop("_key", "_class")


def _shares(sizes: dict[str, int], share: float) -> dict[str, int]:
    """Test rows per class: whole parts first, the rest to the largest fractions."""
    total = math.ceil(share * sum(sizes.values()))
    counts = {c: int(n * share) for c, n in sizes.items()}
    by_fraction = sorted(sizes, key=lambda c: (counts[c] - sizes[c] * share, c))
    for c in by_fraction[: total - sum(counts.values())]:
        counts[c] += 1
    return counts


def _cut_offs(keyed: DataFrame, wanted: dict[str, int]) -> dict[str, int]:
    """Per class, the key at or below which exactly the wanted number of rows lies."""
    cuts = {c: -1 for c, k in wanted.items() if k == 0}
    open_cells = {c: (0, 0) for c, k in wanted.items() if k}  # class -> (key prefix, rows below it)
    for shift in range(KEY_BITS - STEP_BITS, -1, -STEP_BITS):
        if not open_cells:
            break
        rows = [(c, prefix, below, wanted[c]) for c, (prefix, below) in open_cells.items()]
        cells = small_frame(keyed.sparkSession, rows, "_class string, prefix long, below long, k long")
        hits = run_sql(
            keyed.sparkSession,
            f"""
            SELECT _class, cell, before, n, k FROM (
                SELECT *, below + sum(n) OVER (PARTITION BY _class ORDER BY cell) - n AS before FROM (
                    SELECT /*+ BROADCAST(c) */ c._class, c.below, c.k, shiftright(r._key, {shift}) AS cell, count(*) AS n
                    FROM {{rows}} r JOIN {{cells}} c
                    ON r._class = c._class AND shiftright(r._key, {shift + STEP_BITS}) = c.prefix
                    GROUP BY ALL))
            WHERE k > before AND k <= before + n
            """,
            rows=keyed.select("_class", "_key"),
            cells=cells,
        ).collect()
        open_cells = {}
        for h in hits:
            if h.before + h.n == h.k or shift == 0:
                cuts[h["_class"]] = ((h.cell + 1) << shift) - 1
            else:
                open_cells[h["_class"]] = (h.cell, h.before)
    return cuts


@dataclass
class FeaturePipeline:
    """Numbers standardised around the training mean, categories one-hot, or hashed on request.

    A vector is: the numbers, one slot per level of each text column, the hashed columns.
    """

    numbers: list[str]
    texts: list[str]
    hashed: list[str]
    fills: dict[str, object]
    scale: dict[str, tuple[float, float]]
    levels: list[DataFrame] = field(default_factory=list)  # per text column (_c, _i): value and index
    sizes: list[int] = field(default_factory=list)
    stages: PipelineModel | None = None

    @property
    def size(self) -> int:
        return len(self.numbers) + sum(self.sizes) + HASHED_FEATURES * len(self.hashed)

    @property
    def columns(self) -> list[tuple[int, int]]:
        """The slots of each column of levels or hashed slots: the first and the one behind the last."""
        edges = np.cumsum([len(self.numbers), *self.sizes, *[HASHED_FEATURES] * len(self.hashed)]).tolist()
        return list(zip(edges, edges[1:]))

    def _text(self, c: str, dtype: T.DataType) -> Column:
        return F.coalesce(F.expr(X.as_text(X.quote(c), dtype)), F.lit(str(self.fills.get(c, "Unknown"))))

    def _columns(self, df: DataFrame) -> DataFrame:
        dtypes = X.types_of(df)
        columns = {}
        for i, c in enumerate(self.numbers):
            mean, std = self.scale[c]
            value = f"coalesce({X.double(X.quote(c), dtypes[c])}, {X.number(self.fills.get(c, mean))})"
            columns[f"_n{i}"] = F.expr(f"({value} - {X.number(mean)}) / {X.number(std)}")
        columns |= {f"_h{i}": self._text(c, dtypes[c]) for i, c in enumerate(self.hashed)}
        columns |= {f"_c{i}": self._text(c, dtypes[c]) for i, c in enumerate(self.texts)}
        frame = df.withColumns(columns)
        for i, (levels, size) in enumerate(zip(self.levels, self.sizes)):
            known = levels.select(F.col("_c").alias(f"_c{i}"), F.col("_i").alias(f"_l{i}"))
            index = F.coalesce(F.col(f"_l{i}"), F.lit(float(size)))  # beyond the levels: no slot
            frame = frame.join(known, f"_c{i}", "left").withColumn(f"_i{i}", index)
        return frame

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with its ``features`` vector.

        Spark's encoder and assembler would name every slot in the schema, which the driver holds.
        """
        frame = self.places(df)
        slots = [F.lit(i) for i in range(len(self.numbers))] + [F.lit(a) + F.col(f"_p{i}") for i, (a, _) in enumerate(self.columns)]
        known = [F.when(F.col(f"_p{i}") < b - a, 1.0).otherwise(0.0) for i, (a, b) in enumerate(self.columns)]
        values = [*[F.col(f"_n{i}") for i in range(len(self.numbers))], *known]
        return frame.select(*df.columns, _vectors(self.size)(F.array(*slots), F.array(*values)).alias("features"))

    def places(self, df: DataFrame) -> DataFrame:
        """``df`` with the numbers _n0.. and, per column of levels or hashed slots, the place of its slot, _p0.. ."""
        frame = self._columns(df)
        frame = self.stages.transform(frame) if self.stages else frame
        texts = [F.col(f"_i{i}").cast("int").alias(f"_p{i}") for i in range(len(self.texts))]
        hashed = [(F.array_position(vector_to_array(f"_s{i}"), 1.0) - 1).cast("int").alias(f"_p{len(texts) + i}") for i in range(len(self.hashed))]
        return frame.select(*df.columns, *[f"_n{i}" for i in range(len(self.numbers))], *texts, *hashed)

    def grow(self, rows: DataFrame, trees: int, depth: int, classes: int = 0, subset: int | None = None):
        """A forest of ``rows`` as ``places`` gives them, with _label and _weight."""
        sizes = [*self.sizes, *[HASHED_FEATURES] * len(self.hashed)]
        numbers = [f"_n{i}" for i in range(len(self.numbers))]
        return forest_fit.fit(rows, numbers, [(f"_p{i}", n) for i, n in enumerate(sizes)], trees, depth, SEED, classes, subset)

    def names(self, slots: Iterable[int]) -> dict[int, str]:
        """Readable names of some vector slots, looked up in the levels."""
        slots = sorted(slots)
        found = {s: self.numbers[s] for s in slots if s < len(self.numbers)}
        first = len(self.numbers)
        for c, levels, size in zip(self.texts, self.levels, self.sizes):
            wanted = [float(s - first) for s in slots if first <= s < first + size]
            if wanted:
                found |= {first + int(r["_i"]): f"{c}_{r['_c']}" for r in levels.where(F.col("_i").isin(wanted)).collect()}
            first += size
        for c in self.hashed:
            found |= {s: f"{c}_{s - first}" for s in slots if first <= s < first + HASHED_FEATURES}
            first += HASHED_FEATURES
        return found


def _vectors(size: int):
    """A function that makes vectors of ``size`` numbers from slots in order and their values, in the shorter of the two forms."""

    def made(at: pa.Array, values: pa.Array) -> pa.Array:
        rows, places, v = len(at), at.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False)
        if not np.isfinite(v).all() and np.isnan(v).any():
            raise ValueError("A feature is missing or not a number.")
        row = np.repeat(np.arange(rows), len(v) // max(rows, 1))[v != 0]
        places, v = places[v != 0], v[v != 0]
        filled = np.bincount(row, minlength=rows)
        dense = 1.5 * (filled + 1) >= size
        ends = np.concatenate([[0], np.cumsum(np.where(dense, size, filled))]).astype(np.int32)
        rank = np.arange(len(v)) - np.repeat(np.cumsum(filled) - filled, filled)
        whole = np.zeros(ends[-1])
        whole[ends[row] + np.where(dense[row], places, rank)] = v
        listed = np.concatenate([[0], np.cumsum(np.where(dense, 0, filled))]).astype(np.int32)
        indices = pa.ListArray.from_arrays(pa.array(listed), pa.array(places[~dense[row]], pa.int32()), mask=pa.array(dense))
        sizes, kinds = pa.array(np.full(rows, size, np.int32), mask=dense), pa.array(dense.astype(np.int8))
        return pa.StructArray.from_arrays([kinds, sizes, indices, pa.ListArray.from_arrays(pa.array(ends), pa.array(whole))], names=["type", "size", "indices", "values"])

    return F.arrow_udf(made, returnType=VectorUDT())


def feature_pipeline(df: DataFrame, hashed: Sequence[str] = ()) -> FeaturePipeline:
    """Fit the features of every data column: median and population scaling, mode and one-hot.

    Every level of a text column gets a slot, in the order of the values. The levels are a table
    that rows are joined with, so the driver only learns how many there are; vectors are sparse.
    Columns named in ``hashed`` share a fixed number of slots instead. Unknown levels later on
    are all zeros.
    """
    frame = times_as_seconds(df)
    numbers, texts = columns_of(frame, X.NUMERIC), columns_of(frame, X.CATEGORICAL)
    if not numbers and not texts:
        raise ValueError("No features are available for modelling.")
    rows = frame.count()
    stats = numeric_stats(frame, numbers)
    gaps = [c for c in numbers if stats[c].count < rows]
    fills = fill_values(frame, [*gaps, *texts])
    if gaps:  # the fill values shift mean and deviation
        dtypes = X.types_of(frame)
        filled = [
            f"coalesce({X.double(X.quote(c), dtypes[c])}, {X.number(fills.get(c, 0.0))}) AS {X.quote(c)}" for c in gaps
        ]
        stats |= numeric_stats(frame.selectExpr(*filled), gaps)
    scale = {c: (s.mean, s.std or 1.0) for c, s in stats.items()}
    wide = [c for c in texts if c in hashed]
    fitted = FeaturePipeline(numbers, [c for c in texts if c not in hashed], wide, fills, scale)
    plain = fitted._columns(frame)
    for i in range(len(fitted.texts)):
        values = plain.select(F.col(f"_c{i}").alias("_c")).distinct()
        indexed = sorted_positions(values, ["_c"], "_i").select("_c", F.col("_i").cast("double").alias("_i"))
        fitted.levels.append(materialize(indexed, "levels"))
    fitted.sizes = [levels.count() for levels in fitted.levels]
    if wide:
        stages = [FeatureHasher(inputCols=[f"_h{i}"], outputCol=f"_s{i}", numFeatures=HASHED_FEATURES) for i in range(len(wide))]
        fitted.stages = Pipeline(stages=stages).fit(fitted._columns(frame))
    return fitted


def feature_importance(model, features: FeaturePipeline, spark, top: int = TOP_FEATURES) -> DataFrame:
    """The ``top`` features by importance."""
    weights = model.featureImportances.toArray()
    best = [int(i) for i in np.argsort(-weights, kind="stable")[:top]]
    names = features.names(best)
    rows = [(place, names[i], round(float(weights[i]), 4)) for place, i in enumerate(best, start=1)]
    return small_frame(spark, rows, "place int, feature string, importance double")


def _prepare(df: DataFrame, target: str, label: str, stratify: str | None, hashed: Sequence[str]):
    """Places of the train rows and feature vectors of the test rows, written once, and the fitted features."""
    labelled = times_as_seconds(df).withColumn("_label", F.expr(label)).where("_label IS NOT NULL")
    train, test = split(labelled, stratify=stratify)
    features = feature_pipeline(train.drop("_label", target), hashed)
    train_table = materialize(features.places(train.drop(*[c for c in train.columns if c not in ("_label", *features.numbers, *features.texts, *features.hashed)])), "train")
    train_table = train_table.drop(*features.numbers, *features.texts, *features.hashed)
    test_table = materialize(features.transform(test).select("_label", "features"), "test")
    return train_table, test_table, features


def regression_metrics(predictions: DataFrame) -> dict[str, float]:
    """rmse, mae and r2 from (label, prediction), in one scan around the known mean label."""
    mean = predictions.agg(F.avg("label")).first()[0]
    row = predictions.selectExpr(
        "count(*) AS n",
        "sum((label - prediction) * (label - prediction)) AS e",
        "sum(abs(label - prediction)) AS a",
        f"sum((label - {X.number(mean)}) * (label - {X.number(mean)})) AS t",
    ).first()
    r2 = 1 - row.e / row.t if row.t else (1.0 if row.e == 0 else 0.0)
    return {"rmse": round(math.sqrt(row.e / row.n), 4), "mae": round(row.a / row.n, 4), "r2": round(r2, 4)}


def regress(df: DataFrame, target: str, trees: int = TREES, depth: int = DEPTH, hashed: Sequence[str] = ()) -> ModelResult:
    """Random-forest regression with a held-out fifth.

    A forest adds up sums per level, so the passes it takes grow with the levels of the text columns;
    name very wide ones in ``hashed``.
    """
    dtype = X.types_of(df)[target]
    train, test, features = _prepare(df, target, X.double(X.quote(target), dtype), None, hashed)
    model = features.grow(train.withColumn("_weight", F.lit(1.0)), trees, depth)
    predictions = model.transform(test).select(F.col("_label").alias("label"), "prediction")
    return ModelResult(
        "completed", REGRESSION, target, model="Random Forest Regressor",
        metrics=regression_metrics(predictions),
        importance=feature_importance(model, features, df.sparkSession),
        predictions=predictions, fitted=model, inputs=features,
    )


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """(class, count) of the target as text."""
    return df.groupBy(F.expr(X.as_text(X.quote(target), X.types_of(df)[target])).alias("class")).count()


def classification_metrics(predictions: DataFrame) -> dict[str, float]:
    """Accuracy and class-weighted precision, recall and F1 from (label, prediction).

    Worked out from the confusion counts, at most one row per pair of classes.
    """
    cells = [(r.label, r.prediction, r["count"]) for r in predictions.groupBy("label", "prediction").count().collect()]
    total = sum(n for *_, n in cells)
    precision = recall = f1 = 0.0
    for c in {label for label, *_ in cells}:
        hit = sum(n for label, p, n in cells if label == p == c)
        actual = sum(n for label, _, n in cells if label == c)
        said = sum(n for _, p, n in cells if p == c)
        p, r = (hit / said if said else 0.0), hit / actual
        precision += p * actual / total
        recall += r * actual / total
        f1 += (2 * p * r / (p + r) if p + r else 0.0) * actual / total
    accuracy = sum(n for label, p, n in cells if label == p) / total
    values = {"accuracy": accuracy, "precision": precision, "recall": recall, "f1_score": f1}
    return {k: round(v, 4) for k, v in values.items()}


def classify(
    df: DataFrame,
    target: str,
    max_rows: int | None = None,
    trees: int = TREES,
    depth: int = DEPTH,
    hashed: Sequence[str] = (),
) -> ModelResult:
    """Random-forest classification with balanced class weights and a held-out fifth."""
    rows, distinct = target_facts(df, target)
    if distinct < 2:
        return skipped(CLASSIFICATION, "Classification needs two or more distinct classes.", target)
    if distinct > MAX_CLASSES or distinct / rows > MAX_CLASS_SHARE:
        return skipped(CLASSIFICATION, "The target has too many distinct classes for a baseline classifier.", target)
    text = X.as_text(X.quote(target), X.types_of(df)[target])
    df = df.where(f"{text} IS NOT NULL")
    counts = {r["class"]: r["count"] for r in class_counts(df, target).collect()}  # at most MAX_CLASSES rows
    df = cap_rows(df, max_rows) if max_rows else df
    classes = sorted(counts)
    label = "CASE " + " ".join(f"WHEN {text} = {X.text(c)} THEN {i}D" for i, c in enumerate(classes)) + " END"
    stratified = min(counts.values()) >= 2 and len(counts) <= max(1, round(rows * TEST_SHARE))
    train, test, features = _prepare(df, target, label, "_label" if stratified else None, hashed)
    in_train = {r["_label"]: r["count"] for r in train.groupBy("_label").count().collect()}
    total = sum(in_train.values())
    weight = "CASE " + " ".join(
        f"WHEN _label = {c} THEN {X.number(total / (len(in_train) * n))}" for c, n in in_train.items()
    ) + " END"
    subset = math.ceil(math.sqrt(features.size))
    model = features.grow(train.withColumn("_weight", F.expr(weight)), trees, depth, len(classes), subset)
    names_of = F.array(*[F.lit(c) for c in classes])
    predictions = model.transform(test).select(
        names_of[F.col("_label").cast("int")].alias("label"), names_of[F.col("prediction").cast("int")].alias("prediction")
    )
    return ModelResult(
        "completed", CLASSIFICATION, target, model="Random Forest Classifier",
        metrics=classification_metrics(predictions),
        importance=feature_importance(model, features, df.sparkSession),
        classes=small_frame(df.sparkSession, sorted(counts.items()), "class string, count long"),
        predictions=predictions, fitted=model, inputs=features,
    )


def silhouette(table: DataFrame) -> float:
    """Mean silhouette of (features, prediction) under squared Euclidean distance.

    Distances to a cluster follow from its count, sum and sum of squares, so no pairs are formed.
    """
    return ClusteringEvaluator(predictionCol="prediction", featuresCol="features").evaluate(table)


def cluster(df: DataFrame, starts: int = STARTS, hashed: Sequence[str] = ()) -> ModelResult:
    """KMeans with the cluster count, 2 to 6, of the best silhouette; each count's best of several starts.

    All counts and starts are fitted together, see ``kmeans``; ``centres`` and ``features`` of the result are what
    rows were assigned by. Slots of wide columns at which a centre is zero are left out of ``centres``.
    """
    rows = df.count()
    if rows < MIN_CLUSTER_ROWS:
        return skipped(CLUSTERING, "Clustering needs at least five records.")
    frame = times_as_seconds(df)
    features = feature_pipeline(frame, hashed)
    key = F.col(ROW).cast("long") if ROW in frame.columns else F.monotonically_increasing_id()
    # a few files of many rows would leave most cores without work in every scan
    table = materialize(features.transform(frame).select("features", key.alias("key")).repartition("key"), "features")
    fits = kmeans.fit_all(table, features.size, list(range(2, min(MAX_CLUSTERS, rows - 1) + 1)), starts, SEED, features.columns)
    scores = fits.silhouettes([k for k in sorted(fits) if (fits.sizes(k) > 0).sum() > 1])
    if not scores:
        return skipped(CLUSTERING, "The records do not separate into clusters.")
    k = max(scores, key=scores.get)
    score, assigned = scores[k], fits.assigned(k)
    return ModelResult(
        "completed", CLUSTERING, model="KMeans",
        metrics={"silhouette_score": round(score, 4), "clusters": float(k)},
        clusters=assigned.groupBy(F.col("prediction").alias("cluster")).count(),
        predictions=assigned.select(*([F.col("key").alias(ROW)] if ROW in frame.columns else []), "prediction"),
        centres=fits.centres(k),
        features=assigned,
        notes="silhouette metric: squaredEuclidean",
    )


def model(df: DataFrame, target: str | None = None, hashed: Sequence[str] = ()) -> ModelResult:
    """Pick and run the model that suits the table and target, or say why there is none."""
    if len(df.head(MIN_ROWS)) < MIN_ROWS:
        return skipped("insufficient_data", "At least 8 records are needed for a baseline model.", target)
    columns = data_columns(df)
    if target is None:
        return cluster(df, hashed=hashed)
    if target not in columns:
        return skipped("target_missing", f"Target column '{target}' is not in the table.", target)
    if len(columns) < 2:
        return skipped("missing_features", "The table has no column besides the target.", target)
    if target_mode(df, target) == REGRESSION:
        return regress(df, target, hashed=hashed)
    return classify(df, target, hashed=hashed)
