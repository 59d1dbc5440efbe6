"""Fitted forests as node tables: kept, read and scored as plain DataFrames.

A node table has one row per node (tree, node): what it predicts, the weight and statistics of the rows
that reached it, and for inner nodes the gain, the slot it asks for and where both answers lead. It has
at most trees * 2^(depth + 1) rows, whatever the data. Tasks walk all trees with slices of rows, a level at
a time; a table too large to be sent to every task is joined with the rows once a level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridlore.session import materialize, scratch_path, small_frame

BROADCAST_NODES = 1 << 20
"""Nodes, counted first, that are sent to every task (some 100 MB); more are joined by shuffle."""
STEPS_AT_ONCE = 1 << 17
"""Pairs of a row and a tree that take a step together inside a task."""


NODE = "tree int, node int, level int, slot int, cut double, left_values array<double>, left int, right int, gain double, weight double, prediction double, stats array<double>"


def nodes_of(rows: list[tuple]) -> pa.Table:
    """Rows of a node table as Arrow."""
    schema = to_arrow_schema(T._parse_datatype_string(NODE))
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


@dataclass
class Forest:
    """A forest grown by ``forest_fit``: its node table, at most trees * 2^(depth + 1) rows; one of classes has ``numClasses``."""

    nodes: pa.Table
    slots: int
    classes: int = field(default=0, repr=False)

    def __post_init__(self):
        if self.classes:
            self.numClasses = self.classes

    @property
    def featureImportances(self) -> DenseVector:
        tree, slot = self.nodes["tree"].to_numpy(), self.nodes["slot"].fill_null(-1).to_numpy()
        gain = self.nodes["gain"].fill_null(0.0).to_numpy() * self.nodes["weight"].to_numpy()
        total = np.zeros(self.slots)
        for t in np.unique(tree):
            mine = (tree == t) & (slot >= 0)
            if gain[mine].sum() > 0:
                total += np.bincount(slot[mine], weights=gain[mine], minlength=self.slots) / gain[mine].sum()
        return Vectors.dense(total / total.sum() if total.sum() else total)

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` (features) with a ``prediction``: the trees' mean, or the class of most votes."""
        slots = sorted(set(self.nodes["slot"].drop_null().to_pylist()))
        walk = _Walk(self.nodes, slots, max(self.nodes["level"].to_pylist()), self.classes)

        def said(values: np.ndarray) -> np.ndarray:
            sums = walk.sums(values)
            return sums.argmax(axis=1).astype(float) if sums.shape[1] > 1 else sums[:, 0] / len(walk.roots)

        if not slots:
            return rows.withColumn("prediction", F.lit(float(said(np.zeros((1, 0)))[0])))

        @F.pandas_udf("double")
        def predicted(values: pd.Series) -> pd.Series:
            step = max(1, STEPS_AT_ONCE // len(walk.roots))
            return pd.Series(np.concatenate([np.zeros(0), *[said(np.stack(values.iloc[i : i + step].to_list())) for i in range(0, len(values), step)]]))

        asked = VectorSlicer(inputCol="features", outputCol="_asked", indices=slots).transform(rows)
        return asked.withColumn("prediction", predicted(vector_to_array("_asked"))).drop("_asked")


def _levels(tree: pd.DataFrame) -> pd.DataFrame:
    """Steps from the root for the nodes of one tree; parents come before their children."""
    tree = tree.sort_values("id")
    level = np.zeros(len(tree), np.int32)
    for node, left, right in tree[["id", "leftChild", "rightChild"]].itertuples(index=False):
        if left >= 0:
            level[left] = level[right] = level[node] + 1
    return pd.DataFrame({"tree": tree["treeID"], "node": tree["id"], "level": level})


def node_table(model) -> DataFrame:
    """(tree, node, level, slot, cut, left_values, left, right, gain, weight, prediction, stats) of a fitted forest.

    Node 0 of a tree is its root. A leaf has null slot, cut, left_values, left, right and gain. Rows go left
    with a value of at most ``cut``, or, where that is null, one of ``left_values``. ``stats`` are weighted
    class counts, or count, sum and sum of squares of a regression's labels.
    """
    spark = SparkSession.getActiveSession()
    if isinstance(model, Forest):
        return materialize(spark.createDataFrame(model.nodes, T._parse_datatype_string(NODE)), "nodes")
    path = scratch_path(spark, "forest")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").selectExpr("treeID", "nodeData.*")
    # a tree has at most 2^(depth + 1) nodes
    levels = nodes.select("treeID", "id", "leftChild", "rightChild").groupBy("treeID")
    levels = levels.applyInPandas(_levels, "tree int, node int, level int")
    inner = "leftChild >= 0"
    weight = "aggregate(impurityStats, 0D, (a, v) -> a + v)" if hasattr(model, "numClasses") else "impurityStats[0]"
    nodes = nodes.selectExpr(
        "treeID AS tree",
        "id AS node",
        f"CASE WHEN {inner} THEN split.featureIndex END AS slot",
        f"CASE WHEN {inner} AND split.numCategories < 0 THEN split.leftCategoriesOrThreshold[0] END AS cut",
        f"CASE WHEN {inner} AND split.numCategories >= 0 THEN split.leftCategoriesOrThreshold END AS left_values",
        f"CASE WHEN {inner} THEN leftChild END AS left",
        f"CASE WHEN {inner} THEN rightChild END AS right",
        f"CASE WHEN {inner} THEN gain END AS gain",
        f"{weight} AS weight",
        "prediction",
        "impurityStats AS stats",
    )
    return materialize(nodes.join(levels, ["tree", "node"]), "nodes")


def importance(nodes: DataFrame) -> DataFrame:
    """(slot, importance): the gain of a slot's splits, weighted by the rows they saw, as a share of its tree's, then of all.

    Slots without a split are left out; a forest of single leaves gives an empty table.
    """
    gains = nodes.where("slot IS NOT NULL").groupBy("tree", "slot").agg(F.sum(F.col("gain") * F.col("weight")).alias("g"))
    trees = gains.groupBy("tree").agg(F.sum("g").alias("all")).where("all > 0")
    shares = gains.join(F.broadcast(trees), "tree").groupBy("slot").agg(F.sum(F.col("g") / F.col("all")).alias("share"))
    total = shares.agg(F.sum("share").alias("total"))
    # one row
    return shares.join(F.broadcast(total)).select("slot", (F.col("share") / F.col("total")).alias("importance"))


def score(rows: DataFrame, nodes: DataFrame, key: str, classes: int = 0) -> DataFrame:
    """(key, prediction) of ``rows`` (key, features) by the trees of ``nodes``.

    A regression (``classes`` 0) predicts the mean of its trees' leaves. Else each tree gives a class the
    share of its leaf's weight, ``votes`` are the sums over trees and the prediction is the class of most
    votes, the smallest of equals. ``key`` tells rows apart and may be null in one row; rows that share a key
    are scored as one, so it has to be unique. Only slots some split asks for leave the vector, at most one per
    inner node. All trees of a row stay in its task, so only one row of sums per row is shuffled.
    """
    shape = nodes.agg(
        F.count(F.lit(1)).alias("n"), F.max("tree").alias("last"), F.max("level").alias("depth"), F.sort_array(F.collect_set("slot")).alias("slots"),
    ).first()
    if not shape.n:
        raise ValueError("The node table is empty.")
    if shape.slots:
        rows = VectorSlicer(inputCol="features", outputCol="_asked", indices=list(shape.slots)).transform(rows)
        values = vector_to_array("_asked")
    else:
        values = F.array().cast("array<double>")
    if shape.n <= BROADCAST_NODES:
        reached = _walked(rows.select(F.col(key).alias("_key"), values.alias("_values")), nodes, shape.slots, shape.depth, classes).groupBy("_key")
        mean = F.sum(F.get("_sums", F.lit(0))) / (F.count(F.lit(1)) * (shape.last + 1))
        votes = [F.sum(F.get("_sums", F.lit(k))) for k in range(classes)]
    else:
        reached = _joined(rows.select(F.col(key).alias("_key"), values.alias("_values")), nodes, shape.slots, shape.depth, shape.last).groupBy("_key")
        mean = F.avg("prediction")
        weight = F.aggregate("stats", F.lit(0.0), lambda a, v: a + v)
        votes = [F.sum(F.when(weight > 0, F.get("stats", F.lit(k)) / weight).otherwise(0.0)) for k in range(classes)]
    return _said(reached, key, mean, votes)


def _said(reached, key: str, mean: Column, votes: list[Column]) -> DataFrame:
    """(key, prediction) of rows grouped by ``_key``, with the votes if there are classes."""
    if not votes:
        return reached.agg(mean.alias("prediction")).withColumnRenamed("_key", key)
    summed = reached.agg(*[v.alias(f"_{k}") for k, v in enumerate(votes)])
    summed = summed.select(F.col("_key").alias(key), F.array(*[f"_{k}" for k in range(len(votes))]).alias("votes"))
    best = F.array_position("votes", F.array_max("votes")) - 1
    return summed.withColumn("prediction", best.cast("double"))


class _Walk:
    """Nodes as arrays, children by their place in them; leaves lead to themselves."""

    def __init__(self, nodes: pa.Table, slots: list[int], depth: int, classes: int):
        tree, node = (nodes[c].to_numpy().astype(np.int64) for c in ("tree", "node"))
        ids = tree << 32 | node
        order = np.argsort(ids)
        inner = np.asarray(nodes["slot"].is_valid())

        def child(c: str) -> np.ndarray:
            place = np.arange(len(ids))
            wanted = tree[inner] << 32 | nodes[c].drop_null().to_numpy().astype(np.int64)
            place[inner] = order[np.searchsorted(ids, wanted, sorter=order)]
            return place

        self.depth, self.width, self.roots = depth, len(slots), np.flatnonzero(node == 0)
        self.children = np.stack([child("right"), child("left")], axis=1).ravel()
        self.asked = np.zeros(len(ids), np.int64)
        self.asked[inner] = np.searchsorted(slots, nodes["slot"].drop_null().to_numpy())
        self.cut = np.full(len(ids), np.nan)
        cut = np.asarray(nodes["cut"].is_valid())
        self.cut[cut] = nodes["cut"].drop_null().to_numpy()
        # categories that go left, as one row of flags per node after the other
        sets = {i: v for i, v in enumerate(nodes["left_values"].to_pylist()) if v is not None}
        self.size, self.first = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for i, values in sets.items():
            self.size[i] = int(max(values, default=-1)) + 1
        self.first[1:] = np.cumsum(self.size)[:-1]
        self.flags = np.zeros(max(int(self.size.sum()), 1), bool)
        for i, values in sets.items():
            self.flags[self.first[i] + np.array(values, np.int64)] = True
        if classes:
            stats = np.array(nodes["stats"].to_pylist(), float).reshape(len(ids), -1)[:, :classes]
            weight = stats.sum(axis=1, keepdims=True)
            self.said = np.divide(stats, weight, out=np.zeros_like(stats), where=weight > 0)
        else:
            self.said = nodes["prediction"].to_numpy()[:, None]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per row the sum of what its leaves say."""
        trees, flat = len(self.roots), values.ravel()
        row = np.repeat(np.arange(len(values)) * self.width, trees)
        at = np.tile(self.roots, len(values))
        for _ in range(self.depth):
            value = flat[row + self.asked[at]]
            left = value <= self.cut[at]
            sets = np.flatnonzero(self.size[at])
            if len(sets):
                nodes, category = at[sets], value[sets]
                known = (category >= 0) & (category < self.size[nodes]) & (category == np.floor(category))
                place = self.first[nodes] + np.where(known, category, 0).astype(np.int64)
                left[sets] = known & self.flags[place]
            at = self.children[2 * at + left]
        return self.said[at].reshape(len(values), trees, -1).sum(axis=1)


def _walked(rows: DataFrame, nodes: DataFrame, slots: list[int], depth: int, classes: int) -> DataFrame:
    """(_key, _sums) of rows (_key, _values): sums over trees, of predictions or of each class's share."""
    # at most BROADCAST_NODES rows
    table = nodes.select("tree", "node", "slot", "cut", "left_values", "left", "right", "prediction", "stats").toArrow()
    walk = _Walk(table, slots, depth, classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, STEPS_AT_ONCE // len(walk.roots))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                values = part.column("_values").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, walk.width)
                sums = walk.sums(values)
                lists = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32), sums.ravel())
                yield pa.RecordBatch.from_arrays([part.column("_key"), lists], names=["_key", "_sums"])

    schema = rows.select("_key").schema.add("_sums", T.ArrayType(T.DoubleType()))
    return rows.mapInArrow(run, schema)


def _joined(rows: DataFrame, nodes: DataFrame, slots: list[int], depth: int, last: int) -> DataFrame:
    """The leaves that rows (_key, _values) reach, one per tree, by a shuffled join a level."""
    at = rows.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(last)))).withColumn("_node", F.lit(0))
    places = small_frame(rows.sparkSession, list(zip(slots, range(len(slots)))), "slot int, place int")
    splits = nodes.where("slot IS NOT NULL").join(F.broadcast(places), "slot")
    splits = splits.selectExpr("level", "tree AS _tree", "node AS _node", "place", "cut", "left_values", "left", "right")
    leaves = nodes.where("slot IS NULL").selectExpr("tree AS _tree", "node AS _node", "prediction", "stats")
    value = F.get("_values", F.col("place"))
    goes_left = F.when(F.col("cut").isNotNull(), value <= F.col("cut")).otherwise(F.array_contains("left_values", value))
    for level in range(depth):
        asked = splits.where(F.col("level") == level).drop("level")
        following = F.when(F.col("place").isNull(), F.col("_node")).when(goes_left, F.col("left")).otherwise(F.col("right"))
        at = at.join(asked, ["_tree", "_node"], "left").select("_key", "_values", "_tree", following.alias("_node"))
    return at.join(leaves, ["_tree", "_node"])
