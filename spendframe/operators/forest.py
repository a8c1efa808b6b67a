"""Isolation forest (Liu, Ting, Zhou 2008) grown and scored as Spark jobs.

Samples are drawn by hashing (row, tree, seed), and every tree has its own
random generator, so the forest does not depend on the partitioning. Trees
grow in parallel in groups of a few samples of at most 256 rows each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .features import FEATURES

# --- fixed values -----------------------------------------------------------
TREES = 200
SAMPLE = 256
SEED = 42
MIN_CONTAMINATION = 0.05
MAX_CONTAMINATION = 0.15
# ----------------------------------------------------------------------------
_TREES_PER_TASK_GROUP = 10
SENT_NODES = 1_500_000  # about 40 MB; seven shared forests of 200 trees have at most 715,400
GROUP_ROWS = 50_000  # feature vectors scored at once
_OVERSAMPLE = 3
Z_FEATURES = [f"z_{name}" for name in FEATURES]
_EULER = 0.5772156649015329


def mean_path(size):
    """Average path length of an unsuccessful search among ``size`` points."""
    n = np.asarray(size, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + _EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def grow_tree(points: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """One isolation tree as parallel node lists; a leaf has feature -1 and its path length."""
    limit = int(np.ceil(np.log2(max(len(points), 2))))
    leaf_path = mean_path(np.arange(len(points) + 1))
    chance = rng.random((2 * len(points) + 1, 2))  # one feature and one position draw per node
    nodes: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "path": []}

    def add(feature: int, threshold: float, path: float) -> int:
        for name, value in zip(nodes, (feature, threshold, -1, -1, path)):
            nodes[name].append(value)
        return len(nodes["feature"]) - 1

    pending = [(np.arange(len(points)), 0, -1, "")]
    while pending:
        rows, depth, parent, side = pending.pop()
        block = points[rows]
        low, high = block.min(axis=0), block.max(axis=0)
        splittable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(splittable) == 0:
            node = add(-1, 0.0, depth + float(leaf_path[len(rows)]))
        else:
            pick, place = chance[len(nodes["feature"])]
            feature = int(splittable[int(pick * len(splittable))])
            cut = low[feature] + place * (high[feature] - low[feature])
            threshold = float(min(cut, np.nextafter(high[feature], low[feature])))
            node = add(feature, threshold, 0.0)
            goes_left = block[:, feature] <= threshold
            pending.append((rows[~goes_left], depth + 1, node, "right"))
            pending.append((rows[goes_left], depth + 1, node, "left"))
        if parent >= 0:
            nodes[side][parent] = node
    return nodes


def path_lengths(points: np.ndarray, tree: dict[str, np.ndarray]) -> np.ndarray:
    """Path length of every point in one tree."""
    feature, threshold = np.asarray(tree["feature"]), np.asarray(tree["threshold"])
    left, right, path = np.asarray(tree["left"]), np.asarray(tree["right"]), np.asarray(tree["path"])
    node = np.zeros(len(points), dtype=np.int64)
    moving = np.flatnonzero(feature[node] >= 0)
    while len(moving):
        at = node[moving]
        goes_left = points[moving, feature[at]] <= threshold[at]
        node[moving] = np.where(goes_left, left[at], right[at])
        moving = moving[feature[node[moving]] >= 0]
    return path[node]


TREE_SCHEMA = (
    "model_key string, tree int, sample_rows int, feature array<int>, threshold array<double>, "
    "left array<int>, right array<int>, path array<double>"
)


def train_trees(
    scaled: DataFrame, key: str = "category", row_key: str = "date",
    trees: int = TREES, sample: int = SAMPLE, seed: int = SEED,
) -> DataFrame:
    """Node table of the forest of every model; ``scaled`` needs ``train_rows`` per model."""
    tasks = int(scaled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.least(F.lit(1.0), F.lit(float(_OVERSAMPLE * sample)) / F.col("train_rows"))
    drawn = F.filter(F.sequence(F.lit(1), F.lit(trees)), lambda tree: F.pmod(F.xxhash64("row_hash", tree), F.lit(1 << 31)) < F.col("share") * F.lit(float(1 << 31)))
    draw = F.pmod(F.xxhash64("row_hash", "tree"), F.lit(1 << 31))
    position = F.row_number().over(Window.partitionBy(key, "tree").orderBy("draw", row_key))
    # the trees that draw a row are found inside the row; about three samples' worth of rows per tree is made and shuffled
    samples = (
        scaled.repartition(tasks).withColumn("row_hash", F.xxhash64(F.col(key), F.col(row_key).cast("string"), F.lit(seed)))
        .select(key, row_key, *Z_FEATURES, "row_hash", share.alias("share"))
        .select("*", F.explode(drawn).alias("tree")).withColumn("draw", draw)
        .withColumn("position", position).where(F.col("position") <= sample)
        .withColumn("tree_group", F.floor((F.col("tree") - 1) / F.lit(_TREES_PER_TASK_GROUP)))
        .drop("row_hash", "share", "draw")
    )

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        model = str(group[key].iloc[0])
        grown = []
        for tree, rows in group.sort_values(["tree", "position"]).groupby("tree", sort=True):
            rng = np.random.default_rng([seed, int(tree), zlib.crc32(model.encode())])
            nodes = grow_tree(rows[Z_FEATURES].to_numpy(dtype=float), rng)
            grown.append({"model_key": model, "tree": int(tree), "sample_rows": len(rows), **nodes})
        return pd.DataFrame(grown)

    # growing is processor-bound, so the small groups must not be merged into few tasks
    return samples.repartition(tasks, key, "tree_group").groupBy(key, "tree_group").applyInPandas(grow, TREE_SCHEMA)


def score(rows: DataFrame, trees: DataFrame, key: str = "category", spread: int = 8, sent_nodes: int = SENT_NODES) -> DataFrame:
    """``rows`` with ``score`` in [-1, 0): the lower, the more isolated. Rows without a model are dropped.

    Forests of at most ``sent_nodes`` nodes together go to every task, and rows are
    scored batch by batch where they are. Larger ones, as with a model for each
    tenant, meet their rows by key, in groups that are split by size.
    """
    nodes = trees.agg(F.sum(F.size("feature"))).first()[0] or 0
    return _score_in_place(rows, trees, key) if nodes <= sent_nodes else _score_by_key(rows, trees, key)


def _isolation(matrix: np.ndarray, forest: list[dict]) -> np.ndarray:
    total = np.zeros(len(matrix))
    for tree in forest:
        total += path_lengths(matrix, tree)
    typical = float(mean_path([tree["sample_rows"] for tree in forest]).sum())
    return -np.power(2.0, -total / max(typical, 1e-12))


def _score_in_place(rows: DataFrame, trees: DataFrame, key: str) -> DataFrame:
    forests: dict[str, list[dict]] = {}
    for tree in sorted(trees.toPandas().to_dict("records"), key=lambda t: t["tree"]):  # their size is checked
        forests.setdefault(tree["model_key"], []).append(tree)
    sent = rows.sparkSession.sparkContext.broadcast(forests)
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for model, points in batch.groupby(key, sort=False):
                if model in sent.value:
                    yield points.assign(score=_isolation(points[Z_FEATURES].to_numpy(dtype=float), sent.value[model]))

    return rows.mapInPandas(run, schema)


def _score_by_key(rows: DataFrame, trees: DataFrame, key: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Score each model's different feature vectors, in groups of about ``group_rows`` with a copy of its trees.

    Equal vectors have equal scores, so they are scored once and rows that repeat one without
    end do not meet in a task; the join that brings the scores back is split by size.
    """
    vectors = rows.select(key, *Z_FEATURES).distinct()
    sizes = vectors.groupBy(F.col(key).alias("__model")).agg(F.ceil(F.count(F.lit(1)) / F.lit(group_rows)).cast("int").alias("groups"))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in Z_FEATURES]), F.col("groups")).cast("int")
    salted = vectors.join(sizes, F.col(key) == F.col("__model")).select(key, *Z_FEATURES, salt.alias("__salt"))
    copies = trees.join(sizes, F.col("model_key") == F.col("__model")).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups", "__model")
    schema = T.StructType([vectors.schema[name] for name in (key, *Z_FEATURES)] + [T.StructField("score", T.DoubleType())])
    names = schema.fieldNames()

    def apply(points: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        if points.empty or forest.empty:
            return pd.DataFrame({name: pd.Series([], dtype=object) for name in names})
        trees_in_order = forest.sort_values("tree").to_dict("records")
        return points.assign(score=_isolation(points[Z_FEATURES].to_numpy(dtype=float), trees_in_order))[names]

    scored = (
        salted.groupBy(key, "__salt")
        .cogroup(copies.withColumnRenamed("model_key", "__model").groupBy("__model", "__salt"))
        .applyInPandas(apply, schema)
    )
    same = [F.col(f"__s.{name}").eqNullSafe(F.col(f"__r.{name}")) for name in Z_FEATURES]
    joined = rows.alias("__r").join(scored.alias("__s"), [F.col(f"__r.{key}") == F.col(f"__s.{key}"), *same])
    return joined.select(*[F.col(f"__r.{name}") for name in rows.columns], "__s.score")


def offsets(training_scores: DataFrame, key: str = "category") -> DataFrame:
    """Score below which a row is an anomaly: the contamination quantile of the training scores."""
    whole = Window.partitionBy(key)
    ranked = (
        training_scores.withColumn("n", F.count(F.lit(1)).over(whole))
        .withColumn("rank", F.row_number().over(whole.orderBy("score")) - 1)
        .withColumn("contamination", F.least(
            F.lit(MAX_CONTAMINATION), F.greatest(F.lit(MIN_CONTAMINATION), F.lit(2.0) / F.col("n"))
        ))
        .withColumn("at", F.col("contamination") * (F.col("n") - 1))
    )
    low = F.max(F.when(F.col("rank") == F.floor("at"), F.col("score")))
    high = F.max(F.when(F.col("rank") == F.ceil("at"), F.col("score")))
    return ranked.groupBy(key).agg(
        F.first("contamination").alias("contamination"),
        (low + (high - low) * F.first(F.col("at") - F.floor("at"))).alias("offset"),
    )


def decide(scored: DataFrame, offset_table: DataFrame, key: str = "category") -> DataFrame:
    """``decision`` = score - offset and ``model_flag`` (decision below 0)."""
    return (
        scored.join(offset_table.select(key, "offset"), key)
        .withColumn("decision", F.col("score") - F.col("offset"))
        .withColumn("model_flag", F.col("decision") < 0)
        .drop("offset")
    )
