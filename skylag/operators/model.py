"""Tree-model forecasts of P10, P50 and P90, split counts and additive attributions."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from skylag import functions as fn
from skylag.operators.scenario import MODEL_REQUEST
from skylag.schemas import FEATURE_DESCRIPTIONS, FEATURES, NO_DESCRIPTION, PERCENTILES
from skylag.session import checkpoint_root

Models = dict[str, GBTRegressionModel]
TOP = 10


def _vectors(features: DataFrame, *kept: str) -> DataFrame:
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    return assembler.transform(features).select(*kept, "features")


# Training -----------------------------------------------------------------------------

def fit_models(training: DataFrame, trees: int = 12, depth: int = 4, seed: int = 42) -> Models:
    """One boosted-tree model per percentile, fitted on the cells' log labels.

    The assembled table is checkpointed: boosting reads it many times, and a lost executor
    must not send it back to the flights. The three fits are independent and their many small
    jobs are submitted side by side.
    """
    checkpoint_root(training.sparkSession)
    labels = [f"label_{p}" for p in PERCENTILES]
    table = _vectors(training, *labels).checkpoint()

    def fit(p: str) -> GBTRegressionModel:
        return GBTRegressor(
            featuresCol="features", labelCol=f"label_{p}", predictionCol=f"log_{p}",
            maxIter=trees, maxDepth=depth, lossType="squared", seed=seed,
        ).fit(table)

    with ThreadPoolExecutor(len(PERCENTILES)) as pool:
        return dict(zip(PERCENTILES, pool.map(fit, PERCENTILES)))


def save_models(models: Models, folder: str) -> None:
    for p, model in models.items():
        model.write().overwrite().save(f"{folder}/{p}")


def load_models(folder: str) -> Models:
    return {p: GBTRegressionModel.load(f"{folder}/{p}") for p in PERCENTILES}


# Scoring ------------------------------------------------------------------------------

def _score(vectors: DataFrame, models: Models) -> DataFrame:
    for model in models.values():
        vectors = model.transform(vectors)
    return vectors


def log_forecast(features: DataFrame, models: Models) -> DataFrame:
    """The three predictions on the log scale that the models are fitted on."""
    scored = _score(_vectors(features, *MODEL_REQUEST), models)
    return scored.select(*MODEL_REQUEST, *[F.col(f"log_{p}").alias(p) for p in PERCENTILES])


def model_forecast(features: DataFrame, models: Models) -> DataFrame:
    """P10, P50 and P90 in minutes, the outlook, and whether the three models disagree in order."""
    scored = _score(_vectors(features, *MODEL_REQUEST), models)
    return scored.select(
        *MODEL_REQUEST,
        *[fn.from_log_delay(F.col(f"log_{p}")).alias(p) for p in PERCENTILES],
    ).withColumns({
        "band": fn.forecast_band(F.col("p50")),
        "crossed": (F.col("p10") > F.col("p50")) | (F.col("p50") > F.col("p90")),
    })


# Explanation --------------------------------------------------------------------------

def _feature_name(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(f) for f in FEATURES]), index + 1)


def _nodes(spark: SparkSession, folder: str, p: str) -> DataFrame:
    """Tree nodes of one saved model; leaves have no children."""
    return spark.read.parquet(f"{folder}/{p}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.rawCount",
        "nodeData.leftChild", "nodeData.rightChild",
        F.col("nodeData.split.featureIndex").alias("feature_index"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )


def split_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each saved model splits on each feature."""
    counts = [
        _nodes(spark, folder, p).where("leftChild >= 0").groupBy("feature_index")
        .agg(F.count(F.lit(1)).alias("splits")).withColumn("percentile", F.lit(p))
        for p in PERCENTILES
    ]
    return reduce(DataFrame.unionByName, counts).withColumn(
        "feature", _feature_name(F.col("feature_index")))


def feature_importance(counts: DataFrame, top: int = TOP) -> DataFrame:
    """The most used features of each model; ties in feature order."""
    window = Window.partitionBy("percentile").orderBy(F.desc("splits"), "feature_index")
    return (
        counts.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top)
        .select("percentile", "rank", "feature", "splits")
    )


class Leaf(NamedTuple):
    """A leaf's weighted value and, per feature tested on its path, the interval (lo, hi] that
    leads to it and the share of training rows that follow the path's tests of that feature."""

    value: float
    tests: dict[int, tuple[float, float, float]]


class Group(NamedTuple):
    """Leaves below one node, with the splits that tell which of their tests a flight passes."""

    splits: list[tuple[int, float]]
    leaves: list[Leaf]


#: Splits of a group at most (a single leaf may have more): what its leaves contribute is prepared for every outcome of
#: these. More splits make fewer groups, but every row carries the prepared vectors past the join.
GROUP_SPLITS = 5


def _groups(nodes: list, weights: list[float]) -> list[Group]:
    """The leaves of all trees in groups. A tree is cut at the highest nodes whose path and subtree have few enough splits."""
    by_id = {(n.treeID, n.id): n for n in nodes}

    def children(node) -> list:
        return [by_id[node.treeID, c] for c in (node.leftChild, node.rightChild)] if node.leftChild >= 0 else []

    def below(node) -> list[tuple[int, float]]:
        return [split for child in children(node) for split in below(child)] + (
            [(node.feature_index, node.threshold)] if children(node) else [])

    def leaves(node, tests: dict) -> list[Leaf]:
        if not children(node):
            return [Leaf(weights[node.treeID] * node.prediction, tests)]
        lo, hi, share = tests.get(node.feature_index, (-math.inf, math.inf, 1.0))
        intervals = [(lo, min(hi, node.threshold)), (max(lo, node.threshold), hi)]
        return [leaf for child, interval in zip(children(node), intervals)
                for leaf in leaves(child, {**tests, node.feature_index: (*interval, share * child.rawCount / node.rawCount)})]

    def cut(node, path: list, tests: dict) -> list[Group]:
        splits = list(dict.fromkeys([*path, *below(node)]))
        if len(splits) <= GROUP_SPLITS or not children(node):
            return [Group(splits, leaves(node, tests))]
        lo, hi, share = tests.get(node.feature_index, (-math.inf, math.inf, 1.0))
        own, found = (node.feature_index, node.threshold), []
        for child, interval in zip(children(node), [(lo, min(hi, own[1])), (max(lo, own[1]), hi)]):
            followed = {**tests, own[0]: (*interval, share * child.rawCount / node.rawCount)}
            found += cut(child, [*path, own], followed)
        return found

    return [group for tree in range(len(weights)) for group in cut(by_id[tree, 0], [], {})]


def _shapley_parts(leaf: Leaf) -> list[list[float]]:
    """Contribution of each tested feature for every set of passed tests, as a bit mask.

    In a coalition a feature counts 1 or 0 as its test is passed or not, outside of it its
    share of training rows. The coalitions of one size are the coefficients of a product with one
    factor per other feature, so none is listed; a path tests at most as many features as trees are deep.
    """
    shares = [share for _, _, share in leaf.tests.values()]
    m = len(shares)
    passed = (np.arange(2 ** m)[:, None] >> np.arange(m)) & 1
    weights = np.array([1 / (m * math.comb(m - 1, size)) for size in range(m)])
    parts = np.empty((2 ** m, m))
    for i in range(m):
        by_size = np.zeros((2 ** m, m))
        by_size[:, 0] = 1
        for j in range(m):
            if j != i:
                joined = np.roll(by_size, 1, axis=1) * passed[:, [j]]
                by_size = by_size * shares[j] + joined
        parts[:, i] = leaf.value * (passed[:, i] - shares[i]) * (by_size @ weights)
    return parts.tolist()


def _outcome_vectors(group: Group) -> np.ndarray:
    """Contributions of all features, one row per outcome of the group's splits (bit j: the value is above split j)."""
    above = (np.arange(2 ** len(group.splits))[:, None] >> np.arange(len(group.splits))) & 1
    place = {split: j for j, split in enumerate(group.splits)}
    out = np.zeros((len(above), len(FEATURES)))
    for leaf in group.leaves:
        if not leaf.tests:
            continue
        mask = np.zeros(len(above), dtype=int)
        for bit, (feature, (lo, hi, _)) in enumerate(leaf.tests.items()):
            passed = np.ones(len(above), dtype=bool)
            if lo > -math.inf:
                passed &= above[:, place[feature, lo]] == 1
            if hi < math.inf:
                passed &= above[:, place[feature, hi]] == 0
            mask |= passed << bit
        out[:, list(leaf.tests)] += np.array(_shapley_parts(leaf))[mask]
    return out


GROUPS = "percentile string, base_value double, groups array<struct<features:array<int>, thresholds:array<double>, vectors:array<array<double>>>>"
# What the groups of all models may take when they are sent to every task.
LEAF_BYTES = 32 << 20


def _bounded(leaves: list[Leaf], used: int) -> int:
    """Bytes of the leaves' contributions after ``used`` others; too many fail before they are computed."""
    used += sum(2 ** len(leaf.tests) * len(leaf.tests) * 8 for leaf in leaves)
    if used > LEAF_BYTES:
        raise ValueError(f"attributions of trees this deep and many take {used} bytes, over {LEAF_BYTES}")
    return used


def _saved_trees(spark: SparkSession, folder: str) -> dict[str, tuple[list, list[float]]]:
    """Nodes and tree weights of the saved models, read side by side."""
    def one(p: str) -> tuple[list, list[float]]:
        weights = spark.read.parquet(f"{folder}/{p}/treesMetadata").toDF("tree", "metadata", "weight").collect()
        return _nodes(spark, folder, p).collect(), [r["weight"] for r in sorted(weights, key=lambda r: r["tree"])]

    with ThreadPoolExecutor(len(PERCENTILES)) as pool:
        return dict(zip(PERCENTILES, pool.map(one, PERCENTILES)))


def _group_table(spark: SparkSession, folder: str) -> DataFrame:
    """One row per saved model: its base value and its groups of leaves with their prepared contributions.

    Its size follows from the models' parameters alone, trees times groups times two to ``GROUP_SPLITS``, and is checked.
    """
    rows, size = [], 0
    for p, (nodes, weights) in _saved_trees(spark, folder).items():
        groups = _groups(nodes, weights)
        leaves = [leaf for group in groups for leaf in group.leaves]
        size = _bounded(leaves, size)
        size += sum(2 ** len(g.splits) * len(FEATURES) * 8 for g in groups)
        if size > LEAF_BYTES:
            raise ValueError(f"attributions of trees this deep and many take {size} bytes, over {LEAF_BYTES}")
        base = sum(leaf.value * math.prod(t[2] for t in leaf.tests.values()) for leaf in leaves)
        rows.append((p, base, [([f for f, _ in g.splits], [t for _, t in g.splits], _outcome_vectors(g).tolist()) for g in groups]))
    return F.broadcast(spark.createDataFrame(rows, GROUPS))


def _spread(features: DataFrame) -> DataFrame:
    """Distinct flights, partitioned by key.

    Copies collapse in the tasks that hold them. The number of partitions is then fixed, as the
    few bytes of a flight say nothing about the work it multiplies into: partitions must not
    be merged by size.
    """
    partitions = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return features.dropDuplicates(MODEL_REQUEST).repartition(partitions, *MODEL_REQUEST)


def _outcome(group: Column) -> Column:
    """Which row of a group's vectors a flight takes: one bit per split it lies above."""
    bits = F.zip_with(group["features"], group["thresholds"],
                      lambda f, t: F.when(F.get(F.col("x"), f) > t, 1).otherwise(0))
    # The first split is the lowest bit.
    return F.aggregate(F.reverse(bits), F.lit(0), lambda number, bit: number * 2 + bit)


def contribution_vectors(features: DataFrame, folder: str) -> DataFrame:
    """One row per flight and model: ``contributions`` of all features, in feature order, and the ``base_value``.

    These are the Shapley values of the trees, with training shares for absent features:
    contributions and base value add up to the prediction. Trees are cut into groups of leaves with few splits; what a group
    contributes is prepared for each outcome of its splits, so that a flight costs one look-up and one sum of
    vectors per group, inside its row. Flights are spread by key, and nothing is multiplied before the result.
    """
    groups = _group_table(features.sparkSession, folder)
    per_model = _spread(features).select(
        *MODEL_REQUEST, F.array(*FEATURES).alias("x"),
        F.explode(F.array(*[F.lit(p) for p in PERCENTILES])).alias("percentile"))
    none = F.array_repeat(F.lit(0.0), F.lit(len(FEATURES)))
    added = F.aggregate("groups", none, lambda total, group: F.zip_with(
        total, F.get(group["vectors"], _outcome(group)), lambda a, b: a + b))
    return per_model.join(groups, "percentile").select(
        *MODEL_REQUEST, "percentile", added.alias("contributions"), "base_value")


def attribution(features: DataFrame, folder: str) -> DataFrame:
    """Contribution of every feature to every log prediction of the models saved in ``folder``, a row each."""
    return (
        contribution_vectors(features, folder)
        .select(*MODEL_REQUEST, "percentile", "base_value", F.posexplode("contributions").alias("feature_index", "contribution"))
        .select(*MODEL_REQUEST, "percentile", "feature_index", "contribution",
                _feature_name(F.col("feature_index")).alias("feature"), "base_value")
    )


def attribution_top(contributions: DataFrame, top: int = TOP) -> DataFrame:
    """The largest contributions of each prediction by size, numbered in feature order."""
    request = Window.partitionBy(*MODEL_REQUEST, "percentile")
    largest = request.orderBy(F.desc(F.abs("contribution")), F.desc("feature_index"))
    return (
        contributions.withColumn("_n", F.row_number().over(largest)).where(F.col("_n") <= top)
        .withColumn("position", F.row_number().over(request.orderBy("feature_index")))
        .select(*MODEL_REQUEST, "percentile", "position", "feature",
                F.bround("contribution", 2).alias("contribution"), "base_value")
    )


def feature_descriptions(important: DataFrame, attributed: DataFrame) -> DataFrame:
    """Every feature named by either view of a model, with its description."""
    named = important.select("percentile", "feature").union(
        attributed.select("percentile", "feature")).distinct()
    texts = F.create_map(*[F.lit(x) for pair in FEATURE_DESCRIPTIONS.items() for x in pair])
    return named.withColumn(
        "description", F.coalesce(F.try_element_at(texts, F.col("feature")), F.lit(NO_DESCRIPTION)))
