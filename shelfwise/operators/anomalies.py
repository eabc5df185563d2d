"""Sales anomalies: an isolation forest over four figures, and rule-based labels.

The forest follows Liu, Ting and Zhou, "Isolation Forest" (ICDM 2008). Trees are grown from small
samples in parallel tasks; rows are scored in Arrow batches. Everything else is plain SQL work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.quantiles import exact_quantile
from shelfwise.session import cut_lineage, written

FIGURES = ("price", "discount", "units_sold", "revenue")
TREE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, depth double"

HIGH, LOW = "High Sales Anomaly", "Low Sales Anomaly"


def unsuccessful_search(n: float) -> float:
    """Mean path length of a failed search in a binary search tree of ``n`` entries."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(sample: np.ndarray, rng: np.random.Generator, deepest: int) -> list[tuple]:
    """Nodes of one random tree as (node, feature, cut, left, right, depth); a leaf has feature -1."""
    nodes: list[tuple] = []
    todo = [(sample, 0, -1, 0)]
    links: dict[int, list[int]] = {}
    while todo:
        rows, depth, parent, side = todo.pop()
        node = len(nodes)
        if parent >= 0:
            links[parent][side] = node
        low, high = rows.min(axis=0), rows.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= deepest or len(rows) <= 1 or not len(open_features):
            nodes.append((node, -1, 0.0, depth + unsuccessful_search(len(rows))))
            continue
        feature = int(rng.choice(open_features))
        cut = float(rng.uniform(low[feature], high[feature]))
        goes_left = rows[:, feature] <= cut
        links[node] = [-1, -1]
        nodes.append((node, feature, cut, float(depth)))
        todo += [(rows[~goes_left], depth + 1, node, 1), (rows[goes_left], depth + 1, node, 0)]
    return [(n, f, cut, *links.get(n, [-1, -1]), depth) for n, f, cut, depth in nodes]


def fit_forest(df: DataFrame, trees: int = 100, sample_rows: int = 256, seed: int = 42) -> DataFrame:
    """Trees as node rows. The sample has about ``trees * sample_rows`` rows, whatever the table holds."""
    total = df.count()
    figures = df.select(*[F.col(n).cast("double").alias(n) for n in FIGURES])
    fraction = min(1.0, 1.2 * trees * sample_rows / max(total, 1))
    rows_per_tree = max(1, min(sample_rows, total))
    # drawn once and written, so that a retried task does not draw other rows
    drawn = cut_lineage(figures.sample(fraction=fraction, seed=seed) if fraction < 1 else figures)
    if fraction < 1:
        dealt = drawn.withColumn("tree", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(trees)).cast("int"))
    else:  # fewer rows than the forest asks for: every tree samples from all of them
        dealt = drawn.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    deepest = math.ceil(math.log2(max(rows_per_tree, 2)))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(key[0])])
        rows = pdf[list(FIGURES)].to_numpy()
        rows = rows[np.lexsort(rows.T)]
        if len(rows) > rows_per_tree:
            rows = rows[rng.choice(len(rows), rows_per_tree, replace=False)]
        out = pd.DataFrame(grow_tree(rows, rng, deepest), columns=["node", "feature", "cut", "left", "right", "depth"])
        out.insert(0, "tree", int(key[0]))
        return out

    return dealt.groupBy("tree").applyInPandas(grow, TREE_SCHEMA)


def as_heap(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(feature, cut, depth)`` of a tree laid out level by level, the children of node ``i`` at ``2i + 1`` and ``2i + 2``.

    ``depth`` is that of the lowest level alone; below a leaf both sides lead to its depth. A tree of ``n`` sampled rows
    is cut at most ``log2(n)`` levels deep, so this is no larger than a few times the tree.
    """
    level, features, cuts = np.zeros(1, dtype=np.int64), [], []
    while (feature[level] >= 0).any():
        leaf = feature[level] < 0
        features.append(np.where(leaf, 0, feature[level]))
        cuts.append(np.where(leaf, np.inf, cut[level]))
        level = np.column_stack([np.where(leaf, level, left[level]), np.where(leaf, level, right[level])]).ravel()
    empty = [np.empty(0)]
    return np.concatenate(empty + features).astype(np.int64), np.concatenate(empty + cuts), depth[level]


def path_score(heaps: list[tuple[np.ndarray, ...]], values: np.ndarray, sample_rows: int) -> np.ndarray:
    """Anomaly score of each row, 2 to the power of minus its mean path length over the expected one.

    All rows go down a tree together, one level at a time.
    """
    total = np.zeros(len(values))
    flat, width = np.ascontiguousarray(values, dtype=float).ravel(), values.shape[1]
    base = np.arange(len(values)) * width
    for feature, cut, depth in heaps:
        at = np.zeros(len(values), dtype=np.int64)
        for _ in range(len(depth).bit_length() - 1):
            right = ~(flat.take(base + feature.take(at)) <= cut.take(at))  # a missing value goes right
            at += at
            at += 1
            at += right
        total += depth.take(at - len(feature))
    return np.power(2.0, -total / len(heaps) / unsuccessful_search(sample_rows))


def with_scores(df: DataFrame, forest: DataFrame, sample_rows: int = 256) -> DataFrame:
    """All rows with their anomaly score: a projection in Arrow batches, without a shuffle.

    The forest is at most ``trees * 2 * sample_rows`` nodes and goes with the tasks.
    """
    nodes = forest.orderBy("tree", "node").toPandas()
    names = ("feature", "cut", "left", "right", "depth")
    heaps = [as_heap(*[part[n].to_numpy() for n in names]) for _, part in nodes.groupby("tree")]

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            values = np.column_stack([col.to_numpy(dtype=float) for col in columns])
            yield pd.Series(path_score(heaps, values, sample_rows))

    return df.withColumn("score", score(*[F.col(n).cast("double") for n in FIGURES]))


def flag_anomalies(
    df: DataFrame, outlier_fraction: float = 0.05, trees: int = 100, sample_rows: int = 256, seed: int = 42
) -> DataFrame:
    """Rows whose score is above the ``1 - outlier_fraction`` quantile of all row scores.

    The scored rows are written once; the quantile then reads one column, and the result is a filter.
    """
    if not 0.01 <= outlier_fraction <= 0.5:
        raise ValueError("outlier_fraction must be between 0.01 and 0.5")
    forest = fit_forest(df, trees, sample_rows, seed)
    used = min(sample_rows, max(2, df.count()))
    scored = written(with_scores(df, forest, used))
    return scored.where(F.col("score") > exact_quantile(scored, "score", 1 - outlier_fraction).scalar())


def classify_anomalies(df: DataFrame, mean_units, spike_multiplier: float = 2.0) -> DataFrame:
    """Adds label and reason; ``mean_units`` is the mean over all cleaned rows, flagged or not."""
    if not 1 <= spike_multiplier <= 10:
        raise ValueError("spike_multiplier must be between 1 and 10")
    high = F.col("units_sold") >= mean_units * spike_multiplier
    reason = (
        F.when(high & (F.col("discount") >= 20), "Discount driven spike")
        .when(high, "Unexpected sales spike")
        .when(F.col("units_sold") == 0, "Stockout — zero units sold")
        .otherwise("Low demand issue")
    )
    return df.withColumns({"anomaly_label": F.when(high, HIGH).otherwise(LOW), "reason": reason})


def mean_units(df: DataFrame):
    return df.agg(F.avg("units_sold").alias("m")).scalar()


def anomaly_counts(classified: DataFrame) -> DataFrame:
    label = F.col("anomaly_label")
    return classified.agg(
        F.count(F.lit(1)).alias("total_anomalies"),
        F.count_if(label == HIGH).alias("high_sales_anomalies"),
        F.count_if(label == LOW).alias("low_sales_anomalies"),
    )


def top_anomalies(classified: DataFrame, max_results: int = 50) -> DataFrame:
    """The strongest anomalies first, as flat records."""
    if not 1 <= max_results <= 500:
        raise ValueError("max_results must be between 1 and 500")
    keys = ["product_id", "date", "store_id", "category", "region"]
    return (
        classified.orderBy(F.desc("score"), *keys, "units_sold")
        .limit(max_results)
        .select(*keys, *[F.col(n).cast("double").alias(n) for n in FIGURES], "anomaly_label", "reason")
    )


def detect_anomalies(
    df: DataFrame, outlier_fraction: float = 0.05, spike_multiplier: float = 2.0, **forest
) -> DataFrame:
    """All flagged rows of cleaned sales with score, label and reason."""
    return classify_anomalies(flag_anomalies(df, outlier_fraction, **forest), mean_units(df), spike_multiplier)
