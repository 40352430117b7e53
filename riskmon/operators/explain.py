"""Exact path-dependent Shapley values of boosted trees, and their summaries.

A tree's expectation under a set of known features is a sum over leaves of the
leaf's value times one factor per feature on its path: whether the row follows
the feature's splits, or the share of training rows that do. Each leaf is thus a
product game of its path's features, whose Shapley values are integrals of a
polynomial, in time quadratic in the length of the path.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Leaf:
    """Value times tree weight; per feature the interval (low, high] of its splits and the share of rows that follow them.

    A feature with categorical splits has the set of its categories on this path as a fourth entry.
    """

    value: float
    splits: dict[int, tuple]


def admits(x: np.ndarray, split: tuple) -> np.ndarray:
    """Which values of a feature follow its splits."""
    inside = (x > split[0]) & (x <= split[1])
    return inside & np.isin(x, list(split[3])) if len(split) > 3 else inside


def leaves(model: PipelineModel) -> list[Leaf]:
    """All leaves of a fitted tree ensemble."""
    return [leaf for tree in tree_leaves(model) for leaf in tree]


def tree_leaves(model: PipelineModel) -> list[list[Leaf]]:
    """The leaves of each tree, in the order of boosting."""
    trees, found = model.stages[-1], []

    def walk(node, weight: float, splits: dict[int, tuple], out: list[Leaf]) -> None:
        if node.subtreeDepth() == 0:
            out.append(Leaf(weight * node.prediction(), splits))
            return
        split = node.split()
        f, nominal = split.featureIndex(), split.getClass().getSimpleName() == "CategoricalSplit"
        count = node.impurityStats().rawCount()
        for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
            low, high, share, *among = splits.get(f, (-np.inf, np.inf, 1.0))
            if nominal:
                own = frozenset(split.leftCategories() if left else split.rightCategories())
                among = [own & among[0] if among else own]
            else:
                low, high = (low, min(high, split.threshold())) if left else (max(low, split.threshold()), high)
            walk(child, weight, splits | {f: (low, high, share * child.impurityStats().rawCount() / count, *among)}, out)

    for tree, weight in zip(trees.trees, trees.treeWeights):
        found.append([])
        walk(tree._call_java("rootNode"), weight, {}, found[-1])
    return found


def staged_margins(df: DataFrame, model: PipelineModel, columns: list[str], keep: list[str]) -> DataFrame:
    """(keep..., trees, margin) of all rows under every prefix of the boosted trees."""
    found = tree_leaves(model)
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def staged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, total = pdf[columns].to_numpy(float), np.zeros((len(pdf), len(found)))
            for k, tree in enumerate(found):
                for leaf in tree:
                    inside = np.ones(len(x), bool)
                    for f, split in leaf.splits.items():
                        inside &= admits(x[:, f], split)
                    total[inside, k] = leaf.value
            margin = np.cumsum(total, axis=1)
            held = {c: np.repeat(pdf[c].to_numpy(), len(found)) for c in keep}
            yield pd.DataFrame(held | {"trees": np.tile(np.arange(1, len(found) + 1, dtype=np.int32), len(pdf)), "margin": margin.ravel()})

    schema = ", ".join([*(f"{k} {fields[k]}" for k in keep), "trees int, margin double"])
    rows = df.na.fill(-1e9, columns).select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return rows.mapInPandas(staged, schema)


def shapley(x: np.ndarray, all_leaves: list[Leaf]) -> tuple[np.ndarray, float]:
    """Values per row and feature, and the ensemble's expectation."""
    phi, base = np.zeros(x.shape), 0.0
    for leaf in all_leaves:
        features = list(leaf.splits)
        share = {f: leaf.splits[f][2] for f in features}
        base += leaf.value * float(np.prod([share[f] for f in features]))
        follows = {f: admits(x[:, f], leaf.splits[f]).astype(float) for f in features}
        # The sum over all sets of the other features, weighted by size, is the integral over t in [0, 1] of the
        # product of share (1 - t) + follows t: a polynomial that so many Gauss points integrate exactly.
        nodes, weights = np.polynomial.legendre.leggauss(max(1, (len(features) + 1) // 2))
        for t, weight in zip((nodes + 1) / 2, weights / 2):
            factors = {f: share[f] * (1 - t) + follows[f] * t for f in features}
            whole = weight * leaf.value * np.prod(list(factors.values()), axis=0) if features else None
            for f in features:
                phi[:, f] += whole / factors[f] * (follows[f] - share[f])
    return phi, base


def attributions(df: DataFrame, model: PipelineModel, columns: list[str], keep: list[str]) -> DataFrame:
    """Long form (keep..., feature, phi) of all rows; nulls are scored as in training."""
    found = leaves(model)
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def explained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            phi, _ = shapley(pdf[columns].to_numpy(float), found)
            long = {k: np.repeat(pdf[k].to_numpy(), len(columns)) for k in keep}
            yield pd.DataFrame(long | {"feature": np.tile(columns, len(pdf)), "phi": phi.ravel()})

    schema = ", ".join([*(f"{k} {fields[k]}" for k in keep), "feature string", "phi double"])
    return df.na.fill(-1e9, columns).select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(explained, schema)


def summary(long: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """Mean absolute, mean and per-class mean attribution of each feature."""
    return long.groupBy(*by, "feature").agg(
        F.avg(F.abs("phi")).alias("mean_abs"), F.avg("phi").alias("mean"),
        F.avg(F.when(F.col(label) == 1, F.col("phi"))).alias("mean_positive"), F.avg(F.when(F.col(label) == 0, F.col("phi"))).alias("mean_negative"),
    )
