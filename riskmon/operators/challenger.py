"""Challenger evaluation: windows, paired bootstrap tests and the guarded decision."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmon.operators import bootstrap


def windows(df: DataFrame, delay: int, label: str = "label") -> DataFrame:
    """(batch, role): the last two mature batches evaluate, the shortest suffix of the others with both classes calibrates, the rest trains.

    Raises if fewer than four batches are mature.
    """
    counts = df.groupBy("batch").agg(F.sum(F.col(label).cast("long")).alias("positives"), F.count(F.lit(1)).alias("rows"))
    latest = F.max("batch").over(Window.partitionBy())
    mature = counts.withColumn("latest", latest).where(F.col("batch") + delay <= F.col("latest"))
    held = [(r["batch"], r["positives"], r["rows"]) for r in mature.orderBy("batch").collect()]
    if len(held) < 4:
        raise ValueError("at least four mature batches are needed")
    rest, start, positives, negatives = held[:-2], None, 0, 0
    for batch, p, n in reversed(rest):
        positives, negatives, start = positives + p, negatives + n - p, batch
        if positives and negatives:
            break
    role = F.when(F.col("batch") >= held[-2][0], "evaluation").when(F.col("batch") >= start, "calibration").otherwise("training")
    return mature.select("batch", "rows", "positives", role.alias("role"))


def average_precision(y: np.ndarray, p: np.ndarray, n: np.ndarray | None = None) -> float:
    """Of rows that occur n times each."""
    n = np.ones(len(y), np.int64) if n is None else n
    order = np.argsort(-p, kind="stable")
    y, p, n = y[order], p[order], n[order]
    last = np.flatnonzero(np.append(p[1:] != p[:-1], True))
    hits, seen = np.cumsum(y * n)[last], np.cumsum(n)[last]
    whole = (y * n).sum()
    return float((np.diff(np.append(0, hits)) * hits / np.maximum(seen, 1)).sum() / whole) if whole else float("nan")


def recall(y: np.ndarray, decided: np.ndarray, n: np.ndarray | None = None) -> float:
    n = np.ones(len(y), np.int64) if n is None else n
    return float((decided * y * n).sum() / (y * n).sum()) if (y * n).sum() else float("nan")


def paired_difference(scores: DataFrame, metric: str | Callable, iterations: int = 500, level: float = 0.95, seed: int = 42) -> tuple[float, float, float] | None:
    """(difference, lower, upper) of metric(challenger) - metric(champion) under stratified resampling, for windows of any size.

    `metric` is a name of `bootstrap.METRICS`, or `average_precision` or `recall` of this
    module. None for a single class.
    """
    named = {average_precision: "pr_auc", recall: "recall"}
    return bootstrap.difference(scores, named.get(metric, metric), iterations, level, seed)


def paired_average_precision(scores: DataFrame, iterations: int = 500, level: float = 0.95, seed: int = 42) -> tuple[float, float, float] | None:
    """The same for average precision."""
    return bootstrap.difference(scores, "pr_auc", iterations, level, seed)


def decide(pr_auc: tuple[float, float, float] | None, recall_difference: tuple[float, float, float] | None, regressions: int) -> bool:
    """Recommend only a surely better ranking with no loss of recall, overall or in any segment."""
    return bool(pr_auc and recall_difference and pr_auc[1] > 0 and recall_difference[1] >= 0 and not regressions)


def segment_recall(scores: DataFrame, minimum_positive: int, minimum_negative: int = 0, iterations: int = 300, seed: int = 42) -> DataFrame:
    """Per segment value: both recalls and their difference with 95 % bounds from its own resamples; segments with too few of either class are left out.

    `scores` holds segment, value, label and the 0/1 decisions champion and challenger.
    Only the four counts of decision pairs among positives matter, so each
    segment is resampled from them as a multinomial.
    """
    bad = F.col("label") == 1
    counted = scores.groupBy("segment", "value").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("positives"), F.count_if(~bad).alias("negatives"),
        F.count_if(bad & (F.col("champion") == 1)).alias("first"), F.count_if(bad & (F.col("challenger") == 1)).alias("second"),
        F.count_if(bad & F.expr("champion = 1 and challenger = 0")).alias("lost"), F.count_if(bad & F.expr("champion = 0 and challenger = 1")).alias("won"),
    )
    supported = counted.where((F.col("positives") >= max(1, minimum_positive)) & (F.col("negatives") >= minimum_negative))
    names = ["segment", "value", "rows", "positives", "negatives", "champion_recall", "challenger_recall", "recall_difference", "lower", "upper", "reliable_regression"]

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                share = np.array([r.lost, r.won, r.positives - r.lost - r.won]) / r.positives
                draw = np.random.default_rng(seed).multinomial(r.positives, share, iterations)
                low, high = np.quantile((draw[:, 1] - draw[:, 0]) / r.positives, [0.025, 0.975])
                held = r.segment, r.value, r.rows, r.positives, r.negatives
                rows.append((*held, r.first / r.positives, r.second / r.positives, (r.won - r.lost) / r.positives, low, high, bool(high < 0)))
            yield pd.DataFrame(rows, columns=names)

    schema = ", ".join(f"{n} {'string' if n in names[:2] else 'long' if n in names[2:5] else 'boolean' if n == names[-1] else 'double'}" for n in names)
    return supported.mapInPandas(bounds, schema)
