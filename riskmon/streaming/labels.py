"""Delayed labels: a stream of scores meets a stream of labels within a bounded interval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_time(delay: str):
    """A label counts from its event's time on and up to `delay` later."""
    return (F.col("label_time") >= F.col("event_time")) & (F.col("label_time") <= F.col("event_time") + F.expr(f"interval {delay}"))


def split_labels(labels: DataFrame, delay: str) -> tuple[DataFrame, DataFrame]:
    """Labels (event_id, event_time, label_time, label) in time, and those for the side table: too late, too early, or without a time."""
    fine = F.coalesce(in_time(delay), F.lit(False))
    return labels.where(fine), labels.where(~fine)


def labelled_scores(scores: DataFrame, labels: DataFrame, delay: str, lateness: str) -> DataFrame:
    """Scores (event_id, event_time, score) with the label that came in time, or null once none can come any more.

    Both streams may be out of order by `lateness`; state is kept no longer than `delay`
    and `lateness` ask for. Labels name their event's time too, so one that is late is
    told apart without state (`split_labels`). On two tables the same call gives the
    batch answer.
    """
    fine, _ = split_labels(labels, delay)
    right = fine.select(F.col("event_id").alias("of_event"), "label_time", "label").withWatermark("label_time", lateness)
    left = scores.withWatermark("event_time", lateness)
    same = (F.col("event_id") == F.col("of_event")) & in_time(delay)
    return left.join(right, same, "left_outer").drop("of_event")
