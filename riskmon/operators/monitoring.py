"""Label maturity, performance status, segments with pooling and the action policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmon.operators.features import as_category
from riskmon.operators.metrics import rates

OTHER = "__OTHER__"


def label_status(batch: Column, delay: int, latest: Column) -> Column:
    return F.when(batch + delay <= latest, "mature").otherwise("pending")


def performance_status(value: Column, warning: Column, critical: Column, higher_is_worse: bool) -> Column:
    odd = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    beyond = (lambda limit: value > limit) if higher_is_worse else (lambda limit: value < limit)
    return F.when(odd, "unavailable").when(beyond(critical), "critical").when(beyond(warning), "warning").otherwise("healthy")


def top_values(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The k most frequent values of each column, ties to the smaller value: (segment, value, rows)."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("segment"), as_category(c).alias("value")) for c in columns]))
    counts = df.select(each.alias("r")).groupBy("r.segment", "r.value").agg(F.count(F.lit(1)).alias("rows"))
    place = F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("rows"), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= k).drop("place")


def segments(df: DataFrame, top: DataFrame, capped: list[str], plain: list[str]) -> DataFrame:
    """Rows once per segment column: (..., segment, value); values outside the top list become one."""
    pieces = F.explode(F.array(*[F.struct(F.lit(c).alias("segment"), as_category(c).alias("value")) for c in (*capped, *plain)]))
    long = df.select("*", pieces.alias("r")).select(*df.columns, "r.segment", "r.value")
    kept = top.select(F.col("segment").alias("ts"), F.col("value").alias("tv"))
    held = long.join(F.broadcast(kept), (F.col("segment") == F.col("ts")) & (F.col("value") == F.col("tv")), "left")
    known = F.col("tv").isNotNull() | ~F.col("segment").isin(capped) if capped else F.lit(True)
    return held.withColumn("value", F.when(known, F.col("value")).otherwise(OTHER)).drop("ts", "tv")


COUNTS = ("rows", "positives", "negatives", "true_positive", "false_positive", "false_negative", "true_negative", "fraud_amount", "captured_amount")


def segment_counts(df: DataFrame, by: list[str], threshold: Column) -> DataFrame:
    """Additive counts per batch, segment and value."""
    y, flagged = F.col("label") == 1, F.col("score") >= threshold
    return df.groupBy(*by, "segment", "value").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(y).alias("positives"), F.count_if(~y).alias("negatives"),
        F.count_if(y & flagged).alias("true_positive"), F.count_if(~y & flagged).alias("false_positive"),
        F.count_if(y & ~flagged).alias("false_negative"), F.count_if(~y & ~flagged).alias("true_negative"),
        F.coalesce(F.sum(F.when(y, F.col("amount"))), F.lit(0.0)).alias("fraud_amount"),
        F.coalesce(F.sum(F.when(y & flagged, F.col("amount"))), F.lit(0.0)).alias("captured_amount"),
    )


def pooled(counts: DataFrame, batch: str, minimum_positive: int, minimum_negative: int) -> DataFrame:
    """Segment metrics; thin support is pooled with the previous batch and suppressed if still thin.

    Batches are numbered densely; pooling happens whenever a previous batch exists, with
    zero counts if the value did not occur there.
    """
    order = counts.select(batch).distinct().withColumn("seq", F.dense_rank().over(Window.orderBy(batch)))
    now = counts.join(F.broadcast(order), batch)
    before = now.select(F.col("seq") + 1, "segment", "value", *[F.col(c).alias(f"p_{c}") for c in COUNTS]).toDF("seq", "segment", "value", *[f"p_{c}" for c in COUNTS])
    both = now.join(before, ["seq", "segment", "value"], "left")
    thin = (F.col("positives") < minimum_positive) | (F.col("negatives") < minimum_negative)
    pool = thin & (F.col("seq") > 1)
    out = both.withColumn("window_batches", F.when(pool, 2).otherwise(1))
    out = out.withColumns({c: F.col(c) + F.when(F.col("window_batches") == 2, F.coalesce(f"p_{c}", F.lit(0))).otherwise(0) for c in COUNTS})
    enough = (F.col("positives") >= minimum_positive) & (F.col("negatives") >= minimum_negative)
    derived = rates("true_positive", "false_positive", "false_negative", "true_negative")
    shown = {
        "prevalence": F.col("positives") / F.col("rows"), "precision": derived["precision"], "recall": derived["recall"],
        "false_positive": F.col("false_positive"), "false_negative": F.col("false_negative"),
        "captured_rate": F.when(F.col("fraud_amount") > 0, F.col("captured_amount") / F.col("fraud_amount")),
    }
    return out.select(
        batch, "segment", "value", "window_batches", "rows", "positives", "negatives",
        F.when(enough, "reported").otherwise("suppressed").alias("status"), *[F.when(enough, v).alias(k) for k, v in shown.items()],
    )


def actions(batches: DataFrame, stream: str = "stream", batch: str = "batch") -> DataFrame:
    """Adds action and evidence to (stream, batch, drift_severity, performance_severity, primary_critical, label_status).

    Warnings must persist for two batches; primary breaches must occur in two
    successive mature batches; stale labels come before everything else.
    """
    order = Window.partitionBy(stream).orderBy(batch)
    warned = (F.col("drift_severity") == "warning") | (F.col("performance_severity") == "warning")
    mature = F.when(F.col("label_status") == "mature", F.col("primary_critical"))
    earlier = F.coalesce(F.last(mature, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    out = batches.withColumns({"w": warned, "pw": F.coalesce(F.lag(warned).over(order), F.lit(False)), "pp": earlier})
    stale, twice = F.col("label_status") == "stale", F.col("primary_critical") & F.col("pp")
    drifted, failed = F.col("drift_severity") == "critical", F.col("performance_severity") == "critical"
    action = (
        F.when(stale, "investigate").when(twice, "retrain_evaluation_required").when(drifted | failed, "investigate")
        .when(F.col("w") & F.col("pw"), "investigate").otherwise("continue_monitoring")
    )
    evidence = (
        F.when(stale, "Labels are stale beyond the configured maturity delay")
        .when(twice, "Primary performance guardrail breached in two mature batches")
        .when(drifted | failed, F.concat_ws("; ", F.when(drifted, "Critical data or prediction drift"), F.when(failed, "Critical mature-label performance breach")))
        .when(F.col("w") & F.col("pw"), "Warning persisted for two consecutive batches")
        .otherwise("No sustained or critical guardrail breach")
    )
    return out.withColumns({"action": action, "action_evidence": evidence}).drop("w", "pw", "pp")


def recommendations(acted: DataFrame, stream: str = "stream", batch: str = "batch") -> DataFrame:
    """(stream, batch, action, action_evidence, repeated): the policy's output with whether the batch before asked for the same."""
    before = F.lag("action").over(Window.partitionBy(stream).orderBy(batch))
    return acted.select(stream, batch, "action", "action_evidence", F.coalesce(before == F.col("action"), F.lit(False)).alias("repeated"))


def health(drift: Column, performance: Column) -> Column:
    """Worst of two statuses: critical, warning, unavailable, healthy."""
    out = F.lit("healthy")
    for status in ("unavailable", "warning", "critical"):
        out = F.when((drift == status) | (performance == status), status).otherwise(out)
    return out
