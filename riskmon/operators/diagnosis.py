"""Attribution changes, driver ranking and investigation records, for all batches at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_shares(totals: dict, size: int) -> dict:
    """How many rows of each class a sample of `size` takes: in proportion, at least one, what rounding leaves to the largest classes."""
    whole = sum(totals.values())
    share = {k: max(1, int(size * n / whole)) for k, n in totals.items()}
    rest = size - sum(share.values())
    for k in sorted(totals, key=lambda k: -totals[k]):
        add = max(0, min(rest, totals[k] - share[k]))
        share[k] += add
        rest -= add
    return share


def stratified_sample(df: DataFrame, size: int, label: str = "label", key: str = "event_id") -> DataFrame:
    """At most `size` rows in proportion to the classes (each class at least one), the first in the order of a hash of the key.

    Every task keeps the smallest hashes of its own rows before they meet, so no task
    orders a class.
    """
    totals = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(totals.values()) <= size:
        return df
    parts = [df.where(F.col(label).eqNullSafe(F.lit(k))).orderBy(F.xxhash64(key), key).limit(n) for k, n in class_shares(totals, size).items()]
    first, *others = parts
    for part in others:
        first = first.unionByName(part)
    return first


def sample_and_rest(df: DataFrame, size: int, label: str = "label", key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """The sample and all other rows; `key` must be unique. The keys of the sample are no more than `size`."""
    sample = stratified_sample(df, size, label, key)
    taken = sample.select(F.col(key).alias("__taken"))
    return sample, df.join(F.broadcast(taken), F.col(key).eqNullSafe(F.col("__taken")), "left_anti")


def importance_change(reference: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """(feature, mean_abs) of a reference and of groups joined, with change and ranks (ties share the smaller rank)."""
    joined = current.join(F.broadcast(reference.select("feature", F.col("mean_abs").alias("reference_mean_abs"))), "feature")
    change = F.col("mean_abs") - F.col("reference_mean_abs")
    held = joined.select(*by, "feature", "reference_mean_abs", F.col("mean_abs").alias("current_mean_abs"), change.alias("change"), F.abs(change).alias("absolute_change"))
    whole = Window.partitionBy(*by)
    return held.withColumns({
        "reference_rank": F.rank().over(whole.orderBy(F.desc("reference_mean_abs"))),
        "current_rank": F.rank().over(whole.orderBy(F.desc("current_mean_abs"))),
    })


def rank_drivers(alerts: DataFrame, change: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """The k likeliest drivers per group from drift records and attribution changes.

    Score: twice the worst severity, the excess over the warning limit in units
    of the limits' distance (0 to 5), two for a missing feature, and the change
    as a share of the group's largest.
    """
    level = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    width = F.greatest(F.abs(F.col("critical_limit") - F.col("warning_limit")), F.lit(1e-9))
    excess = F.least(F.greatest((F.col("value") - F.col("warning_limit")) / width, F.lit(0.0)), F.lit(5.0))
    per = alerts.where("severity <> 'healthy'").groupBy(*by, "feature").agg(
        F.max(level).alias("worst"), F.max(excess).alias("excess"),
        F.max((F.col("metric") == "schema_missing").cast("int")).alias("absent"),
        F.array_join(F.array_sort(F.collect_set("metric")), ", ").alias("metrics"),
    )
    held = per.join(change.select(*by, "feature", "absolute_change"), [*by, "feature"], "left").withColumn("absolute_change", F.coalesce("absolute_change", F.lit(0.0)))
    largest = F.max("absolute_change").over(Window.partitionBy(*by))
    score = 2 * F.col("worst") + F.col("excess") + 2 * F.col("absent") + F.when(largest > 0, F.col("absolute_change") / largest).otherwise(0.0)
    placed = held.withColumn("driver_score", F.round(score, 9))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("driver_score"), "feature"))
    return placed.withColumn("place", place).where(F.col("place") <= k).select(*by, "place", "feature", "metrics", "driver_score")


def top_segment(metrics: DataFrame, by: list[str], metric: str) -> DataFrame:
    """segment=value with the largest metric among reported rows, ties to the smaller name."""
    name = F.concat_ws("=", "segment", "value")
    held = metrics.where((F.col("status") == "reported") & F.col(metric).isNotNull()).withColumn("name", name)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(metric), "name"))
    return held.withColumn("place", place).where("place = 1").select(*by, F.col("name").alias(f"top_{metric}_segment"))


def classify(batches: DataFrame, alerts: DataFrame, performance: DataFrame, by: list[str]) -> DataFrame:
    """(by..., drift_severity, performance_severity, classification) of every batch that drifts or performs worse.

    `batches` has drift_severity, performance_severity and prediction_severity, `alerts` the drift records
    (metric, severity), `performance` the performance records (metric, status). All classes that apply are
    listed in this order: data_quality_failure, covariate_drift, prediction_drift, prevalence_shift,
    calibration_drift, confirmed_performance_degradation; monitoring_signal if none does.
    """
    gap = F.col("metric") == "missingness_shift"
    drifted = alerts.where("severity <> 'healthy'").groupBy(*by).agg(F.bool_or(gap).alias("gaps"), F.bool_or(~gap).alias("moved"))
    kinds = {
        "prevalence_shift": ("prevalence_shift",), "calibration_drift": ("brier_score", "expected_calibration_error"),
        "confirmed_performance_degradation": ("pr_auc", "precision", "recall", "false_positive_rate", "false_negative_rate"),
    }
    failed = performance.where("status in ('warning', 'critical')").groupBy(*by).agg(*[F.bool_or(F.col("metric").isin(*m)).alias(k) for k, m in kinds.items()])
    noisy = ~((F.col("drift_severity") == "healthy") & F.col("performance_severity").isin("healthy", "unavailable"))
    joined = batches.where(noisy).join(drifted, by, "left").join(failed, by, "left")
    listed = F.concat_ws(
        ", ", F.when(F.col("gaps"), "data_quality_failure"), F.when(F.col("moved"), "covariate_drift"),
        F.when(F.col("prediction_severity") != "healthy", "prediction_drift"), *[F.when(F.col(k), k) for k in kinds],
    )
    named = F.when(F.length(listed) > 0, listed).otherwise("monitoring_signal")
    return joined.select(*by, "drift_severity", "performance_severity", named.alias("classification"))


def investigation_records(batches: DataFrame, alerts: DataFrame, performance: DataFrame, change: DataFrame, segments: DataFrame, by: list[str]) -> DataFrame:
    """One record for every batch that drifts or performs worse: classes, drivers as JSON, the worst segments, and what to do.

    `batches` holds the acted rows (label_status, action, action_evidence and the three
    severities), `alerts` the drift records, `performance` the performance records,
    `change` the attribution changes, `segments` the segment metrics of mature batches.
    """
    found = classify(batches, alerts, performance, by).drop("drift_severity", "performance_severity")
    listed = F.array_sort(F.collect_list(F.struct("place", "feature", "metrics", "driver_score"))).alias("d")
    out = found.join(rank_drivers(alerts, change, by).groupBy(*by).agg(listed), by, "left")
    for metric in ("false_negative", "false_positive", "prevalence"):
        out = out.join(top_segment(segments, by, metric), by, "left")
    kept = batches.select(*by, *[c for c in ("stream", "label_status", "action", "action_evidence") if c not in by])
    return out.join(kept, by).select(
        *by, *[c for c in ("stream", "label_status", "action") if c not in by], "classification", F.get("d.feature", F.lit(0)).alias("likely_driver"), F.coalesce(F.to_json("d"), F.lit("[]")).alias("driver_evidence"),
        "top_false_negative_segment", "top_false_positive_segment", "top_prevalence_segment", F.col("action_evidence").alias("recommended_action"),
    )


EVIDENCE = "array<struct<place:int,feature:string,metrics:string,driver_score:double>>"


def evidence_rows(found: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """The first k drivers of every investigation, read back from its JSON; malformed evidence gives no rows."""
    each = F.explode(F.from_json("driver_evidence", EVIDENCE)).alias("r")
    return found.select(*by, each).select(*by, "r.*").where(F.col("place") <= k)


def investigations(batches: DataFrame, drivers: DataFrame, segment: DataFrame, by: list[str]) -> DataFrame:
    """A record for every batch with drift or a performance finding; driver evidence is JSON, strongest first."""
    noisy = ~((F.col("drift_severity") == "healthy") & F.col("performance_severity").isin("healthy", "unavailable"))
    listed = drivers.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "feature", "metrics", "driver_score"))).alias("d"))
    kinds = F.concat_ws(
        ", ", F.when(F.col("drift_severity") != "healthy", "data_drift"),
        F.when(F.col("performance_severity").isin("warning", "critical"), "performance_change"),
    )
    joined = batches.where(noisy).join(listed, by, "left").join(segment, by, "left")
    return joined.select(
        *by, kinds.alias("classification"), F.get("d.feature", F.lit(0)).alias("leading_driver"),
        F.coalesce(F.to_json("d"), F.lit("[]")).alias("driver_evidence"), *[c for c in segment.columns if c not in by],
    )
