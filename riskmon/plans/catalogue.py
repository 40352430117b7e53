"""Registered queries over the driver's tables, with the same results as DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskmon import config
from riskmon.analogs import daily, transactions
from riskmon.operators import causal, challenger, diagnosis, drift, explain, features, lifecycle, metrics, monitor, monitoring, performance, resample, temporal
from riskmon.plans import replay
from riskmon.sources import export, ingest, scratch

DAY = 86400
NUMERIC, CATEGORIES = ["amount", "score"], ["product", "channel", "region", "user_id"]
MODEL_CATEGORIES = ["product", "region", "user_id"]  # the label follows from the channel
THRESHOLD, ITERATIONS = 0.8, 500


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c).cast("double"), places).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def labelled(spark: SparkSession, d: str) -> DataFrame:
    rows = transactions(spark, d)
    return temporal.assign_partitions(rows, temporal.time_bounds(rows), batch_seconds=DAY)


def acceptance(df: DataFrame) -> DataFrame:
    return df.where("dataset_period = 'acceptance'")


def batches(df: DataFrame) -> DataFrame:
    return df.where("production_batch is not null").withColumnRenamed("production_batch", "batch")


def velocity_by_period(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: past-only velocity features, summed up per elapsed-time period."""
    rows = causal.add_causal(labelled(spark, d), "user", ["user_id"])
    return rounded(rows.groupBy("dataset_period").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("label").alias("prevalence"), F.avg("user_prior_count").alias("mean_prior_count"),
        F.avg(F.col("user_hours_since_previous").cast("double")).alias("mean_hours"),
    ), 4)


def contract_validation(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    return ingest.contract_report(docs, "documents", "doc_id").unionByName(ingest.contract_report(labels, "labels", "doc_id", "toxic"))


def one_to_one_join(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    labels = labels.withColumns({c: F.col(c).cast("double") for c in ("quality", "toxic")})
    return ingest.join_one_to_one(docs.select("doc_id", "source", "n_chars"), labels, "doc_id")


def table_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ingest.profile(one_to_one_join(spark, d)))


def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    """Rows, time range, coverage of the region and prevalence of the table and of each of its periods."""
    rows = labelled(spark, d).withColumn(ingest.AVAILABLE, F.col("region").isNotNull())
    return rounded(ingest.summary(rows, "t", "label", "dataset_period"))


def missing_families(spark: SparkSession, d: str) -> DataFrame:
    """How many rows have so many nulls among identity, vendor and all transaction columns, the engineered ones included."""
    rows = labelled(spark, d).withColumns({
        "id_12": F.col("region"), "DeviceType": F.when(F.col("user_id") % 5 != 0, F.col("channel")), "V1": F.when(F.col("event_id") % 7 != 0, F.col("amount")),
    }).drop("region", "channel")
    counted = features.add_missing_counts(features.add_stateless(causal.add_causal(rows, "user", ["user_id"])))
    return counted.groupBy(*[F.col(c).cast("int").alias(c) for c in features.COUNTS]).agg(F.count(F.lit(1)).alias("rows"))


def temporal_bounds(spark: SparkSession, d: str) -> DataFrame:
    b = temporal.time_bounds(transactions(spark, d))
    return spark.range(1).select(
        F.lit(b.least).cast("long").alias("first_t"), F.lit(b.most).cast("long").alias("last_t"),
        *[F.lit(b.cutoff(i)).alias(f"{p}_end") for i, p in enumerate(temporal.PERIODS[:3])],
    )


def temporal_periods(spark: SparkSession, d: str) -> DataFrame:
    return rounded(labelled(spark, d).groupBy("dataset_period").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("label").alias("prevalence"), F.min("t").alias("first_t"), F.max("t").alias("last_t")
    ))


def counted(column: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return labelled(spark, d).where(F.col(column).isNotNull()).groupBy(F.col(column).cast("int").alias(column)).agg(
            F.count(F.lit(1)).alias("rows"), F.min("t").alias("first_t"), F.max("t").alias("last_t")
        )

    return query


def shadow_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = transactions(spark, d)
    b = temporal.time_bounds(rows)
    late = rows.where(F.col("t") >= b.least + (b.span * 2) // 3)
    return temporal.assign_shadow_batches(late, temporal.time_bounds(late).least, DAY)


def shadow_batches(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shadow_rows(spark, d).groupBy("shadow_batch").agg(F.count(F.lit(1)).alias("rows"), F.avg("score").alias("score_mean")))


def union_batches(spark: SparkSession, d: str) -> DataFrame:
    made = batches(labelled(spark, d)).select(F.format_string("production_%03d", "batch").alias("batch_id"), "score", "label")
    late = shadow_rows(spark, d).select(F.format_string("shadow_%03d", "shadow_batch").alias("batch_id"), "score")
    return rounded(made.unionByName(late, allowMissingColumns=True).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("label").cast("double")).alias("positives"), F.avg("score").alias("score_mean")
    ))


def causal_count_recency(spark: SparkSession, d: str) -> DataFrame:
    rows = causal.add_causal(transactions(spark, d), "user", ["user_id"])
    return rounded(rows.select("event_id", "user_prior_count", "user_hours_since_previous"), 3)


def causal_amount_mean_ratio(spark: SparkSession, d: str) -> DataFrame:
    rows = transactions(spark, d).withColumn("amount", F.when(F.col("event_id") % 7 != 0, F.col("amount")))
    rows = causal.add_causal(rows, "user", ["user_id"])
    return rounded(rows.select("event_id", "user_prior_amount_mean", "user_amount_to_prior_mean"), 2)


def causal_two_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = causal.add_causal(transactions(spark, d), "pair", ["product", "region"])
    return rounded(rows.select("event_id", "pair_prior_count", "pair_hours_since_previous"), 3)


def causal_daily_ties(spark: SparkSession, d: str) -> DataFrame:
    rows = causal.add_causal(daily(spark, d), "user", ["user_id"])
    return rounded(rows.select("event_id", "user_prior_count", "user_hours_since_previous"), 2)


def frozen_state_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d)
    out = causal.add_frozen(batches(rows), rows.where("production_batch is null"), "user", ["user_id"])
    return rounded(out.select("event_id", "user_prior_count", "user_hours_since_previous"), 3)


def stateless_features(spark: SparkSession, d: str) -> DataFrame:
    rows = features.add_stateless(transactions(spark, d))
    return rounded(rows.select("event_id", "amount_log1p", "amount_fraction", "elapsed_day", "hour_sin", "hour_cos", "weekday_sin", "weekday_cos"), 2)


def missing_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = features.add_stateless(transactions(spark, d), families={"identity": ["region"], "vendor": [], "all": ["region", "product", "amount"]})
    names = [f"missing_count_{n}" for n in ("identity", "vendor", "all")]
    return rows.groupBy(*[F.col(n).cast("int").alias(n) for n in names]).agg(F.count(F.lit(1)).alias("rows"))


def category_levels(spark: SparkSession, d: str) -> DataFrame:
    return features.category_levels(labelled(spark, d).where("dataset_period = 'development'"), ["product", "channel", "region"])


def frequency_encoding(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d)
    fitted = features.Preprocessor(["user_id", "channel"], ["amount"], cardinality_limit=10).fit(rows.where("dataset_period = 'development'"))
    out = fitted.transform(batches(rows).select("event_id", "user_id", "channel", "amount"))
    return rounded(out.select("event_id", "user_id__frequency", "channel"), 5)


def drop_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).withColumns({"constant": F.lit(1), "sparse": F.when(F.col("event_id") % 100 == 0, 1)})
    return rounded(features.Preprocessor(["product", "region"], ["amount", "constant", "sparse"]).profile(rows))


def unknown_mapping(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d)
    fitted = features.Preprocessor(["product"], []).fit(rows.where("dataset_period = 'development' and product <> 'P3'"))
    return fitted.transform(batches(rows).select("batch", "product")).groupBy("batch", "product").agg(F.count(F.lit(1)).alias("rows"))


def review_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.review_thresholds(labelled(spark, d).where("dataset_period = 'calibration'"), [0.005, 0.01, 0.02, 0.05]))


def confusion_by_batch(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.confusion(batches(labelled(spark, d)), ["batch"], F.lit(THRESHOLD)))


def average_precision_by_batch(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.ranking(batches(labelled(spark, d)), ["batch"]).select("batch", "positives", "pr_auc"))


def roc_auc_by_batch(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.ranking(batches(labelled(spark, d)), ["batch"]).select("batch", "negatives", "roc_auc"))


def brier_logloss(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.score_summary(batches(labelled(spark, d)), ["batch"]).select("batch", "brier", "log_loss"))


def score_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.score_summary(batches(labelled(spark, d)), ["batch"]).drop("brier", "log_loss"))


def ece_by_batch(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.calibration_error(batches(labelled(spark, d)), ["batch"]))


def reliability_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.reliability(acceptance(labelled(spark, d)), []))


def review_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d)
    asked = metrics.review_thresholds(rows.where("dataset_period = 'calibration'"), [0.01, 0.02, 0.05])
    return rounded(metrics.review_budget(acceptance(rows), asked), 4)


def captured_amount(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.captured_amount(batches(labelled(spark, d)), ["batch"], F.lit(THRESHOLD)), 4)


def numeric_pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = labelled(spark, d)
    return drift.numeric_long(batches(rows), ["batch"], NUMERIC), drift.numeric_long(acceptance(rows), [], NUMERIC)


def category_pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = labelled(spark, d)
    return drift.category_long(batches(rows), ["batch"], CATEGORIES), drift.category_long(acceptance(rows), [], CATEGORIES)


def divergence_values(spark: SparkSession, d: str) -> DataFrame:
    now, ref = numeric_pair(spark, d)
    return drift.numeric_divergences(now, ["batch"], ref)


def psi_by_batch(spark: SparkSession, d: str) -> DataFrame:
    return rounded(divergence_values(spark, d).drop("js"))


def score_js(spark: SparkSession, d: str) -> DataFrame:
    return rounded(divergence_values(spark, d).where("feature = 'score'").select("batch", "js"))


def categorical_js(spark: SparkSession, d: str) -> DataFrame:
    now, ref = category_pair(spark, d)
    return rounded(drift.category_distance(now, ["batch"], ref))


def unseen_rate(spark: SparkSession, d: str) -> DataFrame:
    now, ref = category_pair(spark, d)
    return rounded(drift.unseen_rate(now, ["batch"], ref))


def missingness_shift(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d)
    return rounded(drift.missingness_shift(batches(rows), ["batch"], acceptance(rows), ["region", "amount"]))


def wasserstein_by_batch(spark: SparkSession, d: str) -> DataFrame:
    now, ref = numeric_pair(spark, d)
    return rounded(drift.wasserstein(now, ["batch"], ref))


def drift_severity(spark: SparkSession, d: str) -> DataFrame:
    level = drift.severity(F.col("psi"), F.lit(0.01), F.lit(0.05))
    return psi_by_batch(spark, d).withColumn("severity", level).groupBy("batch").agg(
        drift.worst(F.col("severity")).alias("severity"), F.count_if(F.col("severity") != "healthy").alias("alerts")
    )


def resamples(spark: SparkSession, d: str) -> DataFrame:
    rows = acceptance(labelled(spark, d)).withColumn("day", F.floor(F.col("t") / DAY))
    draws = drift.hashed_draws(rows.select("day"), ITERATIONS)
    return drift.bootstrap_statistics(drift.numeric_long(rows, ["day"], NUMERIC), draws)


def bootstrap_drift_limits(spark: SparkSession, d: str) -> DataFrame:
    return rounded(drift.control_limits(resamples(spark, d), ["feature"], "psi"))


def alert_count_limits(spark: SparkSession, d: str) -> DataFrame:
    samples = rounded(resamples(spark, d), 9)
    return drift.alert_limits(samples, rounded(drift.control_limits(samples, ["feature"], "psi"), 9), "psi")


def drift_records(spark: SparkSession, d: str) -> DataFrame:
    values, limits = rounded(divergence_values(spark, d), 9), rounded(drift.control_limits(resamples(spark, d), ["feature"], "psi"), 9)
    return drift.compare(values, limits, ["batch"], "psi", [*NUMERIC, "absent"])


def drift_compare(spark: SparkSession, d: str) -> DataFrame:
    return rounded(drift_records(spark, d))


def drift_ordered(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("batch").orderBy(rank, F.desc("value"), "feature"))
    return drift_compare(spark, d).withColumn("place", place).select("batch", "place", "feature", "severity", "value")


def performance_limits(spark: SparkSession, d: str) -> DataFrame:
    """Limits of recall and average precision over day-block resamples of the acceptance period."""
    rows = acceptance(labelled(spark, d)).withColumn("day", F.floor(F.col("t") / DAY))
    draws = drift.hashed_draws(rows.select("day"), ITERATIONS)
    counts = rows.groupBy("day", "score").agg(F.sum(F.col("label").cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    ranked = resample.ranking(counts, resample.Draws(draws))
    bad, hit = F.col("label") == 1, (F.col("label") == 1) & (F.col("score") >= THRESHOLD)
    daily_sums = rows.groupBy("day").agg(F.count_if(bad).alias("bad"), F.count_if(hit).alias("hit"))
    share = F.try_divide(F.sum(F.col("hit") * F.col("mult")), F.sum(F.col("bad") * F.col("mult")))
    recalls = daily_sums.join(F.broadcast(draws), "day").groupBy("iter").agg(share.alias("recall"))
    long = ranked.join(recalls, "iter").unpivot(["iter"], ["pr_auc", "recall"], "metric", "v")
    return rounded(drift.control_limits(long, ["metric"], "v", 0.05, 0.01))


def label_maturity(spark: SparkSession, d: str) -> DataFrame:
    counts = batches(labelled(spark, d)).groupBy("batch").agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("label_status", monitoring.label_status(F.col("batch"), 2, F.max("batch").over(Window.partitionBy())))


def segment_topk(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.top_values(acceptance(labelled(spark, d)), ["region", "user_id"], 5)


def segment_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d)
    top = monitoring.top_values(acceptance(rows), ["region"], 3)
    long = monitoring.segments(batches(rows), top, ["region"], ["product"])
    return monitoring.pooled(monitoring.segment_counts(long, ["batch"], F.lit(THRESHOLD)), "batch", 12, 30)


def segment_metrics_pooled(spark: SparkSession, d: str) -> DataFrame:
    return rounded(segment_rows(spark, d).withColumns({c: F.col(c).cast("double") for c in ("false_positive", "false_negative")}))


def top_segments(spark: SparkSession, d: str) -> DataFrame:
    return diagnosis.top_segment(segment_metrics_pooled(spark, d), ["batch"], "false_negative")


def batch_table(spark: SparkSession, d: str) -> DataFrame:
    """Per batch: mean score shift, recall, and the statuses that follow from fixed limits."""
    rows = labelled(spark, d)
    mean = acceptance(rows).agg(F.avg("score")).first()[0]
    base = batches(rows).groupBy("batch").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.abs(F.avg("score") - mean), 9).alias("shift"),
        F.round(F.avg(F.when(F.col("label") == 1, (F.col("score") >= THRESHOLD).cast("double"))), 9).alias("recall"),
    )
    status = monitoring.label_status(F.col("batch"), 2, F.max("batch").over(Window.partitionBy()))
    held = base.withColumn("label_status", status)
    recall = F.when(F.col("label_status") == "mature", F.col("recall"))
    return held.withColumns({
        "stream": F.lit("production"), "drift_severity": drift.severity(F.col("shift"), F.lit(0.004), F.lit(0.02)),
        "performance_severity": monitoring.performance_status(recall, F.lit(0.22), F.lit(0.19), False),
        "primary_critical": F.coalesce(recall < 0.2, F.lit(False)),
    })


def batch_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(batch_table(spark, d).drop("stream"))


def action_policy(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.actions(batch_table(spark, d)).select("batch", "action", "action_evidence")


def health_timeline(spark: SparkSession, d: str) -> DataFrame:
    return batch_table(spark, d).select("batch", monitoring.health(F.col("drift_severity"), F.col("performance_severity")).alias("health"))


def latest_batch(spark: SparkSession, d: str) -> DataFrame:
    return rounded(batch_table(spark, d).agg(F.max_by(F.struct("batch", "rows", "shift", "label_status"), "batch").alias("x")).select("x.*"))


def metric_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(batch_table(spark, d).select("batch", "shift", "recall").unpivot(["batch"], ["shift", "recall"], "metric", "value"))


def public_projection(spark: SparkSession, d: str) -> DataFrame:
    return rounded(export.public_table(batch_table(spark, d), "batch_status", ["batch", "rows", "recall", "drift_severity"]))


def importance(spark: SparkSession, d: str) -> DataFrame:
    """Mean absolute deviation of each numeric feature from its acceptance mean, per batch; `attribution_change` has Shapley values."""
    now, ref = numeric_pair(spark, d)
    centre = ref.groupBy("feature").agg(F.avg("value").alias("m"))
    held = now.join(F.broadcast(centre), "feature").groupBy("batch", "feature").agg(F.avg(F.abs(F.col("value") - F.col("m"))).alias("mean_abs"))
    base = ref.join(F.broadcast(centre), "feature").groupBy("feature").agg(F.avg(F.abs(F.col("value") - F.col("m"))).alias("mean_abs"))
    return diagnosis.importance_change(base, held, ["batch"])


def shap_rank_change(spark: SparkSession, d: str) -> DataFrame:
    return rounded(importance(spark, d))


def ranked_drivers(spark: SparkSession, d: str) -> DataFrame:
    return diagnosis.rank_drivers(drift_records(spark, d), rounded(importance(spark, d), 9), ["batch"])


def driver_ranking(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranked_drivers(spark, d), 4)


def investigations(spark: SparkSession, d: str) -> DataFrame:
    found = diagnosis.investigations(batch_table(spark, d), ranked_drivers(spark, d), top_segments(spark, d), ["batch"])
    return found.drop("driver_evidence")


def prediction_drift(spark: SparkSession, d: str) -> DataFrame:
    """Score movement per batch: divergence of the scores against limits from the resamples."""
    limits = rounded(drift.control_limits(resamples(spark, d).where("feature = 'score'"), ["feature"], "js"), 9)
    held = rounded(divergence_values(spark, d), 9).where("feature = 'score'").join(F.broadcast(limits), "feature")
    level = drift.severity(F.col("js"), F.col("warning_limit"), F.col("critical_limit"))
    return held.select("batch", "js", "warning_limit", "critical_limit", level.alias("prediction_severity"))


def score_js_limits(spark: SparkSession, d: str) -> DataFrame:
    return rounded(prediction_drift(spark, d))


def global_severity(spark: SparkSession, d: str) -> DataFrame:
    samples = rounded(resamples(spark, d), 9)
    allowed = drift.alert_limits(samples, rounded(drift.control_limits(samples, ["feature"], "psi"), 9), "psi")
    return drift.global_severity(drift_records(spark, d), allowed, prediction_drift(spark, d).select("batch", "prediction_severity"), ["batch"])


def label_freshness(spark: SparkSession, d: str) -> DataFrame:
    """How many batches have mature and pending labels, the latest mature one, and the action of the latest batch."""
    acted = monitoring.actions(batch_table(spark, d))
    latest = F.max_by(F.when(F.col("label_status") == "stale", "investigate").otherwise(F.col("action")), "batch")
    return acted.agg(
        F.count_if(F.col("label_status") == "mature").alias("mature"), F.count_if(F.col("label_status") == "pending").alias("pending"),
        F.max(F.when(F.col("label_status") == "mature", F.col("batch"))).alias("latest_mature"), latest.alias("current_action"),
    )


def last_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The five latest batches with the evidence of their actions."""
    return action_policy(spark, d).orderBy(F.desc("batch")).limit(5)


def recommendation_history(spark: SparkSession, d: str) -> DataFrame:
    """The latest eight recommendations, each with whether the batch before it asked for the same."""
    rows = monitoring.recommendations(monitoring.actions(batch_table(spark, d)))
    return rows.orderBy(F.desc("batch")).limit(8)


def confusion_pivot(spark: SparkSession, d: str) -> DataFrame:
    """The confusion counts of the latest mature batch as a table of two by two."""
    mature = batch_table(spark, d).where("label_status = 'mature'").agg(F.max("batch").alias("batch"))
    counts = metrics.confusion(batches(labelled(spark, d)), ["batch"], F.lit(THRESHOLD)).join(F.broadcast(mature), "batch")
    cells = F.explode(F.array(*[
        F.struct(F.lit(actual).alias("actual"), F.col(missed).alias("predicted_0"), F.col(hit).alias("predicted_1"))
        for actual, missed, hit in ((0, "true_negative", "false_positive"), (1, "false_negative", "true_positive"))
    ]))
    return counts.select("batch", cells.alias("r")).select("batch", "r.*")


def budget_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """The review budget in long form."""
    shown = ["precision", "recall", "realised_rate", "captured_rate"]
    return rounded(review_budget(spark, d).unpivot(["review_rate"], shown, "metric", "value"), 4)


def calibration_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """Calibration error and Brier score of every batch in long form."""
    rows = batches(labelled(spark, d))
    both = metrics.calibration_error(rows, ["batch"]).join(metrics.score_summary(rows, ["batch"]).select("batch", "brier"), "batch")
    return rounded(both.unpivot(["batch"], ["ece", "brier"], "metric", "value"))


def score_movement(spark: SparkSession, d: str) -> DataFrame:
    """Divergence and mean shift of the scores of every batch in long form."""
    both = rounded(divergence_values(spark, d), 9).where("feature = 'score'").select("batch", "js").join(batch_table(spark, d).select("batch", "shift"), "batch")
    return rounded(both.unpivot(["batch"], ["js", "shift"], "metric", "value"))


def challenger_windows(spark: SparkSession, d: str) -> DataFrame:
    return challenger.windows(batches(labelled(spark, d)), delay=2)


def feature_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Three drift metrics of every feature and batch in long form."""
    rows, texts = labelled(spark, d), ["product", "channel", "region"]
    now, ref = numeric_pair(spark, d)
    by = ["batch", "feature"]
    numbers = drift.numeric_divergences(now, ["batch"], ref).select(*by, "psi").join(drift.wasserstein(now, ["batch"], ref), by)
    seen, known = drift.category_long(batches(rows), ["batch"], texts), drift.category_long(acceptance(rows), [], texts)
    names = drift.category_distance(seen, ["batch"], known).join(drift.unseen_rate(seen, ["batch"], known), by)
    gaps = drift.missingness_shift(batches(rows), ["batch"], acceptance(rows), [*NUMERIC, *texts])
    parts = [(numbers, ["psi", "wasserstein"]), (names, ["js", "unseen_rate"]), (gaps, ["missingness_shift"])]
    first, *rest = (part.unpivot(by, columns, "metric", "value") for part, columns in parts)
    for part in rest:
        first = first.unionByName(part)
    return rounded(first)


MONITORED = (["amount"], ["product", "channel", "region"])


def fitted_monitor(spark: SparkSession, d: str) -> tuple[monitor.DriftMonitor, DataFrame]:
    """The drift monitor of the acceptance period, and the rows of all batches; tables that several plans read are stored."""
    rows = scratch.stored(labelled(spark, d).where("dataset_period = 'acceptance' or production_batch is not null"), "monitored")
    reference = acceptance(rows).withColumn("day", F.floor(F.col("t") / DAY))
    draws = drift.hashed_draws(reference.select("day"), ITERATIONS)
    return monitor.fit(reference, *MONITORED, draws, keep=lambda name, df: scratch.stored(df, name)), batches(rows)


def monitor_limits(spark: SparkSession, d: str) -> DataFrame:
    """Warning and critical limits of every metric of every feature and of the scores."""
    fitted, _ = fitted_monitor(spark, d)
    scores = fitted.prediction_limits.select(F.lit("score").alias("feature"), F.lit("prediction").alias("kind"), "metric", "warning_limit", "critical_limit")
    return rounded(fitted.limits.unionByName(scores))


def monitor_records(spark: SparkSession, d: str) -> DataFrame:
    """Three records of every monitored feature and batch."""
    fitted, now = fitted_monitor(spark, d)
    return rounded(fitted.compare(now, ["batch"]))


def drift_chart(spark: SparkSession, d: str) -> DataFrame:
    """The twelve gravest drift records of every batch, each with its value and both limits in long form."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("batch").orderBy(rank, F.desc_nulls_last("value"), "feature", "metric"))
    first = monitor_records(spark, d).withColumn("place", place).where("place <= 12")
    return first.unpivot(["batch", "place", "feature", "metric"], ["value", "warning_limit", "critical_limit"], "series", "metric_value")


def monitor_prediction(spark: SparkSession, d: str) -> DataFrame:
    """Divergence and mean shift of the scores of every batch against resampled limits."""
    fitted, now = fitted_monitor(spark, d)
    return rounded(fitted.prediction(now, ["batch"]))


def monitor_summary(spark: SparkSession, d: str) -> DataFrame:
    """How many features alert in every batch, how many may, and what follows."""
    fitted, now = fitted_monitor(spark, d)
    return fitted.summary(fitted.compare(now, ["batch"]), fitted.prediction(now, ["batch"]), ["batch"])


def monitored_batches(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Acted batch records, drift and performance records and segments, as the replay makes them, of the table's own scores."""
    fitted, now = fitted_monitor(spark, d)
    now, rows = now.withColumn("stream", F.lit("production")), fitted.reference
    records, prediction = scratch.stored(fitted.compare(now, replay.BY), "drift"), scratch.stored(fitted.prediction(now, replay.BY), "prediction")
    found, shown = replay.judged(now, rows, THRESHOLD, config.Settings(iterations=ITERATIONS))
    found = scratch.stored(found, "performance")
    base = replay.base_records(now, THRESHOLD, 2)
    acted = scratch.stored(replay.batch_records(base, fitted.summary(records, prediction, replay.BY), prediction, found, shown), "batches")
    top = monitoring.top_values(rows, ["region"], 3)
    segments = replay.mature_segments(now, base, top, ["region"], ["product"], THRESHOLD, 12, 30).withColumn("stream", F.lit("production"))
    return {"batches": acted, "records": records, "performance": found, "segments": segments, "rows": now, "reference": rows}


def batch_records(spark: SparkSession, d: str) -> DataFrame:
    """One row per batch with all that the monitoring knows of it."""
    return rounded(monitored_batches(spark, d)["batches"], 4)


def mature_segment_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Segment metrics of mature batches, pooled with the mature batch before."""
    found = monitored_batches(spark, d)["segments"]
    return rounded(found.withColumns({c: F.col(c).cast("double") for c in ("false_positive", "false_negative")}))


def investigation_records(spark: SparkSession, d: str) -> DataFrame:
    """Classes, likely driver, worst segments and recommended action of every batch that needs a look."""
    held = monitored_batches(spark, d)
    numbers = [c for c in MONITORED[0]]
    now, ref = drift.numeric_long(held["rows"], replay.BY, numbers), drift.numeric_long(held["reference"], [], numbers)
    centre = ref.groupBy("feature").agg(F.avg("value").alias("m"))

    def spread(long: DataFrame, by: list[str]) -> DataFrame:
        return long.join(F.broadcast(centre), "feature").groupBy(*by, "feature").agg(F.avg(F.abs(F.col("value") - F.col("m"))).alias("mean_abs"))

    change = rounded(diagnosis.importance_change(spread(ref, []), spread(now, replay.BY), replay.BY), 9)
    found = diagnosis.investigation_records(held["batches"], held["records"], held["performance"], change, held["segments"], replay.BY)
    return found.drop("driver_evidence")


def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    return performance.metric_row(batches(labelled(spark, d)), ["batch"], THRESHOLD, "amount")


def full_metric_row(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metric_rows(spark, d), 4)


def full_limits(spark: SparkSession, d: str) -> DataFrame:
    rows = acceptance(labelled(spark, d)).withColumn("day", F.floor(F.col("t") / DAY))
    return rounded(performance.limits(performance.resampled(rows, drift.hashed_draws(rows.select("day"), ITERATIONS), THRESHOLD)), 9)


def full_performance_limits(spark: SparkSession, d: str) -> DataFrame:
    return rounded(full_limits(spark, d))


def judged_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d)
    status = monitoring.label_status(F.col("batch"), 2, F.max("batch").over(Window.partitionBy()))
    reference = performance.metric_row(acceptance(rows).withColumn("period", F.lit(0)), ["period"], THRESHOLD)
    held = metric_rows(spark, d).withColumn("label_status", status)
    return performance.records(held, reference, full_limits(spark, d), ["batch"], F.col("label_status") == "mature")


def overview(spark: SparkSession, d: str) -> DataFrame:
    """One row: freshness of labels, current action, review rate of the latest batch and metrics of the latest mature one."""
    acted = monitoring.actions(batch_table(spark, d)).select("batch", "label_status", "action")
    held, mature = metric_rows(spark, d).join(acted, "batch"), F.when(F.col("label_status") == "mature", F.col("batch"))
    shown = F.struct(F.col("batch").alias("mature_batch"), "prevalence", "pr_auc", "recall", "expected_calibration_error")
    sums = held.agg(
        F.count_if(F.col("label_status") == "stale").alias("stale"), F.count_if(F.col("label_status") == "pending").alias("pending"),
        F.max_by(F.struct(F.col("batch").alias("latest_batch"), "action", "review_rate"), "batch").alias("now"), F.max_by(shown, mature).alias("then"),
    )
    fresh = F.when(F.col("stale") > 0, "Stale").when(F.col("pending") > 0, F.concat(F.col("pending").cast("string"), F.lit(" pending"))).otherwise("Current")
    action = F.when(F.col("stale") > 0, "investigate").otherwise(F.col("now.action"))
    return rounded(sums.select(fresh.alias("freshness"), action.alias("current_action"), "now.latest_batch", "now.review_rate", "then.*"))


def reported_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments with enough rows of both classes in every investigated batch, those with the most missed positives first."""
    noisy = ~((F.col("drift_severity") == "healthy") & F.col("performance_severity").isin("healthy", "unavailable"))
    held = segment_metrics_pooled(spark, d).where("status = 'reported'").join(F.broadcast(batch_table(spark, d).where(noisy).select("batch")), "batch")
    place = F.row_number().over(Window.partitionBy("batch").orderBy(F.desc("false_negative"), "segment", "value"))
    return held.select("batch", place.alias("place"), "segment", "value", "rows", "prevalence", "precision", "recall", "false_positive", "false_negative", "captured_rate")


def performance_records(spark: SparkSession, d: str) -> DataFrame:
    return rounded(judged_batches(spark, d))


def performance_summary(spark: SparkSession, d: str) -> DataFrame:
    return performance.summary(judged_batches(spark, d), ["batch"])


def missingness_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Drift records of missing values, with limits from the day-block resamples."""
    rows, columns = labelled(spark, d), ["region", "amount"]
    ref = acceptance(rows).withColumn("day", F.floor(F.col("t") / DAY))
    samples = drift.bootstrap_missingness(ref, drift.hashed_draws(ref.select("day"), ITERATIONS), columns)
    limits = rounded(drift.control_limits(samples, ["feature"], "missingness_shift"), 9)
    now = rounded(drift.missingness_shift(batches(rows), ["batch"], acceptance(rows), columns), 9)
    return drift.compare(now, limits, ["batch"], "missingness_shift", columns)


def missingness_records(spark: SparkSession, d: str) -> DataFrame:
    return rounded(missingness_alerts(spark, d))


def investigation_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every batch that drifts or performs worse, with all classes of finding that apply to it."""
    judged = judged_batches(spark, d)
    drifted = global_severity(spark, d).select("batch", F.col("severity").alias("drift_severity"))
    moved = prediction_drift(spark, d).select("batch", "prediction_severity")
    held = drifted.join(moved, "batch", "left").join(performance.summary(judged, ["batch"]), "batch")
    return diagnosis.classify(held, drift_records(spark, d).unionByName(missingness_alerts(spark, d)), judged, ["batch"])


def investigation_drilldown(spark: SparkSession, d: str) -> DataFrame:
    """The drivers of every investigation, read back from its JSON evidence."""
    found = diagnosis.investigations(batch_table(spark, d), ranked_drivers(spark, d), top_segments(spark, d), ["batch"])
    return rounded(diagnosis.evidence_rows(found, ["batch"]), 4)


def engineered(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.engineer(labelled(spark, d), MODEL_CATEGORIES)


def model_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metric rows of all batches under a champion that is fitted on the development and calibrated on the calibration period."""
    made = engineered(spark, d)
    champion = lifecycle.train_champion(made, MODEL_CATEGORIES)
    return rounded(performance.metric_row(champion.score(batches(made)), ["batch"], champion.threshold, "amount"))


def attribution_change(spark: SparkSession, d: str) -> DataFrame:
    made = engineered(spark, d)
    champion = lifecycle.train_champion(made, MODEL_CATEGORIES)
    now = explain.summary(lifecycle.attributions(champion, batches(made), ["batch", "label"]), ["batch"])
    ref = explain.summary(lifecycle.attributions(champion, acceptance(made), ["label"]), [])
    return diagnosis.importance_change(ref, now, ["batch"])


def attribution_rank_change(spark: SparkSession, d: str) -> DataFrame:
    """Change of each feature's mean absolute Shapley value from the acceptance period, with ranks, for every batch."""
    return rounded(attribution_change(spark, d))


def attribution_drivers(spark: SparkSession, d: str) -> DataFrame:
    """Drift alerts of every batch ranked with the change of the Shapley values."""
    return rounded(diagnosis.rank_drivers(drift_records(spark, d), attribution_change(spark, d), ["batch"]))


def contest(spark: SparkSession, d: str) -> tuple[DataFrame, lifecycle.Bundle, list[str], list[str]]:
    """What a challenger's trial is given: the rows with all features, stored once, the champion, and the columns of inputs and segments."""
    rows = labelled(spark, d).select("t", "amount", *MODEL_CATEGORIES, "label", "dataset_period", "production_batch")
    made = lifecycle.engineer(rows, MODEL_CATEGORIES, keep=lambda table: scratch.stored(table, "engineered"))
    return made, lifecycle.train_champion(made, MODEL_CATEGORIES), MODEL_CATEGORIES, ["product", "region"]


def challenger_trial(spark: SparkSession, d: str) -> DataFrame:
    """One row: windows, thresholds, differences with bounds and the decision about a challenger."""
    return rounded(lifecycle.evaluate_challenger(*contest(spark, d)).summary)


def challenger_segments(spark: SparkSession, d: str) -> DataFrame:
    """Recall differences of the challenger in every segment with enough positives."""
    return rounded(lifecycle.train_challenger(*contest(spark, d)).segments)


# A fitted model decides the rows of these, so they have no SQL.
OF_MODELS = ("model_metrics", "attribution_rank_change", "attribution_drivers", "challenger_trial", "challenger_segments")
SQL_DIR = Path(__file__).parent / "sql"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        velocity_by_period, contract_validation, one_to_one_join, table_profile, temporal_bounds, temporal_periods, shadow_batches,
        union_batches, causal_count_recency, causal_amount_mean_ratio, causal_two_keys, causal_daily_ties, frozen_state_lookup,
        stateless_features, missing_counts, category_levels, frequency_encoding, drop_rules, unknown_mapping, review_thresholds,
        confusion_by_batch, average_precision_by_batch, roc_auc_by_batch, brier_logloss, score_summary, ece_by_batch,
        reliability_table, review_budget, captured_amount, psi_by_batch, score_js, categorical_js, unseen_rate, missingness_shift,
        wasserstein_by_batch, drift_severity, bootstrap_drift_limits, alert_count_limits, drift_compare, drift_ordered,
        performance_limits, label_maturity, segment_topk, segment_metrics_pooled, top_segments, batch_metrics, action_policy,
        health_timeline, latest_batch, metric_unpivot, public_projection, shap_rank_change, driver_ranking, investigations,
        challenger_windows, score_js_limits, global_severity, label_freshness, last_evidence, recommendation_history, confusion_pivot,
        budget_unpivot, calibration_unpivot, score_movement, feature_metrics, full_metric_row, full_performance_limits, performance_records,
        monitor_limits, monitor_records, monitor_prediction, monitor_summary, batch_records, mature_segment_metrics, investigation_records, performance_summary, missingness_records, investigation_classes, investigation_drilldown,
        dataset_summary, missing_families, drift_chart, overview, reported_segments,
        model_metrics, attribution_rank_change, attribution_drivers, challenger_trial, challenger_segments,
    )
} | {"development_blocks": counted("development_block"), "daily_batches": counted("production_batch"), "fold_membership": lambda s, d: temporal.fold_rows(labelled(s, d))}


def oracle_sql() -> dict[str, str]:
    """Statements of sql/queries.sql by name, each with the shared views that it names in front."""
    views, statements = {}, {}
    for part in (SQL_DIR / "queries.sql").read_text().split("-- ")[1:]:
        head, _, body = part.partition("\n")
        kind, name = head.split()
        (views if kind == "view" else statements)[name] = body.strip().rstrip(";")
    out = {}
    for name, body in statements.items():
        used, todo = set(), [body]
        while todo:
            words = set(re.findall(r"\w+", todo.pop()))
            new = [v for v in views if v in words and v not in used]
            used.update(new)
            todo += [views[v] for v in new]
        shared = ",\n".join(f"{v} AS ({views[v]})" for v in views if v in used)
        out[name] = f"WITH {shared}\n{body}" if shared else body
    return out
