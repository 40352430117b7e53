"""One run over all production and shadow batches: score, judge, act, explain, and write the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskmon.config import Settings
from riskmon.operators import diagnosis, drift, explain, lifecycle, metrics, models, monitor, monitoring, performance

SECONDS_PER_DAY = 86_400
BY = ["stream", "batch"]
# The performance metrics of a batch record.
SHOWN = (
    "positives", "precision", "recall", "f1", "false_positive_rate", "false_negative_rate", "pr_auc", "roc_auc", "brier_score", "expected_calibration_error",
    "fraud_amount", "captured_amount", "captured_rate",
)


def base_records(scored: DataFrame, threshold: float, delay: int) -> DataFrame:
    """(stream, batch, sizes, score and label status) of every batch; shadow batches have no labels."""
    sums = scored.groupBy(*BY).agg(
        F.count(F.lit(1)).alias("rows"), (F.min("t") / SECONDS_PER_DAY).alias("elapsed_day_start"), (F.max("t") / SECONDS_PER_DAY).alias("elapsed_day_end"),
        F.avg("score").alias("score_mean"), F.avg((F.col("score") >= threshold).cast("double")).alias("review_rate"),
    )
    middle = metrics.quantiles(scored, BY, "score", [0.5, 0.95])
    held = metrics.same_group(sums, middle, BY)
    labelled = F.col("stream") == "production"
    latest = F.max(F.when(labelled, F.col("batch"))).over(Window.partitionBy())
    status = F.when(labelled, monitoring.label_status(F.col("batch"), delay, latest)).otherwise("unavailable")
    return held.select(
        *BY, "rows", "elapsed_day_start", "elapsed_day_end", status.alias("label_status"), F.when(labelled, F.col("batch") + delay).alias("label_available_at_batch"), "score_mean",
        F.get("quantiles", F.lit(0)).alias("score_p50"), F.get("quantiles", F.lit(1)).alias("score_p95"), "review_rate", F.lit(threshold).alias("review_threshold"),
    )


def batch_records(base: DataFrame, summary: DataFrame, prediction: DataFrame, judged: DataFrame, rows: DataFrame) -> DataFrame:
    """The base records with drift, performance, metrics where labels are mature, and the action.

    `summary` and `prediction` are the drift monitor's, `judged` the performance records and
    `rows` the metric rows, both of production batches.
    """
    moved = prediction.groupBy(*BY).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in monitor.PREDICTION])
    drifted = summary.select(*BY, "warning_features", "critical_features", "prediction_severity", F.col("global_severity").alias("drift_severity"))
    verdict = performance.summary(judged, BY)
    out = base.join(drifted, BY).join(moved, BY).join(verdict, BY, "left").join(rows.select(*BY, *SHOWN), BY, "left")
    out = out.withColumns({
        "performance_severity": F.coalesce("performance_severity", F.lit("unavailable")), "primary_critical": F.coalesce("primary_critical", F.lit(False)),
        **{c: F.when(F.col("label_status") == "mature", F.col(c)) for c in SHOWN},
    })
    return monitoring.actions(out)


def judged(scored: DataFrame, reference: DataFrame, threshold: float, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Performance records of every labelled batch against limits of the reference period, and the metric rows."""
    days = reference.withColumn("day", F.floor(F.col("t") / SECONDS_PER_DAY))
    bounds = performance.limits(performance.resampled(days, drift.hashed_draws(days.select("day"), settings.iterations), threshold))
    base = performance.metric_row(reference.withColumn("period", F.lit(0)), ["period"], threshold)
    status = monitoring.label_status(F.col("batch"), settings.label_delay, F.max("batch").over(Window.partitionBy()))
    rows = performance.metric_row(scored, BY, threshold, "amount").withColumn("label_status", status)
    return performance.records(rows, base, bounds, BY, F.col("label_status") == "mature"), rows


def mature_segments(scored: DataFrame, base: DataFrame, top: DataFrame, capped: list[str], plain: list[str], threshold: float, positives: int, negatives: int) -> DataFrame:
    """Segment metrics of mature batches only; thin segments are pooled with the mature batch before."""
    mature = base.where("label_status = 'mature'").select(*BY)
    long = monitoring.segments(scored.join(F.broadcast(mature), BY, "left_semi"), top, capped, plain)
    return monitoring.pooled(monitoring.segment_counts(long, ["batch"], F.lit(threshold)), "batch", positives, negatives)


def contract(table: DataFrame, rate: float) -> DataFrame:
    """(field, value): what the latest production batch was scored and judged with."""
    latest = table.where("stream = 'production'").agg(F.max_by(F.struct("model_version", "data_version", "review_threshold"), "batch").alias("x")).select("x.*")
    shown = {"Model version": F.col("model_version"), "Data version": F.col("data_version"), "Review threshold": F.format_number("review_threshold", 3), "Default capacity": F.lit(f"{100 * rate:g}%")}
    return latest.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in shown.items()])).alias("r")).select("r.*")


def monitored_inputs(bundle: lifecycle.Bundle, made: DataFrame, always: list[str], settings: Settings) -> tuple[DataFrame, list[str], list[str]]:
    """The rows with the model's inputs as it was fitted on them, and the numeric and categorical ones to monitor, by importance."""
    known = bundle.preprocessor
    held = known.transform(made)
    names = {c: c.removeprefix("in_") for c in bundle.columns}
    chosen = monitor.monitored_features(models.importances(bundle.model, bundle.columns), bundle.columns, settings.top_features, tuple(f"in_{c}" for c in always))
    renamed = {c: f"monitored_{names[c]}" for c in chosen}
    return held.withColumnsRenamed(renamed), [renamed[c] for c in chosen if c not in known.levels], [renamed[c] for c in chosen if c in known.levels]


def run(
    spark: SparkSession, rows: DataFrame, bundle: lifecycle.Bundle, target: str, categorical: list[str], capped: list[str], numeric: list[str], settings: Settings,
    shadow: DataFrame | None = None, data_version: str = "",
) -> dict[str, str]:
    """Write every monitoring table of labelled rows, and of later unlabelled ones, to a new folder under `target`; returns the paths by name.

    `shadow` has the columns of `rows` but for the label, and shadow_batch. Scores are
    stored first, and each later table reads stored ones, so a lost executor costs tasks
    and not the run. Performance and segments are judged only where labels are mature.
    Features in `numeric` are monitored whatever their importance.
    """
    place = f"{target.rstrip('/')}/replay-{uuid.uuid4().hex[:8]}"
    paths: dict[str, str] = {}

    def stored(name: str, df: DataFrame) -> DataFrame:
        paths[name] = f"{place}/{name}"
        df.write.parquet(paths[name])
        return spark.read.parquet(paths[name])

    every = rows.unionByName(shadow, allowMissingColumns=True) if shadow is not None else rows.withColumn("shadow_batch", F.lit(None).cast("int"))
    engineered = lifecycle.engineer(every, categorical, bundle.asked[1])
    made, wanted, levels = monitored_inputs(bundle, bundle.score(engineered), numeric, settings)
    made = stored("scored", made)
    number = F.coalesce("production_batch", "shadow_batch").cast("int")
    scored = made.where(number.isNotNull()).withColumns({"batch": number, "stream": F.when(F.col("production_batch").isNotNull(), "production").otherwise("shadow")})
    labelled, reference = scored.where("stream = 'production'"), made.where("dataset_period = 'acceptance'").withColumn("day", F.floor(F.col("t") / SECONDS_PER_DAY))
    draws = drift.hashed_draws(reference.select("day"), settings.iterations)
    fitted = monitor.fit(reference, wanted, levels, draws, settings.warning_quantile, settings.critical_quantile, keep=lambda name, df: stored(f"reference_{name}", df))
    plain = F.regexp_replace("feature", "^monitored_", "")
    records = stored("drift", fitted.compare(scored, BY).withColumn("feature", plain))
    prediction = stored("prediction", fitted.prediction(scored, BY))
    found, metric_rows = judged(labelled, reference, bundle.threshold, settings)
    found = stored("performance", found)
    base = stored("base", base_records(scored, bundle.threshold, settings.label_delay))
    versions = {"model_version": F.lit(bundle.version), "data_version": F.lit(data_version)}
    table = stored("batches", batch_records(base, fitted.summary(records, prediction, BY), prediction, found, metric_rows).withColumns(versions))
    outcome = {"challenger_evaluated": F.lit(False), "retrain_recommended": F.lit(False), "challenger_outcome": F.lit(None).cast("string")}
    stored("recommendations", monitoring.recommendations(table).withColumns(versions | outcome))
    top = monitoring.top_values(reference, capped, 10)
    pooled = stored("segments", mature_segments(labelled, base, top, capped, [], bundle.threshold, settings.minimum_positive, settings.minimum_negative).withColumn("stream", F.lit("production")))
    explained = engineered.withColumns({"batch": number, "stream": F.when(F.col("production_batch").isNotNull(), "production").otherwise("shadow")})
    now = explain.summary(lifecycle.attributions(bundle, explained.where("batch is not null"), [*BY, "label"]), BY)
    ref = explain.summary(lifecycle.attributions(bundle, explained.where("dataset_period = 'acceptance'"), ["label"]), [])
    change = stored("attributions", diagnosis.importance_change(ref, now, BY))
    stored("contract", contract(table, settings.review_rate))
    stored("investigations", diagnosis.investigation_records(table, records, found, change, pooled, BY))
    return paths
