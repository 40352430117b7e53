"""From CSV files to validated Parquet tables and a manifest, and from a prepared table to a trained bundle with its report."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmon.config import Settings
from riskmon.operators import bootstrap, features, lifecycle, metrics, models, performance, temporal, tuning
from riskmon.sources import export, ingest, scratch


def read_joined(spark: SparkSession, paths: list[str], s: Settings, labelled: bool) -> DataFrame:
    """Transactions with their identities, names normalised, known columns cast, both tables checked."""
    known = {s.id_column: "bigint", s.time_column: "bigint", s.amount_column: "double", **({s.label_column: "int"} if labelled else {})}
    tables = []
    for path in paths:
        header = spark.read.option("header", True).csv(path).columns
        numbers = {c: "double" for c in header if features.is_numeric(c.replace("-", "_"))}
        tables.append(ingest.normalize_identity(ingest.read_csv(spark, path, numbers | known)))
    name = paths[0].rsplit("/", 1)[1].split(".")[0]
    ingest.validate(tables[0], name, s.id_column, s.time_column, s.label_column if labelled else None)
    return ingest.join_one_to_one(*tables, s.id_column)


def prepare(spark: SparkSession, source: str, target: str, settings: Settings | None = None) -> dict:
    """CSV transactions and identities to validated Parquet tables, labelled and later ones, and the manifest, which is returned.

    Later, unlabelled rows are taken where one of their files exists, and then both must: they must all follow the
    labelled ones and are dealt into shadow batches. The labelled table is partitioned by period. The manifest is written last.
    """
    s = settings or Settings()
    more = any(export.present(spark, f"{source.rstrip('/')}/{name}") for name in s.later_files)
    names = s.expected_files + (s.later_files if more else ())
    paths = ingest.required_files(spark, source, names)
    train = read_joined(spark, paths[:2], s, labelled=True)
    bounds = temporal.time_bounds(train, s.time_column)
    later = read_joined(spark, paths[2:], s, labelled=False) if more else None
    if later is not None:
        shadow = temporal.time_bounds(later, s.time_column)
        temporal.check_shadow_follows(bounds, shadow)
        later = temporal.assign_shadow_batches(later, shadow.least, s.batch_seconds, s.time_column)
    parted = temporal.assign_partitions(train, bounds, s.development_blocks, s.batch_seconds, s.time_column)
    temporal.check_partitions(parted, s.development_blocks)
    parted.write.mode("overwrite").option("compression", "zstd").partitionBy("dataset_period").parquet(f"{target}/train.parquet")
    manifest = {
        "manifest_version": 1, "created_at_utc": datetime.now(UTC).isoformat(), "project": s.name,
        "source_files": {name: ingest.fingerprint(spark, path) for name, path in zip(names, paths)},
        "train": ingest.table_profile(spark.read.parquet(f"{target}/train.parquet"), s.time_column, s.label_column, "dataset_period"),
        "temporal_boundaries": {"least": bounds.least, "most": bounds.most, "cutoffs": [bounds.cutoff(i) for i in range(3)]},
        "development_folds": [{"name": name, "train_blocks": list(range(1, last + 1)), "validation_block": valid} for name, last, valid in temporal.expanding_folds(s.development_blocks)],
        "outputs": {"train": "train.parquet"},
    }
    if later is not None:
        later.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/test.parquet")
        manifest["test"] = ingest.table_profile(spark.read.parquet(f"{target}/test.parquet"), s.time_column)
        manifest["outputs"]["test"] = "test.parquet"
    ingest.write_manifest(spark, f"{target}/manifest", manifest)
    return manifest


def data_version(manifest: dict) -> str:
    return ingest.content_version({name: found["digest"] for name, found in manifest["source_files"].items()})


def transactions(spark: SparkSession, source: str, s: Settings, table: str = "train") -> DataFrame:
    """A prepared table under the names that the operators use, with every column that is an input by its name."""
    rows = spark.read.parquet(f"{source}/{table}.parquet")
    product = F.col("ProductCD") if "ProductCD" in rows.columns else F.lit(None).cast("string")
    entity = F.col(s.entity_column) if s.entity_column in rows.columns else F.lit(None).cast("string")
    more = [c for c in rows.columns if (features.is_categorical(c) or features.is_numeric(c) or c == features.AVAILABLE) and c not in ("ProductCD", s.entity_column)]
    label = [F.col(s.label_column).alias("label")] if s.label_column in rows.columns else []
    placed = [c for c in ("dataset_period", "development_block", "production_batch", "shadow_batch") if c in rows.columns]
    return rows.select(
        F.col(s.id_column).alias("event_id"), F.col(s.time_column).alias("t"), F.col(s.amount_column).alias("amount"), *label,
        entity.alias("user_id"), product.alias("product"), *more, *placed,
    )


def inputs(rows: DataFrame) -> tuple[list[str], list[str]]:
    """(categorical, further numeric) inputs among the columns of `transactions`."""
    numbers = [c for c in rows.columns if features.is_numeric(c) or c == features.AVAILABLE]
    return ["product", "user_id", *(c for c in rows.columns if features.is_categorical(c))], [*numbers, *features.COUNTS]


def baselines(made: DataFrame, categorical: list[str], numeric: list[str]) -> dict[str, float]:
    """Average precision in the acceptance period of the prior and of a logistic model of the development period.

    Only categories with a bounded list of levels may be given.
    """
    train, held = made.where("dataset_period = 'development'"), made.where("dataset_period = 'acceptance'")
    prior = held.withColumn("score", F.lit(models.prior_score(train)))
    line = models.logistic_baseline(train, categorical, numeric)
    scored = line.transform(models.logistic_input(held.drop("score"), categorical, numeric))
    found = {"prior": prior, "logistic": scored.withColumn("score", models.probability(scored))}
    return {name: metrics.ranking(df.select("label", "score"), []).first()["pr_auc"] for name, df in found.items()}


def train(spark: SparkSession, source: str, target: str, s: Settings) -> str:
    """Tune on the development folds, fit the champion, judge it in the acceptance period; returns the bundle's new folder.

    Beside the bundle the folder holds report (one line of JSON: metrics, intervals, baselines, folds' best trial, data
    version), review_budgets (a row per review rate) and trials. The run is logged under `target`.
    """
    manifest = ingest.read_manifest(spark, f"{source}/manifest")
    rows = transactions(spark, source, s)
    categorical, numeric = inputs(rows)
    made = scratch.stored(lifecycle.engineer(rows, categorical, numeric), "engineered")
    for period in ("development", "calibration", "acceptance"):
        models.require_both_classes(made.where(F.col("dataset_period") == period))
    texts, numbers = [f"in_{c}" for c in categorical], [f"in_{c}" for c in (*lifecycle.NUMERIC, *lifecycle.PAST, *numeric)]
    objective = tuning.fold_objective(made.where("dataset_period = 'development'"), texts, numbers, s.development_blocks, s.seed, lambda df: scratch.stored(df, "folds"), s.cardinality_limit)
    best, trials = tuning.search(objective, s.trials, seed=s.seed)
    bundle = lifecycle.train_champion(made, categorical, rate=s.review_rate, limit=s.cardinality_limit, numeric=numeric, **tuning.tree_parameters(best))
    held = scratch.stored(bundle.score(made.where("dataset_period = 'acceptance'")).select("label", "score", "amount"), "acceptance")
    found = performance.metric_row(held.withColumn("period", F.lit(0)), ["period"], bundle.threshold, "amount").first().asDict()
    calibrated = bundle.score(made.where("dataset_period = 'calibration'")).select("score")
    budgets = metrics.review_budget(held, metrics.review_thresholds(calibrated, list(s.review_rates)))
    decided = held.select("label", (F.col("score") >= bundle.threshold).cast("double").alias("score"))
    bounds = {"pr_auc": bootstrap.interval(held.select("label", "score"), "pr_auc", s.iterations, seed=s.seed), "recall": bootstrap.interval(decided, "recall", s.iterations, seed=s.seed)}
    report = {
        "model_version": bundle.version, "data_version": data_version(manifest), "threshold": bundle.threshold, "calibrator": bundle.calibrator.kind,
        "acceptance_metrics": {k: v for k, v in found.items() if k != "period"}, "acceptance_intervals": {k: dict(zip(("value", "lower", "upper"), v)) for k, v in bounds.items()},
        "baseline_pr_auc": baselines(made, [c for c in texts if c in bundle.columns], [c for c in numbers if c in bundle.columns]), "tuning": {"best": best, "value": max(v for _, v in trials), "trials": len(trials)},
        "importances": dict(models.importances(bundle.model, bundle.columns)), "settings": asdict(s),
    }
    path = f"{target.rstrip('/')}/bundle-{bundle.version}-{uuid.uuid4().hex[:8]}"
    bundle.save(path)
    budgets.coalesce(1).write.parquet(f"{path}/review_budgets")
    spark.createDataFrame([(k, json.dumps(p, sort_keys=True), v) for k, (p, v) in enumerate(trials)], "trial int, parameters string, value double").coalesce(1).write.parquet(f"{path}/trials")
    ingest.write_manifest(spark, f"{path}/report", report)
    lifecycle.log_run(spark, f"{target.rstrip('/')}/runs", bundle, {"pr_auc": found["pr_auc"], "roc_auc": found["roc_auc"]})
    return path
