"""Metric rows, performance limits and records, and classes of investigations."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskmon.operators import diagnosis, drift, metrics, performance

ROWS = "g int, score double, label int, amount double"


def brute(score, label, cut):
    flagged = score >= cut
    tp, fp, fn = (flagged & (label == 1)).sum(), (flagged & (label == 0)).sum(), (~flagged & (label == 1)).sum()
    order = np.unique(score)[::-1]
    ap = sum(((score == s) & (label == 1)).sum() * label[score >= s].mean() for s in order) / label.sum()
    edge = np.unique(np.round(np.quantile(score, np.linspace(0, 1, 11)), 9))
    bins = np.searchsorted(edge[1:-1], score, side="left")
    ece = sum((bins == b).mean() * abs(label[bins == b].mean() - score[bins == b].mean()) for b in np.unique(bins))
    return {"pr_auc": ap, "precision": tp / max(tp + fp, 1), "recall": tp / (tp + fn), "brier_score": ((score - label) ** 2).mean(), "expected_calibration_error": ece}


def test_metric_row_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    score, label = rng.integers(0, 40, 300) / 40, rng.integers(0, 2, 300)
    rows = [(1, float(s), int(y), 2.0) for s, y in zip(score, label)]
    found = performance.metric_row(spark.createDataFrame(rows, ROWS), ["g"], 0.5, "amount")
    assert len(found.columns) == 1 + 24 + 3
    row = found.first()
    for name, value in brute(score, label, 0.5).items():
        assert row[name] == pytest.approx(value), name
    assert row["review_rate"] == pytest.approx((score >= 0.5).mean()) and row["fraud_amount"] == 2.0 * label.sum()


def test_metric_row_refuses_bad_rows(spark):
    for score, label in ((1.5, 1), (float("nan"), 1), (None, 1), (0.5, 2), (0.5, None)):
        with pytest.raises(Exception, match="must"):
            performance.metric_row(spark.createDataFrame([(1, score, label, 1.0)], ROWS), ["g"], 0.5).collect()
    with pytest.raises(ValueError):
        performance.metric_row(spark.createDataFrame([], ROWS), ["g"], 1.5)
    assert performance.metric_row(spark.createDataFrame([], ROWS), ["g"], 0.5).count() == 0


def test_resamples_equal_a_literal_repeat_of_the_days(spark):
    rng = np.random.default_rng(5)
    rows = [(int(d), float(s) / 20, int(y)) for d, s, y in zip(rng.integers(0, 3, 200), rng.integers(0, 21, 200), rng.integers(0, 2, 200))]
    # Day 9 holds one class, so a resample of it alone is left out.
    rows += [(9, 0.5, 0)] * 5
    draws = spark.createDataFrame([(0, 0, 2), (0, 1, 1), (1, 2, 3), (2, 9, 7)], "iter int, day int, mult int")
    frame = spark.createDataFrame(rows, "day int, score double, label int")
    found = {(r["iter"], r["metric"]): r["value"] for r in performance.resampled(frame, draws, 0.5).collect()}
    assert {i for i, _ in found} == {0, 1} and len(found) == 16
    base = np.mean([y for _, _, y in rows])
    for i, mult in ((0, {0: 2, 1: 1}), (1, {2: 3})):
        repeated = [(s, y) for d, s, y in rows for _ in range(mult.get(d, 0))]
        score, label = (np.array(x) for x in zip(*repeated))
        for name, value in (brute(score, label, 0.5) | {"prevalence_shift": abs(label.mean() - base)}).items():
            assert found[i, name] == pytest.approx(value), name


def test_records_of_immature_and_single_class_batches_are_unavailable(spark):
    rng = np.random.default_rng(7)
    rows = [(g, float(s), int(y), 1.0) for g in (1, 2) for s, y in zip(rng.random(80), rng.integers(0, 2, 80))] + [(3, 0.4, 0, 1.0)] * 4
    frame = spark.createDataFrame(rows, ROWS)
    reference = performance.metric_row(frame.where("g = 1"), ["g"], 0.5)
    names = [(m, "lower" if m in performance.LOWER else "higher", *((2.0, 1.5) if m == "recall" else (0.0, -1.0) if m in performance.LOWER else (9.0, 10.0)))
             for m in (*performance.LOWER, *performance.HIGHER)]
    bounds = spark.createDataFrame(names, "metric string, direction string, warning_limit double, critical_limit double")
    judged = performance.records(performance.metric_row(frame, ["g"], 0.5), reference, bounds, ["g"], F.col("g") != 2)
    got = {(r["g"], r["metric"]): r for r in judged.collect()}
    assert len(got) == 24
    assert all(got[g, m[0]]["status"] == "unavailable" and got[g, m[0]]["value"] is None for g in (2, 3) for m in names)
    assert got[1, "recall"]["status"] == "critical" and got[1, "precision"]["status"] == "healthy"
    assert got[1, "prevalence_shift"]["reference_value"] == 0 and got[2, "prevalence_shift"]["reference_value"] is None
    status = {r["g"]: (r["performance_severity"], r["primary_critical"]) for r in performance.summary(judged, ["g"]).collect()}
    assert status == {1: ("critical", True), 2: ("unavailable", False), 3: ("unavailable", False)}


def test_limits_take_the_worse_side(spark):
    samples = spark.createDataFrame([(m, float(v)) for m in ("recall", "brier_score") for v in range(101)] + [("recall", None)], "metric string, value double")
    got = {r["metric"]: tuple(r)[1:] for r in performance.limits(samples).collect()}
    assert got == {"recall": ("lower", 5.0, 1.0), "brier_score": ("higher", 95.0, 99.0)}


def test_missingness_resamples(spark):
    ref = spark.createDataFrame([(0, None), (0, 1), (1, 1), (1, 1)], "day int, x int")
    draws = spark.createDataFrame([(0, 0, 2), (1, 1, 2), (2, 0, 1), (2, 1, 1)], "iter int, day int, mult int")
    got = {r["iter"]: r["missingness_shift"] for r in drift.bootstrap_missingness(ref, draws, ["x"]).collect()}
    assert got == {0: 0.25, 1: 0.25, 2: 0.0}


def test_classes_of_findings(spark):
    batches = spark.createDataFrame(
        [(1, "healthy", "unavailable", "healthy"), (2, "critical", "healthy", "warning"), (3, "warning", "critical", "healthy"), (4, "warning", "healthy", "healthy")],
        "batch int, drift_severity string, performance_severity string, prediction_severity string",
    )
    alerts = spark.createDataFrame([(2, "missingness_shift", "warning"), (2, "psi", "critical"), (4, "psi", "healthy")], "batch int, metric string, severity string")
    failed = spark.createDataFrame([(3, "recall", "critical"), (3, "brier_score", "warning"), (3, "prevalence_shift", "warning"), (4, "recall", "healthy")], "batch int, metric string, status string")
    got = {r["batch"]: r["classification"] for r in diagnosis.classify(batches, alerts, failed, ["batch"]).collect()}
    assert got == {
        2: "data_quality_failure, covariate_drift, prediction_drift",
        3: "prevalence_shift, calibration_drift, confirmed_performance_degradation", 4: "monitoring_signal",
    }


def test_evidence_reads_back(spark):
    found = spark.createDataFrame(
        [(1, '[{"place":1,"feature":"a","metrics":"psi","driver_score":2.5},{"place":2,"feature":"b","metrics":"psi","driver_score":1.0}]'), (2, "[]"), (3, "no json"), (4, None)],
        "batch int, driver_evidence string",
    )
    got = [tuple(r) for r in diagnosis.evidence_rows(found, ["batch"], 1).collect()]
    assert got == [(1, 1, "a", "psi", 2.5)]


def test_weighted_calibration_counts_rows(spark):
    frame = spark.createDataFrame([(0.1, 0, 3), (0.7, 1, 2), (0.9, 0, 1)], "score double, label int, w int")
    repeated = frame.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("w"))))
    one, other = metrics.calibration_error(frame, [], weight="w").first()[0], metrics.calibration_error(repeated, []).first()[0]
    assert one == pytest.approx(other)
