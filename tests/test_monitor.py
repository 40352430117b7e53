"""The drift monitor: absent features, values that cannot be computed, the choice of features, and what follows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskmon.operators import drift, monitor

ROWS = "day long, batch int, score double, x double, c string"


def reference(spark):
    rows = [(d, None, 0.1 + 0.01 * ((d + i) % 7), float((i * 7 + d) % 50), "ab"[i % 2]) for d in range(6) for i in range(40)]
    return spark.createDataFrame(rows, ROWS)


@pytest.fixture(scope="module")
def fitted(spark):
    ref = reference(spark)
    return monitor.fit(ref, ["x"], ["c"], drift.draw_days(spark, list(range(6)), 40))


def test_limits_cover_every_metric(fitted):
    assert {(r["feature"], r["kind"], r["metric"]) for r in fitted.limits.collect()} == set(monitor.kinds(["x"], ["c"]))
    assert {r["metric"] for r in fitted.prediction_limits.collect()} == set(monitor.PREDICTION)
    assert all(r["warning_limit"] <= r["critical_limit"] for r in fitted.limits.collect())
    assert {r["kind"] for r in fitted.allowed.collect()} == {"warning", "critical"}


def test_records_of_shifted_equal_and_unusable_batches(spark, fitted):
    same = reference(spark).withColumn("batch", F.lit(1))
    moved = same.withColumns({"batch": F.lit(2), "x": F.col("x") + 100, "c": F.lit("new"), "score": F.col("score") + 0.5})
    empty = same.withColumns({"batch": F.lit(3), "x": F.lit(None).cast("double"), "c": F.lit(None).cast("string")})
    now = same.unionByName(moved).unionByName(empty)
    records = fitted.compare(now, ["batch"])
    got = {(r["batch"], r["feature"], r["metric"]): (r["value"], r["severity"]) for r in records.collect()}
    assert len(got) == 3 * 6
    assert all(value == 0 and level == "healthy" for (batch, _, _), (value, level) in got.items() if batch == 1)
    assert got[2, "x", "psi"][1] == got[2, "x", "normalized_wasserstein"][1] == got[2, "c", "jensen_shannon"][1] == "critical"
    assert got[2, "c", "unseen_category_rate"] == (1.0, "critical") and got[2, "x", "missingness_shift"] == (0.0, "healthy")
    # Without a finite value nothing can be computed, which is critical; a null category is a level of its own.
    assert got[3, "x", "psi"] == got[3, "x", "normalized_wasserstein"] == (None, "critical")
    assert got[3, "x", "missingness_shift"] == got[3, "c", "missingness_shift"] == (1.0, "critical") and got[3, "c", "unseen_category_rate"] == (1.0, "critical")
    summary = {r["batch"]: r for r in fitted.summary(records, fitted.prediction(now, ["batch"]), ["batch"]).collect()}
    assert (summary[1]["warning_features"], summary[1]["global_severity"], summary[1]["prediction_severity"]) == (0, "healthy", "healthy")
    assert (summary[2]["critical_features"], summary[2]["global_severity"], summary[2]["prediction_severity"]) == (2, "critical", "critical")


def test_absent_features_and_wrong_input(spark, fitted):
    now = reference(spark).withColumn("batch", F.lit(1)).drop("c")
    got = [r for r in fitted.compare(now, ["batch"]).collect() if r["feature"] == "c"]
    assert [(r["metric"], r["value"], r["warning_limit"], r["severity"], r["feature_kind"]) for r in got] == [("schema_missing", 1.0, 0.0, "critical", "categorical")]
    assert fitted.compare(now, ["batch"]).count() == 4
    draws = drift.draw_days(spark, [0, 1], 3)
    for broken in ({"numeric": ["gone"]}, {"warning": 0.99, "critical": 0.95}):
        with pytest.raises(ValueError):
            monitor.fit(reference(spark), **({"numeric": ["x"], "categorical": [], "draws": draws} | broken))


def test_monitored_features():
    ranked = [("a", 0.5), ("b", 0.2), ("c", 0.2), ("d", 0.1), ("gone", 0.9)]
    assert monitor.monitored_features(ranked, ["a", "b", "c", "d", "z"], 3, ("z", "a", "absent")) == ["a", "b", "z"]
    assert monitor.monitored_features(ranked, ["a", "b", "c", "d"], 10) == ["a", "b", "c", "d"]
