"""Metrics and drift statistics against brute force and on edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskmon.operators import challenger, drift, metrics, monitoring


def scored(spark, y, p, amount=None):
    return spark.createDataFrame([("g", int(a), float(b), float(c)) for a, b, c in zip(y, p, amount or [1.0] * len(y))], "g string, label int, score double, amount double")


def test_perfect_ranking(spark):
    df = scored(spark, [0, 0, 1, 1], [0.05, 0.1, 0.8, 0.9])
    assert metrics.ranking(df, ["g"]).first()["pr_auc"] == 1
    c = metrics.confusion(df, ["g"], F.lit(0.5)).first()
    assert c["precision"] == 1 and c["false_positive"] == 0


def test_ranking_with_ties(spark):
    random.seed(2)
    y, p = [random.random() < 0.3 for _ in range(300)], [random.randrange(12) / 12 for _ in range(300)]
    r = metrics.ranking(scored(spark, y, p), ["g"]).first()
    pos, neg = [b for a, b in zip(y, p) if a], [b for a, b in zip(y, p) if not a]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert r["roc_auc"] == pytest.approx(auc)
    assert r["pr_auc"] == pytest.approx(challenger.average_precision(np.array(y, int), np.array(p)))


def test_no_positives(spark):
    df = scored(spark, [0] * 5, [0.1, 0.2, 0.3, 0.4, 0.5])
    r, c = metrics.ranking(df, ["g"]).first(), metrics.confusion(df, ["g"], F.lit(0.5)).first()
    assert r["pr_auc"] is None and r["roc_auc"] is None and c["false_negative_rate"] is None and c["recall"] == 0


def test_thresholds_and_amounts(spark):
    df = scored(spark, [0] * 100, np.linspace(0, 1, 100))
    t = metrics.review_thresholds(df, [0.02]).first()["threshold"]
    assert t >= 0.98 and df.where(F.col("score") >= t).count() <= 3
    c = metrics.captured_amount(scored(spark, [0, 1, 1, 0], [0.1, 0.9, 0.4, 0.2], [10, 50, 100, 20]), ["g"], F.lit(0.8)).first()
    assert c["captured_amount"] == 50 and c["captured_rate"] == pytest.approx(1 / 3)


@pytest.mark.parametrize(("n", "q"), [(20, 0.95), (100, 0.98), (5, 0.5), (1, 0.9)])
def test_higher_quantile(spark, n, q):
    df = spark.range(n).select(F.col("id").cast("double").alias("x"))
    assert metrics.higher_quantile(df, "x", [q]).first()["value"] == np.quantile(np.arange(n), q, method="higher")


def test_calibration(spark):
    assert metrics.calibration_error(scored(spark, [0, 0, 0, 1], [0.5] * 4), ["g"]).first()["ece"] == 0.25
    rel = metrics.reliability(scored(spark, [0, 0, 1, 0, 1, 1], [0.1, 0.2, 0.3, 0.4, 0.8, 0.9]), ["g"], bins=3).orderBy("bin").collect()
    assert sum(r["rows"] for r in rel) == 6 and [r["bin"] for r in rel] == [1, 2, 3]
    assert metrics.calibration_line(scored(spark, [1, 1], [0.2, 0.3])) == (None, None)


def long(spark, values):
    return spark.createDataFrame([("b", "x", float(v)) for v in values], "batch string, feature string, value double")


def test_numeric_drift(spark):
    base = long(spark, np.linspace(0, 1, 200))
    same = drift.numeric_divergences(base, ["batch"], base.drop("batch")).first()
    assert same["psi"] == pytest.approx(0) and same["js"] == pytest.approx(0, abs=1e-7)
    moved = long(spark, np.linspace(3, 4, 200))
    assert drift.numeric_divergences(moved, ["batch"], base.drop("batch")).first()["psi"] > 1
    assert drift.wasserstein(base, ["batch"], base.drop("batch")).first()["wasserstein"] == pytest.approx(0)
    assert drift.wasserstein(moved, ["batch"], base.drop("batch")).first()["wasserstein"] > 1


def test_category_drift(spark):
    rows = spark.createDataFrame([("r", "a"), ("r", "a"), ("r", "b"), ("r", None), ("c", "c"), ("c", "c"), ("c", "a"), ("c", None)], "s string, v string")
    now, ref = drift.category_long(rows.where("s = 'c'"), ["s"], ["v"]), drift.category_long(rows.where("s = 'r'"), [], ["v"])
    assert drift.category_distance(now, ["s"], ref).first()["js"] > 0
    assert drift.unseen_rate(now, ["s"], ref).first()["unseen_rate"] == 0.5


def test_severity(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, 0.1), (4, 0.2), (5, 0.3)], "i int, v double")
    got = [r["s"] for r in df.select("i", drift.severity(F.col("v"), F.lit(0.1), F.lit(0.2)).alias("s")).orderBy("i").collect()]
    assert got == ["critical", "critical", "healthy", "warning", "critical"]


def test_bootstrap_equals_literal_resample(spark):
    random.seed(1)
    rows = [(d, "x", float(random.randrange(20))) for d in range(3) for _ in range(50)]
    ref = spark.createDataFrame(rows, "day long, feature string, value double")
    draws = drift.draw_days(spark, [0, 1, 2], 4)
    got = {r["iter"]: r["psi"] for r in drift.bootstrap_statistics(ref, draws).collect()}
    for i in range(4):
        mult = {r["day"]: r["mult"] for r in draws.where(f"iter = {i}").collect()}
        sample = long(spark, [v for d, _, v in rows for _ in range(mult.get(d, 0))])
        assert drift.numeric_divergences(sample, ["batch"], ref.drop("day")).first()["psi"] == pytest.approx(got[i])


def test_schema_missing(spark):
    limits = spark.createDataFrame([("x", 0.1, 0.2)], "feature string, warning_limit double, critical_limit double")
    values = spark.createDataFrame([(1, "x", 0.05)], "batch int, feature string, psi double")
    got = {r["feature"]: r for r in drift.compare(values, limits, ["batch"], "psi", ["x", "gone"]).collect()}
    assert got["x"]["severity"] == "healthy" and got["gone"]["metric"] == "schema_missing" and got["gone"]["severity"] == "critical"


def test_running_sums_equal_a_whole_sort(spark):
    rnd = np.random.default_rng(3)
    rows = [(g, float(v), int(n)) for g in ("a", None) for v, n in zip(np.unique(np.concatenate([rnd.normal(size=200), 10 ** rnd.uniform(0, 9, 50)])), rnd.integers(1, 9, 250))]
    rows.append(("one", 5.0, 7))
    df = spark.createDataFrame(rows, "g string, v double, n long")
    for by in (["g"], []):
        held = df if by else df.where("g = 'a'")
        for down in (False, True):
            got = {(r["g"], r["v"]): (r["upto_n"], r["all_n"]) for r in metrics.running(held, by, "v", ["n"], down, buckets=16).collect()}
            for g in {r[0] for r in rows} if by else {"a"}:
                own = sorted((r for r in rows if r[0] == g), key=lambda r: -r[1] if down else r[1])
                assert [got[g, v] for _, v, _ in own] == [(sum(r[2] for r in own[: i + 1]), sum(r[2] for r in own)) for i in range(len(own))]
    assert metrics.running(df.limit(0), ["g"], "v", ["n"]).count() == 0


def test_a_column_that_vanishes_from_a_batch_is_schema_missing(spark):
    values = spark.createDataFrame([(1, "x", 0.5), (1, "y", 0.1), (2, "x", 0.0), (2, "free", 0.2)], "batch int, feature string, psi double")
    limits = spark.createDataFrame([("x", 0.2, 0.4), ("y", 0.2, 0.4)], "feature string, warning_limit double, critical_limit double")
    got = {(r["batch"], r["feature"]): (r["metric"], r["value"], r["severity"]) for r in drift.compare(values, limits, ["batch"], "psi", ["x", "y", "free", "gone"]).collect()}
    missing = ("schema_missing", 1.0, "critical")
    assert got[1, "x"] == ("psi", 0.5, "critical") and got[1, "y"] == ("psi", 0.1, "healthy") and got[2, "x"] == ("psi", 0.0, "healthy")
    assert got[2, "y"] == missing and got[1, "gone"] == got[2, "gone"] == missing
    # Present without limits: judged by its value, not called missing.
    assert got[2, "free"] == ("psi", 0.2, "critical") and got[1, "free"] == missing


def test_hashed_draws_are_many_and_even(spark):
    days = spark.createDataFrame([(d,) for d in (3, 5, 9) for _ in range(4)], "day long")
    rows = drift.hashed_draws(days, 500).collect()
    per: dict = {}
    for r in rows:
        per.setdefault(r["iter"], {})[r["day"]] = r["mult"]
    assert len(per) == 500 and all(sum(x.values()) == 7 for x in per.values())
    # 36 multisets of 7 draws from 3 days exist; a period of the number of days would leave 3.
    assert len({tuple(sorted(x.items())) for x in per.values()}) > 30
    share = [sum(x.get(d, 0) for x in per.values()) / 3500 for d in (3, 5, 9)]
    assert all(abs(s - 1 / 3) < 0.03 for s in share)


def test_global_severity_counts_alerts(spark):
    records = spark.createDataFrame([(1, "a", "critical"), (1, "b", "critical"), (2, "a", "warning"), (2, "b", "healthy"), (3, "a", "healthy"), (4, "a", "healthy")], "batch int, feature string, severity string")
    limits = spark.createDataFrame([("warning", 0), ("critical", 1)], "kind string, limit long")
    prediction = spark.createDataFrame([(1, "healthy"), (2, "healthy"), (3, "critical"), (4, "healthy")], "batch int, prediction_severity string")
    got = {r["batch"]: r["severity"] for r in drift.global_severity(records, limits, prediction, ["batch"]).collect()}
    assert got == {1: "critical", 2: "warning", 3: "critical", 4: "healthy"}


def test_paired_average_precision(spark):
    rnd = np.random.default_rng(8)
    y = (rnd.random(600) < 0.3).astype(int)
    old, new = 0.4 * y + rnd.random(600), 0.9 * y + rnd.random(600)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(y, old, new)], "label int, champion double, challenger double")
    difference, low, high = challenger.paired_average_precision(df, 100)
    assert difference == pytest.approx(challenger.average_precision(y, new) - challenger.average_precision(y, old))
    assert low < difference < high and low > 0
    direct = challenger.paired_difference(df, challenger.average_precision, 100)
    assert direct[0] == pytest.approx(difference) and abs(direct[1] - low) < 0.05 and abs(direct[2] - high) < 0.05
    assert challenger.paired_average_precision(df.where("label = 1"), 10) is None
    with pytest.raises(ValueError, match="metric must be one of"):
        challenger.paired_difference(df, "other", 10)


def test_recommendations_mark_repeats(spark):
    rows = spark.createDataFrame([("p", i, a, "e") for i, a in enumerate(["x", "x", "y", "y", "x"])], "stream string, batch int, action string, action_evidence string")
    assert [r["repeated"] for r in monitoring.recommendations(rows).orderBy("batch").collect()] == [False, True, False, True, False]
