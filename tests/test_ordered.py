"""Running sums, quantiles and resamples of ordered values against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskmon.operators import drift, metrics, resample


def skewed(n=200_001):
    rng = np.random.default_rng(1)
    return np.concatenate([np.exp(rng.normal(0, 6, n - 1)), [1e18]])


def test_no_part_is_large_on_skewed_values(spark):
    values = skewed()
    df = spark.createDataFrame([(float(v), 1) for v in values], "value double, c long")
    placed = metrics.bucketed(df, [], "value", 256)
    largest = placed.groupBy("__bucket").count().agg(F.max("count")).first()[0]
    assert largest < 0.01 * len(values)
    for lower, upper in placed.groupBy("__bucket").agg(F.min("value").alias("a"), F.max("value").alias("b")).orderBy("__bucket").selectExpr("b", "lead(a) over (order by a) as n").where("n is not null").collect():
        assert lower < upper
    run = metrics.running(df, [], "value", ["c"]).select("value", "upto_c").orderBy("value").collect()
    assert [r["upto_c"] for r in run] == list(range(1, len(values) + 1))


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_in_null_and_small_groups(spark, descending):
    rng = np.random.default_rng(2)
    rows = [(g, float(v), int(c)) for g in (None, "a", "b") for v, c in zip(range(50), rng.integers(0, 5, 50))] + [("one", 3.0, 2)]
    df = spark.createDataFrame(rows, "g string, value double, c long")
    got = metrics.running(df, ["g"], "value", ["c"], descending, buckets=16).collect()
    assert len(got) == len(rows)
    for r in got:
        own = [(v, c) for g, v, c in rows if g == r["g"]]
        assert r["all_c"] == sum(c for _, c in own)
        assert r["upto_c"] == sum(c for v, c in own if (v >= r["value"] if descending else v <= r["value"]))


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(3)
    points = [0.0, 0.1, 0.25, 0.5, 0.9, 0.95, 1.0]
    rows = [("a", float(v), 1) for v in rng.normal(size=501)] + [("b", float(v), int(w)) for v, w in zip(rng.integers(0, 20, 60), rng.integers(1, 6, 60))] + [("c", 2.5, 1), (None, 1.0, 1), (None, 4.0, 1), ("a", None, 1)]
    df = spark.createDataFrame(rows, "g string, v double, w long")
    got = {r["g"]: r["quantiles"] for r in metrics.quantiles(df, ["g"], "v", points, "w").collect()}
    for g in ("a", "b", "c", None):
        own = np.repeat([v for k, v, _ in rows if k == g and v is not None], [w for k, v, w in rows if k == g and v is not None])
        assert np.allclose(got[g], np.quantile(own, points), rtol=1e-12, atol=1e-12)
    assert metrics.quantiles(df.where("false"), ["g"], "v", points).count() == 0


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(resample, "PART", 9)
    monkeypatch.setattr(resample, "SLICE", 4)


def resampled(values, days, draw):
    return np.concatenate([values[days == d] for d, m in draw.items() for _ in range(m)] or [values[:0]])


def case(spark, n=400, iters=12):
    rng = np.random.default_rng(5)
    days, score, label = rng.integers(0, 9, n), rng.integers(0, 60, n) / 60, rng.integers(0, 2, n)
    drawn = [dict(zip(*np.unique(rng.choice(10, 5), return_counts=True))) for _ in range(iters)]
    rows = [(i, int(d), int(m)) for i, draw in enumerate(drawn) for d, m in draw.items()]
    return days, score, label, drawn, resample.Draws(spark.createDataFrame(rows, "iter int, day long, mult long"))


def average_precision(y, p):
    order = np.argsort(-p, kind="stable")
    y, p = y[order], p[order]
    last = np.flatnonzero(np.append(p[1:] != p[:-1], True))
    hits, seen = np.cumsum(y)[last], last + 1
    return float((np.diff(hits, prepend=0) * hits / seen).sum() / y.sum())


def test_resampled_ranking_and_calibration(spark, small_parts):
    days, score, label, drawn, draws = case(spark)
    counts = spark.createDataFrame([(int(d), float(s), int(y), 1) for d, s, y in zip(days, score, label)], "day long, score double, p long, n long").groupBy("day", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    ap = {r["iter"]: r["pr_auc"] for r in resample.ranking(counts, draws).collect()}
    ece = {r["iter"]: r["ece"] for r in resample.calibration_error(counts, draws).collect()}
    for i, draw in enumerate(drawn):
        s, y = resampled(score, days, draw), resampled(label, days, draw)
        assert ap[i] == pytest.approx(average_precision(y, s), abs=1e-12)
        edges = np.unique(np.round(np.quantile(s, np.linspace(0, 1, 11)), 9))
        at = np.searchsorted(edges[1:-1], s, side="left")
        assert ece[i] == pytest.approx(sum(abs(y[at == b].sum() - s[at == b].sum()) for b in np.unique(at)) / len(s), abs=1e-9)


def wasserstein(a, b):
    both = np.sort(np.concatenate([a, b]))
    gaps = np.diff(both)
    share = [np.searchsorted(np.sort(x), both[:-1], side="right") / len(x) for x in (a, b)]
    return float((np.abs(share[0] - share[1]) * gaps).sum())


def test_resampled_distances(spark, small_parts):
    days, score, label, drawn, draws = case(spark)
    values = np.round(np.exp(5 * score), 3)
    rows = [(int(d), "x", float(v)) for d, v in zip(days, values)] + [(int(d), "y", float(y)) for d, y in zip(days, label)]
    df = spark.createDataFrame(rows, "day long, feature string, value double")
    counts = df.groupBy("day", "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    got = {(r["iter"], r["feature"]): r["value"] for r in resample.wasserstein(counts, drift.reference_scale(df), draws).collect()}
    levels = counts.withColumn("value", F.col("value").cast("string"))
    js = {(r["iter"], r["feature"]): r["value"] for r in resample.category_distance(levels, draws, 1e-6).collect()}
    for feature, own in (("x", values), ("y", label.astype(float))):
        q = np.quantile(own, [0.25, 0.75])
        scale = max(q[1] - q[0], own.std(), 1e-6)
        known, whole = np.unique(own, return_counts=True)
        for i, draw in enumerate(drawn):
            s = resampled(own, days, draw)
            assert got[i, feature] == pytest.approx(wasserstein(s, own) / scale, abs=1e-9)
            a = np.array([(s == v).sum() for v in known]) + 1e-6
            e = whole + 1e-6
            a, e = a / a.sum(), e / e.sum()
            m = (a + e) / 2
            assert js[i, feature] == pytest.approx(np.sqrt(max(((a * np.log2(a / m)).sum() + (e * np.log2(e / m)).sum()) / 2, 0)), abs=1e-9)
