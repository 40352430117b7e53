"""The stratified bootstrap against resamples by hand."""

from __future__ import annotations

import numpy as np
import pytest

from riskmon.operators import bootstrap, models

ITERATIONS = 300


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(bootstrap, "BUCKET", 60)
    monkeypatch.setattr(bootstrap, "PART", 15)
    monkeypatch.setattr(bootstrap, "SLICE", 4)


def data(n=700):
    rng = np.random.default_rng(8)
    y = (rng.random(n) < 0.3).astype(int)
    # Ties within and between the scores.
    return y, np.round(0.4 * y + rng.random(n), 2), np.round(0.9 * y + rng.random(n), 1)


def metrics(y, p):
    order = np.argsort(-p, kind="stable")
    y, p = y[order], p[order]
    last = np.flatnonzero(np.append(p[1:] != p[:-1], True))
    hits, seen = np.cumsum(y)[last], last + 1
    ap = (np.diff(hits, prepend=0) * hits / seen).sum() / y.sum()
    area = sum((p[y == 1] > q).sum() + 0.5 * (p[y == 1] == q).sum() for q in p[y == 0])
    return ap, area / (y.sum() * (1 - y).sum())


def frame(spark, y, a, b):
    return spark.createDataFrame([(int(i), float(j), float(k)) for i, j, k in zip(y, a, b)], "label int, champion double, challenger double").repartition(3)


def test_metrics_of_the_very_draws(spark, small):
    y, a, b = data()
    drawn = bootstrap.draw(frame(spark, y, a, b), ["champion", "challenger"], 20)
    rows = drawn.collect()
    counts = np.array([np.frombuffer(bootstrap.zlib.decompress(r["draws"]), "<i8") for r in rows])
    label = np.array([r["label"] for r in rows])
    # Class totals stay as they are in every resample.
    assert (counts[label == 1].sum(axis=0) == y.sum()).all() and (counts[label == 0].sum(axis=0) == len(y) - y.sum()).all()
    assert len({tuple(c) for c in counts.T}) == 21
    for column in ("champion", "challenger"):
        score = np.array([r[column] for r in rows])
        got = {r["iter"]: (r["pr_auc"], r["roc_auc"]) for r in bootstrap.ranking(drawn, column, 20).collect()}
        for i in range(21):
            assert got[i] == pytest.approx(metrics(np.repeat(label, counts[:, i]), np.repeat(score, counts[:, i])), abs=1e-12)


@pytest.mark.parametrize("metric", ["pr_auc", "roc_auc", "recall"])
def test_bounds_against_brute_force(spark, small, metric):
    y, a, b = data()
    if metric == "recall":
        a, b = (a > 0.8).astype(float), (b > 1.0).astype(float)
    one = {"pr_auc": lambda y, p: metrics(y, p)[0], "roc_auc": lambda y, p: metrics(y, p)[1], "recall": lambda y, p: p[y == 1].mean()}[metric]
    rng, classes = np.random.default_rng(1), [np.flatnonzero(y == c) for c in (0, 1)]
    found = []
    for _ in range(ITERATIONS):
        at = np.concatenate([rng.choice(c, len(c)) for c in classes])
        found.append(one(y[at], b[at]) - one(y[at], a[at]))
    value, low, high = bootstrap.difference(frame(spark, y, a, b), metric, ITERATIONS)
    assert value == pytest.approx(one(y, b) - one(y, a), abs=1e-12)
    want, width = np.quantile(found, [0.025, 0.975]), np.std(found)
    assert abs(low - want[0]) < 0.5 * width and abs(high - want[1]) < 0.5 * width


def test_interval_single_class_and_repeats(spark, small):
    y, a, b = data()
    df = frame(spark, y, a, b).selectExpr("label", "challenger as score")
    low, high = models.bootstrap_interval(df, "pr_auc", 60)
    assert low < metrics(y, b)[0] < high and models.bootstrap_interval(df, "pr_auc", 60) == (low, high)
    assert models.bootstrap_interval(df.where("label = 0")) is None
    with pytest.raises(ValueError):
        models.bootstrap_interval(df, "other", 5)
