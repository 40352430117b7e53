"""The Parzen sampler, fold-wise preparation, samples with their complement, and long paths of Shapley values."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskmon.operators import challenger, diagnosis, explain, features, models, tuning


def planted(p):
    """The largest value, 0, lies at one point of the space."""
    return -sum(((r.place(p[k]) - (0.3 * r.ends()[0] + 0.7 * r.ends()[1])) / (r.ends()[1] - r.ends()[0])) ** 2 for k, r in tuning.SPACE.items())


def test_sampler_beats_random_search():
    adaptive = [max(v for _, v in tuning.search(planted, 60, seed=s)[1]) for s in range(8)]
    blind = [max(v for _, v in tuning.search(planted, 60, seed=s, startup=60)[1]) for s in range(8)]
    assert np.mean(adaptive) > 0.6 * np.mean(blind) and np.mean([a > b for a, b in zip(adaptive, blind)]) >= 0.75
    best, seen = tuning.search(planted, 20, seed=3, parallel=4)
    assert (best, seen) == tuning.search(planted, 20, seed=3, parallel=4) and len(seen) == 20
    assert planted(best) == max(v for _, v in seen)
    for p, _ in seen:
        assert set(p) == set(tuning.SPACE) and all(r.low <= p[k] <= r.high for k, r in tuning.SPACE.items())


def fold_table(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(400):
        block = 1 + i // 80
        rows.append((i, block, rnd.choice("ab") if block < 4 else "late", str(rnd.randrange(4 * block)) if i % 9 else None, float(i % 5) if block > 3 else 1.0, None if block < 4 else 2.0, int(rnd.random() < 0.2 + 0.5 * (i % 5 == 4))))
    return spark.createDataFrame(rows, "event_id int, development_block int, c string, many string, x double, gone double, label int")


def test_no_fold_sees_later_levels(spark):
    df = fold_table(spark)
    folds = {f"f{k}": F.col("development_block") <= k for k in (2, 3, 4)}
    fitted = features.fit_folds(df, folds, ["c", "many"], ["x", "gone"], cardinality_limit=8)
    for k in (2, 3, 4):
        own = features.Preprocessor(["c", "many"], ["x", "gone"], cardinality_limit=8).fit(df.where(F.col("development_block") <= k))
        got = fitted[f"f{k}"]
        assert sorted(got.dropped) == sorted(own.dropped) and got.levels == own.levels and set(got.frequencies) == set(own.frequencies)
        for c, table in own.frequencies.items():
            assert {r["value"]: r["frequency"] for r in table.collect()} == pytest.approx({r["value"]: r["frequency"] for r in got.frequencies[c].collect()})
    assert "late" not in fitted["f3"].levels["c"] and "late" in fitted["f4"].levels["c"] and set(fitted["f2"].dropped) == {"x", "gone"}


def test_objective_of_the_folds(spark):
    score = tuning.fold_objective(fold_table(spark), ["c", "many"], ["x"], keep=lambda df: df.cache(), limit=8)
    plain = {"maxDepth": 2, "maxIter": 3, "stepSize": 0.2, "subsamplingRate": 1.0, "feature_share": 1.0}
    assert 0 < score(plain) <= 1 and score(plain) == score(plain)


def test_sample_and_its_complement(spark):
    df = spark.range(500).select(F.col("id").alias("event_id"), F.when(F.col("id") % 50 == 0, 1).when(F.col("id") % 7 == 0, None).otherwise(0).alias("label")).repartition(5)
    sample, rest = diagnosis.sample_and_rest(df, 60)
    taken, left = ({r["event_id"] for r in part.collect()} for part in (sample, rest))
    assert len(taken) == 60 and taken | left == set(range(500)) and not taken & left
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    want = diagnosis.class_shares({r["label"]: r["count"] for r in df.groupBy("label").count().collect()}, 60)
    assert counts == want
    # The smallest hashes of each class, whatever the partitions.
    hashed = df.withColumn("h", F.xxhash64("event_id")).collect()
    for label, n in want.items():
        own = sorted((r["h"], r["event_id"]) for r in hashed if r["label"] == label)[:n]
        assert {i for _, i in own} <= taken
    sample, rest = diagnosis.sample_and_rest(df, 1000)
    assert sample.count() == 500 and rest.count() == 0


def test_shapley_values_of_long_paths():
    rng = np.random.default_rng(4)
    leaf = explain.Leaf(2.0, {f: (-0.5, 0.5, float(rng.uniform(0.3, 0.9))) for f in range(24)})
    x = rng.normal(size=(50, 24)) * 0.3
    began = time.perf_counter()
    phi, base = explain.shapley(x, [leaf])
    # All 2^24 sets of features would take hours.
    assert time.perf_counter() - began < 5
    inside = ((x > -0.5) & (x <= 0.5)).all(axis=1)
    assert np.allclose(phi.sum(axis=1) + base, np.where(inside, 2.0, 0.0), atol=1e-12)


def test_trees_stop_at_the_best_average_precision(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=500) > 1).astype(int)
    rows = spark.createDataFrame([(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y))], "id int, a double, b double, c double, label int")
    train, valid, columns = rows.where("id < 350"), rows.where("id >= 350"), ["a", "b", "c"]
    model, values = models.boosted_trees_by_precision(train, valid, columns, maxIter=7, maxDepth=3, stepSize=0.5)
    brute = []
    for k in range(1, 8):
        scored = models.score(models.boosted_trees(train, columns, maxIter=k, maxDepth=3, stepSize=0.5), valid, columns).collect()
        brute.append(challenger.average_precision(np.array([r["label"] for r in scored]), np.array([r["score"] for r in scored])))
    assert values == pytest.approx(brute, abs=1e-9)
    assert len(model.stages[-1].trees) == 1 + int(np.argmax(brute))
