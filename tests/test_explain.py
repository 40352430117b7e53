"""Shapley values against the definition and against the model's margin."""

from __future__ import annotations

import random
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskmon.operators import explain, models


def value(leaf, x, known):
    out = leaf.value
    for f, (low, high, share) in leaf.splits.items():
        out *= float(low < x[f] <= high) if f in known else share
    return out


def test_leaf_formula_is_the_shapley_value():
    rnd = random.Random(1)
    found = [explain.Leaf(rnd.gauss(0, 1), {f: (-1.0, rnd.gauss(0, 1), rnd.random()) for f in rnd.sample(range(4), 3)}) for _ in range(6)]
    x = np.array([[rnd.gauss(0, 1) for _ in range(4)] for _ in range(3)])
    phi, base = explain.shapley(x, found)
    for row, got in zip(x, phi):
        for f in range(4):
            want, others = 0.0, [g for g in range(4) if g != f]
            for k in range(4):
                for s in combinations(others, k):
                    gain = sum(value(leaf, row, {*s, f}) - value(leaf, row, set(s)) for leaf in found)
                    want += factorial(k) * factorial(3 - k) / factorial(4) * gain
            assert got[f] == pytest.approx(want)
        assert got.sum() + base == pytest.approx(sum(value(leaf, row, set(range(4))) for leaf in found))


def test_attributions_add_up_to_the_margin(spark):
    rnd = random.Random(2)
    rows = spark.createDataFrame([(i, rnd.gauss(0, 1), rnd.random() if i % 7 else None, rnd.random(), int(rnd.random() < 0.3 + 0.4 * (i % 2)), float(i % 2)) for i in range(300)], "id int, x double, y double, z double, label int, odd double")
    columns = ["x", "y", "z", "odd"]
    model = models.boosted_trees(rows, columns, maxIter=4, maxDepth=3)
    long = explain.attributions(rows, model, columns, ["id", "label"])
    _, base = explain.shapley(np.zeros((1, 4)), explain.leaves(model))
    margin = {r["id"]: r["m"] for r in model.transform(rows.na.fill(-1e9, columns)).select("id", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    for r in long.groupBy("id").agg(F.sum("phi").alias("s")).collect():
        assert r["s"] + base == pytest.approx(margin[r["id"]], abs=1e-9)
    top = explain.summary(long, []).orderBy(F.desc("mean_abs")).first()
    assert top["feature"] == "odd" and top["mean_positive"] > top["mean_negative"]


def test_categories_are_split_into_sets(spark):
    rnd, odd = random.Random(4), {1, 4, 6, 9}
    rows = spark.createDataFrame([(i, float(i % 12), rnd.random(), int(i % 12 in odd)) for i in range(480)], "id int, level double, x double, label int")
    one = {"maxIter": 1, "maxDepth": 1}
    found = explain.tree_leaves(models.boosted_trees(rows, ["level", "x"], levels={"level": 12}, **one))[0]
    assert sorted(sorted(leaf.splits[0][3] & set(range(12))) for leaf in found) == [sorted({*range(12)} - odd), sorted(odd)]
    by_order = explain.tree_leaves(models.boosted_trees(rows, ["level", "x"], **one))[0]
    assert all(len(leaf.splits[0]) == 3 for leaf in by_order if 0 in leaf.splits)
    noisy = rows.withColumn("label", F.when(F.col("x") > 0.9, 1 - F.col("label")).otherwise(F.col("label")))
    model = models.boosted_trees(noisy, ["level", "x"], levels={"level": 12}, maxIter=3, maxDepth=3)
    long = explain.attributions(noisy, model, ["level", "x"], ["id"])
    _, base = explain.shapley(np.zeros((1, 2)), explain.leaves(model))
    margin = {r["id"]: r["m"] for r in model.transform(noisy).select("id", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    for r in long.groupBy("id").agg(F.sum("phi").alias("s")).collect():
        assert r["s"] + base == pytest.approx(margin[r["id"]], abs=1e-9)
    last = {r["id"]: r["margin"] for r in explain.staged_margins(noisy, model, ["level", "x"], ["id"]).where("trees = 3").collect()}
    assert last == pytest.approx(margin, abs=1e-9)
    # More categories than the usual bins.
    models.boosted_trees(rows.withColumn("level", (F.col("id") % 40).cast("double")), ["level", "x"], levels={"level": 40}, **one)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 300])
def test_isotonic_steps_are_found_by_halving(spark, n):
    rnd = random.Random(n)
    bounds, values = sorted(rnd.random() for _ in range(n)), sorted(rnd.random() for _ in range(n))
    asked = [-1.0, 0.0, 2.0, *bounds, *(rnd.random() for _ in range(50))]
    rows = spark.createDataFrame([(x,) for x in asked], "raw double").select("raw", models.Calibrator("isotonic", bounds=tuple(bounds), values=tuple(values)).apply(F.col("raw")).alias("p"))
    for r in rows.collect():
        assert r["p"] == pytest.approx(float(np.interp(r["raw"], bounds, values)), abs=1e-12)
