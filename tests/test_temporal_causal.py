"""Periods, folds and past-only features on small inputs."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from riskmon.operators import causal, features, temporal


def test_periods_and_blocks(spark):
    df = spark.createDataFrame([(i,) for i in range(101)], "t long")
    b = temporal.time_bounds(df)
    out = temporal.assign_partitions(df, b, blocks=5, batch_seconds=10)
    temporal.check_partitions(out)
    got = {r["t"]: r for r in out.collect()}
    assert got[49]["dataset_period"] == "development" and got[49]["development_block"] == 5
    assert got[50]["dataset_period"] == "calibration" and got[50]["development_block"] is None
    assert got[69]["dataset_period"] == "acceptance" and got[70]["production_batch"] == 1 and got[100]["production_batch"] == 4


@pytest.mark.parametrize("rows", [[], [(None,)], [(3,), (3,)]])
def test_bad_times(spark, rows):
    with pytest.raises(ValueError):
        temporal.time_bounds(spark.createDataFrame(rows, "t long"))


def test_folds_and_shadow():
    assert [f[0] for f in temporal.expanding_folds(5)] == ["blocks_1_2_to_3", "blocks_1_3_to_4", "blocks_1_4_to_5"]
    with pytest.raises(ValueError, match="strictly after"):
        temporal.check_shadow_follows(temporal.Bounds(0, 30), temporal.Bounds(30, 40))
    temporal.check_shadow_follows(temporal.Bounds(0, 30), temporal.Bounds(31, 40))


ROWS = [(1, 100, 10.0, "a"), (2, 100, 20.0, "a"), (3, 200, 30.0, "a"), (4, 300, None, "a"), (5, 300, 7.0, None), (6, 400, 1.0, None), (7, 500, 2.0, "a")]


def test_equal_times_do_not_see_each_other(spark):
    df = spark.createDataFrame(ROWS, "id int, t long, amount double, k string")
    got = {r["id"]: r for r in causal.add_causal(df, "e", ["k"]).collect()}
    assert [got[i]["e_prior_count"] for i in range(1, 8)] == [0, 0, 2, 3, 0, 1, 4]
    assert got[3]["e_prior_amount_mean"] == 15 and got[3]["e_amount_to_prior_mean"] == 2
    assert got[3]["e_hours_since_previous"] == pytest.approx(100 / 3600)
    assert got[1]["e_hours_since_previous"] is None and got[4]["e_amount_to_prior_mean"] is None
    # The row without amount counts in the denominator.
    assert got[7]["e_prior_amount_mean"] == pytest.approx(60 / 4)


def test_causal_against_state_machine(spark):
    import random

    random.seed(5)
    rows = [(i, random.randrange(40), random.choice([None, float(random.randrange(9))]), random.choice("xyz")) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, t long, amount double, k string")
    got = {r["id"]: r for r in causal.add_causal(df, "e", ["k"]).collect()}
    for i, t, amount, k in rows:
        before = [r for r in rows if r[3] == k and r[1] < t]
        assert got[i]["e_prior_count"] == len(before)
        if before:
            assert got[i]["e_prior_amount_mean"] == pytest.approx(sum(r[2] or 0 for r in before) / len(before), rel=1e-6)


def test_frozen_history(spark):
    df = spark.createDataFrame(ROWS, "id int, t long, amount double, k string")
    got = {r["id"]: r["e_prior_count"] for r in causal.add_frozen(df.where("t >= 300"), df.where("t < 300"), "e", ["k"]).collect()}
    assert got == {4: 3, 5: 0, 6: 0, 7: 3}
    with pytest.raises(ValueError, match="missing columns"):
        causal.add_causal(df, "e", ["absent"])


def test_stateless(spark):
    df = spark.createDataFrame([(0, 10.25, None, True), (43200, None, "x", None)], "t long, amount double, id_12 string, identity_available boolean")
    a, b = features.add_stateless(df, families={"identity": ["id_12"]}).orderBy("t").collect()
    assert a["amount_log1p"] == pytest.approx(math.log(11.25), rel=1e-6) and a["amount_fraction"] == 0.25
    assert b["amount_log1p"] is None and (a["missing_count_identity"], b["missing_count_identity"]) == (1, 0)
    assert (a["identity_available"], b["identity_available"]) == (1, 0) and b["hour_cos"] == pytest.approx(-1)


def test_preprocessor(spark):
    df = spark.createDataFrame([("a", "d1", 1.0, 5), ("b", "d2", 2.0, 5), ("a", "d3", 3.0, 5), (None, "d4", None, 5)], "c string, device string, x double, constant int")
    p = features.Preprocessor(["c", "device"], ["x", "constant"], cardinality_limit=3).fit(df)
    assert p.dropped == ["constant"] and p.levels == {"c": ["__MISSING__", "a", "b"]}
    new = spark.createDataFrame([("z", "d1", 1.0, 5), (None, "new", 2.0, 5)], df.schema)
    a, b = p.transform(new).orderBy("x").collect()
    assert (a["c"], a["device__frequency"]) == ("__UNKNOWN__", 0.25) and (b["c"], b["device__frequency"]) == ("__MISSING__", 0.0)
    with pytest.raises(ValueError, match="missing columns"):
        p.transform(new.drop("x"))


def test_drop_on_missing_share(spark):
    df = spark.range(4).select(F.when(F.col("id") == 0, 1.0).alias("x"), F.col("id").cast("double").alias("y"))
    assert features.Preprocessor([], ["x", "y"], missing_threshold=0.7).fit(df).dropped == ["x"]
