"""Models, the streaming twin and the command line."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from riskmon import cli
from riskmon.operators import causal, models
from riskmon.streaming.causal import causal_stream


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    data = []
    for i in range(600):
        x, c = rnd.gauss(0, 1), rnd.choice(["a", "b", None])
        y = int(rnd.random() < 1 / (1 + math.exp(-(2 * x - 1 + (c == "a")))))
        data.append((i, x if i % 9 else None, rnd.random(), c, y, i * 5 // 600 + 1))
    return spark.createDataFrame(data, "id int, x double, z double, c string, label int, development_block int").cache()


def test_models_rank_better_than_the_prior(spark, rows):
    assert 0 < models.prior_score(rows) < 1
    line = models.logistic_baseline(rows, ["c"], ["x", "z"])
    out = line.transform(models.logistic_input(rows, ["c"], ["x", "z"]))
    trees = models.score(models.boosted_trees(rows, ["x", "z"], maxIter=5, maxDepth=3), rows, ["x", "z"])
    for scored in (out.withColumn("score", models.probability(out)).select("label", "score"), trees.select("label", "score")):
        held = models.ranking(scored.withColumn("g", F.lit(1)), ["g"]).first()
        assert held["roc_auc"] > 0.75
    with pytest.raises(ValueError):
        models.boosted_trees(rows.where("label = 1"), ["x"])


def test_calibrators(spark, rows):
    raw = rows.where("x is not null").select("label", (1 / (1 + F.exp(-2 * F.col("x")))).alias("raw"))
    best, figures = models.fit_calibrators(raw)
    assert set(figures) == {"sigmoid", "isotonic"} and best.kind in figures
    got = [r[0] for r in spark.createDataFrame([(0.0,), (0.2,), (0.5,), (0.9,), (1.0,)], "raw double").select(best.apply(F.col("raw"))).collect()]
    assert got == sorted(got) and 0 <= got[0] and got[-1] <= 1


def test_tuning_uses_the_temporal_folds(rows):
    best, seen = models.tune(rows, ["x", "z"], trials=1)
    assert len(seen) == 1 and seen[0][0] == best and seen[0][1] > 0.5


def test_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(3)
    data = [(i, rnd.choice("ab"), t, rnd.choice([None, float(rnd.randint(1, 9))])) for i, t in enumerate(sorted(rnd.randrange(60) for _ in range(90)))]
    schema = "event_id long, key string, t long, amount double"
    for i in range(3):
        spark.createDataFrame([r for r in data if r[2] // 20 == i], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    query = causal_stream(stream).writeStream.format("memory").queryName("causal_rows").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {r["event_id"]: r for r in spark.table("causal_rows").collect()}
    want = causal.add_causal(spark.createDataFrame(data, schema), "e", ["key"]).collect()
    late = [r for r in got.values() if r["late"]]
    assert len(got) == len(data) and not late
    for r in want:
        s = got[r["event_id"]]
        assert s["prior_count"] == r["e_prior_count"] and s["prior_amount_mean"] == r["e_prior_amount_mean"] and s["hours_since_previous"] == r["e_hours_since_previous"]


def test_cli(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "psi_by_batch" in capsys.readouterr().out
    n = 100
    (tmp_path / "train_transaction.csv").write_text("TransactionID,isFraud,TransactionDT,TransactionAmt\n" + "".join(f"{i},{i % 2},{i * 10000},{i}.5\n" for i in range(n)))
    (tmp_path / "train_identity.csv").write_text("TransactionID,id-12\n1,x\n")
    assert cli.main(["prepare", str(tmp_path), str(tmp_path / "out")]) == 0
    out = spark.read.parquet(f"{tmp_path}/out/train.parquet")
    assert out.count() == n and out.where("identity_available").count() == 1 and "id_12" in out.columns
