"""Streams of reordered files against the batch answers: labels, actions, late rows, features."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from riskmon.operators import causal, monitoring
from riskmon.streaming import causal as stream_causal
from riskmon.streaming import labels, late, policy

START = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def files(spark, rows, schema, folder, pieces):
    """One Parquet folder read file by file, in the order in which the pieces are written."""
    for i, piece in enumerate(pieces):
        spark.createDataFrame([rows[k] for k in piece], schema).coalesce(1).write.parquet(f"{folder}/in/p{i:03d}")
        for name in os.listdir(f"{folder}/in/p{i:03d}"):
            os.utime(f"{folder}/in/p{i:03d}/{name}", (1_700_000_000 + 10 * i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def finished(df, folder, mode="append"):
    query = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def test_delayed_labels(spark, tmp_path):
    rnd = random.Random(3)
    scores = [(i, START + i * HOUR, i / 100) for i in range(40)]
    given = [(i, START + i * HOUR, START + i * HOUR + rnd.choice([1, 5, 24, 30, -1]) * HOUR, i % 2) for i in range(0, 40, 2)]
    # A last row moves both watermarks past everything.
    far = START + 1000 * HOUR
    schemas = "event_id long, event_time timestamp, score double", "event_id long, event_time timestamp, label_time timestamp, label int"
    order = list(range(40))
    swapped = [order[4:8], order[:4], *[order[k : k + 8] for k in range(8, 40, 8)]]
    by_label = sorted(range(20), key=lambda k: given[k][2])
    left = files(spark, [*scores, (900, far, 0.0), (901, far, 0.0)], schemas[0], f"{tmp_path}/s", [*swapped, [40], [41]])
    right = files(spark, [*given, (902, far, far, 1), (903, far, far, 1)], schemas[1], f"{tmp_path}/l", [by_label[5:10], by_label[:5], by_label[10:], [20], [21]])
    got = finished(labels.labelled_scores(left, right, "24 hours", "100 hours"), str(tmp_path)).where("event_id < 900")
    tables = spark.createDataFrame(scores, schemas[0]), spark.createDataFrame(given, schemas[1])
    want = labels.labelled_scores(*tables, "24 hours", "100 hours")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 40
    fine, side = labels.split_labels(tables[1], "24 hours")
    assert want.where("label is not null").count() == fine.count() and fine.count() + side.count() == 20
    assert {r["event_id"] for r in side.collect()} == {i for i, e, t, _ in given if not e <= t <= e + 24 * HOUR}


BATCH = "stream string, batch int, batch_time timestamp, drift_severity string, performance_severity string, primary_critical boolean, label_status string"


def test_actions_and_stale_batches(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(s, b, START + 24 * b * HOUR, rnd.choice(["healthy", "warning", "critical"]), rnd.choice(["healthy", "warning", "warning", "critical"]), rnd.random() < 0.5, "mature") for b in range(1, 13) for s in ("a", "b")]
    rows += [(s, b, START + 24 * b * HOUR, "warning", "unavailable", False, "pending") for b in (13, 14) for s in ("a", "b")]
    far = [("z", b, START + (2000 + b) * HOUR, "healthy", "healthy", False, "mature") for b in (1, 2)]
    # The labels of stream b's batch 13 come, those of the others never do.
    again = [("b", 13, START + 24 * 14 * HOUR, "warning", "healthy", False, "mature")]
    everything = [*rows, *again, *far]
    n = len(rows)
    pieces = [range(0, 7), range(7, 8), range(8, 20), range(20, n), [n], [n + 1], [n + 2]]
    got = finished(policy.action_stream(files(spark, everything, BATCH, str(tmp_path), pieces), 7 * 86_400), str(tmp_path)).where("stream <> 'z'").collect()
    want = monitoring.actions(spark.createDataFrame(rows, BATCH)).collect()
    first = {(r["stream"], r["batch"], r["label_status"]): (r["action"], r["action_evidence"]) for r in got}
    assert {(r["stream"], r["batch"], r["label_status"]): (r["action"], r["action_evidence"]) for r in want}.items() <= first.items()
    assert sorted((r["stream"], r["batch"]) for r in got if r["label_status"] == "stale") == [("a", 13), ("a", 14), ("b", 14)]
    assert all((r["action"], r["action_evidence"]) == ("investigate", policy.STALE) for r in got if r["label_status"] == "stale")
    assert len(got) == len(rows) + 1 + 3


def test_late_rows_go_to_the_second_sink(spark, tmp_path):
    rows = [(1, 100), (2, 150), (3, 130), (4, 90), (5, 200), (6, 139), (7, 140), (8, None), (9, 190), (10, 189)]
    source = files(spark, rows, "event_id long, t long", str(tmp_path), [[0, 1], [2, 3, 4], [5, 6, 7], [8, 9]])
    folder = f"{tmp_path}/split"
    late.split_late(source, folder, "t", 10, f"{tmp_path}/checkpoint").awaitTermination(240)
    kept, dead = (sorted((r["batch_id"], r["event_id"]) for r in spark.read.parquet(f"{folder}/{name}").collect()) for name in ("accepted", "dead_letter"))
    # Watermarks: none, 140, 190, 190.
    assert kept == [(0, 1), (0, 2), (1, 5), (3, 9)]
    assert dead == [(1, 3), (1, 4), (2, 6), (2, 7), (2, 8), (3, 10)]
    # A micro-batch that is run again leaves the same rows.
    late.splitter(folder, "t", 10)(spark.createDataFrame(rows[2:5], "event_id long, t long"), 1)
    assert sorted((r["batch_id"], r["event_id"]) for r in spark.read.parquet(f"{folder}/accepted").collect()) == kept


@pytest.mark.parametrize("seed", [1, 2])
def test_features_of_a_stream_out_of_order(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = [(i, f"k{i % 3}", 1000 + 60 * (i // 4), None if i % 7 == 0 else float(rnd.randint(0, 9))) for i in range(60)]
    # Times are split over files and disordered within ten minutes.
    order = sorted(range(60), key=lambda i: rows[i][2] + rnd.randint(0, 500))
    schema = "event_id long, key string, t long, amount double"
    ends = [(1000 + i, "end", 10_000_000 + i, 1.0) for i in range(2)]
    source = files(spark, [*rows, *ends], schema, str(tmp_path), [*[order[k : k + 11] for k in range(0, 60, 11)], [60], [61]])
    got = finished(stream_causal.ordered_causal_stream(source, "10 minutes"), str(tmp_path)).where("key <> 'end'")
    table = spark.createDataFrame(rows, schema)
    want = causal.add_causal(table, "k", ["key"])
    names = ("prior_count", "hours_since_previous", "prior_amount_mean", "amount_to_prior_mean")
    batch = {r["event_id"]: [r[f"k_{n}"] for n in names] for r in want.collect()}
    found = {r["event_id"]: [r[n] for n in names] for r in got.collect()}
    assert set(found) == set(batch)
    for i, values in found.items():
        assert values == pytest.approx(batch[i], nan_ok=True) or [None if v is None or v != v else round(v, 5) for v in values] == [None if v is None else round(v, 5) for v in batch[i]]
