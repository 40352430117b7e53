"""Segments, policy, diagnosis, challenger and contracts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskmon.operators import challenger, diagnosis, monitoring
from riskmon.plans import catalogue
from riskmon.sources import export, ingest


def test_action_sequence(spark):
    rows = [("s", 1, "warning", "healthy", False, "mature"), ("s", 2, "warning", "healthy", False, "mature"), ("s", 3, "healthy", "critical", True, "mature"), ("s", 4, "healthy", "critical", True, "mature"), ("s", 5, "healthy", "healthy", False, "stale")]
    df = spark.createDataFrame(rows, "stream string, batch int, drift_severity string, performance_severity string, primary_critical boolean, label_status string")
    got = [r["action"] for r in monitoring.actions(df).orderBy("batch").collect()]
    assert got == ["continue_monitoring", "investigate", "investigate", "retrain_evaluation_required", "investigate"]


def segment_rows(spark, batches):
    rows = [(b, "product", "W", y, p, 10.0) for b in batches for y, p in ((1, 0.9), (1, 0.8), (0, 0.1), (0, 0.2))]
    return spark.createDataFrame(rows, "batch int, segment string, value string, label int, score double, amount double")


def test_pooling_and_suppression(spark):
    counts = monitoring.segment_counts(segment_rows(spark, [1, 2]), ["batch"], F.lit(0.5))
    first, second = monitoring.pooled(counts, "batch", 3, 3).orderBy("batch").collect()
    assert (first["status"], first["window_batches"], first["recall"]) == ("suppressed", 1, None)
    assert (second["status"], second["window_batches"], second["recall"], second["rows"]) == ("reported", 2, 1.0, 8)
    assert {r["status"] for r in monitoring.pooled(counts, "batch", 30, 30).collect()} == {"suppressed"}


def test_other_segment(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "mail string")
    top = monitoring.top_values(df, ["mail"], 1)
    got = sorted(r["value"] for r in monitoring.segments(df, top, ["mail"], []).collect())
    assert got == ["__OTHER__", "__OTHER__", "a", "a"]


def test_importance_ranks_and_drivers(spark):
    ref = spark.createDataFrame([("moving", 1.0), ("still", 2.0)], "feature string, mean_abs double")
    now = spark.createDataFrame([(1, "moving", 2.0), (1, "still", 2.0)], "batch int, feature string, mean_abs double")
    change = diagnosis.importance_change(ref, now, ["batch"])
    got = {r["feature"]: r for r in change.collect()}
    assert got["moving"]["change"] == 1 and got["moving"]["reference_rank"] == 2 and got["still"]["current_rank"] == 1 == got["moving"]["current_rank"]
    alerts = spark.createDataFrame([(1, "moving", "psi", 0.5, 0.1, 0.2, "critical"), (1, "still", "psi", 0.15, 0.1, 0.2, "warning")], "batch int, feature string, metric string, value double, warning_limit double, critical_limit double, severity string")
    assert [r["feature"] for r in diagnosis.rank_drivers(alerts, change, ["batch"]).orderBy("place").collect()] == ["moving", "still"]


def test_stratified_sample(spark):
    df = spark.range(20).select(F.col("id").alias("event_id"), (F.col("id") < 2).cast("int").alias("label"))
    got = diagnosis.stratified_sample(df, 10)
    assert got.count() == 10 and got.where("label = 1").count() == 1


def test_paired_bootstrap_and_decision(spark):
    rows = [(1, 1 - i / 40, i / 40) for i in range(20)] + [(0, i / 200, 0.5 + i / 200) for i in range(80)]
    df = spark.createDataFrame(rows, "label int, challenger double, champion double")
    a, b = (challenger.paired_difference(df, challenger.average_precision, iterations=60) for _ in range(2))
    assert a == b and a[1] > 0
    assert challenger.decide(a, (0.1, 0.0, 0.2), 0) and not challenger.decide(a, (0.1, -0.1, 0.2), 0)
    assert challenger.paired_difference(df.where("label = 1"), challenger.average_precision) is None


def test_segment_recall(spark):
    rows = [("s", "v", 1, 1, 0)] * 40 + [("s", "thin", 1, 1, 1)] * 3
    df = spark.createDataFrame(rows, "segment string, value string, label int, champion int, challenger int")
    (r,) = challenger.segment_recall(df, 10).collect()
    assert r["value"] == "v" and r["reliable_regression"]
    assert (r["rows"], r["positives"], r["negatives"], r["champion_recall"], r["challenger_recall"], r["recall_difference"]) == (40, 40, 0, 1.0, 0.0, -1.0)
    # Without enough negatives a segment blocks nothing.
    assert challenger.segment_recall(df, 10, 1).count() == 0
    more = df.unionByName(spark.createDataFrame([("s", "v", 0, 1, 0)] * 5, df.schema))
    assert challenger.segment_recall(more, 10, 5).count() == 1 and challenger.segment_recall(more, 10, 6).count() == 0


def test_windows_need_four_mature_batches(spark):
    df = spark.createDataFrame([(b, y) for b in range(1, 9) for y in (0, 1)], "batch int, label int")
    roles = {r["batch"]: r["role"] for r in challenger.windows(df, 2).collect()}
    assert roles == {1: "training", 2: "training", 3: "training", 4: "calibration", 5: "evaluation", 6: "evaluation"}
    with pytest.raises(ValueError):
        challenger.windows(df.where("batch <= 5"), 2)


def test_ingest(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("TransactionID,amount,id-12\n1,2.5,x\n2,NA,\n3,NaN,null\n")
    df = ingest.normalize_identity(ingest.read_csv(spark, str(path), {"TransactionID": "bigint", "amount": "double"}))
    assert df.columns == ["TransactionID", "amount", "id_12"]
    assert [tuple(r) for r in df.orderBy("TransactionID").collect()] == [(1, 2.5, "x"), (2, None, None), (3, None, None)]
    right = spark.createDataFrame([(1, "d")], "TransactionID long, device string")
    joined = ingest.join_one_to_one(df, right, "TransactionID").orderBy("TransactionID").collect()
    assert [r["identity_available"] for r in joined] == [True, False, False]
    with pytest.raises(ingest.DataValidationError):
        ingest.join_one_to_one(df, right.union(right), "TransactionID")
    with pytest.raises(ingest.DataValidationError):
        ingest.normalize_identity(spark.createDataFrame([(1, 2)], ["id-1", "id_1"]))
    bad = tmp_path / "b.csv"
    bad.write_text("TransactionID\nx\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        ingest.read_csv(spark, str(bad), {"TransactionID": "bigint"}).collect()
    assert ingest.json_safe({1: float("nan"), "a": [1.5]}) == {"1": None, "a": [1.5]}


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, TransactionID int")
    export.export_tables({"t": df}, {"t": ["a", "b"]}, str(tmp_path))
    assert export.load_tables(spark, str(tmp_path), {"t": ["a", "b"]})["t"].columns == ["a", "b"]
    for wrong in ({"t": ["a"]}, {"t": ["a", "b"], "u": ["a"]}, {}):
        with pytest.raises(ValueError):
            export.load_tables(spark, str(tmp_path), wrong)
    # An optional table may be absent; one that lies there unlisted is refused.
    held = export.load_tables(spark, str(tmp_path), {"t": ["a", "b"]}, {"u": ["c"]})
    assert held["u"].columns == ["c"] and held["u"].count() == 0
    df.select("a").write.parquet(f"{tmp_path}/u.parquet")
    with pytest.raises(ValueError):
        export.load_tables(spark, str(tmp_path), {"t": ["a", "b"]}, {"u": ["a"]})
    export.export_tables({"t": df, "u": df}, {"t": ["a", "b"], "u": ["a"]}, str(tmp_path))
    assert set(export.load_tables(spark, str(tmp_path), {"t": ["a", "b"]}, {"u": ["a"]})) == {"t", "u"}
    with pytest.raises(FileNotFoundError):
        export.load_tables(spark, f"{tmp_path}/t.parquet", {"t": ["a", "b"]})
    for columns in (["a", "missing"], ["TransactionID"]):
        with pytest.raises(ValueError):
            export.public_table(df, "t", columns)
    new = export.update_latest(spark, f"{tmp_path}/t.parquet", "a", {"b": 9})
    assert spark.read.parquet(new).first()["b"] == 9


def test_every_query_has_sql_but_those_of_fitted_models():
    assert set(catalogue.QUERIES) - set(catalogue.oracle_sql()) == set(catalogue.OF_MODELS)
    assert not set(catalogue.oracle_sql()) - set(catalogue.QUERIES)
