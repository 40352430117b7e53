"""Bundles, challengers, the replay, settings and the commands around them."""

from __future__ import annotations

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from riskmon import cli, config
from riskmon.operators import features, lifecycle, temporal
from riskmon.plans import preparation, replay
from riskmon.sources import ingest

CATEGORIES = ["product", "user_id"]
DAY = 86_400


@pytest.fixture(scope="module")
def rows(spark):
    rnd, data = random.Random(5), []
    for i in range(4000):
        late, user = i > 3000, rnd.randrange(40)
        amount = rnd.choice([None, *[rnd.uniform(1, 100)] * 9])
        risk = 0.6 if (amount or 0) > 80 else 0.05
        data.append((i, i * 60 * DAY // 4000, amount, user, rnd.choice("ab") if not late else rnd.choice("abc"), int(rnd.random() < risk)))
    df = spark.createDataFrame(data, "event_id long, t long, amount double, user_id long, product string, label int")
    return temporal.assign_partitions(df, temporal.time_bounds(df), batch_seconds=2 * DAY).cache()


@pytest.fixture(scope="module")
def made(rows):
    return lifecycle.engineer(rows, CATEGORIES).cache()


@pytest.fixture(scope="module")
def champion(made):
    return lifecycle.train_champion(made, CATEGORIES, limit=20, maxIter=4)


def test_scores_and_round_trip(spark, made, champion, tmp_path):
    champion.save(f"{tmp_path}/bundle")
    again = lifecycle.load(spark, f"{tmp_path}/bundle")
    assert again.version == champion.version and again.threshold == champion.threshold
    assert list(again.preprocessor.frequencies) == ["in_user_id"]
    held = made.where("production_batch is not null")
    got = {r["event_id"]: r["score"] for r in again.score(held).collect()}
    want = champion.score(held)
    assert set(want.columns) == {*made.columns, "score"}
    assert {r["event_id"]: r["score"] for r in want.collect()} == got and all(0 <= s <= 1 for s in got.values())
    high, low = want.groupBy(F.coalesce(F.col("amount") > 80, F.lit(False)).alias("h")).agg(F.avg("score")).orderBy(F.desc("h")).collect()
    assert high[1] > 3 * low[1]


def test_refused_bundles(spark, champion, tmp_path):
    spark.createDataFrame([(json.dumps({"kind": "other"}), "x")], "state string, version string").write.parquet(f"{tmp_path}/other/state")
    with pytest.raises(TypeError):
        lifecycle.load(spark, f"{tmp_path}/other")
    champion.model.save(f"{tmp_path}/odd/model")
    champion.preprocessor.frequencies["in_user_id"].write.parquet(f"{tmp_path}/odd/frequency/in_user_id")
    spark.createDataFrame([(json.dumps(champion.state() | {"threshold": 0.123}), champion.version)], "state string, version string").write.parquet(f"{tmp_path}/odd/state")
    with pytest.raises(ValueError):
        lifecycle.load(spark, f"{tmp_path}/odd")


def test_a_score_sees_only_earlier_rows(made, rows, champion):
    cut = 40 * DAY
    whole = {r["event_id"]: r["score"] for r in champion.score(made.where(F.col("t") < cut)).collect()}
    part = {r["event_id"]: r["score"] for r in champion.score(lifecycle.engineer(rows.where(F.col("t") < cut), CATEGORIES)).collect()}
    assert whole == part


def test_attributions_add_up_to_the_margin(made, champion):
    few = made.where("event_id < 50")
    total = lifecycle.attributions(champion, few, ["event_id"]).groupBy("event_id").agg(F.sum("phi").alias("phi"))
    margin = champion.model.transform(champion.inputs(few).na.fill(-1e9, champion.columns)).select("event_id", "rawPrediction")
    gaps = [r["rawPrediction"][1] - r["phi"] for r in margin.join(total, "event_id").collect()]
    assert len(gaps) == 50 and max(gaps) - min(gaps) < 1e-9


def test_challenger_trial(spark, made, champion):
    equal = lifecycle.evaluate_challenger(made, champion, CATEGORIES, ["product"], iterations=40, minimum_positive=5)
    row = equal.summary.first()
    assert row["last_calibration"] < row["first_evaluation"] == row["last_evaluation"] - 1 == equal.last_batch - 1
    assert row["training_rows"] == made.where(F.col("production_batch").isNull() | (F.col("production_batch") < row["first_calibration"])).count()
    assert row["pr_auc_lower"] <= row["pr_auc_upper"] and row["retrain_recommended"] == equal.recommended
    assert equal.recommended == (row["pr_auc_lower"] > 0 and row["recall_lower"] >= 0 and row["regressed_segments"] == 0)
    asked = spark.createDataFrame([(b, "investigate") for b in range(1, equal.last_batch + 3)], "batch int, action string")
    held = lifecycle.record_trial(asked, equal).where("challenger_evaluated").collect()
    assert [r["batch"] for r in held] == [equal.last_batch] and held[0]["challenger_outcome"] == row["outcome"]
    with pytest.raises(ValueError):
        lifecycle.record_trial(asked.where("batch = 1"), equal)


def test_replay_writes_every_table(spark, rows, champion, tmp_path):
    late = rows.where("event_id % 8 = 0").select((F.col("event_id") + 10_000).alias("event_id"), (F.col("t") + 60 * DAY).alias("t"), "amount", "user_id", "product")
    shadow = temporal.assign_shadow_batches(late, 60 * DAY, 30 * DAY)
    settings = config.Settings(iterations=30, minimum_positive=5, top_features=3)
    paths = replay.run(spark, rows, champion, f"{tmp_path}/out", CATEGORIES, ["product"], ["amount"], settings, shadow, "data-1")
    tables = {name: spark.read.parquet(path) for name, path in paths.items()}
    numbers = {("production", r[0]) for r in rows.where("production_batch is not null").select("production_batch").distinct().collect()}
    everything = numbers | {("shadow", r[0]) for r in shadow.select("shadow_batch").distinct().collect()}
    assert {(r["stream"], r["batch"]) for r in tables["batches"].collect()} == everything == {(r["stream"], r["batch"]) for r in tables["recommendations"].collect()}
    assert tables["scored"].count() == rows.count() + shadow.count()
    features = {r[0] for r in tables["drift"].select("feature").distinct().collect()}
    assert "amount" in features and len(features) in (3, 4)
    assert tables["drift"].count() == 3 * len(features) * len(everything) and tables["performance"].count() == 8 * len(numbers)
    latest = max(n for _, n in numbers)
    pending = tables["performance"].where(F.col("batch") > latest - 2).select("status").distinct().collect()
    assert [r[0] for r in pending] == ["unavailable"]
    # Labels that are not mature reach neither segments nor batch records.
    assert {r[0] for r in tables["segments"].select("batch").distinct().collect()} == {n for _, n in numbers if n <= latest - 2}
    blank = tables["batches"].where(F.col("label_status") != "mature").where("recall is not null or pr_auc is not null or fraud_amount is not null")
    assert blank.count() == 0
    of_shadow = tables["batches"].where("stream = 'shadow'").select("label_status", "performance_severity", "label_available_at_batch").distinct().collect()
    assert [tuple(r) for r in of_shadow] == [("unavailable", "unavailable", None)]
    assert {(r["model_version"], r["data_version"]) for r in tables["recommendations"].collect()} == {(champion.version, "data-1")}
    assert {r["feature"] for r in tables["attributions"].collect()} >= {"amount", "user_id__frequency"}
    flagged = tables["batches"].where("drift_severity <> 'healthy' or performance_severity in ('warning', 'critical')")
    assert tables["investigations"].count() == flagged.count()
    assert {"classification", "likely_driver", "top_false_negative_segment", "top_false_positive_segment", "top_prevalence_segment"} <= set(tables["investigations"].columns)


def test_settings(tmp_path, capsys):
    assert cli.main(["show-config"]) == 0 and json.loads(capsys.readouterr().out)["review_rate"] == 0.02
    for wrong in ({"period_ends": [0.6, 0.5, 0.7, 1.0]}, {"review_rate": 0.3}, {"iterations": 0}, {"warning_quantile": 0.99}, {"development_blocks": 2}, {"other": 1}):
        Path(tmp_path, "s.json").write_text(json.dumps(wrong))
        with pytest.raises(ValueError):
            config.load(f"{tmp_path}/s.json")


def test_commands_from_files_to_a_trial(spark, tmp_path, capsys):
    with pytest.raises(FileNotFoundError):
        ingest.required_files(spark, str(tmp_path), ("train_transaction.csv",))
    rnd = random.Random(2)
    lines = [f"{i},{int(rnd.random() < (0.7 if i % 10 > 7 else 0.05))},{i * 8000},{i % 10}.5,{'WC'[i % 2]},{i % 30},{i % 3 or ''}" for i in range(2000)]
    later = [f"{i},{i * 8000},{i % 10}.5,{'WC'[i % 2]},{i % 30},{i % 3}" for i in range(2001, 2201)]
    Path(tmp_path, "train_transaction.csv").write_text("\n".join(["TransactionID,isFraud,TransactionDT,TransactionAmt,ProductCD,card1,C1", *lines]))
    Path(tmp_path, "train_identity.csv").write_text("\n".join(["TransactionID,id-01,id-12", *(f"{i},{i % 4},{'xy'[i % 2]}" for i in range(0, 2000, 4))]))
    Path(tmp_path, "test_transaction.csv").write_text("\n".join(["TransactionID,TransactionDT,TransactionAmt,ProductCD,card1,C1", *later]))
    Path(tmp_path, "test_identity.csv").write_text("TransactionID,id-01,id-12,id-13\n2001,1,x,z\n")
    Path(tmp_path, "s.json").write_text(json.dumps({"iterations": 20, "minimum_positive": 3, "minimum_negative": 3, "trials": 1}))
    chosen = ["--config", f"{tmp_path}/s.json"]
    assert cli.main(["prepare", *chosen, str(tmp_path), f"{tmp_path}/out"]) == 0
    made = ingest.read_manifest(spark, f"{tmp_path}/out/manifest")
    assert set(made["source_files"]) == {*config.Settings().expected_files, *config.Settings().later_files} and made["source_files"]["train_transaction.csv"]["lines"] == 2001
    assert made["train"]["rows"] == sum(made["train"]["period_rows"].values()) == 2000 and made["train"]["identity_coverage"] == 0.25
    assert (made["train"]["minimum_time"], made["train"]["maximum_time"]) == (0, 1999 * 8000) and made["train"]["schema"]["C1"] == made["train"]["schema"]["id_01"] == "double"
    assert made["train"]["missing_fraction"]["C1"] == pytest.approx(667 / 2000) and made["test"]["rows"] == 200 and "prevalence" not in made["test"]
    assert made["train"]["prevalence"] == pytest.approx(sum(line.split(",")[1] == "1" for line in lines) / 2000)
    assert [f["validation_block"] for f in made["development_folds"]] == [3, 4, 5]
    assert cli.main(["train", *chosen, f"{tmp_path}/out", f"{tmp_path}/models"]) == 0
    bundle = capsys.readouterr().out.strip().splitlines()[-1]
    assert spark.read.parquet(f"{tmp_path}/models/runs").count() == 1
    report = json.loads(spark.read.text(f"{bundle}/report").first()[0])
    assert report["data_version"] == preparation.data_version(made) and report["tuning"]["trials"] == 1
    known = report["acceptance_intervals"]["pr_auc"]
    assert known["lower"] <= known["value"] <= known["upper"] and known["value"] == pytest.approx(report["acceptance_metrics"]["pr_auc"])
    assert report["acceptance_intervals"]["recall"]["value"] == pytest.approx(report["acceptance_metrics"]["recall"])
    assert report["baseline_pr_auc"]["prior"] == pytest.approx(report["acceptance_metrics"]["prevalence"])
    assert min(known["value"], report["baseline_pr_auc"]["logistic"]) > 2 * report["baseline_pr_auc"]["prior"]
    assert {"in_C1", "in_id_01", "in_id_12", "in_missing_count_transaction"} <= set(report["importances"])
    budgets = spark.read.parquet(f"{bundle}/review_budgets").orderBy("review_rate").collect()
    assert [r["review_rate"] for r in budgets] == [0.005, 0.01, 0.02, 0.05] and budgets[2]["threshold"] == report["threshold"]
    assert cli.main(["replay", *chosen, f"{tmp_path}/out", bundle, f"{tmp_path}/monitoring"]) == 0
    paths = json.loads(capsys.readouterr().out)
    tables = {name: spark.read.parquet(paths[name]) for name in ("recommendations", "batches", "contract")}
    assert {r[0] for r in tables["recommendations"].select("stream").distinct().collect()} == {"production", "shadow"}
    assert tables["batches"].where("stream = 'shadow'").agg(F.sum("rows")).first()[0] == 200
    assert {r["field"]: r["value"] for r in tables["contract"].collect()} == {
        "Model version": report["model_version"], "Data version": report["data_version"], "Review threshold": f"{report['threshold']:.3f}", "Default capacity": "2%",
    }
    assert cli.main(["retrain-eval", *chosen, f"{tmp_path}/out", bundle, f"{tmp_path}/trials"]) == 0
    trial = capsys.readouterr().out.strip().splitlines()[-1]
    assert spark.read.parquet(f"{trial}/summary").count() == 1


def test_refused_preparation(spark, tmp_path):
    Path(tmp_path, "a.csv").write_text("TransactionID,isFraud,TransactionDT,TransactionAmt\n" + "\n".join(f"{i},{i % 2},{i * 9},1" for i in range(40)))
    Path(tmp_path, "b.csv").write_text("TransactionID,id-12\n1,x\n")
    Path(tmp_path, "c.csv").write_text("TransactionID,TransactionDT,TransactionAmt\n100,351,1\n101,400,1\n")
    names = {"expected_files": ("a.csv", "b.csv"), "batch_seconds": 9}
    with pytest.raises(ValueError, match="strictly after"):
        preparation.prepare(spark, str(tmp_path), f"{tmp_path}/out", config.Settings(later_files=("c.csv", "b.csv"), **names))
    with pytest.raises(FileNotFoundError):
        preparation.prepare(spark, str(tmp_path), f"{tmp_path}/out", config.Settings(later_files=("c.csv", "absent.csv"), **names))
    with pytest.raises(FileNotFoundError):
        ingest.read_manifest(spark, f"{tmp_path}/out/manifest")
    two = preparation.prepare(spark, str(tmp_path), f"{tmp_path}/out", config.Settings(**names))
    assert "test" not in two and two["outputs"] == {"train": "train.parquet"}
    lines = Path(tmp_path, "a.csv").read_text().splitlines()
    Path(tmp_path, "d.csv").write_text("\n".join([lines[0], *reversed(lines[1:])]))
    Path(tmp_path, "e.csv").write_text("\n".join([*lines, lines[-1]]))
    first, second, third = (ingest.fingerprint(spark, f"{tmp_path}/{n}.csv") for n in "ade")
    assert first == second == two["source_files"]["a.csv"] and third["digest"] != first["digest"] and third["lines"] == 42
    ingest.write_manifest(spark, f"{tmp_path}/later", {"manifest_version": 2})
    with pytest.raises(ingest.DataValidationError):
        ingest.read_manifest(spark, f"{tmp_path}/later")
    with pytest.raises(ValueError):
        config.Settings(expected_files=("a.csv",))


def test_missing_counts_by_family(spark):
    df = spark.createDataFrame([(1, 5, None, None, None, 2.0, True), (2, 9, 1.0, "a", None, None, False)], "event_id long, t long, amount double, id_12 string, DeviceInfo string, V10 double, identity_available boolean")
    families = features.column_families([*df.columns, "M4", "Vx", "C", "missing_count_vendor"])
    assert families == {"identity": ["id_12", "DeviceInfo"], "vendor": ["V10", "M4"], "transaction": ["amount", "V10", "M4", "Vx", "C"]}
    counted = features.add_missing_counts(features.add_stateless(df)).orderBy("event_id").select(*features.COUNTS).collect()
    # The amount, its logarithm and its fraction; the vendor column counts in both families.
    assert [tuple(r) for r in counted] == [(2, 0, 3), (1, 1, 1)]
    assert features.is_categorical("id_12") and features.is_categorical("M9") and not features.is_categorical("id_11") and features.is_numeric("id_11") and not features.is_numeric("M1")
    assert [tuple(r) for r in features.add_missing_counts(df.select("event_id")).select(*features.COUNTS).distinct().collect()] == [(0, 0, 0)]
