"""What the five queries of fitted models return, against numpy on the rows of one fixed model."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskmon.operators import challenger, diagnosis, explain, lifecycle, performance
from tests.test_lifecycle import CATEGORIES, champion, made, rows  # noqa: F401  (fixtures)


def batches(made):
    return made.where("production_batch is not null").withColumnRenamed("production_batch", "batch")


def test_metric_rows_of_the_model(made, champion):  # noqa: F811
    scored = champion.score(batches(made))
    got = {r["batch"]: r for r in performance.metric_row(scored, ["batch"], champion.threshold, "amount").collect()}
    held = scored.select("batch", "label", "score", "amount").toPandas()
    assert set(got) == set(held["batch"])
    for batch, own in held.groupby("batch"):
        y, p, r = own["label"].to_numpy(), own["score"].to_numpy(), got[batch]
        flagged = p >= champion.threshold
        assert (r["true_positive"], r["false_positive"], r["rows"]) == ((flagged & (y == 1)).sum(), (flagged & (y == 0)).sum(), len(own))
        assert r["pr_auc"] == pytest.approx(challenger.average_precision(y, p)) and r["brier_score"] == pytest.approx(((p - y) ** 2).mean())
        assert (r["score_p50"], r["score_p95"]) == pytest.approx(tuple(np.quantile(p, [0.5, 0.95])))
        assert r["fraud_amount"] == pytest.approx(own["amount"].fillna(0)[y == 1].sum())


def test_attribution_change_and_drivers(spark, made, champion):  # noqa: F811
    now = explain.summary(lifecycle.attributions(champion, batches(made), ["batch", "label"]), ["batch"])
    ref = explain.summary(lifecycle.attributions(champion, made.where("dataset_period = 'acceptance'"), ["label"]), [])
    change = diagnosis.importance_change(ref, now, ["batch"]).cache()
    leaves, names = explain.leaves(champion.model), [c.removeprefix("in_") for c in champion.columns]

    def mean_abs(part):
        held = champion.inputs(part).select("production_batch" if "production_batch" in part.columns else "batch", *[F.col(c).cast("double") for c in champion.columns]).na.fill(-1e9, champion.columns).toPandas()
        phi, _ = explain.shapley(held[champion.columns].to_numpy(), leaves)
        return held.iloc[:, 0].to_numpy(), np.abs(phi)

    _, base = mean_abs(made.where("dataset_period = 'acceptance'"))
    which, values = mean_abs(batches(made))
    got = {(r["batch"], r["feature"]): r for r in change.collect()}
    assert len(got) == len(set(which)) * len(names)
    for batch in set(which):
        own = values[which == batch].mean(axis=0)
        order = sorted(own, reverse=True)
        for k, name in enumerate(names):
            r = got[batch, name]
            assert (r["reference_mean_abs"], r["current_mean_abs"], r["change"]) == pytest.approx((base.mean(axis=0)[k], own[k], own[k] - base.mean(axis=0)[k]), abs=1e-9)
            assert abs(order[r["current_rank"] - 1] - own[k]) < 1e-9
    alerts = spark.createDataFrame(
        [(1, "amount", "psi", 0.4, 0.1, 0.2, "critical"), (1, "product", "psi", 0.15, 0.1, 0.2, "warning"), (1, "gone", "schema_missing", 1.0, 0.0, 0.0, "critical"), (1, "amount", "missingness_shift", 0.0, 0.1, 0.2, "healthy")],
        "batch int, feature string, metric string, value double, warning_limit double, critical_limit double, severity string",
    )
    drivers = diagnosis.rank_drivers(alerts, change, ["batch"]).orderBy("place").collect()
    moved = {n: got[1, n]["absolute_change"] for n in ("amount", "product")}
    score = {"amount": 4 + 3 + moved["amount"] / max(moved.values()), "product": 2 + 0.5 + moved["product"] / max(moved.values()), "gone": 4 + 5 + 2}
    assert [d["feature"] for d in drivers] == sorted(score, key=lambda n: -score[n])
    assert [d["driver_score"] for d in drivers] == pytest.approx(sorted(score.values(), reverse=True), abs=1e-6)


def test_trial_against_scored_rows(made, champion):  # noqa: F811
    trial = lifecycle.evaluate_challenger(made, champion, CATEGORIES, ["product"], iterations=20, minimum_positive=5, minimum_negative=5)
    row = trial.summary.first()
    held = made.where(F.col("production_batch").between(row["first_evaluation"], row["last_evaluation"]))
    both = trial.challenger.score(champion.score(held).withColumnRenamed("score", "champion")).select("label", "product", "champion", F.col("score").alias("challenger")).toPandas()
    y, old, new = (both[c].to_numpy() for c in ("label", "champion", "challenger"))
    assert row["pr_auc_difference"] == pytest.approx(challenger.average_precision(y, new) - challenger.average_precision(y, old))
    caught = {"champion": old >= row["champion_threshold"], "challenger": new >= row["challenger_threshold"]}
    recall = {k: v[y == 1].mean() for k, v in caught.items()}
    assert row["recall_difference"] == pytest.approx(recall["challenger"] - recall["champion"])
    found = {r["value"]: r for r in trial.segments.where("segment = 'product'").collect()}
    for value, r in found.items():
        own = (both["product"] == value).to_numpy()
        assert (r["rows"], r["positives"], r["negatives"]) == (own.sum(), (own & (y == 1)).sum(), (own & (y == 0)).sum())
        assert r["challenger_recall"] == pytest.approx(caught["challenger"][own & (y == 1)].mean()) and r["lower"] <= r["recall_difference"] <= r["upper"]
    assert row["regressed_segments"] == sum(r["reliable_regression"] for r in trial.segments.collect())
