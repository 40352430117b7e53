"""Ranking, decision and calibration metrics, for all groups at once."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = float(np.finfo(np.float64).eps)


def quantile_points(bins: int = 10) -> list[float]:
    return np.linspace(0, 1, bins + 1).tolist()


def inner(edge: Column) -> Column:
    """Edges without the first and the last."""
    return F.slice(edge, F.lit(2), F.greatest(F.size(edge) - 2, F.lit(0)))


def right_closed(value: Column, edge: Column) -> Column:
    return F.size(F.filter(inner(edge), lambda e: e < value))


def left_closed(value: Column, edge: Column) -> Column:
    return F.size(F.filter(inner(edge), lambda e: e <= value))


def cut_points(counts: DataFrame, by: list[str], value: str, buckets: int) -> DataFrame:
    """(by..., __cuts): sorted values that deal the distinct values of each group into about equal parts.

    They come from a mergeable sketch of all values, which is built on the map side
    and whose size does not depend on the input.
    """
    # One text instead of a call to the JVM for every point.
    points = ", ".join(f"{i / buckets!r}D" for i in range(1, buckets))
    sketched = F.expr(f"array_distinct(percentile_approx(cast(`{value}` as double), array({points}), {10 * buckets}))")
    return counts.groupBy(*by).agg((sketched if points else F.array().cast("array<double>")).alias("__cuts"))


def same_group(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Inner join on groups, null ones included; `right` has one row per group."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    names = [f"__of_{c}" for c in by]
    renamed = right.withColumnsRenamed(dict(zip(by, names)))
    return left.join(renamed, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names)]).drop(*names)


def bucketed(counts: DataFrame, by: list[str], value: str, buckets: int) -> DataFrame:
    """counts with `__bucket`, the number of the equal part of its group that a value falls into; higher values, higher numbers."""
    step = max(1, math.isqrt(buckets))
    # The place among every step-th cut first, then among the cuts of that step.
    coarse = F.filter("__cuts", lambda c, i: (i % step == step - 1) & (c < F.col(value)))
    held = same_group(counts, cut_points(counts, by, value, buckets), by).withColumn("__step", F.size(coarse) * step)
    fine = F.filter(F.slice("__cuts", F.col("__step") + 1, F.lit(step)), lambda c: c < F.col(value))
    return held.withColumn("__bucket", F.col("__step") + F.size(fine)).drop("__cuts", "__step")


def running(counts: DataFrame, by: list[str], value: str, columns: list[str], descending: bool = False, buckets: int = 256) -> DataFrame:
    """counts with `upto_<c>`, the sum of each column over this and all earlier values of the group, and `all_<c>`.

    `counts` holds each finite (by..., value) once. Sums are taken over equal parts of
    the group's distinct values first and inside each part then, so that no task
    orders a whole group, however its values are spread.
    """
    names = [*by, "__bucket"]
    placed = bucketed(counts, by, value, buckets)
    turned = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    before = Window.partitionBy(*by).orderBy(turned("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    per = placed.groupBy(*names).agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    per = per.select(
        *names, *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__before_{c}") for c in columns],
        *[F.sum(f"__{c}").over(Window.partitionBy(*by)).alias(f"all_{c}") for c in columns],
    )
    inside = Window.partitionBy(*names).orderBy(turned(value)).rowsBetween(Window.unboundedPreceding, 0)
    upto = {f"upto_{c}": F.col(f"__before_{c}") + F.sum(c).over(inside) for c in columns}
    return same_group(placed, per, names).withColumns(upto).drop("__bucket", *[f"__before_{c}" for c in columns])


def quantiles(df: DataFrame, by: list[str], value: str, points: list[float], weight: str | None = None) -> DataFrame:
    """(by..., quantiles): exact linear quantiles of each group, in the order of `points`, from counts per distinct value.

    A row of weight w counts as w rows. Only the values at the asked places leave
    their tasks, so memory does not grow with a group.
    """
    w = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(w.alias("c"))
    run = running(counts, by, value, ["c"])
    first = F.col("upto_c") - F.col("c")

    def held(at: Column) -> Column:
        return (at >= first) & (at < F.col("upto_c"))

    place = F.transform(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(points)]), lambda x: F.struct(x["i"].alias("i"), (x["p"] * (F.col("all_c") - 1)).alias("at")))
    near = F.filter(place, lambda x: held(F.floor(x["at"])) | held(F.ceil(x["at"])))
    hit = run.select(*by, F.col(value).cast("double").alias("__v"), first.alias("__lo"), "upto_c", F.explode(near).alias("x"))
    at, inside = F.col("x.at"), (lambda k: (k >= F.col("__lo")) & (k < F.col("upto_c")))
    ends = hit.groupBy(*by, F.col("x.i").alias("__i"), at.alias("__at")).agg(F.max(F.when(inside(F.floor(at)), F.col("__v"))).alias("a"), F.max(F.when(inside(F.ceil(at)), F.col("__v"))).alias("b"))
    low, high = F.floor("__at"), F.ceil("__at")
    found = F.when(low == high, F.col("a")).otherwise((high - F.col("__at")) * F.col("a") + (F.col("__at") - low) * F.col("b"))
    return ends.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", found.alias("v")))), lambda x: x["v"]).alias("quantiles"))


def edge_table(df: DataFrame, by: list[str], value: str, bins: int = 10, weight: str | None = None) -> DataFrame:
    """(by..., edges): distinct linear quantiles, rounded to 9 places so that ties do not hang on the last bit."""
    rounded = F.transform("quantiles", lambda x: F.round(x, 9))
    return quantiles(df, by, value, quantile_points(bins), weight).select(*by, F.array_distinct(rounded).alias("edges"))


def higher_quantile(df: DataFrame, value: str, points: list[float], by: list[str] | None = None) -> DataFrame:
    """sorted[ceil((n - 1) q)] per group: (by..., q, value)."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    asked = running(counts, by, value, ["c"]).withColumn("q", F.explode(F.array(*[F.lit(float(p)) for p in points])))
    place = F.ceil(F.round((F.col("all_c") - 1) * F.col("q"), 9))
    return asked.where((F.col("upto_c") > place) & (F.col("upto_c") - F.col("c") <= place)).select(*by, "q", F.col(value).alias("value"))


def review_thresholds(df: DataFrame, rates: list[float], score: str = "score") -> DataFrame:
    """Score threshold per review rate."""
    found = higher_quantile(df, score, [1 - r for r in rates])
    return found.select(F.round(1 - F.col("q"), 6).alias("review_rate"), F.col("value").alias("threshold"))


def confusion(df: DataFrame, by: list[str], threshold: Column, score: str = "score", label: str = "label") -> DataFrame:
    y, flagged = F.col(label) == 1, F.col(score) >= threshold
    tp, fp = F.count_if(y & flagged), F.count_if(~y & flagged)
    fn, tn = F.count_if(y & ~flagged), F.count_if(~y & ~flagged)
    counts = df.groupBy(*by).agg(
        tp.alias("true_positive"), fp.alias("false_positive"), fn.alias("false_negative"), tn.alias("true_negative"), F.count(F.lit(1)).alias("rows")
    )
    return counts.withColumns(rates("true_positive", "false_positive", "false_negative", "true_negative"))


def rates(tp: str, fp: str, fn: str, tn: str) -> dict[str, Column]:
    """Precision, recall and f1 are 0 and the error rates null where undefined."""
    a, b, c, d = (F.col(x) for x in (tp, fp, fn, tn))
    return {
        "precision": F.coalesce(F.try_divide(a, a + b), F.lit(0.0)),
        "recall": F.coalesce(F.try_divide(a, a + c), F.lit(0.0)),
        "f1": F.coalesce(F.try_divide(2 * a, 2 * a + b + c), F.lit(0.0)),
        "false_positive_rate": F.try_divide(b, b + d),
        "false_negative_rate": F.try_divide(c, a + c),
    }


def ranking(df: DataFrame, by: list[str], score: str = "score", label: str = "label", weight: str | None = None) -> DataFrame:
    """Average precision and ROC-AUC with tie credit, per group, from counts per distinct score.

    Average precision is null without positives, the AUC unless both classes occur.
    """
    w = F.col(weight) if weight else F.lit(1)
    per = df.groupBy(*by, score).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("p"), F.sum(w).alias("n"))
    run = running(per, by, score, ["p", "n"], descending=True).withColumnsRenamed({"upto_p": "cp", "upto_n": "cn"})
    negatives = F.col("n") - F.col("p")
    sums = run.groupBy(*by).agg(
        F.sum("p").alias("positives"), F.sum("n").alias("weight"),
        F.sum(F.col("p") * F.col("cp") / F.col("cn")).alias("ap"),
        F.sum(negatives * (F.col("cp") - F.col("p") / 2)).alias("area"),
    )
    return sums.select(
        *by, "positives", (F.col("weight") - F.col("positives")).alias("negatives"),
        F.try_divide("ap", "positives").alias("pr_auc"),
        F.try_divide("area", F.col("positives") * (F.col("weight") - F.col("positives"))).alias("roc_auc"),
    )


def score_summary(df: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    p, y = F.col(score), F.col(label)
    clipped = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(y.cast("long")).alias("positives"), F.avg(y.cast("double")).alias("prevalence"),
        F.avg(p).alias("score_mean"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(-(y * F.log(clipped) + (1 - y) * F.log(1 - clipped))).alias("log_loss"),
    )
    held = same_group(sums, quantiles(df, by, score, [0.5, 0.95]), by)
    return held.select(*by, "rows", "positives", "prevalence", "score_mean", F.get("quantiles", F.lit(0)).alias("score_p50"), F.get("quantiles", F.lit(1)).alias("score_p95"), "brier", "log_loss")


def captured_amount(df: DataFrame, by: list[str], threshold: Column, amount: str = "amount", score: str = "score", label: str = "label") -> DataFrame:
    bad = F.when(F.col(label) == 1, F.col(amount))
    taken = F.when((F.col(label) == 1) & (F.col(score) >= threshold), F.col(amount))
    out = df.groupBy(*by).agg(F.coalesce(F.sum(bad), F.lit(0.0)).alias("fraud_amount"), F.coalesce(F.sum(taken), F.lit(0.0)).alias("captured_amount"))
    return out.withColumn("captured_rate", F.when(F.col("fraud_amount") > 0, F.col("captured_amount") / F.col("fraud_amount")))


def with_edges(df: DataFrame, by: list[str], score: str, bins: int, weight: str | None = None) -> DataFrame:
    return same_group(df, edge_table(df, by, score, bins, weight), by)


def reliability(df: DataFrame, by: list[str], score: str = "score", label: str = "label", bins: int = 10) -> DataFrame:
    """Equal-frequency bins, right-closed, numbered from 1 per group; constant scores give none."""
    held = with_edges(df, by, score, bins).where(F.size("edges") > 1).withColumn("b", right_closed(F.col(score), F.col("edges")))
    table = held.groupBy(*by, "b").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(score).alias("mean_probability"), F.avg(F.col(label).cast("double")).alias("observed_rate"),
        F.min(score).alias("minimum_probability"), F.max(score).alias("maximum_probability"),
    )
    number = F.dense_rank().over(Window.partitionBy(*by).orderBy("b"))
    return table.withColumn("bin", number).drop("b")


def calibration_error(df: DataFrame, by: list[str], score: str = "score", label: str = "label", bins: int = 10, weight: str | None = None) -> DataFrame:
    """Gap of label and score over equal-frequency bins; a row with weight w counts as w rows."""
    w = F.col(weight) if weight else F.lit(1)
    held = with_edges(df, by, score, bins, weight).withColumn("b", right_closed(F.col(score), F.col("edges")))
    gap = F.abs(F.sum(w * F.col(label).cast("double")) / F.sum(w) - F.sum(w * F.col(score)) / F.sum(w))
    per = held.groupBy(*by, "b").agg(F.sum(w).alias("n"), gap.alias("gap"))
    return per.groupBy(*by).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def review_budget(df: DataFrame, thresholds: DataFrame, score: str = "score", label: str = "label", amount: str = "amount") -> DataFrame:
    """Decision metrics of every threshold, by review rate; `thresholds` holds one row per asked rate.

    All thresholds are conditional sums of one pass, so no row is repeated.
    """
    y = F.col(label) == 1

    def decided(rate: float, threshold: float) -> Column:
        flagged = F.col(score) >= threshold
        return F.struct(
            F.lit(rate).alias("review_rate"), F.lit(threshold).alias("threshold"), F.count_if(y & flagged).alias("true_positive"),
            F.count_if(~y & flagged).alias("false_positive"), F.count_if(y & ~flagged).alias("false_negative"), F.count_if(~y & ~flagged).alias("true_negative"),
            F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.when(y, F.col(amount))), F.lit(0.0)).alias("fraud_amount"),
            F.coalesce(F.sum(F.when(y & flagged, F.col(amount))), F.lit(0.0)).alias("captured_amount"),
        )

    asked = [decided(r["review_rate"], r["threshold"]) for r in thresholds.collect()]
    counts = df.agg(F.array(*asked).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return counts.select(
        "review_rate", "threshold", "true_positive", "false_positive", "false_negative", "true_negative", "rows",
        *[v.alias(k) for k, v in rates("true_positive", "false_positive", "false_negative", "true_negative").items()],
        "fraud_amount", "captured_amount", F.when(F.col("fraud_amount") > 0, F.col("captured_amount") / F.col("fraud_amount")).alias("captured_rate"),
        ((F.col("true_positive") + F.col("false_positive")) / F.col("rows")).alias("realised_rate"),
    )


def calibration_line(df: DataFrame, score: str = "score", label: str = "label") -> tuple[float | None, float | None]:
    """Slope and intercept of a logistic fit of the label on the score's logit; null for one class."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n, least, most = df.agg(F.count(F.lit(1)), F.min(label), F.max(label)).first()
    if least == most:
        return None, None
    p = F.least(F.greatest(F.col(score), F.lit(1e-6)), F.lit(1 - 1e-6))
    rows = VectorAssembler(inputCols=["z"], outputCol="features").transform(df.select(F.col(label).cast("double").alias("label"), F.log(p / (1 - p)).alias("z")))
    model = LogisticRegression(regParam=1 / (1e6 * n), standardization=False, tol=1e-10, maxIter=200).fit(rows)
    return float(model.coefficients[0]), float(model.intercept)
