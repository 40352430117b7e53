"""The whole metric row, performance limits from day-block resamples, and the records of mature batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmon.operators import metrics, resample
from riskmon.operators.monitoring import performance_status

# The judged metrics, by the side on which they are worse.
LOWER = ("pr_auc", "precision", "recall")
HIGHER = ("false_positive_rate", "false_negative_rate", "brier_score", "expected_calibration_error", "prevalence_shift")
PRIMARY = ("pr_auc", "recall")
QUANTILES = {"lower": (0.05, 0.01), "higher": (0.95, 0.99)}


def checked(df: DataFrame, threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    """The rows; one with a score outside [0, 1] or a label other than 0 and 1 (null and NaN count as such) stops the job."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must lie in [0, 1]")
    good = {score: F.col(score).between(0, 1), label: F.col(label).isin(0, 1)}
    say = {score: "scores must be finite and lie in [0, 1]", label: "labels must be 0 or 1"}
    return df.withColumns({c: F.when(F.coalesce(ok, F.lit(False)), F.col(c)).otherwise(F.raise_error(F.lit(say[c]))) for c, ok in good.items()})


def metric_row(df: DataFrame, by: list[str], threshold: float, amount: str | None = None, score: str = "score", label: str = "label") -> DataFrame:
    """24 metrics per group, and three of amounts if `amount` is named; no rows give no group.

    Without positives (or negatives) the metrics that need them are null; precision, recall and f1 are 0.
    """
    rows, cut = checked(df, threshold, score, label), F.lit(threshold)
    out = metrics.confusion(rows, by, cut, score, label)
    out = out.join(metrics.score_summary(rows, by, score, label).drop("rows"), by).join(metrics.ranking(rows, by, score, label).drop("positives"), by)
    out = out.join(metrics.calibration_error(rows, by, score, label), by).withColumnsRenamed({"brier": "brier_score", "ece": "expected_calibration_error"})
    taken = F.col("true_positive") + F.col("false_positive")
    out = out.withColumns({"threshold": cut, "predicted_positive": taken, "review_rate": taken / F.col("rows"), "negatives": F.col("negatives").cast("long")})
    return out.join(metrics.captured_amount(rows, by, cut, amount, score, label), by) if amount else out


def resampled(rows: DataFrame, draws: DataFrame, threshold: float) -> DataFrame:
    """(iter, metric, value) of day-block resamples of (day, score, label); resamples of a single class are left out.

    What is additive is summed per day before the draws are joined. Average
    precision and calibration order the counts per day and distinct score once for all draws.
    """
    y, flagged, gap = F.col("label") == 1, F.col("score") >= threshold, F.col("score") - F.col("label")
    sums = {
        "tp": F.count_if(y & flagged), "fp": F.count_if(~y & flagged), "fn": F.count_if(y & ~flagged), "tn": F.count_if(~y & ~flagged),
        "squares": F.sum(gap * gap),
    }
    daily = rows.groupBy("day").agg(*[v.alias(k) for k, v in sums.items()])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    whole = tp + fp + fn + tn
    base = daily.agg((F.sum(tp + fn) / F.sum(whole)).alias("base"))
    per = daily.join(F.broadcast(draws), "day").groupBy("iter").agg(*[F.sum(F.col(c) * F.col("mult")).alias(c) for c in sums])
    additive = per.where((tp + fn > 0) & (fp + tn > 0)).join(F.broadcast(base), F.lit(True)).select(
        "iter", *[v.alias(k) for k, v in metrics.rates("tp", "fp", "fn", "tn").items() if k != "f1"],
        (F.col("squares") / whole).alias("brier_score"), F.abs((tp + fn) / whole - F.col("base")).alias("prevalence_shift"),
    )
    counts = rows.groupBy(F.col("day").cast("long").alias("day"), "score").agg(F.sum(y.cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    drawn = resample.Draws(draws)
    ranked = resample.ranking(counts, drawn)
    error = resample.calibration_error(counts, drawn).withColumnRenamed("ece", "expected_calibration_error")
    return additive.join(ranked, "iter").join(error, "iter").unpivot(["iter"], [*LOWER, *HIGHER], "metric", "value")


def limits(samples: DataFrame) -> DataFrame:
    """(metric, direction, warning_limit, critical_limit): low quantiles where less is worse, high ones elsewhere; nulls don't count."""
    points = [q for pair in QUANTILES.values() for q in pair]
    found = samples.groupBy("metric").agg(F.percentile("value", F.array(*[F.lit(q) for q in points])).alias("q"))
    low = F.col("metric").isin(*LOWER)
    return found.select(
        "metric", F.when(low, "lower").otherwise("higher").alias("direction"),
        F.when(low, F.col("q")[0]).otherwise(F.col("q")[2]).alias("warning_limit"), F.when(low, F.col("q")[1]).otherwise(F.col("q")[3]).alias("critical_limit"),
    )


def records(rows: DataFrame, reference: DataFrame, bounds: DataFrame, by: list[str], usable: Column) -> DataFrame:
    """Eight records for each metric row; `reference` is the one metric row of the reference period.

    Where labels are not `usable` or of a single class, all eight are unavailable with a null value, and
    the reference of the prevalence shift is null instead of 0. Values are judged at 9 places.
    """
    names = [m for m in (*LOWER, *HIGHER) if m != "prevalence_shift"]
    known = reference.select(F.col("prevalence").alias("__base"), *[F.col(m).alias(f"__{m}") for m in names])
    held = rows.join(F.broadcast(known), F.lit(True)).withColumn("__ok", usable & (F.col("positives") > 0) & (F.col("negatives") > 0))
    pairs = {m: (F.col(m), F.col(f"__{m}")) for m in names} | {"prevalence_shift": (F.abs(F.col("prevalence") - F.col("__base")), F.when(F.col("__ok"), 0.0))}
    each = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.round(F.when(F.col("__ok"), now), 9).alias("value"), F.round(ref, 9).alias("reference_value")) for m, (now, ref) in pairs.items()
    ]))
    judged = held.select(*by, each.alias("r")).select(*by, "r.*").join(F.broadcast(bounds), "metric")
    sides = [performance_status(F.col("value"), F.col("warning_limit"), F.col("critical_limit"), high) for high in (False, True)]
    status = F.when(F.col("direction") == "lower", sides[0]).otherwise(sides[1])
    return judged.select(*by, "metric", "value", "reference_value", "warning_limit", "critical_limit", "direction", status.alias("status"))


def summary(judged: DataFrame, by: list[str]) -> DataFrame:
    """(by..., performance_severity, primary_critical): the worst status; unavailable only if all records are."""
    status = F.col("status")
    worst = (
        F.when(F.bool_or(status == "critical"), "critical").when(F.bool_or(status == "warning"), "warning")
        .when(F.bool_and(status == "unavailable"), "unavailable").otherwise("healthy")
    )
    primary = F.bool_or((status == "critical") & F.col("metric").isin(*PRIMARY))
    return judged.groupBy(*by).agg(worst.alias("performance_severity"), primary.alias("primary_critical"))
