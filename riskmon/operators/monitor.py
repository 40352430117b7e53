"""The whole drift monitor: limits of every metric of every feature from day-block resamples, and records of all batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmon.operators import drift, resample
from riskmon.operators.metrics import same_group

# The metrics of a feature, by its kind, and those of the scores.
METRICS = {"numeric": ("missingness_shift", "normalized_wasserstein", "psi"), "categorical": ("missingness_shift", "jensen_shannon", "unseen_category_rate")}
PREDICTION = ("score_jensen_shannon", "score_mean_shift")
SCORE = "score"


def monitored_features(importances: list[tuple[str, float]], available: list[str], top: int, always: tuple[str, ...] = ()) -> list[str]:
    """The `top` features of the largest importance (ties by name) and then those in `always`, as far as they are available, each once."""
    ranked = [name for name, _ in sorted(importances, key=lambda x: (-x[1], x[0]))[:top]]
    return [f for f in dict.fromkeys([*ranked, *always]) if f in available]


def kinds(numeric: list[str], categorical: list[str]) -> list[tuple[str, str, str]]:
    """(feature, kind, metric) of everything that is monitored."""
    return [(f, kind, m) for kind, names in (("numeric", numeric), ("categorical", categorical)) for f in names for m in METRICS[kind]]


def per_day(rows: DataFrame, columns: list[str], long) -> DataFrame:
    return long(rows, ["day"], columns).groupBy("day", "feature", "value").agg(F.count(F.lit(1)).alias("n"))


def category_divergence(current: DataFrame, by: list[str], reference: DataFrame) -> DataFrame:
    """(by..., feature, js): smoothed Jensen-Shannon distance over the levels of the group and the reference together."""
    now = current.groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("a"))
    ref = reference.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("e"))
    groups = now.select(*by, "feature").distinct()
    union = now.withColumn("e", F.lit(0)).unionByName(groups.join(ref, "feature").withColumn("a", F.lit(0)))
    cells = union.groupBy(*by, "feature", "value").agg(F.sum("a").alias("a"), F.sum("e").alias("e"))
    whole = cells.groupBy(*by, "feature").agg(F.sum("a").alias("na"), F.sum("e").alias("ne"), F.count(F.lit(1)).alias("k"))
    held = same_group(cells, whole, [*by, "feature"])
    share = {c: (F.col(c) + drift.SMOOTHING) / (F.col(n) + drift.SMOOTHING * F.col("k")) for c, n in (("a", "na"), ("e", "ne"))}
    middle = (share["a"] + share["e"]) / 2
    half = share["a"] * F.log2(share["a"] / middle) + share["e"] * F.log2(share["e"] / middle)
    return held.groupBy(*by, "feature").agg(F.sqrt(F.greatest(F.sum(half) / 2, F.lit(0.0))).alias("js"))


def named(df: DataFrame, by: list[str], metric: str, value: str) -> DataFrame:
    return df.select(*by, "feature", F.lit(metric).alias("metric"), F.col(value).cast("double").alias("value"))


def together(parts: list[DataFrame]) -> DataFrame:
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


@dataclass
class DriftMonitor:
    """A fitted reference: `limits` (feature, kind, metric, warning_limit, critical_limit), `prediction_limits` (metric, ...) and `allowed` (kind, limit)."""

    reference: DataFrame
    numeric: list[str]
    categorical: list[str]
    samples: DataFrame
    limits: DataFrame
    prediction_samples: DataFrame
    prediction_limits: DataFrame
    allowed: DataFrame

    def values(self, current: DataFrame, by: list[str]) -> DataFrame:
        """(by..., feature, metric, value) of all metrics; a feature without usable values has none."""
        return feature_values(current, by, self.reference, [c for c in self.numeric if c in current.columns], [c for c in self.categorical if c in current.columns])

    def compare(self, current: DataFrame, by: list[str]) -> DataFrame:
        """(by..., feature, feature_kind, metric, value, limits, severity): three records of each feature, or one of schema_missing.

        A value that cannot be computed is null and critical.
        """
        groups = current.select(*by).distinct()
        absent = [c for c in (*self.numeric, *self.categorical) if c not in current.columns]
        expected = groups.crossJoin(F.broadcast(self.limits)).where(~F.col("feature").isin(absent)) if absent else groups.crossJoin(F.broadcast(self.limits))
        found = self.values(current, by).withColumnsRenamed({c: f"__{c}" for c in (*by, "feature", "metric")})
        key = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*by, "feature", "metric")]
        held = expected.join(found, key, "left").select(*by, "feature", F.col("kind").alias("feature_kind"), "metric", F.round("value", 9).alias("value"), "warning_limit", "critical_limit")
        records = held.withColumn("severity", drift.severity(F.col("value"), F.col("warning_limit"), F.col("critical_limit")))
        if not absent:
            return records
        gone = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit("categorical" if c in self.categorical else "numeric").alias("feature_kind")) for c in absent]))
        zero = F.lit(0.0)
        missing = groups.select(*by, gone.alias("g")).select(
            *by, "g.*", F.lit("schema_missing").alias("metric"), F.lit(1.0).alias("value"), zero.alias("warning_limit"), zero.alias("critical_limit"), F.lit("critical").alias("severity")
        )
        return records.unionByName(missing)

    def prediction(self, current: DataFrame, by: list[str]) -> DataFrame:
        """(by..., metric, value, limits, severity) of the scores: divergence and shift of the mean."""
        moved = prediction_values(current, by, self.reference)
        judged = moved.withColumn("value", F.round("value", 9)).join(F.broadcast(self.prediction_limits), "metric")
        return judged.select(*by, "metric", "value", "warning_limit", "critical_limit", drift.severity(F.col("value"), F.col("warning_limit"), F.col("critical_limit")).alias("severity"))

    def summary(self, records: DataFrame, prediction: DataFrame, by: list[str]) -> DataFrame:
        """(by..., warning_features, critical_features, their limits, prediction_severity, global_severity)."""
        features = records.groupBy(*by, "feature").agg(drift.worst(F.col("severity")).alias("severity"))
        counts = features.groupBy(*by).agg(F.count_if(F.col("severity") != "healthy").alias("warning_features"), F.count_if(F.col("severity") == "critical").alias("critical_features"))
        scores = prediction.groupBy(*by).agg(drift.worst(F.col("severity")).alias("prediction_severity"))
        most = self.allowed.groupBy().agg(*[F.max(F.when(F.col("kind") == k, F.col("limit"))).alias(f"{k}_feature_limit") for k in ("warning", "critical")])
        held = same_group(counts, scores, by).crossJoin(F.broadcast(most))
        level = (
            F.when((F.col("critical_features") > F.col("critical_feature_limit")) | (F.col("prediction_severity") == "critical"), "critical")
            .when((F.col("warning_features") > F.col("warning_feature_limit")) | (F.col("prediction_severity") == "warning"), "warning").otherwise("healthy")
        )
        names = ("warning_features", "critical_features", "warning_feature_limit", "critical_feature_limit", "prediction_severity")
        return held.select(*by, *names, level.alias("global_severity"))


def feature_values(current: DataFrame, by: list[str], reference: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    parts = [named(drift.missingness_shift(current, by, reference, [*numeric, *categorical]), by, "missingness_shift", "missingness_shift")] if numeric or categorical else []
    if numeric:
        now, ref = drift.numeric_long(current, by, numeric), drift.numeric_long(reference, [], numeric)
        parts += [named(drift.wasserstein(now, by, ref), by, "normalized_wasserstein", "wasserstein"), named(drift.numeric_divergences(now, by, ref), by, "psi", "psi")]
    if categorical:
        now, ref = drift.category_long(current, by, categorical), drift.category_long(reference, [], categorical)
        parts += [named(category_divergence(now, by, ref), by, "jensen_shannon", "js"), named(drift.unseen_rate(now, by, ref), by, "unseen_category_rate", "unseen_rate")]
    return together(parts)


def prediction_values(current: DataFrame, by: list[str], reference: DataFrame) -> DataFrame:
    now, ref = drift.numeric_long(current, by, [SCORE]), drift.numeric_long(reference, [], [SCORE])
    moved = drift.numeric_divergences(now, by, ref).select(*by, F.lit(PREDICTION[0]).alias("metric"), F.col("js").alias("value"))
    mean = reference.agg(F.avg(SCORE).alias("__mean"))
    shift = current.groupBy(*by).agg(F.avg(SCORE).alias("m")).crossJoin(F.broadcast(mean)).select(*by, F.lit(PREDICTION[1]).alias("metric"), F.abs(F.col("m") - F.col("__mean")).alias("value"))
    return moved.unionByName(shift)


def resampled_features(reference: DataFrame, numeric: list[str], categorical: list[str], draws: DataFrame, drawn: resample.Draws) -> DataFrame:
    """(iter, feature, metric, value) of the reference (day, features...)."""
    parts = [named(drift.bootstrap_missingness(reference, draws, [*numeric, *categorical]), ["iter"], "missingness_shift", "missingness_shift")]
    if numeric:
        long = drift.numeric_long(reference, ["day"], numeric)
        scale = drift.reference_scale(drift.numeric_long(reference, [], numeric))
        parts += [named(resample.wasserstein(per_day(reference, numeric, drift.numeric_long), scale, drawn), ["iter"], "normalized_wasserstein", "value")]
        parts += [named(drift.bootstrap_statistics(long, draws), ["iter"], "psi", "psi")]
    if categorical:
        distance = resample.category_distance(per_day(reference, categorical, drift.category_long), drawn, drift.SMOOTHING)
        parts += [named(distance, ["iter"], "jensen_shannon", "value")]
        # A resample of the reference holds no level that the reference lacks.
        parts += [named(distance.withColumn("none", F.lit(0.0)), ["iter"], "unseen_category_rate", "none")]
    return together(parts)


def resampled_scores(reference: DataFrame, draws: DataFrame) -> DataFrame:
    """(iter, metric, value) of the scores of the reference (day, score)."""
    moved = drift.bootstrap_statistics(drift.numeric_long(reference, ["day"], [SCORE]), draws).select("iter", F.lit(PREDICTION[0]).alias("metric"), F.col("js").alias("value"))
    daily = reference.where(F.col(SCORE).isNotNull()).groupBy("day").agg(F.sum(SCORE).alias("s"), F.count(F.lit(1)).alias("n"))
    mean = daily.agg((F.sum("s") / F.sum("n")).alias("__mean"))
    drawn = daily.join(F.broadcast(draws), "day").groupBy("iter").agg((F.sum(F.col("s") * F.col("mult")) / F.sum(F.col("n") * F.col("mult"))).alias("m"))
    return moved.unionByName(drawn.crossJoin(F.broadcast(mean)).select("iter", F.lit(PREDICTION[1]).alias("metric"), F.abs(F.col("m") - F.col("__mean")).alias("value")))


def allowed_alerts(samples: DataFrame, limits: DataFrame, warning: float, critical: float) -> DataFrame:
    """(kind, limit): how many features alert at once in the resamples themselves, the higher quantile."""
    level = drift.severity(F.col("value"), F.col("warning_limit"), F.col("critical_limit"))
    worst = samples.join(F.broadcast(limits), ["feature", "metric"]).groupBy("iter", "feature").agg(drift.worst(level).alias("severity"))
    per = worst.groupBy("iter").agg(F.count_if(F.col("severity") != "healthy").alias("warning"), F.count_if(F.col("severity") == "critical").alias("critical"))

    def higher(kind: str, q: float) -> Column:
        # One number per resample, so the sorted counts fit into one row.
        place = F.ceil(F.round((F.count(F.lit(1)) - 1) * q, 9)).cast("int")
        return F.struct(F.lit(kind).alias("kind"), F.get(F.array_sort(F.collect_list(kind)), place).alias("limit"))

    return per.agg(F.array(higher("warning", warning), higher("critical", critical)).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def fit(reference: DataFrame, numeric: list[str], categorical: list[str], draws: DataFrame, warning: float = 0.95, critical: float = 0.99, keep=lambda name, df: df) -> DriftMonitor:
    """Fit on the reference rows (day, score, features...); `keep` may store a table that several plans read."""
    absent = [c for c in (*numeric, *categorical, SCORE, "day") if c not in reference.columns]
    if absent:
        raise ValueError(f"the reference lacks {', '.join(absent)}")
    if not 0 < warning < critical < 1:
        raise ValueError("quantiles must increase between 0 and 1")
    drawn = resample.Draws(draws)
    samples = keep("samples", resampled_features(reference, numeric, categorical, draws, drawn).withColumn("value", F.round("value", 9)))
    listed = F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(row, ("feature", "kind", "metric"))]) for row in kinds(numeric, categorical)]))
    every = reference.sparkSession.range(1).select(listed.alias("r")).select("r.*")
    usual = drift.control_limits(samples, ["feature", "metric"], "value", warning, critical)
    rounded = {c: F.round(c, 9) for c in ("warning_limit", "critical_limit")}
    limits = keep("limits", every.join(usual, ["feature", "metric"], "left").withColumns(rounded).select("feature", "kind", "metric", *rounded))
    scores = keep("score_samples", resampled_scores(reference, draws).withColumn("value", F.round("value", 9)))
    bounds = keep("score_limits", drift.control_limits(scores, ["metric"], "value", warning, critical).withColumns(rounded))
    allowed = keep("allowed", allowed_alerts(samples, limits, warning, critical))
    return DriftMonitor(reference, numeric, categorical, samples, limits, scores, bounds, allowed)
