"""Drift statistics of all batches against one reference, in long form.

The long form is (group..., feature, value); every statistic is grouped over it,
so the number of features and batches costs no extra plan.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskmon.operators.features import as_category
from riskmon.operators.metrics import edge_table, left_closed, quantiles, running

SMOOTHING = 1e-6
SEVERITIES = ("healthy", "warning", "critical")


def numeric_long(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Finite values only."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.expr(f"try_cast({c} as double)").alias("value")) for c in columns]))
    out = df.select(*by, each.alias("r")).select(*by, "r.*")
    return out.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def category_long(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), as_category(c).alias("value")) for c in columns]))
    return df.select(*by, each.alias("r")).select(*by, "r.*")


def reference_edges(reference: DataFrame, bins: int = 10) -> DataFrame:
    """One row per feature with its quantile edges; a constant feature has its value three times."""
    found = edge_table(reference, ["feature"], "value", bins).withColumnRenamed("edges", "e")
    single = F.array(F.element_at("e", 1), F.element_at("e", 1), F.element_at("e", 1))
    return found.select("feature", F.when(F.size("e") < 2, single).otherwise(F.col("e")).alias("edges"))


def known_edges(reference: DataFrame, bins: int = 10) -> DataFrame:
    """`reference_edges` computed once and held on the driver, features times bins numbers, since plans read them several times."""
    found = reference_edges(reference, bins)
    return reference.sparkSession.createDataFrame(found.collect(), found.schema)


def histogram(rows: DataFrame, by: list[str], edge: DataFrame) -> DataFrame:
    binned = rows.join(F.broadcast(edge), "feature").withColumn("bin", left_closed(F.col("value"), F.col("edges")))
    return binned.groupBy(*by, "feature", "bin").agg(F.count(F.lit(1)).alias("n"))


def on_grid(counts: DataFrame, by: list[str], cells: DataFrame, cell: str) -> DataFrame:
    """Counts of every (group, feature) on all cells of the feature, zeros filled in."""
    groups = counts.select(*by, "feature").distinct()
    full = groups.join(cells, "feature")
    return full.join(counts, [*by, "feature", cell], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def smoothed(counts: DataFrame, by: list[str]) -> Column:
    whole = Window.partitionBy(*by, "feature")
    return (F.col("n") + SMOOTHING) / (F.sum("n").over(whole) + SMOOTHING * F.count(F.lit(1)).over(whole))


def divergences(current: DataFrame, by: list[str], reference: DataFrame, cells: DataFrame, cell: str, smooth: bool = True) -> DataFrame:
    """PSI and Jensen-Shannon distance (base 2) of each group's histogram from the reference's."""

    def shares(counts: DataFrame, keys: list[str]) -> Column:
        return smoothed(counts, keys) if smooth else F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "feature"))

    now, ref = on_grid(current, by, cells, cell), on_grid(reference, [], cells, cell)
    both = now.withColumn("a", shares(now, by)).drop("n").join(ref.withColumn("e", shares(ref, [])).drop("n"), ["feature", cell])
    middle = (F.col("a") + F.col("e")) / 2
    half = F.when(F.col("a") > 0, F.col("a") * F.log2(F.col("a") / middle)).otherwise(0.0) + F.when(
        F.col("e") > 0, F.col("e") * F.log2(F.col("e") / middle)
    ).otherwise(0.0)
    psi = F.when((F.col("a") > 0) & (F.col("e") > 0), (F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e")))
    return both.groupBy(*by, "feature").agg(F.sum(psi).alias("psi"), F.sqrt(F.greatest(F.sum(half) / 2, F.lit(0.0))).alias("js"))


def numeric_divergences(current: DataFrame, by: list[str], reference: DataFrame, bins: int = 10) -> DataFrame:
    edge = known_edges(reference, bins)
    cells = edge.select("feature", F.explode(F.sequence(F.lit(0), F.greatest(F.size("edges") - 2, F.lit(0)))).alias("bin"))
    return divergences(histogram(current, by, edge), by, histogram(reference, [], edge), cells, "bin")


def category_distance(current: DataFrame, by: list[str], reference: DataFrame) -> DataFrame:
    """Jensen-Shannon distance over the union of levels, without smoothing."""
    now = current.groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    ref = reference.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    cells = now.select("feature", "value").union(ref.select("feature", "value")).distinct()
    return divergences(now, by, ref, cells, "value", smooth=False).drop("psi")


def unseen_rate(current: DataFrame, by: list[str], reference: DataFrame) -> DataFrame:
    known = reference.select("feature", "value").distinct().withColumn("known", F.lit(1))
    held = current.groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("n")).join(known, ["feature", "value"], "left")
    return held.groupBy(*by, "feature").agg((F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("unseen_rate"))


def missingness_shift(current: DataFrame, by: list[str], reference: DataFrame, columns: list[str]) -> DataFrame:
    def shares(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        wide = df.groupBy(*keys).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias(name)) for c in columns]))
        return wide.select(*keys, each.alias("r")).select(*keys, "r.*")

    both = shares(current, by, "now").join(F.broadcast(shares(reference, [], "ref")), "feature")
    return both.select(*by, "feature", F.abs(F.col("now") - F.col("ref")).alias("missingness_shift"))


def bootstrap_missingness(reference: DataFrame, draws: DataFrame, columns: list[str]) -> DataFrame:
    """(iter, feature, missingness_shift) of day-block resamples of the reference (day, columns...), from counts per day."""
    gaps = reference.groupBy("day").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"__{i}") for i, c in enumerate(columns)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"__{i}").alias("gaps")) for i, c in enumerate(columns)]))
    daily = gaps.select("day", "n", each.alias("r")).select("day", "n", "r.*")
    base = daily.groupBy("feature").agg((F.sum("gaps") / F.sum("n")).alias("base"))
    share = F.sum(F.col("gaps") * F.col("mult")) / F.sum(F.col("n") * F.col("mult"))
    sampled = daily.join(F.broadcast(draws), "day").groupBy("iter", "feature").agg(share.alias("share"))
    return sampled.join(F.broadcast(base), "feature").select("iter", "feature", F.abs(F.col("share") - F.col("base")).alias("missingness_shift"))


def reference_scale(reference: DataFrame) -> DataFrame:
    """(feature, scale): max(IQR, population deviation, 1e-6)."""
    middle = quantiles(reference, ["feature"], "value", [0.25, 0.75]).select("feature", (F.get("quantiles", F.lit(1)) - F.get("quantiles", F.lit(0))).alias("iqr"))
    spread = reference.groupBy("feature").agg(F.stddev_pop("value").alias("deviation"))
    return spread.join(middle, "feature").select("feature", F.greatest("iqr", "deviation", F.lit(1e-6)).alias("scale"))


def wasserstein(current: DataFrame, by: list[str], reference: DataFrame) -> DataFrame:
    """Wasserstein-1 distance over max(IQR, population deviation, 1e-6) of the reference."""
    scale = reference_scale(reference)
    now = current.groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("c"))
    ref = reference.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("r"))
    groups = now.select(*by, "feature").distinct()
    union = now.withColumn("r", F.lit(0)).unionByName(groups.join(ref, "feature").withColumn("c", F.lit(0)))
    merged = union.groupBy(*by, "feature", "value").agg(F.sum("c").alias("c"), F.sum("r").alias("r"))
    # The area between two step functions, summed by parts: the gap after a value holds up to the next
    # value, so each value enters once with the gap before it and once, negated, with the gap after it.
    run = running(merged, [*by, "feature"], "value", ["c", "r"])
    after = F.abs(F.col("upto_c") / F.col("all_c") - F.col("upto_r") / F.col("all_r"))
    before = F.abs((F.col("upto_c") - F.col("c")) / F.col("all_c") - (F.col("upto_r") - F.col("r")) / F.col("all_r"))
    area = run.withColumn("area", (before - after) * F.col("value")).groupBy(*by, "feature").agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"))
    return area.join(scale, "feature").select(*by, "feature", (F.col("area") / F.col("scale")).alias("wasserstein"))


def severity(value: Column, warning: Column, critical: Column) -> Column:
    """A value that is null or not finite is critical; limits are strict."""
    odd = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(odd | (value > critical), "critical").when(value > warning, "warning").otherwise("healthy")


def worst(value: Column) -> Column:
    """Aggregate: the worst of several severities."""
    rank = F.when(value == "critical", 2).when(value == "warning", 1).otherwise(0)
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.max(rank) + 1)


def draw_days(spark: SparkSession, days: list[int], iterations: int, size: int = 7, seed: int = 42) -> DataFrame:
    """(iter, day, mult): days drawn with replacement, as often as the multiplicity says. At most iterations x size rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(iterations):
        day, n = np.unique(rng.choice(days, size), return_counts=True)
        rows += [(i, int(d), int(m)) for d, m in zip(day, n)]
    return spark.createDataFrame(rows, "iter int, day long, mult long")


def hashed_draws(days: DataFrame, iterations: int, size: int = 7) -> DataFrame:
    """(iter, day, mult): days drawn with replacement by MD5 of iteration and place, the same in any engine."""
    listed = days.agg(F.array_sort(F.collect_set("day")).alias("days"))
    each = listed.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", "iter", "j").cast("binary")), 1, 8), 16, 10).cast("long")
    place = (drawn % F.size("days")).cast("int")
    return each.groupBy("iter", F.get("days", place).alias("day")).agg(F.count(F.lit(1)).alias("mult"))


def bootstrap_statistics(reference: DataFrame, draws: DataFrame, bins: int = 10) -> DataFrame:
    """(iter, feature, psi, js) of day-block resamples of the reference (day, feature, value).

    A resample's histogram is the days' histograms weighted by multiplicity, so
    the work grows with days x bins and not with rows x iterations.
    """
    edge = known_edges(reference.drop("day"), bins)
    daily = histogram(reference, ["day"], edge)
    total = daily.groupBy("feature", "bin").agg(F.sum("n").alias("n"))
    sampled = daily.join(F.broadcast(draws), "day").groupBy("iter", "feature", "bin").agg(F.sum(F.col("n") * F.col("mult")).alias("n"))
    cells = edge.select("feature", F.explode(F.sequence(F.lit(0), F.greatest(F.size("edges") - 2, F.lit(0)))).alias("bin"))
    return divergences(sampled, ["iter"], total, cells, "bin")


def control_limits(samples: DataFrame, by: list[str], value: str, warning: float = 0.95, critical: float = 0.99) -> DataFrame:
    both = F.percentile(F.col(value), F.array(F.lit(warning), F.lit(critical)))
    return samples.groupBy(*by).agg(F.element_at(both, 1).alias("warning_limit"), F.element_at(both, 2).alias("critical_limit"))


def alert_limits(samples: DataFrame, limits: DataFrame, value: str) -> DataFrame:
    """How many features may alert at once: (kind, limit) from the resamples themselves."""
    judged = samples.join(F.broadcast(limits), "feature").withColumn("severity", severity(F.col(value), F.col("warning_limit"), F.col("critical_limit")))
    per = judged.groupBy("iter").agg(F.count_if(F.col("severity") != "healthy").alias("warning"), F.count_if(F.col("severity") == "critical").alias("critical"))
    # One row per iteration, so the sorted counts fit into one row.
    place = {q: F.ceil(F.round((F.count(F.lit(1)) - 1) * q, 9)).cast("int") for q in (0.95, 0.99)}
    kinds = [F.struct(F.lit(kind).alias("kind"), F.get(F.array_sort(F.collect_list(kind)), place[q]).alias("limit")) for kind, q in (("warning", 0.95), ("critical", 0.99))]
    return per.agg(F.array(*kinds).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def compare(values: DataFrame, limits: DataFrame, by: list[str], value: str, expected: list[str]) -> DataFrame:
    """Drift records of all groups, one per expected feature.

    A feature that a group's table lacks, so that `values` holds no row of it, is
    critical as schema_missing, whether it has limits or not; a feature without
    limits is judged against 0.
    """
    groups = values.select(*by).distinct()
    wanted = groups.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in expected])))
    seen = values.select(*by, "feature", F.col(value).alias("value"), F.lit(True).alias("seen"))
    held = wanted.join(seen, [*by, "feature"], "left").join(F.broadcast(limits), "feature", "left")
    absent = F.col("seen").isNull()
    bound = {c: F.when(absent, 0.0).otherwise(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("warning_limit", "critical_limit")}
    return held.select(
        *by, "feature", F.when(absent, "schema_missing").otherwise(value).alias("metric"),
        F.when(absent, 1.0).otherwise(F.col("value")).alias("value"), bound["warning_limit"], bound["critical_limit"],
    ).withColumn("severity", severity(F.col("value"), F.col("warning_limit"), F.col("critical_limit")))


def global_severity(records: DataFrame, limits: DataFrame, prediction: DataFrame, by: list[str]) -> DataFrame:
    """(by..., critical_features, alerting_features, severity): more features alert than `limits` (kind, limit) allow, or the prediction itself drifts.

    `prediction` holds the severity of the scores of each group as prediction_severity.
    """
    most = limits.groupBy().pivot("kind", ["warning", "critical"]).agg(F.first("limit"))
    per = records.groupBy(*by).agg(
        F.count_if(F.col("severity") == "critical").alias("critical_features"), F.count_if(F.col("severity") != "healthy").alias("alerting_features")
    )
    held = per.join(prediction, by, "left").join(F.broadcast(most.select(F.col("warning").alias("__w"), F.col("critical").alias("__c"))), F.lit(True), "left")
    level = (
        F.when((F.col("critical_features") > F.col("__c")) | (F.col("prediction_severity") == "critical"), "critical")
        .when((F.col("alerting_features") > F.col("__w")) | (F.col("prediction_severity") == "warning"), "warning")
        .otherwise("healthy")
    )
    return held.withColumn("severity", level).select(*by, "critical_features", "alerting_features", "severity")
