"""Day-block resamples of ordered statistics without a row per draw.

A resample weights each day's counts by how often the day was drawn. Values are
ordered once, in equal parts of the distinct ones; inside a part the counts per
day times the matrix of draws give all resamples at once. What leaves a task is a
sum per resample, so the rows grow with values and with draws, not with both.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmon.operators.metrics import bucketed, quantile_points

# Distinct values of one part, and how many of them meet the draws at a time.
PART, SLICE = 50_000, 2048


class Draws:
    """Multiplicities of the drawn days: a matrix of days by draws, bounded by the days of the reference and the draws."""

    def __init__(self, draws: DataFrame):
        rows = draws.select("iter", "day", "mult").collect()
        self.days = sorted({r["day"] for r in rows})
        self.iters = sorted({r["iter"] for r in rows})
        place, column = {d: i for i, d in enumerate(self.days)}, {x: i for i, x in enumerate(self.iters)}
        self.matrix = np.zeros((len(self.days), len(self.iters)))
        for r in rows:
            self.matrix[place[r["day"]], column[r["iter"]]] = r["mult"]

    def dense(self, rows: np.ndarray, days: np.ndarray, values: np.ndarray, height: int) -> np.ndarray:
        """(height x days) sums of values; days that were never drawn are left out."""
        at = np.searchsorted(self.days, days)
        known = (at < len(self.days)) & (np.array(self.days)[np.minimum(at, len(self.days) - 1)] == days)
        out = np.zeros((height, len(self.days)))
        np.add.at(out, (rows[known], at[known]), values[known])
        return out


def parts(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """counts (by..., day, value, sums) with `__bucket`: parts of about PART distinct values of a group, however many there are."""
    distinct = counts.select(*by, value).distinct()
    largest = distinct.groupBy(*by).count().agg(F.max("count")).first()[0] or 1
    placed = bucketed(distinct, by, value, max(1, -(-largest // PART)))
    keys = [*by, value]
    return counts.alias("x").join(placed.alias("y"), [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in keys]).select("x.*", "y.__bucket")


def with_before(placed: DataFrame, by: list[str], columns: list[str], draws: Draws, descending: bool) -> DataFrame:
    """placed, and per part and day a row without a value that holds the sums of all earlier parts."""
    names = [*by, "__bucket"]
    per = placed.groupBy(*names, "day").agg(*[F.sum(c).alias(c) for c in columns])
    grid = placed.select(*names).distinct().withColumn("day", F.explode(F.array(*[F.lit(d).cast("long") for d in draws.days])))
    full = grid.join(per, [*names, "day"], "left")
    order = F.desc("__bucket") if descending else F.asc("__bucket")
    before = Window.partitionBy(*by, "day").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    heads = full.select(*names, "day", *[F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(before), F.lit(0)).alias(c) for c in columns])
    return placed.unionByName(heads, allowMissingColumns=True)


def per_part(counts: DataFrame, by: list[str], value: str, columns: list[str], draws: Draws, body: Callable, schema: str, descending: bool = False) -> DataFrame:
    """`body(key, values, matrices, before)` on every part of every group.

    values are the part's distinct values in order, matrices hold each column's counts
    per value and day, before its sums per day over all earlier parts of the group.
    """
    placed = parts(counts, by, value).withColumn(value, F.col(value).cast("double"))
    rows = with_before(placed, by, columns, draws, descending)

    def computed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[value].isna().to_numpy()
        held, own = pdf[~head], pdf[head]
        values, place = np.unique(held[value].to_numpy(np.float64), return_inverse=True)
        if descending:
            values, place = values[::-1], len(values) - 1 - place
        day = held["day"].to_numpy(np.int64)
        matrices = [draws.dense(place, day, held[c].to_numpy(np.float64), len(values)) for c in columns]
        zero = np.zeros(len(own), np.int64)
        before = [draws.dense(zero, own["day"].to_numpy(np.int64), own[c].to_numpy(np.float64), 1)[0] for c in columns]
        return body(key, values, matrices, before)

    return rows.groupBy(*by, "__bucket").applyInPandas(computed, schema)


def slices(values: np.ndarray, matrices: list[np.ndarray], before: list[np.ndarray], draws: Draws):
    """Parts of a part: (values, sums per value and draw, running sums per value and draw) of every column."""
    upto = [b @ draws.matrix for b in before]
    for at in range(0, len(values), SLICE):
        own = [m[at : at + SLICE] @ draws.matrix for m in matrices]
        run = [u + np.cumsum(o, axis=0) for u, o in zip(upto, own)]
        upto = [r[-1] for r in run]
        yield values[at : at + SLICE], own, run


def ranking(counts: DataFrame, draws: Draws) -> DataFrame:
    """(iter, pr_auc) of resamples of (day, score, p, n): positives and rows per day and score; null without positives."""

    def summed(key: tuple, values: np.ndarray, matrices: list, before: list) -> pd.DataFrame:
        area, hits = np.zeros(len(draws.iters)), np.zeros(len(draws.iters))
        for _, (p, _), (cp, cn) in slices(values, matrices, before, draws):
            area += (p * cp / np.where(cn > 0, cn, 1)).sum(axis=0)
            hits += p.sum(axis=0)
        return pd.DataFrame({"iter": draws.iters, "area": area, "hits": hits})

    found = per_part(counts, [], "score", ["p", "n"], draws, summed, "iter int, area double, hits double", descending=True)
    return found.groupBy("iter").agg(F.try_divide(F.sum("area"), F.sum("hits")).alias("pr_auc"))


def quantile_edges(counts: DataFrame, draws: Draws, bins: int) -> dict[int, np.ndarray]:
    """Distinct quantile edges of the scores of every resample, rounded to 9 places; bounded by draws and bins."""
    totals = {r["day"]: r["n"] for r in counts.groupBy("day").agg(F.sum("n").alias("n")).collect()}
    whole = np.array([totals.get(d, 0) for d in draws.days], np.float64) @ draws.matrix
    points = np.array(quantile_points(bins))

    def placed(key: tuple, values: np.ndarray, matrices: list, before: list) -> pd.DataFrame:
        out = []
        for own, (n,), (upto,) in slices(values, matrices[:1], before[:1], draws):
            for i, iteration in enumerate(draws.iters):
                at = points * (whole[i] - 1)
                for side, ranks in (("a", np.floor(at)), ("b", np.ceil(at))):
                    k = np.searchsorted(upto[:, i], ranks, side="right")
                    ok = (k < len(own)) & (ranks >= upto[0, i] - n[0, i])
                    out += [(iteration, j, at[j], side, own[k[j]]) for j in np.flatnonzero(ok).tolist()]
        return pd.DataFrame(out, columns=["iter", "j", "at", "side", "v"])

    rows = per_part(counts, [], "score", ["n"], draws, placed, "iter int, j int, at double, side string, v double")
    ends = rows.groupBy("iter", "j", "at").agg(F.max(F.when(F.col("side") == "a", F.col("v"))).alias("a"), F.max(F.when(F.col("side") == "b", F.col("v"))).alias("b"))
    low, high = F.floor("at"), F.ceil("at")
    found = F.round(F.when(low == high, F.col("a")).otherwise((high - F.col("at")) * F.col("a") + (F.col("at") - low) * F.col("b")), 9)
    listed = ends.groupBy("iter").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("j", found.alias("v")))), lambda x: x["v"])).alias("edges"))
    return {r["iter"]: np.array(r["edges"]) for r in listed.collect()}


def calibration_error(counts: DataFrame, draws: Draws, bins: int = 10) -> DataFrame:
    """(iter, ece) of resamples of (day, score, p, n), with equal-frequency bins of each resample's own."""
    edges = quantile_edges(counts, draws, bins)

    def binned(key: tuple, values: np.ndarray, matrices: list, before: list) -> pd.DataFrame:
        sums = np.zeros((len(draws.iters), 3, bins))
        for own, (p, n), _ in slices(values, matrices, before, draws):
            for i, iteration in enumerate(draws.iters):
                # Bins are open on the left and closed on the right.
                at = np.searchsorted(edges[iteration][1:-1], own, side="left")
                for k, weight in enumerate((n[:, i], p[:, i], n[:, i] * own)):
                    sums[i, k] += np.bincount(at, weight, bins)
        i, b = np.nonzero(sums[:, 0])
        return pd.DataFrame({"iter": np.array(draws.iters)[i], "b": b, "n": sums[i, 0, b], "p": sums[i, 1, b], "s": sums[i, 2, b]})

    found = per_part(counts, [], "score", ["p", "n"], draws, binned, "iter int, b int, n double, p double, s double")
    per = found.groupBy("iter", "b").agg(*[F.sum(c).alias(c) for c in ("n", "p", "s")])
    return per.groupBy("iter").agg((F.sum(F.abs(F.col("p") - F.col("s"))) / F.sum("n")).alias("ece"))


def wasserstein(counts: DataFrame, scale: DataFrame, draws: Draws) -> DataFrame:
    """(iter, feature, value): normalised Wasserstein distance of each resample of (day, feature, value, n) from all rows."""
    totals: dict[str, np.ndarray] = {}
    everything: dict[str, float] = {}
    for r in counts.groupBy("feature", "day").agg(F.sum("n").alias("n")).collect():
        everything[r["feature"]] = everything.get(r["feature"], 0) + r["n"]
        if r["day"] in draws.days:
            totals.setdefault(r["feature"], np.zeros(len(draws.days)))[draws.days.index(r["day"])] += r["n"]
    # Days that are never drawn count for the reference only, so its sums come as a column of their own.
    whole = counts.groupBy("feature", "value").agg(F.sum("n").alias("r"))
    marked = counts.withColumn("r", F.lit(0)).unionByName(whole.select(F.lit(draws.days[0]).cast("long").alias("day"), "feature", "value", F.lit(0).alias("n"), "r"))

    def summed(key: tuple, values: np.ndarray, matrices: list, before: list) -> pd.DataFrame:
        feature, area = key[0], np.zeros(len(draws.iters))
        drawn, known = totals.get(feature, np.zeros(len(draws.days))) @ draws.matrix, everything[feature]
        reference = before[1].sum()
        for at in range(0, len(values), SLICE):
            n = matrices[0][at : at + SLICE] @ draws.matrix
            if not at:
                c = before[0] @ draws.matrix
            r = matrices[1][at : at + SLICE].sum(axis=1)
            upto, rupto = c + np.cumsum(n, axis=0), reference + np.cumsum(r)
            share = upto / np.where(drawn > 0, drawn, np.nan)
            after = np.abs(share - (rupto / known)[:, None])
            ahead = np.abs((upto - n) / np.where(drawn > 0, drawn, np.nan) - ((rupto - r) / known)[:, None])
            area += ((ahead - after) * values[at : at + SLICE][:, None]).sum(axis=0)
            c, reference = upto[-1], rupto[-1]
        return pd.DataFrame({"feature": feature, "iter": draws.iters, "area": area})

    found = per_part(marked, ["feature"], "value", ["n", "r"], draws, summed, "feature string, iter int, area double")
    areas = found.groupBy("feature", "iter").agg(F.sum("area").alias("area"))
    return areas.join(F.broadcast(scale), "feature").select("iter", "feature", F.when(~F.isnan("area"), F.col("area") / F.col("scale")).alias("value"))


def category_distance(counts: DataFrame, draws: Draws, smoothing: float) -> DataFrame:
    """(iter, feature, value): Jensen-Shannon distance of each resample of (day, feature, value, n) from all rows.

    Levels are dealt into pieces by hash; a resample's distance is a sum over levels.
    """
    totals: dict[str, np.ndarray] = {}
    for r in counts.groupBy("feature", "day").agg(F.sum("n").alias("n")).collect():
        if r["day"] in draws.days:
            totals.setdefault(r["feature"], np.zeros(len(draws.days)))[draws.days.index(r["day"])] += r["n"]
    joined = counts.groupBy("feature", "value").agg(F.sum("n").alias("whole"), F.collect_list(F.struct("day", "n")).alias("days"))
    size = {r["feature"]: (r["k"], r["n"]) for r in joined.groupBy("feature").agg(F.count(F.lit(1)).alias("k"), F.sum("whole").alias("n")).collect()}
    pieces = max((-(-k // PART) for k, _ in size.values()), default=1)
    piece = joined.withColumn("piece", F.pmod(F.xxhash64("value"), F.lit(pieces)))

    def summed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        feature = key[0]
        k, whole = size[feature]
        drawn = totals.get(feature, np.zeros(len(draws.days))) @ draws.matrix
        half = np.zeros(len(draws.iters))
        for at in range(0, len(pdf), SLICE):
            own = pdf.iloc[at : at + SLICE]
            flat = [(i, d["day"], d["n"]) for i, days in enumerate(own["days"]) for d in days]
            rows, days, n = (np.array(x) for x in zip(*flat))
            a = (draws.dense(rows, days, n.astype(np.float64), len(own)) @ draws.matrix + smoothing) / (drawn + smoothing * k)
            e = ((own["whole"].to_numpy(np.float64) + smoothing) / (whole + smoothing * k))[:, None]
            middle = (a + e) / 2
            with np.errstate(divide="ignore", invalid="ignore"):
                half += (np.where(a > 0, a * np.log2(a / middle), 0.0) + np.where(e > 0, e * np.log2(e / middle), 0.0)).sum(axis=0)
        return pd.DataFrame({"feature": feature, "iter": draws.iters, "half": half})

    found = piece.groupBy("feature", "piece").applyInPandas(summed, "feature string, iter int, half double")
    return found.groupBy("iter", "feature").agg(F.sqrt(F.greatest(F.sum("half") / 2, F.lit(0.0))).alias("value"))
