"""Stratified bootstrap of ranking metrics for any number of rows.

Rows are counted per distinct combination of label and scores, and combinations are
dealt into buckets. For every resample a class's total is first divided among its
buckets and then, inside a bucket, among its combinations, both by multinomial laws:
together exactly the draw of all rows of the class with replacement, with the class
totals held fixed. A combination carries its counts of all resamples as one packed
vector, so no row is repeated per resample. A draw follows from its bucket alone and
is made again where it is needed: only the sums per score leave a bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmon.operators.metrics import bucketed
from riskmon.sources import scratch

# Combinations of a bucket of draws and of a part of the ranking, and vectors unpacked at a time.
BUCKET, PART, SLICE = 5000, 20_000, 512
METRICS = ("pr_auc", "roc_auc", "recall")


def packed(counts: np.ndarray, kind: str = "<i8") -> list[bytes]:
    return [zlib.compress(row.tobytes(), 1) for row in counts.astype(kind)]


def narrowest(counts: np.ndarray) -> str:
    return next(f"<i{size}" for size in (1, 2, 4, 8) if counts.max(initial=0) <= np.iinfo(f"<i{size}").max)


def unpacked(column: pd.Series, iterations: int) -> np.ndarray:
    """One row per vector; the length tells the kind of number."""
    out = np.empty((len(column), iterations + 1), np.int64)
    for i, x in enumerate(column):
        raw = zlib.decompress(x)
        out[i] = np.frombuffer(raw, f"<i{len(raw) // (iterations + 1)}")
    return out


def combinations(scores: DataFrame, columns: list[str]) -> DataFrame:
    return scores.groupBy(F.col("label").cast("int").alias("label"), *[F.col(c).cast("double").alias(c) for c in columns]).agg(F.count(F.lit(1)).alias("n"))


def resampler(counts: DataFrame, columns: list[str], iterations: int, seed: int) -> Callable[[Callable, str], DataFrame] | None:
    """A function that runs `body(rows, draws)` on every bucket of `combinations`; None for a single class.

    rows are of one label, and draws holds how often each occurs, as it is (place 0) and
    in each resample. A draw depends on the seed, the bucket and the resample only, so a
    task that runs again draws the same.
    """
    buckets = max(1, -(-counts.count() // BUCKET))
    placed = counts.withColumn("bucket", F.pmod(F.xxhash64("label", *columns), F.lit(buckets)))
    # Bounded by combinations / BUCKET.
    sizes = placed.groupBy("label", "bucket").agg(F.sum("n").alias("n")).orderBy("label", "bucket").collect()
    of = {y: ([r["bucket"] for r in sizes if r["label"] == y], np.array([r["n"] for r in sizes if r["label"] == y], np.float64)) for y in {r["label"] for r in sizes}}
    if len(of) < 2:
        return None

    def divided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in pdf["id"].tolist():
                for y, (names, n) in of.items():
                    total = np.random.default_rng([seed, y, i]).multinomial(int(n.sum()), n / n.sum())
                    yield pd.DataFrame({"label": np.int32(y), "bucket": names, "iter": np.int64(i), "total": total})

    schema = "label int, bucket long, iter long, total long"
    totals = counts.sparkSession.range(1, iterations + 1).mapInPandas(divided, schema).withColumnsRenamed({"label": "of_label", "bucket": "of_bucket"})

    def run(body: Callable, names: str) -> DataFrame:
        def drawn(key: tuple, rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(columns).reset_index(drop=True)
            n = rows["n"].to_numpy(np.float64)
            counts = np.zeros((len(rows), iterations + 1), np.int64)
            counts[:, 0] = n
            for i, total in zip(given["iter"], given["total"]):
                counts[:, i] = np.random.default_rng([seed, int(key[0]), int(key[1]), int(i)]).multinomial(int(total), n / n.sum())
            return body(rows, counts)

        return placed.groupBy("label", "bucket").cogroup(totals.groupBy("of_label", "of_bucket")).applyInPandas(drawn, names)

    return run


def draw(scores: DataFrame, columns: list[str], iterations: int, seed: int = 42) -> DataFrame | None:
    """(label, columns..., draws): how often each combination occurs, as it is (place 0) and in each resample. None for a single class."""
    run = resampler(combinations(scores, columns), columns, iterations, seed)
    names = ", ".join(["label int", *(f"{c} double" for c in columns), "draws binary"])
    return None if run is None else run(lambda rows, n: rows[["label", *columns]].assign(draws=packed(n)), names)


def recall(drawn: DataFrame, column: str, iterations: int) -> DataFrame:
    """(iter, value): recall of 0/1 decisions."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums = np.zeros((2, iterations + 1))
            for at in range(0, len(pdf), SLICE):
                part = pdf.iloc[at : at + SLICE]
                n = unpacked(part["draws"], iterations) * (part["label"] == 1).to_numpy()[:, None]
                sums += n.sum(axis=0), (n * part[column].to_numpy()[:, None]).sum(axis=0)
            yield pd.DataFrame({"iter": range(iterations + 1), "whole": sums[0], "hit": sums[1]})

    found = drawn.select("label", column, "draws").mapInPandas(summed, "iter int, whole double, hit double")
    return found.groupBy("iter").agg(F.try_divide(F.sum("hit"), F.sum("whole")).alias("value"))


def with_parts(counts: DataFrame, columns: list[str]) -> DataFrame:
    """counts with part_<c>: the place of each score in the ranking, in parts of about PART combinations; a score is in one part, however many hold it."""
    parts = max(1, -(-counts.count() // PART))
    for c in columns:
        counts = bucketed(counts, [], c, parts).withColumnRenamed("__bucket", f"part_{c}")
    return counts


def ranked(rows: DataFrame, heads: DataFrame, iterations: int) -> DataFrame:
    """(of, iter, pr_auc, roc_auc) with tie credit from rows (of, part, label, score, draws), `of` naming the score that ranks.

    `heads` (of, part, label, draws) add up to the same per part: each part is ranked
    with the sums of the higher ones.
    """

    def summed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros((2, iterations + 1))
        for at in range(0, len(pdf), SLICE):
            own = pdf.iloc[at : at + SLICE]
            n = unpacked(own["draws"], iterations)
            sums += n[(own["label"] == 1).to_numpy()].sum(axis=0), n.sum(axis=0)
        return pd.DataFrame({"of": key[0], "part": key[1], "iter": range(iterations + 1), "p": sums[0], "n": sums[1]})

    def by_score(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positives and rows per distinct score and resample, the highest scores first; a score never crosses two steps."""
        pdf = pdf.sort_values("score", ascending=False, kind="stable")
        score, positive = pdf["score"].to_numpy(), (pdf["label"] == 1).to_numpy()[:, None]
        carried = np.zeros((2, iterations + 1))
        for at in range(0, len(pdf), SLICE):
            end = min(at + SLICE, len(pdf))
            edges = np.flatnonzero(np.append(True, score[at + 1 : end] != score[at : end - 1]))
            counts = unpacked(pdf["draws"].iloc[at:end], iterations)
            p, n = (np.add.reduceat(x, edges, axis=0).astype(np.float64) for x in (counts * positive[at:end], counts))
            p[0] += carried[0]
            n[0] += carried[1]
            carried[:] = 0
            if end < len(pdf) and score[end] == score[end - 1]:
                carried[:] = p[-1], n[-1]
                p, n = p[:-1], n[:-1]
            if len(n):
                yield p, n

    per = heads.groupBy("of", "part").applyInPandas(summed, "of string, part int, iter int, p double, n double")
    above = Window.partitionBy("of", "iter").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("of", "part", "iter", *[F.coalesce(F.sum(c).over(above), F.lit(0.0)).alias(c) for c in ("p", "n")])

    def placed(key: tuple, rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        given = given.sort_values("iter")
        up, un = given["p"].to_numpy(np.float64), given["n"].to_numpy(np.float64)
        out = np.zeros((4, iterations + 1))
        for p, n in by_score(rows):
            cp, cn = up + np.cumsum(p, axis=0), un + np.cumsum(n, axis=0)
            out += (p * cp / np.where(cn > 0, cn, 1)).sum(axis=0), ((n - p) * (cp - p / 2)).sum(axis=0), p.sum(axis=0), n.sum(axis=0)
            up, un = cp[-1], cn[-1]
        return pd.DataFrame({"of": key[0], "iter": range(iterations + 1), **dict(zip(("ap", "area", "p", "n"), out))})

    each = rows.groupBy("of", "part").cogroup(before.groupBy("of", "part")).applyInPandas(placed, "of string, iter int, ap double, area double, p double, n double")
    sums = each.groupBy("of", "iter").agg(*[F.sum(c).alias(c) for c in ("ap", "area", "p", "n")])
    return sums.select("of", "iter", F.try_divide("ap", "p").alias("pr_auc"), F.try_divide("area", F.col("p") * (F.col("n") - F.col("p"))).alias("roc_auc"))


def ranking(drawn: DataFrame, column: str, iterations: int) -> DataFrame:
    """(iter, pr_auc, roc_auc) of drawn combinations, ranked by one of the scores."""
    rows = with_parts(drawn, [column]).select(F.lit(column).alias("of"), F.col(f"part_{column}").alias("part"), "label", F.col(column).alias("score"), "draws")
    return ranked(rows, rows.drop("score"), iterations).drop("of")


def rankings(counts: DataFrame, columns: list[str], iterations: int, seed: int) -> DataFrame | None:
    """(of, iter, pr_auc, roc_auc) of `combinations`, ranked by each of the scores under the same resamples; None for a single class."""
    run = resampler(with_parts(counts, columns), columns, iterations, seed)

    def added(rows: pd.DataFrame, n: np.ndarray, by: str) -> tuple[np.ndarray, list[bytes]]:
        """The first row of each value of a column, and the packed sum of its draws."""
        key = rows[by].to_numpy()
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        sums = np.add.reduceat(n[order], first, axis=0)
        return order[first], packed(sums, narrowest(sums))

    def spread(rows: pd.DataFrame, n: np.ndarray, by: str) -> pd.DataFrame:
        out = []
        for c in columns:
            at, sums = added(rows, n, by + c)
            out.append(pd.DataFrame({"of": c, "part": rows[f"part_{c}"].to_numpy()[at], "label": rows["label"].to_numpy()[at], "score": rows[c].to_numpy()[at], "draws": sums}))
        return pd.concat(out)

    schema = "of string, part int, label int, score double, draws binary"
    if run is None:
        return None
    return ranked(run(lambda rows, n: spread(rows, n, ""), schema), run(lambda rows, n: spread(rows, n, "part_"), schema).drop("score"), iterations)


def values(counts: DataFrame, columns: list[str], metric: str, iterations: int, seed: int) -> DataFrame | None:
    """(of, iter, value) of each of the scores of `combinations` under one of METRICS; None for a single class."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    if metric != "recall":
        found = rankings(counts, columns, iterations, seed)
        return None if found is None else found.select("of", "iter", F.col(metric).alias("value"))
    run = resampler(counts, columns, iterations, seed)
    if run is None:
        return None
    names = ", ".join(["label int", *(f"{c} double" for c in columns), "draws binary"])
    drawn = run(lambda rows, n: rows[["label", *columns]].assign(draws=packed(n, narrowest(n))), names)
    each = [recall(drawn, c, iterations).select(F.lit(c).alias("of"), "iter", "value") for c in columns]
    return reduce(DataFrame.unionByName, each)


def bounds(found: DataFrame, level: float) -> tuple[float, float, float]:
    """(value, lower, upper): of the rows as they are, and percentiles over the resamples; one row per resample."""
    ends = F.percentile(F.when(F.col("iter") > 0, F.col("value")), F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    value, (low, high) = found.agg(F.max(F.when(F.col("iter") == 0, F.col("value"))), ends).first()
    return value, low, high


def interval(scores: DataFrame, metric: str, iterations: int = 500, level: float = 0.95, seed: int = 42) -> tuple[float, float, float] | None:
    """(value, lower, upper) of a metric of (label, score); None for a single class."""
    with scratch.held(combinations(scores, ["score"]), "combinations") as counts:
        found = values(counts, ["score"], metric, iterations, seed)
        return None if found is None else bounds(found, level)


def difference(scores: DataFrame, metric: str, iterations: int = 500, level: float = 0.95, seed: int = 42) -> tuple[float, float, float] | None:
    """(value, lower, upper) of metric(challenger) - metric(champion) of (label, champion, challenger), both from the same resamples."""
    columns = ["champion", "challenger"]
    with scratch.held(combinations(scores, columns), "combinations") as counts:
        found = values(counts, columns, metric, iterations, seed)
        if found is None:
            return None
        first, second = (F.max(F.when(F.col("of") == c, F.col("value"))) for c in columns)
        return bounds(found.groupBy("iter").agg((second - first).alias("value")), level)
