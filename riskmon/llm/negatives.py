"""Hard-negative mining by angular triangle filtering.

Every vector stores its norm and its angles to a few reference directions. By the
triangle inequality of angles, two vectors lie at least as far apart as their
angles to any reference differ, and at most as far as those add up to, so stored
angles bound the cosine, and with the norms the score. Vectors are dealt into
cells by their nearest reference and by a window of the angle to it, and cells
into shards. Anchors meet only the shards whose windows overlap what their scores
still need, inside a shard only the rows whose bounds do, and those alone get
integer scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskmon.llm.common import discard, join_counted, materialize, prepared
from riskmon.llm.search import quantized

REFERENCES, SHARD, GROUP, BLOCK = 16, 4096, 1024, 64
# References are chosen among at most so many vectors and numbers.
SAMPLE_ROWS, SAMPLE_NUMBERS = 4096, 1 << 22
# Shards that one task compares with a group of anchors; angle windows of one reference.
RUN, WINDOWS = 16, 256
# Rounding of angles in radians, and of scores as a share.
SLACK, SHARE = 1e-6, 1e-9
LEAST, MOST = -(2**63), 2**63 - 1
EXACT = float(2**53)


def directions(points: np.ndarray, n: int) -> np.ndarray:
    """Up to n unit vectors of the sample, each the farthest in angle from those before it."""
    norms = np.linalg.norm(points, axis=1)
    units = points[norms > 0] / norms[norms > 0][:, None]
    if not len(units):
        return np.eye(1, points.shape[1] if points.ndim == 2 and points.shape[1] else 1)
    chosen, nearest = [0], units @ units[0]
    while len(chosen) < min(n, len(units)):
        far = int(np.argmin(nearest))
        if nearest[far] > 1 - 1e-9:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, units @ units[far])
    return units[chosen]


def fitted(references: np.ndarray, dim: int) -> np.ndarray:
    """The references in another number of dimensions; any direction serves."""
    out = np.zeros((len(references), dim))
    out[:, : min(dim, references.shape[1])] = references[:, :dim]
    norms = np.linalg.norm(out, axis=1)
    out[norms == 0, 0] = 1.0
    return out / np.linalg.norm(out, axis=1)[:, None]


MEASURED = "row long, vec_id long, label long, v array<double>, is_anchor boolean, dim int, norm double, angles array<double>, home int, bin int"


def measured(rows: DataFrame, references: np.ndarray, homes: int, windows: int) -> DataFrame:
    """rows with their norm, their angles to the references, and their cell: the nearest of the first `homes` references and a window of the angle to it."""

    def angled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            norm, angles = np.zeros(len(pdf)), np.zeros((len(pdf), len(references)))
            sizes = pdf["dim"].to_numpy()
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                data = np.stack(pdf["v"].to_numpy()[own])
                norm[own] = np.linalg.norm(data, axis=1)
                # The angle of a zero vector is never used.
                cosine = data @ fitted(references, int(dim)).T / np.where(norm[own] > 0, norm[own], 1)[:, None]
                angles[own] = np.arccos(np.clip(cosine, -1, 1))
            home = np.argmin(angles[:, :homes], axis=1)
            bin_ = np.minimum(angles[np.arange(len(pdf)), home] * (windows / math.pi), windows - 1).astype(np.int32)
            yield pdf.assign(norm=norm, angles=list(angles), home=home.astype(np.int32), bin=bin_)

    return rows.mapInPandas(angled, MEASURED)


def number(part: Column) -> Column:
    """The number of a part of a cell."""
    return F.shiftleft(F.col("home").cast("long"), 50) + F.shiftleft(F.col("bin").cast("long"), 40) + part


def parted(rows: DataFrame, most: int, name: str) -> DataFrame:
    """rows with a number of their part of their cell, of about `most` rows."""
    key = ["dim", "home", "bin"]
    parts = materialize(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "cells")
    return join_counted(rows, parts, key).withColumn(name, number(F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / most)))).drop("n")


SHARDS = "dim int, home int, bin int, shard long, rows binary, ids binary, labels binary, kind string, v binary, norms binary, angles binary, lo array<double>, hi array<double>, most double"


def packed(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard as one row, its vectors in the order of their angle to the reference of their cell."""
    angles = np.stack(pdf["angles"].to_numpy())
    order = np.argsort(angles[:, int(pdf["home"].iloc[0])], kind="stable")
    pdf, angles = pdf.iloc[order], angles[order]
    v, norms = np.stack(pdf["v"].to_numpy()), pdf["norm"].to_numpy(np.float64)
    widest = np.abs(v).max()
    kind = "int16" if widest < 2**15 else "int32" if widest < 2**31 else "float64"
    whole = [pdf[c].to_numpy(np.int64).tobytes() for c in ("row", "vec_id", "label")]
    head = [pdf[c].iloc[0] for c in ("dim", "home", "bin", "shard")]
    return pd.DataFrame(
        [[*head, *whole, kind, v.astype(kind).tobytes(), norms.tobytes(), angles.tobytes(), angles.min(axis=0), angles.max(axis=0), norms.max()]],
        columns=[c.split()[0] for c in SHARDS.split(", ")],
    )


def open_rows(low: np.ndarray, high: np.ndarray, norm: np.ndarray, angles: np.ndarray, norms: np.ndarray, theirs: np.ndarray, home: int) -> np.ndarray:
    """Rows of a shard whose score bounds overlap low..high of any anchor of the block.

    `angles` are those of the anchors, `theirs` those of the shard, which is sorted by `theirs[:, home]`.
    """
    need = np.min(low / norm) * (1 - SHARE) if (norm > 0).all() and (low > 0).all() else 0.0
    first, last = angles.min(axis=0), angles.max(axis=0)
    a, b = 0, len(norms)
    reach = np.full(len(norms), math.pi)
    if need > 0:
        # A score of at least need x norm is possible within this angle only.
        reach = np.arccos(np.clip(need / np.maximum(norms, 1e-300), -1, 1)) + SLACK
        widest = reach.max()
        a, b = np.searchsorted(theirs[:, home], (first[home] - widest, last[home] + widest))
        b = int(np.searchsorted(theirs[:, home], last[home] + widest, side="right"))
    own, reach = theirs[a:b], reach[a:b]
    keep = ((own >= first - reach[:, None]) & (own <= last + reach[:, None])).all(axis=1)
    if need > 0:
        keep &= norms[a:b] >= need
    # The largest angle to any anchor, and so the least score with it.
    most = np.minimum(np.minimum((last + own).min(axis=1), (2 * math.pi - first - own).min(axis=1)) + SLACK, math.pi)
    cosine = np.cos(most) - SLACK
    least = cosine * norms[a:b] * np.where(cosine > 0, norm.min(), norm.max())
    keep &= least - np.abs(least) * SHARE <= high.max()
    return a + np.flatnonzero(keep)


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers of Python, beyond a long the nearest long."""
    left, right = ([[int(x) for x in v] for v in side] for side in (queries, vectors))
    out = np.empty((len(left), len(right)), object)
    for i, q in enumerate(left):
        out[i] = [max(LEAST, min(MOST, sum(x * y for x, y in zip(q, v)))) for v in right]
    return out


FOUND = "query_row long, asked long, row long, vec_id long, score long"


def answer(group: pd.Series, shards: pd.DataFrame, k: int, same: bool, window: tuple[int, int] | None) -> pd.DataFrame:
    """For each anchor of the group and each window of scores that it asks for, the k best rows of the shards with the same or another label.

    With `window` an anchor asks once per positive score, for scores in those
    percents of it; else once, for scores from the one given on. Every shard's rows
    raise the least score that the next ones have to reach.
    """
    queries, norm, angles = np.array([list(v) for v in group["v"]], np.float64), np.array(group["norms"], np.float64), np.array([list(a) for a in group["angles"]], np.float64)
    labels, own = np.array(group["labels"], np.int64), np.array(group["rows"], np.int64)
    asked: list[list[int]] = []
    slots: list[list[int]] = []
    low, high, best = [], [], []
    for i, scores in enumerate(group["needs"]):
        slots.append([])
        for s in map(int, scores):
            slots[i].append(len(asked))
            asked.append([i, s])
            low.append(-((-window[0] * s) // 100) if window else s)
            high.append(window[1] * s // 100 if window else MOST)
            best.append([])
    out_of = ~np.array([bool(s) for s in slots])
    for shard in shards.itertuples(index=False):
        rows, ids, theirs = (np.frombuffer(x, np.int64) for x in (shard.rows, shard.ids, shard.labels))
        vectors = np.frombuffer(shard.v, shard.kind).reshape(len(rows), -1)
        norms, stored = np.frombuffer(shard.norms, np.float64), np.frombuffer(shard.angles, np.float64).reshape(len(rows), -1)
        wide = float(np.abs(queries).max(axis=0) @ np.abs(vectors.astype(np.float64)).max(axis=0)) >= EXACT
        for start in range(0, len(queries), BLOCK):
            block = np.arange(start, min(start + BLOCK, len(queries)))
            block = block[~out_of[block]]
            if not len(block):
                continue
            least = np.array([min(low[s] for s in slots[i]) for i in block], np.float64)
            most = np.array([max(high[s] for s in slots[i]) for i in block], np.float64)
            # Without floating point that is exact, no row is left out.
            picked = np.arange(len(rows)) if wide else open_rows(least, most, norm[block], angles[block], norms, stored, shard.home)
            if not len(picked):
                continue
            scores = exact_scores(queries[block], vectors[picked]) if wide else queries[block] @ vectors[picked].astype(np.float64).T
            fits = (labels[block][:, None] == theirs[picked][None, :]) == same
            fits &= own[block][:, None] != rows[picked][None, :]
            if not wide:
                fits &= (scores >= least[:, None]) & (scores <= most[:, None])
            for at in np.flatnonzero(fits.any(axis=1)).tolist():
                fit = np.flatnonzero(fits[at])
                values = scores[at, fit]
                for s in slots[block[at]]:
                    ok = (values >= low[s]) & (values <= high[s])
                    chosen, points = picked[fit[ok.astype(bool)]], values[ok.astype(bool)]
                    if not len(chosen):
                        continue
                    order = np.lexsort((rows[chosen], ids[chosen]))
                    order = order[np.argsort(-points[order], kind="stable")][:k]
                    best[s] = sorted(best[s] + [(-int(points[o]), int(ids[chosen[o]]), int(rows[chosen[o]])) for o in order])[:k]
                    if len(best[s]) == k:
                        low[s] = max(low[s], -best[s][-1][0])
    out = [(own[i], s if window else 0, row, ident, -score) for (i, s), held in zip(asked, best) for score, ident, row in held]
    return pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")], dtype="int64")


def grouped(anchors: DataFrame) -> DataFrame:
    """One row per group of anchors, with its bounds: the span of angles to each reference, and the least score per norm that an anchor needs.

    `needs` are the scores an anchor asks for and `least` the lowest that can serve it.
    """
    names = ("row", "label", "v", "norm", "angles", "needs")
    order = F.element_at("angles", F.col("home") + 1)
    held = F.array_sort(F.collect_list(F.struct(order.alias("o"), *names))).alias("q")
    need = F.when(F.min(F.when((F.col("least") > 0) & (F.col("norm") > 0), 1).otherwise(0)) == 1, F.min(F.try_divide("least", "norm")))

    def corner(pick) -> Column:
        return F.aggregate("q.angles", F.get("q.angles", F.lit(0)), lambda acc, a: F.zip_with(acc, a, lambda x, y: pick(x, y)))

    per = anchors.groupBy("dim", "home", "bin", "group").agg(held, need.alias("need"))
    fields = [F.col(f"q.{n}").alias(m) for n, m in zip(names, ("rows", "labels", "v", "norms", "angles", "needs"))]
    return per.select("dim", "home", "bin", "group", "need", corner(F.least).alias("first"), corner(F.greatest).alias("last"), *fields)


def reached(groups: DataFrame, shards: DataFrame, homes: int, windows: int) -> DataFrame:
    """(dim, group, shard, own): the shards whose angles and norms leave room for what an anchor of the group needs.

    Each group asks, for every reference that has cells, for the windows of angle it
    reaches, so pairs come from an equal join of cells, not from all of both sides.
    """

    def within(norm: Column) -> Column:
        # Angle within which a vector of this norm can score what is needed.
        return F.when(F.col("need").isNull(), F.lit(math.pi)).otherwise(F.acos(F.least(F.lit(1.0), F.col("need") * (1 - SHARE) / norm)) + SLACK)

    largest = shards.agg(F.max("most")).first()[0] or 0.0
    asks = groups.select("dim", "group", "need", "first", "last", within(F.lit(max(largest, 1e-300))).alias("reach"), F.col("home").alias("own_home"), F.col("bin").alias("own_bin"))
    asks = asks.withColumn("home", F.explode(F.sequence(F.lit(0), F.lit(homes - 1))))

    def window(value: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(windows - 1), F.floor(value * (windows / math.pi)).cast("int")))

    at = F.col("home") + 1
    spread = F.sequence(window(F.element_at("first", at) - F.col("reach")), window(F.element_at("last", at) + F.col("reach")))
    met = asks.withColumn("bin", F.explode(spread)).join(shards.select("dim", "home", "bin", "shard", "lo", "hi", "most"), ["dim", "home", "bin"])
    close = within(F.greatest("most", F.lit(1e-300)))
    apart = F.exists(F.zip_with(F.zip_with("first", "hi", lambda f, h: f - h), F.zip_with("lo", "last", lambda x, e: x - e), lambda a, b: F.greatest(a, b)), lambda gap: gap > F.col("close"))
    met = met.where(F.col("need").isNull() | (F.col("most") >= F.col("need") * (1 - SHARE))).withColumn("close", close).where(~apart)
    own = (F.col("home") == F.col("own_home")) & (F.col("bin") == F.col("own_bin"))
    return met.select("dim", "group", "shard", own.alias("own"))


def answered(pairs: DataFrame, groups: DataFrame, shards: DataFrame, k: int, same: bool, window: tuple[int, int] | None = None) -> DataFrame:
    """`answer` for every group over its shards, about RUN of them in a task."""
    per = pairs.groupBy("dim", "group").agg(F.ceil(F.count(F.lit(1)) / RUN).alias("runs"))
    runs = materialize(pairs.join(per, ["dim", "group"]).select("dim", "group", "shard", F.pmod(F.xxhash64("shard"), F.col("runs")).alias("run")), "runs")
    left = runs.select("dim", "group", "run").distinct().join(groups.drop("home", "bin", "need", "first", "last"), ["dim", "group"])
    right = runs.join(shards.drop("bin", "lo", "hi", "most"), ["dim", "shard"])

    def compared(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        return answer(ours.iloc[0], theirs, k, same, window)

    key = ("dim", "group", "run")
    right = right.withColumnsRenamed({c: f"of_{c}" for c in key})
    return left.groupBy(*key).cogroup(right.groupBy(*[f"of_{c}" for c in key])).applyInPandas(compared, FOUND)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), shard_rows: int = SHARD) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the hard negatives.

    `vectors` holds vec_id, embedding and label. Scores are integer inner products of
    floor(256 embedding). An anchor's positives are the best other rows of its label;
    for each of them the negatives are the best rows of another label whose score lies
    in `window`, in percent of the positive's. Ties go to the smaller id. Rows with a
    null label, a null or empty vector, a null or non-finite component or without an id
    take no part; vectors of another length than the anchor's are neither; every row
    counts by itself, so rows that repeat an id are positives and negatives of their own
    and each anchor row gets its rows; a positive of negative score has an empty window;
    components and scores beyond a long count as the nearest long; vectors may be of any
    length; other columns of any name play no part; an empty table gives no row.
    References are chosen among a bounded sample and only decide how much is skipped.
    """
    if not window[0] < window[1]:
        raise ValueError("the window must not be empty")
    prepared(vectors.sparkSession)
    usable = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), quantized(F.col("embedding")).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    usable = usable.where("vec_id is not null and label is not null and v is not null")
    rows = materialize(usable.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v", "is_anchor", F.size("v").alias("dim")), "vectors")
    sizes = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    usual, total = sizes["dim"] if sizes else 1, rows.count()
    sample = rows.where(F.col("dim") == usual).orderBy(F.xxhash64("row")).select("v").limit(max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // usual))).collect()
    references = directions(np.array([r["v"] for r in sample], np.float64).reshape(-1, usual), REFERENCES)
    # Cells grow in number with the rows, as squares do: by references and by windows of their angles.
    cells = max(1, total // shard_rows)
    homes = min(len(references), math.ceil(math.sqrt(cells)))
    windows = min(WINDOWS, 4 * math.ceil(cells / homes))
    placed = materialize(measured(rows, references, homes, windows), "angles")
    discard(rows)
    shards = materialize(parted(placed.drop("is_anchor"), shard_rows, "shard").groupBy("dim", "shard").applyInPandas(packed, SHARDS), "shards")
    anchors = materialize(parted(placed.where("is_anchor"), GROUP, "group"), "anchors")
    discard(placed)
    floorless = anchors.withColumn("needs", F.array(F.lit(LEAST).cast("long"))).withColumn("least", F.lit(float("-inf")))
    ranked = Window.partitionBy("query_row", "asked").orderBy(F.desc("score"), "vec_id", "row")

    def first(found: DataFrame, k: int) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)

    # First the anchor's own cell; what is found there is the least that the others have to reach.
    groups = materialize(grouped(floorless), "groups")
    at_home = materialize(answered(reached(groups, shards, homes, windows).where("own"), groups, shards, positives, True), "home")
    kth = first(at_home, positives).groupBy("query_row").agg(F.when(F.count(F.lit(1)) == positives, F.min("score")).alias("kth"))
    floored = anchors.join(kth.withColumnRenamed("query_row", "row"), "row", "left").withColumn("kth", F.coalesce("kth", F.lit(LEAST).cast("long")))
    groups = materialize(grouped(floored.withColumn("needs", F.array("kth")).withColumn("least", F.col("kth").cast("double"))), "groups")
    elsewhere = answered(reached(groups, shards, homes, windows).where("not own"), groups, shards, positives, True)
    likes = materialize(first(at_home.unionByName(elsewhere), positives).select("query_row", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    asked = likes.where("positive_score >= 0").groupBy("query_row").agg(F.sort_array(F.collect_set("positive_score")).alias("needs"))
    asking = anchors.join(asked.withColumnRenamed("query_row", "row"), "row").withColumn("least", F.get("needs", F.lit(0)).cast("double") * window[0] / 100)
    groups = materialize(grouped(asking), "groups")
    found = first(answered(reached(groups, shards, homes, windows), groups, shards, negatives, False, window), negatives)
    named = found.join(likes.where("positive_score >= 0").withColumnRenamed("positive_score", "asked"), ["query_row", "asked"])
    return named.join(anchors.select(F.col("row").alias("query_row"), F.col("vec_id").alias("anchor_id")), "query_row").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("asked").alias("positive_score"), F.col("score").alias("negative_score")
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = prepared(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", shifted), F.col("vec_id") % 50 == 0)


SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
      FROM r a JOIN r c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
