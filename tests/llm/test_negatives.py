"""Hard negatives against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskmon.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label long, row string, v int, dim int, angles string, n int, score int, rank int"
LIMIT = 2**63


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "r", 1, 2, "a", 3, 4, 5) for i, v, y in rows], SCHEMA)


def brute(rows, positives=5, hard=3, window=(50, 95), anchor=lambda i: i % 10 == 0):
    held = [(i, [max(-LIMIT, min(LIMIT - 1, math.floor(256 * c))) for c in v], y) for i, v, y in rows if i is not None and y is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for at, (i, q, label) in enumerate(held):
        if not anchor(i):
            continue
        others = []
        for k, (j, v, y) in enumerate(held):
            if k != at and len(v) == len(q):
                others.append((-max(-LIMIT, min(LIMIT - 1, sum(a * b for a, b in zip(q, v)))), j, y == label))
        others.sort()
        for ps, p, _ in [o for o in others if o[2]][:positives]:
            fit = [o for o in others if not o[2] and window[0] * -ps <= 100 * -o[0] <= window[1] * -ps]
            out += [(i, p, r + 1, o[1], -ps, -o[0]) for r, o in enumerate(fit[:hard])]
    return sorted(out)


def check(spark, rows, **options):
    got = negatives.mine(frame(spark, rows).repartition(3), F.col("vec_id") % 10 == 0, **options)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def clustered(n, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    which = rng.integers(0, 6, n)
    points = centres[which] + 0.4 * rng.normal(size=(n, dim)) * rng.choice([0.2, 1, 3], size=(n, 1))
    return [(i, [float(x) for x in p], int(y)) for i, (p, y) in enumerate(zip(points, rng.integers(0, 3, n)))]


@pytest.mark.parametrize("shard_rows", [4096, 60])
def test_against_brute_force(spark, shard_rows):
    check(spark, clustered(900), shard_rows=shard_rows)


def test_ties_repeats_and_rows_that_take_no_part(spark):
    rows = [(i, [float(i % 3), 1.0, float(i % 2)], i % 2) for i in range(60)]
    rows += [(20, [0.0, 0.0, 0.0], 1), (30, [0.5, 0.25, 0.0], 0), (30, [0.5, 0.25, 0.0], 1), (40, [-1.0, -1.0, -2.0], 1)]
    rows += [(100, None, 1), (110, [], 1), (120, [1.0, None, 2.0], 1), (130, [math.nan, 1.0, 2.0], 0), (140, [1.0, 2.0, 3.0], None), (None, [1.0, 2.0, 3.0], 1), (150, [1.0, 2.0], 1), (151, [2.0, 2.0], 1), (152, [1.5, 1.0], 0)]
    # A third of all rows is one vector of one label.
    rows += [(1000 + i, [1.0, 1.0, 0.5], 7) for i in range(35)]
    for shard_rows in (4096, 10):
        check(spark, rows, shard_rows=shard_rows)


def test_scores_beyond_floating_point(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-(2**40), 2**40, 4)], i % 2) for i in range(50)] + [(60, [1e18, 1.0, 1e300, 0.0], 0), (61, [1e18, 2.0, 1e300, 0.0], 0), (62, [1e17, 2.0, 1.0, 0.5], 1)]
    check(spark, rows)


def test_few_rows_and_empty_table(spark):
    check(spark, [(0, [1.0, 2.0], 1)])
    check(spark, [(0, [1.0, 2.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 1.0], 2)])
    check(spark, [(0, [0.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, [0.0, 0.0], 2)])
    assert negatives.mine(frame(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    with pytest.raises(ValueError):
        negatives.mine(frame(spark, []), F.lit(True), window=(95, 50))


def test_bounds_lose_no_row_and_skip_some():
    rng = np.random.default_rng(2)
    skipped = 0
    for _ in range(200):
        dim = int(rng.integers(2, 6))
        refs = negatives.directions(rng.normal(size=(30, dim)), 4)
        rows = np.floor(60 * rng.normal(size=(80, dim)))
        norms = np.linalg.norm(rows, axis=1)
        theirs = np.arccos(np.clip(rows @ refs.T / np.maximum(norms, 1)[:, None], -1, 1))
        order = np.argsort(theirs[:, 0])
        rows, norms, theirs = rows[order], norms[order], theirs[order]
        anchors = np.floor(60 * (rng.normal(size=dim) + 0.1 * rng.normal(size=(5, dim))))
        norm = np.linalg.norm(anchors, axis=1)
        own = np.arccos(np.clip(anchors @ refs.T / np.maximum(norm, 1)[:, None], -1, 1))
        low = np.floor(rng.uniform(-0.2, 0.9, 5) * norm * np.median(norms))
        high = low + np.floor(rng.uniform(0, 1, 5) * norm * np.median(norms))
        kept = set(negatives.open_rows(low, high, norm, own, norms, theirs, 0).tolist())
        scores = anchors @ rows.T
        needed = set(np.flatnonzero(((scores >= low[:, None]) & (scores <= high[:, None])).any(axis=0)).tolist())
        assert needed <= kept
        skipped += 80 - len(kept)
    assert skipped > 1000


def test_clusters_are_skipped_by_their_windows(spark):
    rows = [(i, [100.0 * (i % 2), 100.0 * (1 - i % 2), float(i % 7) + 1], i % 3) for i in range(400)]
    check(spark, rows, shard_rows=40)
