"""Whitening against numpy on whole numbers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from riskmon.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int, x int, index long, part int, n string, z array<int>"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, "n", [5]) for i, v in rows], SCHEMA)


def brute(rows, components=4):
    """{(vec_id, component): (n, deviation, whitened up to sign, explained)} by numpy over the distinct vectors."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    held = [(i, [min(max(math.floor(256 * c), -(2**63)), 2**63 - 1) for c in v]) for i, v in good]
    fit = sorted({tuple(x) for _, x in held})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[c - s / n for c, s in zip(x, sums)] for x in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    out = []
    for i, x in held:
        deviation = min(sum((n * c - s) ** 2 for c, s in zip(x, sums)), 2**63 - 1)
        for k in range(min(components, len(values))):
            e = values[::-1][k]
            y = np.dot([c - s / n for c, s in zip(x, sums)], axes[:, ::-1][:, k])
            out.append((i, k + 1, n, deviation, abs(y) / math.sqrt(e) if e > 1e-9 * values.sum() else None, e / values.sum() if values.sum() > 0 else None))
    return sorted(out, key=lambda r: (str(r[0]), r[1], r[3]))


def close(a, b):
    return a is None and b is None or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-7)


def check(spark, rows):
    got = whitening.whiten(frame(spark, rows).repartition(3)).collect()
    held = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"] if r["whitened"] is None else abs(r["whitened"]), r["explained"]) for r in got), key=lambda r: (str(r[0]), r[1], r[3]))
    want = brute(rows)
    assert [r[:4] for r in held] == [r[:4] for r in want]
    assert all(close(a[4], b[4]) and close(a[5], b[5]) for a, b in zip(held, want))
    return got


@pytest.mark.parametrize("dim, n", [(3, 40), (6, 2500), (1, 9)])
def test_against_numpy(spark, dim, n):
    rng = np.random.default_rng(dim)
    spread = rng.normal(size=(dim, dim))
    rows = [(i, (rng.normal(size=dim) @ spread).tolist()) for i in range(n)]
    # A third of all rows is one vector, which the fit list holds once.
    rows += [(n + i, rows[0][1]) for i in range(n // 2)] + [(7, rows[1][1]), (None, rows[2][1]), (None, rows[2][1])]
    got = check(spark, rows)
    assert max(r["identity_error"] for r in got) < 1e-9
    by = {k: [r["whitened"] for r in got if r["component"] == k and r["vec_id"] == n] for k in range(1, min(dim, 4) + 1)}
    assert all(len(v) == 1 for v in by.values())


def test_signs_are_the_same_for_all_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    got = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whiten(frame(spark, rows)).collect()}
    x = np.floor(256 * np.array([v for _, v in rows]))
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    for k in range(4):
        want = (x - x.mean(axis=0)) @ axes[:, 3 - k] / math.sqrt(values[3 - k])
        own = np.array([got[i, k + 1] for i in range(60)])
        assert np.allclose(own, want, atol=1e-8) or np.allclose(own, -want, atol=1e-8)


def test_rows_that_take_no_part(spark):
    rng = random.Random(1)
    rows = [(i, [rng.random(), rng.random(), 0.5, -rng.random()]) for i in range(30)]
    odd = [(50, None), (51, []), (52, [1.0, None, 2.0, 3.0]), (53, [float("nan")] * 4), (54, [1.0, float("-inf"), 0.0, 0.0])]
    check(spark, rows + odd)
    # Vectors of another length than most are left out.
    got = whitening.whiten(frame(spark, rows + [(60, [1.0, 2.0])])).collect()
    assert {r["vec_id"] for r in got} == set(range(30))


def test_no_variance_and_empty_table(spark):
    got = whitening.whiten(frame(spark, [(1, [0.5, -0.0]), (2, [0.5, 0.0])])).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got) == [
        (i, c, 1, 0, None, None, 0.0) for i in (1, 2) for c in (1, 2)
    ]
    empty = whitening.whiten(frame(spark, []))
    assert empty.count() == 0 and empty.columns == [c.split()[0] for c in whitening.OUT.split(", ")]


def test_exact_deviations_of_large_numbers(spark):
    rows = [(i, [float(2**44 + 3 * i), -float(i * 2**40), 0.25 * i]) for i in range(9)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(frame(spark, rows)).collect()}
    assert got == {r[0]: r[3] for r in brute(rows)}
    rows = [(i, [1e300 * (-1) ** i, 1.0 * i, 2.0]) for i in range(5)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(frame(spark, rows)).collect()}
    assert got == {r[0]: r[3] for r in brute(rows)}
