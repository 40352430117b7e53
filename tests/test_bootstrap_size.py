"""What the paired bootstrap reads and ships, and its figures where few scores hold many rows."""

from __future__ import annotations

import numpy as np
import pytest

from riskmon.operators import bootstrap
from tests.test_bootstrap import data, frame, metrics, small  # noqa: F401  (fixture)

COLUMNS = ["champion", "challenger"]


def test_scores_are_read_once(spark, small):  # noqa: F811
    seen, (y, a, b) = spark.sparkContext.accumulator(0), data(200)

    def passed(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = frame(spark, y, a, b)
    value, low, high = bootstrap.difference(rows.mapInPandas(passed, rows.schema), "pr_auc", 20)
    assert value == pytest.approx(metrics(y, b)[0] - metrics(y, a)[0], abs=1e-12) and low <= high
    assert seen.value == 200


def test_few_scores_of_many_combinations(spark, small):  # noqa: F811
    y, a, b = data()
    a = np.floor(a * 3) / 3
    rows = frame(spark, y, a, b)
    counts = bootstrap.combinations(rows, COLUMNS).cache()
    held = bootstrap.with_parts(counts, COLUMNS).toPandas()
    # A score is in one part, and parts are cut by combinations, not by distinct scores.
    assert held.groupby("champion")["part_champion"].nunique().max() == 1
    assert held["part_champion"].nunique() > held["champion"].nunique() / 2 and held["champion"].nunique() < 8
    drawn = bootstrap.draw(rows, COLUMNS, 10).toPandas()
    n = np.array([np.frombuffer(bootstrap.zlib.decompress(x), "<i8") for x in drawn["draws"]])
    got = {(r["of"], r["iter"]): (r["pr_auc"], r["roc_auc"]) for r in bootstrap.rankings(counts, COLUMNS, 10, 42).collect()}
    assert len(got) == 22
    for c in COLUMNS:
        for i in range(11):
            assert got[c, i] == pytest.approx(metrics(np.repeat(drawn["label"], n[:, i]).to_numpy(), np.repeat(drawn[c], n[:, i]).to_numpy()), abs=1e-12)


def test_packed_vectors_of_every_width():
    for top in (1, 127, 128, 40_000, 3_000_000_000):
        counts = np.array([[0, 1, top], [top, 0, 2]])
        assert (bootstrap.unpacked(bootstrap.packed(counts, bootstrap.narrowest(counts)), 2) == counts).all()
