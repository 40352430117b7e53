"""The pipeline's near-duplicate stage against brute force at similarities from 0.80 to 0.85, with rows without an id."""

from __future__ import annotations

import corpus_pipeline
from riskmon.llm import minhash
from riskmon.llm.common import join_counted, materialize
from tests.llm.conftest import make, prose
from tests.llm.test_dedup import shingles


def brute_kept(rows):
    """Texts of the rows that are first in their group; rows without an id come after all others."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    sets = [shingles(rows[i][1]) for i in order]
    top = list(range(len(order)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return [rows[order[i]] for i in range(len(order)) if find(i) == i]


def test_near_duplicate_stage(spark):
    rows, similar = [], []
    for i in range(24):
        base = prose(100 + i, 60 + i).split()
        n = len(base) - 4
        # One more tail of m words makes the similarity n / (n + m), one fewer shows the other side of 0.80.
        longer = base + prose(200 + i, n // 4 + i % 2).split()
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(longer))]
        a, b = shingles(rows[-1][1]), shingles(rows[-2][1])
        similar.append(len(a & b) / len(a | b))
    assert sum(0.8 <= s < 0.85 for s in similar) >= 10 and any(s < 0.8 for s in similar)
    alone = prose(301, 40)
    rows += [(None, rows[0][1]), (None, alone), (None, alone), (None, prose(302, 30)), (None, ""), (None, None), (None, " "), (60, ""), (61, None)]
    got = corpus_pipeline.drop_near_duplicates(spark, make(spark, [(i, t, "s") for i, t in rows]), "").select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_kept(rows), key=str)


def test_small_tables_of_keys_are_broadcast_once(spark):
    rows = materialize(spark.createDataFrame([(i % 50, 7 * i) for i in range(300)], "a long, v long"), "rows")
    for n in (0, 3, 40):
        table = materialize(spark.createDataFrame([(i, (i, float(i)), 1 + i % 4) for i in range(n)], "a long, head struct<x: long, y: double>, n long"), "table")
        want = sorted(map(str, rows.join(table, ["a"]).collect()))
        for most in (5, 1024):
            got = join_counted(rows, table, ["a"], most)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(str, got.collect())) == want and got.columns == ["a", "v", "head", "n"]
        # One broadcast of a local table, and no other join or sort; it took three broadcasts and two sorts before.
        assert plan.count("BroadcastExchange") == min(n, 1) and "SortMergeJoin" not in plan and "TakeOrdered" not in plan


def test_components_take_no_round_to_confirm(spark, monkeypatch):
    written = []
    monkeypatch.setattr(minhash, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    # Stars of the smallest id: the links are the answer, and only they are stored.
    links = spark.createDataFrame([(1, 2), (3, 1), (4, 1), (7, 6), (6, 6)], "a long, b long")
    assert sorted(map(tuple, minhash.components(links).collect())) == [(2, 1), (3, 1), (4, 1), (7, 6)]
    assert len(written) == 1
