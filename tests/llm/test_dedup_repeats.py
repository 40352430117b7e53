"""Repeats within documents and within ids, against brute force."""

from __future__ import annotations

import pytest

from riskmon.llm import minhash, substrings, suffixes
from tests.llm.conftest import make, prose
from tests.llm.test_dedup import brute_bytes, brute_words, shingles


def words_match(spark, rows, batches):
    got = substrings.remove_repeats(make(spark, [(i, t, "s") for i, t in rows]), batches=batches).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got], key=str) == brute_words(rows, 50)
    return sorted((r["n_removed"] for r in got), reverse=True)


@pytest.mark.parametrize("batches", [1, 5])
def test_contexts_that_recur_in_their_first_document(spark, batches):
    line, passage = prose(31, 10) + "\n", prose(32, 60)
    x, y = prose(33, 70), prose(34, 70)
    twice = f"{x} {passage} {x} " * 2
    rows = [(1, line * 6), (2, line * 100), (3, f"{y} {passage} {y}"), (4, twice), (4, "other " + twice)] + [(i, prose(i, 90)) for i in range(5, 12)]
    assert words_match(spark, rows, batches)[:3] == [1000, 120, 120]


def crowd(n):
    """Texts of many lengths without an id, some with a passage of the first document in different places."""
    passage = prose(41, 60)
    rows = [(1, prose(42, 5) + " " + passage)]
    for k in range(n):
        rows.append((None, f"{prose(k + 1000, 1 + k % 40)} {passage if k % 3 == 0 else ''} {prose(k + 9000, 1 + k % 25)}"))
    # Two texts that share all but the end, under one id; the middle is also in a smaller document with other text around.
    start = prose(43, 8)
    return rows + [(50, f"{start} {passage} {prose(44, 70)}"), (50, f"{start} {passage} {prose(44, 70)} end")]


def test_words_of_many_rows_without_an_id(spark):
    words_match(spark, crowd(3000), 3)


def test_bytes_of_many_rows_without_an_id(spark):
    rows = crowd(3000)
    got = suffixes.remove_repeated_bytes(make(spark, [(i, t, "s") for i, t in rows])).collect()
    assert sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got], key=str) == brute_bytes(rows, 100)


def brute_components(rows):
    """(doc_id, n_shingles, class_id, component_id, kept) of every row, each row a document of its own."""
    sets = [shingles(t) for _, t in rows]
    linked = [[bool(a) and 100 * len(a & b) >= 85 * len(a | b) for b in sets] for a in sets]
    out = []
    for i, (ident, _) in enumerate(rows):
        reached, todo = {i}, [i]
        while todo:
            new = {j for j, yes in enumerate(linked[todo.pop()]) if yes} - reached
            reached |= new
            todo += new
        ids = [[rows[j][0] for j in group if rows[j][0] is not None] for group in ([j for j in range(len(rows)) if j == i or sets[j] and sets[j] == sets[i]], reached)]
        least = [min(x, default=None) for x in ids]
        out.append((ident, len(sets[i]), *least, ident == least[1]))
    return sorted(out, key=str)


def test_links_of_rows_that_share_an_id_or_have_none(spark):
    def near(text):
        return text + " one more"

    a, b, c, d = (prose(s, 60) for s in (71, 72, 73, 74))
    rows = [(1, a), (1, b), (2, near(b)), (3, near(a)), (5, c), (None, near(c)), (None, d), (None, near(d)), (7, near(near(c))), (8, None), (8, ""), (None, " "), (9, c), (9, c)]
    for order in (rows, rows[::-1], rows[1::2] + rows[::2]):
        got = minhash.near_duplicates(make(spark, [(i, t, "s") for i, t in order]).repartition(3)).select("doc_id", "n_shingles", "class_id", "component_id", "kept").collect()
        assert sorted(map(tuple, got), key=str) == brute_components(order)
