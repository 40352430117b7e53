"""Substring and near-duplicate removal against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from riskmon.llm import anchors, minhash, substrings, suffixes
from riskmon.llm.words import hash_words
from tests.llm.conftest import edge_rows, make, prose

LAST = 2**63


def brute_bytes(rows, length):
    """(doc_id, bytes, removed, kept hash) of every row by looking at every string."""
    first: dict[bytes, tuple] = {}
    texts = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, (i, k)), (i, k))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < (i, k):
                gone[k : k + length] = True
        out.append((None if i == LAST else i, len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows, length):
    first: dict[tuple, int] = {}
    texts = [(LAST if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in texts:
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((None if i == LAST else i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("few", [16_000, 1])
def test_bytes_against_brute_force(spark, edges, monkeypatch, few):
    monkeypatch.setattr(suffixes, "MOST_CONTEXTS", few)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 400)
    got = suffixes.remove_repeated_bytes(edges).collect()
    assert sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got], key=str) == brute_bytes([r[:2] for r in edge_rows()], 100)


def test_spans_are_maximal_runs(spark):
    shared = prose(5, 40)
    rows = [(1, shared), (2, "A" * 150 + shared + "B" * 150 + shared)]
    got = {r["doc_id"]: r for r in suffixes.remove_repeated_bytes(make(spark, [(i, t, "s") for i, t in rows])).collect()}
    # The runs of A and of B repeat themselves after their first 100 bytes.
    assert got[1]["n_spans"] == 0 and got[2]["n_spans"] >= 2
    assert sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got.values()], key=str) == brute_bytes(rows, 100)


def test_merge_finds_all_repeats():
    rnd = random.Random(3)
    contexts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 60))) for _ in range(80)]
    for length in (7, 8):
        own, at, block = suffixes.repeated_windows(contexts, length, 300)
        found: dict[int, set] = {}
        for c, o, b in zip(own.tolist(), at.tolist(), block.tolist()):
            found.setdefault(b, set()).add((c, o))
        want: dict[bytes, set] = {}
        for i, c in enumerate(contexts):
            for k in range(len(c) - length + 1):
                want.setdefault(c[k : k + length], set()).add((i, k))
        assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_suffix_order():
    contexts = [b"banana", b"ana", b"banana", b"nab"]
    text = np.frombuffer(b"".join(bytes(x + 1 for x in c) + b"\0" for c in contexts), np.uint8)
    whole = [bytes(text[i:]) for i in range(len(text))]
    cut = [(s[: s.index(0)], i) for i, s in enumerate(whole)]
    assert suffixes.suffix_order(text).tolist() == [i for _, i in sorted(cut)]


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_words_against_brute_force(spark, edges, batches):
    got = substrings.remove_repeats(edges, batches=batches).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got], key=str) == brute_words([r[:2] for r in edge_rows()], 50)


def test_index_compacts(spark):
    index = substrings.FingerprintIndex(length=10, gram=4, fan_in=2)
    rows, _ = substrings.keyed(make(spark, [(i, prose(i % 2, 40), "s") for i in range(5)]))
    removed, runs = [], []
    for i in range(5):
        removed.append(index.add(rows.where(f"doc = {i}"), rows.where(f"doc <= {i}")).count())
        runs.append(len(index.runs))
    assert runs == [1, 2, 3, 2, 3] and removed[:2] == [0, 0] and all(removed[2:])
    index.compact()
    assert len(index.runs) == 1 and index.runs[0].groupBy("anchor", "context").count().where("count > 1").isEmpty()


def test_index_is_kept_for_a_later_job(spark, tmp_path):
    rows, _ = substrings.keyed(make(spark, [(i, prose(51 + i % 2, 40), "s") for i in range(4)]))
    sizes = {"length": 10, "gram": 4}
    first = substrings.FingerprintIndex(folder=f"file://{tmp_path}", **sizes)
    first.add(rows.where("doc < 2"), rows.where("doc < 2"))
    later = substrings.FingerprintIndex.open(spark, f"file://{tmp_path}", **sizes)
    assert len(later.runs) == 1
    marked = later.add(rows.where("doc >= 2"), rows).collect()
    assert {(r["doc"], p) for r in marked for p in range(r["lo"], r["hi"] + 1)} == {(d, p) for d in (2, 3) for p in range(31)}
    assert len(substrings.FingerprintIndex.open(spark, f"file://{tmp_path}", **sizes).runs) == 2


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_long_words_of_one_polynomial_hash_differ(spark):
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join([prose(1, 29), word, prose(2, 30)])), (2, " ".join([prose(1, 29), other, prose(2, 30)])), (3, word), (4, other)]
    docs = make(spark, [(i, t, "s") for i, t in rows])
    got = substrings.remove_repeats(docs).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got], key=str) == brute_words(rows, 50)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == {i: i for i in range(1, 5)}


def test_word_hashes_are_of_whole_words():
    rnd = random.Random(1)
    words = list({"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 150))) for _ in range(30_000)})
    got, bounds = hash_words([" ".join(words).encode(), b"", ("\t".join(words[:9]) + "\n").encode()])
    assert len(set(got[: len(words)].tolist())) == len(words) and bounds.tolist() == [0, len(words), len(words), len(words) + 9]
    assert got[len(words) :].tolist() == got[:9].tolist()


def test_texts_above_a_megabyte(spark):
    passage = prose(61, 200)
    long = " ".join(prose(600 + k, 5000) for k in range(45))
    rows = [(1, long + " " + passage), (2, passage + " end"), (3, long), (2**63 - 1, passage), (None, passage + " x")]
    assert len(long) > 1 << 20
    docs = make(spark, [(i, t, "s") for i, t in rows])
    order = [(2**63 - 1 if i is None else i, t) for i, t in rows]
    words = sorted(((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(docs).collect()))
    assert words == sorted(x[1:] for x in brute_words(order, 50))
    got = suffixes.remove_repeated_bytes(docs).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(x[1:] for x in brute_bytes(order, 100))
    assert {r["doc_id"] for r in got} == {i for i, _ in rows}
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs.where("doc_id is not null")).collect()}[3] == 1


def test_runs_cover_each_window_once(monkeypatch):
    monkeypatch.setattr(anchors, "PIECE", 64)
    words, bounds = hash_words([prose(1, 200).encode(), b"", prose(2, 9).encode(), prose(3, 30).encode()])
    seen = [(o, p) for own, _, _, lo, hi in anchors.runs(words, bounds, 10, 4) for o, a, b in zip(own, lo, hi) for p in range(a, b + 1)]
    assert sorted(seen) == [(0, p) for p in range(191)] + [(3, p) for p in range(21)]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_on_edges(spark, edges):
    got = minhash.near_duplicates(edges).collect()
    assert len(got) == len(edge_rows())
    component, size = brute_components([(i, t) for i, t, _ in edge_rows() if i is not None])
    for r in got:
        if r["doc_id"] is not None:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (component[r["doc_id"]], size[r["doc_id"]], component[r["doc_id"]] == r["doc_id"])


@pytest.mark.parametrize("small", [32, 2])
def test_near_duplicates_of_many_variants(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rnd = random.Random(8)
    base = prose(21, 200).split()
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rnd.randint(0, 9)):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words[: 200 - rnd.randint(0, 40)])))
    component, _ = brute_components(rows)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(make(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == component


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200)], "a long, b long")
    got = {r["id"]: r["component"] for r in minhash.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[200] == 100


def test_empty_tables(nothing):
    assert suffixes.remove_repeated_bytes(nothing).count() == 0
    assert substrings.remove_repeats(nothing).count() == 0
    assert minhash.near_duplicates(nothing).count() == 0
