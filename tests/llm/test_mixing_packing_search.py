"""Mixing, packing, exact search and the pipeline."""

from __future__ import annotations

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskmon.llm import mixing, packing, search
from tests.llm.conftest import edge_rows, make, prose


def brute_targets(sizes):
    """Caps of twice the size, the excess reshared by weight until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_taken(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, prose(i, rnd.randint(1, 40)), rnd.choice(["a", "b", "B", "ü", None, "c"] + ["hot"] * 6)) for i in range(400)]
    got = mixing.mix_sources(make(spark, rows)).collect()
    again = mixing.mix_sources(make(spark, rows[::-1])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert target == pytest.approx(brute_targets(dict(sizes)), abs=0.01)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()), abs=0.1)
    assert all(abs(taken[s] - target[s]) <= 40 for s in sizes)


def test_whole_epochs_come_first(spark):
    rows = [(i, prose(i, 10), "small" if i < 5 else "z") for i in range(100)]
    per = defaultdict(list)
    for r in mixing.mix_sources(make(spark, rows)).collect():
        per[r["source"]].append(r["copies"])
    assert set(per["small"]) == {2} and max(per["z"]) - min(per["z"]) <= 1


def test_mix_edges(edges, nothing):
    got = mixing.mix_sources(edges, keep_rows=True).collect()
    assert len(got) == len(edge_rows()) and all(r["taken"] == 0 for r in got if not (r["row"]["text"] or "").strip())
    assert mixing.mix_sources(nothing).count() == 0


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: made.encode(text, add_special_tokens=False).ids


SPECIAL_TEXTS = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>  y", "<|endoftext", "<|endoftext|>\n é 漢字 😀", "|endoftext|>"]


def test_encoder_matches_the_public_tokenizer(tokenizer):
    own = packing.encoder(None)
    marks = [chr(c) for c in range(0, 0x30000, 13) if not 0xD800 <= c < 0xE000]
    odd = [" ".join(f"a{c}b 1{c}2 {c}{c}!" for c in marks[k : k + 50]) for k in range(0, len(marks), 50)]
    for text in [prose(1, 50), "don't  stop\n\n x", "", "  a \t b  ", "x" * 20_000, *SPECIAL_TEXTS, *odd, *(t or "" for _, t, _ in edge_rows())]:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == tokenizer(text)


def test_encoder_matches_on_every_document(tokenizer):
    pq = pytest.importorskip("pyarrow.parquet")
    own = packing.encoder(None)
    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist():
        assert np.frombuffer(own.ids(text or ""), "<u4").tolist() == tokenizer(text or "")


def test_packing_round_trip(spark, edges, tokenizer):
    special = [(1000 + i, t, "s") for i, t in enumerate([*SPECIAL_TEXTS, " ".join(f"{t} {prose(i, 700)}" for i, t in enumerate(SPECIAL_TEXTS))])]
    docs = edges.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(make(spark, special))
    got = packing.pack_documents(docs, group=7).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    texts = {i: t for i, t, _ in [*edge_rows(), *special] if i is not None}
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = np.asarray([*tokenizer(texts[i] or ""), 2], "<u4").tobytes()
        at = 0
        for p, r in enumerate(sorted(pieces, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (p, at) and r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            assert r["length"] == 1024 or p == 0
            at += r["length"]
        assert 4 * at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024


def test_best_fit_equals_linear_search():
    rnd = random.Random(2)
    lengths = sorted((rnd.randint(1, 100) for _ in range(500)), reverse=True)
    sequence, offset = packing.best_fit(lengths, 100)
    room: list[int] = []
    for n, s, o in zip(lengths, sequence, offset):
        fits = [r for r in room if r >= n]
        if not fits:
            assert s == len(room) and o == 0
            room.append(100 - n)
        else:
            assert room[s] == min(fits) and o == 100 - room[s]
            room[s] -= n


def test_packing_of_nothing(nothing, edges):
    assert packing.pack_documents(nothing).count() == 0
    assert packing.pack_documents(edges).select("doc_id").distinct().count() == len({i for i, _, _ in edge_rows()})


@pytest.mark.parametrize("shard", [40, 8192])
def test_search_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(search, "LEAF", 8)
    rnd = np.random.default_rng(5)
    data = np.concatenate([rnd.normal(size=(200, 6)), np.repeat(rnd.normal(size=(1, 6)), 30, 0)])
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (504, []), (505, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string")
    got = defaultdict(list)
    for r in search.search(df, F.col("vec_id") % 5 == 0, shard_rows=shard).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = np.floor(data * 256).astype(np.int64)
    assert set(got) == {i for i in range(230) if i % 5 == 0}
    for q, found in got.items():
        scores = whole @ whole[q]
        want = sorted((i for i in range(230) if i != q), key=lambda i: (-scores[i], i))[:5]
        assert found == [(k + 1, i, scores[i]) for k, i in enumerate(want)]


def brute_search(rows, every, k=5):
    """(query_id, rank, vec_id, score) of all queries by looking at every row but the query's own."""
    most = 2**63 - 1
    whole = [(i, [max(-most - 1, min(most, math.floor(256 * x))) for x in v]) for i, v in rows]
    out = []
    for q, (i, v) in enumerate(whole):
        if i % every == 0:
            scored = [(-max(-most - 1, min(most, sum(a * b for a, b in zip(v, w)))), j, c) for c, (j, w) in enumerate(whole) if c != q and len(v) == len(w)]
            out += [(i, rank + 1, j, -score) for rank, (score, j, _) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_search_of_few_or_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in search.search(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 131072), (0, 2, 2, 131072)]
    assert search.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_search_keeps_rows_of_one_id_and_large_numbers(spark):
    rnd = random.Random(7)
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (5, [1e20, -1.0]), (6, [-1e20, 3.0]), (7, [3e9, 2e9]), (10, [1e17, 1e17]), (10, [0.1, 0.2])]
    rows += [(20 + i, [rnd.uniform(-2e11, 2e11), rnd.uniform(-1, 1)]) for i in range(40)] + [(70 + i, [float(i), 1.0, 2.0]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search.search(df, F.col("vec_id") % 5 == 0, shard_rows=8).collect()
    assert sorted(map(tuple, got)) == brute_search(rows, 5)


def test_search_of_clusters_skips_shards(spark):
    rnd = np.random.default_rng(9)
    centres = rnd.normal(size=(16, 4)) * 20
    rows = [(i, (centres[i % 16] + rnd.normal(size=4)).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, search.search(df, F.col("vec_id") % 50 == 0, shard_rows=50).collect())) == brute_search(rows, 50)


def test_splits_deal_a_sample_evenly():
    points = np.random.default_rng(3).normal(size=(1000, 5))
    assert len(search.splits(points, 16)) == 15 and len(search.splits(points, 1)) == 0 and search.splits(points[:0], 8) == []


def test_pipeline_stages(spark, tmp_path):
    rows = [(i, prose(i, 80), "ab"[i % 2]) for i in range(60)]
    rows += [(100 + i, " ".join(w + "$$$" for w in prose(i, 80).split()), "a") for i in range(60)]
    rows += [(200, rows[7][1], "b"), (201, rows[8][1] + " a.b@c.org", "b")]
    make(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, _, _ in rows[:120]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {name: {r["doc_id"] for r in found} for name, found in kept.items()}
    assert ids["quality classifier"] == {*range(60), 200, 201}
    assert 200 not in ids["near-duplicates"] and ids["near-duplicates"] >= set(range(60)) - {8} and len(kept["near-duplicates"]) == len(ids["near-duplicates"])
    assert all("@" not in r["text"] and r["n_chars"] == len(r["text"]) for r in kept["personal data"])
    assert ids["personal data"] == ids["near-duplicates"] >= ids["mixing"] == ids["packing"]


def test_pipeline_stages_on_edges(spark, edges, nothing, tmp_path):
    """Every stage on nulls, empty and long texts, repeated rows and ids, clashing columns, and on an empty table."""
    spark.createDataFrame([(i, int(i != 14), 0) for i in range(1, 15)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    texts = [t for _, t, _ in edge_rows()]
    for name, stage in corpus_pipeline.STAGES:
        got, empty = stage(spark, edges, str(tmp_path)), stage(spark, nothing, str(tmp_path))
        rows = got.collect()
        assert empty.count() == 0 and rows, name
        if name == "packing":
            assert {r["doc_id"] for r in rows} == {i for i, _, _ in edge_rows()}
            continue
        assert got.columns == edges.columns and empty.columns == edges.columns
        if name != "personal data":
            assert all(r["text"] in texts for r in rows)
        if name == "personal data":
            assert len(rows) == len(texts) and sum(r["text"] is None for r in rows) == texts.count(None)
        if name == "near-duplicates":
            # 1, 2, 3 and 3 again are copies of one another, 7 and 8 too; texts without words stay.
            assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14] and len(rows) == 12


def test_near_duplicate_stage_keeps_other_texts_of_an_id(spark):
    rows = [(1, prose(71, 40)), (1, prose(72, 40)), (1, prose(72, 40)), (2, prose(71, 40)), (3, prose(73, 40)), (None, prose(73, 40)), (None, prose(74, 40))]
    got = corpus_pipeline.drop_near_duplicates(spark, make(spark, [(i, t, "s") for i, t in rows]), "").select("doc_id", "text").collect()
    assert sorted(t for _, t in got) == sorted(prose(k, 40) for k in (71, 72, 73, 74)) and (3, prose(73, 40)) in map(tuple, got)


def test_redaction_leaves_no_part_of_a_secret(spark):
    secret = "f3ef4d6b2755a36d" * 50
    docs = make(spark, [(i, f'key: token = "{secret}" and more', "s") for i in range(5)])
    got = corpus_pipeline.redact_personal_data(spark, docs, "").collect()
    assert all("f3ef" not in r["text"] and r["n_chars"] == len(r["text"]) for r in got)
