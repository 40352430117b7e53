"""Rules, classifiers and personal data against brute force, held-out rows and edge cases."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from riskmon.llm import pii, quality, rules, toxicity
from tests.llm.conftest import edge_rows, make, prose


def brute_repeats(words):
    windows: dict[tuple, list[int]] = {}
    for k in range(len(words) - 4):
        windows.setdefault(tuple(words[k : k + 5]), []).append(k)
    return len({p + j for at in windows.values() if len(at) > 1 for p in at for j in range(5)})


def test_rules_against_brute_force(spark, edges):
    got = rules.ledger(edges).collect()
    assert len(got) == len(edge_rows())
    by_id = {r["doc_id"]: r for r in got}
    for i, text, _ in edge_rows():
        words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
        r = by_id[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), brute_repeats(words))
        lines = [x for x in (text or "").split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
        assert r["n_dup_lines"] == len(lines) - len(set(lines))


def test_policies_and_ablation(spark):
    texts = ["word " * 3, " ".join(f"w{i}" for i in range(40)), "### a $$$ b *** c " + " ".join(f"w{i}" for i in range(9)), "same line here\n" * 9]
    entries = rules.ledger(make(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    kept = {v: sorted(r["doc_id"] for r in rules.apply_policy(entries, v).where("kept").collect()) for v in rules.POLICIES}
    assert kept["v3"] == [1] and 2 in kept["v1"]
    table = {r["rule"]: r for r in rules.ablate(entries, "v3").collect()}
    assert table["few_words"]["failed"] == 1 and table["symbols"]["failed_alone"] == 1 and table["symbols"]["kept_without"] == 2


def test_ablation_against_brute_force(spark, edges):
    """Every rejected row of the query carries what its first failed rule costs, over all rows."""
    entries = rules.materialize(rules.ledger(edges), "ledger")
    got = rules.explained(entries, "v3").collect()
    bits = [r["bits"] for r in got]
    names = [n for n, _ in rules.RULES]
    assert len(got) == len(edge_rows()) and len(set(bits)) > 2
    for r in got:
        failed = [i for i in range(len(names)) if r["bits"] >> i & 1]
        assert r["kept"] == (not failed) and r["policy"] == "v3" and r["first_failed"] == (names[failed[0]] if failed else None)
        if failed:
            one = 1 << failed[0]
            assert (r["failed"], r["failed_alone"], r["kept_without"]) == (sum(b & one > 0 for b in bits), sum(b == one for b in bits), sum(b & ~one == 0 for b in bits))
    assert rules.explained(rules.ledger(edges.limit(0)), "v1").count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
            fine = {"email": True, "ip": kind != "ip" or max(map(int, m[0].split("."))) <= 255, "card": 13 <= len(d) <= 19 and total % 10 == 0, "phone": 9 <= len(d) <= 15}
            if fine[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_against_python(spark):
    rnd = random.Random(4)
    parts = ["a", "b@", "@", ".", "1", "23", "255", "256", "-", " ", "+1", "(", ")", "4111111111111111", "é", "😀", "\n", "_x", "a@b.c", "0"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 50))), "s") for i in range(400)]
    rows += [(1000, None, "s"), (1001, "1" * 3000 + "a" * 3000 + "@" + "1-" * 2000, "s"), (1002, " ".join(f"a{i}@b.com" for i in range(300)), "s")]
    got = pii.detect(make(spark, rows)).select("doc_id", pii.listed(F.filter("spans", lambda x: x["base"])).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in got} == {i: brute_spans(t) for i, t, _ in rows}


def test_method_adds_and_redacts(spark):
    text = 'mail a.b@c.org or call +1 (319) 555-5132. token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e06" end'
    rows = [(i, text, "s") for i in range(30)] + [(99, "nothing to see", "s")]
    got = pii.detect(make(spark, rows), keep_rows=True)
    r = got.where("doc_id = 5").select(pii.listed(F.col("spans")).alias("s"), pii.redacted(F.col("row.text"), F.col("spans")).alias("t")).first()
    assert "secret:" in r["s"] and r["t"] == 'mail <email> or call <phone>. <secret>" end'
    assert got.where("doc_id = 99").select(pii.redacted(F.col("row.text"), F.col("spans"))).first()[0] == "nothing to see"


def brute_candidates(text):
    """Loose spans that overlap no base span, by Python's own matcher."""
    base = [tuple(map(int, x.split(":")[1:])) for x in brute_spans(text).split(",") if x]
    out = []
    for kind, pattern in pii.LOOSE.items():
        for m in re.finditer(pattern, text or ""):
            if all(e <= m.start() or m.end() <= s for s, e in base):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return sorted(out)


def test_loose_candidates_against_python(spark):
    rnd = random.Random(14)
    parts = ["a", "b(at)c", " [at] ", "x.y", "(dot)", ".", "org", " ", "319-555-5132", "(319) 555-5132", "555", "-", "token", "=", "secret: ", "abcdef123456", "Zz9/+", "+1", "4111111111111111", "a@b.c", "é", "😀", "\n", "api_key=\""]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))), "s") for i in range(500)]
    rows += [(1000, "." * 20_000 + " a(at)b.org " + "-" * 20_000, "s"), (1001, "token=" + "k3" * 400 + " end", "s"), (1002, "x" * 300 + "[at]" + "y" * 200 + ".com", "s")]
    loose = F.filter("spans", lambda x: ~x["base"])
    got = pii.candidates(make(spark, rows), False).select("doc_id", F.transform(loose, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])).alias("s")).collect()
    assert {r["doc_id"]: sorted(r["s"]) for r in got} == {i: brute_candidates(t) for i, t, _ in rows}
    assert sum(len(r["s"]) for r in got) > 200


def test_long_secrets_go_whole(spark):
    rows = [(i, f'set token = "{"f3ef4d6b2755" * (1 + i)}" here', "s") for i in range(70)]
    got = pii.detect(make(spark, rows), keep_rows=True).select(pii.redacted(F.col("row.text"), F.col("spans")).alias("t")).collect()
    assert {r["t"] for r in got} == {'set <secret>" here'}


def test_many_candidates_in_one_text(spark):
    text = " ".join(f"u{i}@b.com or {i % 10}19-555-{1000 + i % 9000} x" for i in range(6000))
    spans = pii.detect(make(spark, [(1, text, "s")])).select(F.size(F.filter("spans", lambda x: x["base"]))).first()[0]
    assert spans == 6000


def test_classifier_depends_on_the_labelers(spark):
    rows = [(i, f"call my phone {200 + i % 79}-555-{1000 + i} or mail a{i}@b.com", "s") for i in range(300)]
    rows += [(1000 + i, f"build no. 000-{100 + i % 90}-{1000 + i} {prose(i, 30)}", "s") for i in range(300)]
    docs = make(spark, rows)
    stored = pii.candidates(docs, False)
    got = {r["doc_id"]: r["n"] for r in pii.detect(docs).select("doc_id", F.size(F.filter("spans", lambda x: x["kind"] == "phone")).alias("n")).collect()}
    assert all(got[i] == 1 for i in range(300)) and not any(got[1000 + i] for i in range(300))
    # Without the posterior labels nothing separates the two.
    rows = stored.select(F.explode("spans").alias("x")).select("x.*").collect()
    counts = [(r["kind"], tuple(r[c] for c in pii.LABELERS), tuple(r[c] for c in pii.BINS), 1.0) for r in rows]
    blind = pii.fit_classifier(counts, [0.9] * len(counts))
    assert stored.select(F.explode("spans").alias("x")).where(pii.classifier(blind, F.col("x")) <= 0).isEmpty()


def test_em_finds_the_reliable_labelers():
    rnd = random.Random(2)
    counts = {}
    for _ in range(5000):
        true = rnd.random() < 0.4
        p = tuple((1 if (rnd.random() < r) == true else -1) for r in (0.95, 0.9, 0.85, 0.5, 0.5))
        counts[p] = counts.get(p, 0) + 1
    rates, posterior = pii.em(sorted(counts.items()))
    right = [t[1][1] for t in rates]
    assert min(right[:3]) > 0.8 and max(right[3:]) < 0.6


def test_running_folds_across_blocks(spark):
    values = list(range(1, 400))
    df = spark.createDataFrame([(values,)], "v array<long>")
    assert df.select(pii.running(F.col("v"), 0, lambda a, b: a + b)).first()[0] == [sum(values[:k]) for k in range(len(values))]


def labelled(spark, junk, n=400):
    rnd = random.Random(6)
    texts = [(i, (junk(i, rnd) if i % 4 == 0 else prose(i, 60)), "s") for i in range(n)]
    return make(spark, texts), spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(n)], "doc_id long, label int")


def test_quality_held_out_accuracy(spark):
    docs, labels = labelled(spark, lambda i, r: " ".join(w + "***" for w in prose(i, 60).split()))
    train = labels.where(quality.fold(4) != 2)
    got = quality.score_quality(docs, train).join(labels, "doc_id").where(quality.fold(4) == 2).collect()
    assert got and np.mean([(r["score"] >= 0.7) == r["label"] for r in got]) >= 0.97


def brute_statistics(text):
    """The classifier's features of one text, in plain Python."""
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(" ")]
    n, chars, m = max(len(words), 1), max(sum(map(len, words)), 1), max(len(lines), 1)
    count = lambda p: len(re.findall(p, text))
    return [
        np.log1p(len(words)), sum(map(len, words)) / n, count("[#*$%&<>]") / n, count("!") / n, count(r"\|") / n, count("[A-ZÀ-ÖØ-Þ]") / chars,
        count("[0-9]") / chars, len(set(words)) / n, brute_repeats(words) / n, np.log1p(len(words) / m), 1 - len(set(lines)) / m,
    ]


def test_quality_score_against_brute_force(spark, edges):
    """The compiled column gives what its rules, evaluated one by one in Python, add up to."""
    docs, labels = labelled(spark, lambda i, r: " ".join(w + "***" for w in prose(i, 60).split()))
    model = quality.fit(docs, labels)
    assert len(model.weighted) > 1
    for r in quality.statistics(edges).withColumn("score", model.score()).join(edges.select("doc_id", "text"), "doc_id").collect():
        x = brute_statistics(r["text"])
        assert np.allclose([r[f] for f in quality.FEATURES], x)
        total = model.intercept + sum(w for rule, w in model.weighted if all(x[f] <= b if sign == "<=" else x[f] > b for f, sign, b in rule))
        assert abs(r["score"] - 1 / (1 + np.exp(-total))) < 1e-9


def test_fit_takes_each_labelled_id_once(spark):
    docs = make(spark, [(1, "b b", "s")] * 5 + [(1, "a a", "s"), (2, None, "s"), (3, "c", "s"), (None, "d", "s")])
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, None), (None, 1), (9, 1)], "doc_id long, label int")
    assert sorted(map(tuple, quality.labelled_sample(docs, labels, 100).collect())) == [(1, 1, "a a"), (2, 0, None)]
    assert quality.labelled_sample(docs, labels, 1).count() <= 1


def test_fold_is_crc32(spark):
    got = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", quality.fold(4).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 4 for r in got)


def test_tree_paths():
    text = "  If (feature 0 <= 1.5)\n   If (feature 2 > 0.25)\n    Predict: 0.0\n   Else (feature 2 <= 0.25)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0\n"
    assert quality.paths(text) == {((0, "<=", 1.5),), ((0, "<=", 1.5), (2, ">", 0.25)), ((0, "<=", 1.5), (2, "<=", 0.25)), ((0, ">", 1.5),)}


def test_toxicity_held_out_accuracy(spark):
    def junk(i, r):
        words = prose(i, 60).split()
        words[r.randrange(60)] = "zz" + r.choice(["gorp", "gorpen", "gorping"])
        words[r.randrange(60)] = "blarg!"
        return " ".join(words)

    docs, labels = labelled(spark, junk)
    labels = labels.withColumn("label", 1 - F.col("label"))
    got = toxicity.score_toxicity(docs, labels.where(quality.fold(5) != 0)).join(labels, "doc_id").where(quality.fold(5) == 0).collect()
    assert got and np.mean([(r["score"] >= 0.5) == r["label"] for r in got]) >= 0.97


def test_toxicity_score_against_brute_force(spark, edges):
    """Scores are the logistic sum of the weights of the voters that fire, found here word by word."""
    docs, labels = labelled(spark, lambda i, r: prose(i, 60) + " blarg! zz" + r.choice(["gorp", "gorpen"]))
    labels = labels.withColumn("label", 1 - F.col("label"))
    lexicon, weights = toxicity.fit(docs, labels, 1000)
    assert lexicon
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels, 1000).collect()}
    for i, text in [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]:
        words = [w.strip(toxicity.STRIP) for w in text.lower().split()]
        fires = [any((w == f[1:]) if f[0] == "w" else (w[: int(f[0])] == f[1:] and len(w) > int(f[0])) for w in words if w) for f in lexicon]
        hits = sum(any((w == f[1:]) if f[0] == "w" else (w[: int(f[0])] == f[1:] and len(w) > int(f[0])) for f in lexicon) for w in words if w)
        fires += [sum(fires) >= 2, hits > 0 and 100 * hits >= len(words), hits == 0]
        total = weights[-1] + sum(w for w, x in zip(weights, fires) if x)
        assert abs(got[i] - 1 / (1 + np.exp(-total))) < 1e-9


def test_label_model_discounts_copies_of_a_voter():
    rnd = np.random.default_rng(4)
    y = rnd.random(6000) < 0.3
    weak = rnd.random(6000) < np.where(y, 0.6, 0.3)
    copies = np.column_stack([np.where(rnd.random(6000) < 0.97, weak, ~weak) for _ in range(5)])
    good = np.column_stack([rnd.random(6000) < np.where(y, 0.85, 0.1) for _ in range(3)])
    votes = np.column_stack([copies, good]).astype(np.float32)
    noisy = np.where(rnd.random(6000) < 0.15, ~y, y).astype(float)
    right = {d: np.mean((toxicity.label_model(votes, noisy, dependent=d) > 0.5) == y) for d in (True, False)}
    assert right[True] > 0.95 and right[True] > right[False] + 0.2
    parent = toxicity.dependencies(np.column_stack([votes, noisy]).astype(float), y.astype(float))
    assert sum(p >= 0 for p in parent[:5]) == 4 and all(p < 5 for p in parent[:5])


def test_label_model_trusts_good_voters():
    rnd = np.random.default_rng(1)
    y = rnd.random(2000) < 0.3
    votes = np.column_stack([(rnd.random(2000) < np.where(y, 0.9, 0.02)) for _ in range(3)] + [rnd.random(2000) < 0.5]).astype(np.float32)
    noisy = np.where(rnd.random(2000) < 0.1, ~y, y).astype(float)
    assert np.mean((toxicity.label_model(votes, noisy) > 0.5) == y) > 0.98


def test_edges_and_empty_tables(spark, edges, nothing):
    none = spark.createDataFrame([], "doc_id long, label int")
    some = spark.createDataFrame([(1, 1), (4, 0), (5, None), (None, 1), (10, 1), (7, 0)], "doc_id long, label int")
    for labels in (none, some):
        for scored in (quality.score_quality(edges, labels), toxicity.score_toxicity(edges, labels)):
            got = scored.collect()
            assert len(got) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score_quality(nothing, some).count() == 0 and toxicity.score_toxicity(nothing, some).count() == 0
    assert pii.detect(nothing).count() == 0 and rules.ledger(nothing).count() == 0
    assert pii.detect(edges).count() == len(edge_rows())


def test_toxicity_on_the_given_labels(spark):
    """Held-out recall and false alarms on the given tables, not on invented text."""
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    got = toxicity.op9_toxicity(spark, sf_dir).where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("found"))
    counts = {r["toxic"]: (r["n"], r["found"]) for r in got.collect()}
    assert counts[1][0] > 50 and counts[1][1] >= 0.88 * counts[1][0]
    assert counts[0][0] > 500 and counts[0][1] <= 2
