"""License scans against brute force, planted notices and edge cases."""

from __future__ import annotations

import random
import re

import pytest

from riskmon.llm import licenses
from tests.llm.conftest import edge_rows, make, prose


def brute_base(text):
    """(n_words, n_base, first, last, labels) by comparing word lists at every place."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    places = [k for k, _ in hits]
    return len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


def texts():
    pieces = ["mit license", "MIT License,", "apache-license", "CC BY", "cc by-sa 4.0", "gnu general public license", "Licensed under the GNU General Public License, version 2", "by the", "éa", "license", "cc", "gnu", "x"]
    rnd = random.Random(4)
    out = [" ".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12))) for _ in range(120)]
    return [*out, "mit\x00license", "MIT licensé", "mit license" * 3, "cc by cc by", "ＭＩＴ license", "mit_license mit`license", None, ""]


def columns(got):
    return [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got]


def test_base_against_brute_force(spark, tmp_path, edges):
    rows = [(i, t, "s") for i, t in enumerate(texts())]
    make(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = licenses.op13_license_scan(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert columns(got) == [brute_base(t) for _, t, _ in rows]
    for r in got:
        labels = set(r["labels"].split(",")) - {""}
        assert set(r["base_labels"].split(",")) - {""} <= labels and (r["score"] > 0) == bool(labels) and 0 <= r["score"] <= 1


def test_edges_and_empty_table(spark, tmp_path, edges, nothing):
    for name, table in (("some", edges), ("none", nothing)):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = licenses.op13_license_scan(spark, f"{tmp_path}/some").select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(r[0], *brute_base(r[1])) for r in edge_rows()], key=str)
    assert licenses.op13_license_scan(spark, f"{tmp_path}/none").count() == 0


def test_gates_open_every_rule_that_matches():
    """The keyword prefilter loses no match: a keyword is part of every match of its rule."""
    rnd = random.Random(9)
    _, compiled = licenses.matcher()
    names = [f[2] for f in licenses.FAMILIES]
    plain = [re.sub(r"\(\?:([^()|]*)\|?[^()]*\)\??", r"\1", re.sub(r"\[cs\]", "s", n)).split("|")[0] for n in names]
    for _ in range(300):
        words = " ".join(rnd.choice([*plain, "licensed under the", "version 2 0", "v3", "2 1", "spdx license identifier mit", "all rights reserved", "or later"]) for _ in range(6))
        normal = f" {' '.join(words.split())} "
        every = sorted((i, *m.span()) for i, rule in enumerate(compiled) for m in rule.finditer(normal))
        assert sorted(licenses.detections(normal)) == every


def test_suppression_against_brute_force():
    rnd = random.Random(5)
    level = [rnd.randint(1, 3) for _ in range(20)]
    for _ in range(300):
        found = []
        for _ in range(rnd.randint(1, 14)):
            a = rnd.randint(0, 12)
            found.append((rnd.randrange(20), a, a + rnd.randint(1, 8)))
        kept = []
        # In order of priority, then of length, then of the list: a detection inside a kept one goes.
        for s in sorted(set(found), key=lambda s: (-level[s[0]], s[1] - s[2], s[1], s[0])):
            if not any(k[1] <= s[1] and s[2] <= k[2] for k in kept):
                kept.append(s)
        assert sorted(licenses.unsuppressed(found, lambda i: level[i])) == sorted(kept)


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0"), ("see the GNU Lesser General Public License v2.1", "lgpl-2.1"),
        ("GNU Affero General Public License", "agpl"), ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "cc-by-nc-sa-4.0"), ("gplv3 code", "gpl-3.0"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"), ("2-clause BSD licence", "bsd-2-clause"), ("submit the permit to the bsd", ""),
        ("It is released under the Mozilla Public License 2.0; all rights reserved.", "mpl-2.0,proprietary"),
    ],
)
def test_signatures(text, labels):
    _, _, found = licenses.scan(text)
    assert ",".join(sorted({f["label"] for f in found})) == labels


def test_hundreds_of_rules_and_long_texts():
    assert len(licenses.rules()) > 300
    long = " ".join(prose(k, 5000) for k in range(45)) + " Mit\nLicense " + prose(3, 50)
    assert len(long) > 1 << 20
    n, base, found = licenses.scan(long)
    assert n == len(long.split()) and [b["first"] for b in base] == [n - 52] and "mit" in {f["label"] for f in found if f["last"] == n - 51}
    many = licenses.scan("mit license " * 20_000)
    assert len(many[1]) == len(many[2]) == 20_000
