"""Documents with nulls, empty and long texts, repeats and clashing columns."""

from __future__ import annotations

import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size int, key double, row string, spans string, label int, "
    "hash long, band int, n int, component string, anchor int, doc int, th int, w string, copies int, range int"
)


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(1, 9))) for _ in range(n))


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, 0.5, "r", "s", 1, 3, 2, 1, "c", 4, 5, 6, "w", 9, 8) for i, t, s in rows], SCHEMA)


def edge_rows():
    base = prose(1, 300)
    changed = base.replace(base.split()[150], "changed", 1)
    part = " ".join(base.split()[40:140])
    long = " ".join(prose(k, 400) for k in range(60))
    return [
        (1, base, "a"), (2, base, "a"), (3, changed, None), (3, changed, None), (4, None, "b"), (5, "", "b"), (6, " \n\t ", None), (7, "one two", "a"),
        (8, "one two", "c"), (9, prose(9, 80) + " " + part + " " + prose(10, 80), "a"), (10, long, "b"), (11, "x" * 5000, "c"),
        (12, part + " " + part, "c"), (13, "ÀÉ ü 漢字 😀 a b ünï", "a"), (None, "no id here " + prose(3, 60), "a"), (14, "line one\nline one\n\nline two " + prose(4, 30), "b"),
    ]


@pytest.fixture(scope="session")
def edges(spark):
    return make(spark, edge_rows()).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return make(spark, [])
