"""License scans by ordered signature rules.

A text becomes its lower-case words, one space between two. Signature rules are
regular expressions over that form, in five priorities: names, names with a
version, phrases that grant a license, identifiers, and sentences of license
texts. Each rule is gated by a keyword that its matches must hold; one automaton
looks for all keywords, and only the rules whose keyword occurs are run. A
detection that lies inside one of a higher priority, or inside a longer one of its
own, is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmon.llm.common import documents, prepared

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Licenses: label, keyword of every name, name as a regular expression over normalised words, versions.
# A name stands without "the"; "licen[cs]e" covers both spellings.
FAMILIES = (
    ("gpl", "gnu general public", r"gnu general public licen[cs]e", "1.0 2.0 3.0"),
    ("gpl", "gpl", r"(?:gnu )?gpl", "1.0 2.0 3.0"),
    ("lgpl", "lesser general public", r"gnu lesser general public licen[cs]e", "2.1 3.0"),
    ("lgpl", "library general public", r"gnu library general public licen[cs]e", "2.0"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", "2.0 2.1 3.0"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", "1.0 3.0"),
    ("agpl", "agpl", r"(?:gnu )?agpl", "1.0 3.0"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e", "1.1 1.2 1.3"),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl", "1.1 1.2 1.3"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e", "1.0 1.1 2.0"),
    ("mit", "mit licen", r"mit licen[cs]e", ""),
    ("mit", "expat", r"expat licen[cs]e", ""),
    ("mit-0", "no attribution", r"mit no attribution(?: licen[cs]e)?", ""),
    ("x11", "x11", r"(?:mit )?x11 licen[cs]e", ""),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2 clause|two clause) bsd licen[cs]e|bsd (?:2|two) clause(?: licen[cs]e)?", ""),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3 clause|three clause) bsd licen[cs]e|bsd (?:3|three) clause(?: licen[cs]e)?", ""),
    ("bsd-4-clause", "bsd", r"(?:original|old|4 clause|four clause) bsd licen[cs]e|bsd (?:4|four) clause(?: licen[cs]e)?", ""),
    ("0bsd", "bsd", r"(?:0bsd|zero clause bsd|bsd zero clause)(?: licen[cs]e)?", ""),
    ("bsd", "bsd", r"bsd licen[cs]e", ""),
    ("isc", "isc", r"isc licen[cs]e", ""),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", "1.0 1.1 2.0"),
    ("mpl", "mpl", r"mpl", "1.0 1.1 2.0"),
    ("epl", "eclipse", r"eclipse public licen[cs]e", "1.0 2.0"),
    ("edl", "eclipse", r"eclipse distribution licen[cs]e", "1.0"),
    ("cddl", "development and distribution", r"common development and distribution licen[cs]e", "1.0 1.1"),
    ("cddl", "cddl", r"cddl", "1.0 1.1"),
    ("cpl", "common public", r"common public licen[cs]e", "1.0"),
    ("eupl", "european union public", r"european union public licen[cs]e", "1.0 1.1 1.2"),
    ("eupl", "eupl", r"eupl", "1.0 1.1 1.2"),
    ("artistic", "artistic", r"(?:perl )?artistic licen[cs]e", "1.0 2.0"),
    ("bsl", "boost", r"boost software licen[cs]e", "1.0"),
    ("busl", "business source", r"business source licen[cs]e", "1.0 1.1"),
    ("sspl", "server side public", r"server side public licen[cs]e", "1.0"),
    ("elastic", "elastic", r"elastic licen[cs]e", "1.0 2.0"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", ""),
    ("unlicense", "unlicense", r"unlicense", ""),
    ("wtfpl", "wtfpl", r"wtfpl", "1.0 2.0"),
    ("psf", "python software foundation", r"python software foundation licen[cs]e", "2.0"),
    ("ofl", "open font", r"(?:sil )?open font licen[cs]e", "1.0 1.1"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e", ""),
    ("afl", "academic free", r"academic free licen[cs]e", "2.0 2.1 3.0"),
    ("osl", "open software", r"open software licen[cs]e", "2.0 2.1 3.0"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", ""),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", ""),
    ("odbl", "open database", r"open database licen[cs]e", "1.0"),
    ("odc-by", "open data commons", r"open data commons attribution licen[cs]e", "1.0"),
    ("pddl", "public domain dedication", r"(?:odc )?public domain dedication and licen[cs]e", "1.0"),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?", ""),
    ("cc0", "cc0", r"(?:creative commons )?cc0(?: universal)?", "1.0"),
    ("cc0", "creative commons zero", r"creative commons zero", "1.0"),
    ("cc-by", "cc by", r"(?:creative commons )?cc by", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "cc by sa", r"(?:creative commons )?cc by sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", "cc by nd", r"(?:creative commons )?cc by nd", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", "cc by nc", r"(?:creative commons )?cc by nc", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", "cc by nc sa", r"(?:creative commons )?cc by nc sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", "cc by nc nd", r"(?:creative commons )?cc by nc nd", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by", "creative commons attribution", r"creative commons attribution", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "attribution share", r"creative commons attribution share ?alike", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", "attribution no", r"creative commons attribution no ?deriv(?:ative)?s", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", "attribution non", r"creative commons attribution non ?commercial", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", "attribution non", r"creative commons attribution non ?commercial share ?alike", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", "attribution non", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s", "1.0 2.0 2.5 3.0 4.0"),
)

# Sentences of license texts and notices: label, keyword, signature.
SENTENCES = (
    ("mit", "hereby granted free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "copy modify and", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "source and binary forms", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or promote", r"neither the name of .{1,200}? may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "compliance with the license", r"you may not use this file except in compliance with the license"),
    ("gpl", "is free software", r"this (?:program|library|file|software) is free software you can redistribute it and or modify it"),
    ("gpl-2.0", "either version 2", r"gnu general public license as published by the free software foundation either version 2"),
    ("gpl-3.0", "either version 3", r"gnu general public license as published by the free software foundation either version 3"),
    ("lgpl", "lesser general public", r"terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3.0", "affero", r"gnu affero general public license as published by the free software foundation either version 3"),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public license"),
    ("zlib", "express or implied warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl-1.0", "machine executable object", r"unless such copies or derivative works are solely in the form of machine executable object code"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "what the fuck", r"you just do what the fuck you want to"),
    ("public-domain", "public domain", r"(?:dedicated|released|placed|is|are)(?: in| into| to)? the public domain"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("proprietary", "proprietary", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("non-commercial", "commercial", r"for (?:non ?commercial|personal)(?: and non ?commercial)? use only"),
)

NAME, VERSION, GRANT, IDENTIFIER, SENTENCE = range(1, 6)
CONFIDENCE = {NAME: 0.6, VERSION: 0.85, GRANT: 0.95, IDENTIFIER: 0.99, SENTENCE: 0.97}
UNDER = (
    r"(?:licen[cs]ed|released|distributed|published|provided|available|offered|covered|governed|redistributed|issued|shared|made available)"
    r"(?: under| by| with)(?: the| a| an)?(?: terms(?: and conditions)? of(?: the| a)?)?"
)


@dataclass(frozen=True)
class Rule:
    """A signature; rules of one priority are ordered as they stand in the list."""

    label: str
    keyword: str
    signature: str
    priority: int


def numbered(version: str) -> str:
    """A version as it reads in normalised words: 3.0 as "3", "3 0", "v3", "version 3 0" and so on."""
    major, minor = version.split(".")
    return f"(?:version |v ?)?{major}" + ("(?: 0)?" if minor == "0" else f" {minor}")


@cache
def rules() -> tuple[Rule, ...]:
    """The ordered rules: base phrases, then every license in every form, then sentences."""
    out = [Rule(label, phrase, phrase, NAME) for phrase, label in BASE.items()]
    later = r"(?: only| or (?:any )?later(?: version)?)?"
    for label, keyword, name, versions in FAMILIES:
        named = f"(?:{name})"
        out += [Rule(label, keyword, named, NAME), Rule(label, keyword, f"{UNDER} {named}", GRANT)]
        for version in versions.split():
            # "gplv3" is one word, so no space has to precede a version.
            full = f"{named}(?: licen[cs]e)?(?: international| unported)? ?{numbered(version)}(?: international| unported)?{later}"
            out += [Rule(f"{label}-{version}", keyword, full, VERSION), Rule(f"{label}-{version}", keyword, f"{UNDER} {full}", GRANT)]
    for label in sorted({r.label for r in out}):
        ident = label.replace("-", " ").replace(".", " ")
        out.append(Rule(label, "spdx", f"spdx licen[cs]e identifier {ident}(?: only| or later)?", IDENTIFIER))
    return (*out, *(Rule(label, keyword, signature, SENTENCE) for label, keyword, signature in SENTENCES))


@cache
def matcher() -> tuple[ahocorasick.Automaton, list[re.Pattern]]:
    """Automaton from keywords to the rules they gate, and the compiled rules."""
    gates: dict[str, list[int]] = {}
    for i, rule in enumerate(rules()):
        gates.setdefault(rule.keyword, []).append(i)
    automaton = ahocorasick.Automaton()
    for keyword, held in gates.items():
        automaton.add_word(keyword, tuple(held))
    automaton.make_automaton()
    return automaton, [re.compile(f"(?<= )(?:{r.signature})(?= )") for r in rules()]


Span = tuple[int, int, int]


def detections(normal: str) -> list[Span]:
    """(rule, start, end) in characters of every match of a rule whose keyword occurs."""
    automaton, compiled = matcher()
    opened = sorted({i for _, held in automaton.iter(normal) for i in held})
    return [(i, *m.span()) for i in opened for m in compiled[i].finditer(normal)]


def unsuppressed(found: list[Span], priority) -> list[Span]:
    """Detections that lie in no detection of a higher priority, nor in a longer or earlier listed one of their own."""
    kept: list[Span] = []
    starts: list[int] = []
    reach: list[int] = []
    for level in sorted({priority(i) for i, _, _ in found}, reverse=True):
        last, own = -1, []
        for span in sorted((s for s in found if priority(s[0]) == level), key=lambda s: (s[1], -s[2], s[0])):
            _, start, end = span
            at = bisect_right(starts, start)
            if last < end and not (at and reach[at - 1] >= end):
                own.append(span)
                last = end
        kept += own
        kept.sort(key=lambda s: s[1])
        starts, reach = [s[1] for s in kept], []
        for s in kept:
            reach.append(max(s[2], reach[-1] if reach else 0))
    return kept


PLACE = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())])
FOUND = pa.struct([("label", pa.string()), ("rule", pa.int32()), ("priority", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("confidence", pa.float64())])
SCANNED = (
    "doc_id long, n_words long, base array<struct<label:string,first:long,last:long>>, "
    "found array<struct<label:string,rule:int,priority:int,first:long,last:long,confidence:double>>"
)


def scan(text: str | None) -> tuple[int, list[dict], list[dict]]:
    """Number of words, the places of base phrases, and the detections that remain, by word numbers (the last included)."""
    words = WORDS.findall((text or "").translate(LOWER))
    normal = f" {' '.join(words)} "
    found = detections(normal)
    if not found:
        return len(words), [], []
    # Where each word starts in `normal`.
    starts = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))) - np.array([len(w) for w in words])

    def placed(start: int, end: int) -> dict:
        return {"first": int(np.searchsorted(starts, start)), "last": int(np.searchsorted(starts, end)) - 1}

    book = rules()
    base = [{"label": book[i].label, **placed(a, b)} for i, a, b in sorted(found, key=lambda s: s[1]) if i < len(BASE)]
    kept = unsuppressed(found, lambda i: book[i].priority)
    return len(words), base, [
        {"label": book[i].label, "rule": i, "priority": book[i].priority, **placed(a, b), "confidence": CONFIDENCE[book[i].priority]} for i, a, b in kept
    ]


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, `base` places of the base phrases and `found` detections.

    Places count words from 0, the last word included. A null text counts as empty and
    has no words; texts of any length are scanned whole; a detection that ties with
    another in priority and place is the one listed first in `rules`; repeated rows and
    rows without an id are scanned one by one; other columns of any name play no part;
    an empty table gives no row.
    """
    prepared(docs.sparkSession)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scan(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(PLACE)), pa.array([g[2] for g in got], pa.list_(FOUND))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "base", "found"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scanned, SCANNED)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_licenses(documents(spark, sf_dir))

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    missed = F.aggregate("found", F.lit(1.0), lambda acc, x: acc * (1 - x["confidence"]))
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.first").alias("first_word"), F.array_max("base.first").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"), joined(F.concat("base.label", "found.label")).alias("labels"), (1 - missed).alias("score"),
    )
