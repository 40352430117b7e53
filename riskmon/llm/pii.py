"""Personal data by weak supervision.

Candidate spans come from strict base patterns and from looser ones. Five
labelers vote on each candidate: the base pattern, the shape, a gazetteer, words
before it, and candidates of other kinds near it. Expectation-maximisation over
the counts of distinct vote patterns estimates kind by kind how reliable each
labeler is. The posteriors train a logistic span classifier on the votes and on
what no labeler sees: length, share of digits and case. Base spans are always
reported; a looser candidate is reported when the classifier accepts it. Only
counts of distinct votes and bins reach the driver; texts are handled by column
expressions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmon.llm.common import documents, let, materialize, prepared

KINDS = ("email", "ip", "card", "phone")

# Base patterns. Possessive repeats and the look-behinds keep each scan linear;
# \G lets a match start where the one before it ended.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A cheap test that must hold for a valid match to exist.
GATES = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
}
# Looser patterns, each of a kind of its own or of a base kind. None bounds a length, and none rescans what it passed.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z]{2,}+",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "secret": r"(?i)(?<![A-Za-z])(?:token|secret|password|passwd|api[_-]?key)\x20?[=:]\x20?[\"']?[A-Za-z0-9_+/-]{12,}+",
}
LOOSE_GATES = {
    "email": lambda t: t.rlike(r"[\[(](?:at|AT)[\])]"),
    "phone": lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
    "secret": lambda t: t.rlike(r"[=:]\x20?[\"']?[A-Za-z0-9_+/-]{12}"),
}
NAMES = (*KINDS, "secret")

# Fixed values of the gazetteer labeler.
DOMAINS = """
com org net edu gov mil int info biz name pro mobi dev app online site xyz example test
ar at au be bg br ca ch cl cn co cz de dk ee es eu fi fr gr hk hr hu id ie il in io is it jp kr li lt lu lv me mx
my nl no nz ph pl pt ro rs ru se sg si sk th tr tv tw ua uk us vn za
""".split()
# Country calling codes of one or two digits; all others have three and start with one of ZONES.
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
ZONES = "21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split()
# Issuers' first digits, by the length of the number.
ISSUERS = {13: "4", 14: "30|36|38|39", 15: "34|37", 16: "4|5[1-5]|2[2-7]|35|6011|64[4-9]|65", 17: "62|5[06-8]|6", 18: "62|5[06-8]|6", 19: "4|62|5[06-8]|6"}
# Blocks of addresses that name no host: this network, loopback, link-local, multicast and reserved.
NOWHERE = r"^0*(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^0*169\.0*254\."
KEY_HEADS = "sk- sk_ pk_ rk_ ghp_ gho_ ghs_ github_pat_ glpat- xoxb- xoxp- AKIA ASIA AIza ya29 eyJ SG npm_ dop_v1_ hf_".split()
PLACEHOLDERS = "example changeme change-me placeholder yourkey your-key your_key xxxxxx dummy abcdef 123456 password secret".split()
# Words of the context labeler in the 40 code points before a span.
FOR = {
    "email": r"(?i)(?:mail|contact|write|reach|courriel|correo)",
    "ip": r"(?i)(?:\bip\b|host|server|address|login|adresse)",
    "card": r"(?i)(?:card|visa|credit|payment|karte|carte|tarjeta)",
    "phone": r"(?i)(?:call|phone|\btel|fax|mobile|telefon)",
    "secret": r"(?i)(?:key|auth|login|bearer|secret)",
}
AGAINST = r"(?i)(?:version|isbn|order|invoice|serial|\bno\.|build)"
# Candidates of other kinds so near speak for each other.
NEAR = 80
BLOCK = 64


def running(values: Column, none: int, join) -> Column:
    """Exclusive running fold of an array of longs, in blocks: near-linear in its length."""

    def fold(part: Column) -> Column:
        return F.aggregate(part, F.lit(none).cast("long"), join)

    def by_blocks(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / BLOCK).cast("int")), lambda b: fold(F.slice(v, b * BLOCK + 1, BLOCK)))

        def spread(sums: Column) -> Column:
            starts = F.transform(sums, lambda x, b: fold(F.slice(sums, F.lit(1), b)))

            def at(first: Column) -> Column:
                def one(x: Column, k: Column) -> Column:
                    b = F.floor(k / BLOCK).cast("int")
                    return join(F.get(first, b), fold(F.slice(v, b * BLOCK + 1, k % BLOCK)))

                return F.transform(v, one)

            return let(starts, at)

        return let(blocks, spread)

    return let(values, by_blocks)


def found(text: Column, kind: str, pattern: str, gate: Column) -> Column:
    """Array of (kind, s, e, v) of all matches, positions in code points, end exclusive.

    The pieces between matches and the matches themselves alternate, so their
    running lengths are the positions.
    """

    def placed(hits: Column) -> Column:
        def by_pieces(pieces: Column) -> Column:
            lengths = F.transform(pieces, lambda p, k: (F.length(p) + F.coalesce(F.length(F.get(hits, k)), F.lit(0))).cast("long"))

            def spans(before: Column) -> Column:
                def one(v: Column, k: Column) -> Column:
                    start = F.get(before, k) + F.length(F.get(pieces, k))
                    return F.struct(F.lit(kind).alias("kind"), start.alias("s"), (start + F.length(v)).alias("e"), v.alias("v"))

                return F.transform(hits, one)

            return let(running(lengths, 0, lambda a, b: a + b), spans)

        return let(F.split(text, pattern, -1), by_pieces)

    none = F.array().cast("array<struct<kind:string,s:bigint,e:bigint,v:string>>")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(gate, let(hits, lambda h: F.when(F.size(h) > 0, placed(h)).otherwise(none))).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """The digits' checksum, every second one from the right doubled, is a multiple of ten."""

    def total(d: Column) -> Column:
        doubled = F.transform(
            d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)
        )
        return F.aggregate(doubled, F.lit(0), lambda acc, x: acc + x) % 10 == 0

    return let(F.transform(F.split(F.reverse(digits(value)), ""), lambda x: F.coalesce(F.try_to_number(x, F.lit("9")).cast("int"), F.lit(0))), total)


PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits(v)).between(13, 19), luhn(v)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(v)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    def kept(kind: str) -> Column:
        return F.filter(found(text, kind, PATTERNS[kind], GATES[kind](text)), lambda x: valid(kind, x["v"]))

    return {kind: kept(kind) for kind in KINDS}


def one_of(values: list[str]) -> str:
    return "(?:" + "|".join(v.replace(".", r"\.") for v in values) + ")"


def gazetteer(kind: Column, v: Column) -> Column:
    """1 where a fixed list knows a part of the value, -1 where it rules the value out, else 0."""
    number = digits(v)
    issuer = F.lit(False)
    for length, heads in ISSUERS.items():
        issuer = F.when(F.length(number) == length, number.rlike(f"^(?:{heads})")).otherwise(issuer)
    calling = number.rlike(f"^{one_of(CALLING)}|^{one_of(ZONES)}[0-9]")
    area = number.rlike("^[2-9][0-8][0-9][2-9]")
    secret = F.regexp_extract(v, r"[=:]\x20?[\"']?(.*)$", 1)
    return (
        F.when(kind == "email", F.when(F.lower(F.regexp_extract(v, r"[.\])\x20]([A-Za-z]+)$", 1)).isin(DOMAINS), 1).otherwise(-1))
        .when(kind == "ip", F.when(v.rlike(NOWHERE), -1).otherwise(1))
        .when(kind == "card", F.when(issuer, 1).otherwise(-1))
        .when(kind == "phone", F.when(F.when(v.startswith("+"), calling).otherwise(area), 1).otherwise(-1))
        .when(secret.rlike(f"^{one_of(KEY_HEADS)}"), 1)
        .when(F.lower(secret).rlike(one_of(PLACEHOLDERS)), -1)
        .otherwise(0)
    )


def shape(kind: Column, v: Column) -> Column:
    """1 where the value is built like most of its kind, else -1."""
    strict = (
        F.when(kind == "secret", v.rlike(r"[A-Za-z0-9_+/-]{20}") & v.rlike(r"[0-9]"))
        .when(kind == "phone", F.length(digits(v)).between(10, 13))
        .when(kind == "ip", ~v.rlike(r"(?:^|\.)0[0-9]"))
        .when(kind == "email", ~v.rlike(r"^[._%+-]|\.\."))
        .otherwise(~v.rlike(r"^([0-9])(?:[\x20-]?\1)*$") & ~digits(v).rlike("^0"))
    )
    return F.when(strict, 1).otherwise(-1)


def context(kind: Column, before: Column) -> Column:
    """1 after a word that announces the kind, -1 after one that announces another number, else 0."""
    announced = F.lit(False)
    for name, pattern in FOR.items():
        announced = F.when(kind == name, before.rlike(pattern)).otherwise(announced)
    return F.when(announced, 1).when(before.rlike(AGAINST), -1).otherwise(0)


LABELERS = ("pattern", "shape", "gazetteer", "context", "neighbour")
# The classifier's own view of a span: binned length, share of digits, and mixed case.
LENGTHS, SHARES = 8, 5
BINS = ("length_bin", "digit_bin", "mixed")


def ballot(text: Column, x: Column, before_it: Column, after_it: Column) -> Column:
    """A candidate with its labelers' votes (1 for, -1 against, 0 no opinion) and the classifier's bins."""
    kind, v = x["kind"], x["v"]
    before = F.substring(text, F.greatest(x["s"] - 39, F.lit(1)).cast("int"), F.least(x["s"], F.lit(40)).cast("int"))
    near = F.coalesce((before_it["kind"] != kind) & (x["s"] - before_it["e"] <= NEAR), F.lit(False))
    near = near | F.coalesce((after_it["kind"] != kind) & (after_it["s"] - x["e"] <= NEAR), F.lit(False))
    length = F.length(v)
    return F.struct(
        kind.alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base"),
        x["base"].cast("int").alias("pattern"), shape(kind, v).alias("shape"), gazetteer(kind, v).alias("gazetteer"),
        context(kind, before).alias("context"), near.cast("int").alias("neighbour"),
        F.least(F.floor(F.log2(length.cast("double"))), F.lit(LENGTHS - 1)).cast("int").alias("length_bin"),
        F.least(F.floor(F.length(digits(v)) * SHARES / length), F.lit(SHARES - 1)).cast("int").alias("digit_bin"),
        (v.rlike("[a-z]") & v.rlike("[A-Z]")).cast("int").alias("mixed"),
    )


FAR = 2**62


def free(ordered: Column) -> Column:
    """The candidates, in order of their starts, without the looser ones that overlap a base span."""
    ends = running(F.transform(ordered, lambda x: F.when(x["base"], x["e"]).otherwise(F.lit(0))), 0, lambda a, b: F.greatest(a, b))
    starts = F.reverse(running(F.reverse(F.transform(ordered, lambda x: F.when(x["base"], x["s"]).otherwise(F.lit(FAR)))), FAR, lambda a, b: F.least(a, b)))
    apart = let(
        F.struct(ends.alias("ends"), starts.alias("starts")),
        lambda at: F.filter(ordered, lambda x, k: x["base"] | ((F.get(at["ends"], k) <= x["s"]) & (F.get(at["starts"], k) >= x["e"]))),
    )
    return F.when(F.exists(ordered, lambda x: ~x["base"]) & F.exists(ordered, lambda x: x["base"]), apart).otherwise(ordered)


def candidates(docs: DataFrame, keep_rows: bool) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))

    def marked(spans: Column, base: bool) -> Column:
        # Base spans go before looser ones of the same start.
        return F.transform(
            spans, lambda x: F.struct(x["s"].alias("s"), F.lit(0 if base else 1).alias("loose"), x["e"].alias("e"), x["kind"].alias("kind"), x["v"].alias("v"), F.lit(base).alias("base"))
        )

    every = [marked(x, True) for x in base_spans(text).values()] + [marked(found(text, k, LOOSE[k], LOOSE_GATES[k](text)), False) for k in LOOSE]
    got = docs.select(
        "doc_id", text.alias("text"), F.sort_array(F.concat(*every)).alias("found"), *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if keep_rows else [])
    )
    votes = let(free(F.col("found")), lambda c: F.transform(c, lambda x, k: ballot(F.col("text"), x, F.get(c, k - 1), F.get(c, k + 1))))
    return got.select("doc_id", votes.alias("spans"), *(["row"] if keep_rows else []))


Pattern = tuple[tuple[int, ...], float]


def em(patterns: list[Pattern], rounds: int = 50) -> tuple[list[dict[int, list[float]]], list[float]]:
    """Reliabilities P(vote | class) of the labelers for one kind, and each vote pattern's posterior.

    Labelers count as independent given the class, and start as somewhat better than chance.
    """
    posterior = [0.9 if sum(p) > 0 else 0.1 for p, _ in patterns]
    rates: list[dict[int, list[float]]] = []
    for _ in range(rounds):
        total = [1.0, 1.0]
        rates = [{-1: [2.0, 1.0], 0: [1.5, 1.5], 1: [1.0, 2.0]} for _ in LABELERS]
        for (p, n), q in zip(patterns, posterior):
            for c, weight in ((0, n * (1 - q)), (1, n * q)):
                total[c] += weight
                for j, v in enumerate(p):
                    rates[j][v][c] += weight
        for table in rates:
            for c in (0, 1):
                whole = sum(table[v][c] for v in table)
                for v in table:
                    table[v][c] /= whole
        posterior = []
        for p, _ in patterns:
            score = math.log(total[1] / total[0]) + sum(math.log(rates[j][v][1] / rates[j][v][0]) for j, v in enumerate(p))
            posterior.append(1 / (1 + math.exp(-max(-30.0, min(30.0, score)))))
    return rates, posterior


# Rows of counts: kind, votes, bins, number of spans.
Count = tuple[str, tuple[int, ...], tuple[int, ...], float]


def features(kind: str, votes: tuple[int, ...], bins: tuple[int, ...]) -> list[float]:
    """The classifier's inputs: kind, votes by kind, and the bins, as 0, 1 and -1."""
    out = [float(kind == k) for k in NAMES]
    for k in NAMES:
        out += [float(v) if k == kind else 0.0 for v in votes]
    length, share, mixed = bins
    return out + [float(length == i) for i in range(LENGTHS)] + [float(share == i) for i in range(SHARES)] + [float(mixed)]


def posteriors(counts: list[Count]) -> list[float]:
    """Each row's posterior, from labelers judged kind by kind."""
    by_kind: dict[str, dict[tuple[int, ...], float]] = {}
    for kind, votes, _, n in counts:
        own = by_kind.setdefault(kind, {})
        own[votes] = own.get(votes, 0.0) + n
    judged = {}
    for kind, own in by_kind.items():
        patterns = sorted(own.items())
        judged |= {(kind, votes): q for (votes, _), q in zip(patterns, em(patterns)[1])}
    return [judged[kind, votes] for kind, votes, _, _ in counts]


def fit_classifier(counts: list[Count], posterior: list[float], steps: int = 25, ridge: float = 0.01) -> np.ndarray:
    """Logistic weights of `features`, by Newton steps on the posterior labels weighted by count."""
    x = np.array([features(k, v, b) for k, v, b, _ in counts])
    n, q = np.array([c[3] for c in counts]), np.array(posterior)
    n = n / n.sum()
    weights = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (n * (p - q)) + 1e-4 * ridge * weights
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(weights)) * 1e-4 * ridge + np.eye(len(weights)) * 1e-9
        step = np.linalg.solve(curve, slope)
        weights -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return weights


def classifier(weights: np.ndarray, x: Column) -> Column:
    """The score of a candidate as a column; above 0 it counts as personal data."""

    def pick(values: np.ndarray, index: Column) -> Column:
        return F.get(F.array(*[F.lit(float(w)) for w in values]), index)

    kinds, votes = len(NAMES), len(LABELERS)
    kind = F.array_position(F.array(*[F.lit(k) for k in NAMES]), x["kind"]).cast("int") - 1
    by_vote = weights[kinds : kinds + kinds * votes].reshape(kinds, votes)
    rest = weights[kinds + kinds * votes :]
    score = pick(weights[:kinds], kind) + pick(rest[:LENGTHS], x["length_bin"]) + pick(rest[LENGTHS : LENGTHS + SHARES], x["digit_bin"])
    for j, name in enumerate(LABELERS):
        score = score + pick(by_vote[:, j], kind) * x[name]
    return score + F.lit(float(rest[-1])) * x["mixed"]


def train(stored: DataFrame) -> np.ndarray | None:
    """Weights from the candidates of all documents, or None if there are none.

    Only counts of distinct (kind, votes, bins) reach the driver: fewer than 5 x 3^5 x 80 rows at any size.
    """
    names = ("kind", *LABELERS, *BINS)
    rows = stored.select(F.explode("spans").alias("x")).groupBy(*[F.col(f"x.{c}").alias(c) for c in names]).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = sorted((r["kind"], tuple(r[c] for c in LABELERS), tuple(r[c] for c in BINS), float(r["n"])) for r in rows)
    return fit_classifier(counts, posteriors(counts)) if counts else None


def detect(docs: DataFrame, keep_rows: bool = False) -> DataFrame:
    """One row per input row: doc_id and `spans` (rank of the kind, s, e, kind, base), ordered by kind and start.

    A null or empty text has no spans; texts and matches of any length are read
    whole; spans of one kind and start tie by their end; repeated rows are handled
    one by one; other columns play no part; an empty table gives no row. The
    reliabilities are estimated from the candidates of all documents.
    """
    prepared(docs.sparkSession)
    stored = materialize(candidates(docs, False), "pii")
    weights = train(stored)

    def accepted(x: Column) -> Column:
        return x["base"] | (classifier(weights, x) > 0) if weights is not None else x["base"]

    ranks = F.array(*[F.lit(k) for k in NAMES])

    def placed(x: Column) -> Column:
        return F.struct(F.array_position(ranks, x["kind"]).alias("rank"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), x["base"].alias("base"))

    chosen = F.sort_array(F.transform(F.filter("spans", accepted), placed))
    # Whole rows are scanned again rather than stored with their spans.
    return (candidates(docs, True) if keep_rows else stored).select("doc_id", chosen.alias("spans"), *(["row"] if keep_rows else []))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each maximal run of overlapping spans replaced by the kind of its first one, in angle brackets."""

    def cut(ordered: Column) -> Column:
        def joined(done: Column) -> Column:
            parts = F.transform(
                ordered,
                lambda x, k: F.when(
                    (x["s"] >= F.get(done, k)) | (k == 0),
                    F.concat(
                        F.substring(text, (F.get(done, k) + 1).cast("int"), (x["s"] - F.get(done, k)).cast("int")),
                        F.lit("<"), x["kind"], F.lit(">"),
                    ),
                ).otherwise(F.lit("")),
            )
            last = F.array_max(F.transform(ordered, lambda x: x["e"]))
            return F.concat(F.array_join(parts, ""), F.substring(text, (last + 1).cast("int"), F.length(text)))

        ends = running(F.transform(ordered, lambda x: x["e"]), 0, lambda a, b: F.greatest(a, b))
        return let(ends, joined)

    by_start = F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return F.when(F.size(spans) > 0, let(by_start, cut)).otherwise(text)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda x: x["base"])

    def number(kind: str, among: Column = base) -> Column:
        return F.size(F.filter(among, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return detect(documents(spark, sf_dir)).select(
        "doc_id", *[number(kind) for kind in KINDS], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(spans).alias("spans"),
        F.size(spans).cast("long").alias("n_spans"), number("secret", spans),
    )
