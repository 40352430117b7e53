"""Quality rules as a bitmask ledger.

Every rule is evaluated once over a text. The ledger stores the measurements and
one integer whose bit i says that rule i fails. A policy is a versioned mask of
rules: applying one, comparing two or leaving a rule out are bitwise operations
on the stored ledger and never touch the texts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmon.llm.common import SPACES, WORD, documents, let, materialize, prepared

WINDOW = 5

# Rule name, failing condition over the measurements. The position is the bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("duplicate_lines", "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines"),
    ("long_words", "word_chars > 25 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("exclamations", "100 * n_exclaims > 30 * n_words"),
]
BASE = ("few_words", "repeated_windows")
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "duplicate_lines"),
    "v3": tuple(name for name, _ in RULES),
}


def bit(name: str) -> int:
    return 1 << [rule for rule, _ in RULES].index(name)


def mask(version: str) -> int:
    return sum(bit(name) for name in POLICIES[version])


def words_of(text: Column) -> Column:
    """Words of a text in order; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the array.

    Windows are compared by 64-bit hash. Only an array with an equal pair of
    windows is sorted: equal windows are then neighbours, and each adds the words
    up to the next repeated window, five at most.
    """

    def covered(windows: Column) -> Column:
        def marked(ordered: Column) -> Column:
            twins = F.filter(ordered, lambda x, k: (F.get(ordered, k - 1)["h"] == x["h"]) | (F.get(ordered, k + 1)["h"] == x["h"]))
            return let(
                F.array_sort(F.transform(twins, lambda x: x["i"])),
                lambda at: F.aggregate(
                    F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)))),
                    F.lit(0), lambda acc, x: acc + x,
                ),
            )

        return let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), marked)

    def by_windows(hashed: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(hashed) - WINDOW), lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(WINDOW)])
        )
        found = let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
        return F.when(F.size(hashed) <= WINDOW, F.lit(0)).otherwise(found)

    return let(F.transform(words, lambda w: F.xxhash64(w)), by_windows)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements that the rules use, one row per input row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    of_words = let(
        words_of(F.col("text")),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        lines,
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    return docs.select(
        "doc_id", of_words.alias("of_words"), of_lines.alias("of_lines"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_exclaims"),
    ).select("doc_id", "of_words.*", "of_lines.*", "n_symbols", "n_exclaims")


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements plus ``bits``, the failed rules of each document.

    A null or empty text has no words and fails few_words; texts of any length are
    read whole; no rule depends on other rows, so there are no ties; repeated rows
    are judged one by one; other columns of any name play no part; an empty table
    gives an empty ledger.
    """
    prepared(docs.sparkSession)
    failed = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, condition) in enumerate(RULES)]
    bits = failed[0]
    for one in failed[1:]:
        bits = bits.bitwiseOR(one)
    return measure(docs).withColumn("bits", bits)


def apply_policy(entries: DataFrame, version: str) -> DataFrame:
    """The ledger with `kept`: no rule of the policy fails."""
    return entries.withColumn("kept", F.col("bits").bitwiseAND(F.lit(mask(version))) == 0)


def ablate(entries: DataFrame, version: str) -> DataFrame:
    """Per rule of a policy: documents that fail it, fail it alone, and are kept without it.

    Works on counts per distinct bitmask, 2^rules at most.
    """
    counts = entries.groupBy(F.col("bits").bitwiseAND(F.lit(mask(version))).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(bit(n)).alias("bit")) for n in POLICIES[version]])).alias("r")
    crossed = counts.select("bits", "n", rules).select("bits", "n", "r.*")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return crossed.groupBy("rule", "bit").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("failed"),
        total(F.col("bits") == F.col("bit")).alias("failed_alone"),
        total(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("kept_without"),
    )


def explained(entries: DataFrame, version: str) -> DataFrame:
    """The ledger under a policy: `policy`, `kept`, and for the rest `first_failed` with that rule's ablation figures."""
    failed = F.col("bits").bitwiseAND(F.lit(mask(version)))
    lowest = failed.bitwiseAND(-failed)
    table = ablate(entries, version).withColumnRenamed("rule", "first_failed")
    # At most one row per rule of the policy.
    told = apply_policy(entries, version).withColumn("lowest", lowest).join(F.broadcast(table), F.col("lowest") == F.col("bit"), "left")
    return told.drop("lowest", "bit").withColumn("policy", F.lit(version))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = sum(bit(name) for name in BASE)
    judged = explained(materialize(ledger(documents(spark, sf_dir)), "ledger"), "v3")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("bits").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), "kept",
        "bits", "policy", "first_failed", "failed", "failed_alone", "kept_without",
    )


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
g AS (SELECT r, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' '))) AS win,
             unnest(range(1, greatest(len(w) - 3, 1))) AS pos FROM w),
p AS (SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY r, win) AS n FROM g) WHERE n > 1),
q AS (SELECT r, sum(least(5, coalesce(nxt - pos, 5))) AS n_repeat_words
      FROM (SELECT r, pos, lead(pos) OVER (PARTITION BY r ORDER BY pos) AS nxt FROM p) GROUP BY r),
l AS (SELECT r, len(x) AS n_lines, len(x) - len(list_distinct(x)) AS n_dup_lines
      FROM (SELECT r, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS x FROM t)),
m AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(w.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             len(regexp_extract_all(w.text, '!')) AS n_exclaims, l.n_lines,
             CAST(l.n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(q.n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM w JOIN l ON l.r = w.r LEFT JOIN q ON q.r = w.r),
b AS (SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (100 * n_symbols > 30 * n_words)::INT
             + 8 * (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)::INT + 16 * (word_chars > 25 * n_words)::INT
             + 32 * (word_chars < 2 * n_words)::INT + 64 * (100 * n_exclaims > 30 * n_words)::INT AS INTEGER) AS bits FROM m),
v(rule, bit) AS (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('duplicate_lines', 8), ('long_words', 16), ('short_words', 32), ('exclamations', 64)),
a AS (SELECT rule, bit, count(*) FILTER (WHERE bits & bit <> 0) AS failed, count(*) FILTER (WHERE bits = bit) AS failed_alone,
             count(*) FILTER (WHERE bits & ~bit = 0) AS kept_without FROM b, v GROUP BY rule, bit)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 AS base_failed, bits = 0 AS kept,
       bits, 'v3' AS policy, a.rule AS first_failed, failed, failed_alone, kept_without
FROM b LEFT JOIN a ON a.bit = b.bits & -b.bits
"""
