"""Quality classifier as a sparse ensemble of conjunctive rules.

Shallow trees over text statistics are grown on labelled documents; every path
from a root to a node is a conjunction of threshold tests. A lasso logistic fit
over these rules keeps a few of them, and the result is compiled into one column
expression, so that scoring a corpus runs no model code.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmon.llm.common import documents, let, materialize, prepared
from riskmon.llm.rules import repeated_words, words_of

# At most so many labelled rows fit the model; statistics cover every document.
SAMPLE_ROWS = 20_000
TREES, DEPTH, PENALTY = 24, 3, 0.002
FEATURES = (
    "log_words", "word_length", "symbols", "exclamations", "bars", "capitals", "digits",
    "distinct_words", "repeated_words", "line_words", "duplicate_lines",
)


def statistics(docs: DataFrame, extra: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, the columns `extra` and the features of each document; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    of_words = let(
        words_of(F.col("text")),
        lambda w: F.struct(
            F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"),
            F.size(F.array_distinct(w)).alias("different"), repeated_words(w).alias("repeated"),
        ),
    )
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.trim(line)) > 0)
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("different")))
    counted = docs.select(
        "doc_id", *extra, of_words.alias("w"), of_lines.alias("l"),
        *[F.regexp_count(text, F.lit(p)).alias(n) for n, p in (("sym", "[#*$%&<>]"), ("exc", "!"), ("bar", r"\|"), ("cap", "[A-ZÀ-ÖØ-Þ]"), ("dig", "[0-9]"))],
    )
    words, lined = F.greatest(F.col("w.n"), F.lit(1)), F.greatest(F.col("l.n"), F.lit(1))
    chars = F.greatest(F.col("w.chars"), F.lit(1))
    values = {
        "log_words": F.log1p(F.col("w.n").cast("double")),
        "word_length": F.col("w.chars") / words,
        "symbols": F.col("sym") / words,
        "exclamations": F.col("exc") / words,
        "bars": F.col("bar") / words,
        "capitals": F.col("cap") / chars,
        "digits": F.col("dig") / chars,
        "distinct_words": F.col("w.different") / words,
        "repeated_words": F.col("w.repeated") / words,
        "line_words": F.log1p(F.col("w.n") / lined),
        "duplicate_lines": 1 - F.col("l.different") / lined,
    }
    others = [c for c in counted.columns if c not in ("w", "l", "sym", "exc", "bar", "cap", "dig")]
    return counted.select(*others, *[values[f].cast("double").alias(f) for f in FEATURES])


Test = tuple[int, str, float]


def paths(tree_text: str) -> set[tuple[Test, ...]]:
    """The conjunctions of all nodes below the root in a tree's printed form."""
    found, held = set(), []
    for line in tree_text.splitlines():
        got = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if got:
            depth = len(got[1])
            held = [x for x in held if x[0] < depth] + [(depth, (int(got[2]), got[3], float(got[4])))]
            found.add(tuple(sorted({test for _, test in held})))
    return found


def rule_column(rule: tuple[Test, ...]) -> Column:
    out = F.lit(True)
    for feature, sign, bound in rule:
        value = F.col(FEATURES[feature])
        out = out & (value <= bound if sign == "<=" else value > bound)
    return out.cast("double")


class RuleEnsemble:
    """Rules with weights and an intercept; `score` is a column over `statistics`."""

    def __init__(self, intercept: float, weighted: list[tuple[tuple[Test, ...], float]]):
        self.intercept, self.weighted = intercept, weighted

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weighted:
            total = total + F.lit(weight) * rule_column(rule)
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{FEATURES[f]} {s} {b:.4g}" for f, s, b in rule) for rule, w in self.weighted]


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(doc_id, text, label) of at most `sample_rows` labelled ids, chosen by hash of the id, each once.

    Of labels that share an id the largest counts, and of texts the smallest.
    """
    ids = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """Fit on `labelled_sample`.

    Rows without a label play no part. With one class only, the score is that
    class's share, smoothed; without labels it is one half.
    """
    labelled = labelled_sample(docs, labels, sample_rows)
    # A bounded table, read many times by the two fits: few partitions, kept in memory.
    train = materialize(statistics(labelled, (F.col("label").cast("double").alias("label"),)), "quality-train").coalesce(4).persist()
    n, ones = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        share = (ones + 0.5) / (n + 1.0)
        return RuleEnsemble(math.log(share / (1 - share)), [])
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(train)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, subsamplingRate=0.8, featureSubsetStrategy="onethird")
    grown = forest.fit(vectors)
    rules = sorted(set().union(*[paths(tree.toDebugString) for tree in grown.trees]))
    if not rules:
        rules = [((0, ">", 0.0),)]
    # Stored, since the lasso runs over a hundred jobs, and each one's task would carry the plan of all rules.
    held = materialize(train.select("label", F.array(*[rule_column(r) for r in rules]).alias("x")), "quality-rules").coalesce(4)
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=60)
    model = lasso.fit(held.select("label", array_to_vector("x").alias("features")))
    weights = model.coefficients.toArray()
    train.unpersist()
    return RuleEnsemble(float(model.intercept), [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-4])


def score_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, keep_rows: bool = False) -> DataFrame:
    """One row per input row: doc_id, `score`, the estimate that its quality label is 1, and the features.

    `labels` holds doc_id and label, and only rows that may be learned from. Null
    and empty texts are scored by their statistics like others, and texts of any
    length by all of their words; a row's score depends on no other row, so ties need
    no rule and repeated rows get equal scores; other columns play no part; an empty
    table gives no row. With `keep_rows` the input row comes along as the struct
    ``row``.
    """
    prepared(docs.sparkSession)
    row = (F.struct(*[docs[c] for c in docs.columns]).alias("row"),) if keep_rows else ()
    return statistics(docs, row).withColumn("score", fit(docs, labels, sample_rows).score())


def fold(modulus: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def training_labels(spark: SparkSession, sf_dir: str, column: str, modulus: int, held_out: int) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return table.where(fold(modulus) != held_out).select("doc_id", F.col(column).alias("label"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(documents(spark, sf_dir), training_labels(spark, sf_dir, "quality", 4, 2))
    return scored.select(
        "doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
