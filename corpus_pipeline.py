"""A corpus pipeline: judge, deduplicate, redact, mix and pack the documents.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmon.llm import minhash, mixing, packing, pii, quality
from riskmon.llm.common import discard, documents, ids_repeat, join_counted, materialize, prepared

# Percent of similarity from which the near-duplicate stage takes two documents for one.
SIMILAR = 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.7 or more.

    Null, empty and very long texts are scored by their statistics like others;
    repeated rows stay or go together, and no rule is needed for ties; extra columns
    of any name pass through; an empty table stays empty.
    """
    prepared(spark)
    labels = quality.training_labels(spark, sf_dir, "quality", 4, 2)
    return quality.score_quality(docs, labels, keep_rows=True).where("score >= 0.7").select("row.*")


def row_keys(docs: DataFrame) -> DataFrame:
    """docs with `__key`: the id, or a number above all ids for rows without one and for all but one of the rows of an id."""
    if not ids_repeat(docs) and docs.where("doc_id is null").isEmpty():
        return docs.withColumn("__key", F.col("doc_id").cast("long"))
    # Stored, since the numbers must be the same in every plan.
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    once = numbered.where("doc_id is not null").groupBy("doc_id").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("n"))
    most = docs.agg(F.coalesce(F.max("doc_id").cast("long"), F.lit(-1))).first()[0]
    above = F.col("__row") + F.lit(most + 1)
    # Only ids of several rows need the join.
    firsts = materialize(once.where("n > 1"), "firsts")
    again = join_counted(numbered.select("doc_id", "__row"), firsts, ["doc_id"]).where("__row <> __first").select("__row", F.lit(True).alias("__again"))
    marked = numbered.join(again, "__row", "left")
    key = F.when(F.col("doc_id").isNull() | F.col("__again").isNotNull(), above).otherwise(F.col("doc_id").cast("long"))
    return materialize(marked.withColumn("__key", key).select(*docs.columns, "__key"), "keys")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates, of similarity 0.8 or more.

    First is the smallest id; rows without an id, and further rows of an id, are
    documents of their own that come after all ids. Null, empty and blank texts have
    no near-duplicates and stay; very long texts are compared whole; extra columns of
    any name pass through; an empty table stays empty.
    """
    prepared(spark)
    keyed = row_keys(docs)
    judged = minhash.near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text"), SIMILAR)
    dropped = judged.where("not kept").select(F.col("doc_id").alias("__key"))
    return keyed.join(dropped, "__key", "left_anti").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind; n_chars follows the text.

    A null text stays null and an empty one empty; texts and spans of any length are
    replaced whole; overlapping spans tie for the kind of the first; repeated rows
    change alike; extra columns of any name pass through; an empty table stays empty.
    """
    prepared(spark)
    text = pii.redacted(F.coalesce(F.col("row.text"), F.lit("")), F.col("spans"))
    clean = pii.detect(docs, keep_rows=True).select("row", F.when(F.col("row.text").isNotNull(), text).alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return clean.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null and empty texts hold no words, so they stay with the whole epochs of their
    source only; very long texts count all their words; equal keys tie by doc_id and
    size; repeated rows are taken one by one; extra columns of any name pass through;
    an empty table stays empty.
    """
    prepared(spark)
    mixed = mixing.mix_sources(docs, keep_rows=True)
    return mixed.where("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 1024 tokens.

    A null or empty text is its end token alone, a very long one is cut; pieces of one
    length tie by doc_id; repeated rows are packed one by one; extra columns play no
    part; an empty table gives no row.
    """
    prepared(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", drop_low_quality),
    ("near-duplicates", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("mixing", mix),
    ("packing", pack),
]

# Model scores and hashed choices are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each one's result stored before the next."""
    docs, stored = documents(spark, sf_dir), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, "stage-" + name.replace(" ", "-"))
            if stored is not None:
                discard(stored)
            stored = docs
    return docs
