"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key ``-ln(u) / weight``, where u is a uniform
number derived from its id and weight a quality weight derived from its text.
A source whose target holds e whole epochs and a rest takes every document e
times and, for the rest, documents in the order of their keys until the running
sum of sizes comes nearest to it. The running sum is taken in two levels, over
key ranges and then inside the one range where a source's budget ends, so that
no task orders a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskmon.llm.common import WORD, documents, materialize

NOISE = r"[#*$%&|<>!]"


def quality_weight(text: Column) -> Column:
    """Weight in [0.1, 1]: 1 for plain prose, less for texts dense in symbols."""
    noise = F.regexp_count(text, F.lit(NOISE)) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(6.0) * noise), F.lit(1.0))


def uniform(ident: Column) -> Column:
    """A reproducible number in (0, 1) from the first 48 bits of an id's MD5."""
    digits = F.substring(F.md5(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def source_targets(sized: DataFrame, share: float, weights: tuple, most: float) -> DataFrame:
    """Per source: its size and its target, by filling capped shares to one level.

    A source's cap is `most` times its size. Sorted by cap over weight, sources
    below the common level stop at their cap and the others get level x weight;
    this is where repeated resharing of the excess ends.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    listed = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per.withColumn("w", F.element_at(cycle, ((F.row_number().over(listed) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    filled = (
        ranked.withColumn("caps", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("used", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("budget", F.least(F.lit(share) * F.sum("source_size").over(every), F.sum("cap").over(every)))
        .withColumn("place", F.row_number().over(by_ratio))
        .withColumn("level", (F.col("budget") - F.col("caps")) / (F.sum("w").over(every) - F.col("used")))
    )
    # The first source in this order that its own level does not lift above its cap sets the level of all.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(every)["level"]
    return filled.select("source", "source_size", F.least(F.col("cap"), F.coalesce(level, F.col("ratio")) * F.col("w")).alias("target"))


def mix_sources(
    docs: DataFrame,
    share: float = 1.5,
    weights: tuple = (5, 2, 1),
    most: float = 2.0,
    ranges: int = 1024,
    keep_rows: bool = False,
) -> DataFrame:
    """One row per input row with the words that the mix takes from it.

    Sources in code point order (null last, a source of its own) weigh `weights`
    in turn and share `share` times all sizes; a target stops at `most` times its
    source's size. Columns: doc_id, source, size, source_size, target, copies
    (0 to ceil(most)), taken = copies x size, and with `keep_rows` the input row
    as the struct ``row``. A null or empty text has size 0 and takes nothing;
    repeated rows are taken or left one by one; an empty table gives no row;
    other columns of any name play no part. A source that ends in a document
    takes it if that brings the sum nearer to its target.
    """
    base = docs.select(
        F.col("doc_id"),
        F.col("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (-F.log(uniform(F.col("doc_id"))) / quality_weight(F.col("text"))).alias("key"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if keep_rows else []),
    )
    sized = materialize(base.withColumn("range", F.floor((1 - F.exp(-F.col("key"))) * ranges).cast("int")), "mix")
    targets = source_targets(sized, share, weights, most).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(F.lit(0)).cast("int")
    ).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        sized.groupBy("source", "range")
        .agg(F.sum("size").alias("range_size"))
        .withColumn("below", F.coalesce(F.sum("range_size").over(upto), F.lit(0)))
        .alias("s")
        .join(targets.alias("t"), F.expr("s.source <=> t.source"))
        .select("s.source", "range", "range_size", "below", "source_size", "target", "epochs", "rest")
    )
    placed = sized.alias("d").join(spans.alias("s"), F.expr("d.source <=> s.source and d.range = s.range")).select(
        "d.*", "s.range_size", "s.below", "s.source_size", "s.target", "s.epochs", "s.rest"
    )
    ends = (F.col("below") < F.col("rest")) & (F.col("below") + F.col("range_size") > F.col("rest"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    whole = placed.where(~ends).withColumn("extra", (F.col("below") + F.col("range_size") <= F.col("rest")).cast("int"))
    partly = (
        placed.where(ends)
        .withColumn("upto", F.col("below") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("extra", (F.col("upto") + F.col("size") / 2 <= F.col("rest")).cast("int"))
        .drop("upto")
    )
    out = whole.unionByName(partly).withColumn("copies", F.col("epochs") + F.col("extra"))
    return out.select(
        "doc_id", "source", "size", "source_size", F.round("target", 3).alias("target"), "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"), *(["row"] if keep_rows else []),
    )


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         -ln((CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
           / coalesce(greatest(0.1::DOUBLE, 1.0::DOUBLE - 6.0::DOUBLE * len(regexp_extract_all(text, '[#*$%&|<>!]')) / greatest(length(text), 1)), 1.0::DOUBLE) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS ssize FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
c AS (SELECT *, 2.0::DOUBLE * ssize AS cap, 2.0::DOUBLE * ssize / w AS ratio FROM r),
f AS (SELECT *, (least(1.5::DOUBLE * sum(ssize) OVER (), sum(cap) OVER ()) - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lev
      FROM c WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, ssize, least(cap, coalesce((SELECT lev FROM f WHERE lev <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1), ratio) * w) AS target FROM f),
e AS (SELECT *, CASE WHEN ssize > 0 THEN floor(target / ssize + 1e-9) ELSE 0 END AS epochs FROM t),
x AS (SELECT d.*, e.ssize, e.target, e.epochs, e.target - e.epochs * e.ssize AS rest,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, CAST(ssize AS BIGINT) AS source_size, round(target, 3) AS target,
       CAST((epochs + CASE WHEN size > 0 AND upto + size / 2.0 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM x
"""
