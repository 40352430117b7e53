"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmon.session import importable

# Words of every operator of this subpackage: maximal runs of other characters
# than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
# Stands for a missing id.
LAST = 2**63 - 1
# Rows of one Arrow batch between the JVM and a Python worker.
BATCH_ROWS = 1000
SPACES = r"[\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, local
    masters use the machine's temporary folder and others are refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return "file://" + tempfile.gettempdir() + "/riskmon-scratch"
    raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")


def materialize(df: DataFrame, name: str, keep_in: str | None = None) -> DataFrame:
    """Write `df` once to the shared scratch folder and return the stored table.

    This cuts the lineage in a form that survives lost executors; the table is
    removed when the application ends, unless a folder to keep it in is given.
    """
    spark = df.sparkSession
    path = f"{keep_in or scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not keep_in:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._scratch_path = path
    return stored


def discard(stored: DataFrame) -> None:
    """Delete a table of `materialize` that no later plan reads."""
    spark = stored.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(stored._scratch_path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once per row, whatever the optimizer inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prepared(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches small enough for rows of long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return importable(spark)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")


def ids_repeat(docs: DataFrame) -> bool:
    """Whether several rows share an id; rows without one share the largest."""
    return not docs.groupBy(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).count().where("count > 1").isEmpty()


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc, th, text, doc_id) and whether ids repeat.

    doc is the id to compare by, a missing one as the largest; th tells rows of one
    id apart and is 0 where no id repeats.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    repeat = ids_repeat(docs)
    ident = F.col("doc_id").cast("long")
    number = F.monotonically_increasing_id() if repeat else F.lit(0).cast("long")
    rows = docs.select(F.coalesce(ident, F.lit(LAST)).alias("doc"), number.alias("th"), text.alias("text"), ident.alias("doc_id"))
    # Stored where rows are numbered, since every plan must see the same numbers.
    return (materialize(rows, "keyed") if repeat else rows), repeat


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], most: int = 1024) -> DataFrame:
    """Inner join of stored `rows` with a stored `table` that holds each key once and in `n` the number of its rows.

    The `most` keys of the most rows are joined by broadcast, all others, of which
    none has more than 1 / `most` of the rows, by shuffle. So no task gathers the
    rows of a hot key, and what is broadcast is bounded at any size. A table of fewer
    than `most` keys needs no second join.
    """
    # Taken once, as a local table of bounded size: every plan that broadcasts it would sort the whole table again.
    taken = table.orderBy(F.desc("n"), *keys).limit(most).toArrow()
    hot = table.sparkSession.createDataFrame(taken, table.schema)
    if taken.num_rows < most:
        return rows.join(F.broadcast(hot), keys)
    known = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias("__hot"))), keys, "left")
    rest = known.where("__hot is null").select(*rows.columns).join(table, keys)
    return rest.unionByName(rows.join(F.broadcast(hot), keys))


def tasks_for(df: DataFrame, rows_per_task: int, least: int = 1) -> int:
    """Number of groups such that none holds many more than `rows_per_task` rows; grows with the input."""
    return max(least, -(-df.count() // rows_per_task))
