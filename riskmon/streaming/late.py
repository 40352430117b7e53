"""Late rows: a watermark that each micro-batch reads from what earlier ones stored, and a second sink for what it refuses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def watermark(spark: SparkSession, folder: str, batch_id: int, lateness: int) -> int | None:
    """The latest time of all micro-batches before this one, less `lateness`; null before the first."""
    try:
        seen = spark.read.schema("latest long, batch_id long").parquet(f"{folder}/progress")
        latest = seen.where(F.col("batch_id") < batch_id).agg(F.max("latest")).first()[0]
    except AnalysisException:
        return None
    return None if latest is None else latest - lateness


def splitter(folder: str, time: str, lateness: int) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`: rows at or after the watermark go to `folder`/accepted, the others, and those without a time, to `folder`/dead_letter.

    Every micro-batch overwrites its own part of each table, so one that is run again
    after a failure leaves each row once.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        mark = watermark(spark, folder, batch_id, lateness)
        fine = F.col(time).isNotNull() if mark is None else F.coalesce(F.col(time) >= mark, F.lit(False))
        kept = rows.persist()
        for name, part in (("accepted", kept.where(fine)), ("dead_letter", kept.where(~fine).withColumn("watermark", F.lit(mark).cast("long")))):
            part.write.mode("overwrite").parquet(f"{folder}/{name}/batch_id={batch_id}")
        # Last, so that a micro-batch counts as seen only when its rows are stored.
        kept.agg(F.max(time).cast("long").alias("latest")).write.mode("overwrite").parquet(f"{folder}/progress/batch_id={batch_id}")
        kept.unpersist()

    return write


def split_late(rows: DataFrame, folder: str, time: str, lateness: int, checkpoint: str, **options):
    """Start the split of a stream of rows whose `time` counts whole units; returns the streaming query."""
    return rows.writeStream.foreachBatch(splitter(folder.rstrip("/"), time, lateness)).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()
