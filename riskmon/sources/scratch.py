"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame


def _written(df: DataFrame, name: str):
    """The stored table, its file system and its path."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        folder = f"file://{tempfile.gettempdir()}/riskmon-monitoring"
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    system.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path), system, place


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and return the stored table, so that several plans read it; removed when the application ends.

    The cluster names the folder in ``spark.checkpoint.dir``; only local masters may leave it unset.
    """
    return _written(df, name)[0]


@contextmanager
def held(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """The same for the length of a block: no plan that runs later may read the table."""
    table, system, place = _written(df, name)
    try:
        yield table
    finally:
        system.delete(place, True)
