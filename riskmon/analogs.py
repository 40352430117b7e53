"""Views of the driver's tables in the shape of the transaction domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as transactions; time is in whole seconds, independent of the session's time zone."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.col("ts")
    seconds = F.datediff(ts, F.lit("1970-01-01")) * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return e.select(
        "event_id", seconds.cast("long").alias("t"), F.col("value").alias("amount"), "user_id",
        F.concat(F.lit("P"), (F.col("user_id") % 5).cast("string")).alias("product"),
        F.col("event_type").alias("channel"),
        F.when(F.col("user_id") % 11 != 0, F.col("user_id") % 7).alias("region"),
        (F.regexp_extract("props", "[0-9]+", 0).cast("int") / F.lit(100.0)).alias("score"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as transactions at midnights, with many equal times."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(
        F.col("o_orderkey").alias("event_id"), (F.datediff("o_orderdate", F.lit("1970-01-01")) * 86400).cast("long").alias("t"),
        F.col("o_totalprice").alias("amount"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("product"),
    )
