"""Public export through a column allow-list, and validated load."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmon.sources import ingest

FORBIDDEN = "transactionid"


def public_table(df: DataFrame, name: str, allowed: list[str]) -> DataFrame:
    """Only the allowed columns; a missing one, or one that names a transaction id, is an error."""
    missing = [c for c in allowed if c not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    if any(FORBIDDEN in c.lower() for c in allowed):
        raise ValueError(f"{name}: transaction ids are not public")
    return df.select(*allowed)


def export_tables(tables: dict[str, DataFrame], allowed: dict[str, list[str]], target: str) -> None:
    """Check all tables before the first one is written; the manifest with the inventory comes last, so an export that broke off has none."""
    checked = {name: public_table(tables[name], name, columns) for name, columns in allowed.items()}
    for name, df in checked.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/{name}.parquet")
    if checked:
        spark = next(iter(checked.values())).sparkSession
        ingest.write_manifest(spark, f"{target}/manifest", {"manifest_version": 1, "created_at_utc": datetime.now(UTC).isoformat(), "files": sorted(checked)})


def load_tables(spark: SparkSession, source: str, allowed: dict[str, list[str]], optional: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """Tables whose column sets are exactly the allowed ones; an `optional` table may be absent and is empty then.

    The manifest must name the tables that are there, no more and no fewer.
    """
    listed, extra = set(ingest.read_manifest(spark, f"{source}/manifest").get("files", ())), optional or {}
    here = {name: columns for name, columns in extra.items() if present(spark, f"{source}/{name}.parquet")}
    if listed != {*allowed, *here}:
        raise ValueError(f"the manifest lists {sorted(listed)}, not {sorted({*allowed, *here})}")
    out = {name: spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns)) for name, columns in extra.items() if name not in here}
    for name, columns in (allowed | here).items():
        df = spark.read.parquet(f"{source}/{name}.parquet")
        if set(df.columns) != set(columns):
            raise ValueError(f"{name}: unexpected columns")
        out[name] = df
    return out


def present(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place))


def update_latest(spark: SparkSession, path: str, order: str, changes: dict[str, object]) -> str:
    """A new version of a table with the row of the largest `order` changed; returns its path, the old one stays."""
    df = spark.read.parquet(path)
    latest = df.agg(F.max(order)).first()[0]
    new = f"{path.rstrip('/')}-{uuid.uuid4().hex[:8]}"
    df.withColumns({c: F.when(F.col(order) == latest, F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()}).write.parquet(new)
    return new
