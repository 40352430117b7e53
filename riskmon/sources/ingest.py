"""CSV and Parquet ingest with contract checks."""

from __future__ import annotations

import hashlib
import json
import math
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_TOKENS = ("", "NA", "NaN", "null")
AVAILABLE = "identity_available"


class DataValidationError(ValueError):
    """An input table breaks its contract."""


def required_files(spark: SparkSession, folder: str, names: tuple[str, ...]) -> list[str]:
    """The paths of the named files in a folder of any file system; one that is absent is an error."""
    paths = [f"{folder.rstrip('/')}/{name}" for name in names]
    missing = []
    for path in paths:
        try:
            spark.read.text(path)
        except AnalysisException as found:
            if found.getCondition() != "PATH_NOT_FOUND":
                raise
            missing.append(path)
    if missing:
        raise FileNotFoundError(f"missing files: {', '.join(missing)}")
    return paths


def read_csv(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """All columns as text first, null tokens to null, then strict casts (a bad value fails the job).

    Columns without a type stay text; NaN never appears, it is null.
    """
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    out = []
    for c in raw.columns:
        value = F.when(~F.trim(F.col(f"`{c}`")).isin(*NULL_TOKENS), F.col(f"`{c}`"))
        out.append((value.cast(types[c]) if c in types else value).alias(c))
    return raw.select(*out)


def normalize_identity(df: DataFrame) -> DataFrame:
    """id-12 becomes id_12; a collision is an error."""
    names = [c.replace("-", "_") if c.startswith("id-") else c for c in df.columns]
    if len(set(names)) < len(names):
        raise DataValidationError("two columns have the same name once normalized")
    return df.toDF(*names)


def contract_report(df: DataFrame, table: str, ident: str, label: str | None = None) -> DataFrame:
    """One row of counts that a valid table has at zero: null ids, repeated ids, bad labels."""
    bad = F.count_if(F.col(label).isNull() | ~F.col(label).isin(0, 1)) if label else F.lit(0).cast("long")
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(ident).isNull()).alias("null_ids"),
        (F.count(ident) - F.count_distinct(ident)).alias("repeated_ids"), bad.alias("bad_labels"),
    ).select(F.lit(table).alias("table_name"), "*")


def validate(df: DataFrame, table: str, ident: str, time: str | None = None, label: str | None = None) -> DataFrame:
    missing = [c for c in (ident, time, label) if c and c not in df.columns]
    if missing:
        raise DataValidationError(f"{table}: missing columns {missing}")
    found = contract_report(df, table, ident, label).first()
    if found["null_ids"] or found["repeated_ids"] or found["bad_labels"]:
        raise DataValidationError(f"{table}: {found.asDict()}")
    if time and df.where(F.col(time).isNull()).limit(1).count():
        raise DataValidationError(f"{table}: null times")
    return df


def join_one_to_one(left: DataFrame, right: DataFrame, ident: str) -> DataFrame:
    """Left join of two tables with unique ids; identity_available tells whether the right side had the row."""
    if AVAILABLE in left.columns or AVAILABLE in right.columns:
        raise DataValidationError(f"{AVAILABLE} is a reserved name")
    validate(left, "left", ident)
    validate(right, "right", ident)
    joined = left.join(right.withColumn(AVAILABLE, F.lit(True)), ident, "left")
    return joined.withColumn(AVAILABLE, F.coalesce(AVAILABLE, F.lit(False)))


def profile(df: DataFrame) -> DataFrame:
    """(column, rows, null_share) of every column in one pass."""
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *[F.avg(F.col(c).isNull().cast("double")).alias(f"n_{c}") for c in df.columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("null_share")) for c in df.columns]))
    return wide.select("rows", each.alias("r")).select("r.column", "rows", "r.null_share")


def summary(df: DataFrame, time: str, label: str | None = None, period: str | None = None) -> DataFrame:
    """Rows, time range, coverage of identities and prevalence of the table and of each of its periods, in one pass.

    The table's own row has no period; an empty table has no rows in it.
    """
    share = F.avg(F.col(AVAILABLE).cast("double")) if AVAILABLE in df.columns else F.lit(None).cast("double")
    prevalence = F.avg(F.col(label).cast("double")) if label else F.lit(None).cast("double")
    sums = [F.count(F.lit(1)).alias("rows"), F.min(time).alias("minimum_time"), F.max(time).alias("maximum_time"), share.alias("identity_coverage"), prevalence.alias("prevalence")]
    if period is None:
        return df.agg(*sums).select(F.lit(None).cast("string").alias("period"), "*")
    return df.select("*", F.col(period).alias("__period")).rollup("__period").agg(*sums).withColumnRenamed("__period", "period")


def table_profile(df: DataFrame, time: str, label: str | None = None, period: str | None = None) -> dict:
    """What a manifest says of a table."""
    held = {r["period"]: r for r in summary(df, time, label, period).collect()}
    whole = held.pop(None)
    out = {k: v for k, v in whole.asDict().items() if k not in ("period", "prevalence")}
    out |= {"columns": len(df.columns), "schema": dict(df.dtypes), "missing_fraction": {r["column"]: r["null_share"] for r in profile(df).collect()}}
    if label:
        out["prevalence"] = whole["prevalence"]
    return out | ({"period_rows": {k: r["rows"] for k, r in sorted(held.items())}} if period else {})


def fingerprint(spark: SparkSession, path: str) -> dict:
    """Lines and content digest of a text file of any size on any file system, from tasks.

    Each line gives two numbers of 60 bits of its SHA-256, and the digest is their sums,
    so it depends on the lines and how often they occur, but not on their order.
    """
    digest = F.sha2(F.col("value").cast("binary"), 256)
    parts = [F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(28,0)")) for at in (1, 16)]
    lines, *sums = spark.read.text(path).agg(F.count(F.lit(1)), *parts).first()
    return {"lines": lines, "digest": "-".join(f"{int(x or 0):x}" for x in sums)}


def write_manifest(spark: SparkSession, path: str, value: dict) -> None:
    """One line of JSON as a text table, so that it may lie on any file system."""
    text = json.dumps(json_safe(value), sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    """A manifest of version 1; an absent one or one of another version is refused."""
    folder, _, name = path.rstrip("/").rpartition("/")
    found = json.loads(spark.read.text(required_files(spark, folder, (name,))[0]).first()[0])
    if found.get("manifest_version") != 1:
        raise DataValidationError(f"{path}: unsupported manifest version {found.get('manifest_version')}")
    return found


def sha256_of(path: str, chunk: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(chunk):
            digest.update(part)
    return digest.hexdigest()


def content_version(hashes: dict[str, str]) -> str:
    return hashlib.sha256(json.dumps(hashes, sort_keys=True).encode()).hexdigest()[:12]


def json_safe(value: object) -> object:
    """Numbers that JSON lacks become null, keys text, numpy scalars plain."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [json_safe(v) for v in value]
    if hasattr(value, "item"):
        value = value.item()
    return None if isinstance(value, float) and not math.isfinite(value) else value


def write_json(path: str, value: object) -> None:
    Path(path).write_text(json.dumps(json_safe(value), indent=2, sort_keys=True))
