"""Session helpers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers that see this machine's files import the package.

    On a cluster ship the package with ``--py-files`` or install it.
    """
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(":")
    if root not in known:
        env["PYTHONPATH"] = ":".join(x for x in (root, *known) if x)
    return spark
