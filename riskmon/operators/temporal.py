"""Elapsed-time periods, development blocks, production and shadow batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERIODS = ("development", "calibration", "acceptance", "production")


@dataclass(frozen=True)
class Bounds:
    """Time range and the cutoffs at the ends of the first three periods."""

    least: int
    most: int
    fractions: tuple[float, float, float] = (0.5, 0.6, 0.7)

    @property
    def span(self) -> int:
        return self.most - self.least

    def cutoff(self, i: int) -> float:
        return self.least + self.fractions[i] * self.span


def time_bounds(df: DataFrame, time: str = "t") -> Bounds:
    """Time range; raises if the column is missing, empty, null somewhere or a single instant."""
    if time not in df.columns:
        raise ValueError(f"missing time column {time}")
    n, empty, least, most = df.agg(F.count(F.lit(1)), F.count_if(F.col(time).isNull()), F.min(time), F.max(time)).first()
    if not n or empty:
        raise ValueError("the time column must be non-empty and without nulls")
    if least == most:
        raise ValueError("times must span more than one instant")
    return Bounds(least, most)


def assign_partitions(df: DataFrame, bounds: Bounds, blocks: int = 5, batch_seconds: int = 604_800, time: str = "t") -> DataFrame:
    """Adds dataset_period, development_block and production_batch, pure functions of the time."""
    position = (F.col(time) - bounds.least).cast("double") / float(bounds.span)
    first, second, third = bounds.fractions
    period = (
        F.when(position < first, PERIODS[0]).when(position < second, PERIODS[1]).when(position < third, PERIODS[2]).otherwise(PERIODS[3])
    )
    block = F.least(F.greatest(F.floor(position / first * blocks) + 1, F.lit(1)), F.lit(blocks))
    batch = F.floor((F.col(time) - F.lit(bounds.cutoff(2))) / batch_seconds) + 1
    return df.withColumns({
        "dataset_period": period,
        "development_block": F.when(position < first, block).cast("short"),
        "production_batch": F.when(position >= third, batch).cast("int"),
    })


def check_partitions(df: DataFrame, blocks: int = 5) -> None:
    """Raises if a period or a development block is empty."""
    seen = df.groupBy("dataset_period", "development_block").count().collect()
    if {r[0] for r in seen} != set(PERIODS) or {r[1] for r in seen if r[1]} != set(range(1, blocks + 1)):
        raise ValueError("every period and every development block must hold rows")


def check_shadow_follows(train: Bounds, shadow: Bounds) -> None:
    if shadow.least <= train.most:
        raise ValueError("shadow times must be strictly after training times")


def assign_shadow_batches(df: DataFrame, least: int, batch_seconds: int = 604_800, time: str = "t") -> DataFrame:
    return df.withColumn("shadow_batch", (F.floor((F.col(time) - least) / batch_seconds) + 1).cast("int"))


def expanding_folds(blocks: int = 5) -> list[tuple[str, int, int]]:
    """(name, last training block, validation block)."""
    return [(f"blocks_1_{k - 1}_to_{k}", k - 1, k) for k in range(3, blocks + 1)]


def fold_rows(df: DataFrame, blocks: int = 5) -> DataFrame:
    """Row counts of the training and validation side of every fold, in one pass."""
    block = F.col("development_block")
    sides = F.array(*[
        F.struct(
            F.lit(name).alias("fold"), F.when(block <= last, "train").when(block == valid, "validation").alias("side")
        ) for name, last, valid in expanding_folds(blocks)
    ])
    each = df.where(block.isNotNull()).select("t", F.explode(sides).alias("f")).where("f.side is not null")
    return each.groupBy("f.fold", "f.side").agg(F.count(F.lit(1)).alias("rows"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
