"""Features of an entity's strictly earlier rows.

Times before the current one form the frame, so rows of equal time never see
each other. Rows are first summed per key and time: the window then runs over
distinct times, which keeps hot keys small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NAMES = ("prior_count", "hours_since_previous", "prior_amount_mean", "amount_to_prior_mean")


def check_columns(df: DataFrame, needed: Sequence[str]) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def _features(df: DataFrame, entity: str, n, last, total, time: str, amount: str) -> DataFrame:
    mean = F.when(n > 0, total / n)
    ratio = F.when((mean != 0) & F.col(amount).isNotNull(), F.col(amount) / mean)
    return df.withColumns({
        f"{entity}_prior_count": n.cast("int"),
        f"{entity}_hours_since_previous": ((F.col(time) - last) / 3600).cast("float"),
        f"{entity}_prior_amount_mean": mean.cast("float"),
        f"{entity}_amount_to_prior_mean": ratio.cast("float"),
    })


def add_causal(df: DataFrame, entity: str, keys: Sequence[str], time: str = "t", amount: str = "amount") -> DataFrame:
    """Adds the four past-only columns of one entity; null keys form one entity.

    The mean divides by all earlier rows, those without amount included.
    """
    check_columns(df, [*keys, time, amount])
    before = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    moments = df.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.coalesce(amount, F.lit(0.0))).alias("__s"))
    past = moments.select(
        *keys, time,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"), F.max(time).over(before).alias("__last"),
        F.coalesce(F.sum("__s").over(before), F.lit(0.0)).alias("__s"),
    )
    same = F.col(f"d.{time}").eqNullSafe(F.col(f"p.{time}"))
    for k in keys:
        same = same & F.col(f"d.{k}").eqNullSafe(F.col(f"p.{k}"))
    joined = df.alias("d").join(past.alias("p"), same, "left").select("d.*", "p.__n", "p.__last", "p.__s")
    return _features(joined, entity, F.col("__n"), F.col("__last"), F.col("__s"), time, amount).drop("__n", "__last", "__s")


def add_frozen(df: DataFrame, history: DataFrame, entity: str, keys: Sequence[str], time: str = "t", amount: str = "amount") -> DataFrame:
    """The same columns from a frozen history: no row of `df` sees another."""
    state = history.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.max(time).alias("__last"), F.sum(F.coalesce(amount, F.lit(0.0))).alias("__s")
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"d.{k}").eqNullSafe(F.col(f"p.{k}"))
    joined = df.alias("d").join(state.alias("p"), same, "left").select("d.*", "p.__n", "p.__last", "p.__s")
    return _features(joined, entity, F.coalesce(F.col("__n"), F.lit(0)), F.col("__last"), F.col("__s"), time, amount).drop("__n", "__last", "__s")
