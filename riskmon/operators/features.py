"""Row features and fitted preprocessing."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmon.sources.ingest import AVAILABLE

MISSING, UNKNOWN = "__MISSING__", "__UNKNOWN__"

# Columns that hold categories whatever their type.
CATEGORIES = """
ProductCD card1 card2 card3 card4 card5 card6 addr1 addr2 P_emaildomain R_emaildomain M1 M2 M3 M4 M5 M6 M7 M8 M9
DeviceType DeviceInfo id_12 id_13 id_14 id_15 id_16 id_17 id_18 id_19 id_20 id_21 id_22 id_23 id_24 id_25
id_26 id_27 id_28 id_29 id_30 id_31 id_32 id_33 id_34 id_35 id_36 id_37 id_38
""".split()
# Columns that say who or when a row is, and nothing that a model may see.
EXCLUDED = ("event_id", "t", "label", "dataset_period", "development_block", "production_batch", "shadow_batch")
COUNTS = ("missing_count_identity", "missing_count_vendor", "missing_count_transaction")


def is_categorical(name: str) -> bool:
    return name in CATEGORIES


def is_numeric(name: str) -> bool:
    """Counts, time gaps, distances, vendor columns and the first identity columns, by name."""
    return bool(re.fullmatch(r"[CDV][0-9]+|dist[0-9]+|id_(0[1-9]|1[01])", name))


def add_stateless(df: DataFrame, time: str = "t", amount: str = "amount", families: dict[str, list[str]] | None = None) -> DataFrame:
    """Amount and time features in 32 bits, and null counts per family of columns."""
    value = F.expr(f"try_cast({amount} as double)")
    hour = (F.col(time) % 86400) / 3600
    day = (F.col(time) % 604800) / 86400
    out = df.withColumns({
        "amount_log1p": F.when(value.isNotNull(), F.log1p(F.greatest(value, F.lit(0.0)))).cast("float"),
        "amount_fraction": (value - F.floor(value)).cast("float"),
        "elapsed_day": (F.col(time) / 86400).cast("float"),
        "hour_sin": F.sin(2 * math.pi * hour / 24).cast("float"), "hour_cos": F.cos(2 * math.pi * hour / 24).cast("float"),
        "weekday_sin": F.sin(2 * math.pi * day / 7).cast("float"), "weekday_cos": F.cos(2 * math.pi * day / 7).cast("float"),
    })
    if AVAILABLE in df.columns:
        out = out.withColumn(AVAILABLE, F.coalesce(F.col(AVAILABLE), F.lit(False)).cast("byte"))
    counts = {f"missing_count_{name}": null_count(columns) for name, columns in (families or {}).items()}
    return out.withColumns(counts) if counts else out


def column_families(columns: list[str], excluded: tuple[str, ...] = EXCLUDED) -> dict[str, list[str]]:
    """The columns of three families, by name; vendor columns are transaction columns too."""
    identity = [c for c in columns if c.startswith("id_") or c in ("DeviceType", "DeviceInfo")]
    vendor = [c for c in columns if re.fullmatch(r"[CDMV][0-9]+", c)]
    left_out = {*identity, *excluded, *COUNTS, AVAILABLE}
    return {"identity": identity, "vendor": vendor, "transaction": [c for c in columns if c not in left_out]}


def add_missing_counts(df: DataFrame, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Null counts of the three families among all columns that `df` has now; an empty family counts 0."""
    return df.withColumns({f"missing_count_{name}": null_count(columns) for name, columns in column_families(df.columns, excluded).items()})


def null_count(columns: list[str]) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + F.col(c).isNull().cast("int")
    return total.cast("short")


def as_category(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


@dataclass
class Preprocessor:
    """Drop rules, frozen levels and frequencies, all small and on the driver."""

    categorical: list[str]
    numeric: list[str]
    missing_threshold: float = 0.98
    cardinality_limit: int = 1000
    dropped: list[str] = field(default_factory=list)
    levels: dict[str, list[str]] = field(default_factory=dict)
    frequencies: dict[str, DataFrame] = field(default_factory=dict)

    def profile(self, df: DataFrame) -> DataFrame:
        """One row per column: share of nulls and distinct values, nulls counted as one."""
        columns = [*self.categorical, *self.numeric]
        aggs = []
        for c in columns:
            aggs += [F.avg(F.col(c).isNull().cast("double")).alias(f"m_{c}"), (F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(f"d_{c}")]
        wide = df.agg(*aggs)
        rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("missing_share"), F.col(f"d_{c}").cast("long").alias("distinct_values")) for c in columns])
        return wide.select(F.explode(rows).alias("r")).select(
            "r.*", ((F.col("r.missing_share") > self.missing_threshold) | (F.col("r.distinct_values") <= 1)).alias("dropped")
        )

    def fit(self, df: DataFrame) -> Preprocessor:
        seen = {r["column"]: r for r in self.profile(df).collect()}
        self.dropped = [c for c, r in seen.items() if r["dropped"]]
        for c in self.categorical:
            if c in self.dropped:
                continue
            if seen[c]["distinct_values"] > self.cardinality_limit:
                self.frequencies[c] = frequency_table(df, c)
            else:
                self.levels[c] = sorted(r[0] for r in df.select(as_category(c)).distinct().collect())
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """The fitted columns: unseen frequencies are 0, unseen levels the unknown level."""
        missing = [c for c in (*self.categorical, *self.numeric) if c not in df.columns and c not in self.dropped]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        out, names = df, []
        for c in self.categorical:
            if c in self.frequencies:
                table = self.frequencies[c].select(F.col("value").alias(f"__{c}"), F.col("frequency").cast("float").alias(f"{c}__frequency"))
                out = out.join(table, as_category(c) == F.col(f"__{c}"), "left").drop(f"__{c}")
                out = out.withColumn(f"{c}__frequency", F.coalesce(f"{c}__frequency", F.lit(0.0).cast("float")))
                names.append(f"{c}__frequency")
            elif c in self.levels:
                names.append(c)
        mapped = {c: F.when(as_category(c).isin(self.levels[c]), as_category(c)).otherwise(UNKNOWN) for c in self.levels}
        mapped |= {c: F.expr(f"try_cast({c} as float)") for c in self.numeric if c not in self.dropped}
        names += [c for c in self.numeric if c not in self.dropped]
        return out.withColumns(mapped).select(*[c for c in df.columns if c not in (*self.categorical, *self.numeric)], *names)


def fit_folds(df: DataFrame, folds: dict[str, Column], categorical: list[str], numeric: list[str], missing_threshold: float = 0.98, cardinality_limit: int = 1000, keep=lambda table: table) -> dict[str, Preprocessor]:
    """A fitted preprocessor for each fold, whose training rows a condition names, all from one pass over the rows.

    Levels and frequencies are counted once per fold, column and level, so no fold
    sees a level of another; `keep` may store these counts, which are read again.
    """
    each = F.explode(F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in folds.items()])))
    held = df.withColumn("__fold", each)
    texts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in categorical])) if categorical else None
    fitted = {name: Preprocessor(list(categorical), list(numeric), missing_threshold, cardinality_limit) for name in folds}
    if numeric:
        sums = [x for c in numeric for x in (F.avg(F.col(c).isNull().cast("double")).alias(f"m_{c}"), (F.min(c) == F.max(c)).alias(f"s_{c}"))]
        for r in held.groupBy("__fold").agg(*sums).collect():
            # One value and no nulls, or nulls only, is one distinct value.
            fitted[r["__fold"]].dropped = [c for c in numeric if r[f"m_{c}"] > missing_threshold or r[f"m_{c}"] == 1 or (r[f"m_{c}"] == 0 and r[f"s_{c}"])]
    if not categorical:
        return fitted
    counts = keep(held.select("__fold", texts.alias("r")).groupBy(F.col("__fold").alias("fold"), "r.column", "r.value").agg(F.count(F.lit(1)).alias("n")))
    shapes = counts.groupBy("fold", "column").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("gaps")).collect()
    few = [(r["fold"], r["column"]) for r in shapes if r["distinct"] <= cardinality_limit]
    known: dict[tuple, list[str]] = {}
    if few:
        small = F.concat_ws("\x1f", "fold", "column").isin([f"{a}\x1f{b}" for a, b in few])
        for r in counts.where(small).select("fold", "column", F.coalesce("value", F.lit(MISSING)).alias("value")).collect():
            known.setdefault((r["fold"], r["column"]), []).append(r["value"])
    for r in shapes:
        one, c = fitted[r["fold"]], r["column"]
        if r["gaps"] / r["rows"] > missing_threshold or r["distinct"] <= 1:
            one.dropped.append(c)
        elif r["distinct"] <= cardinality_limit:
            one.levels[c] = sorted(set(known[r["fold"], c]))
        else:
            own = counts.where((F.col("fold") == r["fold"]) & (F.col("column") == c))
            value, share = F.coalesce("value", F.lit(MISSING)).alias("value"), (F.sum("n") / r["rows"]).alias("frequency")
            one.frequencies[c] = own.groupBy(value).agg(F.sum("n").alias("n"), share)
    for one in fitted.values():
        # As the columns were given, in whatever order the counts came.
        one.dropped = [c for c in (*categorical, *numeric) if c in one.dropped]
        one.levels = {c: one.levels[c] for c in categorical if c in one.levels}
        one.frequencies = {c: one.frequencies[c] for c in categorical if c in one.frequencies}
    return fitted


def frequency_table(df: DataFrame, column: str) -> DataFrame:
    counted = df.groupBy(as_category(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total")))).select("value", "n", (F.col("n") / F.col("total")).alias("frequency"))


def category_levels(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, rows) of several columns in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), as_category(c).alias("value")) for c in columns]))
    return df.select(each.alias("r")).groupBy("r.column", "r.value").agg(F.count(F.lit(1)).alias("rows"))
