"""Baselines, boosted trees, calibration and temporal tuning with Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmon.operators import bootstrap, explain
from riskmon.operators.features import as_category
from riskmon.operators.metrics import calibration_error, ranking
from riskmon.operators.temporal import expanding_folds


def require_both_classes(df: DataFrame, label: str = "label") -> None:
    if {r[0] for r in df.select(label).distinct().collect()} != {0, 1}:
        raise ValueError("the target must hold exactly the classes 0 and 1")


def prior_score(train: DataFrame, label: str = "label") -> float:
    return float(train.agg(F.avg(label)).first()[0])


def logistic_baseline(train: DataFrame, categorical: list[str], numeric: list[str], label: str = "label", c: float = 1.0) -> PipelineModel:
    """Median-imputed, standardised numbers with missing flags and one-hot categories; classes weigh the same."""
    require_both_classes(train, label)
    prepared = logistic_input(train, categorical, numeric)
    n, share = prepared.agg(F.count(F.lit(1)), F.avg(label)).first()
    weighted = prepared.withColumn("class_weight", F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    stages = [Imputer(strategy="median", inputCols=numeric, outputCols=[f"{x}_filled" for x in numeric])] if numeric else []
    stages += [VectorAssembler(inputCols=[f"{x}_filled" for x in numeric] + [f"{x}_missing" for x in numeric], outputCol="numbers"), StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True)] if numeric else []
    stages += [StringIndexer(inputCols=[f"{x}_text" for x in categorical], outputCols=[f"{x}_index" for x in categorical], handleInvalid="keep"),
               OneHotEncoder(inputCols=[f"{x}_index" for x in categorical], outputCols=[f"{x}_hot" for x in categorical])] if categorical else []
    stages += [
        VectorAssembler(inputCols=(["scaled"] if numeric else []) + [f"{x}_hot" for x in categorical], outputCol="features"),
        LogisticRegression(labelCol=label, weightCol="class_weight", regParam=1 / (c * n), maxIter=100),
    ]
    return Pipeline(stages=stages).fit(weighted)


def logistic_input(df: DataFrame, categorical: list[str], numeric: list[str]) -> DataFrame:
    flags = {f"{x}_missing": F.col(x).isNull().cast("double") for x in numeric} | {x: F.col(x).cast("double") for x in numeric}
    return df.withColumns(flags | {f"{x}_text": as_category(x) for x in categorical})


def probability(scored: DataFrame) -> Column:
    return vector_to_array(scored["probability"])[1]


def boosted_trees(
    train: DataFrame, columns: list[str], label: str = "label", seed: int = 42, validation: Column | None = None, positive_weight: bool = False,
    levels: dict[str, int] | None = None, **parameters,
) -> PipelineModel:
    """Gradient-boosted trees over numeric columns; missing values become -1e9.

    `levels` names the columns that hold a category's number, 0 to so many less one: they are
    split into sets of categories, not by order, and the bins are at least as many as categories.
    `validation` marks the rows for early stopping, `positive_weight` weighs
    positives by negatives over positives.
    """
    require_both_classes(train, label)
    rows = train.na.fill(-1e9, columns)
    for c, n in (levels or {}).items():
        rows = rows.withMetadata(c, {"ml_attr": {"type": "nominal", "name": c, "num_vals": n}})
    bins = max([parameters.get("maxBins", 32), *(levels or {}).values()])
    model = GBTClassifier(labelCol=label, seed=seed, **parameters | {"maxBins": bins})
    if validation is not None:
        rows = rows.withColumn("is_validation", validation)
        model = model.setValidationIndicatorCol("is_validation")
    if positive_weight:
        share = prior_score(train, label)
        rows = rows.withColumn("row_weight", F.when(F.col(label) == 1, (1 - share) / share).otherwise(1.0))
        model = model.setWeightCol("row_weight")
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), model]).fit(rows)


def staged_average_precision(model: PipelineModel, validation: DataFrame, columns: list[str], label: str = "label") -> list[float]:
    """Average precision on the validation rows under 1, 2, ... trees, all ranked in one plan."""
    staged = explain.staged_margins(validation, model, columns, [label])
    found = {r["trees"]: r["pr_auc"] for r in ranking(staged, ["trees"], score="margin", label=label).collect()}
    return [found[k] for k in sorted(found)]


def boosted_trees_by_precision(train: DataFrame, validation: DataFrame, columns: list[str], label: str = "label", seed: int = 42, patience: int = 0, **parameters) -> tuple[PipelineModel, list[float]]:
    """Boosted trees cut at the fewest trees of the best average precision on `validation`, and all prefixes' values.

    `patience` ends the search after so many trees without a better value. Trees of a
    prefix do not depend on later ones, so the cut model is fitted with that many.
    """
    require_both_classes(validation, label)
    model = boosted_trees(train, columns, label, seed, **parameters)
    values = staged_average_precision(model, validation, columns, label)
    best = 0
    for k, value in enumerate(values):
        if value > values[best]:
            best = k
        elif patience and k - best >= patience:
            break
    if best + 1 == len(values):
        return model, values
    return boosted_trees(train, columns, label, seed, **parameters | {"maxIter": best + 1}), values


def score(model: PipelineModel, df: DataFrame, columns: list[str], name: str = "score") -> DataFrame:
    out = model.transform(df.na.fill(-1e9, columns))
    return out.withColumn(name, probability(out)).select(*df.columns, name)


def importances(model: PipelineModel, columns: list[str]) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(columns, map(float, values)), key=lambda x: (-x[1], x[0]))


@dataclass
class Calibrator:
    """Maps raw scores to probabilities: a logistic curve on the logit, or isotonic steps with clipped ends."""

    kind: str
    slope: float = 1.0
    intercept: float = 0.0
    bounds: tuple[float, ...] = ()
    values: tuple[float, ...] = ()

    def apply(self, raw: Column) -> Column:
        if self.kind == "sigmoid":
            p = F.least(F.greatest(raw, F.lit(1e-6)), F.lit(1 - 1e-6))
            return 1 / (1 + F.exp(-(F.lit(self.slope) * F.log(p / (1 - p)) + F.lit(self.intercept))))
        # Both tables are one literal each, and a row halves its way to the last bound that is not above it.
        bounds, values = (F.split(F.lit(",".join(map(repr, x))), ",").cast("array<double>") for x in (self.bounds, self.values))
        n = len(self.bounds)
        halves = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
        below = F.aggregate(halves, F.lit(0), lambda at, k: F.when((at + k <= n) & (F.get(bounds, at + k - 1) <= raw), at + k).otherwise(at))
        low, high = F.greatest(below - 1, F.lit(0)), F.least(below, F.lit(len(self.bounds) - 1))
        b0, b1, v0, v1 = F.get(bounds, low), F.get(bounds, high), F.get(values, low), F.get(values, high)
        inside = (below > 0) & (b1 > b0)
        return F.when(inside, v0 + (v1 - v0) * (raw - b0) / (b1 - b0)).otherwise(v0)


def fit_calibrators(df: DataFrame, raw: str = "raw", label: str = "label") -> tuple[Calibrator, dict[str, tuple[float, float]]]:
    """The better of both kinds by Brier score, then calibration error, then preferring the sigmoid; and both's figures."""
    require_both_classes(df, label)
    n = df.count()
    p = F.least(F.greatest(F.col(raw), F.lit(1e-6)), F.lit(1 - 1e-6))
    logits = VectorAssembler(inputCols=["z"], outputCol="features").transform(df.select(F.col(label).cast("double").alias("label"), F.log(p / (1 - p)).alias("z")))
    line = LogisticRegression(regParam=1 / (1e6 * n), standardization=False, maxIter=200, tol=1e-10).fit(logits)
    steps = IsotonicRegression(labelCol=label, featuresCol=raw).fit(df.select(F.col(label).cast("double").alias(label), F.col(raw).cast("double").alias(raw)))
    kinds = {
        "sigmoid": Calibrator("sigmoid", float(line.coefficients[0]), float(line.intercept)),
        "isotonic": Calibrator("isotonic", bounds=tuple(map(float, steps.boundaries)), values=tuple(map(float, steps.predictions))),
    }
    figures = {}
    for name, calibrator in kinds.items():
        held = df.select(F.lit("all").alias("g"), F.col(label).alias("label"), calibrator.apply(F.col(raw)).alias("score"))
        brier = held.agg(F.avg((F.col("score") - F.col("label")) ** 2)).first()[0]
        figures[name] = (brier, calibration_error(held, ["g"]).first()["ece"])
    best = min(kinds, key=lambda k: (*figures[k], k != "sigmoid"))
    return kinds[best], figures


def tune(rows: DataFrame, columns: list[str], trials: int, blocks: int = 5, seed: int = 42, label: str = "label") -> tuple[dict, list[tuple[dict, float]]]:
    """Seeded random search; a trial's value is the mean average precision over the expanding temporal folds."""
    rng, seen = np.random.default_rng(seed), []
    for _ in range(trials):
        chosen = {"maxDepth": int(rng.integers(2, 6)), "maxIter": int(rng.integers(5, 20)), "stepSize": float(rng.uniform(0.05, 0.3)), "subsamplingRate": float(rng.uniform(0.6, 1.0))}
        found = []
        for _, last, valid in expanding_folds(blocks):
            model = boosted_trees(rows.where(F.col("development_block") <= last), columns, label, seed, **chosen)
            scored = score(model, rows.where(F.col("development_block") == valid), columns)
            found.append(ranking(scored.withColumn("g", F.lit(1)), ["g"], label=label).first()["pr_auc"] or 0.0)
        seen.append((chosen, float(np.mean(found))))
    return max(seen, key=lambda x: x[1])[0], seen


def bootstrap_interval(scores: DataFrame, metric: str = "pr_auc", iterations: int = 500, level: float = 0.95, seed: int = 42) -> tuple[float, float] | None:
    """Bounds of a metric (`bootstrap.METRICS`) of (label, score) under stratified resampling, for any number of rows; None for a single class."""
    found = bootstrap.interval(scores, metric, iterations, level, seed)
    return None if found is None else found[1:]
