"""The model's life: features, a champion with its calibration and threshold, its storage, and the challenger's trial.

Features look at strictly earlier rows only, so one table of them serves every
period: a batch is scored with the history before it, whoever scores it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmon.operators import causal, challenger, explain, features, metrics, models, monitoring
from riskmon.sources import scratch

KIND = "riskmon.bundle"
NUMERIC = ["amount", "amount_log1p", "amount_fraction", "hour_sin", "hour_cos", "weekday_sin", "weekday_cos"]
PAST = [f"user_{name}" for name in causal.NAMES]
SHAPE = {"maxIter": 8, "maxDepth": 3, "stepSize": 0.2}


def engineer(rows: DataFrame, categorical: list[str], numeric: list[str] | tuple[str, ...] = (), keep: Callable[[DataFrame], DataFrame] = lambda table: table) -> DataFrame:
    """The rows with past-only and stateless features; the model's inputs are copies named in_<column>, so that all columns stay.

    `numeric` names further inputs; missing counts among them are taken over all columns but `features.EXCLUDED`.
    `keep` may store the rows with their past-only features, which alone need the history; the others follow from the row.
    """
    made = features.add_stateless(keep(causal.add_causal(rows, "user", ["user_id"])))
    if set(features.COUNTS) & set(numeric):
        made = features.add_missing_counts(made)
    return made.withColumns({f"in_{c}": F.col(c) for c in (*NUMERIC, *PAST, *numeric, *categorical)})


@dataclass
class Bundle:
    """What scoring needs: preprocessing, trees, calibrator and threshold."""

    model: PipelineModel
    preprocessor: features.Preprocessor
    calibrator: models.Calibrator
    threshold: float
    parameters: dict = field(default_factory=dict)

    @property
    def asked(self) -> tuple[list[str], list[str]]:
        """The (categorical, further numeric) columns that `engineer` must be given."""
        p, own = self.preprocessor, {f"in_{c}" for c in (*NUMERIC, *PAST)}
        return [c.removeprefix("in_") for c in p.categorical], [c.removeprefix("in_") for c in p.numeric if c not in own]

    @property
    def columns(self) -> list[str]:
        p = self.preprocessor
        return [*(f"{c}__frequency" for c in p.frequencies), *p.levels, *(c for c in p.numeric if c not in p.dropped)]

    def state(self) -> dict:
        p = self.preprocessor
        return {
            "kind": KIND, "threshold": self.threshold, "parameters": self.parameters, "calibrator": asdict(self.calibrator),
            "categorical": p.categorical, "numeric": p.numeric, "dropped": p.dropped, "levels": p.levels, "frequencies": sorted(p.frequencies),
        }

    @property
    def version(self) -> str:
        """From the state and the trees, so that equal models have equal versions."""
        trees = self.model.stages[-1].toDebugString.partition("\n")[2]
        return hashlib.sha256((json.dumps(self.state(), sort_keys=True) + trees).encode()).hexdigest()[:12]

    def inputs(self, made: DataFrame) -> DataFrame:
        """Engineered rows with all inputs as numbers; a level is its place among the fitted ones, an unseen one 0."""
        return self.numbers(self.preprocessor.transform(made))

    def numbers(self, held: DataFrame) -> DataFrame:
        """The same of rows that the preprocessor has transformed."""
        places = {c: F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(c)).cast("double") for c, levels in self.preprocessor.levels.items()}
        return held.withColumns(places | {c: F.col(c).cast("double") for c in self.columns if c not in places})

    def score(self, made: DataFrame) -> DataFrame:
        """Engineered rows with their calibrated score in place of any that they had."""
        kept = {c: f"kept_{c}" for c in (*self.preprocessor.categorical, *self.preprocessor.numeric)}
        held = made.drop("score").withColumns({k: F.col(c) for c, k in kept.items()})
        raw = models.score(self.model, self.inputs(held), self.columns, "raw")
        return raw.withColumn("score", self.calibrator.apply(F.col("raw"))).drop("raw", *self.columns).withColumnsRenamed({k: c for c, k in kept.items()})

    def save(self, path: str) -> None:
        """A new folder: the trees in Spark ML's form, the state as one JSON text, and the tables of frequencies."""
        spark = SparkSession.active()
        self.model.save(f"{path}/model")
        for c, table in self.preprocessor.frequencies.items():
            table.write.parquet(f"{path}/frequency/{c}")
        spark.createDataFrame([(json.dumps(self.state()), self.version)], "state string, version string").write.parquet(f"{path}/state")


def load(spark: SparkSession, path: str) -> Bundle:
    """A saved bundle; anything else, or one whose parts do not belong together, is refused."""
    kept = spark.read.parquet(f"{path}/state").first()
    state = json.loads(kept["state"])
    if state.get("kind") != KIND:
        raise TypeError(f"{path} holds no model bundle")
    curve = state["calibrator"] | {"bounds": tuple(state["calibrator"]["bounds"]), "values": tuple(state["calibrator"]["values"])}
    tables = {c: spark.read.parquet(f"{path}/frequency/{c}") for c in state["frequencies"]}
    known = features.Preprocessor(state["categorical"], state["numeric"], dropped=state["dropped"], levels=state["levels"], frequencies=tables)
    found = Bundle(PipelineModel.load(f"{path}/model"), known, models.Calibrator(**curve), state["threshold"], state["parameters"])
    if found.version != kept["version"]:
        raise ValueError(f"{path}: trees and state differ from those that were saved")
    return found


def train(training: DataFrame, calibration: DataFrame, categorical: list[str], rate: float = 0.02, limit: int = 500, numeric: list[str] | tuple[str, ...] = (), **parameters) -> Bundle:
    """A bundle from engineered rows: trees from `training`, calibrator and the threshold of a review rate from `calibration`."""
    parameters = SHAPE | parameters
    texts, numbers = [f"in_{c}" for c in categorical], [f"in_{c}" for c in (*NUMERIC, *PAST, *numeric)]
    # Counts per level and ranges instead of distinct values of every column, most of which are numbers that hardly repeat.
    known = features.fit_folds(training, {"training": F.lit(True)}, texts, numbers, 0.995, limit, keep=lambda table: scratch.stored(table, "levels"))["training"]
    found = Bundle(None, known, models.Calibrator("sigmoid"), 0.5, parameters)
    # Fitting and calibrating pass over their rows many times; what they read is stored, transformed.
    with scratch.held(known.transform(training).select("label", *found.columns), "training") as rows:
        found.model = models.boosted_trees(found.numbers(rows), found.columns, levels={c: len(v) + 1 for c, v in known.levels.items()}, **parameters)
    scored = models.score(found.model, found.inputs(calibration.drop("score")), found.columns, "raw").select("label", "raw")
    with scratch.held(scored, "calibration") as raw:
        found.calibrator, _ = models.fit_calibrators(raw)
        asked = metrics.review_thresholds(raw.select(found.calibrator.apply(F.col("raw")).alias("score")), [rate])
        found.threshold = float(asked.first()["threshold"])
    return found


def train_champion(made: DataFrame, categorical: list[str], **options) -> Bundle:
    """The first bundle: trees from the development period, the rest from the calibration period."""
    return train(made.where("dataset_period = 'development'"), made.where("dataset_period = 'calibration'"), categorical, **options)


def attributions(bundle: Bundle, made: DataFrame, keep: list[str]) -> DataFrame:
    """Shapley values of the trees' margin, (keep..., feature, phi), of all rows."""
    long = explain.attributions(bundle.inputs(made), bundle.model, bundle.columns, keep)
    return long.withColumn("feature", F.regexp_replace("feature", "^in_", ""))


def log_run(spark: SparkSession, path: str, bundle: Bundle, figures: dict[str, float]) -> None:
    """Adds one row to a Parquet table of training runs."""
    row = spark.createDataFrame([(bundle.version, json.dumps(bundle.parameters, sort_keys=True), json.dumps(figures, sort_keys=True))], "version string, parameters string, figures string")
    row.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


@dataclass
class Rivals:
    """A challenger beside the champion: the batches of every role, and the evaluation rows with both scores and decisions."""

    challenger: Bundle
    batches: dict[str, list[int]]
    training: DataFrame
    scores: DataFrame
    decisions: DataFrame
    segments: DataFrame


@dataclass
class Trial:
    """A challenger's outcome: one row of figures, and the segments' recalls."""

    challenger: Bundle
    summary: DataFrame
    segments: DataFrame
    recommended: bool
    last_batch: int


def train_challenger(made: DataFrame, champion: Bundle, categorical: list[str], capped: list[str], delay: int = 2, minimum_positive: int = 30, minimum_negative: int = 30) -> Rivals:
    """Train on matured history with the champion's parameters, calibrate on the batches after it, and score the last two mature batches with both."""
    batch = F.col("production_batch")
    roles = {}
    for r in challenger.windows(made.where(batch.isNotNull()).withColumnRenamed("production_batch", "batch"), delay).collect():
        roles.setdefault(r["role"], []).append(r["batch"])
    training = made.where(batch.isNull() | (batch < min(roles["calibration"])))
    new = train(training, made.where(batch.isin(roles["calibration"])), categorical, numeric=champion.asked[1], **champion.parameters)
    held = made.where(batch.isin(roles["evaluation"]))
    models.require_both_classes(held)
    first = champion.score(held).withColumnRenamed("score", "champion")
    both = new.score(first).withColumnRenamed("score", "challenger")
    scores = scratch.stored(both.select("label", *capped, "champion", "challenger"), "rivals")
    decisions = scores.withColumns({"champion": (F.col("champion") >= champion.threshold).cast("double"), "challenger": (F.col("challenger") >= new.threshold).cast("double")})
    long = monitoring.segments(decisions, monitoring.top_values(training, capped, 10), capped, [])
    segments = scratch.stored(challenger.segment_recall(long, minimum_positive, minimum_negative), "segments")
    return Rivals(new, roles, training, scores, decisions, segments)


def evaluate_challenger(made: DataFrame, champion: Bundle, categorical: list[str], capped: list[str], delay: int = 2, iterations: int = 500, minimum_positive: int = 30, minimum_negative: int = 30) -> Trial:
    """The challenger of `train_challenger`, compared and judged.

    It is recommended only if its average precision is surely better and its recall, at
    each model's own threshold, does not fall, neither over all rows nor in any segment
    with enough rows of both classes.
    """
    spark = made.sparkSession
    rivals = train_challenger(made, champion, categorical, capped, delay, minimum_positive, minimum_negative)
    new, roles, segments = rivals.challenger, rivals.batches, rivals.segments
    ranked = challenger.paired_average_precision(rivals.scores.select("label", "champion", "challenger"), iterations)
    recalled = challenger.paired_difference(rivals.decisions.select("label", "champion", "challenger"), challenger.recall, iterations)
    regressions = segments.where("reliable_regression").count()
    recommended = challenger.decide(ranked, recalled, regressions)
    row = (
        champion.version, new.version, min(roles["calibration"]), max(roles["calibration"]), min(roles["evaluation"]), max(roles["evaluation"]),
        rivals.training.count(), rivals.scores.count(), champion.threshold, new.threshold, *map(float, ranked), *map(float, recalled), regressions, recommended,
        "retrain_recommended" if recommended else "challenger_rejected",
    )
    schema = """champion_version string, challenger_version string, first_calibration int, last_calibration int, first_evaluation int, last_evaluation int,
        training_rows long, evaluation_rows long, champion_threshold double, challenger_threshold double, pr_auc_difference double, pr_auc_lower double,
        pr_auc_upper double, recall_difference double, recall_lower double, recall_upper double, regressed_segments long, retrain_recommended boolean, outcome string"""
    return Trial(new, spark.createDataFrame([row], schema), segments, recommended, max(roles["evaluation"]))


def record_trial(recommendations: DataFrame, trial: Trial, batch: str = "batch") -> DataFrame:
    """The recommendations with the trial's outcome at its last evaluation batch; an error if they lack that batch."""
    if not recommendations.where(F.col(batch) == trial.last_batch).limit(1).count():
        raise ValueError(f"no recommendation for batch {trial.last_batch}")
    here = F.col(batch) == trial.last_batch
    outcome = "retrain_recommended" if trial.recommended else "challenger_rejected"
    return recommendations.withColumns({
        "challenger_evaluated": here, "retrain_recommended": here & F.lit(trial.recommended), "challenger_outcome": F.when(here, F.lit(outcome)),
    })
