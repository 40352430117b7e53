"""Adaptive tuning: a tree-structured Parzen sampler over the parameters of boosted trees, scored on temporal folds."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmon.operators import features, models
from riskmon.operators.metrics import ranking
from riskmon.operators.temporal import expanding_folds


@dataclass(frozen=True)
class Range:
    """A parameter between two bounds, on a logarithmic scale or in whole numbers if asked for."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def ends(self) -> tuple[float, float]:
        return (math.log(self.low), math.log(self.high)) if self.log else (self.low, self.high)

    def value(self, x: float) -> float | int:
        x = min(max(math.exp(x) if self.log else x, self.low), self.high)
        return int(round(x)) if self.whole else float(x)

    def place(self, value: float) -> float:
        return math.log(value) if self.log else float(value)


# The nine parameters of a trial.
SPACE = {
    "maxDepth": Range(2, 6, whole=True), "maxIter": Range(5, 40, log=True, whole=True), "stepSize": Range(0.02, 0.4, log=True), "subsamplingRate": Range(0.5, 1.0),
    "minInstancesPerNode": Range(1, 50, log=True, whole=True), "minInfoGain": Range(1e-6, 1e-2, log=True), "minWeightFractionPerNode": Range(0.0, 0.05),
    "maxBins": Range(16, 64, whole=True), "feature_share": Range(0.4, 1.0),
}


def kernels(values: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres and widths of a mixture: one normal per value, narrower the more there are, and a wide one over the whole range."""
    width = np.full(len(values) + 1, max(0.5 * (high - low) / math.sqrt(len(values)), (high - low) / 100))
    width[-1] = high - low
    return np.append(values, (low + high) / 2), width


def density(x: np.ndarray, centres: np.ndarray, width: np.ndarray, low: float, high: float) -> np.ndarray:
    """Of the mixture, each normal cut off at the ends of the range."""
    inside = np.array([0.5 * (math.erf((high - c) / (w * math.sqrt(2))) - math.erf((low - c) / (w * math.sqrt(2)))) for c, w in zip(centres, width)])
    z = (x[:, None] - centres) / width
    return (np.exp(-0.5 * z * z) / (width * inside)).mean(axis=1)


def propose(seen: list[tuple[dict, float]], space: dict[str, Range], rng: np.random.Generator, startup: int = 6, candidates: int = 24, best_share: float = 0.12) -> dict:
    """The next trial: at random at first, then for each parameter the candidate likeliest among good trials against the others."""
    if len(seen) < startup:
        return {k: r.value(rng.uniform(*r.ends())) for k, r in space.items()}
    ranked = sorted(seen, key=lambda s: -s[1])
    cut = max(2, math.ceil(best_share * len(ranked)))
    out = {}
    for name, one in space.items():
        low, high = one.ends()
        good, rest = (kernels(np.array([one.place(p[name]) for p, _ in part]), low, high) for part in (ranked[:cut], ranked[cut:]))
        of = rng.integers(0, len(good[0]), candidates)
        x = rng.normal(good[0][of], good[1][of])
        x = np.where((x < low) | (x > high), rng.uniform(low, high, candidates), x)
        out[name] = one.value(float(x[np.argmax(density(x, *good, low, high) / density(x, *rest, low, high))]))
    return out


def search(objective: Callable[[dict], float], trials: int, space: dict[str, Range] | None = None, seed: int = 42, parallel: int = 1, startup: int = 6) -> tuple[dict, list[tuple[dict, float]]]:
    """(best parameters, all trials with their values): the largest value of the objective, the same for the same seed.

    With `parallel` above 1 so many trials are proposed from the same results and run at once.
    """
    space, rng, seen = space or SPACE, np.random.default_rng(seed), []
    while len(seen) < trials:
        chosen = [propose(seen, space, rng, startup) for _ in range(min(parallel, trials - len(seen)))]
        with ThreadPoolExecutor(len(chosen)) as pool:
            seen += list(zip(chosen, pool.map(objective, chosen)))
    return max(seen, key=lambda s: s[1])[0], seen


def tree_parameters(trial: dict) -> dict:
    """A trial's values under the names that the trees know."""
    return {k: v for k, v in trial.items() if k != "feature_share"} | {"featureSubsetStrategy": str(trial.get("feature_share", 1.0))}


def fold_objective(rows: DataFrame, categorical: list[str], numeric: list[str], blocks: int = 5, seed: int = 42, keep=lambda table: table, limit: int = 1000) -> Callable[[dict], float]:
    """Mean average precision over the expanding temporal folds, each with preprocessing of its own training rows."""
    block: Column = F.col("development_block")
    folds = {name: block <= last for name, last, _ in expanding_folds(blocks)}
    fitted = features.fit_folds(rows, folds, categorical, numeric, 0.995, limit, keep)
    ready = []
    for name, last, valid in expanding_folds(blocks):
        known = fitted[name]
        columns = [*(f"{c}__frequency" for c in known.frequencies), *known.levels, *(c for c in known.numeric if c not in known.dropped)]
        places = {c: F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(c)).cast("double") for c, levels in known.levels.items()}
        held = known.transform(rows.where(block <= valid)).withColumns(places)
        ready.append((keep(held), columns, {c: len(levels) + 1 for c, levels in known.levels.items()}, last, valid))

    def objective(parameters: dict) -> float:
        given, found = tree_parameters(parameters), []
        for held, columns, levels, last, valid in ready:
            model = models.boosted_trees(held.where(block <= last), columns, "label", seed, levels=levels, **given)
            scored = models.score(model, held.where(block == valid), columns)
            found.append(ranking(scored, []).first()["pr_auc"] or 0.0)
        return float(np.mean(found))

    return objective
