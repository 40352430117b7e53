"""Toxicity by weak supervision.

Lexicon voters (words and word beginnings) are mined from labelled documents and
joined by pattern voters over their hits and by the given labels. A generative
label model estimates by expectation-maximisation how often each voter fires in
either class and which voters depend on each other: a maximum spanning forest of
conditional mutual information gives each voter at most one other that its firing
rates depend on. The posterior labels train a linear classifier on the same votes,
which scores every document.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmon.llm.common import documents, materialize, prepared
from riskmon.llm.quality import fold, labelled_sample, training_labels

# At most so many labelled rows fit the model.
SAMPLE_ROWS = 20_000
PREFIXES = (4, 5, 6)
STRIP = ".,;:!?*&%$#|<>\"'()[]{}"
PATTERNS = ("several", "dense", "none")


def forms(text: str | None) -> set[str]:
    """Lower-case words of a text, marked 'w', and their beginnings, marked by length."""
    out = set()
    for word in set((text or "").lower().split()):
        word = word.strip(STRIP)
        if word:
            out.add("w" + word)
            out.update(f"{n}{word[:n]}" for n in PREFIXES if len(word) > n)
    return out


def count_forms(rows: DataFrame, only: set[str] | None = None) -> DataFrame:
    """Number of rows per form, counted inside each task first."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter = Counter()
            for text in pdf["text"]:
                got = forms(text)
                seen.update(got & only if only is not None else got)
            if seen:
                yield pd.DataFrame({"form": list(seen), "n": np.fromiter(seen.values(), "int64", len(seen))})

    return rows.select("text").mapInPandas(counted, "form string, n long").groupBy("form").agg(F.sum("n").alias("n"))


def mine(train: DataFrame, toxic: int, clean: int) -> list[str]:
    """Forms far more frequent in toxic rows, the most telling one of each family of related forms."""
    least = max(3, math.ceil(0.02 * toxic))
    hits = {r["form"]: r["n"] for r in count_forms(train.where("label = 1")).where(F.col("n") >= least).collect()}
    against = {r["form"]: r["n"] for r in count_forms(train.where("label = 0"), set(hits)).collect()}
    rated = []
    for form, n in hits.items():
        odds = math.log((n + 0.5) / (toxic + 1) / ((against.get(form, 0) + 0.5) / (clean + 1)))
        if odds > 2.5:
            rated.append((odds * math.log1p(n), -len(form), form))
    kept: list[str] = []
    for _, _, form in sorted(rated, key=lambda x: (-x[0], x[1], x[2])):
        body = form[1:]
        if not any(body.startswith(k[1:]) or k[1:].startswith(body) for k in kept):
            kept.append(form)
    return kept


class Votes:
    """The voters of a lexicon: indices that fire in a text, patterns after the lexicon's own."""

    def __init__(self, lexicon: list[str]):
        self.place = {form: i for i, form in enumerate(lexicon)}
        self.size = len(lexicon) + len(PATTERNS)

    def of(self, text: str | None) -> list[int]:
        counts = Counter((text or "").lower().split())
        place, fired, hits = self.place, set(), 0
        for raw, n in counts.items():
            word = raw.strip(STRIP)
            got = {place.get("w" + word)} | {place.get(f"{k}{word[:k]}") for k in PREFIXES if len(word) > k}
            got.discard(None)
            if got:
                fired |= got
                hits += n
        first = len(place)
        total = sum(counts.values())
        if len(fired) >= 2:
            fired.add(first)
        if hits and 100 * hits >= total:
            fired.add(first + 1)
        if not hits:
            fired.add(first + 2)
        return sorted(fired)


def dependencies(votes: np.ndarray, posterior: np.ndarray, doubt: float = 15.0) -> np.ndarray:
    """For each voter the one it depends on, or -1: a maximum spanning forest of conditional mutual information.

    An edge counts if twice its information times the rows, which follows a
    chi-square law of two degrees where there is none, exceeds `doubt`.
    """
    n, m = votes.shape
    gain = np.zeros((m, m))
    for weight in (1 - posterior, posterior):
        mass = weight.sum() + 1.0
        on = (weight @ votes + 0.5) / mass
        both = ((votes * weight[:, None]).T @ votes + 0.25) / mass
        for joint, x, y in (
            (both, on[:, None], on[None, :]), (on[:, None] - both, on[:, None], 1 - on[None, :]),
            (on[None, :] - both, 1 - on[:, None], on[None, :]), (1 - on[:, None] - on[None, :] + both, 1 - on[:, None], 1 - on[None, :]),
        ):
            joint = np.maximum(joint, 1e-9)
            gain += mass / n * joint * np.log(joint / np.maximum(x * y, 1e-9))
    gain[2 * n * gain < doubt] = 0
    np.fill_diagonal(gain, 0)
    parent, best, near = np.full(m, -1), np.zeros(m), np.full(m, -1)
    inside = np.zeros(m, bool)
    for _ in range(m):
        # Prim's algorithm; where no edge leads on, a new tree starts.
        at = int(np.argmax(np.where(inside, -1.0, best)))
        parent[at], inside[at] = near[at], True
        closer = ~inside & (gain[at] > best)
        best[closer], near[closer] = gain[at][closer], at
    return parent


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 30, dependent: bool = True) -> np.ndarray:
    """Posterior P(toxic) of each row from its 0/1 votes and its noisy label, which is one more voter and the start.

    A voter's rates in either class are those given the vote of the voter that it
    depends on; the forest of dependencies is estimated at the start and twice along the way.
    The label stays out of the forest: hanging on a voter it would count as an echo of that voter.
    """
    everyone = np.column_stack([votes, labels]).astype(np.float64)
    posterior = np.where(labels > 0, 0.95, 0.05)
    parent = np.full(everyone.shape[1], -1)
    for turn in range(rounds):
        if dependent and turn in (0, rounds // 3, 2 * rounds // 3):
            parent[:-1] = dependencies(everyone[:, :-1], posterior)
        above = np.where(parent[None, :] >= 0, everyone[:, parent], 0.0)
        mass = np.array([(1 - posterior).sum(), posterior.sum()]) + 1.0
        score = np.full(len(everyone), math.log(mass[1] / mass[0]))
        for value in (above, 1 - above):
            rate = []
            for weight in (1 - posterior, posterior):
                whole, fires = weight @ value, weight @ (value * everyone)
                rate.append((fires + 0.5) / (whole + 1.0))
            on, off = np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0]))
            score += (value * everyone) @ on + (value * (1 - everyone)) @ off
        posterior = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return posterior


def linear_classifier(votes: np.ndarray, posterior: np.ndarray, steps: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights, the intercept last, by Newton steps on posterior labels."""
    x = np.column_stack([votes, np.ones(len(votes))]).astype(np.float64)
    weights = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - posterior) + penalty * weights
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int) -> tuple[list[str], np.ndarray]:
    train = materialize(labelled_sample(docs, labels, sample_rows).select("text", "label"), "toxic-train")
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    lexicon = mine(train, toxic, clean) if toxic and clean else []
    votes = Votes(lexicon)
    if not toxic or not clean:
        weights = np.zeros(votes.size + 1)
        weights[-1] = math.log((toxic + 0.5) / (clean + 0.5))
        return lexicon, weights

    def voted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"fired": [votes.of(t) for t in pdf["text"]], "label": pdf["label"]})

    rows = train.mapInPandas(voted, "fired array<int>, label int").collect()
    matrix, label = np.zeros((len(rows), votes.size), np.float32), np.array([r["label"] for r in rows], np.float64)
    for i, r in enumerate(rows):
        matrix[i, r["fired"]] = 1
    return lexicon, linear_classifier(matrix, label_model(matrix, label))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: doc_id and `score`, the estimate that its toxic label is 1.

    `labels` holds doc_id and label, and only rows that may be learned from. A
    null or empty text has no hits and is scored by that, and a text of any length by
    all of its words; a row's score depends on no other row, so ties need no rule and
    repeated rows get equal scores; other columns play no part; an empty table gives
    no row; without labels of both classes the score is the smoothed share.
    """
    prepared(docs.sparkSession)
    lexicon, weights = fit(docs, labels, sample_rows)
    votes = Votes(lexicon)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.array([weights[-1] + sum(weights[i] for i in votes.of(t)) for t in batch.column(1).to_pylist()], np.float64)
            score = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, "doc_id long, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(documents(spark, sf_dir), training_labels(spark, sf_dir, "toxic", 5, 0))
    return scored.select(
        "doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
