"""Incremental substring dedup over a log-structured fingerprint index.

Documents arrive in batches by rising id. The index is a list of immutable runs,
each sorted by anchor hash, that hold where a window context first occurred. A
new batch is merge-joined with every run. A context that is known as a whole
marks all its windows; contexts that share only an anchor are verified window by
window on the texts, and what is found in a context's first place holds in all
its places of that id. The batch then becomes a run itself; once there are more
than `fan_in` runs, the next batch first compacts them into one. Runs may be kept
in a folder, from where a later job goes on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmon.llm.anchors import cover, prefix_sums, runs, span_hashes
from riskmon.llm.common import LAST, discard, documents, join_counted, keyed, materialize, prepared
from riskmon.llm.words import hash_words

LENGTH, GRAM, BATCHES, FAN_IN = 50, 12, 4, 2
RUN = "doc long, th long, anchor long, context long, lo long, hi long"


def fingerprints(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchor runs of the words of each text."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                words, bounds = hash_words([t.encode() for t in part.column(2).to_pylist()])
                doc, th = part.column(0).to_numpy(), part.column(1).to_numpy()
                for own, anchor, context, lo, hi in runs(words, bounds, length, gram):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (doc[own], th[own], anchor.view(np.int64), context.view(np.int64), lo, hi)],
                        names=["doc", "th", "anchor", "context", "lo", "hi"],
                    )

    return rows.mapInArrow(found, RUN)


def verified(places: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """Hashes of all windows of the places (doc, th, anchor, lo, hi), from the texts; `at` is lo x length + offset."""
    wanted = places.groupBy("doc", "th").agg(F.collect_list(F.struct("anchor", "lo", "hi")).alias("p"))
    joined = wanted.join(rows, ["doc", "th"]).select("doc", "th", "text", "p.anchor", "p.lo", "p.hi")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, _ = hash_words([row["text"].encode()])
                sums = prefix_sums(words)
                lo, hi = np.array(row["lo"]), np.array(row["hi"])
                each = hi - lo + 1
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(each)[:-1])), each) + np.arange(each.sum())
                got = span_hashes(sums, at, at + length).view(np.int64)
                anchor = np.repeat(np.array(row["anchor"], np.int64), each)
                place = np.repeat(lo, each) * (length - 1) + at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), row[k], np.int64)) for k in ("doc", "th")] + [pa.array(x) for x in (anchor, got, place)],
                    names=["doc", "th", "anchor", "window", "at"],
                )

    return joined.mapInArrow(windows, "doc long, th long, anchor long, window long, at long")


class FingerprintIndex:
    """Sorted runs of (anchor, context) with the first place (doc, th, lo, hi) and the number n of places of each."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM, fan_in: int = FAN_IN, folder: str | None = None):
        self.length, self.gram, self.fan_in, self.folder = length, gram, fan_in, folder
        self.runs: list[DataFrame] = []

    @classmethod
    def open(cls, spark: SparkSession, folder: str, **parameters: int) -> FingerprintIndex:
        """The index that earlier jobs left in a folder; its parameters must be the same."""
        index = cls(folder=folder, **parameters)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in files.listStatus(path) if files.exists(path) else []:
            run = found.getPath().toString()
            # A run without the mark of a finished write is left out.
            if files.exists(spark._jvm.org.apache.hadoop.fs.Path(run + "/_SUCCESS")):
                index.runs.append(spark.read.parquet(run))
                index.runs[-1]._scratch_path = run
        return index

    def sorted_run(self, rows: DataFrame) -> DataFrame:
        """Rows (anchor, context, first, n) as one run, each key once."""
        once = rows.groupBy("anchor", "context").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
        return materialize(once.sortWithinPartitions("anchor"), "run", self.folder)

    def compact(self) -> None:
        """One run in place of all; the others go once it is stored."""
        merged = self.sorted_run(reduce(DataFrame.unionByName, self.runs))
        old, self.runs = self.runs, [merged]
        for run in old:
            discard(run)

    def known(self, new: DataFrame) -> DataFrame:
        """All contexts that share an anchor with the new run: first place, and n of the new run alone."""
        anchors = new.select("anchor").distinct()
        old = [run.join(anchors, "anchor", "left_semi").withColumn("n", F.lit(0).cast("long")) for run in self.runs]
        every = reduce(DataFrame.unionByName, old, new)
        return every.groupBy("anchor", "context").agg(F.min("first").alias("first"), F.sum("n").alias("n")) if old else new

    def add(self, batch: DataFrame, history: DataFrame) -> DataFrame:
        """Index a batch of `keyed` rows; returns its repeated windows as (doc, th, lo, hi).

        `history` holds the rows of this batch and of all earlier ones. A window
        is repeated if its words also start in a row of a smaller id.
        """
        if len(self.runs) > self.fan_in:
            self.compact()
        got = materialize(fingerprints(batch, self.length, self.gram), "batch")
        place = F.struct("doc", "th", "lo", "hi").alias("first")
        new = self.sorted_run(got.select("anchor", "context", place, F.lit(1).cast("long").alias("n")))
        first = materialize(self.known(new), "first")
        self.runs.append(new)
        other = F.expr("doc > first.doc or th <> first.th or lo <> first.lo")
        places = join_counted(got, first.where("n > 0"), ["anchor", "context"]).where(other)
        again = materialize(places.select("doc", "th", "lo", "hi", F.expr("if(doc = first.doc, first, null)").alias("same")), "again")
        discard(got)
        kinds = first.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("first.doc").alias("a"), F.max("first.doc").alias("b"))
        shared = materialize(kinds.where("n > 1 and a < b").select("anchor", "n"), "shared")
        places = join_counted(first.drop("n"), shared, ["anchor"]).select("first.doc", "first.th", "anchor", "first.lo", "first.hi")
        windows = materialize(verified(places, history, self.length), "windows")
        twice = windows.groupBy("anchor", "window").agg(F.min("doc").alias("earliest"), F.max("doc").alias("latest"), F.count(F.lit(1)).alias("n"))
        twice = materialize(twice.where("latest > earliest").drop("latest"), "twice")
        found = join_counted(windows, twice, ["anchor", "window"]).where("doc > earliest")
        single = materialize(found.selectExpr("doc", "th", f"at div {self.length} as lo", f"at % {self.length} as offset"), "single")
        for done in (first, shared, windows, twice):
            discard(done)
        # What is repeated in a context's first place is so in all its places of that id.
        offsets = single.groupBy("doc", F.col("th").alias("first_th"), F.col("lo").alias("first_lo")).agg(F.collect_set("offset").alias("offsets"))
        within = again.where("same is not null").select("doc", "th", "lo", F.col("same.th").alias("first_th"), F.col("same.lo").alias("first_lo"))
        copied = within.join(offsets, ["doc", "first_th", "first_lo"]).select("doc", "th", "lo", F.explode("offsets").alias("offset"))
        each = single.unionByName(copied).select("doc", "th", (F.col("lo") + F.col("offset")).alias("lo")).withColumn("hi", F.col("lo"))
        marked = materialize(again.where("same is null").select("doc", "th", "lo", "hi").unionByName(each), "marked")
        discard(again)
        discard(single)
        return marked


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and kept_text.

    A word goes if a window of `length` words over it also starts in a document
    of a smaller id; windows are judged on the input. Null, empty and short texts
    keep all their words, and texts of any length are read whole; rows that share an
    id, and so tie, never remove each other's words; rows without an id come after
    all others, with the largest id; other columns play no part; an empty table
    gives no row.
    """
    prepared(docs.sparkSession)
    rows, _ = keyed(docs)
    cuts = rows.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    index = FingerprintIndex(length, gram)
    marked, below = [], None
    for cut in [*sorted(set(cuts)), LAST]:
        batch = rows.where(F.col("doc") <= cut)
        marked.append(index.add(batch if below is None else batch.where(F.col("doc") > below), batch))
        below = cut
    for run in index.runs:
        discard(run)
    removed = reduce(DataFrame.unionByName, marked).groupBy("doc", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("w"))
    joined = rows.join(removed, ["doc", "th"], "left").select("doc_id", "text", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, sizes, gone, digests, texts = [], [], [], [], []
                for row in batch.slice(at, 512).to_pylist():
                    words = row["text"].encode().split()
                    n = len(words)
                    if row["lo"]:
                        out = cover(n, list(zip(row["lo"], row["hi"])), length)
                        words = [w for w, o in zip(words, out.tolist()) if not o]
                    text = b" ".join(words)
                    ids.append(row["doc_id"])
                    sizes.append(n)
                    gone.append(n - len(words))
                    digests.append(hashlib.sha256(text).hexdigest())
                    texts.append(text.decode())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    return joined.mapInArrow(kept, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 48, 1)), lambda i: md5(array_to_string(w[i:i+49], ' ')))) AS h,
             unnest(range(1, greatest(len(w) - 48, 1))) AS pos FROM d),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY h) AS f FROM g) WHERE doc_id > f),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d WHERE len(w) > 0),
k AS (SELECT u.doc_id, u.word, u.pos, r.pos AS last FROM u ASOF LEFT JOIN r ON u.doc_id = r.doc_id AND u.pos >= r.pos),
s AS (SELECT doc_id, count(*) FILTER (WHERE last IS NOT NULL AND pos < last + 50) AS n_removed,
             string_agg(word, ' ' ORDER BY pos) FILTER (WHERE last IS NULL OR pos >= last + 50) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(s.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON s.doc_id = d.doc_id
"""
