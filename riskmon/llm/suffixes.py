"""Exact substring dedup on bytes by merging Burrows-Wheeler transforms.

Only text around recurring anchors can hold a repeated string, so first the
contexts of such anchors are gathered, equal ones once. Contexts that share
anchors are dealt into buckets; a bucket's contexts are split into shards, each
shard's suffixes are sorted once, and its Burrows-Wheeler transform is kept. The
transforms are merged by refining their interleave two symbols a round: after k
rounds it is sorted by the first 2k bytes, and neighbours that a round tells
apart have fewer in common. Entries that stand alone leave. The intervals left
at `length` bytes are the repeated strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmon.llm.anchors import cover, prefix_sums, runs, span_hashes
from riskmon.llm.common import discard, documents, join_counted, keyed, materialize, prepared
from riskmon.llm.words import BYTE_CODE

LENGTH, GRAM = 100, 32
SHARD_BYTES, BUCKET_BYTES = 1 << 17, 1 << 21
# An anchor with more different contexts is resolved window by window instead.
MOST_CONTEXTS = 16_000
# A run's place as one number: first window, extra windows (under 128).
PLACE = "doc long, th long, anchor long, context long, place long"


def fingerprints(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [t.encode() for t in part.column(2).to_pylist()]
                bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
                data = np.frombuffer(b"".join(texts), np.uint8)
                doc, th = part.column(0).to_numpy(), part.column(1).to_numpy()
                for own, anchor, context, lo, hi in coded_runs(data, bounds, length, gram):
                    place = (lo << 7) | (hi - lo)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (doc[own], th[own], anchor.view(np.int64), context.view(np.int64), place)],
                        names=["doc", "th", "anchor", "context", "place"],
                    )

    return rows.mapInArrow(found, PLACE)


def coded_runs(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """`runs` over bytes, coding no more than about 4 MB of them at once; a run holds 128 windows at most by the choice of length."""
    i, count, most = 0, len(bounds) - 1, 1 << 22
    while i < count:
        j = i + 1
        while j < count and bounds[j + 1] - bounds[i] <= most:
            j += 1
        for at in range(int(bounds[i]), max(int(bounds[j]), int(bounds[i]) + 1), most):
            end = min(at + most + length - 1, int(bounds[j]))
            inner = bounds[i : j + 1] - at if j > i + 1 or end == bounds[j] and at == bounds[i] else np.array([0, end - at])
            for own, anchor, context, lo, hi in runs(BYTE_CODE[data[at:end]], inner, length, gram):
                shift = at - int(bounds[i]) if j == i + 1 else 0
                yield own + i, anchor, context, lo + shift, hi + shift
        i = j


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of a text's suffixes in order, by doubling over those that are still tied.

    `text` holds byte + 1 and a 0 after each context; a 0 ends a suffix, and equal
    suffixes keep the order of their contexts.
    """
    n = len(text)
    places = np.arange(n)
    zeros = np.flatnonzero(text == 0)
    left = zeros[np.searchsorted(zeros, places)] - places
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key[: n - k] |= np.where(left[: n - k] > k, text[k:], 0).astype(np.uint64) << np.uint64(56 - 8 * k)
    order = np.argsort(key)
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank = np.empty(n, np.int64)
    tied, step = places, 8
    while True:
        # A rank is the first place of its group of ties, so settled ranks stay as they are.
        group = np.maximum.accumulate(np.where(new, tied, 0))
        rank[order[tied]] = group
        tied = tied[~(new & np.concatenate((new[1:], [True])))]
        if not len(tied):
            return order
        at = order[tied]
        key = rank[at] * np.int64(n) + np.where(left[at] < step, at, rank[np.minimum(at + step, n - 1)])
        dealt = np.argsort(key)
        order[tied] = at[dealt]
        key = key[dealt]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        step *= 2


def transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order, Burrows-Wheeler symbols and last-to-first mapping of a shard."""
    order = suffix_order(text)
    symbols = text[order - 1]
    back = np.empty(len(text), np.int64)
    back[np.argsort(symbols, kind="stable")] = np.arange(len(text))
    return order, symbols, back


def merge(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries (numbered through all shards) in repeated intervals of `length` symbols, and their interval's number.

    Entries start in shard order; a round replaces each by the entry two places
    before it in the text and deals them stably by these two symbols, which
    interleaves the shards two symbols deeper. Entries that meet the end of a
    context or stand alone leave.
    """
    first = np.cumsum([0] + [len(s[1]) for s in shards[:-1]])
    symbols = np.concatenate([s[1] for s in shards])
    back = np.concatenate([s[2] + at for s, at in zip(shards, first)]).astype(np.int32)
    before = symbols[back]
    pairs = np.where((symbols == 0) | (before == 0), 0, before.astype(np.uint16) << 8 | symbols).astype(np.uint16)
    twice = back[back]
    entries, block = np.arange(len(symbols), dtype=np.int32), np.zeros(len(symbols), np.int32)
    steps = [(pairs, twice)] * (length // 2) + [(symbols.astype(np.uint16), back)] * (length % 2)
    for codes, previous in steps:
        code = codes[entries]
        inside = code != 0
        code, block, entries = code[inside], block[inside], previous[entries[inside]]
        dealt = np.argsort(code, kind="stable")
        code, block, entries = code[dealt], block[dealt], entries[dealt]
        apart = np.ones(len(code) + 1, bool)
        np.not_equal(code[1:], code[:-1], out=apart[1:-1])
        apart[1:-1] |= block[1:] != block[:-1]
        shared = ~(apart[:-1] & apart[1:])
        block = np.cumsum(apart[:-1], dtype=np.int32)[shared]
        entries = entries[shared]
        if not len(entries):
            break
    return entries, block


def repeated_windows(contexts: list[bytes], length: int, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset, interval) of all windows that occur twice or more in the contexts."""
    shards, starts, owners, at = [], [], [], 0
    while at < len(contexts):
        end, size = at, 0
        while end < len(contexts) and (end == at or size + len(contexts[end]) < shard_bytes):
            size += len(contexts[end]) + 1
            end += 1
        sizes = np.array([len(c) + 1 for c in contexts[at:end]])
        last = np.cumsum(sizes) - 1
        text = np.zeros(last[-1] + 1, np.uint8)
        inside = np.ones(len(text), bool)
        inside[last] = False
        text[inside] = np.frombuffer(b"".join(contexts[at:end]), np.uint8) + np.uint8(1)  # UTF-8 has no byte 255
        shards.append(transform(text))
        starts.append(np.repeat(last - sizes + 1, sizes))
        owners.append(np.repeat(np.arange(at, end), sizes))
        at = end
    entries, block = merge(shards, length)
    base = np.cumsum([0] + [len(s[0]) for s in shards[:-1]])
    shard = np.searchsorted(base, entries, side="right") - 1
    place = np.concatenate([s[0] for s in shards])[entries]
    at = base[shard] + place
    return np.concatenate(owners)[at], place - np.concatenate(starts)[at], block


WINDOW = "doc long, th long, lo long, hi long"


def merged_windows(contexts: DataFrame, buckets: int, length: int) -> DataFrame:
    """Windows of the contexts (doc, th, lo, anchor, bytes) that repeat an earlier one of their bucket."""

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        own, offset, block = repeated_windows(pdf["bytes"].tolist(), length)
        out = pd.DataFrame({"doc": pdf["doc"].to_numpy()[own], "th": pdf["th"].to_numpy()[own], "lo": pdf["lo"].to_numpy()[own] + offset, "block": block})
        out = out.sort_values(["block", "doc", "lo"], kind="stable")
        first = out.groupby("block")[["doc", "lo"]].transform("first")
        out = out[(out["doc"] > first["doc"]) | (out["lo"] > first["lo"])]
        return out.assign(hi=out["lo"])[["doc", "th", "lo", "hi"]]

    dealt = contexts.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandas(merged, WINDOW)


def cut_out(places: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """The bytes of places (doc, th, anchor, lo, hi), and `many` as given."""
    wanted = places.groupBy("doc", "th").agg(F.collect_list(F.struct("anchor", "lo", "hi", "many")).alias("p"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text, p = row["text"].encode(), row["p"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["doc"]] * len(p), pa.int64()), pa.array([row["th"]] * len(p), pa.int64()),
                        pa.array([x["anchor"] for x in p], pa.int64()), pa.array([x["lo"] for x in p], pa.int64()),
                        pa.array([x["many"] for x in p], pa.bool_()), pa.array([text[x["lo"] : x["hi"] + length] for x in p], pa.binary()),
                    ],
                    names=["doc", "th", "anchor", "lo", "many", "bytes"],
                )

    return wanted.join(rows, ["doc", "th"]).select("doc", "th", "text", "p").mapInArrow(
        cut, "doc long, th long, anchor long, lo long, many boolean, bytes binary"
    )


def single_windows(contexts: DataFrame, length: int) -> DataFrame:
    """The same result for contexts of very frequent anchors, by grouping equal windows with partial sums."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(row["bytes"], np.uint8)
                at = np.arange(len(data) - length + 1)
                got = span_hashes(prefix_sums(BYTE_CODE[data]), at, at + length).view(np.int64)
                columns = [np.full(len(at), row[k], np.int64) for k in ("doc", "th", "anchor")]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, got, at + row["lo"])], names=["doc", "th", "anchor", "window", "lo"])

    windows = materialize(contexts.mapInArrow(split, "doc long, th long, anchor long, window long, lo long"), "windows")
    first = windows.groupBy("anchor", "window").agg(F.min(F.struct("doc", "lo")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    placed = join_counted(windows, materialize(first, "first-windows"), ["anchor", "window"])
    return placed.where("struct(doc, lo) > first").select("doc", "th", "lo", F.col("lo").alias("hi"))


def repeated(rows: DataFrame, length: int, gram: int, shared_ids: bool) -> list[DataFrame]:
    """Ranges of windows (doc, th, lo, hi) whose bytes also start earlier."""
    stored = materialize(fingerprints(rows, length, gram), "prints")
    recurring = materialize(stored.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "anchors")
    held = materialize(join_counted(stored, recurring, ["anchor"]).drop("n"), "recurring")
    discard(stored)
    discard(recurring)
    first = held.groupBy("anchor", "context").agg(F.min(F.struct("doc", "place", "th")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = materialize(first, "first")
    lo = F.shiftright("place", 7)
    ranged = ["th", lo.alias("lo"), (lo + F.col("place").bitwiseAND(F.lit(127))).alias("hi")]
    placed = join_counted(held, first, ["anchor", "context"])
    whole = placed.where("struct(doc, place) > struct(first.doc, first.place)").select("doc", *ranged)
    kinds = materialize(first.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "kinds")
    places = join_counted(first.select("anchor", "first.*"), kinds, ["anchor"]).select("doc", "anchor", (F.col("n") > MOST_CONTEXTS).alias("many"), *ranged)
    contexts = materialize(cut_out(places, rows, length), "contexts")
    size = contexts.agg(F.coalesce(F.sum(F.when(~F.col("many"), F.length("bytes") + 1)), F.lit(0))).first()[0]
    few = contexts.where("not many")
    found = [merged_windows(few, max(1, -(-size // BUCKET_BYTES)), length)]
    if size < contexts.agg(F.coalesce(F.sum(F.length("bytes") + 1), F.lit(0))).first()[0]:
        found.append(single_windows(contexts.where("many"), length))
    if not shared_ids:
        return [whole, *found]
    # Other texts of the id may hold a context at its first place too; what was found there holds in them.
    stored = materialize(reduce(DataFrame.unionByName, found), "found")
    twins = placed.where("doc = first.doc and place = first.place and th <> first.th").select("doc", F.col("first.th").alias("first_th"), *ranged)
    twins = twins.select("doc", "th", "first_th", F.explode(F.sequence("lo", "hi")).alias("lo"))
    copied = twins.join(stored.withColumnRenamed("th", "first_th"), ["doc", "first_th", "lo"]).select("doc", "th", "lo", "hi")
    return [whole, stored, copied]


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of `length` bytes over it also starts earlier, in a
    smaller doc_id or before in the same document; strings are judged on the
    input and never cross documents. A null text is empty; texts of any length are
    handled whole, in pieces that overlap; of rows with one id a string that starts
    at an equal place in two of them repeats in neither; rows without an id come
    after all others, with the largest id; other columns play no part; an empty
    table gives no row.
    """
    if not gram < length <= gram + 128:
        raise ValueError("length must exceed gram by 1 to 128")
    prepared(docs.sparkSession)
    rows, shared_ids = keyed(docs)
    gone = reduce(DataFrame.unionByName, repeated(rows, length, gram, shared_ids))
    gone = gone.groupBy("doc", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("w"))
    joined = rows.join(gone, ["doc", "th"], "left").select("doc_id", "text", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                out: list[tuple] = []
                for row in batch.slice(at, 128).to_pylist():
                    text = row["text"].encode()
                    removed = spans = 0
                    n = len(text)
                    if row["lo"]:
                        mask = cover(n, list(zip(row["lo"], row["hi"])), length)
                        removed = int(mask.sum())
                        spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                        text = np.frombuffer(text, np.uint8)[~mask].tobytes()
                    out.append((row["doc_id"], n, removed, spans, hashlib.sha256(text).hexdigest()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                )

    return joined.mapInArrow(kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(documents(spark, sf_dir))


SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 200)) AS w FROM (SELECT doc_id, h, unnest(range(1, greatest(len(h) // 2 - 98, 1))) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
o AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
m AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR before + 100 < i THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM o),
x AS (SELECT doc_id, min(i) AS first, max(i) + 99 AS last FROM m GROUP BY doc_id, span),
p AS (SELECT doc_id, first, last, lag(last, 1, 0) OVER (PARTITION BY doc_id ORDER BY first) AS after FROM x),
k AS (SELECT d.doc_id, sum(last - first + 1) AS gone, count(*) AS spans, max(last) AS final, string_agg(substr(h, 2 * after + 1, 2 * (first - 1 - after)), '' ORDER BY first) AS head
      FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(final, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
