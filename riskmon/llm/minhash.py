"""Near-duplicate detection with circulant MinHash.

Two permutations of the 64-bit integers give all signature coordinates: the first
scatters the shingles, the second is applied after a circular shift by k for
coordinate k. Bands of coordinates collect candidates; the full shingle sets
decide. Equal sets are one class from the start. In each bucket of a band every
class is first compared with the smallest one; connected components of these
links leave open only buckets that hold several components. Small open buckets
are compared pair by pair; classes that large ones tie together are dealt into
blocks, and one task compares two blocks by a matrix product and returns no more
links than join them. So no group is expanded into its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmon.llm.common import LAST, discard, documents, join_counted, materialize, prepared
from riskmon.llm.words import PLACE_CODE, hash_windows, hash_words, mix

SHINGLE, BANDS, ROWS = 5, 20, 4
COORDINATES = BANDS * ROWS
# A link needs 100 x intersection >= PERCENT x union.
PERCENT = 85
# Open buckets with more members are compared in blocks of about so many classes and shingles.
SMALL, BLOCK, BLOCK_SHINGLES = 32, 512, 1 << 20
SLICE = 1 << 15
# Partners that are compared with one copy of a text.
PART = 64


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z count as a-z."""
    words, bounds = hash_words([t.lower() for t in texts])
    windows = hash_windows(words, shingle)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= shingle:
            yield np.unique(windows[a : b - shingle + 1])
        elif b > a:
            yield mix(np.array([(words[a:b] * PLACE_CODE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def second_permutation(x: np.ndarray) -> np.ndarray:
    """Two multiplies: after one alone, neighbouring shifts order small sets much alike."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of COORDINATES minima per non-empty set."""
    out = np.full((len(sets), COORDINATES), np.uint64(2**64 - 1))
    owners = [i for i, s in enumerate(sets) if len(s)]
    first = 0
    while first < len(owners):
        size, last = 0, first
        while last < len(owners) and (last == first or size + len(sets[owners[last]]) <= SLICE):
            size += len(sets[owners[last]])
            last += 1
        chosen = owners[first:last]
        scattered = mix(np.concatenate([sets[i] for i in chosen]))
        starts = np.cumsum([0] + [len(sets[i]) for i in chosen[:-1]])
        for k in range(COORDINATES):
            out[chosen, k] = np.minimum.reduceat(second_permutation(scattered + np.uint64(k)), starts)
        first = last
    return out


def band_hashes(rows: np.ndarray) -> np.ndarray:
    """One row of BANDS hashes per signature."""
    mixed = mix(rows).reshape(len(rows), BANDS, ROWS)
    return mix((mixed * PLACE_CODE[:ROWS]).sum(axis=2, dtype=np.uint64))


def lists(matrix: np.ndarray) -> pa.ListArray:
    bounds = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(matrix.ravel()))


SKETCHED = "doc_id long, n_shingles long, sum_a long, sum_b long, bands array<long>"


def sketch(docs: DataFrame) -> DataFrame:
    """Set size, set fingerprint and band hashes of each document."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = list(shingle_sets([(t or "").encode() for t in part.column(1).to_pylist()]))
                bands = band_hashes(signatures(sets)).view(np.int64)
                sums = [
                    np.array([mix(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                    for salt in (0x5BD1E995, 0xC2B2AE3D27D4EB4F)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[0]), pa.array(sums[1]),
                        lists(bands),
                    ],
                    names=["doc_id", "n_shingles", "sum_a", "sum_b", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sketched, SKETCHED)


def confirm(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) whose full shingle sets are as similar as asked.

    The partners of each a are dealt into parts of about `PART`; a part's rows lie
    next to each other, the one of a first, so that no text is copied per pair.
    """
    stored = materialize(pairs, "pairs")
    many = materialize(stored.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "partners")
    part = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / PART))
    dealt = join_counted(stored, many, ["a"]).select("a", "b", part.alias("part"))
    heads = dealt.select(F.col("a").alias("id"), "a", "part").distinct().withColumn("b", F.lit(None).cast("long"))
    roles = heads.unionByName(dealt.select(F.col("b").alias("id"), "a", "part", "b"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    placed = roles.join(texts, "id").repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: tuple[tuple[int, int], np.ndarray] | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                a, parts, b, texts = (part.column(i).to_pylist() for i in range(4))
                out = []
                for x, p, y, own in zip(a, parts, b, shingle_sets([(t or "").encode() for t in texts])):
                    if y is None:
                        head = (x, p), own
                    elif head is not None and head[0] == (x, p):
                        same = len(np.intersect1d(head[1], own, assume_unique=True))
                        if same > 0 and 100 * same >= percent * (len(head[1]) + len(own) - same):
                            out.append((x, y))
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return placed.select("a", "part", "b", "text").mapInArrow(alike, "a long, b long")


def stars(edges: DataFrame) -> bool:
    """Whether every upper end hangs on one lower end that hangs on none, so that the lower ends are the smallest ids of their components."""
    ends = edges.select(F.col("hi").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("lo").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    counted = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counted.where("up > 1 or up > 0 and down > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over the links (a, b), by alternating stars.

    Each round moves neighbours to the smallest neighbour of their centre, first
    from below and then from above, until every node hangs on its component's
    smallest id; the number of rounds grows with the logarithm of the longest path.
    The links are checked for that before each round, so no round only confirms.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), "cc")
    while not stars(edges):
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = F.min("lo").alias("m"), F.count(F.lit(1)).alias("n")
        centre = materialize(both.groupBy("hi").agg(*least).withColumn("m", F.least("m", "hi")), "cc")
        large = join_counted(both, centre, ["hi"]).where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        large = materialize(large.where("hi <> lo").distinct(), "cc")
        lower = materialize(large.groupBy("hi").agg(*least), "cc")
        joined = join_counted(large, lower, ["hi"])
        small = joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(joined.select("hi", F.col("m").alias("lo")))
        edges, old = materialize(small.where("hi <> lo").distinct(), "cc"), edges
        for done in (old, centre, large, lower):
            discard(done)
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, class_id, component_id, kept.

    class_id is the smallest doc_id with the same shingle set, component_id the
    smallest that links reach. A null, empty or blank text has no shingles and is
    linked with nothing; texts of any length are read whole; ties go to the smallest
    doc_id. Every row is a document of its own, so rows that share a doc_id are linked
    by their own texts, and rows without one link others like all rows; both ids are
    null where no row of the class or component has one. Other columns play no part;
    an empty table gives no row.
    """
    prepared(docs.sparkSession)
    ident = F.col("doc_id").cast("long")
    shared = docs.groupBy(F.coalesce(ident, F.lit(LAST))).agg(F.count(F.lit(1)).alias("n"), F.bool_or(ident.isNull()).alias("missing"))
    if shared.where("n > 1 or missing").isEmpty():
        return by_key(docs.select(ident.alias("doc_id"), "text"), percent)
    # Stored, since the numbers of the rows must be the same in every plan.
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), ident.alias("own"), "text"), "numbered")
    found = by_key(rows.select(F.col("row").alias("doc_id"), "text"), percent).drop("kept").withColumnRenamed("doc_id", "row")
    found = materialize(found.join(rows.select("row", "own"), "row"), "rows")
    for key in ("class_id", "component_id"):
        least = found.groupBy(key).agg(F.min("own").alias("least"), F.count(F.lit(1)).alias("n"))
        found = materialize(join_counted(found, materialize(least, "least"), [key]).drop(key, "n").withColumnRenamed("least", key), "rows")
    return found.select(F.col("own").alias("doc_id"), "n_shingles", "class_id", "component_id", F.col("own").eqNullSafe(F.col("component_id")).alias("kept"))


def by_key(docs: DataFrame, percent: int) -> DataFrame:
    """`near_duplicates` of documents whose ids are all there and all different."""
    rows = materialize(sketch(docs), "sketch")
    key = ["n_shingles", "sum_a", "sum_b"]
    classes = rows.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes, "classes")
    heads = join_counted(rows.where("n_shingles > 0"), classes, key).where("doc_id = class_id").select("class_id", "n_shingles", "bands")
    heads = materialize(heads, "heads")
    spread = heads.select("class_id", "n_shingles", F.posexplode("bands").alias("band", "hash"))
    shared = spread.groupBy("band", "hash").agg(F.min(F.struct("class_id", "n_shingles")).alias("head"), F.count(F.lit(1)).alias("n"))
    members = materialize(join_counted(spread, materialize(shared.where("n > 1"), "buckets"), ["band", "hash"]).drop("n"), "members")
    discard(heads)
    first = members.select(F.col("head.class_id").alias("a"), F.col("class_id").alias("b"), F.col("head.n_shingles").alias("na"), F.col("n_shingles").alias("nb"))
    links = materialize(confirm(comparable(first, percent), docs, percent), "links")
    placed = components(links)
    open_ = materialize(open_buckets(members, placed), "open")
    discard(members)
    few, many = open_.where(F.col("n") <= SMALL), open_.where(F.col("n") > SMALL)
    x, y = few.alias("x"), few.alias("y")
    apart = F.expr("x.band = y.band and x.hash = y.hash and x.class_id < y.class_id and x.component <> y.component")
    pairs = x.join(y, apart).where("x.class_id <> x.head.class_id").select(
        F.col("x.class_id").alias("a"), F.col("y.class_id").alias("b"), F.col("x.n_shingles").alias("na"), F.col("y.n_shingles").alias("nb")
    )
    more = confirm(comparable(pairs, percent), docs, percent)
    if not many.isEmpty():
        more = more.unionByName(compare_blocks(many, docs, percent))
    more = materialize(more, "links")
    if not more.isEmpty():
        placed = components(links.unionByName(more))
    answer = materialize(
        classes.join(placed.withColumnRenamed("id", "class_id"), "class_id", "left").withColumn("component_id", F.coalesce("component", "class_id")).drop("component"),
        "answer",
    )
    slim = rows.select("doc_id", *key)
    # Rows without shingles are the only ones that no class holds.
    held = join_counted(slim.where("n_shingles > 0"), answer, key).drop("n")
    none = slim.where("n_shingles = 0").withColumns({"class_id": F.col("doc_id"), "component_id": F.col("doc_id")})
    return held.unionByName(none).select("doc_id", "n_shingles", "class_id", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def comparable(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) whose sizes leave room for a link."""
    room = F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")
    return pairs.where(F.col("a") != F.col("b")).where(room).select("a", "b").distinct()


def open_buckets(members: DataFrame, placed: DataFrame) -> DataFrame:
    """Members, with components and bucket size, of the buckets that hold more than one component."""
    own = members.join(placed.withColumnRenamed("id", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    mixed = own.groupBy("band", "hash").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"))
    return own.join(mixed.where("lo <> hi").drop("lo", "hi"), ["band", "hash"])


def joining(n: int, linked: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those links that join parts which the links before them left apart."""
    above = list(range(n))

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    out = []
    for i, j in linked:
        x, y = top(i), top(j)
        if x != y:
            above[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of 0/1 matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(n > 1) - 1
    keep = n[code] > 1
    owner, code = owner[keep], place[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    wide = 4096
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, wide):
        a, b = np.searchsorted(code, (first, first + wide))
        held = np.zeros((len(sets), wide), np.float32)
        held[owner[a:b], code[a:b] - first] = 1
        total += held @ held.T
    return total


def compare_blocks(many: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links within the groups that large open buckets tie together, every pair of blocks in a task of its own.

    Sets can be linked only if their sizes are of one level or of two neighbouring ones.
    """
    groups = components(many.select(F.col("head.class_id").alias("a"), F.col("class_id").alias("b")).distinct())
    sizes = many.select(F.col("class_id").alias("id"), F.col("n_shingles").alias("size")).distinct()
    level = F.floor(F.log("size") / (-1.001 * math.log(percent / 100)))
    dealt = groups.join(sizes, "id").withColumn("level", level).withColumn("pair", F.explode(F.array(F.col("level") - 1, F.col("level"))))
    counts = dealt.groupBy("component", "pair").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_SHINGLES)).alias("blocks")
    )
    dealt = dealt.join(counts, ["component", "pair"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    rows = dealt.select(
        "component", "pair", "level", "id", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")
    ).join(texts, "id")

    def compared(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sets = list(shingle_sets([(t or "").encode() for t in pdf["text"]]))
        both, n = common_counts(sets), np.array([len(s) for s in sets], np.float64)
        linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        own, lower = pdf["own"].to_numpy(), pdf["level"].to_numpy() == key[1]
        linked &= (own[:, None] <= own[None, :]) if key[2] == key[3] else (own[:, None] < own[None, :])
        linked &= lower[:, None] | lower[None, :]
        i, j = np.nonzero(linked & (both > 0))
        ids = pdf["id"].to_numpy()
        out = joining(len(ids), [(x, y) for x, y in zip(i.tolist(), j.tolist()) if x != y])
        return pd.DataFrame({"a": [ids[x] for x, _ in out], "b": [ids[y] for _, y in out]}, dtype="int64")

    return rows.groupBy("component", "pair", "lo", "hi").applyInPandas(compared, "a long, b long")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
u AS (SELECT doc_id, len(s) AS n, md5(unnest(s)) AS x FROM g),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
          HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
k AS (SELECT list_sort(s) AS s, min(doc_id) AS class_id FROM g WHERE len(s) > 0 GROUP BY 1)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, c.component_id, g.doc_id = c.component_id AS kept, coalesce(k.class_id, g.doc_id) AS class_id
FROM g JOIN c ON c.doc_id = g.doc_id LEFT JOIN k ON k.s = list_sort(g.s)
"""
