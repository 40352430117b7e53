"""Exact top-k search over KD-trees, one per shard of the vectors.

Median splits of a bounded sample deal all vectors into cells of space, and a
cell's vectors into shards. A shard's tree splits at the median of its widest
component, keeps the tight bounding box of every node, and is built once. A query
walks a tree best first, by the largest inner product that a node's box allows,
and stops at the bound of its k-th score so far. Each query first asks the shard
that holds it; the k-th score found there is passed on, blocks of queries skip the
shards whose root box cannot reach it, and the other trees start with it as bound.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskmon.llm.common import discard, materialize, prepared

SHARD, LEAF, QUERY_BLOCK = 8192, 128, 512
# The splits that deal vectors into cells are fitted on at most so many vectors, and make at most so many cells.
SAMPLE_ROWS, CELLS = 20_000, 1024
# Blocks of queries that share one copy of a tree, and that meet one copy of the root boxes.
BLOCKS, DEAL = 16, 256
MOST = 2**63 - 1
EXACT = float(2**53)


class Tree:
    """Median-split tree over integer vectors (held as float64)."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        low, high, children, spans = [], [], [], []
        order = np.arange(len(ids))
        # Nodes are numbered as they are split; a leaf has no children.
        todo = [(0, len(ids), None)]
        while todo:
            first, last, parent = todo.pop()
            part = points[order[first:last]]
            box = part.min(axis=0), part.max(axis=0)
            node = len(low)
            low.append(box[0])
            high.append(box[1])
            children.append([-1, -1])
            spans.append((first, last))
            if parent is not None:
                children[parent][children[parent][0] >= 0] = node
            wide = int(np.argmax(box[1] - box[0]))
            if last - first > leaf and box[1][wide] > box[0][wide]:
                middle = (last - first) // 2
                order[first:last] = order[first:last][np.argpartition(part[:, wide], middle)]
                todo += [(first, first + middle, node), (first + middle, last, node)]
        self.ids, self.points = ids[order], points[order]
        self.low, self.high = np.array(low), np.array(high)
        self.children, self.spans = np.array(children, np.int32), np.array(spans, np.int32)

    def stored(self) -> list[bytes]:
        return [np.ascontiguousarray(x).tobytes() for x in (self.ids, self.points, self.low, self.high, self.children, self.spans)]

    @classmethod
    def loaded(cls, dim: int, ids: bytes, points: bytes, low: bytes, high: bytes, children: bytes, spans: bytes) -> Tree:
        tree = cls.__new__(cls)
        tree.ids = np.frombuffer(ids, np.int64).reshape(-1, 2)
        tree.points, tree.low, tree.high = (np.frombuffer(x, np.float64).reshape(-1, dim) for x in (points, low, high))
        tree.children, tree.spans = (np.frombuffer(x, np.int32).reshape(-1, 2) for x in (children, spans))
        return tree

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product of each query with any point of each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def scores(self, query: np.ndarray, first: int, last: int, wide: bool) -> list[int] | np.ndarray:
        """Inner products of the query with points first..last-1; whole numbers of Python where float64 is not exact."""
        if not wide:
            return self.points[first:last] @ query
        whole = [int(x) for x in query]
        return [max(-MOST - 1, min(MOST, sum(int(x) * y for x, y in zip(p, whole)))) for p in self.points[first:last]]

    def top(self, query: np.ndarray, own: int, bound: np.ndarray, k: int, floor: float) -> list[tuple[int, int, int]]:
        """The k best (score, id, row), ties to the smaller id and row, that reach `floor`; row `own` is left out."""
        best: list[tuple[int, int, int]] = []  # a heap of (score, -id, -row), the worst first
        wide = float(np.abs(query) @ np.maximum(np.abs(self.low[0]), np.abs(self.high[0]))) >= EXACT
        if wide:
            # Bounds in float64 are no proof here, so every leaf is read.
            floor, bound = float("-inf"), np.full(len(bound), np.inf)
        nodes = [(-bound[0], 0)]
        while nodes:
            limit, node = heapq.heappop(nodes)
            if -limit < (max(floor, best[0][0]) if len(best) == k else floor):
                break
            if self.children[node][0] >= 0:
                for child in self.children[node].tolist():
                    heapq.heappush(nodes, (-bound[child], child))
                continue
            first, last = self.spans[node].tolist()
            scores = self.scores(query, first, last, wide)
            least = max(floor, best[0][0]) if len(best) == k else floor
            for i in range(last - first) if wide else np.flatnonzero(scores >= least).tolist():
                ident, row = self.ids[first + i].tolist()
                if row == own:
                    continue
                entry = (int(scores[i]), -ident, -row)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return [(score, -ident, -row) for score, ident, row in best]


def quantized(embedding: Column) -> Column:
    """floor(256 x) of each component as a double, within the range of a long; null unless every component is finite."""
    parts = F.transform(embedding, lambda x: F.floor(x.cast("double") * 256).cast("double"))
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(fine & (F.size(embedding) > 0), parts)


def splits(points: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """Median splits (component, bound) of a sample, level by level; node i has the children 2i + 1 and 2i + 2."""
    out, parts = [], [points]
    while 2 * len(parts) <= cells and all(len(p) > 1 for p in parts):
        below = []
        for part in parts:
            wide = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            middle = float(np.median(part[:, wide]))
            out.append((wide, middle))
            left = part[:, wide] <= middle
            below += [part[left], part[~left]]
        parts = below
    return out


def cells_of(vectors: DataFrame, planes: list[tuple[int, float]]) -> DataFrame:
    """vectors with the number of the cell that each falls in; a component that a vector lacks counts as above."""
    part, bound = (np.array(x) for x in zip(*planes)) if planes else (np.zeros(0, int), np.zeros(0))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            node = np.zeros(len(pdf), np.int64)
            sizes = pdf["dim"].to_numpy()
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                data, at = np.stack(pdf["v"].to_numpy()[own]), np.zeros(len(own), np.int64)
                while len(part) and at[0] < len(part):
                    wide = part[at]
                    value = np.where(wide < dim, data[np.arange(len(own)), np.minimum(wide, dim - 1)], np.inf)
                    at = 2 * at + 1 + (value > bound[at])
                node[own] = at - len(part)
            yield pdf.assign(cell=node.astype(np.int32))

    return vectors.mapInPandas(placed, "row long, vec_id long, v array<double>, is_query boolean, dim int, cell int")


FOUND = "query_row long, query_id long, row long, vec_id long, score long"
TREE = "dim int, shard long, n long, ids binary, points binary, low binary, high binary, children binary, spans binary"


def search(vectors: DataFrame, is_query: Column, k: int = 5, shard_rows: int = SHARD) -> DataFrame:
    """The k best vectors for each query: query_id, rank (from 1), vec_id, score.

    `vectors` holds vec_id and embedding. Every row is a candidate, and a query
    leaves out its own row only, so rows that repeat an id all count and repeated
    queries each get their k rows. Ties go to the smaller id. Vectors of another
    length are no candidates. Null or empty vectors, vectors with a null or
    non-finite component and rows without an id take no part; vectors may be of
    any length; components and scores beyond a long count as the nearest long;
    other columns play no part; an empty table gives no row. Shards hold about
    `shard_rows` vectors at any size of the table; the splits into cells, which
    only decide how tight boxes are, are fitted on a bounded sample.
    """
    prepared(vectors.sparkSession)
    usable = vectors.select(F.col("vec_id").cast("long"), quantized(F.col("embedding")).alias("v"), is_query.alias("is_query"))
    usable = usable.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    # Numbered, and then stored, so that rows of one id stay apart.
    usable = usable.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.coalesce("is_query", F.lit(False)).alias("is_query"), F.size("v").alias("dim"))
    numbered = materialize(usable, "vectors")
    rows = numbered.count()
    sample = [r["v"] for r in numbered.orderBy(F.xxhash64("row")).select("v").limit(SAMPLE_ROWS).collect()]
    usual = max((len(v) for v in sample), default=1)
    planes = splits(np.array([v for v in sample if len(v) == usual]), min(CELLS, rows // shard_rows)) if sample else []
    stored = materialize(cells_of(numbered, planes), "cells")
    discard(numbered)
    parts = stored.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("parts"))
    # A shard's number: its cell and a part of the cell.
    shard = F.shiftleft(F.col("cell").cast("long"), 32) + F.pmod(F.xxhash64("row"), F.col("parts"))
    placed = materialize(stored.join(parts, ["dim", "cell"]).select("dim", shard.alias("shard"), "row", "vec_id", "v", "is_query"), "placed")
    discard(stored)

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "row"])
        tree = Tree(pdf[["vec_id", "row"]].to_numpy(np.int64), np.stack(pdf["v"].to_numpy()))
        return pd.DataFrame([[tree.points.shape[1], int(pdf["shard"].iloc[0]), len(pdf), *tree.stored()]], columns=[c.split()[0] for c in TREE.split(", ")])

    trees = materialize(placed.select("dim", "shard", "row", "vec_id", "v").groupBy("dim", "shard").applyInPandas(packed, TREE), "trees")
    queries = placed.where("is_query")
    # A block holds queries of one shard, so they lie near each other.
    per = queries.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks"))
    asked = materialize(queries.join(per, ["dim", "shard"]).select("dim", F.col("shard").alias("home"), block.alias("block"), "row", "vec_id", "v"), "asked")

    def blocks(requests: DataFrame) -> DataFrame:
        """One row per block of queries (dim, home, block, row, vec_id, v, floor)."""
        held = F.collect_list(F.struct("row", "vec_id", "v", "floor")).alias("q")
        return requests.groupBy("dim", "home", "block").agg(held).select(
            "dim", "home", "block", F.col("q.row").alias("query_rows"), F.col("q.vec_id").alias("query_ids"), F.col("q.v").alias("v"), F.col("q.floor").alias("floors")
        )

    def answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf.itertuples(index=False):
                tree = Tree.loaded(x.dim, x.ids, x.points, x.low, x.high, x.children, x.spans)
                queries = np.array([list(q) for q in x.v], np.float64).reshape(-1, x.dim)
                out = []
                for q, own, ident, floor, limit in zip(queries, x.query_rows, x.query_ids, x.floors, tree.bounds(queries)):
                    out += [(own, ident, row, vec, score) for score, vec, row in tree.top(q, int(own), limit, k, floor)]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")], dtype="int64")

    columns = ("query_rows", "query_ids", "v", "floors", "dim", "ids", "points", "low", "high", "children", "spans")
    ranked = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    at_home = blocks(asked.withColumn("floor", F.lit(float("-inf")))).withColumnRenamed("home", "shard")
    home = materialize(at_home.join(trees, ["dim", "shard"]).select(*columns).mapInPandas(answered, FOUND), "home")
    kth = home.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").cast("double").alias("floor"))
    bounded = materialize(blocks(asked.join(kth, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))), "blocks")
    found = home.unionByName(reaching(bounded, trees).select(*columns).mapInPandas(answered, FOUND))
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def reaching(blocks: DataFrame, trees: DataFrame) -> DataFrame:
    """Blocks of queries beside every other shard whose root box may hold a score that one of them still needs.

    The stated queries meet all shards block by block: first only the boxes of both
    sides, then, for the pairs that remain, queries and trees.
    """

    def corner(pick, values: Column) -> Column:
        # Smallest or largest value of each component over the block.
        first = F.get(values, F.lit(0))
        return F.aggregate(values, first, lambda acc, v: F.zip_with(acc, v, lambda a, b: pick(a, b)))

    def boxed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            boxes = [[np.frombuffer(b, np.float64)[:d].tolist() for d, b in zip(pdf["dim"], pdf[c])] for c in ("low", "high")]
            yield pd.DataFrame({"dim": pdf["dim"], "shard": pdf["shard"], "least": boxes[0], "most": boxes[1]})

    roots = materialize(trees.select("dim", "shard", "low", "high").mapInPandas(boxed, "dim int, shard long, least array<double>, most array<double>"), "roots")
    asked = materialize(
        blocks.select("dim", "home", "block", F.array_min("floors").alias("floor"), corner(F.least, F.col("v")).alias("qlo"), corner(F.greatest, F.col("v")).alias("qhi")), "boxes"
    )
    best = F.zip_with(
        F.zip_with("qlo", "least", lambda q, x: F.struct(q.alias("q"), x.alias("x"))),
        F.zip_with("qhi", "most", lambda q, x: F.struct(q.alias("q"), x.alias("x"))),
        lambda a, b: F.greatest(a["q"] * a["x"], a["q"] * b["x"], b["q"] * a["x"], b["q"] * b["x"]),
    )
    reach = F.aggregate(best, F.lit(0.0), lambda acc, x: acc + x)
    size = F.aggregate(best, F.lit(0.0), lambda acc, x: acc + F.abs(x))
    # Where float64 is not exact, no shard is left out.
    may = (reach >= F.col("floor")) | (size >= EXACT)
    # Each deal holds about `DEAL` blocks and meets a copy of all root boxes.
    deals = -(-asked.count() // DEAL) or 1
    copies = roots.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    dealt = asked.withColumn("deal", F.pmod(F.xxhash64("home", "block"), F.lit(deals)).cast("int"))
    pairs = materialize(dealt.join(copies, ["dim", "deal"]).where("home <> shard").where(may).select("dim", "home", "block", "shard"), "asks")
    per = pairs.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / BLOCKS).alias("groups"))
    grouped = pairs.join(per, ["dim", "shard"]).withColumn("group", F.pmod(F.xxhash64("home", "block"), F.col("groups")))
    names = ("query_rows", "query_ids", "v", "floors")
    sent = grouped.join(blocks, ["dim", "home", "block"]).groupBy("dim", "shard", "group").agg(F.collect_list(F.struct(*names)).alias("b"))
    return sent.select("dim", "shard", *[F.flatten(f"b.{c}").alias(c) for c in names]).join(trees, ["dim", "shard"])


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = prepared(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
