"""Whitening of vectors with Spark MLlib's block matrices.

Vectors become whole numbers and are numbered without gaps. The distinct ones,
centred, form a BlockMatrix whose transpose times itself is the scatter matrix;
its eigenvectors are found on the driver, where only one square of the vectors'
length arrives. A second BlockMatrix, of all centred rows, times the whitening
matrix gives every row's components. All row-level work stays in the JVM.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskmon.llm.common import materialize, prepared

# Rows and columns of a block, and blocks of the long side that one task multiplies.
ROWS, COLUMNS, SPLIT = 1024, 1024, 16
MOST = 2**63 - 1
# An eigenvalue below this share of the trace is rounding, and its component has no scale.
NOTHING = 1e-13
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(embedding: Column) -> Column:
    """floor(256 x) of each component as a long; null unless there are components and each is finite."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(fine & (F.size(embedding) > 0), F.transform(embedding, lambda x: F.floor(x.cast("double") * 256)))


def numbered(rows: DataFrame) -> DataFrame:
    """Stored `rows` with `index`, from 0 without gaps."""
    held = materialize(rows.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33)), "vectors")
    # One row per task of the scan.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return held.join(F.broadcast(starts), "part").withColumn("index", F.col("start") + F.col("place")).drop("part", "place", "start")


def block_matrix(rows: DataFrame, mean: np.ndarray, n_rows: int) -> BlockMatrix:
    """`x` of the rows (index, x) less `mean`; a row that is not there counts as zero."""
    centre = F.array(*[F.lit(float(m)) for m in mean])
    held = rows.select("index", array_to_vector(F.zip_with("x", centre, lambda a, b: a.cast("double") - b)).alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(held, "vector"), n_rows, len(mean))
    return matrix.toBlockMatrix(ROWS, COLUMNS)


def gram(matrix: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix, multiplied in tasks of `SPLIT` blocks each."""
    splits = max(1, -(-matrix.numRowBlocks // SPLIT))
    flipped = matrix.transpose()
    product = flipped._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, COLUMNS, COLUMNS).toLocalMatrix().toArray()


def local_blocks(spark: SparkSession, values: np.ndarray) -> BlockMatrix:
    """A small matrix as blocks."""
    tall = range(-(-len(values) // COLUMNS))
    blocks = [((i, 0), DenseMatrix(*(part := values[i * COLUMNS : (i + 1) * COLUMNS]).shape, part.ravel("F").tolist())) for i in tall]
    return BlockMatrix(spark.sparkContext.parallelize(blocks, 1), COLUMNS, values.shape[1])


def indexed(matrix: BlockMatrix) -> DataFrame:
    """(index, z): the rows of a block matrix as arrays."""
    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(rows, "vector").select("index", vector_to_array("vector").alias("z"))


def deviations(n: int, sums: list[int], low: list[int], high: list[int]) -> Column:
    """Sum over components of (n x - S)^2, exact; beyond a long it is the largest long."""
    most = sum(max(abs(n * a - s), abs(n * b - s)) ** 2 for s, a, b in zip(sums, low, high))
    if most <= MOST and max(map(abs, sums)) <= MOST and n * max(map(abs, [*low, *high])) <= MOST:
        parts = F.zip_with("x", F.array(*[F.lit(s).cast("long") for s in sums]), lambda x, s: F.lit(n).cast("long") * x - s)
        return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, d: acc + d * d)
    kind = "decimal(38,0)"
    parts = F.zip_with("x", F.array(*[F.lit(str(s)).cast(kind) for s in sums]), lambda x, s: F.abs(F.expr(f"cast({n} as {kind})") * x.cast(kind) - s).cast(kind))
    # A difference of 2^32 or more alone exceeds a long.
    small = F.transform(parts, lambda d: F.least(d, F.lit(2**32).cast(kind)).cast(kind))
    total = F.aggregate(small, F.lit(0).cast(kind), lambda acc, d: (acc + d * d).cast(kind))
    return F.least(total, F.lit(str(MOST)).cast(kind)).cast("long")


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding) and component: see `OUT`.

    Rows count by x = floor(256 embedding); the fit list holds each distinct x once.
    Rows with a null or empty vector or with a null or non-finite component take no
    part, nor do vectors of another length than most rows have (the longer on a tie).
    A component without variance has a null `whitened` and does not count for
    `identity_error`; without any variance `explained` is null. Repeated rows and rows
    without an id each give their rows; x beyond a long counts as the nearest long;
    vectors may be of any length whose square the driver can hold; other columns of any
    name play no part; an empty table gives no row.
    """
    spark = prepared(vectors.sparkSession)
    usable = vectors.select(F.col("vec_id").cast("long"), whole(F.col("embedding")).alias("x")).where("x is not null")
    lengths = usable.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return spark.createDataFrame([], OUT)
    dim, n_rows = lengths
    rows = numbered(usable.where(F.size("x") == dim))
    fit = materialize(rows.groupBy("x").agg(F.min("index").alias("index")), "fit")
    n = fit.count()
    stats = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("i").collect()
    sums, low, high = ([int(r[c]) for r in stats] for c in ("s", "a", "b"))
    mean = np.array([s / n for s in sums])
    # Kept, since several products read it; blocks that are lost are made again from the stored rows.
    fitted = block_matrix(fit, mean, n_rows).persist(StorageLevel.MEMORY_AND_DISK)
    covariance = gram(fitted) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace = float(np.trace(covariance))
    scaled = values > NOTHING * trace
    matrix = axes / np.sqrt(np.where(scaled, values, 1.0))
    local = local_blocks(spark, matrix)
    projected, error = fitted.multiply(local).persist(StorageLevel.MEMORY_AND_DISK), 0.0
    if scaled.any():
        error = float(np.abs((gram(projected) / n - np.eye(len(values)))[np.ix_(scaled, scaled)]).max())
    # Without repeated vectors the fit list is all rows.
    every = projected if n == n_rows else block_matrix(rows, mean, n_rows).multiply(local)
    found = materialize(indexed(every).withColumnRenamed("index", "at"), "projected")
    for kept in (projected, fitted):
        kept._java_matrix_wrapper.call("blocks").unpersist(False)
    shares = [F.lit(float(v) / trace if trace > 0 else None).cast("double") for v in np.maximum(values, 0)]
    component = [F.struct(F.lit(k + 1).alias("component"), (F.get("z", F.lit(k)) if scaled[k] else F.lit(None).cast("double")).alias("whitened"), shares[k].alias("explained")) for k in range(len(values))]
    known = rows.select("index", "vec_id", deviations(n, sums, low, high).alias("deviation"))
    joined = known.join(found, known["index"] == found["at"]).select("vec_id", "deviation", F.explode(F.array(*component)).alias("c"))
    return joined.select("vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(prepared(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))
