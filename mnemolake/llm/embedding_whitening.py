"""Whitening of embeddings with distributed block matrices.

Entries become integers, so counts, sums and deviations are exact. Centred rows are indexed and cut into distributed
blocks; the transposed blocks times the blocks give the scatter matrix, which is as large as the number of dimensions
and is decomposed on the driver; the blocks times the whitening matrix project every row.

The rows of the middle dimension are split for the scatter product, so its partial products are made in as many tasks as
there are blocks, and only matrices of the size of the result meet.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mnemolake.llm.feistel_shards import global_row_numbers
from mnemolake.llm.shared import Registry, stored, table

registry = Registry()

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
ROWS_PER_BLOCK = 1024
#: a component of a smaller share of the variance is rounding noise and cannot be scaled to variance 1
LEAST_SHARE = 1e-12
BIG = "decimal(38,0)"
OUT = f"component int, n long, deviation {BIG}, whitened double, explained double, identity_error double"


def usable(vector: Column) -> Column:
    """A vector without null, NaN or infinite entries; an empty one has nothing to project."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(finite(c.cast("double")), F.lit(False))), F.lit(False))


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the sum of every dimension; one row per dimension reaches the driver."""
    per = rows.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.sum("v").alias("s"), F.count("*").alias("n")).orderBy("d").collect()
    if len({r["n"] for r in per}) > 1:
        raise ValueError("vectors of different lengths")
    return (per[0]["n"] if per else 0), [r["s"] for r in per]


def _times(left: BlockMatrix, right: BlockMatrix, middle_splits: int) -> BlockMatrix:
    """left * right, with the middle dimension dealt to so many groups of tasks.

    The Python method has no argument for the splits, without which every product for one result block is made in one task.
    """
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, middle_splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: its id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Rows whose vector is null or empty, or holds a null, NaN or infinite entry, are left out; vectors of different
    lengths are an error. An entry c becomes the integer floor(1024 c) + 100000. Components are numbered from 1 by falling
    variance; those without variance are left out, so one vector, or only equal vectors, give no rows, as does an empty table. Equal
    vectors get equal values, repeated and null ids keep their rows. The largest entry may be 2^52. Other columns are ignored.
    """
    spark = rows.sparkSession
    whole = F.transform(vector_col, lambda c: F.floor(SCALE * c.cast("double")).cast("long") + SHIFT)
    fit = rows.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), whole.alias("x"))
    placed, _ = global_row_numbers(fit, ["id"], "at")
    n, sums = _sums(placed)
    nothing = spark.createDataFrame([], f"id long, {OUT}").withColumn("id", F.col("id").cast(fit.schema["id"].dataType))
    if not n:
        return nothing.withColumnRenamed("id", id_col)
    dims = len(sums)
    total = F.array(*[F.lit(s).cast("long") for s in sums])
    apart = F.zip_with("x", total, lambda x, s: n * x.cast(BIG) - s.cast(BIG))  # n times the centred entry, exact
    square = F.aggregate(apart, F.lit(0).cast(BIG), lambda acc, v: (acc + (v * v).cast(BIG)).cast(BIG))
    centred = F.transform(apart, lambda v: v.cast("double") / float(n))

    indexed = placed.select(F.col("at").alias("index"), array_to_vector(centred).alias("vector"))
    blocks = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(indexed, "vector"), n, dims).toBlockMatrix(ROWS_PER_BLOCK, dims)
    scatter = _times(blocks.transpose(), blocks, -(-n // ROWS_PER_BLOCK)).toLocalMatrix().toArray()
    covariance = (scatter + scatter.T) / (2.0 * n)
    values, vectors = np.linalg.eigh(covariance)
    trace = float(np.trace(covariance))
    order = [i for i in np.argsort(-values, kind="stable")[:components].tolist() if values[i] > LEAST_SHARE * max(trace, 0.0)]
    if not order:
        return nothing.withColumnRenamed("id", id_col)
    kept = len(order)
    projection = vectors[:, order] / np.sqrt(values[order])

    one = spark.sparkContext.parallelize([((0, 0), Matrices.dense(dims, kept, projection.ravel(order="F").tolist()))], 1)
    projected = _times(blocks, BlockMatrix(one, dims, kept, dims, kept), 1).toIndexedRowMatrix()
    lines = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
    lines = MLUtils.convertVectorColumnsToML(lines, "vector").select(F.col("index").alias("at"), vector_to_array("vector").alias("z"))
    white = stored(placed.select("at", "id", square.alias("deviation")).join(lines, "at").select("id", "deviation", "z"), "whitened")

    error = identity_error(white, kept)
    explained = F.array(*[F.lit(float(values[i]) / trace) for i in order])
    out = white.select("id", "deviation", F.posexplode("z").alias("c", "whitened"))
    return out.select(
        F.col("id").alias(id_col), (F.col("c") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("c")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def identity_error(white: DataFrame, kept: int) -> float:
    """The largest absolute entry of the covariance of ``z`` minus the identity, centred before it is multiplied."""
    z = [F.get("z", F.lit(i)) for i in range(kept)]
    means = white.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(z)]).first()
    pairs = [(i, j) for i in range(kept) for j in range(i, kept)]
    found = white.agg(*[F.avg((z[i] - means[i]) * (z[j] - means[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(value - (i == j)) for (i, j), value in zip(pairs, found))


@registry.add("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
