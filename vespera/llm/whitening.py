"""Embedding whitening with distributed block matrices.

Centred rows are indexed into blocks of a ``BlockMatrix``; its transpose times itself is the scatter matrix, which is as
small as the vectors are long and is decomposed locally. Multiplying the blocks by the whitening matrix projects all
rows. Rows stay in Spark's JVM from the blocks to the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a block, and blocks that one task multiplies and adds up: 1024 x 64 doubles are half a megabyte.
BLOCK_ROWS, BLOCKS_PER_TASK = 1024, 8
#: Vectors up to this length: the local decomposition takes the cube of it in time and eight bytes a square in memory.
LONGEST = 4096
#: Eigenvalues below this share of the largest one are rounding; their components cannot be whitened.
RANK = 1e-12

_OUT = (
    "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
)


def _all_finite(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def _numbered(vectors: DataFrame, dim: int, scale: int, shift: int) -> DataFrame:
    """(index, vec_id, x): indexes count the rows without gaps, by the sizes of the written parts."""
    whole = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("long"))
    rows = vectors.where(F.size("embedding") == dim).select("vec_id", whole.alias("x"))
    place = F.monotonically_increasing_id()
    rows = rows.select("vec_id", "x", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit(2**33 - 1)).alias("at"))
    rows = materialize(rows, "fit-rows")
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())  # one per task
    start, before = [], 0
    for part, n in sizes:
        start.append((part, before))
        before += n
    starts = rows.sparkSession.createDataFrame(start, "part long, start long")
    return rows.join(F.broadcast(starts), "part").select((F.col("start") + F.col("at")).alias("index"), "vec_id", "x")


def _sums(rows: DataFrame, dim: int) -> tuple[int, list[int], int]:
    """Rows, exact sums of each dimension, and the greatest spread of any: one row per task and dimension is added up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, "i8")
        low, high = np.full(dim, np.iinfo("i8").max), np.full(dim, np.iinfo("i8").min)
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            if len(x):
                n += len(x)
                total += x.sum(axis=0)
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if n:
            columns = [np.arange(dim, dtype="i4"), np.full(dim, n), total, low, high]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["d", "n", "total", "low", "high"])

    parts = rows.select("x").mapInArrow(add, "d int, n long, total long, low long, high long")
    sums = parts.groupBy("d").agg(F.sum("n").alias("n"), F.sum("total").alias("s"), F.min("low").alias("a"), F.max("high").alias("b"))
    found = sorted(sums.collect())  # a row per dimension
    return (found[0]["n"], [r["s"] for r in found], max(r["b"] - r["a"] for r in found)) if found else (0, [], 0)


def _blocks(rows: DataFrame, n: int, dim: int) -> BlockMatrix:
    """rows(index, vector) as blocks of ``BLOCK_ROWS`` whole rows."""
    vectors = rows.select("index", array_to_vector("vector").alias("vector"))
    indexed = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, dim)
    return indexed.toBlockMatrix(BLOCK_ROWS, dim)


def _scatter(blocks: BlockMatrix, n: int, dim: int) -> np.ndarray:
    """Transpose times the matrix. The middle dimension is split, so that a task holds few blocks and adds them up."""
    splits = max(1, math.ceil(n / BLOCK_ROWS / BLOCKS_PER_TASK))
    turned = blocks.transpose()._java_matrix_wrapper._java_model
    product = turned.multiply(blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, dim, dim).toLocalMatrix().toArray()


def _rows(blocks: BlockMatrix) -> DataFrame:
    """(index, y array) of the rows of a block matrix."""
    indexed = blocks.toIndexedRowMatrix()
    return callMLlibFunc("getIndexedRows", indexed._java_matrix_wrapper._java_model).select(
        "index", vector_to_array("vector").alias("y")
    )


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """A row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``vectors(vec_id, embedding)``; other columns are not read. Vectors that are null or empty, or hold null or
    non-finite entries, drop out. Each entry c becomes the whole number ``floor(scale * c) + shift``. All remaining
    vectors are the fit list, repeated ids and vectors each counted; a covariance has divisor ``n`` and is centred
    before it is multiplied. Components are unit eigenvectors of the covariance in falling order of eigenvalue; the
    entry of largest size of each is positive. Vectors of another length than most have (the longer of equally
    frequent ones) share no space with the others and drop out too. Components without variance cannot be whitened and
    are left out; no vectors, or equal ones only, give no rows. A null vec_id stays null.

    ``deviation`` is the sum over dimensions of ``(n * x - S)^2``, exact in 38 digits. ``whitened`` has the covariance
    of the identity up to ``identity_error``, which is measured on the result. ``explained`` is the component's share of
    the variance. Driver and tasks hold one matrix as wide as the vectors are long (``LONGEST`` at most); rows only meet
    in blocks of ``BLOCK_ROWS``, dealt by their index, so equal vectors spread like any others.
    """
    spark = vectors.sparkSession
    none = spark.createDataFrame([], _OUT)
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(_all_finite(F.col("embedding")))
    lengths = usable.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if first is None:
        return none
    dim = first["d"]
    if dim > LONGEST:
        raise ValueError(f"vectors of {dim} dimensions are too long to decompose their covariance locally")
    rows = materialize(_numbered(usable, dim, scale, shift), "numbered")
    n, sums, spread = _sums(rows, dim)

    mean = F.array(*[F.lit(s / n) for s in sums])
    centred = rows.select("index", F.zip_with("x", mean, lambda x, m: x - m).alias("vector"))
    blocks = _blocks(centred, n, dim)
    values, axes = np.linalg.eigh(_scatter(blocks, n, dim) / n)
    values, axes = values[::-1], axes[:, ::-1]
    trace = float(values.sum())
    count = int((values[:components] > RANK * values[0]).sum()) if values[0] > 0 else 0
    if not count:
        return none
    axes = axes[:, :count] * np.sign(axes[np.abs(axes[:, :count]).argmax(axis=0), np.arange(count)])
    whitening = (axes / np.sqrt(values[:count])).ravel(order="F")
    one = spark.sparkContext.parallelize([((0, 0), Matrices.dense(dim, count, whitening))], 1)
    projected = materialize(_rows(blocks.multiply(BlockMatrix(one, dim, count))), "projected")

    means = projected.select(*[F.avg(F.col("y")[i]) for i in range(count)]).first()
    again = F.zip_with("y", F.array(*[F.lit(m) for m in means]), lambda y, m: y - m)
    spread_again = _scatter(_blocks(projected.select("index", again.alias("vector")), n, count), n, count) / n
    error = float(np.abs(spread_again - np.eye(count)).max())

    # A sum over dimensions that fits a long for any row needs no decimals.
    kind = "long" if dim * (n * max(spread, 1)) ** 2 < 2**62 else "decimal(38,0)"
    total = F.array(*[F.lit(s).cast(kind) for s in sums])

    def squared(x: Column, s: Column) -> Column:
        gap = F.lit(n).cast("decimal(19,0)") * x.cast("decimal(19,0)") if kind != "long" else F.lit(n) * x
        gap = gap.cast(kind) - s
        return (gap * gap).cast(kind)

    deviation = F.aggregate(F.zip_with("x", total, squared), F.lit(0).cast(kind), lambda a, b: (a + b).cast(kind))
    fixed = rows.select("index", "vec_id", deviation.cast("decimal(38,0)").alias("deviation"))
    shares = F.array(*[F.lit(float(v) / trace) for v in values[:count]])
    return (
        fixed.join(projected, "index")
        .select("vec_id", "deviation", F.posexplode("y").alias("at", "whitened"))
        .select(
            "vec_id",
            (F.col("at") + 1).alias("component"),
            F.lit(n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.element_at(shares, F.col("at") + 1).alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )
