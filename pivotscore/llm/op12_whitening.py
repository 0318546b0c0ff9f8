"""Embedding whitening with MLlib's distributed block matrices.

Entries are put on a fixed-point grid, ``x = floor(64 c) + 1000000``, so that
equal vectors are exactly equal and their sums exact.  The fit list, each
distinct vector once, is centred, indexed and dealt into row blocks of a
``BlockMatrix``; its transpose times itself is the scatter matrix.  The one
small matrix that comes to the driver (dimensions squared, whatever the
table's size) is decomposed there, and the blocks times the whitening matrix
project the rows.

MLlib sums all products of one result block in one task unless told
otherwise; as the scatter is a single block, the row blocks are multiplied in
``ceil(blocks / BLOCKS)`` partial sums that are added up afterwards.

Projections of the distinct vectors are joined back to the table's rows by a
128-bit key.  MLlib's multiplication lists the blocks' numbers at the driver,
two integers for each ``BLOCK_BYTES`` of the table.  Vectors that make up more than a ``1 / HOT`` share of the rows,
of which there are fewer than HOT, are joined by broadcast, the rest by key.

Defined results: rows with a null vector, an empty one, null or non-finite
entries, or entries whose x is no 64-bit integer take no part, and where
lengths differ those not of the commonest length (on a tie the smaller).
Repeated rows and null ids come back as often as they are given.  Where an
eigenvalue is zero, within rounding, ``whitened`` is 0.0 and the component is
left out of ``identity_error`` (0.0 if none is left); ``explained`` is 0.0
where all are zero.  A ``deviation`` beyond 64 bits is null.  Extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: Components returned; bytes of a row block; row blocks of a partial sum; inverse share of a frequent vector.
COMPONENTS, BLOCK_BYTES, BLOCKS, HOT = 16, 1 << 21, 16, 1000
SCALE, OFFSET = 64, 1_000_000


@dataclass
class Fit:
    """Counts, sums and eigenpairs of the fit list."""

    n: int
    sums: list[int]
    values: np.ndarray    # falling eigenvalues of the covariance
    vectors: np.ndarray   # unit eigenvectors, one a column
    used: int             # components whose eigenvalue is not zero
    whitening: np.ndarray  # dimensions x returned components


def grid(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x, key) of the rows that take part."""
    entries = F.transform(F.col("v"), lambda c: F.floor(F.lit(float(SCALE)) * c).cast("long") + F.lit(OFFSET))
    fits = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(2.0 ** 55)))
    some = (table.select(F.col("vec_id").cast("long"), F.col(vector).cast("array<double>").alias("v"))
            .filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(F.coalesce(fits, F.lit(False)))
            .select("vec_id", entries.alias("x")))
    kept = cut(some.withColumn("key", F.unhex(F.md5(F.concat_ws(",", F.col("x").cast("array<string>"))))))
    common = kept.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return kept.filter(F.size("x") == common["d"]) if common else kept


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def indexed(distinct: DataFrame) -> DataFrame:
    """``distinct`` with a dense row index: its place in its written partition after all earlier partitions."""
    placed = cut(distinct.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    # One row for each task that wrote the list.
    sizes = sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows")).collect())
    before, first = 0, []
    for part_id, rows in sizes:
        first.append((part_id, before))
        before += rows
    firsts = F.broadcast(placed.sparkSession.createDataFrame(first, "part long, before long"))
    return (placed.withColumn("part", part).join(firsts, "part")
            .withColumn("row", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "before", "at"))


def sums(distinct: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows of the fit list and the exact sum of each dimension."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"), d)
            # Upper and lower bits apart, so that no partial sum overflows.
            parts = [(x >> 20).sum(0), (x & 0xFFFFF).sum(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, len(b), np.int64)), *map(pa.array, parts)],
                                             names=["k", "n", "high", "low"])

    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    got = distinct.select("x").mapInArrow(rows, "k int, n long, high long, low long").groupBy("k").agg(F.sum("n").alias("n"), *wide).orderBy("k").collect()
    return got[0]["n"], [(int(r["high"]) << 20) + int(r["low"]) for r in got]


def centred(distinct: DataFrame, n: int, total: list[int]) -> DataFrame:
    """(row, vector): x - S/n, from an exact integer difference and the mean's fraction."""
    whole = F.array(*[F.lit(s // n) for s in total])
    rest = F.array(*[F.lit((s % n) / n) for s in total])
    less = F.zip_with("x", F.arrays_zip(whole.alias("w"), rest.alias("r")), lambda x, m: (x - m["w"]).cast("double") - m["r"])
    vectors = distinct.select("row", array_to_vector(less).alias("vector"))
    return MLUtils.convertVectorColumnsFromML(vectors, "vector")


def row_blocks(vectors: DataFrame, n: int, width: int) -> BlockMatrix:
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(max(1, BLOCK_BYTES // (8 * width)), width)


def scatter(blocks: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix, in partial sums of ``BLOCKS`` row blocks."""
    splits = max(1, -(-blocks.numRowBlocks // BLOCKS))
    wrapped = blocks.transpose()._java_matrix_wrapper
    product = BlockMatrix(wrapped.call("multiply", blocks._java_matrix_wrapper._java_model, splits),
                          blocks.colsPerBlock, blocks.colsPerBlock)
    return product.toLocalMatrix().toArray()


def decompose(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Falling eigenvalues, eigenvectors and how many values are not zero."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    zero = values[0] * len(values) * np.finfo(float).eps * 16
    return values, vectors, int((values > zero).sum())


def fit(distinct: DataFrame, d: int, components: int = COMPONENTS) -> tuple[Fit, BlockMatrix]:
    """The whitening of ``distinct(row, x)`` and its centred rows in blocks."""
    n, total = sums(distinct, d)
    blocks = row_blocks(centred(distinct, n, total), n, d)
    values, vectors, rank = decompose(scatter(blocks) / n)
    k = min(components, d)
    used = min(rank, k)
    whitening = np.zeros((d, k))
    whitening[:, :used] = vectors[:, :used] / np.sqrt(values[:used])
    return Fit(n, total, values, vectors, used, whitening), blocks


def project(spark: SparkSession, blocks: BlockMatrix, whitening: np.ndarray) -> BlockMatrix:
    """The blocks' rows times the whitening matrix."""
    d, k = whitening.shape
    small = spark.sparkContext.parallelize([((0, 0), DenseMatrix(d, k, whitening.ravel(order="F").tolist()))], 1)
    return blocks.multiply(BlockMatrix(small, d, k))


def whiten(table: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component."""
    spark = table.sparkSession
    rows = grid(table, vector)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    one = rows.select(F.size("x").alias("d")).first()
    if one is None:
        return spark.createDataFrame([], schema)
    distinct = indexed(rows.groupBy("key").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("copies")))
    model, blocks = fit(distinct, one["d"], components)
    projected = project(spark, blocks, model.whitening)
    inner = scatter(projected)[:model.used, :model.used] / model.n
    error = float(np.abs(inner - np.eye(model.used)).max()) if model.used else 0.0
    # (index, vector) rows straight from the JVM.
    flat = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    flat = MLUtils.convertVectorColumnsToML(flat, "vector").select(F.col("index").alias("row"), vector_to_array("vector").alias("white"))
    told = cut(deviations(distinct, model).join(flat, "row").select("key", "copies", "deviation", "white"))
    everyone = rows.count()
    often = F.col("copies") * HOT > everyone  # at most HOT distinct vectors
    hot = F.broadcast(told.filter(often))
    seen = F.broadcast(told.filter(often).select("key"))
    all_rows = rows.select("vec_id", "key")
    joined = all_rows.join(hot, "key").unionByName(all_rows.join(seen, "key", "left_anti").join(told.filter(~often), "key"))
    share = model.values / (model.values.sum() or 1.0)
    shares = F.array(*[F.lit(float(s)) for s in share[:model.whitening.shape[1]]])
    return (joined.select("vec_id", "deviation", F.posexplode("white").alias("k", "whitened"))
            .select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                    "whitened", shares[F.col("k")].alias("explained"), F.lit(error).alias("identity_error")))


def deviations(distinct: DataFrame, model: Fit) -> DataFrame:
    """(row, key, copies, deviation): the exact sum of (n x - S) squared over the dimensions."""
    n, total = model.n, model.sums
    small = np.array([s % n for s in total], np.int64)
    base = np.array([s // n for s in total], np.int64)

    def exact(x: np.ndarray) -> list[int | None]:
        step = x - base  # n x - S = n (x - floor(S/n)) - S mod n
        most = int(np.abs(step).max(initial=0)) + 1
        if (most * n) ** 2 * len(total) < 2 ** 63:
            return ((step * n - small) ** 2).sum(1).tolist()
        got = [sum((int(a) * n - int(b)) ** 2 for a, b in zip(r, small, strict=True)) for r in step]
        return [g if g < 2 ** 63 else None for g in got]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"), len(total))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("key"), b.column("copies"), pa.array(exact(x), pa.int64())],
                                             names=["row", "key", "copies", "deviation"])

    return (distinct.select("row", "key", "copies", "x").mapInArrow(rows, "row long, key binary, copies long, deviation long"))
