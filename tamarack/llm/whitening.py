"""PCA whitening of embeddings with MLlib's distributed block matrices.

Rows are packed into blocks of a bounded size where they lie; a block's place in the matrix comes
from the number of blocks before it, so no row moves. The last block of a task is filled with
zero rows, which add nothing to a product. The centred blocks are a BlockMatrix A; its scatter
A'A is multiplied in splits of the middle dimension, so that no task holds more than a few blocks,
the eigenvectors are found on the driver from one d x d matrix, and A times the whitening matrix
projects the rows. MLlib deals a tall product out over the square root of the tasks asked for, each
holding its blocks in memory; so A is projected in slabs of a fixed height, all in one job.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, read_table, workspace

#: Bytes of a block, and of the blocks that a task multiplies at once.
BLOCK, SPLIT = 2 << 20, 32 << 20
#: Columns of a block; blocks of a slab and of a task that projects them.
WIDE, SLAB, TALL = 1024, 512, 32
#: Components with a smaller share of the largest eigenvalue have no direction of their own.
LEAST_SHARE = 1e-12
#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Values beyond this are held here, so that sums of two stay within a long.
MOST = 1 << 61

_MATRIX = "struct<type:tinyint,numRows:int,numCols:int,colPtrs:array<int>,rowIndices:array<int>,values:array<double>,isTransposed:boolean>"
_BLOCKS = "part int, local int, rows int, ids array<long>, x array<long>"


def rows_of(dim: int) -> int:
    """Rows of a block, from the dimension alone."""
    return max(16, BLOCK // (8 * max(dim, 1)))


def usable(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is neither null nor empty and has finite entries only."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return embeddings.where(v.isNotNull() & (F.size(v) > 0) & fine)


def integers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values), -MOST, MOST).astype(np.int64) + SHIFT


def pack(vectors: DataFrame, dim: int, key: str, vector: str) -> DataFrame:
    """Blocks of at most ``rows_of(dim)`` rows: where they lie, their ids and integer entries row by row."""
    most = rows_of(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, local, ids, held = TaskContext.get().partitionId(), 0, [], []

        def block(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array([part], pa.int32()), pa.array([local], pa.int32()), pa.array([len(b)], pa.int32())]
            return pa.record_batch([*columns, pa.array([a.tolist()], pa.list_(pa.int64())), _one_list(b.ravel(), pa.int64())], names=["part", "local", "rows", "ids", "x"])

        for batch in batches:
            flat = np.asarray(pc.list_flatten(batch.column(1)).cast(pa.float64()), np.float64)
            ids += batch.column(0).to_pylist()
            held.append(integers(flat).reshape(-1, dim))
            while len(ids) >= most:
                x = np.concatenate(held)
                yield block(np.array(ids[:most], object), x[:most])
                ids, held, local = ids[most:], [x[most:]], local + 1
        if ids:
            yield block(np.array(ids, object), np.concatenate(held))

    return vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, _BLOCKS)


def _one_list(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dim
        for batch in batches:
            for x in batch.column(0):
                own = np.asarray(x.values, np.int64).reshape(-1, dim)
                low, high = own & 0xFFFFFFFF, own >> 32  # each summed within a long
                total = [t + (int(b) << 32) + int(a) for t, a, b in zip(total, low.sum(0), high.sum(0), strict=True)]
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(dim), pa.int32()), "total": pa.array(map(str, total), pa.string())})

    return run


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n, rounded once: the whole part of the mean is taken off in integers."""
    whole = [s // n for s in sums]
    rest = np.array([(s - w * n) / n for s, w in zip(sums, whole, strict=True)])
    return (x - np.array(whole, np.int64)).astype(np.float64) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum of (n x - S)^2 of each row; null where a long can't hold it."""
    reach = max((max(abs(n * int(a) - s), abs(n * int(b) - s)) for a, b, s in zip(x.min(0), x.max(0), sums, strict=True)), default=0) if len(x) else 0
    if reach * reach * len(sums) < 1 << 63 and n * max(map(abs, (int(x.min(initial=0)), int(x.max(initial=0))))) < 1 << 63:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def _grid(n: int, sums: list[int], offsets: list[int], dim: int):
    """Packed blocks as entries of a block matrix: centred, column by column, filled up with zeros."""
    most = rows_of(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())), ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())]
        for batch in batches:
            for part, local, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = centred(np.asarray(x.values, np.int64).reshape(-1, dim), n, sums)
                whole = np.zeros((most, dim))
                whole[: len(own)] = own
                for j in range(0, dim, WIDE):
                    cells = whole[:, j : j + WIDE]
                    arrays = [pa.array([1], pa.int8()), pa.array([most], pa.int32()), pa.array([cells.shape[1]], pa.int32()), pa.array([None], pa.list_(pa.int32())), pa.array([None], pa.list_(pa.int32())), _one_list(cells.ravel(), pa.float64()), pa.array([True])]
                    yield pa.record_batch([pa.array([offsets[part] + local], pa.int32()), pa.array([j // WIDE], pa.int32()), pa.StructArray.from_arrays(arrays, fields=[pa.field(*f) for f in fields])], names=["i", "j", "m"])

    return run


_ENTRIES = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("m", MatrixUDT())])


def block_matrix(spark: SparkSession, path: str, rows_per_block: int, cols_per_block: int, rows: int, cols: int, first: int = 0) -> BlockMatrix:
    """The BlockMatrix of a written table of (i, j, m), read by the JVM alone; row block ``first`` is its first."""
    typed = spark.read.schema(_ENTRIES).parquet(path).select(F.struct((F.col("i") - first).cast("long").alias("blockRowIndex"), F.col("j").cast("long").alias("blockColIndex")).alias("index"), "m")
    return BlockMatrix(callMLlibFunc("createBlockMatrix", typed, rows_per_block, cols_per_block, rows, cols), rows_per_block, cols_per_block)


def times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """A product with the middle dimension dealt out over ``splits`` tasks a result block."""
    product = left._java_matrix_wrapper._java_model.multiply(right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def scatter(a: BlockMatrix, splits: int) -> np.ndarray:
    return times(a.transpose(), a, splits).toLocalMatrix().toArray()


def directions(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a covariance by falling eigenvalue, ``most`` at
    most, without those that are nothing next to the largest."""
    e, w = np.linalg.eigh((v + v.T) / 2)
    e, w = e[::-1][:most], w[:, ::-1][:, :most]
    fine = e > LEAST_SHARE * max(e[0], 0) if len(e) else np.zeros(0, bool)
    return e[fine], w[:, fine]


def whiten(embeddings: DataFrame, most: int = 32, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each usable row of ``embeddings`` and component up to ``most``: the key, component,
    n, deviation, whitened, explained and identity_error.

    Unusable rows (null or empty vector, null or non-finite entries) go, as do those whose vector
    isn't of the commonest length (of equally common ones the longest). Repeated rows and null keys
    count like any other. Components without variance have no rows; without any (no rows, or equal
    ones) the result is empty. Only key and vector are read."""
    spark = embeddings.sparkSession
    kind = "long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    empty = spark.createDataFrame([], f"`{key}` {kind}")
    vectors = usable(embeddings.select(key, vector), vector)
    common = vectors.groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return empty
    dim, n = common.dim, common["count"]
    blocks = materialize(pack(vectors.where(F.size(vector) == dim), dim, key, vector), "whitening-rows")
    partial = blocks.select("x").mapInArrow(_sums(dim), "at int, total string")
    totals = partial.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("s")).collect()  # a row a dimension
    sums = [int(r.s) for r in sorted(totals, key=lambda r: r["at"])]
    counts = {r.part: r.n for r in blocks.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a task
    offsets, height = [0] * (max(counts) + 1), 0
    for part in sorted(counts):
        offsets[part], height = height, height + counts[part]
    per, wide = rows_of(dim), min(dim, WIDE)
    splits = -(-height * per * dim * 8 // SPLIT)
    path, projected = workspace(spark, "whitening-blocks"), workspace(spark, "whitening-projected")
    grid = blocks.select("part", "local", "x").mapInArrow(_grid(n, sums, offsets, dim), f"i int, j int, m {_MATRIX}")
    grid.withColumn("slab", F.floor(F.col("i") / SLAB)).write.partitionBy("slab").parquet(path)
    v = scatter(block_matrix(spark, path, per, wide, height * per, dim), splits) / n
    e, w = directions(v, most)
    if not len(e):
        return empty
    k, side = len(e), w / np.sqrt(e)
    cells = [((j // WIDE, 0), DenseMatrix(min(WIDE, dim - j), k, side[j : j + WIDE].ravel(order="F").tolist())) for j in range(0, dim, WIDE)]

    def project(slab: int) -> DataFrame:
        own = min(SLAB, height - slab * SLAB)
        a = block_matrix(spark, f"{path}/slab={slab}", per, wide, own * per, dim, slab * SLAB)
        small = BlockMatrix(spark.sparkContext.parallelize(cells, (-(-own // TALL)) ** 2), wide, k, dim, k)
        z = callMLlibFunc("getMatrixBlocks", times(a, small, 1)._java_matrix_wrapper._java_model).toDF("index", "m")
        return z.select((F.col("index._1") + slab * SLAB).cast("int").alias("i"), F.lit(0).alias("j"), "m")

    reduce(DataFrame.union, map(project, range(-(-height // SLAB)))).write.parquet(projected)
    error = float(np.abs(scatter(block_matrix(spark, projected, per, k, height * per, k), splits) / n - np.eye(k)).max())
    explained = (e / np.trace(v)).tolist()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, values, turned in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
                own = np.asarray(x.values, np.int64).reshape(-1, dim)
                out = np.asarray(values.values, np.float64).reshape((per, k) if turned else (k, per))
                out = (out if turned else out.T)[: len(own)]
                m = len(own)
                yield pa.record_batch([
                    ids.values.take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array([d for d in deviations(own, n, sums) for _ in range(k)], pa.int64()), pa.array(out.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ], names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    places = spark.createDataFrame([(p, offsets[p]) for p in sorted(counts)], "part int, first int")  # a row a task
    placed = blocks.join(F.broadcast(places), "part").select((F.col("first") + F.col("local")).alias("i"), "ids", "x")
    z = spark.read.schema(f"i int, j int, m {_MATRIX}").parquet(projected).select(F.col("i").alias("__i"), F.col("m.values").alias("values"), F.col("m.isTransposed").alias("turned"))
    met = placed.join(z, F.col("i") == F.col("__i")).select("ids", "x", "values", "turned")
    return met.mapInArrow(rows, f"`{key}` {kind}")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitened components of every usable embedding."""
    return whiten(read_table(spark, sf_dir, "embeddings"))
