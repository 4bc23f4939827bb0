"""Embedding whitening on distributed block matrices: scatter by a transposed product, a local eigenproblem, projection by a second product."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, partitions, table

SCALE, SHIFT, MOST = 64.0, 1_000_000, 1e15
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array of long, with x = floor(64 * entry) + 1000000) of the vectors that are whole: not null, not empty, all entries finite."""
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform("embedding", lambda c: F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.lit(SCALE) * c))).cast("long") + F.lit(SHIFT).cast("long"))
    pick = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return pick.where(F.size("embedding") > 0).where(whole).select("vec_id", scaled.alias("x"))


def _pack(rows: int):
    """Rows to blocks of `rows`, in the order they come; a task's last block may be shorter."""
    def block(part, nth, ids, xs):
        return pa.RecordBatch.from_pydict({"part": [part], "nth": [nth], "ids": [ids], "x": [np.stack(xs).tobytes()]}, schema=SCHEMA)

    def run(batches):
        from pyspark import TaskContext

        part, nth, ids, xs = TaskContext.get().partitionId(), 0, [], []
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else []
            for vec_id, x in zip(batch.column(0).to_pylist(), flat):
                ids.append(vec_id)
                xs.append(x)
                if len(ids) == rows:
                    yield block(part, nth, ids, xs)
                    nth, ids, xs = nth + 1, [], []
        if ids:
            yield block(part, nth, ids, xs)

    SCHEMA = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("ids", pa.list_(pa.int64())), ("x", pa.binary())])
    return run


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S exactly, as 64-bit integers where they fit and as Python's otherwise."""
    small = n * int(np.abs(x).max(initial=0)) < 2**62 and max(map(abs, sums), default=0) < 2**62
    return n * x - np.array(sums, np.int64) if small else n * x.astype(object) - np.array(sums, object)


def _centred(x: bytes, n: int, sums: list[int], rows: int) -> DenseMatrix:
    """A block of rows less their mean, filled up with rows of zeros, which add nothing to a scatter."""
    out = np.zeros((rows, len(sums)))
    part = deviations(np.frombuffer(x, np.int64).reshape(-1, len(sums)), n, sums).astype(float) / n
    out[: len(part)] = part
    return DenseMatrix(rows, len(sums), out.ravel(order="F"))


def _product(a: BlockMatrix, b: BlockMatrix, splits: int) -> BlockMatrix:
    """a times b, the inner dimension dealt over `splits` groups of blocks, so that a product of few result blocks is not one task's."""
    java = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, a.rowsPerBlock, b.colsPerBlock)


def covariance(blocks: BlockMatrix, n: int, splits: int) -> np.ndarray:
    """Transposed product of centred rows with themselves over n; its side is the dimension of a row."""
    return _product(blocks.transpose(), blocks, splits).toLocalMatrix().toArray() / n


def principal(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues falling, whitening matrix, which of them are above rounding) of the first `most` components of a covariance."""
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    real = values > 4 * len(v) * np.finfo(float).eps * max(np.trace(v), 0.0)
    return values, np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), 0.0), real


def whiten(vectors: DataFrame, components: int = 32, block_cells: int = 1 << 16) -> DataFrame:
    """Rows of `vectors` (vec_id, embedding) projected on the first `components` principal components and scaled to variance 1.

    Returns a row per vector and component: vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained,
    identity_error. Entries are taken as x = floor(64 * entry) + 1000000; n vectors with sums S are the fit list. deviation is the exact sum of
    (n*x - S)^2 over dimensions, null if no long holds it.

    Centred rows are indexed into blocks of about `block_cells` numbers. The scatter is a transposed block product, dealt over groups of blocks;
    only that square matrix, as wide as a vector, is solved on the driver. The whitening matrix is one block that meets every block of rows.

    Null, empty and non-finite vectors take no part. Of vectors of several lengths, those of the most frequent length do (ties: the
    longer). A null vec_id stays null; repeated rows count and return repeatedly; entries beyond 1e15 / 64 are taken as that; other columns are ignored. An empty
    table gives an empty result. A component whose eigenvalue is rounding (all vectors alike, or fewer than dimensions) is 0 for every row and
    takes no part in identity_error.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors)
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], RESULT)
    d, n = sizes["d"], sizes["count"]
    rows = rows.where(F.size("x") == d)
    totals = rows.select(F.posexplode("x").alias("dim", "x")).groupBy("dim").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect()
    sums = [int(r.s) for r in sorted(totals)]
    per = max(16, min(8192, block_cells // d))
    packed = durable(rows.mapInArrow(_pack(per), "part int, nth int, ids array<long>, x binary"))
    counts, offsets, at = packed.groupBy("part").count().collect(), [], 0
    for part, found in sorted(map(tuple, counts)):  # a row per task of the scan
        offsets.append((part, at))
        at += found
    numbered = packed.join(F.broadcast(spark.createDataFrame(offsets, "part int, first long")), "part").select((F.col("first") + F.col("nth")).alias("block"), "ids", "x")
    splits = min(at, max(partitions(spark), at // 64))
    matrix = lambda blocks, width: BlockMatrix(blocks, per, width, at * per, width)
    x = matrix(numbered.select("block", "x").rdd.map(lambda r: ((r.block, 0), _centred(r.x, n, sums, per))), d)
    v = covariance(x, n, splits)
    values, w, real = principal(v, min(components, d))
    k = w.shape[1]
    whitening = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(d, k, w.ravel(order="F")))], 1), d, k, d, k)
    projected = _product(x, whitening, 1).blocks.map(lambda b: (b[0][0], bytearray(np.ascontiguousarray(b[1].toArray()).tobytes())))
    whole = durable(numbered.join(spark.createDataFrame(projected, "block long, y binary"), "block"))

    def moments(batches):
        for batch in batches:
            for ids, y in zip(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_pydict({"dim": np.arange(k, dtype=np.int32), "s": np.frombuffer(y.as_py()).reshape(-1, k)[: len(ids)].sum(axis=0)})

    found = whole.select("ids", "y").mapInArrow(moments, "dim int, s double").groupBy("dim").agg(F.sum("s").alias("s")).collect()
    mean = np.array([r.s for r in sorted(found)]) / n

    def less_mean(r):
        y = np.frombuffer(r.y).reshape(-1, k).copy()
        y[: len(r.ids)] -= mean
        return (r.block, 0), DenseMatrix(per, k, y.ravel(order="F"))

    c = covariance(matrix(whole.select("block", "ids", "y").rdd.map(less_mean), k), n, splits)
    error = float(np.abs(c - np.eye(k))[np.ix_(real, real)].max(initial=0.0))
    explained = values / max(np.trace(v), np.finfo(float).tiny)

    def spread(batches):
        for batch in batches:
            for ids, cells, y in zip(*batch.columns):
                m = len(ids)
                off = deviations(np.frombuffer(cells.as_py(), np.int64).reshape(m, d), n, sums)
                exact = off if off.dtype != object and int(np.abs(off).max(initial=0)) ** 2 * d < 2**62 else off.astype(object)
                square = [int(s) if s < 2**63 else None for s in (exact * exact).sum(axis=1)]
                row = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    ids.values.take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), pa.array(square, pa.int64()).take(row),
                    pa.array(np.frombuffer(y.as_py()).reshape(-1, k)[:m].ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whole.select("ids", "x", "y").mapInArrow(spread, RESULT)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
