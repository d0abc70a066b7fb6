"""Whitened principal components of embeddings through distributed block matrices.

Entries become integers on a fixed grid, so that sums are exact. Rows get gapless numbers, which
deal them, centred, into the blocks of a tall block matrix X. The product of its transpose with
itself is the scatter matrix, as wide as a vector, whose eigenvectors are found locally; X times
the whitening matrix, again block by block, gives the projections, and their own product says
how far their covariance is from the identity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .shared import kept_aside

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS, BLOCK_ROWS = 32, 2048
#: Entries from here on have no place on the grid.
LARGEST = 2.0**30
#: Blocks per partition; both factors' blocks of a partition are in memory together.
BLOCKS_TOGETHER = 8
#: Directions with a smaller share of the largest variance have none that could be told apart
#: from rounding.
LEAST_VARIANCE = 1e-11


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor holds null, non-finite or far too large entries."""
    fine = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LARGEST), F.lit(False)))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def _grid(column: pa.Array, dims: int) -> np.ndarray:
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)
    return np.floor(SCALE * c).astype(np.int64) + OFFSET


def _sums(dims: int):
    """Per task: its number, its number of rows, and the sums of their integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, np.int64)
        for batch in batches:
            n += batch.num_rows
            total += _grid(batch["c"], dims).sum(axis=0)
        part = TaskContext.get().partitionId()
        yield pa.record_batch({"part": pa.array([part], pa.int32()), "rows": pa.array([n], pa.int64()), "sums": pa.array([total], pa.list_(pa.int64()))})

    return run


def _squares(v: np.ndarray) -> list[Decimal]:
    """Exact sums of the squares of each row."""
    if len(v) and float(np.abs(v).max()) ** 2 * v.shape[1] < 2.0**62:
        return [Decimal(int(x)) for x in (v * v).sum(axis=1)]
    return [Decimal(sum(x * x for x in row)) for row in v.tolist()]


def _matrix(values: np.ndarray) -> pa.StructArray:
    """One dense matrix in the columnar form of Spark's matrix type."""
    list_of = lambda kind: pa.list_(pa.field("element", kind, nullable=False))
    fields = [
        pa.field("type", pa.int8(), False), pa.field("numRows", pa.int32(), False), pa.field("numCols", pa.int32(), False),
        pa.field("colPtrs", list_of(pa.int32())), pa.field("rowIndices", list_of(pa.int32())),
        pa.field("values", list_of(pa.float64())), pa.field("isTransposed", pa.bool_(), False),
    ]
    row = (1, *values.shape, None, None, np.ascontiguousarray(values.T).ravel(), False)
    return pa.StructArray.from_arrays([pa.array([x], f.type) for x, f in zip(row, fields, strict=True)], fields=fields)


def _read_matrix(column: pa.ChunkedArray) -> np.ndarray:
    m = column.combine_chunks()
    m = m.chunk(0) if isinstance(m, pa.ChunkedArray) else m
    shape = m.field("numCols")[0].as_py(), m.field("numRows")[0].as_py()
    values = m.field("values").flatten().to_numpy()
    return values.reshape(shape[::-1]) if m.field("isTransposed")[0].as_py() else values.reshape(shape).T


def _block_of(n: int, sums: list[int], dims: int):
    """A block's rows in order: their ids, exact deviations, and centred integers as a matrix."""

    def run(key, table):
        table = table.sort_by("at").combine_chunks()
        v = n * _grid(table["c"].combine_chunks(), dims) - np.array(sums, np.int64)
        return pa.table({
            "block": pa.array([key[0].as_py()], pa.int32()),
            "ids": pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), table["id"].combine_chunks()),
            "deviations": pa.array([_squares(v)], pa.list_(pa.decimal128(38, 0))),
            "matrix": _matrix(v / n),
        })

    return run


def _block_matrix(blocks: DataFrame, column: str, block_rows: int, n: int, width: int) -> BlockMatrix:
    rows = blocks.select(F.struct(F.col("block").cast("long"), F.lit(0).cast("long")), F.col(column))
    return BlockMatrix(callMLlibFunc("createBlockMatrix", rows, block_rows, width, n, width), block_rows, width)


def _scatter(x: BlockMatrix, blocks: int) -> np.ndarray:
    """The product of the transpose of a tall matrix with itself. The shared dimension is split,
    so that no task gets more than a few blocks; partial products are added up in tasks."""
    splits = max(1, -(-blocks // BLOCKS_TOGETHER))
    left, right = x.transpose(), x._java_matrix_wrapper._java_model
    product = left._java_matrix_wrapper.call("multiply", right, splits)  # the Python form has no splits
    return BlockMatrix(product, left.rowsPerBlock, x.colsPerBlock).toLocalMatrix().toArray()


def principal_components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of directions that have variance."""
    e, u = np.linalg.eigh((covariance + covariance.T) / 2)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int(np.count_nonzero(e > LEAST_VARIANCE * max(float(e[0]), 0.0)))) if len(e) else 0
    return e[:k], u[:, :k]


def _emit(explained: list[float]):
    """Rows of a block and their projections, a row per component."""
    k = len(explained)

    def run(key, own, projected):
        z = _read_matrix(projected["matrix"])
        ids, deviations = (own[c].combine_chunks().flatten() for c in ("ids", "deviations"))
        row = pa.array(np.repeat(np.arange(len(z)), k))
        return pa.table({
            "vec_id": ids.take(row), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(z))),
            "deviation": deviations.take(row), "whitened": pa.array(np.ascontiguousarray(z).ravel()),
            "explained": pa.array(np.tile(np.array(explained), len(z))),
        })

    return run


def whitened(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of ``vectors`` (``key``, ``column``) projected on their whitened principal components:
    vec_id, component, n, deviation, whitened, explained, identity_error; a row per component.

    Rows whose vector is null, or holds null, non-finite or too large entries (2**30), take no
    part, nor do those whose width isn't the most frequent one (of equally frequent ones the
    largest). n is the number of rows that take part, deviation their squared distance from the
    mean times n squared (decimal, exact). Components are numbered from 1 by falling variance;
    directions without variance are left out, so fewer than ``components`` come out of narrow,
    constant or very few vectors, and none at all where nothing varies. Null and repeated keys
    are rows like others; an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("c")).where(usable(F.col("c")))
    sizes = rows.groupBy(F.size("c").alias("width")).count().where("width > 0").orderBy(F.desc("count"), F.desc("width")).first()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    n, dims = sizes["count"], sizes["width"]

    # the numbers of the rows follow from their places in these partitions, which stay
    fit = kept_aside(rows.where(F.size("c") == dims))
    per_task = kept_aside(fit.select("c").mapInArrow(_sums(dims), "part int, rows long, sums array<long>"))
    total = per_task.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s"))
    sums = [r["s"] for r in total.orderBy("at").collect()]  # as wide as a vector
    until = F.sum("rows").over(Window.orderBy("part"))  # one row per task
    starts = per_task.select("part", (until - F.col("rows")).alias("start"))
    here = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = fit.select("*", F.spark_partition_id().alias("part"), here.alias("here")).join(F.broadcast(starts), "part")
    number = F.col("start") + F.col("here")
    n_blocks = math.ceil(n / block_rows)
    dealt = numbered.select(F.floor(number / block_rows).cast("int").alias("block"), (number % block_rows).alias("at"), "id", "c")
    dealt = dealt.repartition(max(1, math.ceil(n_blocks / BLOCKS_TOGETHER)), "block")
    own = StructType([
        StructField("block", IntegerType()),
        *spark.createDataFrame([], f"ids array<{kind}>, deviations array<decimal(38,0)>").schema.fields,
        StructField("matrix", MatrixUDT()),
    ])
    blocks = kept_aside(dealt.groupBy("block").applyInArrow(_block_of(n, sums, dims), own))

    x = _block_matrix(blocks, "matrix", block_rows, n, dims)
    covariance = _scatter(x, n_blocks) / n
    e, u = principal_components(covariance, components)
    if not len(e):
        return spark.createDataFrame([], schema)
    k = len(e)
    by = Matrices.dense(dims, k, (u / np.sqrt(e)).T.ravel().tolist())
    z = x.multiply(BlockMatrix(spark.sparkContext.parallelize([((0, 0), by)], 1), dims, k))
    projected = callMLlibFunc("getMatrixBlocks", z._java_matrix_wrapper._java_model)
    projected = kept_aside(projected.select(F.col("_1._1").cast("int").alias("block"), F.col("_2").alias("matrix")))
    error = _scatter(_block_matrix(projected, "matrix", block_rows, n, k), n_blocks) / n - np.eye(k)

    explained = (e / np.trace(covariance)).tolist()
    both = blocks.select("block", "ids", "deviations").groupBy("block").cogroup(projected.groupBy("block"))
    out = both.applyInArrow(_emit(explained), f"vec_id {kind}, component int, deviation decimal(38,0), whitened double, explained double")
    return out.select(
        "vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(float(np.abs(error).max())).alias("identity_error"),
    )
