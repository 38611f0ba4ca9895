"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X lie in blocks of a written table. A step multiplies X by a right vector v and
the transpose of X by the left vector u that comes out, one Spark job each; v and u are freed of all
earlier ones, twice. A left vector is as long as the table, so it is never stored: each is X times a known short vector w, and its
products with others are sums that the jobs bring along. The small bidiagonal matrix gives the
components and their deviations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeweave.session import cut_lineage

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Rows in a block, and bytes that a task reads in each product.
BLOCK_ROWS, TASK_BYTES = 1024, 16 << 20
#: Beside the largest deviation, what counts as none.
NOTHING = 1e-11

_OUT = ("vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whole_numbers(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x): floor(scale * c) + shift of each component, of the vectors without a NULL or non-finite one."""
    v = F.col(vector_col).cast("array<double>")
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size(v) > 0)
    x = F.transform(v, lambda c: F.floor(c * scale) + F.lit(shift).cast("long"))
    return rows.filter(v.isNotNull() & whole).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def _centred(mean: np.ndarray):
    """Rows minus the mean, some rows as the bytes of one matrix."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(len(batch), -1) - mean
            for lo in range(0, len(x), BLOCK_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([x[lo:lo + BLOCK_ROWS].tobytes()], pa.binary())], ["m"])
    return pack


def _sums(fn: Callable[[np.ndarray], np.ndarray], d: int):
    """Adds up what ``fn`` makes of each block; a task returns one row per entry."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for cell in batch.column(0):
                part = fn(np.frombuffer(cell.as_buffer(), dtype=np.float64).reshape(-1, d))
                total = part if total is None else total + part
        if total is not None:
            columns = [pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["k", "value"])
    return add


def _total(blocks: DataFrame, fn: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """The sum over all blocks; the driver gets as many numbers as ``fn`` makes of one block."""
    parts = blocks.mapInArrow(_sums(fn, d), "k int, value double").groupBy("k").agg(F.sum("value").alias("value"))
    return np.array([r.value for r in sorted(parts.collect())])


def _forward(w: np.ndarray):
    """Products of X times the last column with X times each column."""
    def fn(x: np.ndarray) -> np.ndarray:
        y = x @ w
        return y.T @ y[:, -1]
    return fn


def _both(w: np.ndarray):
    """The same, and the transpose of X times X times the last column."""
    def fn(x: np.ndarray) -> np.ndarray:
        y = x @ w
        return np.concatenate([y.T @ y[:, -1], x.T @ y[:, -1]])
    return fn


def _gram(w: np.ndarray):
    def fn(x: np.ndarray) -> np.ndarray:
        y = x @ w
        return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])
    return fn


def _freed(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = x - basis @ (basis.T @ x)
    return x


def bidiagonalised(total: Callable[[Callable], np.ndarray], d: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Right vectors as columns, and the upper bidiagonal matrix. ``total`` sums a function of a block over all blocks.

    Where X or its transpose takes a vector to nothing, the recurrence goes on with a new
    vector across all earlier ones, so equal and zero deviations are found as often as they are there."""
    chance = np.random.default_rng(13)
    right, short, back = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    matrix = np.zeros((steps, steps))
    v = chance.normal(size=d)
    v /= np.linalg.norm(v)
    largest = 0.0
    for j in range(steps):
        right = np.column_stack([right, v])
        w = v - short @ total(_forward(np.column_stack([short, v])))[:j]
        sums = total(_both(np.column_stack([short, w])))
        again, square, z = sums[:j], sums[j], sums[j + 1:]
        w, z = w - short @ again, z - back @ again
        alpha = np.sqrt(max(0.0, square - again @ again))
        largest = max(largest, alpha)
        if alpha > NOTHING * largest:
            w, z = w / alpha, z / alpha
            matrix[j, j] = alpha
        else:
            w, z = np.zeros(d), np.zeros(d)
        short, back = np.column_stack([short, w]), np.column_stack([back, z])
        if j + 1 < steps:
            rest = _freed(z, right)
            beta = np.linalg.norm(rest)
            if beta > NOTHING * largest:
                matrix[j, j + 1] = beta
                v = rest / beta
            else:
                v = _freed(chance.normal(size=d), right)
                v /= np.linalg.norm(v)
    return right, matrix


def components_of(total: Callable[[Callable], np.ndarray], d: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit components as columns by falling deviation, and the singular values; those without deviation are left out."""
    right, matrix = bidiagonalised(total, d, min(d, n))
    _, values, turned = np.linalg.svd(matrix)
    some = values > NOTHING * values[0]
    return (right @ turned.T)[:, some], values[some]


def _projector(mean: np.ndarray, w: np.ndarray):
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def project(x: pa.Array) -> pa.Array:
        y = (x.flatten().to_numpy().reshape(len(x), -1) - mean) @ w
        return pa.ListArray.from_arrays(np.arange(0, y.size + 1, w.shape[1], dtype=np.int32), y.ravel())
    return project


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component (from 1, by falling deviation), n (vectors), deviation (sum
    of (n x - S)^2 over the dimensions, exact; beyond a long the query fails), whitened, explained (share of
    all variance), identity_error (largest distance of the whitened covariance from the identity).

    Vectors that are NULL or empty, or hold NULL or a component that is not finite, have no rows. All others are fitted, repeated
    ids and vectors each; of vectors of several lengths the most frequent length is fitted (of equally many, the longest), and the
    others have no rows. Components without variance are left out, so there are fewer than ``components``
    where dimensions or vectors are few or depend on each other, and none for one vector or equal vectors. An
    empty table gives no rows. A component's sign is the same for all rows.

    The driver holds matrices of the vectors' length squared; the table is read twice per dimension."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[id_col]
    found = whole_numbers(rows, id_col, vector_col)
    sizes = cut_lineage(found, "numbers")
    most = sizes.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    nothing = spark.createDataFrame([], _OUT.format(kind))
    if most is None:
        return nothing
    d, n = most.d, most.n
    table = sizes.filter(F.size("x") == d)
    sums = [r.s for r in sorted(table.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("s")).collect())]
    mean = np.array([s / n for s in sums])
    tasks = max(1, -(-n * d * 8 // TASK_BYTES))
    blocks = cut_lineage(table.select("x").repartition(tasks).mapInArrow(_centred(mean), "m binary"), "blocks")

    def total(fn: Callable) -> np.ndarray:
        return _total(blocks, fn, d)

    axes, values = components_of(total, d, n)
    if not len(values):
        return nothing
    kept = min(components, len(values))
    w = axes[:, :kept] / (values[:kept] / np.sqrt(n))
    sums_of = total(_gram(w))
    middle = sums_of[kept * kept:] / n
    error = np.abs(sums_of[:kept * kept].reshape(kept, kept) / n - np.outer(middle, middle) - np.eye(kept)).max()
    explained = values[:kept] ** 2 / (values ** 2).sum()
    away = F.zip_with("x", F.lit(sums).cast("array<long>"), lambda x, s: x * F.lit(n).cast("long") - s)
    deviation = F.aggregate(away, F.lit(0).cast("long"), lambda total, y: total + y * y)
    spread = table.select("vec_id", deviation.alias("deviation"), _projector(mean, w)("x").alias("y"))
    each = F.posexplode(F.arrays_zip("y", F.lit(explained.tolist()).alias("e"))).alias("pos", "at")
    return spread.select("vec_id", "deviation", each).select(
        "vec_id", (F.col("pos") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.col("at.y").alias("whitened"), F.col("at.e").alias("explained"), F.lit(float(error)).alias("identity_error"))
