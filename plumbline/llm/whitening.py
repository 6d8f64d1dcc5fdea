"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Vectors become whole numbers, floor(scale * entry), and each distinct one is a row of the fitted matrix. A step of the
bidiagonalisation is one pass over that matrix, kept in packed blocks: tasks multiply their centred rows by the newest right
vector and send back sums alone, the products with the left vectors so far and the transposed product. Left vectors are as long
as the matrix and are never kept: a task has its rows of them again from the right vectors and the triangular
coefficients, so a lost executor costs its blocks alone. Both sides are orthogonalised against all vectors before. The
singular values and vectors of the small bidiagonal matrix give deviations and components.

A vector counts if it is not null, holds no null or non-finite entry and has the most frequent length (of ties the longest);
other rows are left out. Directions without variance have no component, so one distinct vector, or none, gives no component. Repeated
rows each get their result, but count once in the fit. Where components have equal variance any basis of theirs may come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

SEED = 11
# Rows of the matrix in one packed block, and bytes of the matrix for a task.
BLOCK_ROWS = 2048
TASK_BYTES = 64 << 20
# Partial sums that the driver adds up; more are added up by tasks first.
DRIVER_PARTS = 256
# Up to this many dimensions every step is taken; beyond, steps end once the components have converged.
ALL_STEPS = 128
# Share of the total variance below which a direction has none.
LEAST_SHARE = 1e-12


@dataclass
class Whitening:
    """n rows with sums per dimension; unit components as columns, their variances, and the total variance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0
    steps: int = 0
    dims: int = field(init=False)

    def __post_init__(self) -> None:
        self.dims = len(self.sums)


def whole_numbers(rows: DataFrame, vector: str, scale: float) -> DataFrame:
    """(row, x) for rows whose vector counts, but for its length; ``row`` holds all the caller's columns."""
    entries = F.transform(F.col(vector), lambda c: c.cast("double"))
    sound = F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    held = rows.select(F.struct(*rows.columns).alias("row"), entries.alias("v")).where(F.coalesce(sound, F.lit(False)))
    return held.select("row", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x"))


def packed(distinct: DataFrame, dims: int) -> DataFrame:
    """(block): up to ``BLOCK_ROWS`` rows of ``x`` each as little-endian 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("x").flatten().to_numpy().astype("<i8").reshape(-1, dims)
            blocks = [values[i:i + BLOCK_ROWS].tobytes() for i in range(0, len(values), BLOCK_ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], names=["block"])

    return distinct.select("x").mapInArrow(run, "block binary")


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for value in batch.column("block").to_pylist():
            yield np.frombuffer(value, "<i8").reshape(-1, dims)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: 64-bit where that holds it, else as Python's numbers."""
    most = max([abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))], default=0)
    if n * most + max(map(abs, sums), default=0) < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (deviations(x, n, sums) / n).astype(np.float64)


def summed(matrix: DataFrame, length: int, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum over all tasks of ``part``, an array of ``length`` doubles for the blocks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([part(batches)], pa.list_(pa.float64()))], names=["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            total += batch.column("sums").flatten().to_numpy().reshape(-1, length).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])

    parts, tasks = matrix.mapInArrow(run, "sums array<double>"), matrix.rdd.getNumPartitions()
    while tasks > DRIVER_PARTS:
        tasks = -(-tasks // DRIVER_PARTS)
        parts = parts.repartition(tasks).mapInArrow(add, "sums array<double>")
    return np.sum([np.zeros(length), *[row["sums"] for row in parts.collect()]], axis=0)


def column_sums(matrix: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dims, object)
        for x in _blocks(batches, dims):
            n += len(x)
            most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
            sums = sums + (x if most * len(x) < 1 << 62 else x.astype(object)).sum(axis=0)
        values = [Decimal(n), *[Decimal(int(s)) for s in sums]]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims + 1), pa.int32()), pa.array(values, pa.decimal128(38, 0))], names=["place", "s"])

    got = matrix.mapInArrow(run, "place int, s decimal(38,0)").groupBy("place").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()
    by = {row["place"]: int(row["s"]) for row in got}
    return by.get(0, 0), [by.get(i + 1, 0) for i in range(dims)]


def _orthogonal(v: np.ndarray, against: list[np.ndarray]) -> np.ndarray:
    """``v`` less its parts along unit vectors, twice, as once leaves rounding errors."""
    for _ in range(2):
        for u in against:
            v = v - u * (u @ v)
    return v


def bidiagonal(matrix: DataFrame, n: int, sums: list[int], wanted: int, apart_from: list[np.ndarray], all_steps: int,
               tolerance: float = 1e-13) -> tuple[np.ndarray, np.ndarray, int]:
    """Variances and unit components, falling, of the centred rows within the space orthogonal to ``apart_from``; and the steps taken."""
    dims, rng = len(sums), np.random.default_rng(SEED)
    most = dims - len(apart_from)
    right: list[np.ndarray] = []
    below = np.zeros((0, 0))  # takes products with the right vectors to left vectors
    left_products = np.zeros((dims, 0))  # transposed products of the left vectors
    alpha: list[float] = []
    beta: list[float] = []

    def fresh() -> np.ndarray:
        v = _orthogonal(rng.standard_normal(dims), apart_from + right)
        return v / np.linalg.norm(v)

    v = fresh() if most else None
    while v is not None:
        right.append(v)
        k, basis, known = len(right), np.array(right).T, below

        def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros(1 + k - 1 + dims)
            for x in _blocks(batches, dims):
                rows = centred(x, n, sums) / np.sqrt(n)
                products = rows @ basis
                left, p = products[:, :k - 1] @ known, products[:, k - 1]
                out[:k - 1] += left.T @ p
                # Parts along earlier left vectors are removed twice: what the first pass leaves shows in the second.
                out[k - 1] += p @ p
                out[k:] += rows.T @ p
            return out

        got = summed(matrix, 1 + k - 1 + dims, part)
        along, square, product = got[:k - 1], got[k - 1], got[k:]
        size = np.sqrt(max(0.0, square - along @ along))
        scale = max([*alpha, *beta, size])
        if scale == 0 or size <= 1e-10 * max(scale, np.sqrt(square)):  # the rows have nothing along this vector
            size = 0.0
        alpha.append(size)
        grown = np.zeros((k, k))
        grown[:k - 1, :k - 1] = below
        if size:
            grown[:k - 1, k - 1] = -(below @ along) / size
            grown[k - 1, k - 1] = 1 / size
            product = (product - left_products @ along) / size
        else:
            product = np.zeros(dims)
        below = grown
        left_products = np.column_stack([left_products, product])
        rest = _orthogonal(product - size * v, apart_from + right)
        length = np.linalg.norm(rest)
        small = length <= 1e-12 * max([*alpha, *beta, 1e-300])
        # Nothing is left along the path: another start finds what is orthogonal to it.
        beta.append(0.0 if small else length)
        values, vectors, last = _small_svd(alpha, beta)
        done = k >= most or most > all_steps and not small and len(values) >= wanted and (
            beta[-1] * np.abs(last[:wanted]) <= tolerance * max(values[0], 1e-300)).all()
        if done:
            return values**2, basis @ vectors, k
        v = fresh() if small else rest / length
    return np.zeros(0), np.zeros((dims, 0)), 0


def _small_svd(alpha: list[float], beta: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Singular values of the bidiagonal matrix, right vectors as columns, and the last entry of each left vector."""
    left, values, right = np.linalg.svd(np.diag(alpha) + np.diag(beta[:-1], 1))
    return values, right.T, left[-1]


def fit(rows: DataFrame, *, vector: str = "embedding", scale: float = 256.0, components: int = 4, all_steps: int = ALL_STEPS) -> Whitening:
    """The mean and the leading components of the distinct whole-number vectors of ``rows``."""
    xs = whole_numbers(rows, vector, scale).select("x").distinct()
    xs = cut_lineage(xs)
    lengths = {r["d"]: r["n"] for r in xs.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(1000).collect()}
    dims = max(lengths, key=lambda d: (lengths[d], d), default=0)
    if not dims:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    held = xs.where(F.size("x") == dims)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-lengths[dims] * dims * 8 // TASK_BYTES))
    matrix = cut_lineage(packed(held.repartition(tasks), dims))
    n, sums = column_sums(matrix, dims)

    def spread(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        return np.array([sum(float((centred(x, n, sums) ** 2).sum()) for x in _blocks(batches, dims)) / n])

    trace = float(summed(matrix, 1, spread)[0])
    values, vectors, steps = bidiagonal(matrix, n, sums, components, [], all_steps)
    if steps < dims:
        # Steps follow one start, which meets one direction of each variance: look for others of like variance.
        while True:
            found = [vectors[:, i] for i in range(min(components, len(values)))]
            more, new, extra = bidiagonal(matrix, n, sums, 1, found, all_steps, 1e-9)
            steps += extra
            if len(found) >= components and (not len(more) or more[0] <= values[components - 1] * (1 + 1e-9)) or not len(more):
                break
            order = np.argsort(-np.append(values[:len(found)], more[0]), kind="stable")
            values, vectors = np.append(values[:len(found)], more[0])[order], np.column_stack([*found, new[:, 0]])[:, order]
    held_ = values[:components] > LEAST_SHARE * trace
    model = Whitening(n, sums, vectors[:, :components][:, held_], values[:components][held_], trace, steps=steps)
    c = len(model.variances)
    if c:
        def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros(c + c * c)
            for x in _blocks(batches, dims):
                y = centred(x, n, sums) @ model.vectors / np.sqrt(model.variances)
                out += np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])
            return out / n

        got = summed(matrix, c + c * c, moments)
        covariance = got[c:].reshape(c, c) - np.outer(got[:c], got[:c])
        model.identity_error = float(np.abs(covariance - np.eye(c)).max())
    return model


def whiten(rows: DataFrame, model: Whitening, *, vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(row, deviation, whitened): the caller's columns as one struct, n² times the squared distance from the mean, exact (null
    where a long doesn't hold it), and the values along the components."""
    held = whole_numbers(rows, vector, scale).where(F.size("x") == model.dims)
    schema = T.StructType([held.schema["row"], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().astype(np.int64).reshape(-1, max(1, model.dims))
            far = deviations(x, model.n, model.sums)
            most = int(max(abs(far.max(initial=0)), abs(far.min(initial=0))))
            squares = ((far if most * most * model.dims < 1 << 63 else far.astype(object)) ** 2).sum(axis=1)
            squares = [s if s < 1 << 63 else None for s in squares.tolist()]
            y = (far / model.n).astype(np.float64) @ model.vectors / np.sqrt(model.variances)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(squares, pa.int64()), pa.array(list(y), pa.list_(pa.float64()))], names=schema.names)

    return held.mapInArrow(run, schema)
