"""Shingle hashing and MinHash signatures: one vectorised Arrow job, no Python work per shingle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WIDTH = 5
# Arithmetic is modulo the Mersenne prime 2^31 - 1, so every product fits 64 bits.
PRIME = np.uint64(2**31 - 1)
BASE = np.uint64(1_000_003)
SECOND_BASE = np.uint64(998_244_353)
# Pads texts shorter than one shingle; larger than any code point.
PAD = 0x110000
# Shingles permuted at a time; keeps the (permutations x shingles) block in the CPU cache.
BLOCK = 512
# Texts whose shingle hashes go out in one batch.
GRAM_ROWS = 64


def _reduce(x: np.ndarray) -> np.ndarray:
    """Modulo PRIME for x below PRIME squared, by folding the high bits."""
    folded = (x & PRIME) + (x >> np.uint64(31))
    return np.minimum(folded, folded - PRIME)  # the difference wraps to a large value below PRIME


def shingle_hashes(text: str, base: np.uint64 = BASE) -> np.ndarray:
    """31-bit hash of every 5-character shingle in order; a shorter text is one shingle by itself.

    A polynomial in the code points, then the fifth power, a bijection modulo this prime that
    breaks up the runs of neighbouring values a polynomial gives.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(points) < WIDTH:
        points = np.concatenate([points, np.full(WIDTH - len(points), PAD, dtype=np.uint64)])
    count = len(points) - WIDTH + 1
    state = np.zeros(count, dtype=np.uint64)
    for i in range(WIDTH):
        state = _reduce(state * base + points[i : i + count] + np.uint64(1))
    square = _reduce(state * state)
    return _reduce(_reduce(square * square) * state)


def gram_hashes(text: str) -> np.ndarray:
    """The distinct shingles as sorted 62-bit numbers, of two hashes each."""
    return np.unique(shingle_hashes(text) << np.uint64(31) | shingle_hashes(text, SECOND_BASE))


def permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the hash family: successive values of the MINSTD generator."""
    values, state = [], seed
    for _ in range(2 * count):
        state = state * 48271 % (2**31 - 1)
        values.append(state)
    table = np.array(values, dtype=np.uint64)
    return table[::2].copy(), table[1::2].copy()


def signature(hashes: np.ndarray, multipliers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minimum of each permuted hash over all shingles, block by block, so memory stays flat."""
    distinct = np.unique(hashes)
    best = np.full(len(multipliers), PRIME, dtype=np.uint64)
    for start in range(0, len(distinct), BLOCK):
        permuted = _reduce(multipliers[:, None] * distinct[None, start : start + BLOCK] + offsets[:, None])
        np.minimum(best, permuted.min(axis=1), out=best)
    return best


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct shingle hashes."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def with_signature(df: DataFrame, text: str, *, num_perm: int = 128, seed: int = 1) -> DataFrame:
    """Replaces the ``text`` column by ``signature``, an array of ``num_perm`` bigints."""
    keep = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*keep, T.StructField("signature", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers, offsets = permutations(num_perm, seed)
        with np.errstate(over="ignore"):
            for batch in batches:
                rows = [
                    signature(shingle_hashes(value.as_py()), multipliers, offsets).view(np.int64)
                    for value in batch.column(text)
                ]
                flat = np.concatenate(rows) if rows else np.empty(0, dtype=np.int64)
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(num_perm))
                lists = pa.ListArray.from_arrays(ends, pa.array(flat))
                columns = [batch.column(f.name) for f in keep]
                yield pa.RecordBatch.from_arrays([*columns, lists], names=[*[f.name for f in keep], "signature"])

    return df.mapInArrow(run, schema)


def with_grams(df: DataFrame, text: str) -> DataFrame:
    """Replaces the ``text`` column by ``grams``, its distinct shingle hashes in order, and their number ``n_grams``."""
    keep = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*keep, T.StructField("grams", T.BinaryType()), T.StructField("n_grams", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                # Hashes take eight times the text, so a batch is given out in parts.
                for start in range(0, batch.num_rows, GRAM_ROWS):
                    part = batch.slice(start, GRAM_ROWS)
                    rows = [gram_hashes(value.as_py()) for value in part.column(text)]
                    columns = [pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([len(r) for r in rows], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in keep], *columns], names=schema.names)

    return df.mapInArrow(run, schema)


def with_jaccard(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Replaces two columns of shingle hashes by the ``jaccard`` of each row."""
    keep = [f for f in pairs.schema.fields if f.name not in (left, right)]
    schema = T.StructType([*keep, T.StructField("jaccard", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in (left, right))
            values = pa.array([jaccard(a, b) for a, b in zip(*sets)], pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], values], names=schema.names)

    return pairs.mapInArrow(run, schema)


def banding(threshold: float, num_perm: int = 128, *, steps: int = 1000) -> tuple[int, int]:
    """Bands and rows that minimise false positives plus false negatives around ``threshold``.

    The chance that two sets of similarity s share a band is 1 - (1 - s^rows)^bands; both error
    areas weigh the same.
    """
    low, high = np.linspace(0, threshold, steps), np.linspace(threshold, 1, steps)
    best = (np.inf, 1, num_perm)
    for bands in range(1, num_perm + 1):
        for rows in range(1, num_perm // bands + 1):
            wrong = np.trapezoid(1 - (1 - low**rows) ** bands, low)
            missed = np.trapezoid((1 - high**rows) ** bands, high)
            best = min(best, (wrong + missed, bands, rows))
    return best[1], best[2]
