"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

An n-gram's value in a document is whether it occurs there, times the log of how much likelier it is in toxic
training documents than in others. A logistic model over these values is fitted to a bounded sample of the labelled
rows (``SAMPLE_ROWS``); counts, ratios and weights come from that sample, every document is scored on its whole text.
N-grams are those of lower-cased words with a blank at both ends, hashed to ``BUCKETS``.

Null, empty and word-less texts have the model's base score. Rows of a document labelled twice count twice; labels that are
null, or of no document, count for nothing. Without labelled rows of both kinds the score is 0. Other columns stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .text import added, extend

# Labelled texts the model is fitted to at most (in expectation; drawn by a hash of doc_id and text).
SAMPLE_ROWS = 12_000
BUCKETS = 1 << 18
ORDERS = (3, 4, 5, 6)
# N-grams that the fit may weigh: those whose ratio is surest. All others have weight 0.
KEPT_BUCKETS = 20_000
# Code points of a long text that are hashed at a time.
CHUNK = 1 << 20


def _part(points: np.ndarray, wanted: np.ndarray | None) -> np.ndarray:
    """Distinct buckets of the n-grams that start in ``points``, blanks being 32; no n-gram has a blank inside."""
    blanks = np.concatenate([[0], np.cumsum(points == 32)])
    out, h = [], points
    with np.errstate(over="ignore"):
        for n in range(2, max(ORDERS) + 1):
            if len(points) < n:
                break
            h = h[:-1] * np.uint64(0x100000001B3) + points[n - 1:]
            if n in ORDERS:
                whole = blanks[n - 1:len(points)] == blanks[1:len(points) - n + 2]
                mixed = (h[whole] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                bucket = (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)
                out.append(bucket if wanted is None else bucket[wanted[bucket]])
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.int32)


def gram_buckets(text: str | None, wanted: np.ndarray | None = None) -> np.ndarray:
    """The distinct buckets of a text, of those ``wanted``."""
    points = np.frombuffer(" ".join((text or "").lower().split()).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    if not len(points):
        return np.empty(0, np.int32)
    points = np.concatenate([[np.uint64(32)], points, [np.uint64(32)]])
    reach = max(ORDERS) - 1
    parts = [_part(points[at:at + CHUNK + reach], wanted) for at in range(0, max(1, len(points) - reach), CHUNK)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def sample(docs: DataFrame, labels: DataFrame, train: Column, *, text: str, doc_id: str, label: str, rows: int) -> DataFrame:
    """(label, text) of at most about ``rows`` labelled texts, drawn by a hash of id and text; equal rows are one example."""
    marked = labels.where(train & F.col(label).isin(0, 1)).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("label")).distinct()
    plain = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).withColumn("_text", F.xxhash64("text"))
    named = cut_lineage(plain.select("_id", "_text").join(marked, "_id").distinct())
    share = min(1.0, rows / max(1, named.count()))
    drawn = named.where(F.pmod(F.xxhash64("_id", "_text"), F.lit(1_000_000)) < int(share * 1_000_000))
    # The texts drawn are at most about SAMPLE_ROWS.
    found = plain.join(F.broadcast(drawn), ["_id", "_text"])
    return found.groupBy("_id", "_text", "label").agg(F.first("text").alias("text")).select("label", "text")


def ratios(examples: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Log-count ratio of each bucket, documents with it, and the number of training documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            for label, value in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                count[label, gram_buckets(value)] += 1
                count[label, BUCKETS] += 1  # the documents themselves
        at = np.flatnonzero(count.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[0, at]), pa.array(count[1, at])], names=["bucket", "n0", "n1"])

    sums = examples.mapInArrow(run, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    count = np.zeros((2, BUCKETS + 1))
    count[0, sums["bucket"]], count[1, sums["bucket"]] = sums["n0"], sums["n1"]
    total = count[:, BUCKETS]
    p = (count[:, :BUCKETS] + 1) / (total[:, None] + 2)
    return np.log(p[1] / p[0]), count[:, :BUCKETS].sum(axis=0), int(total.min())


def fit(examples: DataFrame, *, steps: int = 120, l2: float = 8.0) -> tuple[np.ndarray, float]:
    """Weight of each bucket (ratio times fitted weight) and the bias."""
    ratio, seen, fewer = ratios(examples)
    if not fewer:
        return np.zeros(BUCKETS), -math.inf
    sure = np.abs(ratio) * np.sqrt(seen)
    sure[seen < 3] = 0
    wanted = np.zeros(BUCKETS, bool)
    wanted[np.argsort(-sure, kind="stable")[:KEPT_BUCKETS]] = True
    wanted &= sure > 0
    number = np.cumsum(wanted) - 1
    size, scale = int(wanted.sum()), ratio[wanted]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [number[gram_buckets(v, wanted)].astype(np.int32) for v in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.list_(pa.int32()))], names=["label", "at"])

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        # Hash order makes the fit independent of how rows arrive.
        rows = [(xxhash.xxh64_intdigest(np.asarray(a, np.int32).tobytes()), int(y), np.asarray(a, np.int64)) for a, y in zip(frame["at"], frame["label"])]
        rows.sort(key=lambda r: r[:2])
        y = np.array([r[1] for r in rows], np.float64)
        lens = np.array([len(r[2]) for r in rows])
        at = np.concatenate([r[2] for r in rows]) if len(rows) else np.empty(0, np.int64)
        of = np.repeat(np.arange(len(rows)), lens)
        x = scale[at]
        w, bias = np.zeros(size), 0.0
        speed, rate = np.zeros(size + 1), 0.1
        mean = np.zeros(size + 1)
        for step in range(1, steps + 1):  # Adam over the whole sample
            z = np.bincount(of, x * w[at], len(rows)) + bias
            r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            g = np.append(np.bincount(at, x * r[of], size) + l2 * w, r.sum()) / len(rows)
            mean, speed = 0.9 * mean + 0.1 * g, 0.999 * speed + 0.001 * g * g
            move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.999**step)) + 1e-8)
            w, bias = w - move[:-1], bias - move[-1]
            rate = 0.1 * (1 - step / steps) + 0.002
        return pd.DataFrame({"w": [w], "bias": [bias]})

    table = examples.mapInArrow(features, "label int, at array<int>")
    # One task fits the bounded sample.
    learned = table.groupBy(F.lit(1).alias("all")).applyInPandas(train, "w array<double>, bias double").first()
    weights = np.zeros(BUCKETS)
    weights[wanted] = np.array(learned["w"]) * scale
    return weights, float(learned["bias"])


def score(docs: DataFrame, model: tuple[np.ndarray, float], *, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the chance of label 1, and ``predicted``."""
    weights, bias = model
    schema = added(docs, [("score", T.DoubleType()), ("predicted", T.IntegerType())])
    sent = docs.sparkSession.sparkContext.broadcast((weights, bias))  # one number for each of the BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        wanted = weights != 0
        for batch in batches:
            z = np.array([weights[gram_buckets(v, wanted)].sum() for v in batch.column(text).to_pylist()]) + bias
            p = np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -500, 500))))
            yield extend(batch, schema, {"score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))})

    return docs.mapInArrow(run, schema)


def classifier(docs: DataFrame, labels: DataFrame, train: Column, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
               rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """The model of the labelled rows (columns ``doc_id`` and ``label`` of ``labels``) for which ``train`` holds."""
    return fit(cut_lineage(sample(docs, labels, train, text=text, doc_id=doc_id, label=label, rows=rows)))
