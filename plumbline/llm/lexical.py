"""Ranked lexical search by NRA: sorted reads alone, with a lower and an upper score for each document.

Documents become counts of the terms that some item has. Each task takes its documents in blocks of bounded size, lists a
block's postings by falling impact for each term, and reads the lists of an item in step from the top. What has been read of a
document is its lower score; what its other lists may still hold, at most the last value read there, makes the upper one.
Reading goes on until no unread document can reach the k-th place and every document that may hold a place has equal
bounds, so places, ties and scores are final. A task keeps its k best of each item over all its blocks, and the k-th score
of earlier blocks is where the next one starts from; the best of all tasks are ranked. No text and no posting is shuffled.

Items are the query set: they are read in blocks of at most ``ITEM_TERMS`` terms, each of which takes one pass over the texts.

Each row of ``docs`` is a document and each row of ``items`` a query of its own, also where rows repeat or share an id. Null and
empty texts have no terms: such documents are never found and such items have no result. Equal scores rank by doc_id, null first.
Other columns play no part, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .text import utf8

# Terms of items (each counted once an item) that travel to the tasks at a time.
ITEM_TERMS = 500_000
# Postings that a task holds at a time, but for those of one document.
BLOCK_POSTINGS = 1_000_000
# Documents of a block times terms of the longest item: marks of what an item has not read.
BLOCK_MARKS = 1 << 23
# Postings read from each list in the first step; every further step reads twice as many.
FIRST_READ = 64
# Bytes of a text that are cut into terms at a time.
_PART = 1 << 20
# Groups in which the best of the tasks are ranked before the last ranking.
_GROUPS = 64

# Terms are runs of ASCII letters and digits and of all that is not ASCII; only A-Z are lower-cased.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def term_counts(data: bytes | None) -> Counter:
    """Occurrences of each term of UTF-8 text."""
    plain, counts, at = (data or b"").translate(_PLAIN), Counter(), 0
    while at < len(plain):
        end = plain.find(b" ", at + _PART)
        end = len(plain) if end < 0 else end
        counts.update(plain[at:end].split())
        at = end
    return counts


def counted_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc, n, terms, tfs) for each (doc, text): all its terms with repeats, and those of the vocabulary by number."""
    schema = T.StructType([docs.schema["doc"], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())),
                           T.StructField("tfs", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for value in utf8(batch.column("text")):
                counts = term_counts(value)
                own = counts.keys() & vocabulary.keys()
                sizes.append(sum(counts.values()))
                terms.append([vocabulary[t] for t in own])
                tfs.append([counts[t] for t in own])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                                              pa.array(tfs, pa.list_(pa.int64()))], names=schema.names)

    return docs.select("doc", "text").mapInArrow(run, schema)


class Postings:
    """The postings of a block of documents, those of a term in a row by falling impact."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        order = np.lexsort((-impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.start[term], self.start[term + 1])
        return self.doc[own], self.impact[own]


def best(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, least: int, first_read: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray]:
    """Documents (0 to ``n_docs`` - 1, in the order that decides ties) with the ``k`` highest sums over ``lists``, and the sums.

    A list is (documents, values), values falling. Only sums of at least ``least``, which is positive, are given.
    """
    lists = [(d, v) for d, v in lists if len(d) and v[0] > 0]
    lower = np.zeros(n_docs)
    unread = np.ones((n_docs, len(lists)))  # sums stay far below 2^53, so doubles hold them exactly
    high = np.array([float(v[0]) for _, v in lists])
    active, at, step = None, 0, first_read
    while True:
        for i, (docs, values) in enumerate(lists):
            own = slice(at, at + step)
            lower[docs[own]] += values[own]
            unread[docs[own], i] = 0
            high[i] = values[at + step - 1] if at + step < len(values) else 0.0
        at += step
        step *= 2
        kth = np.partition(lower, n_docs - k)[n_docs - k] if n_docs >= k else 0.0
        bound = max(float(least), kth)
        if high.sum() >= bound:  # a document not yet met may have a place
            continue
        # From here on documents only leave: upper scores fall and the bound rises.
        active = np.flatnonzero(lower > 0) if active is None else active
        gap = unread[active] @ high
        near = lower[active] + gap >= bound
        active, gap = active[near], gap[near]
        if not gap.any():
            break
    found = active[lower[active] >= bound]
    found = found[np.lexsort((found, -lower[found]))][:k]
    return found, lower[found].astype(np.int64)


def _found(index: DataFrame, items: list[tuple[int, list[int], list[int]]], weight: list[int], n: int, total: int, k: int, block_postings: int) -> DataFrame:
    """(item, doc, score): the k best documents of each item in each task."""
    schema = T.StructType([T.StructField("item", T.LongType()), index.schema["doc"], T.StructField("score", T.LongType())])

    most = BLOCK_MARKS // max([1, *[len(of) for _, of, _ in items]])

    def ranked(ids: list, pairs: list[tuple[int, int]]) -> list[tuple]:
        return sorted(((s, ids[d]) for d, s in pairs), key=lambda x: (-x[0], x[1] is not None, x[1] if x[1] is not None else 0))

    def search(ids: list, sizes: list, terms: list[np.ndarray], tfs: list[np.ndarray], top: dict[int, list]) -> None:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0))
        ids = [ids[i] for i in order]
        lengths = np.array([len(terms[i]) for i in order])
        tf = np.concatenate([tfs[i] for i in order])
        m = 75 + 25 * np.array([sizes[i] for i in order]) * n // max(1, total)
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, lengths))
        block = Postings(np.repeat(np.arange(len(ids)), lengths), np.concatenate([terms[i] for i in order]), impact, len(weight))
        for item, of, times in items:
            lists = [(d, v * (weight[t] * q)) for t, q in zip(of, times) if weight[t] > 0 for d, v in [block.of(t)]]
            known = top.get(item, [])
            docs, scores = best(lists, len(ids), k, known[-1][0] if len(known) >= k else 1)
            if len(docs):
                new = ranked(ids, list(zip(docs.tolist(), scores.tolist())))
                top[item] = sorted(known + new, key=lambda x: (-x[0], x[1] is not None, x[1] if x[1] is not None else 0))[:k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, list] = {}
        held: tuple[list, list, list, list] = ([], [], [], [])
        postings = 0
        for batch in batches:
            columns = [batch.column("doc").to_pylist(), batch.column("n").to_pylist()]
            columns += [[x.values.to_numpy() for x in batch.column(c)] for c in ("terms", "tfs")]
            for row in zip(*columns):
                if not len(row[2]):
                    continue
                for into, value in zip(held, row):
                    into.append(value)
                postings += len(row[2])
                if postings >= block_postings or len(held[0]) >= most:
                    search(*held, top)
                    held, postings = ([], [], [], []), 0
        if held[0]:
            search(*held, top)
        rows = [(item, doc, score) for item, own in top.items() for score, doc in own]
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], kind), pa.array(columns[2], pa.int64())], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(index.schema["doc"].dataType)
    return index.mapInArrow(run, schema)


def weights(index: DataFrame, n_terms: int, n: int) -> list[int]:
    """The weight of each numbered term: 0 where no document has it, so that it can't count."""
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    out = [0] * n_terms
    for row in df.collect():  # at most one row for each term of the items' block
        out[row["term"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * row["df"] + 1)))
    return out


def search(docs: DataFrame, items: DataFrame, *, k: int = 20, text: str = "text", doc_id: str = "doc_id", item_text: str = "text",
           item_id: str = "item_id", item_terms: int = ITEM_TERMS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item with a score above 0, ranks from 1."""
    docs = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    items = cut_lineage(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).withColumn("item", F.monotonically_increasing_id()))
    parts, block, vocabulary = [], [], {}

    def settle() -> None:
        index = cut_lineage(counted_terms(docs, dict(vocabulary)))
        n, total = index.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        parts.append(cut_lineage(_found(index, list(block), weights(index, len(vocabulary), n), n, total or 0, k, block_postings)))

    pairs = 0
    for row in items.select("item", "text").toLocalIterator():  # a stated query set, read in turn
        counts = term_counts(row["text"].encode() if row["text"] else None)
        if block and pairs + len(counts) > item_terms:
            settle()
            block, vocabulary, pairs = [], {}, 0
        if counts:
            block.append((row["item"], [vocabulary.setdefault(t, len(vocabulary)) for t in counts], list(counts.values())))
            pairs += len(counts)
    if block or not parts:
        settle()
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    # First the best of groups of tasks, then of all: no task meets more rows of an item than k for each task of a group.
    order = [F.desc("score"), F.asc_nulls_first("doc")]
    grouped = found.withColumn("group", F.spark_partition_id() % _GROUPS)
    few = grouped.withColumn("rank", F.row_number().over(Window.partitionBy("item", "group").orderBy(*order))).where(F.col("rank") <= k)
    last = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return last.join(items.select("item", "item_id"), "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")
