"""Benchmark decontamination by greedy string tiling over words.

Test items are a stated query set; documents are read once for each block of items of about ``BLOCK_WORDS``
words, whatever the number of items. Within a task a document meets only items with which it shares a run of
``min_match`` words (a seed). For such a pair the longest common runs outside earlier tiles are marked again and again, found by
Karp-Rabin hashes of windows, until none of ``min_match`` words is left; moved and interrupted passages are
tiles of their own. The share of the item's words under tiles is its coverage.

Words are runs of letters and digits, lower-cased. Items with fewer than ``min_match`` words are covered when all of their words
stand in the document in one run. Null, empty and word-less texts match nothing, as do word-less items. Of equal long runs the first in the
document, then the first in the item, is marked. Rows that share an id are reported each. Extra columns play no part.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .text import keyed

MIN_MATCH = 5
THRESHOLD = 0.5
# Words of the items that one pass over the documents looks for.
BLOCK_WORDS = 1_000_000
_WORD = re.compile(r"[^\W_]+")
_BASE = 1_000_003
_MASK = (1 << 61) - 1


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _windows(ids: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """Karp-Rabin hash and start of each window of ``size`` free words."""
    power, h, run = pow(_BASE, size, _MASK), 0, 0
    for i, (w, ok) in enumerate(zip(ids, free)):
        if not ok:
            h = run = 0
            continue
        h = (h * _BASE + w + 1) % _MASK
        run += 1
        if run > size:
            h = (h - power * (ids[i - size] + 1)) % _MASK
        if run >= size:
            yield h, i - size + 1


def _matches(doc: list[int], item: list[int], doc_free: list[bool], item_free: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """Starts of free windows of ``size`` words that agree."""
    at: dict[int, list[int]] = {}
    for h, i in _windows(item, item_free, size):
        at.setdefault(h, []).append(i)
    if at:
        for h, d in _windows(doc, doc_free, size):
            for i in at.get(h, ()):
                if doc[d:d + size] == item[i:i + size]:  # the words, not only their hashes
                    yield d, i


def tiles(doc: list[int], item: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, length) of the tiles, longest first; negative words match nothing.

    That a common run of some length exists implies one of every smaller length, so the longest is searched by halving.
    """
    doc_free, item_free = [w >= 0 for w in doc], [w >= 0 for w in item]
    out: list[tuple[int, int, int]] = []
    most = min(len(doc), len(item))
    while next(_matches(doc, item, doc_free, item_free, min_match), None):
        low, high = min_match, most
        while low < high:
            size = (low + high + 1) // 2
            if next(_matches(doc, item, doc_free, item_free, size), None):
                low = size
            else:
                high = size - 1
        for d, i in list(_matches(doc, item, doc_free, item_free, low)):
            if all(doc_free[d:d + low]) and all(item_free[i:i + low]):
                out.append((d, i, low))
                doc_free[d:d + low] = [False] * low
                item_free[i:i + low] = [False] * low
        most = low
    return out


class Items:
    """A block of test items by number of their words, and the seeds that lead to them, in flat arrays."""

    def __init__(self, items: Iterable[tuple[object, str | None]], min_match: int):
        self.names: list = []
        self.number: dict[str, int] = {}
        flat, ends = array("q"), [0]
        for name, text in items:
            self.names.append(name)
            flat.extend([self.number.setdefault(w, len(self.number)) for w in words_of(text)])
            ends.append(len(flat))
        self.flat, self.ends = np.array(flat, np.int64), np.array(ends)
        self.length = np.diff(self.ends)
        self.least = np.minimum(min_match, self.length)
        owner = np.repeat(np.arange(len(self.names)), self.length)
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in set(self.least.tolist()) - {0}:
            h = self.hashes(self.flat, size)
            # Windows within one item, each hash once an item.
            own = np.flatnonzero((owner[:len(h)] == owner[size - 1:]) & (self.least[owner[:len(h)]] == size))
            h, of = h[own], owner[own]
            order = np.lexsort((of, h))
            h, of = h[order], of[order]
            first = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
            keys, starts = np.unique(h[first], return_index=True)
            self.seeds[size] = keys, np.append(starts, first.sum()), of[first].astype(np.int32)

    def words(self, n: int) -> list[int]:
        return self.flat[self.ends[n]:self.ends[n + 1]].tolist()

    @staticmethod
    def hashes(ids: np.ndarray, size: int) -> np.ndarray:
        n = max(0, len(ids) - size + 1)
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(size):
                h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j:j + n].astype(np.uint64) + np.uint64(1)
        return h

    def seeded(self, ids: np.ndarray) -> dict[int, list[int]]:
        """For each item the places in a document at which a seed of it starts."""
        out: dict[int, list[int]] = {}
        strange = np.concatenate([[0], np.cumsum(ids < 0)])
        for size, (keys, starts, owners) in self.seeds.items():
            if len(ids) < size:
                continue
            whole = np.flatnonzero(strange[size:] == strange[:-size])
            if not len(whole):
                continue
            h = self.hashes(ids, size)[whole]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            for hit in np.flatnonzero(keys[at] == h).tolist():
                for n in owners[starts[at[hit]]:starts[at[hit] + 1]].tolist():
                    out.setdefault(n, []).append(int(whole[hit]))
        return out

    def compare(self, text: str | None, threshold: float = 0.0) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(item, tiles) for the items that share a seed with a text; those that too few words of the text can cover are left out."""
        ids = np.array([self.number.get(w, -1) for w in words_of(text)], np.int64)
        for n, places in self.seeded(ids).items():
            least, needed = int(self.least[n]), threshold * int(self.length[n])
            # Only words under a seed can be under a tile, each under one; what lies between is one strange word.
            if least * len(places) < needed:
                continue
            near = np.zeros(len(ids) + 1, bool)
            for j in range(least):
                near[np.array(places) + j] = True
            if near.sum() < needed:
                continue
            kept = np.flatnonzero(near[:-1] | np.concatenate([[False], near[:-2]])) if len(ids) else np.empty(0, np.int64)
            short = np.where(near[kept], ids[kept], -1).tolist()
            yield n, [(int(kept[d]), i, size) for d, i, size in tiles(short, self.words(n), least)]


def overlaps(docs: DataFrame, items: DataFrame, *, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id",
             min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, coverage, n_words, tiles): documents that hold at least ``threshold`` of an item's words."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("item_id", items.schema[item_id].dataType), T.StructField("coverage", T.DoubleType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("tiles", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("doc_start", "item_start", "length")])))])
    body = F.coalesce(F.col(item_text), F.lit(""))
    # Words, or what they take in bytes if they are long.
    size = F.greatest(F.regexp_count(body, F.lit(r"[\p{L}\p{N}]+")).cast("long"), (F.octet_length(body) / 8).cast("long"))
    queried = cut_lineage(items.select(F.col(item_id).alias("name"), body.alias("body"), size.alias("n"), F.monotonically_increasing_id().alias("row")))
    blocks = max(1, -(-(queried.agg(F.sum("n")).first()[0] or 0) // block_words))
    plain = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    kind = plain.schema["d"].dataType

    def search(block: int) -> DataFrame:
        own = queried.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("name", "body").toLocalIterator()
        # About BLOCK_WORDS words, whatever the number of items.
        sent = docs.sparkSession.sparkContext.broadcast([(r["name"], r["body"]) for r in own])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Items(sent.value, min_match)
            for batch in batches:
                rows = []
                for name, value in zip(batch.column("d").to_pylist(), batch.column("t").to_pylist()):
                    for n, found in known.compare(value, threshold):
                        share = sum(f[2] for f in found) / int(known.length[n])
                        if found and share >= threshold:
                            rows.append((name, known.names[n], share, int(known.length[n]),
                                         [{"doc_start": d, "item_start": i, "length": k} for d, i, k in found]))
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, to_arrow(schema))], names=schema.names)

        return plain.mapInArrow(run, schema)

    out = search(0)
    for block in range(1, blocks):
        out = out.union(search(block))
    return out


def to_arrow(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the documents that overlap an item, told by row numbers: ``docs`` has to give the same rows in the same places
    when it is read again, as written tables do. Its columns may have any names."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("at"))
    narrow = rows.select("at", F.col(f"row.`{text}`").alias("text"))
    gone = overlaps(narrow, items, text="text", doc_id="at", **how).select(F.col("doc_id").alias("at")).distinct()
    return rows.join(gone, "at", "left_anti").select("row.*")
