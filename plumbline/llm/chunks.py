"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text; a chunk ends where the hash of the last ``WINDOW`` bytes is small, and
where it is the smallest within ``REACH`` bytes either way, so that monotonous text is cut too. So ends depend on nearby bytes alone, and an insertion shifts no chunk but those it touches. A digest covers a chunk and the
next one: two texts that share it share both chunks side by side. Chained digests found in several documents make
up a repeated passage. Each pair of chunks is kept in the document with the smallest doc_id that holds it, so a document may
keep some of what it shares and hold, inside of it, what an earlier one keeps; these are passages of their own.

Ends of a passage that lie inside a chunk are not seen: a passage is found a chunk short at each side, about
``AVERAGE`` bytes, so ``MIN_WORDS`` is set well below the passages that are to be caught. Null, empty and one-chunk texts have no
digest. Rows that share a doc_id are one document: what repeats only among them is no repeat. A row without a doc_id is a
document by itself, told from others by its text and earlier than all with a doc_id. Offsets are those of the row with the text
hash ``row``. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.skew import skew_join
from ..session import cut_lineage
from .text import added, extend, utf8, word_spans

WINDOW = 16
AVERAGE = 24
REACH = 64
# Words that the chained chunks of a passage hold at least; passages of 50 words and more hold as many.
MIN_WORDS = 25
NO_ID = -(2**63)
# Bits of the filter by which documents know digests that can't be shared: sixteen for each shared digest, within these bounds. Beyond the
# upper one, 2^28 bits for 17 million digests, it lets more through, which costs shuffled rows and changes nothing else.
FILTER_BITS = (1 << 20, 1 << 28)
_GEAR = np.random.default_rng(20).integers(0, 1 << 16, 256, dtype=np.uint16)


def chunk_ends(data: bytes, average: int = AVERAGE) -> np.ndarray:
    """Where chunks end; the last end is the length of the text."""
    gear = _GEAR[np.frombuffer(data, np.uint8)]
    h = gear.copy()
    for j in range(1, WINDOW):
        h[j:] += gear[:-j] << np.uint16(j) if j < len(gear) else 0
    small = h < (1 << 16) // average
    small[:WINDOW - 1] = False
    gaps = np.diff(np.concatenate([[-1], np.flatnonzero(small), [len(h)]]))
    if gaps.max() > REACH:  # elsewhere a small hash is near
        h[:WINDOW - 1] = np.iinfo(np.uint16).max
        padded = np.full(len(h) + 2 * REACH, np.iinfo(np.uint16).max, np.uint16)
        padded[REACH:-REACH] = h
        least, width = padded, 1
        while 2 * width <= 2 * REACH + 1:  # minima of windows twice as wide
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        rest = 2 * REACH + 1 - width
        least = np.minimum(least[:len(least) - rest], least[rest:]) if rest else least
        small |= h <= least[:len(h)]
        small[:WINDOW - 1] = False
    ends = np.flatnonzero(small) + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def windows(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", average: int = AVERAGE, places: bool = True,
            wanted: Broadcast | None = None) -> DataFrame:
    """(doc, row, digest) and, with ``places``, ``span`` and ``words``: for each chunk with a successor, offsets where both start and end.

    ``row`` is a hash of the text; without ``places`` 0 where there is a doc_id. ``span`` holds byte offsets, ``words`` counts of words that start before them, two 32-bit numbers each.
    ``wanted`` is a filter made by :func:`digest_filter`.
    """
    names = ["doc", "row", "digest", "span", "words"] if places else ["doc", "row", "digest"]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if wanted is None else wanted.value
        for batch in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            for doc, row, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
                if not data:
                    continue
                ends = chunk_ends(data, average)
                if len(ends) < 2:
                    continue
                start, end = np.concatenate([[0], ends[:-2]]), ends[1:]
                digest = np.array([xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(start.tolist(), end.tolist())], np.uint64).view(np.int64)
                made = (np.full(len(start), doc, np.int64), np.full(len(start), row, np.int64), digest)
                if places:
                    first = word_spans(data)[0]
                    made += (start << 32 | end, np.searchsorted(first, start) << 32 | np.searchsorted(first, end))
                    if bits is not None:
                        at = digest.view(np.uint64) & np.uint64(64 * len(bits) - 1)
                        hit = bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1
                        made = tuple(c[hit] for c in made)
                else:
                    digest = np.unique(digest)  # a document counts once for each digest
                    made = (made[0][:len(digest)], made[1][:len(digest)], digest)
                parts.append(made)
            columns = [np.concatenate(c).astype(np.int64) for c in zip(*parts)] or [np.empty(0, np.int64)] * len(names)
            for at in range(0, max(1, len(columns[0])), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at:at + 50_000]) for c in columns], names=names)

    row = F.xxhash64(text) if places else F.when(F.col(doc_id).isNull(), F.xxhash64(text)).otherwise(F.lit(0))
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)), row, F.col(text)).mapInArrow(run, schema)


def digest_filter(digests: DataFrame, *, within: tuple[int, int] = FILTER_BITS) -> Broadcast:
    """One bit for each value of the low bits of a digest: set if some digest has it."""
    bits = min(within[1], max(within[0], 1 << (16 * digests.count()).bit_length()))
    at = F.col("digest").bitwiseAND(F.lit(bits - 1))
    words = digests.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(digest & 63 AS int))").alias("bit"))
    table = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.uint64)
    out[table.column("word").to_numpy()] = table.column("bit").to_numpy().view(np.uint64)
    return digests.sparkSession.sparkContext.broadcast(out)


def repeated_passages(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", average: int = AVERAGE, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, row, start, end, n_words, first_doc_id, kept): passages in byte offsets that stand in another document too.

    ``first_doc_id`` is the smallest doc_id with the passage, the document's own where it keeps it (``kept``); parts of fewer
    than ``min_words`` words that a still earlier one has do not cut a passage. Passages that touch hold ``min_words`` together.
    """
    how = {"text": text, "doc_id": doc_id, "average": average}
    no_id = F.when(F.col("doc") == NO_ID, F.col("row"))
    sums = windows(docs, places=False, **how).groupBy("digest").agg(
        F.min("doc").alias("first"), F.max("doc").alias("last"), F.min(no_id).alias("first_row"), F.max(no_id).alias("last_row"), F.count("*").alias("n"))
    shared = cut_lineage(sums.where((F.col("first") < F.col("last")) | (F.col("first_row") < F.col("last_row"))).select(
        "digest", "first", F.coalesce("first_row", F.lit(0)).alias("first_row"), "n"))
    hits = skew_join(windows(docs, wanted=digest_filter(shared), **how), shared.drop("n"), ["digest"], sizes=shared.select("digest", "n"))
    # A list is as long as one row's text: rows that are wholly equal have the same windows, which count once.
    hits = hits.groupBy("doc", "row", "span").agg(F.min(F.struct("words", "first", "first_row")).alias("w"))
    lists = hits.groupBy("doc", "row").agg(F.collect_list(F.struct("span", "w.words", "w.first", "w.first_row")).alias("own"))
    schema = T.StructType([*[T.StructField(n, T.LongType()) for n in ("doc_id", "row", "start", "end", "n_words", "first_doc_id")], T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            own = batch.column("own")
            flat, offsets = own.values, own.offsets.to_numpy()
            fields = [flat.field(i).to_numpy() for i in range(4)]
            for k, (doc, row) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("row").to_pylist())):
                rows.extend(_passages(doc, row, *[f[offsets[k]:offsets[k + 1]] for f in fields], min_words))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:6]], pa.array(columns[6], pa.bool_())], names=schema.names)

    return lists.mapInArrow(run, schema).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID))).withColumn("first_doc_id", F.nullif("first_doc_id", F.lit(NO_ID)))


def _passages(doc: int, row: int, span: np.ndarray, words: np.ndarray, first: np.ndarray, first_row: np.ndarray, min_words: int) -> Iterator[tuple]:
    """Chains windows that overlap by a chunk and cuts the chains where the keeper changes.

    A chain's keeper is the latest of the first documents of its windows. Windows in a row that earlier documents have and
    that hold enough words are cut out and treated likewise; fewer stay part of the passage around them.
    """
    order = np.argsort(span)
    span, words, first, first_row = span[order], words[order], first[order], first_row[order]
    start, end, before, upto = span >> 32, span & 0xFFFFFFFF, words >> 32, words & 0xFFFFFFFF
    place = first if first.min() != NO_ID else np.unique(np.stack([first, first_row]), axis=1, return_inverse=True)[1].ravel()

    def runs(a: int, changes: np.ndarray) -> list[tuple[int, int]]:
        at = [a, *(np.flatnonzero(changes) + a + 1).tolist(), a + len(changes) + 1]
        return list(zip(at, at[1:]))

    def long(a: int, b: int) -> bool:
        return upto[b - 1] - before[a] >= min_words

    def passage(a: int, b: int, by: int) -> tuple:
        own = first[by] == doc and (doc != NO_ID or first_row[by] == row)
        return doc, row, int(start[a]), int(end[b - 1]), int(upto[b - 1] - before[a]), int(first[by]), bool(own)

    todo = [(a, b) for a, b in runs(0, start[1:] >= end[:-1]) if long(a, b)]
    while todo:
        a, b = todo.pop()
        by = a + int(place[a:b].argmax())
        earlier = place[a:b] < place[by]
        at = a
        for c, d in runs(a, earlier[1:] != earlier[:-1]):
            if earlier[c - a] and long(c, d):
                todo.append((c, d))
                if at < c:
                    yield passage(at, c, by)
                at = d
        if at < b:
            yield passage(at, b, by)


def drop_repeats(docs: DataFrame, passages: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the passages that an earlier document keeps; the cut ends on character boundaries."""
    spans = passages.where("NOT kept").groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("_doc"), F.col("row").alias("_row")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    kind = docs.schema[text].dataType
    schema = T.StructType([T.StructField("row", docs.select(F.struct(*docs.columns).alias("r")).schema["r"].dataType), T.StructField("text", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for data, own in zip(utf8(batch.column("text")), batch.column("_spans").to_pylist()):
                if data is not None and own:
                    inside = np.zeros(len(data) + 1, bool)
                    for s in own:
                        a, b = s["start"], s["end"]
                        while a < len(data) and data[a] & 0xC0 == 0x80:
                            a += 1
                        while b < len(data) and data[b] & 0xC0 == 0x80:
                            b += 1
                        inside[a:b] = True
                    data = np.frombuffer(data, np.uint8)[~inside[:-1]].tobytes()
                kept.append(data)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.binary()).cast(pa.string())], names=["row", "text"])

    # The caller's columns travel as one, so no name of theirs can clash; the text is not sent twice.
    rest = [F.lit(None).cast(kind).alias(c) if c == text else F.col(c) for c in docs.columns]
    keyed = docs.select(F.struct(*rest).alias("row"), F.col(text).alias("text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("_doc"), F.xxhash64(text).alias("_row"))
    out = skew_join(keyed, spans, ["_doc", "_row"], "left").mapInArrow(run, schema)
    return out.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
