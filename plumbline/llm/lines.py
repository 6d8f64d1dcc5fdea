"""Line dedup: a sharded minimal perfect hash over repeated lines, probed by the documents.

Lines are compared by 128 bits of their key: 64 index the hash, 64 more stand in the arrays as the
fingerprint that rejects every other line. No line and no text is shuffled.

Null and empty texts have one empty line. Rows that share a doc_id count as documents of their own, but
all of them keep the lines of which that doc_id is the largest; a null doc_id is smaller than any other.
Other columns of the input stay as they are, whatever their names, but for those that the result adds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.skew import skew_join
from ..session import cut_lineage
from . import mph
from .text import SPACES, utf8

MIN_LENGTH = 20
MIN_DOCUMENTS = 3
SHARD_KEYS = 1 << 16
# Arrays up to this size go to every executor; larger ones stay where they are and the probes go to them.
BROADCAST_BYTES = 48 << 20
# Probes of one shard that one task answers where the arrays stay.
SLICE_PROBES = 4_000_000
NO_ID = -(2**63)


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lower-cased."""
    return line.strip(SPACES).lower()


def _long(key: bytes, least: int) -> bool:
    return len(key) >= 4 * least or len(key) >= least and len(key.decode("utf-8", "surrogatepass")) >= least


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join([xxhash.xxh128_digest(k) for k in keys]), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _doc_keys(text: bytes | None, least: int) -> tuple[list[bytes], list[bytes | None]]:
    """Lines of a text with the key of each, null for keys too short to count."""
    lines = (text or b"").split(b"\n")
    keys = [line_key(line) for line in lines]
    return lines, [k if len(k) >= least and _long(k, least) else None for k in keys]


def line_hashes(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_length: int = MIN_LENGTH) -> DataFrame:
    """(h1, h2, doc, row): each long key of each document once; ``row`` is a hash of its text."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("h1", "h2", "doc", "row")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, rows = [], [], []
            for value, doc, row in zip(utf8(batch.column("_text")), batch.column("_doc").to_pylist(), batch.column("_row").to_pylist()):
                own = {k for k in _doc_keys(value, min_length)[1] if k is not None}
                keys.extend(own)
                ids.extend([doc] * len(own))
                rows.extend([row] * len(own))
            h1, h2 = _hashes(keys)
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids, pa.int64()), pa.array(rows, pa.int64())], names=schema.names)

    narrow = docs.select(F.col(text).alias("_text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("_doc"), F.xxhash64(text).alias("_row"))
    return narrow.mapInArrow(run, schema)


def repeated_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_length: int = MIN_LENGTH,
                   min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(h1, h2, n, last): keys in at least ``min_documents`` documents, and the largest doc_id with each."""
    hashes = line_hashes(docs, text=text, doc_id=doc_id, min_length=min_length)
    return hashes.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("last")).where(F.col("n") >= min_documents)


def hash_shards(lines: DataFrame, shards: int) -> DataFrame:
    """(shard, blob): the arrays of each shard, built where its keys are."""
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = (group[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
        blob = mph.build(h1, h2, {"n": group["n"].to_numpy(np.int64), "last": group["last"].to_numpy(np.int64)})
        return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "blob": [blob]})

    return lines.withColumn("shard", F.pmod("h1", F.lit(shards))).groupBy("shard").applyInPandas(pack, "shard long, blob binary")


def _dropped(tables: dict[int, mph.Table], shards: int, h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which probes hit a repeated line that a larger doc_id keeps."""
    out = np.zeros(len(h1), bool)
    shard = h1.view(np.int64) % shards
    for s in np.unique(shard).tolist():
        if s in tables:
            of = np.flatnonzero(shard == s)
            at = tables[s].find(h1[of], h2[of])
            hit = at >= 0
            out[of[hit]] = tables[s].values["last"][at[hit]] != doc[of[hit]]
    return out


def _packed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(_row, _text, _doc): the caller's other columns as one, so that no name of theirs can clash."""
    rest = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    return docs.select(F.struct(*rest).alias("_row"), F.col(text).alias("_text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("_doc"))


def _out_schema(packed: DataFrame) -> T.StructType:
    return T.StructType([packed.schema["_row"], T.StructField("_text", T.StringType()), T.StructField("_lines", T.LongType()), T.StructField("_dropped", T.LongType())])


def _rewrite(batch: pa.RecordBatch, schema: T.StructType, parts: list[tuple[list[bytes], list[bool]]]) -> pa.RecordBatch:
    kept = [b"\n".join([line for line, gone in zip(lines, drop) if not gone]) for lines, drop in parts]
    return pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array([len(lines) for lines, _ in parts], pa.int64()),
                                       pa.array([sum(drop) for _, drop in parts], pa.int64())], names=schema.names)


def _unpacked(out: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    kept = [F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*kept, F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"))


def dedup_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_length: int = MIN_LENGTH,
                min_documents: int = MIN_DOCUMENTS, shard_keys: int = SHARD_KEYS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with ``text`` rid of repeated lines, and the columns n_lines and n_dropped.

    The arrays of all shards are measured. Up to ``broadcast_bytes`` each task has them all and its documents
    probe them in place. Beyond, the hashes of the documents' lines go to the shards and only hits return.
    """
    spark = docs.sparkSession
    repeated = cut_lineage(repeated_lines(docs, text=text, doc_id=doc_id, min_length=min_length, min_documents=min_documents))
    shards = max(1, -(-repeated.count() // shard_keys))
    blobs = cut_lineage(hash_shards(repeated, shards))
    size = blobs.agg(F.sum(F.length("blob"))).first()[0] or 0
    packed = _packed(docs, text, doc_id)
    if size > broadcast_bytes:
        return _unpacked(_dedup_routed(docs, packed, blobs, shards, text, doc_id, min_length), docs, text)
    sent = spark.sparkContext.broadcast([(r["shard"], bytes(r["blob"])) for r in blobs.toLocalIterator()])
    schema = _out_schema(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {shard: mph.Table(blob) for shard, blob in sent.value}
        for batch in batches:
            parts, keys, owner = [], [], []
            docs_of = batch.column("_doc").to_pylist()
            for row, value in enumerate(utf8(batch.column("_text"))):
                lines, own = _doc_keys(value, min_length)
                drop = [False] * len(lines)
                parts.append((lines, drop))
                for i, key in enumerate(own):
                    if key is not None:
                        keys.append(key)
                        owner.append((row, i))
            h1, h2 = _hashes(keys)
            doc = np.array([docs_of[row] for row, _ in owner], dtype=np.int64)
            for at in np.flatnonzero(_dropped(tables, shards, h1, h2, doc)).tolist():
                row, i = owner[at]
                parts[row][1][i] = True
            yield _rewrite(batch, schema, parts)

    return _unpacked(packed.mapInArrow(run, schema), docs, text)


def _dedup_routed(docs: DataFrame, packed: DataFrame, blobs: DataFrame, shards: int, text: str, doc_id: str, min_length: int) -> DataFrame:
    """The same result when the arrays are too large to send: probes travel, hits come back by document."""
    probes = line_hashes(docs, text=text, doc_id=doc_id, min_length=min_length).withColumn("shard", F.pmod("h1", F.lit(shards)))
    slices = probes.groupBy("shard").agg(F.ceil(F.count("*") / SLICE_PROBES).cast("int").alias("slices"))
    wide = slices.where(F.col("slices") > 1)  # at most probes / SLICE_PROBES rows
    of = F.coalesce("slices", F.lit(1))
    asked = probes.join(F.broadcast(wide), "shard", "left").select(
        "shard", F.pmod(F.xxhash64("doc", "row", "h1"), of).alias("slice"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("blob"), "h1", "h2", "doc", "row")
    null = F.lit(None).cast("long")
    arrays = blobs.join(F.broadcast(wide), "shard", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), of - 1))).select(
        "shard", F.col("slice").cast("long").alias("slice"), F.lit(0).alias("kind"), "blob", null.alias("h1"), null.alias("h2"), null.alias("doc"), null.alias("row"))
    both = arrays.unionByName(asked).repartition("shard", "slice").sortWithinPartitions("shard", "slice", "kind")
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("_doc", "_hash", "h1", "h2")])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, mph.Table] = {}
        for batch in batches:
            kind, shard = batch.column("kind").to_numpy(), batch.column("shard").to_numpy()
            edges = [0, *np.flatnonzero(kind == 0).tolist(), len(kind)]
            for start, end in zip(edges, edges[1:]):
                if start < len(kind) and kind[start] == 0:
                    tables = {int(shard[start]): mph.Table(batch.column("blob")[start].as_py())}
                yield from _hits(batch, start + np.flatnonzero(kind[start:end] == 1), tables, shards, schema)

    # A list is as long as one text's lines: rows that share an id have lists of their own by their texts, and equal rows one.
    gone = both.mapInArrow(answer, schema).distinct().groupBy("_doc", "_hash").agg(F.collect_list(F.struct("h1", "h2")).alias("_gone"))
    out = _out_schema(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for value, hits in zip(utf8(batch.column("_text")), batch.column("_gone").to_pylist()):
                lines, own = _doc_keys(value, min_length)
                drop = [False] * len(lines)
                if hits:
                    bad = {(h["h1"], h["h2"]) for h in hits}
                    at = [i for i, k in enumerate(own) if k is not None]
                    h1, h2 = _hashes([own[i] for i in at])
                    for i, pair in zip(at, zip(h1.view(np.int64).tolist(), h2.view(np.int64).tolist())):
                        drop[i] = pair in bad
                parts.append((lines, drop))
            yield _rewrite(batch, out, parts)

    keyed = packed.withColumn("_hash", F.coalesce(F.xxhash64("_text"), F.lit(0)))
    return skew_join(keyed, gone, ["_doc", "_hash"], "left").mapInArrow(run, out)


def _hits(batch: pa.RecordBatch, rows: np.ndarray, tables: dict[int, mph.Table], shards: int, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    h1, h2, doc, row = (batch.column(c).take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h1", "h2", "doc", "row"))
    if len(rows):
        hit = _dropped(tables, shards, h1.view(np.uint64), h2.view(np.uint64), doc)
        yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(row[hit]), pa.array(h1[hit]), pa.array(h2[hit])], names=schema.names)
