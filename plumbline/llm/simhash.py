"""SimHash near-dedup: fingerprints in shards, a BK-tree for each shard, links as spanning edges.

A shard is named by some bits of a fingerprint: the bits are cut into blocks, and by the pigeonhole principle two
fingerprints within the radius agree in enough of them, so no link is lost.

A tree is not sent to everyone: fingerprints that could be near it have its shard's name, so they meet it in
one task, and the trees may grow with the corpus. A shard with more fingerprints than a tree may hold is cut
into several trees, and its fingerprints are sent to each of them. What a tree gives out are edges that span its links, fewer than its nodes;
no pairs are listed.

Null, empty and word-less texts have fingerprint zero, which links like any other. Equal fingerprints are one node, so copies cost
one. Rows that share a doc_id may have different fingerprints; each row gets the
component of its own. A null doc_id never names a component unless it has no other. Other columns stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.skew import skew_join
from ..session import cut_lineage
from .graph import connected_components
from .text import added, extend, keyed, utf8, word_spans

SEED = 42
TREE_NODES = 20_000
# Fingerprints of one shard to aim at: bits of a shard's name follow from it and the number of fingerprints.
SHARD_NODES = 16
# Shards that need several trees are sent to all tasks up to this number; a join finds more.
FEW_SHARDS = 1_000_000
_ROWS = 1 << 15


def shingle_slices(data: bytes, words: int) -> tuple[bytes, list[int], list[int]]:
    """Lower-cased text with single spaces between words, and where each shingle starts and ends in it."""
    low = data.lower()
    starts, ends = word_spans(low)
    if not len(starts):
        return b"", [], []
    if len(starts) > 1 and not ((starts[1:] - ends[:-1] == 1).all() and (np.frombuffer(low, np.uint8)[ends[:-1]] == 32).all()):
        low = b" ".join(low.split())
        starts, ends = word_spans(low)
    n = max(1, len(starts) - words + 1)
    return low, starts[:n].tolist(), ends[-n:].tolist()


def fingerprint(data: bytes | None, words: int, bits: int) -> bytes:
    """Big-endian SimHash; 64 bits from XXH64, 128 from XXH128."""
    low, starts, ends = shingle_slices(data or b"", words)
    if not starts:
        return bytes(bits // 8)
    digest = xxhash.xxh64_digest if bits == 64 else xxhash.xxh128_digest
    ones = np.zeros(bits, np.int64)
    for at in range(0, len(starts), _ROWS):
        raw = b"".join([digest(low[a:b], SEED) for a, b in zip(starts[at:at + _ROWS], ends[at:at + _ROWS])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, bits // 8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(starts)).tobytes()


def fingerprints(docs: DataFrame, *, text: str = "text", words: int = 4, bits: int = 64) -> DataFrame:
    """``docs`` without ``text`` and with its fingerprint as two longs, ``fp_hi`` (0 for 64 bits) and ``fp_lo``."""
    schema = added(docs, [("fp_hi", T.LongType()), ("fp_lo", T.LongType())], drop=(text,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [fingerprint(value, words, bits).rjust(16, b"\0") for value in utf8(batch.column(text))]
            halves = np.frombuffer(b"".join(raw), ">i8").astype(np.int64).reshape(-1, 2)
            yield extend(batch, schema, {"fp_hi": pa.array(halves[:, 0]), "fp_lo": pa.array(halves[:, 1])})

    return docs.mapInArrow(run, schema)


def block_masks(bits: int, radius: int, n: int) -> list[int]:
    """Bit masks of which two fingerprints within ``radius`` agree on at least one.

    With radius + k blocks at least k are without a difference; k grows until shards of ``n`` evenly
    spread fingerprints are small.
    """
    for k in range(1, 4):
        blocks = radius + k
        if n / 2 ** (bits * k // blocks) <= 4 * SHARD_NODES or k == 3:
            edges = [bits * i // blocks for i in range(blocks + 1)]
            block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
            return [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), k)]
    raise AssertionError


class Tree:
    """A BK-tree: each child hangs on the edge named by its Hamming distance to the parent."""

    def __init__(self, radius: int):
        self.radius, self.keys, self.kids, self.up = radius, [], [], []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def near(self, key: int) -> list[int]:
        """Nodes within the radius; below a hit, nodes on edges within the radius are left out, as they link to it."""
        if not self.keys:
            return []
        keys, kids, r, found, todo = self.keys, self.kids, self.radius, [], [0]
        while todo:
            i = todo.pop()
            d = (keys[i] ^ key).bit_count()
            low = d - r
            if low <= 0:
                found.append(i)
                low = r + 1
            high = d + r
            for edge, child in kids[i].items():
                if low <= edge <= high:
                    todo.append(child)
        return found

    def add(self, key: int) -> None:
        new = len(self.keys)
        if new:
            at = 0
            while True:
                d = (self.keys[at] ^ key).bit_count()
                child = self.kids[at].get(d)
                if child is None:
                    self.kids[at][d] = new
                    break
                at = child
        self.keys.append(key)
        self.kids.append({})
        self.up.append(new)


def dealt(members: DataFrame, masks: list[int], tree_nodes: int, *, by: list[str], carried: list[str]) -> DataFrame:
    """``members`` at each tree they belong to or are sent to (``probe``), sorted by tree, a tree's own before the others; ``table`` is the mask's number."""
    names = F.array(*[F.xxhash64(F.lit(i), F.col("fp_hi").bitwiseAND(F.lit(_signed(m >> 64))), F.col("fp_lo").bitwiseAND(F.lit(_signed(m))))
                      for i, m in enumerate(masks)])
    members = members.select(*carried, F.posexplode(names).alias("table", "shard"))
    large = cut_lineage(members.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > tree_nodes).select(
        "shard", F.ceil(F.col("n") / tree_nodes).cast("int").alias("trees"), "n"))
    if large.count() <= FEW_SHARDS:
        with_trees = members.join(F.broadcast(large.drop("n")), "shard", "left")
    else:
        with_trees = skew_join(members, large.drop("n"), ["shard"], "left", sizes=large.drop("trees"))
    trees = F.coalesce("trees", F.lit(1))
    own = F.pmod(F.xxhash64(*by), trees)
    sent = (with_trees.withColumn("own", own)
            .withColumn("tree", F.explode(F.sequence(F.lit(0), trees - 1)))
            .select("shard", "tree", (F.col("tree") != F.col("own")).alias("probe"), "table", *carried))
    return sent.repartition("shard", "tree").sortWithinPartitions("shard", "tree", "probe")


def links(distinct: DataFrame, masks: list[int], radius: int, *, tree_nodes: int = TREE_NODES) -> DataFrame:
    """(a_hi, a_lo, b_hi, b_lo): for each tree, edges that span what its links connect, fewer than its nodes."""
    sent = dealt(distinct, masks, tree_nodes, by=["fp_lo", "fp_hi"], carried=["fp_hi", "fp_lo"])
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("a_hi", "a_lo", "b_hi", "b_lo")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, tree = None, Tree(radius)
        for batch in batches:
            out: list[tuple[int, int]] = []
            columns = [batch.column(c).to_pylist() for c in ("shard", "tree", "probe", "fp_hi", "fp_lo")]
            for shard, part, probe, hi, lo in zip(*columns):
                if (shard, part) != name:
                    name, tree = (shard, part), Tree(radius)
                key = (hi & _WORD) << 64 | lo & _WORD
                found = tree.near(key)
                if probe:
                    for i in {tree.root(i): i for i in found}.values():
                        out.append((key, tree.keys[i]))
                    continue
                new = len(tree.keys)
                tree.add(key)
                for i in found:
                    top = tree.root(i)
                    if top != tree.root(new):
                        tree.up[top] = new
                        out.append((key, tree.keys[i]))
            words = [[_signed(k >> 64) for k, _ in out], [_signed(k) for k, _ in out], [_signed(k >> 64) for _, k in out], [_signed(k) for _, k in out]]
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.int64()) for w in words], names=schema.names)

    return sent.mapInArrow(run, schema).distinct()


_WORD = (1 << 64) - 1


def _signed(word: int) -> int:
    word &= _WORD
    return word - (1 << 64) if word >> 63 else word


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", words: int = 4, bits: int = 64, radius: int = 4,
                    tree_nodes: int = TREE_NODES) -> DataFrame:
    """``docs`` without ``text`` and with fp_hi, fp_lo, component_id, the smallest doc_id reachable over links, and ``_group``, a
    number of the component that does not hang on any doc_id."""
    # A node's number is its fingerprint; of 128 bits a 64-bit hash.
    node = (lambda hi, lo: F.col(lo)) if bits == 64 else (lambda hi, lo: F.xxhash64(hi, lo))
    marks = ["fp_hi", "fp_lo"]
    marked = cut_lineage(fingerprints(docs, text=text, words=words, bits=bits))
    nodes = cut_lineage(marked.groupBy(*marks).agg(F.min(doc_id).alias("_first"), F.count("*").alias("_n")).withColumn("node", node(*marks)))
    distinct = nodes.select(*marks)
    found = links(distinct, block_masks(bits, radius, distinct.count()), radius, tree_nodes=tree_nodes)
    roots = cut_lineage(connected_components(found.select(node("a_hi", "a_lo").alias("a"), node("b_hi", "b_lo").alias("b"))))
    linked = roots.join(nodes.select("node", "_first"), "node")
    least = cut_lineage(linked.groupBy("root").agg(F.min("_first").alias("_least"), F.count("*").alias("n")))
    of_node = skew_join(linked.select("node", "root"), least.drop("n"), ["root"], sizes=least.select("root", "n")).select("node", "root", "_least")
    named = nodes.join(of_node, "node", "left").select(*marks, F.coalesce("_least", "_first").alias("component_id"), F.coalesce("root", "node").alias("_group"))
    return skew_join(marked, named, marks, sizes=nodes.select(*marks, F.col("_n").alias("n")))


def keep_one(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id, null being the smallest.

    Components are of texts: rows that share a doc_id, or have none, are no copies for that. Of rows that share that doc_id the one with the
    smallest text hash stays; of wholly equal rows, one. Which rows go is decided on row numbers, ids and hashes; ``docs`` has to give the same rows
    in the same places when it is read again, as written tables do.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("at"))
    own = rows.select(F.struct(F.coalesce(F.col(f"row.`{doc_id}`").cast("long"), F.lit(-(2**63))).alias("key"), F.xxhash64(F.col(f"row.`{text}`")).alias("crc"), "at").alias("name"),
                      F.col(f"row.`{text}`").alias("text"))
    groups = cut_lineage(near_duplicates(own, text="text", doc_id="name", **how).select("_group", "name"))
    first = cut_lineage(groups.groupBy("_group").agg(F.min("name").alias("stays"), F.count("*").alias("n")))
    several = first.where("n > 1")
    gone = skew_join(groups, several.drop("n"), ["_group"], sizes=several.select("_group", "n")).where("name.at <> stays.at").select(F.col("name.at").alias("at"))
    return rows.join(gone, "at", "left_anti").select("row.*")
