"""Best-fit packing of token sequences by a grouping genetic algorithm.

Texts become token ids and an end id. Pieces longer than a sequence don't exist: only a document that is
too long is cut, from its end, so its first piece takes what is left over. Pieces that fill a sequence alone are done.
The others are dealt evenly to blocks of bounded size, and each block is a bin packing problem of its own.

A population lives on an island, a task. A child takes whole well-filled bins of one parent, drops the
bins of the other that share a piece with them, and puts displaced pieces back by best fit. After an epoch
each island sends its elite to the next island of its block. What a block's best packing leaves in poorly
filled sequences is packed once more across blocks.

A null text is an empty one: one piece with the end id alone. Repeated rows are documents of their own.
Other columns play no part.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

CAPACITY = 2048
END_ID = 0
BLOCK_PIECES = 4096
# Characters of a text that are encoded at a time, where it has edges, and most that the faster way takes.
CUT_TEXT = 20_000
LONGEST = 2 * CUT_TEXT
# Settings of a BPE file with which ids don't follow from the vocabulary alone.
UNUSUAL = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
# Fixed value: how byte-level BPE vocabularies of this kind split text before any merge.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_EDGE = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")
_BLANK = re.compile(r"\s")


class Encoder:
    """Texts to ids, as little-endian 32-bit bytes: the ids that ``tokenizers`` gives for a file, without tokens it would add.

    Of a byte-level BPE file merges follow from the ids, so its vocabulary as ranks, with its added tokens, gives the same ids at a
    third of the time. Stretches without a sure edge between words, which that way can't bear at any length, and files of
    another kind go through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        self.ranked = None
        split, model, extra = given.get("pre_tokenizer") or {}, given["model"], given.get("added_tokens") or []
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or _BLANK.search(t["content"]) for t in extra)
        known = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not given.get("normalizer")
        if not (plain and known and model.get("type") == "BPE" and not any(model.get(k) for k in UNUSUAL)):
            return
        # Byte-level vocabularies write a byte as a printable character: itself, or one after the first 256 in turn.
        plain_bytes = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        others = [b for b in range(256) if b not in plain_bytes]
        byte_of = {chr(b): b for b in plain_bytes} | {chr(256 + i): b for i, b in enumerate(others)}
        added = {t["content"]: t["id"] for t in extra}
        ranks = {bytes(byte_of[c] for c in token): n for token, n in model["vocab"].items() if token not in added}
        self.ranked = tiktoken.Encoding("given", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)

    def _ids(self, text: str) -> bytes:
        if self.ranked is None or len(text) > LONGEST:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.ranked.encode(text, allowed_special="all"), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """A long text is cut before words, where the split of the text has an edge anyhow."""
        if len(text) <= CUT_TEXT or self.ranked is None:
            return self._ids(text)
        parts, at = [], 0
        edges = [m.start() for m in _EDGE.finditer(text)] + [len(text)]
        while at < len(text):
            # The last edge within reach, or else the first one.
            end = edges[max(bisect_right(edges, at + CUT_TEXT) - 1, bisect_right(edges, at))] if edges[-1] > at + CUT_TEXT else len(text)
            parts.append(self._ids(text[at:end]))
            at = end
        return b"".join(parts)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all but the first are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]]


def pieces(docs: DataFrame, tokenizer: str, *, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY,
           with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), one row for each piece, and its ``ids`` if asked for."""
    fields = [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name, value in zip(names, texts):
                ids = encoder.encode(value or "") + end
                for i, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    own = ids[4 * start:4 * (start + length)]
                    rows.append((name, i, start, length, zlib.crc32(own), *[np.frombuffer(own, "<i4")] * with_ids))
            columns = list(zip(*rows)) or [()] * len(schema.fields)
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

    return docs.select(doc_id, text).mapInArrow(run, schema)


class Bins:
    """A packing of pieces: members and fill of each bin."""

    def __init__(self, members: list[list[int]], fill: list[int]):
        self.members, self.fill = members, fill

    def cost(self, capacity: int) -> float:
        """Smaller is better: the number of bins, less a bonus for uneven filling, which leaves room to close one."""
        n = max(1, len(self.fill))
        return len(self.fill) - sum((f / capacity) ** 2 for f in self.fill) / n


def best_fit(order: list[int], size: list[int], capacity: int, bins: Bins) -> Bins:
    """Puts pieces in turn where least room is left."""
    room = sorted((capacity - f, b) for b, f in enumerate(bins.fill) if f < capacity)
    for i in order:
        at = bisect_left(room, (size[i], -1))
        if at < len(room):
            left, b = room.pop(at)
            bins.members[b].append(i)
            bins.fill[b] += size[i]
            left -= size[i]
        else:
            b, left = len(bins.fill), capacity - size[i]
            bins.members.append([i])
            bins.fill.append(size[i])
        if left:
            insort(room, (left, b))
    return bins


def crossover(one: Bins, other: Bins, size: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """Well-filled bins of ``other`` go whole into ``one``; pieces that lose their bin are fitted anew."""
    rank = np.argsort([-f for f in other.fill], kind="stable")
    take = rank[:max(1, int(len(rank) * rng.uniform(0.2, 0.8)))]
    take = take[rng.random(len(take)) < 0.7].tolist() or take[:1].tolist()
    moved = {i for b in take for i in other.members[b]}
    members, fill, displaced = [list(other.members[b]) for b in take], [other.fill[b] for b in take], []
    for own, f in zip(one.members, one.fill):
        hit = [i for i in own if i in moved]
        if hit:
            displaced.extend(i for i in own if i not in moved)
        else:
            members.append(list(own))
            fill.append(f)
    return best_fit(sorted(displaced, key=lambda i: -size[i]), size, capacity, Bins(members, fill))


def mutate(bins: Bins, size: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """Opens the emptiest bins and some others, and fits their pieces anew."""
    n = len(bins.fill)
    chance = np.where(np.argsort(np.argsort(bins.fill)) < max(2, n // 50), 0.9, 0.02)
    gone = rng.random(n) < chance
    displaced = [i for b in np.flatnonzero(gone).tolist() for i in bins.members[b]]
    kept = np.flatnonzero(~gone).tolist()
    order = sorted(displaced, key=lambda i: -size[i] * rng.uniform(0.9, 1.1))
    return best_fit(order, size, capacity, Bins([list(bins.members[b]) for b in kept], [bins.fill[b] for b in kept]))


def _labels(bins: Bins, n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    for b, own in enumerate(bins.members):
        out[own] = b
    return out


def _bins(labels: np.ndarray, size: list[int]) -> Bins:
    members: list[list[int]] = [[] for _ in range(int(labels.max()) + 1)] if len(labels) else []
    for i, b in enumerate(labels.tolist()):
        members[b].append(i)
    return Bins(members, [sum(size[i] for i in own) for own in members])


def evolve(size: list[int], capacity: int, seed: tuple, elites: list[np.ndarray], *, population: int, generations: int) -> Bins:
    """One epoch of one island: elites that came in, best fits of shuffled pieces, and their children."""
    rng = np.random.default_rng(seed)
    least = -(-sum(size) // capacity)
    people = [_bins(e, size) for e in elites]
    falling = sorted(range(len(size)), key=lambda i: -size[i])
    while len(people) < population:
        noise = rng.uniform(1 - 0.1 * len(people), 1 + 0.1 * len(people), len(size))
        order = falling if not people else sorted(falling, key=lambda i: -size[i] * noise[i])
        people.append(best_fit(order, size, capacity, Bins([], [])))
    cost = [p.cost(capacity) for p in people]
    for _ in range(generations):
        best = int(np.argmin(cost))
        if len(people[best].fill) <= least:
            break
        a, b = rng.choice(len(people), 2, replace=False)
        one, other = (a, b) if cost[a] <= cost[b] else (b, a)
        child = crossover(people[one], people[other], size, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, size, capacity, rng)
        worst, price = int(np.argmax(cost)), child.cost(capacity)
        if price < cost[worst]:
            people[worst], cost[worst] = child, price
    return people[int(np.argmin(cost))]


def _solve(items: DataFrame, capacity: int, *, islands: int, epochs: int, population: int, generations: int, seed: int) -> DataFrame:
    """(block, row, bin) for items (block, row, length): the best packing of each block."""
    schema = "block long, island int, rows array<long>, sizes array<long>, elite array<int>, bins int, cost double"
    blocks = items.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("row", "length"))).alias("items"))  # bounded by the dealing
    state = blocks.select("block", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), F.col("items.row").alias("rows"),
                          F.col("items.length").alias("sizes"), F.lit(None).cast("array<array<int>>").alias("elites"))

    def epoch_of(number: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    size = [int(s) for s in row.sizes]
                    came = [] if row.elites is None else [np.asarray(e, np.int32) for e in row.elites]
                    best = evolve(size, capacity, (seed, number, int(row.block), int(row.island)), came, population=population, generations=generations)
                    yield pd.DataFrame({"block": [row.block], "island": [row.island], "rows": [row.rows], "sizes": [row.sizes],
                                        "elite": [_labels(best, len(size))], "bins": [len(best.fill)], "cost": [best.cost(capacity)]})
        return run

    for number in range(epochs):
        if number:
            # Elites move on: island i works with its own and with that of the island before it.
            sent = made.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("elite").alias("guest"))
            state = made.join(sent, ["block", "island"]).withColumn("elites", F.array("elite", "guest")).select("block", "island", "rows", "sizes", "elites")
        made = cut_lineage(state.repartition("block", "island").mapInPandas(epoch_of(number), schema))
    winner = made.groupBy("block").agg(F.min_by(F.struct("rows", "elite", "sizes"), F.struct("cost", "island")).alias("best"))
    each = winner.select("block", F.explode(F.arrays_zip("best.rows", "best.elite", "best.sizes")).alias("x"))
    return each.select("block", F.col("x.rows").alias("row"), F.col("x.elite").alias("bin"), F.col("x.sizes").alias("length"))


def _dealt(items: DataFrame, n: int, block_pieces: int) -> DataFrame:
    return items.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(1, -(-n // block_pieces)))))


def pack(cut: DataFrame, *, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES, islands: int = 2, epochs: int = 2,
         population: int = 6, generations: int = 24, rest_fill: float = 0.97, seed: int = 7) -> DataFrame:
    """``cut`` (with ``length``, at most ``capacity``) and the columns sequence_id and offset."""
    rows = cut_lineage(cut.withColumn("row", F.monotonically_increasing_id()))
    small = cut_lineage(rows.where(F.col("length") < capacity).select("row", "length"))
    knobs = {"islands": islands, "epochs": epochs, "population": population, "generations": generations, "seed": seed}
    first = cut_lineage(_solve(_dealt(small, small.count(), block_pieces), capacity, **knobs))
    fills = first.groupBy("block", "bin").agg(F.sum("length").alias("fill"))
    marked = cut_lineage(first.join(fills, ["block", "bin"]))
    loose = marked.where(F.col("fill") < rest_fill * capacity).select("row", "length")
    again = cut_lineage(_solve(_dealt(loose, loose.count(), block_pieces), capacity, **knobs | {"seed": seed + 1}))
    key = F.struct(F.lit(1).alias("kind"), F.col("block").alias("a"), F.col("bin").cast("long").alias("b"))
    again_key = F.struct(F.lit(2).alias("kind"), F.col("block").alias("a"), F.col("bin").cast("long").alias("b"))
    alone = rows.where(F.col("length") >= capacity).select("row", "length", F.struct(F.lit(0).alias("kind"), F.col("row").alias("a"), F.lit(0).cast("long").alias("b")).alias("key"))
    placed = (marked.where(F.col("fill") >= rest_fill * capacity).select("row", "length", key.alias("key"))
              .union(again.select("row", "length", again_key.alias("key"))).union(alone))
    # A sequence holds at most ``capacity`` pieces, so its list is bounded.
    grouped = placed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("row", "length"))).alias("own"))
    offset = F.transform("own", lambda x, i: F.struct(x["row"].alias("row"), F.aggregate(
        F.slice("own", 1, i), F.lit(0).cast("long"), lambda t, y: t + y["length"]).alias("offset")))
    numbers = cut_lineage(grouped.withColumn("sequence_id", F.monotonically_increasing_id()).select("sequence_id", F.explode(offset).alias("x"))
                          .select("sequence_id", "x.row", "x.offset"))
    return rows.join(numbers, "row").drop("row")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, spans): the packed sequences themselves, from pieces made ``with_ids``."""
    grouped = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids"))).alias("own"))
    return grouped.select("sequence_id", F.flatten("own.ids").alias("ids"), F.transform("own", lambda x: x.dropFields("ids")).alias("spans"))
