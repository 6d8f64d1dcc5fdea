"""K-d tree sharding: nodes are split at weighted medians along their widest metadata dimension.

The weight of a row is its size in bytes. A split is found without moving rows: histograms of the key,
combined in the tasks, close in on the median of every node of a level at once, and only the histograms
(BUCKETS rows for each node) reach the driver. The key of a row is its place on the node's dimension,
then a hash of its text, then its doc_id, so a split can fall between any two rows, and equal texts stay
together unless their group alone outweighs the tolerance.

Null and empty texts weigh one byte; a null dimension counts as the smallest value. Dimensions of text count by the place of a value
among the distinct ones. Rows equal in all parts of the key
can't be told apart and stay together. With fewer rows than shards some shards are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.skew import skew_join
from ..session import cut_lineage
from .text import numbered

BUCKETS = 256
# A split may miss its share by this part of a shard's bytes.
TOLERANCE = 1 / 2000


def placed_by(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Puts in place of the text column ``value`` its place among the distinct values in order, from 1; null is 0."""
    counts = cut_lineage(rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")))
    places = numbered(counts.select(value), [], [value], "_place")
    found = skew_join(rows, places, [value], "left", sizes=counts)
    return found.withColumn(name, F.coalesce(F.col("_place") + 1, F.lit(0))).drop(value, "_place")


def metadata(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", dims: list[str]) -> DataFrame:
    """Narrow rows: doc, size, crc, the key parts ``h`` and ``d``, and a number for each dimension.

    The dimensions of a group of equal texts are those of its smallest member, so that no split
    along a dimension parts the group.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    kinds = dict(docs.dtypes)
    spots = [f"k{i + 1}" for i in range(len(dims))]
    texts = {k: f"value{k}" for k, c in zip(spots, dims) if kinds[c] == "string"}
    values = [F.col(c).alias(texts[k]) if k in texts else F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(k) for k, c in zip(spots, dims)]
    rows = cut_lineage(docs.select(
        F.col(doc_id).alias("doc"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("crc"),
        F.xxhash64(body).bitwiseAND(F.lit(2**63 - 1)).alias("h"), *values))
    if texts:
        for k, value in texts.items():
            rows = placed_by(rows, value, k)
        rows = cut_lineage(rows)
    groups = cut_lineage(rows.groupBy("h", "size").agg(F.count("*").alias("n"), *[F.min(k).alias(f"g{k}") for k in spots]))
    grouped = groups.where("n > 1")
    named = skew_join(rows, grouped.drop("n"), ["h", "size"], "left", sizes=grouped.select("h", "size", "n"))
    low = F.coalesce(F.col("doc").cast("long"), F.lit(0))
    return cut_lineage(named.select("doc", "size", "crc", "h", low.alias("d"), F.lit(0).cast("long").alias("root"), F.col("size").alias("k0"),
                                    *[F.coalesce(f"g{k}", k).alias(k) for k in spots]))


def _with_nodes(rows: DataFrame, splits: list[list[tuple]]) -> DataFrame:
    """Walks each row down the levels found so far; each level's table has one row for each node."""
    out = rows.withColumnRenamed("root", "node")
    schema = "node long, dim int, sk long, sh long, sd long"
    for level in splits:
        known = rows.sparkSession.createDataFrame(level, schema)
        out = out.join(F.broadcast(known), "node", "left")  # at most one row for each shard
        out = out.withColumn("k", _dimension(rows))
        right = F.expr("k > sk OR (k = sk AND (h > sh OR (h = sh AND d >= sd)))")
        out = out.withColumn("node", 2 * F.col("node") + F.when(right, 1).otherwise(0)).drop("dim", "sk", "sh", "sd", "k")
    return out


def _dimension(rows: DataFrame) -> Column:
    """The value on the dimension that the column ``dim`` names."""
    names = sorted(c for c in rows.columns if c[0] == "k" and c[1:].isdigit())
    value = F
    for i, name in enumerate(names):
        value = value.when(F.col("dim") == i, F.col(name))
    return value.otherwise(F.col(names[0]))


def _medians(rows: DataFrame, placed: DataFrame, shares: dict[int, float], tolerance: float) -> list[tuple]:
    """Split keys of all nodes in ``shares``: below a split lies about that share of the node's bytes."""
    names = sorted(c for c in rows.columns if c[0] == "k" and c[1:].isdigit())
    spans = placed.where(F.col("node").isin(list(shares))).groupBy("node").agg(
        F.sum("size").alias("bytes"), *[f(n).alias(f"{f.__name__}_{n}") for n in [*names, "h", "d"] for f in (F.min, F.max)]).collect()
    root = {n: max(1, max(s[f"max_{n}"] for s in spans) - min(s[f"min_{n}"] for s in spans)) for n in names} if spans else {}
    open_, done = {}, {}
    for s in spans:
        dim = max(range(len(names)), key=lambda i: ((s[f"max_{names[i]}"] - s[f"min_{names[i]}"]) / root[names[i]], -i))
        ranges = [(s[f"min_{n}"], s[f"max_{n}"]) for n in (names[dim], "h", "d")]
        open_[s["node"]] = {"dim": dim, "ranges": ranges, "need": shares[s["node"]] * s["bytes"]}
    while open_:
        table, todo = [], {}
        for node, o in open_.items():
            part = next((i for i, (a, b) in enumerate(o["ranges"]) if a < b), None)
            if part is None:  # rows that can't be told apart: they go to the side where they miss by less
                done[node] = (o["dim"], *[a for a, _ in o["ranges"]])
                continue
            (lo, hi), todo[node] = o["ranges"][part], part
            table.append((node, o["dim"], part, lo, hi, (hi - lo) // BUCKETS + 1, o["ranges"][0][0] if part else None, o["ranges"][1][0] if part > 1 else None))
        if not table:
            break
        frame = rows.sparkSession.createDataFrame(table, "node long, dim int, part int, lo long, hi long, width long, is_k long, is_h long")
        key = placed.join(F.broadcast(frame), "node").withColumn("k", _dimension(rows))
        value = F.when(F.col("part") == 0, F.col("k")).when(F.col("part") == 1, F.col("h")).otherwise(F.col("d"))
        inside = key.withColumn("value", value).where("value BETWEEN lo AND hi AND (is_k IS NULL OR k = is_k) AND (is_h IS NULL OR h = is_h)")
        hist = inside.groupBy("node", F.expr("(value - lo) div width").alias("bucket")).agg(
            F.sum("size").alias("w"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("k", "h", "d") for f in (F.min, F.max)]).collect()
        by: dict[int, list] = {}
        for b in hist:
            by.setdefault(b["node"], []).append(b)
        after = {}
        for node in todo:
            o = open_[node]
            before, cut = 0, None
            for b in sorted(by[node], key=lambda b: b["bucket"]):
                if before + b["w"] >= o["need"]:
                    cut = b
                    break
                before += b["w"]
            at = [(cut["min_k"], cut["max_k"]), (cut["min_h"], cut["max_h"]), (cut["min_d"], cut["max_d"])]
            same = all(a == b for a, b in at)
            if cut["w"] <= tolerance or same:
                over = before + cut["w"] - o["need"]
                rest = [b for b in by[node] if b["bucket"] > cut["bucket"]]
                after_cut = min(rest, key=lambda b: b["bucket"]) if rest else None
                if o["need"] - before <= over:  # the bucket goes right
                    done[node] = (o["dim"], *_start(cut, todo[node], o))
                elif after_cut is not None:
                    done[node] = (o["dim"], *_start(after_cut, todo[node], o))
                else:
                    done[node] = (o["dim"], *_after(cut, todo[node], o))
            else:
                after[node] = o | {"ranges": at, "need": o["need"] - before}
        open_ = after
    return [(node, *split) for node, split in done.items()]


_LOW = -(2**63)


def _start(bucket, part: int, o: dict) -> tuple[int, int, int]:
    """The smallest key that falls in ``bucket``."""
    if part == 0:
        return bucket["min_k"], _LOW, _LOW
    return (o["ranges"][0][0], bucket["min_h"], _LOW) if part == 1 else (o["ranges"][0][0], o["ranges"][1][0], bucket["min_d"])


def _after(bucket, part: int, o: dict) -> tuple[int, int, int]:
    """A key just above all in ``bucket``."""
    if part == 0:
        return bucket["max_k"] + 1, _LOW, _LOW
    return (o["ranges"][0][0], bucket["max_h"] + 1, _LOW) if part == 1 else (o["ranges"][0][0], o["ranges"][1][0], bucket["max_d"] + 1)


def kd_shards(docs: DataFrame, *, target_bytes: int | None = None, shards: int | None = None, text: str = "text", doc_id: str = "doc_id",
              dims: list[str] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc, size, crc, shard, slot, node): each document's leaf of the tree and its place in it.

    The number of shards is given, or follows from ``target_bytes``. A node of n leaves gives n // 2 of them,
    and their share of its bytes, to its left child. ``dims`` name further columns beside the size.
    """
    kinds = dict(docs.dtypes)
    dims = [c for c in ("lang", "source") if c in kinds] if dims is None else dims
    rows = metadata(docs, text=text, doc_id=doc_id, dims=dims)
    total = rows.agg(F.sum("size")).first()[0] or 0
    if shards is None:
        shards = max(1, -(-total // target_bytes))
    leaves, splits = {0: shards}, []
    while leaves:
        shares = {node: n // 2 / n for node, n in leaves.items() if n > 1}
        below = {}
        for node, n in leaves.items():
            below |= {2 * node: n // 2, 2 * node + 1: n - n // 2} if n > 1 else {2 * node: n}
        if not shares:
            break
        found = {s[0]: s for s in _medians(rows, _with_nodes(rows, splits), shares, tolerance * total / shards)}
        # An undivided or empty node goes left as a whole.
        top = 2**63 - 1
        splits.append([found.get(node, (node, 0, top, top, top)) for node in leaves])
        leaves = below
    order = {node: i for i, node in enumerate(sorted(leaves))}
    final = rows.sparkSession.createDataFrame([(k, v) for k, v in order.items()], "node long, shard int")
    dealt = _with_nodes(rows, splits).join(F.broadcast(final), "node").select("doc", "size", "crc", "h", "shard", "node")
    return numbered(dealt, ["shard"], ["h", "doc"], "slot").drop("h")
