"""File index, exact copies and near-duplicate clusters.

Copies are kept as member rows with a group size, never as one list per group, and nearness is
kept as bucket membership, never as pairs: both stay linear in the number of files even when one
text makes up a third of the corpus.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sketch
from ..functions.ranking import latest
from ..functions.skew import members_of_repeated_groups, skew_join
from ..functions.text import file_name, let, suffix
from ..session import cut_lineage, written

# Bucket rows that one task walks.
PART_ROWS = 200_000
# Texts compared with one seed in one task.
COMPARED_ROWS = 10_000


def normalise_code(content: Column) -> Column:
    """Lower case, comments out (# and // to the line end, then blocks), all white space out."""
    text = F.lower(content)
    text = F.regexp_replace(text, r"(?d)#.*", "")
    text = F.regexp_replace(text, r"(?d)//.*", "")
    text = F.regexp_replace(text, r"(?s)/\*.*?\*/", "")
    return F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", "")


def shingles(content: Column) -> Column:
    """Distinct 5-character shingles of the normalised text; a text of up to 5 is one shingle."""
    # Each match takes one code point and looks at the five from there.
    return let(normalise_code(content), lambda text: F.when(F.length(text) <= 5, F.array(text)).otherwise(
        F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{5}))."), F.lit(1)))))


def _index_columns(corpus: DataFrame, project_root: str) -> list[Column]:
    raw = F.col("raw") if "raw" in corpus.columns else F.encode("content", "UTF-8")
    return [
        F.col("path"), file_name(F.col("path")).alias("filename"), suffix(F.col("path")).alias("extension"),
        F.octet_length(raw).cast("bigint").alias("size"), F.sha2(raw, 256).alias("hash"),
        F.lit(project_root).alias("project_root"),
    ]


def file_fingerprint(corpus: DataFrame, *, project_root: str) -> DataFrame:
    """Index row per file; ``raw`` bytes are hashed when present, else the UTF-8 text."""
    return corpus.select(*_index_columns(corpus, project_root))


def minhash_signature(corpus: DataFrame, *, num_perm: int = 128) -> DataFrame:
    """(path, signature). Normalising runs in the JVM, hashing in one Arrow job, without a shuffle."""
    texts = corpus.select("path", normalise_code(F.col("content")).alias("text"))
    return sketch.with_signature(texts, "text", num_perm=num_perm)


def index_files(corpus: DataFrame, *, project_root: str) -> DataFrame:
    """Fingerprint and MinHash of each file from one read."""
    columns = _index_columns(corpus, project_root)
    texts = corpus.select(*columns, normalise_code(F.col("content")).alias("text"))
    return sketch.with_signature(texts, "text").withColumnRenamed("signature", "minhash")


def index_upsert(index: DataFrame, batch: DataFrame, *, key: str = "path") -> DataFrame:
    """Rows of the later batch replace those with the same key; inside a batch the last row wins.

    Both need a ``batch`` number and a ``seq`` number. One combining aggregate by key, no window.
    """
    return latest(index.unionByName(batch), [key], "batch", "seq")


def exact_duplicates(files: DataFrame) -> DataFrame:
    """Members of every group of byte-equal files: (hash, copies, path)."""
    return members_of_repeated_groups(files.select("hash", "path"), "hash", "copies")


def duplicate_groups(files: DataFrame) -> DataFrame:
    """One row per repeated hash with its size and first path."""
    return files.groupBy("hash").agg(F.count("*").alias("copies"), F.min("path").alias("first_path")).where(
        F.col("copies") > 1
    )


def clones_of(procedures: DataFrame, files: DataFrame, term: str) -> DataFrame:
    """Copies of the files of matching procedures: (hash, path, matched, clones).

    Every file with a hash that a match has is one row; ``clones`` is how many others share it,
    ``matched`` tells the matches from the rest. A match's clones are the other rows of its hash.
    """
    matched = procedures.where(F.col("proc_name").ilike(f"%{term}%")).select("path").distinct()
    marked = files.select("hash", "path").join(matched.withColumn("matched", F.lit(True)), "path", "left").withColumn(
        "matched", F.coalesce("matched", F.lit(False))
    )
    wanted = marked.groupBy("hash").agg(F.count("*").alias("n"), F.bool_or("matched").alias("hit"))
    wanted = wanted.where((F.col("n") > 1) & F.col("hit")).select("hash", "n")
    return skew_join(marked, wanted, ["hash"], sizes=wanted).select("hash", "path", "matched", (F.col("n") - 1).alias("clones"))


def _digest(values: Column) -> Column:
    """128-bit key of some signature values; 64 bits would collide at tens of billions of files."""
    return F.md5(F.array_join(values.cast("array<string>"), ","))


def _band_keys(bands: int, rows: int) -> Column:
    return F.array(*[
        F.struct(F.lit(b).alias("band"), _digest(F.slice("signature", b * rows + 1, rows)).alias("bucket"))
        for b in range(bands)
    ])


def _representatives(signatures: DataFrame, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """One path per distinct signature with its buckets and copies, and the signature each path has.

    Files with the same signature share every bucket, so the first of them stands for all; this
    keeps copied files out of the buckets.
    """
    # Kept once in the shared folder, with the buckets in place of the long signatures.
    buckets = F.transform(_band_keys(bands, rows), lambda k: F.concat_ws(":", k["band"], k["bucket"]))
    keyed = written(signatures.select("path", _digest(F.col("signature")).alias("sig"), buckets.alias("buckets")))
    reps = keyed.groupBy("sig").agg(F.min("path").alias("rep"), F.first("buckets").alias("buckets"), F.count("*").alias("copies"))
    return written(reps), keyed.select("sig", "path")


def lsh_candidates(signatures: DataFrame, *, threshold: float = 0.9, num_perm: int = 128) -> DataFrame:
    """Bucket membership of all files that share a band with another: (band, bucket, path, members).

    Two files are candidates when they have a row with the same band and bucket. Nothing is
    paired up, so a bucket of n files costs n rows.
    """
    bands, rows = sketch.banding(threshold, num_perm)
    # Kept once: sizes and members both read it, and signatures are dear to compute.
    member = cut_lineage(signatures.select("path", F.inline(_band_keys(bands, rows))))
    sizes = member.groupBy("band", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return skew_join(member, sizes, ["band", "bucket"], sizes=sizes).withColumnRenamed("n", "members")


def _walk(part: pd.DataFrame) -> pd.DataFrame:
    """Seeds of whole connected parts: in path order, a path is a seed unless an earlier seed has one of its buckets."""
    taken: set[str] = set()
    seeds = []
    for rep, own in part.groupby("rep", sort=True)["bucket"]:
        if taken.isdisjoint(own):
            seeds.append(rep)
            taken.update(own)
    return pd.DataFrame({"rep": pd.Series(seeds, dtype=object)})


def _connected(graph: DataFrame) -> DataFrame:
    """(rep, part): the smallest path of the connected part each path is in.

    Each round takes the smallest part among a path's buckets and then the part of that part's own path, so
    chains in path order take about the logarithm of their length; chains in mixed order take more. Both steps are combining aggregates and a join on unique keys.
    """
    parts = written(graph.select("rep", F.col("rep").alias("part")).distinct())
    while True:
        by_rep = graph.join(parts, "rep")
        least = by_rep.groupBy("bucket").agg(F.min("part").alias("least"), F.count("*").alias("n"))
        found = written(skew_join(by_rep, least.drop("n"), ["bucket"], sizes=least.select("bucket", "n"))
                        .groupBy("rep").agg(F.min("least").alias("near"), F.first("part").alias("part")))
        # A part is the path of one of its files, so it has a row of its own. A hot one is told by its files.
        roots = found.select(F.col("rep").alias("near"), F.col("near").alias("root"))
        after = written(skew_join(found, roots, ["near"]).select("rep", F.least("near", "root").alias("next"), "part"))
        if after.where("next <> part").isEmpty():
            return after.select("rep", "part")
        parts = after.select("rep", F.col("next").alias("part"))


def _seeds_at_once(open_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open paths that are the smallest in each of their buckets, and the rows that stay open after them."""
    smallest = open_rows.groupBy("bucket").agg(F.min("rep").alias("smallest"), F.count("*").alias("n"))
    sizes = smallest.select("bucket", "n")
    verdict = skew_join(open_rows, smallest.drop("n"), ["bucket"], sizes=sizes).groupBy("rep").agg(
        F.bool_and(F.col("rep") == F.col("smallest")).alias("seed")
    )
    seeds = written(verdict.where("seed").select("rep"))
    taken = open_rows.join(seeds, "rep", "left_semi").select("bucket").distinct()
    closed = skew_join(open_rows, taken, ["bucket"], "left_semi", sizes=sizes).select("rep").distinct()
    return seeds, written(open_rows.join(closed, "rep", "left_anti"))


def seeds_of(graph: DataFrame, *, part_rows: int = PART_ROWS) -> tuple[DataFrame, int]:
    """(rep) of the greedy walk over bucket membership (bucket, rep), and the number of rounds it took.

    Up to ``part_rows`` open rows are walked in one task. More are closed by a round, in which an open path
    is a seed once it is the smallest open path in each of its buckets and a bucket with a seed closes all its
    paths. What stays open is split into connected parts; each part of up to ``part_rows`` rows is walked in a
    task, and only larger ones go to the next round.
    """
    spark, rounds = graph.sparkSession, 0
    found = spark.createDataFrame([], graph.select("rep").schema)
    open_rows = graph
    while n := open_rows.count():
        if n <= part_rows:
            return found.unionByName(written(open_rows.groupBy().applyInPandas(_walk, "rep string"))), rounds
        rounds += 1
        seeds, open_rows = _seeds_at_once(open_rows)
        found = found.unionByName(seeds)
        if open_rows.isEmpty():
            break
        rows = written(open_rows.join(_connected(open_rows), "rep"))
        small = rows.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") <= part_rows).select("part")
        found = found.unionByName(written(rows.join(small, "part", "left_semi").groupBy("part").applyInPandas(_walk, "rep string")))
        open_rows = written(rows.join(small, "part", "left_anti").drop("part"))
    return found, rounds


def dedup_clusters(signatures: DataFrame, *, threshold: float = 0.9, num_perm: int = 128, part_rows: int = PART_ROWS) -> DataFrame:
    """Greedy clusters in path order: (seed, path, size).

    Walking the paths in order, a path no earlier cluster holds becomes a seed and its cluster is
    every file it shares a bucket with; clusters may overlap. No two seeds share a bucket, so the
    membership rows stay within bands x files. ``seeds_of`` says how the walk is spread.
    """
    bands, rows = sketch.banding(threshold, num_perm)
    reps, members = _representatives(signatures, bands, rows)
    buckets = reps.select("rep", "sig", F.explode("buckets").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    graph = written(skew_join(buckets, shared.select("bucket"), ["bucket"], sizes=shared))
    seeds, _ = seeds_of(graph.select("bucket", "rep"), part_rows=part_rows)
    owner = graph.join(seeds, "rep", "left_semi").select("bucket", F.col("rep").alias("seed"))
    near = skew_join(graph, owner, ["bucket"]).select("seed", "sig").distinct()
    # A representative with copies but no near neighbour still is the seed of its copies.
    alone = reps.where("copies > 1").join(graph.select("rep").distinct(), "rep", "left_anti").select(F.col("rep").alias("seed"), "sig")
    clusters = written(skew_join(members, near.unionByName(alone), ["sig"]).select("seed", "path"))
    return members_of_repeated_groups(clusters, "seed", "size")


def text_digests(corpus: DataFrame) -> DataFrame:
    """(path, digest) of the normalised texts."""
    return corpus.select("path", F.md5(normalise_code(F.col("content"))).alias("digest"))


def sketches(corpus: DataFrame) -> DataFrame:
    """(path, digest, signature) from one read, for clusters and for the comparison of their texts."""
    texts = corpus.select("path", normalise_code(F.col("content")).alias("text"))
    return sketch.with_signature(texts.withColumn("digest", F.md5("text")), "text")


def near_duplicates(corpus: DataFrame, clusters: DataFrame, *, threshold: float = 0.9, digests: DataFrame | None = None) -> DataFrame:
    """Cluster members whose shingle Jaccard with their seed reaches ``threshold``: (seed, path, jaccard).

    Clusters come from sketches; this compares the whole texts. Equal normalised texts are told by ``digests``
    (path, digest), which ``sketches`` gives without another read. Of the others each distinct text is read
    once, as its sorted 62-bit shingle hashes; no text travels in a pair, pairs of texts with too different
    numbers of shingles are left out first, and copies of a pair are compared once.
    """
    marks = text_digests(corpus) if digests is None else digests.select("path", "digest")
    pairs = clusters.where(F.col("seed") != F.col("path")).select("seed", "path").join(marks, "path")
    pairs = written(pairs.join(marks.select(F.col("path").alias("seed"), F.col("digest").alias("seed_digest")), "seed"))
    differ = pairs.where("digest <> seed_digest")
    kinds = written(differ.groupBy("seed_digest", "digest").agg(F.min("seed").alias("seed"), F.min("path").alias("path"), F.count("*").alias("n")))
    wanted = kinds.select("digest", "path").unionByName(kinds.select(F.col("seed_digest").alias("digest"), F.col("seed").alias("path")))
    wanted = wanted.groupBy("digest").agg(F.min("path").alias("path"))
    texts = corpus.select("path", "content").join(wanted, "path").select("digest", normalise_code(F.col("content")).alias("text"))
    grams = written(sketch.with_grams(texts, "text"))
    lengths = grams.select("digest", "n_grams")
    sized = kinds.select("seed_digest", "digest").join(lengths, "digest").join(
        lengths.select(F.col("digest").alias("seed_digest"), F.col("n_grams").alias("n_seed")), "seed_digest")
    close = sized.where(F.least("n_grams", "n_seed") >= threshold * F.greatest("n_grams", "n_seed")).select("seed_digest", "digest")
    own = close.join(grams.select("digest", "grams"), "digest")
    sizes = close.groupBy("seed_digest").agg(F.count("*").alias("n"))
    both = skew_join(own, grams.select(F.col("digest").alias("seed_digest"), F.col("grams").alias("seed_grams")), ["seed_digest"],
                     sizes=sizes, slice_rows=COMPARED_ROWS, salt=F.xxhash64("digest"))
    alike = sketch.with_jaccard(both, "grams", "seed_grams").where(F.col("jaccard") >= threshold)
    same = pairs.where("digest = seed_digest").select("seed", "path", F.lit(1.0).alias("jaccard"))
    found = skew_join(differ, alike, ["seed_digest", "digest"], sizes=kinds.select("seed_digest", "digest", "n"))
    return found.select("seed", "path", "jaccard").unionByName(same)


def duplicate_totals(clusters: DataFrame) -> DataFrame:
    """Number of clusters, largest cluster and member rows."""
    sizes = clusters.groupBy("seed").agg(F.count("*").alias("size"))
    return sizes.agg(F.count("*").alias("clusters"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"),
                     F.coalesce(F.sum("size"), F.lit(0)).alias("members"))
