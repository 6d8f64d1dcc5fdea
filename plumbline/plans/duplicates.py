"""File index and duplicate queries over ``documents`` seen as files, and turns of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sketch
from ..operators import duplicates as op
from ..session import cut_lineage, scratch_dir, written
from ..sources import sinks
from ..sources.bindings import document_files, table
from ..sources.corpus import with_extension
from .registry import query

FILES = """
WITH f AS (SELECT doc_id, source || '/' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.c'
                  WHEN 'fr' THEN '.js' WHEN 'es' THEN '.cs' ELSE '.txt' END AS path, text AS content FROM documents)
"""
NORMAL = FILES + r"""
, n AS (SELECT path, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(content), '#.*', '', 'g'),
          '//.*', '', 'g'), '(?s)/\*.*?\*/', '', 'g'),
          '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '', 'g') AS t FROM f)
"""


def _index(spark, folder):
    """The file index, kept as a narrow table: the texts are read and hashed once."""
    return cut_lineage(op.file_fingerprint(document_files(spark, folder), project_root="documents"))


@query("file_fingerprint", FILES + """
SELECT path, string_split(path, '/')[-1] AS filename, '.' || string_split(path, '.')[-1] AS extension,
       CAST(strlen(content) AS BIGINT) AS size, sha256(content) AS hash, 'documents' AS project_root FROM f""")
def file_fingerprint(spark, folder):
    return op.file_fingerprint(document_files(spark, folder), project_root="documents")


@query("corpus_ext_filter", FILES + """
SELECT path FROM f WHERE regexp_matches(path, '\\.(py|js|ts|java|cs|cpp|c|go|rb|php|rs)$')""")
def corpus_ext_filter(spark, folder):
    return with_extension(document_files(spark, folder)).select("path")


@query("normalize_code", NORMAL + "SELECT path, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS hash FROM n")
def normalize_code(spark, folder):
    text = op.normalise_code(F.col("content"))
    return document_files(spark, folder).select("path", text.alias("t")).select(
        "path", F.length("t").cast("bigint").alias("n_chars"), F.sha2("t", 256).alias("hash"))


@query("exact_duplicates", FILES + """
, h AS (SELECT path, sha256(content) AS hash FROM f)
SELECT hash, count(*) OVER (PARTITION BY hash) AS copies, path FROM h QUALIFY copies > 1""")
def exact_duplicates(spark, folder):
    return op.exact_duplicates(_index(spark, folder))


@query("duplicate_groups", FILES + """
SELECT sha256(content) AS hash, count(*) AS copies, min(path) AS first_path FROM f GROUP BY ALL HAVING count(*) > 1""")
def duplicate_groups(spark, folder):
    return op.duplicate_groups(op.file_fingerprint(document_files(spark, folder), project_root="documents"))


@query("clones_of", FILES + """
, h AS (SELECT path, sha256(content) AS hash, 'proc_' || doc_id AS proc_name FROM f),
g AS (SELECT hash, count(*) - 1 AS clones FROM h GROUP BY hash HAVING count(*) > 1 AND bool_or(proc_name ILIKE '%OC_1%'))
SELECT hash, path, proc_name ILIKE '%OC_1%' AS matched, clones FROM h JOIN g USING (hash)""")
def clones_of(spark, folder):
    files = _index(spark, folder)
    number = F.regexp_extract("path", r"/(\d+)", 1)
    procedures = files.select("path", F.concat(F.lit("proc_"), number).alias("proc_name"))
    return op.clones_of(procedures, files, "OC_1")


@query("index_upsert", """
SELECT path, batch, seq, hash FROM (
  SELECT 'conv/' || conv_id AS path, CASE role WHEN 'user' THEN 1 ELSE 2 END AS batch, turn AS seq, sha256(text) AS hash
  FROM conversations)
QUALIFY row_number() OVER (PARTITION BY path ORDER BY batch DESC, seq DESC, hash DESC) = 1""")
def index_upsert(spark, folder):
    turns = table(spark, folder, "conversations").select(
        F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("path"),
        F.when(F.col("role") == "user", 1).otherwise(2).alias("batch"), F.col("turn").alias("seq"),
        F.sha2("text", 256).alias("hash"))
    return op.index_upsert(turns.where("batch = 1"), turns.where("batch = 2"))


@query("index_round_trip", FILES + """
SELECT path, string_split(path, '/')[-1] AS filename, '.' || string_split(path, '.')[-1] AS extension, CAST(strlen(content) AS BIGINT) AS size, sha256(content) AS hash,
       CASE WHEN regexp_matches(path, '\\.(py|c)$') THEN 'second' ELSE 'first' END AS project_root FROM f""")
def index_round_trip(spark, folder):
    """All files indexed, those of two kinds indexed again, the first run repeated, and what the index then holds."""
    files, index = document_files(spark, folder), scratch_dir(spark, "index")
    first = op.file_fingerprint(files, project_root="first")
    second = op.file_fingerprint(with_extension(files, (".py", ".c")), project_root="second")
    for run, rows in ((1, first), (2, second), (1, first)):
        sinks.merge_index(rows, index, run, buckets=8)
    return sinks.read_index(spark, index, first.schema, buckets=8)


P = int(sketch.PRIME)
A, B = (values.tolist() for values in sketch.permutations(128, 1))
BANDS, ROWS = sketch.banding(0.9)
FOLD = "c0"
for _i in range(1, sketch.WIDTH):
    FOLD = f"(({FOLD}) * {int(sketch.BASE)} + c{_i}) % {P}"
_MINIMA = ", ".join(f"min((x * {m} + {o}) % {P})" for m, o in zip(A, B))

# The same sketch in SQL: characters by position, shingles as a polynomial, its fifth power, 128 minima.
SIGNED = NORMAL + f"""
, chars AS (SELECT path, list_resize(CASE WHEN t = '' THEN [] ELSE list_transform(string_split(t, ''), lambda c: CAST(unicode(c) + 1 AS BIGINT)) END,
                   greatest(length(t), {sketch.WIDTH}), CAST({sketch.PAD + 1} AS BIGINT)) AS l FROM n),
pos AS (SELECT path, unnest(l) AS c0, unnest(range(1, len(l) + 1)) AS i FROM chars),
five AS (SELECT path, c0, {", ".join(f"lead(c0, {k}) OVER w AS c{k}" for k in range(1, sketch.WIDTH))} FROM pos WINDOW w AS (PARTITION BY path ORDER BY i)),
poly AS (SELECT DISTINCT path, {FOLD} AS h FROM five WHERE c{sketch.WIDTH - 1} IS NOT NULL),
sq AS (SELECT path, h, h * h % {P} AS h2 FROM poly),
mixed AS (SELECT path, (h2 * h2 % {P}) * h % {P} AS x FROM sq),
signed AS (SELECT path, [{_MINIMA}] AS sig FROM mixed GROUP BY path)
"""
BUCKETS = SIGNED + f"""
, bk AS (SELECT path, CAST(u.b AS INTEGER) AS band, u.k AS bucket FROM (
           SELECT path, unnest([{", ".join(f"{{'b': {b}, 'k': md5(array_to_string(sig[{b * ROWS + 1}:{(b + 1) * ROWS}], ','))}}" for b in range(BANDS))}]) AS u FROM signed)),
sized AS (SELECT band, bucket, path, count(*) OVER (PARTITION BY band, bucket) AS members FROM bk QUALIFY members > 1)
"""
# The greedy walk itself: one step per candidate in path order, carrying the seeds so far.
CLUSTERS = BUCKETS.replace("WITH f", "WITH RECURSIVE f", 1) + """
, near AS MATERIALIZED (SELECT DISTINCT a.path, b.path AS other FROM sized a JOIN sized b USING (band, bucket)),
todo AS MATERIALIZED (SELECT path, row_number() OVER (ORDER BY path) AS i, list(other) FILTER (WHERE other < path) AS earlier FROM near GROUP BY path),
walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS seeds
         UNION ALL SELECT todo.i, CASE WHEN list_has_any(coalesce(earlier, []), seeds) THEN seeds ELSE list_append(seeds, path) END
         FROM walk JOIN todo ON todo.i = walk.i + 1),
seeds AS (SELECT unnest(seeds) AS seed FROM (SELECT seeds FROM walk ORDER BY i DESC LIMIT 1)),
clusters AS (SELECT seed, other AS path, count(*) OVER (PARTITION BY seed) AS size FROM seeds JOIN near ON near.path = seed)
"""


@query("shingle", SIGNED + f"""
SELECT path, count(*) AS shingles FROM (SELECT DISTINCT path, c0, c1, c2, c3, c4 FROM five WHERE c{sketch.WIDTH - 1} IS NOT NULL) GROUP BY path""")
def shingle(spark, folder):
    return document_files(spark, folder).select("path", F.size(op.shingles(F.col("content"))).cast("bigint").alias("shingles"))


def _signatures(spark, folder):
    return op.minhash_signature(document_files(spark, folder))


@query("minhash_signature", SIGNED + "SELECT path, array_to_string(sig, ',') AS signature FROM signed")
def minhash_signature(spark, folder):
    """The 128 values as text, so that both engines show the same value."""
    return _signatures(spark, folder).select("path", F.array_join(F.col("signature").cast("array<string>"), ",").alias("signature"))


@query("index_files", SIGNED + """
SELECT path, string_split(path, '/')[-1] AS filename, '.' || string_split(path, '.')[-1] AS extension, CAST(strlen(content) AS BIGINT) AS size,
       sha256(content) AS hash, 'documents' AS project_root, md5(array_to_string(sig, ',')) AS minhash FROM f JOIN signed USING (path)""")
def index_files(spark, folder):
    rows = op.index_files(document_files(spark, folder), project_root="documents")
    return rows.withColumn("minhash", F.md5(F.array_join(F.col("minhash").cast("array<string>"), ",")))


@query("lsh_candidates", BUCKETS + "SELECT * FROM sized")
def lsh_candidates(spark, folder):
    return op.lsh_candidates(_signatures(spark, folder))


@query("dedup_clusters", CLUSTERS + "SELECT * FROM clusters")
def dedup_clusters(spark, folder):
    return op.dedup_clusters(_signatures(spark, folder))


@query("near_duplicates", CLUSTERS + """
, tokens AS (SELECT DISTINCT path, [c0, c1, c2, c3, c4] AS s FROM five WHERE c4 IS NOT NULL),
sizes AS (SELECT path, count(*) AS n FROM tokens GROUP BY path),
pairs AS (SELECT seed, path FROM clusters WHERE seed <> path),
common AS (SELECT seed, pairs.path, count(*) AS n FROM pairs JOIN tokens a ON a.path = seed JOIN tokens b ON b.path = pairs.path AND b.s = a.s GROUP BY ALL)
SELECT seed, common.path, common.n / (x.n + y.n - common.n) AS jaccard FROM common
JOIN sizes x ON x.path = seed JOIN sizes y ON y.path = common.path WHERE common.n / (x.n + y.n - common.n) >= 0.9""")
def near_duplicates(spark, folder):
    files = document_files(spark, folder)
    kept = written(op.sketches(files))
    return op.near_duplicates(files, op.dedup_clusters(kept), digests=kept)


@query("duplicate_pair_count", CLUSTERS + """
, per AS (SELECT seed, count(*) AS n FROM clusters GROUP BY seed)
SELECT count(*) AS clusters, coalesce(max(n), 0) AS largest, CAST(coalesce(sum(n), 0) AS BIGINT) AS members FROM per""")
def duplicate_pair_count(spark, folder):
    return op.duplicate_totals(op.dedup_clusters(_signatures(spark, folder)))
