"""One query for each operator over its whole table, and the SQL that can check it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, chunks, decontam, html, langid, lexical, lines, packing, quality, sharding, simhash, toxicity, whitening
from .text import text_hash_mod

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if check is not None:
            CHECKS[name] = check
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def hex16(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


@query("op1_kd_sharding")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    dealt = sharding.kd_shards(docs, shards=8)
    return dealt.select(F.col("doc").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, words=4, bits=64, radius=4)
    return found.select("doc_id", hex16("fp_lo").alias("fingerprint"), "component_id")


LINES_SQL = r"""
WITH line AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
repeated AS (
  SELECT key, max(doc_id) AS last FROM line WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.*, r.last IS NOT NULL AND r.last <> l.doc_id AS gone FROM line l LEFT JOIN repeated r ON l.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op3_line_dedup", LINES_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


TOKENIZER = "byte_bpe_50k.json"


@query("op4_genetic_packing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    packed = packing.pack(packing.pieces(docs, public_tokenizers.path(TOKENIZER)))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op5_rank_order_language_id")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    held_out = text_hash_mod(F.col("doc_id"), 3) == 1
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = langid.language_id(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op8_nb_ngram_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    held_out = text_hash_mod(F.col("doc_id"), 5) == 0
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.classifier(docs, table(spark, folder, "labels"), ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op9_decision_list_quality")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.judged(docs, table(spark, folder, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_max_subsequence_html")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op6_string_tiling_decontamination")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontam.overlaps(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "n_words", F.size("tiles").cast("long").alias("n_tiles"))


@query("op7_gear_chunk_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return chunks.repeated_passages(docs).select("doc_id", "start", "end", "n_words", "first_doc_id")


# In 64-bit numbers throughout, but for the weight, which is made in doubles.
SEARCH_SQL = r"""
WITH doc_term AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
item_term AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
size AS (SELECT doc_id, count(*) AS words FROM doc_term GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(words)::BIGINT AS words FROM size),
posting AS (SELECT doc_id, term, count(*) AS tf FROM doc_term WHERE term IN (SELECT term FROM item_term) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM posting, total GROUP BY term, docs),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * size.words * total.docs) // total.words))))::BIGINT AS score
  FROM posting JOIN weight USING (term) JOIN item_term USING (term) JOIN size USING (doc_id), total GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""


@query("op11_nra_lexical_search", SEARCH_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=20)


# Events of a turn, and code points of a streamed event.
TURN_EVENTS = 1 << 24
STREAMED = 1000


def conversation_log(rows: DataFrame) -> DataFrame:
    """Rows by turn as the event log that would have made them: an assistant's text is streamed, others come at once."""
    pieces = F.transform(F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % STREAMED), F.lit(0)),
                         lambda p, i: F.struct((i + 1).alias("place"), F.lit("delta").alias("kind"), p.alias("text")))
    opening = lambda text: F.array(F.struct(F.lit(0).alias("place"), F.lit("open").alias("kind"), text.alias("text")))
    events = F.when((F.col("role") == "assistant") & F.col("text").isNotNull(), F.concat(opening(F.lit("")), pieces)).otherwise(opening(F.col("text")))
    each = rows.select("conv_id", "turn", "role", F.monotonically_increasing_id().alias("message"), events.alias("events"))
    return each.select("conv_id", "turn", "role", "message", F.explode("events").alias("e")).select(
        "conv_id", "message", (F.col("turn") * TURN_EVENTS + F.col("e.place")).alias("seq"), F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))


CONTROL_PATTERN = r"([<\[])(\\*)(\|begin_of_text\|>|\|start_header_id\|>|\|end_header_id\|>|\|eot_id\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])"
CHAT_SQL = rf"""
WITH turn AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (length('<|begin_of_text|>') + sum(length('<|start_header_id|><|end_header_id|>' || chr(10) || chr(10) || '<|eot_id|>')
        + length(regexp_replace(role, '{CONTROL_PATTERN}', '\1\\\2\3', 'g')) + length(regexp_replace(text, '{CONTROL_PATTERN}', '\1\\\2\3', 'g'))))::BIGINT AS formatted_chars
FROM turn GROUP BY conv_id
"""


@query("op12_event_sourced_chat", CHAT_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rendered = chat.render(chat.fold(conversation_log(rows.union(planted))), run=chat.MESSAGE_RUN * TURN_EVENTS)
    read = chat.read_back(rendered)
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("messages").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))


@query("op13_lanczos_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows, vector="embedding", scale=256.0, components=4)
    explained = F.array(*[F.lit(float(e) / model.trace) for e in model.variances]) if len(model.variances) else F.array().cast("array<double>")
    each = whitening.whiten(rows, model).select(F.col("row.vec_id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       explained[F.col("place")].alias("explained"), F.lit(model.identity_error).alias("identity_error"))
