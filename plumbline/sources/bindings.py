"""The available Parquet tables seen as engine inputs.

Each binding is a pure projection (plus the joins FinOps needs), so filters and column pruning
pass through it to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Session setting by which the caller asks for a number of partitions of texts and files; unset, the reader's splits stay.
INPUT_PARTITIONS = "spark.plumbline.inputPartitions"


# Rows of which a text or file each is made, for one task: these rows are narrow, so a file of a million of them may be one split.
TEXTS_A_TASK = 10_000


def spread(df: DataFrame, key: str, rows_a_task: int | None = None) -> DataFrame:
    """Deals rows to as many partitions as the session asks for, if it does: a file of one row group is one task otherwise.

    With ``rows_a_task``, for narrow rows that cost much work each, the rows are counted and dealt out by that where the session doesn't ask,
    to no fewer partitions than the cluster has cores.
    """
    asked = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    if asked:
        return df.repartition(int(asked), key)
    if rows_a_task is None:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_a_task)), key)


# File extension given to each document language.
DOCUMENT_EXTENSION = {"en": ".py", "de": ".c", "fr": ".js", "es": ".cs"}


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files: (path, content)."""
    extension = F
    for lang, ext in DOCUMENT_EXTENSION.items():
        extension = extension.when(F.col("lang") == lang, ext)
    docs = spread(table(spark, folder, "documents").select("doc_id", "source", "lang", "text"), "doc_id")
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), extension.otherwise(".txt"))
    return docs.select(name.alias("path"), F.col("text").alias("content"))


# Event type of each type in the events table.
EVENT_TYPE_BINDING = {
    "signup": "project.generated",
    "view": "skill.invoked",
    "error": "ci.run",
    "purchase": "tool.executed",
    "click": "knowledge.used",
}


def _event_type(column: str = "event_type"):
    expr = F
    for raw, bound in EVENT_TYPE_BINDING.items():
        expr = expr.when(F.col(column) == raw, bound)
    return expr


def bind_events(raw: DataFrame) -> DataFrame:
    """Events with the stored envelope.

    The payload mixes the cases the operators must tell apart: JSON true, the string "true",
    false, a missing ``tests_passed``, and a missing ``model``.
    """
    k = F.get_json_object("props", "$.k").cast("bigint")
    passed = (
        F.when(k % 5 == 3, "")
        .when(k % 4 == 0, ', "tests_passed": "true"')
        .when(k % 2 == 0, ', "tests_passed": true')
        .otherwise(', "tests_passed": false')
    )
    model = F.when(k % 10 == 0, "").otherwise(F.concat(F.lit(', "model": "m'), (k % 13).cast("string"), F.lit('"')))
    payload = F.concat(
        F.lit('{"skill_name": "s'), k.cast("string"), F.lit('", "estimated_cost_usd": '),
        F.col("value").cast("string"), passed, model, F.lit("}"),
    )
    return raw.select(
        F.col("event_id").cast("string").alias("id"),
        _event_type().alias("event_type"),
        F.concat(F.lit("p"), (F.col("user_id") % 20).cast("string")).alias("project_slug"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("github_username"),
        F.lit("1.0").alias("schema_version"),
        F.col("ts").alias("received_at"),
        F.col("ts").alias("event_ts"),
        payload.alias("payload"),
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    return bind_events(table(spark, folder, "events"))


def bind_wire(raw: DataFrame) -> DataFrame:
    """The same events as posted JSON text, some of them faulty, for the ingest checks."""
    bound = bind_events(raw)
    n = F.col("id").cast("bigint")
    stamp = F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    body = F.to_json(F.struct(
        F.when(n % 17 == 5, F.lit("unknown.type")).otherwise(F.col("event_type")).alias("event_type"),
        F.when(n % 19 != 7, F.col("project_slug")).alias("project_slug"),
        F.when(n % 3 != 0, F.col("github_username")).alias("github_username"),
        F.when(n % 23 != 9, stamp).alias("timestamp"),
        F.when(n % 3 != 1, F.lit("1.1")).alias("schema_version"),
    ))
    # The payload is already JSON, so it is spliced in rather than quoted.
    with_payload = F.concat(F.left(body, F.length(body) - 1), F.lit(',"payload":'), F.col("payload"), F.lit("}"))
    value = F.when(n % 29 == 11, F.lit("{broken")).otherwise(with_payload)
    return bound.select(n.alias("n"), value.alias("value"))


def finops(spark: SparkSession, folder: str) -> DataFrame:
    """Cost events: order lines with team, project, model and skill looked up."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount"
    )
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment"
    )
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    price = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    return (
        lines.join(parts, "l_partkey").join(orders, "l_orderkey").join(customers, "o_custkey")
        .join(nations, "n_nationkey")
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
            F.concat(F.lit("org-"), F.col("n_regionkey").cast("string")).alias("org"),
            F.col("n_name").alias("team"),
            F.col("c_mktsegment").alias("project"),
            F.col("p_brand").alias("model"),
            F.col("p_type").alias("skill"),
            F.col("l_shipdate").alias("ts"),
            F.col("l_quantity").cast("bigint").alias("tokens_in"),
            price.cast("decimal(18,6)").alias("cost_usd"),
        )
    )
