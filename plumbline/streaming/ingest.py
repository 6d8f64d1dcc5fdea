"""Event ingest: checks, defaults, an append-only store, a dead-letter store and the rollup.

The store is folders by day and part, and a list of the live ones that is itself a table. A batch writes a part of each day it
touches, replacing its own if it is replayed, and then its entries of the list. Compaction merges the parts of a day into one and folds the
rollup, writes the whole list anew, and last one row that names the batch it reaches *through*: readers look for the largest, so
they switch in one step, and a replay of a batch that is already folded in changes nothing. Reads of a day open that day's live parts alone.

Late events need no watermark: the rollup is kept as one small delta per batch and summed on read, so an event of any age
lands in its own day at a cost that depends on the batch, not on the days it touches. One writer, the stream, owns a store.
Parts that a compaction has replaced stay in place for readers that began before it; the list tells which are live.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.payload import with_payload
from ..functions.text import once
from ..operators.telemetry import daily_rollup, events_projection
from ..schemas import DAILY_ROLLUP, EVENTS, PAYLOAD, WIRE_EVENT
from ..vocab import EVENT_TYPES

REQUIRED = ("event_type", "project_slug", "timestamp", "payload")


def utc(stamp: Column) -> Column:
    """An instant as UTC wall-clock time, whatever the session zone is."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), stamp.cast("timestamp_ntz"))


def validate(raw: DataFrame) -> DataFrame:
    """Parses ``value`` and adds ``reason``: NULL when accepted, else why not.

    Nothing raises: faulty rows are labelled. Field checks come before the vocabulary check.
    """
    parsed = once(raw, "e", F.from_json("value", WIRE_EVENT))
    stamp = F.col("e.timestamp").try_cast("timestamp")
    nothing = F.coalesce(*[F.col(f"e.{name}") for name in WIRE_EVENT.names]).isNull()
    missing = F.greatest(*[F.col(f"e.{name}").isNull() for name in REQUIRED])
    not_object = ~F.ltrim("e.payload").startswith("{")
    reason = (
        F.when(nothing, "malformed_json")
        .when(missing, "missing_field")
        .when(stamp.isNull() | not_object, "invalid_field")
        .when(~F.col("e.event_type").isin(*EVENT_TYPES), "unknown_event_type")
    )
    return parsed.withColumn("reason", reason)


def enrich(checked: DataFrame, *, received_at: Column | None = None) -> DataFrame:
    """Accepted rows with defaults, a fresh id and the time of receipt."""
    arrived = utc(F.current_timestamp()) if received_at is None else received_at
    return events_projection(
        checked.where(F.col("reason").isNull()).select(
            F.uuid().alias("id"),
            "e.event_type", "e.project_slug",
            F.coalesce("e.github_username", F.lit("")).alias("github_username"),
            F.coalesce("e.schema_version", F.lit("1.0")).alias("schema_version"),
            arrived.alias("received_at"),
            utc(F.col("e.timestamp").try_cast("timestamp")).alias("event_ts"),
            "e.payload",
        )
    )


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reason").isNotNull()).select("value", "reason")


LISTED = "event_date date, part string, rows bigint"
ROLLED = "project_slug string, event_type string, day date, event_count bigint, daily_cost_usd decimal(38,6)"


def create_store(spark: SparkSession, store: str) -> None:
    """An empty list and rollup, and the mark that nothing is folded yet; leaves a store that is there as it is."""
    spark.createDataFrame([], LISTED).write.mode("ignore").parquet(f"{store}/files/since=0/batch_id=-1")
    spark.createDataFrame([], ROLLED).write.mode("ignore").parquet(f"{store}/rollup/since=0/batch_id=-1")
    spark.createDataFrame([(True,)], "complete boolean").coalesce(1).write.mode("ignore").parquet(f"{store}/folded/through=-1")


def folded_through(spark: SparkSession, store: str) -> int:
    """The last batch that compaction has reached, -1 for none."""
    return spark.read.schema("complete boolean, through bigint").parquet(f"{store}/folded").agg(F.max("through")).first()[0]


def live_parts(spark: SparkSession, store: str) -> DataFrame:
    """(event_date, part, rows, batch_id): the parts that make up the store."""
    since = folded_through(spark, store) + 1
    return spark.read.schema(f"{LISTED}, batch_id bigint").parquet(f"{store}/files/since={since}")


def _write_parts(rows: DataFrame, store: str, part: str) -> None:
    # Rebalancing splits a busy day over several writers and merges quiet ones.
    rows.withColumn("part", F.lit(part)).hint("rebalance", "event_date").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("event_date", "part").parquet(f"{store}/events")


def store_batch(batch: DataFrame, batch_id: int, store: str, *, compact_every: int | None = None) -> None:
    """Stores one batch. With ``compact_every`` each batch of that number's multiples ends with a compaction."""
    spark = batch.sparkSession
    create_store(spark, store)
    folded = folded_through(spark, store)
    if batch_id <= folded:
        return
    checked = validate(batch).persist()
    try:
        # The parsed fields are stored too: reports then read those columns and no JSON.
        accepted = with_payload(enrich(checked)).withColumn("event_date", F.to_date("event_ts"))
        _write_parts(accepted, store, f"b{batch_id}")
        rejected(checked).write.mode("overwrite").parquet(f"{store}/dead/batch_id={batch_id}")
        daily_rollup(accepted).write.mode("overwrite").parquet(f"{store}/rollup/since={folded + 1}/batch_id={batch_id}")
        # The delta just written has the days and their rows.
        delta = spark.read.schema(DAILY_ROLLUP).parquet(f"{store}/rollup/since={folded + 1}/batch_id={batch_id}")
        delta.groupBy(F.col("day").alias("event_date")).agg(F.lit(f"b{batch_id}").alias("part"), F.sum("event_count").alias("rows")).coalesce(1).write.mode(
            "overwrite").parquet(f"{store}/files/since={folded + 1}/batch_id={batch_id}")
    finally:
        checked.unpersist()
    if compact_every and (batch_id + 1) % compact_every == 0:
        compact(spark, store)


def start_ingest(raw: DataFrame, store: str, *, available_now: bool = True, compact_every: int | None = 64) -> StreamingQuery:
    """Runs the ingest on a stream with a ``value`` column of JSON text."""
    create_store(raw.sparkSession, store)
    writer = (
        raw.select("value").writeStream.option("checkpointLocation", f"{store}/_progress")
        .foreachBatch(lambda batch, batch_id: store_batch(batch, batch_id, store, compact_every=compact_every))
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _partitioned(schema: T.StructType, **columns: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in columns.items()]])


def _read_parts(spark: SparkSession, store: str, parts: DataFrame) -> DataFrame:
    """The events of listed parts; the list is as long as the days asked for times the parts a day has since it was compacted."""
    schema = _partitioned(EVENTS, p=PAYLOAD, event_date=T.DateType(), part=T.StringType())
    folders = [f"{store}/events/event_date={r['event_date']}/part={r['part']}" for r in parts.select("event_date", "part").collect()]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{store}/events").parquet(*folders)


def read_events(spark: SparkSession, store: str, *, start: date | None = None, end: date | None = None) -> DataFrame:
    """Stored events of the days ``start`` to ``end`` with their parsed payload ``p``, as of now; a filter on ``event_date`` prunes further."""
    parts = live_parts(spark, store)
    if start:
        parts = parts.where(F.col("event_date") >= F.lit(start))
    if end:
        parts = parts.where(F.col("event_date") <= F.lit(end))
    return _read_parts(spark, store, parts)


def read_dead(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema("value string, reason string, batch_id bigint").parquet(f"{store}/dead")


def read_rollup(spark: SparkSession, store: str) -> DataFrame:
    """The daily rollup: what compaction has folded plus later deltas."""
    rows = spark.read.schema(_partitioned(DAILY_ROLLUP, batch_id=T.LongType())).parquet(f"{store}/rollup/since={folded_through(spark, store) + 1}")
    return rows.groupBy("project_slug", "event_type", "day").agg(
        F.sum("event_count").alias("event_count"), F.sum("daily_cost_usd").alias("daily_cost_usd")
    )


def compact(spark: SparkSession, store: str) -> int:
    """Merges the parts of each day that has several, folds the rollup, and returns the batch reached; readers switch at the end."""
    folded = folded_through(spark, store)
    listed = live_parts(spark, store).persist()
    try:
        last = listed.agg(F.max("batch_id")).first()[0]
        if last is None or last <= folded:
            return folded
        days = listed.groupBy("event_date").agg(F.count("*").alias("parts"), F.sum("rows").alias("rows"), F.max("part").alias("part"))
        several = listed.join(days.where("parts > 1").select("event_date"), "event_date", "left_semi")
        _write_parts(_read_parts(spark, store, several).drop("part"), store, f"c{last}")
        part = F.when(F.col("parts") > 1, f"c{last}").otherwise(F.col("part"))
        days.select("event_date", part.alias("part"), "rows").coalesce(1).write.mode("overwrite").parquet(f"{store}/files/since={last + 1}/batch_id={last}")
    finally:
        listed.unpersist()
    rollup = read_rollup(spark, store).withColumn("daily_cost_usd", F.col("daily_cost_usd").cast("decimal(38,6)"))
    rollup.write.mode("overwrite").parquet(f"{store}/rollup/since={last + 1}/batch_id={last}")
    spark.createDataFrame([(True,)], "complete boolean").coalesce(1).write.mode("overwrite").parquet(f"{store}/folded/through={last}")
    return last
