"""Stream queries: the events table posted as JSON text, some of it faulty, in batch and as a stream; costs and calls as streams that raise alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_dir
from ..sources.bindings import bind_wire, finops, spread, table
from ..streaming import alerts, ingest
from .finops import C as COSTS
from .observability import K as CALLS_SQL
from .observability import _calls
from .registry import query
from .telemetry import EV

FAULTS = EV + """
, v AS (SELECT *, CAST(id AS BIGINT) AS n FROM ev),
x AS (SELECT *, CASE WHEN n % 29 = 11 THEN 'malformed_json'
                     WHEN n % 19 = 7 OR n % 23 = 9 THEN 'missing_field'
                     WHEN n % 17 = 5 THEN 'unknown_event_type' END AS reason FROM v),
ok AS (SELECT n, event_type, project_slug, CASE WHEN n % 3 <> 0 THEN github_username ELSE '' END AS github_username,
              CASE WHEN n % 3 <> 1 THEN '1.1' ELSE '1.0' END AS schema_version, event_ts, cost,
              CASE WHEN event_type = 'skill.invoked' THEN cost END AS paid
       FROM x WHERE reason IS NULL)
"""


@query("ingest_validate", FAULTS + "SELECT n, reason IS NULL AS accepted, reason FROM x")
def ingest_validate(spark, folder):
    checked = ingest.validate(bind_wire(table(spark, folder, "events")))
    return checked.select("n", F.col("reason").isNull().alias("accepted"), "reason")


@query("ingest_enrich", FAULTS + "SELECT event_type, project_slug, github_username, schema_version, event_ts FROM ok")
def ingest_enrich(spark, folder):
    rows = ingest.enrich(ingest.validate(bind_wire(table(spark, folder, "events"))))
    return rows.select("event_type", "project_slug", "github_username", "schema_version", "event_ts")


def _run(spark, folder) -> str:
    """Streams the whole events table through the ingest job into a fresh store."""
    schema = table(spark, folder, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    store = scratch_dir(spark, "ingest")
    ingest.start_ingest(bind_wire(spread(raw, "event_id")), store).awaitTermination()
    return store


APPENDED = FAULTS + """
SELECT event_type, project_slug, github_username, schema_version, event_ts, CAST(event_ts AS DATE) AS event_date FROM ok"""
ROLLED = FAULTS + """
SELECT project_slug, event_type, CAST(event_ts AS DATE) AS day, count(*) AS event_count,
       CAST(sum(paid) AS DOUBLE) AS daily_cost_usd FROM ok GROUP BY ALL"""
STORED = ("event_type", "project_slug", "github_username", "schema_version", "event_ts", "event_date")


@query("ingest_append", APPENDED)
def ingest_append(spark, folder):
    return ingest.read_events(spark, _run(spark, folder)).select(*STORED)


@query("rollup_refresh", ROLLED)
def rollup_refresh(spark, folder):
    rollup = ingest.read_rollup(spark, _run(spark, folder))
    return rollup.withColumn("daily_cost_usd", F.col("daily_cost_usd").cast("double"))


def _run_in_batches(spark, folder) -> str:
    """The whole events table in four batches, one of them replayed, with a compaction after the third."""
    store, wire = scratch_dir(spark, "ingest"), bind_wire(table(spark, folder, "events"))
    for batch_id in range(4):
        ingest.store_batch(wire.where(F.col("n") % 4 == batch_id).select("value"), batch_id, store, compact_every=3)
        if batch_id in (1, 2):
            ingest.store_batch(wire.where(F.col("n") % 4 == batch_id).select("value"), batch_id, store, compact_every=3)
    return store


@query("ingest_compacted", APPENDED)
def ingest_compacted(spark, folder):
    return ingest.read_events(spark, _run_in_batches(spark, folder)).select(*STORED)


@query("rollup_compacted", ROLLED)
def rollup_compacted(spark, folder):
    rollup = ingest.read_rollup(spark, _run_in_batches(spark, folder))
    return rollup.withColumn("daily_cost_usd", F.col("daily_cost_usd").cast("double"))


STREAM_BUDGET = 2_000_000.0


@query("budget_alert_stream", COSTS + f"""
, s AS (SELECT org, CAST(date_trunc('month', ts) AS DATE) AS month, CAST(sum(cost) AS DOUBLE) AS spend FROM c GROUP BY ALL)
SELECT org, month, CAST(t.threshold AS DOUBLE) AS threshold, CAST(1 AS BIGINT) AS alerts
FROM s, (VALUES (0.8), (1.0)) AS t(threshold) WHERE spend >= t.threshold * {STREAM_BUDGET:.0f}""")
def budget_alert_stream(spark, folder):
    """All cost events as a stream of files, in an order that has nothing to do with time; each threshold is crossed once."""
    source, store = scratch_dir(spark, "costs"), scratch_dir(spark, "budget")
    costs = finops(spark, folder).select("org", "ts", "cost_usd")
    costs.repartition(6).write.parquet(source)
    stream = spark.readStream.schema(costs.schema).option("maxFilesPerTrigger", 2).parquet(source)
    alerts.start_budget_alerts(stream, store, monthly_budget_usd=STREAM_BUDGET).awaitTermination()
    return alerts.read_budget_alerts(spark, store).groupBy("org", "month", "threshold").agg(F.count("*").alias("alerts"))


# Calls of ten days arrive together, and every 50th call with the last of them, days late.
ARRIVAL = "CASE WHEN id % 50 = 0 THEN 2 ELSE least((dayofmonth(ts) - 1) // 10, 2) END"


@query("tool_degraded_stream", CALLS_SQL + f"""
, a AS (SELECT *, {ARRIVAL} AS arrival, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01 00:00:00') AS window_start FROM k),
m AS (SELECT arrival, max(ts) AS latest FROM a GROUP BY arrival),
w AS (SELECT a.arrival, (SELECT max(latest) FROM m WHERE m.arrival < a.arrival) - INTERVAL '4 days' AS mark FROM m AS a)
SELECT window_start, server, tool, count(*) AS calls, count(*) FILTER (WHERE error) AS errors, count(*) FILTER (WHERE error) / count(*) AS error_rate
FROM a JOIN w USING (arrival) WHERE mark IS NULL OR window_start + INTERVAL '6 hours' > mark
GROUP BY ALL HAVING window_start + INTERVAL '6 hours' <= (SELECT max(latest) FROM m) - INTERVAL '4 days' AND count(*) FILTER (WHERE error) / count(*) > 0.25""")
def tool_degraded_stream(spark, folder):
    """Calls as they arrive in three runs of one stream, some too late for their window."""
    source, store = scratch_dir(spark, "calls"), scratch_dir(spark, "degraded")
    calls = _calls(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    arrival = F.when(F.col("id") % 50 == 0, 2).otherwise(F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)))
    for turn in range(3):
        calls.where(arrival == turn).write.mode("append").parquet(source)
        stream = spark.readStream.schema(calls.schema).parquet(source)
        alerts.start_degraded_alerts(stream, store, window="6 hours", lateness="4 days", threshold=0.25).awaitTermination()
    return alerts.read_degraded_alerts(spark, store).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
