"""Service, tool and trace queries; calls are events, spans are order lines under their order."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import observability as op
from ..sources.bindings import table
from .registry import query

CALLS = """
  event_id AS id, concat('srv-', user_id % 7) AS server, event_type AS tool, concat('caller-', user_id % 11) AS caller,
  ts, CAST(round(value * 10, 0) AS BIGINT) AS latency_ms, event_id % 9 = 0 OR user_id % 13 = 5 AS error"""


def _calls(spark, folder):
    events = table(spark, folder, "events")
    return events.select(
        F.col("event_id").alias("id"), F.concat(F.lit("srv-"), (F.col("user_id") % 7).cast("string")).alias("server"),
        F.col("event_type").alias("tool"), F.concat(F.lit("caller-"), (F.col("user_id") % 11).cast("string")).alias("caller"),
        "ts", F.round(F.col("value") * 10, 0).cast("bigint").alias("latency_ms"),
        ((F.col("event_id") % 9 == 0) | (F.col("user_id") % 13 == 5)).alias("error"),
    )


K = f"WITH k AS (SELECT {CALLS} FROM events) "


@query("service_edges", """
WITH d AS (SELECT 'srv-' || s_suppkey AS source, 'nation-' || s_nationkey AS target, 'declared' AS protocol,
                  TIMESTAMP '1990-01-01 00:00:00' AS ts FROM supplier),
o AS (SELECT 'srv-' || l_suppkey, 'part-' || l_partkey, CASE l_returnflag WHEN 'R' THEN 'mcp' ELSE 'http' END, l_shipdate FROM lineitem)
SELECT source, target, protocol, min(ts) AS discovered_at FROM (SELECT * FROM d UNION ALL SELECT * FROM o) GROUP BY ALL""")
def service_edges(spark, folder):
    return op.service_edges(*_edge_sources(spark, folder))


def _edge_sources(spark, folder):
    declared = table(spark, folder, "supplier").selectExpr(
        "concat('srv-', s_suppkey) AS source", "concat('nation-', s_nationkey) AS target", "'declared' AS protocol",
        "TIMESTAMP_NTZ '1990-01-01 00:00:00' AS ts")
    observed = table(spark, folder, "lineitem").selectExpr(
        "concat('srv-', l_suppkey) AS source", "concat('part-', l_partkey) AS target",
        "CASE l_returnflag WHEN 'R' THEN 'mcp' ELSE 'http' END AS protocol", "l_shipdate AS ts")
    return declared, observed


@query("service_nodes", """
SELECT 'srv-' || s_suppkey AS id FROM supplier UNION SELECT 'nation-' || s_nationkey FROM supplier
UNION SELECT 'srv-' || l_suppkey FROM lineitem UNION SELECT 'part-' || l_partkey FROM lineitem""")
def service_nodes(spark, folder):
    return op.service_nodes(op.service_edges(*_edge_sources(spark, folder)))


@query("health_snapshot", K + """
SELECT server AS service, avg(CASE WHEN error THEN 0 ELSE 1 END) * 100 AS uptime_pct,
       max(ts) FILTER (WHERE error) AS last_incident, quantile_disc(latency_ms, 0.95) AS p95_ms FROM k GROUP BY server""")
def health_snapshot(spark, folder):
    probes = _calls(spark, folder).select(F.col("server").alias("service"), (~F.col("error")).alias("ok"), "ts", "latency_ms")
    return op.health_snapshot(probes)


@query("tool_metrics", K + """
SELECT server, tool, quantile_disc(latency_ms, 0.5) AS p50_ms, quantile_disc(latency_ms, 0.95) AS p95_ms,
       avg(CASE WHEN error THEN 1 ELSE 0 END) AS error_rate,
       count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-19 12:00:00') AS calls_last_24h
FROM k WHERE ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY server, tool""")
def tool_metrics(spark, folder):
    return op.tool_metrics(_calls(spark, folder), now=datetime(2024, 1, 20, 12))


@query("tool_top_callers", K + """
, c AS (SELECT server, tool, caller, count(*) AS calls FROM k GROUP BY ALL)
SELECT server, tool, caller, calls, CAST(row_number() OVER (PARTITION BY server, tool ORDER BY calls DESC, caller) AS INTEGER) AS rank
FROM c QUALIFY rank <= 3""")
def tool_top_callers(spark, folder):
    return op.top_callers(_calls(spark, folder))


@query("tool_daily_rollup", K + """
SELECT server, tool, CAST(ts AS DATE) AS day, count(*) AS calls, count(*) FILTER (WHERE error) AS errors,
       CAST(sum(latency_ms) AS BIGINT) AS total_latency_ms FROM k GROUP BY ALL""")
def tool_daily_rollup(spark, folder):
    return op.tool_daily_rollup(_calls(spark, folder))


@query("tool_degraded_alert", K + """
SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01 00:00:00') AS window_start, server, tool,
       count(*) AS calls, count(*) FILTER (WHERE error) AS errors,
       count(*) FILTER (WHERE error) / count(*) AS error_rate
FROM k GROUP BY ALL HAVING count(*) FILTER (WHERE error) / count(*) > 0.25""")
def tool_degraded_alert(spark, folder):
    return op.tool_degraded_alert(_calls(spark, folder), window="6 hours", threshold=0.25)


@query("trace_tree", """
SELECT o_orderkey AS trace_id, 'root' AS span_id, CAST(NULL AS VARCHAR) AS parent_id, 'order' AS name,
       CAST(NULL AS VARCHAR) AS parent_name, CAST(100 AS BIGINT) AS duration_ms, CAST(NULL AS BIGINT) AS offset_s FROM orders
UNION ALL
SELECT l_orderkey, 'l' || l_linenumber || '-' || l_partkey, CASE WHEN l_linenumber = 1 THEN 'root' ELSE 'missing' END, 'line',
       CASE WHEN o_orderkey IS NOT NULL THEN 'order' END, CAST(l_quantity AS BIGINT), date_diff('second', o_orderdate, l_shipdate)
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND l_linenumber = 1""")
def trace_tree(spark, folder):
    roots = table(spark, folder, "orders").selectExpr(
        "o_orderkey AS trace_id", "'root' AS span_id", "CAST(NULL AS STRING) AS parent_id", "'order' AS name",
        "o_orderdate AS started_at", "100L AS duration_ms")
    lines = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey AS trace_id", "concat('l', l_linenumber, '-', l_partkey) AS span_id",
        "CASE WHEN l_linenumber = 1 THEN 'root' ELSE 'missing' END AS parent_id", "'line' AS name",
        "l_shipdate AS started_at", "CAST(l_quantity AS BIGINT) AS duration_ms")
    return op.trace_tree(roots.unionByName(lines))
