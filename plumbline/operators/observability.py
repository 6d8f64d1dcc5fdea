"""Service graph, health, tool metrics and traces."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import top_k_per_group


def service_edges(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """Distinct (source, target, protocol) with the time it was first seen, from both origins."""
    return declared.unionByName(observed).groupBy("source", "target", "protocol").agg(
        F.min("ts").alias("discovered_at")
    )


def service_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(
        F.struct(F.col("source").alias("id")), F.struct(F.col("target").alias("id"))
    ))).distinct()


def _percentile(column: str, share: float) -> Column:
    """Exact percentile of whole milliseconds; the combined state is one count per distinct value."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {column})").cast("bigint")


def health_snapshot(probes: DataFrame) -> DataFrame:
    """Uptime percent, last incident and P95 latency per service, all with map-side combine."""
    return probes.groupBy("service").agg(
        (F.avg(F.col("ok").cast("int")) * 100).alias("uptime_pct"),
        F.max(F.when(~F.col("ok"), F.col("ts"))).alias("last_incident"),
        _percentile("latency_ms", 0.95).alias("p95_ms"),
    )


def tool_metrics(calls: DataFrame, *, now: datetime) -> DataFrame:
    """Latency percentiles, error rate and calls in the last 24 hours per server and tool."""
    recent = F.col("ts") > F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz") - F.expr("INTERVAL 24 HOURS")
    return calls.where(F.col("ts") <= F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")).groupBy("server", "tool").agg(
        _percentile("latency_ms", 0.5).alias("p50_ms"),
        _percentile("latency_ms", 0.95).alias("p95_ms"),
        F.avg(F.col("error").cast("int")).alias("error_rate"),
        F.count_if(recent).alias("calls_last_24h"),
    )


def top_callers(calls: DataFrame, *, k: int = 3) -> DataFrame:
    counts = calls.groupBy("server", "tool", "caller").agg(F.count("*").alias("calls"))
    return top_k_per_group(counts, ["server", "tool"], k, F.desc("calls"), F.asc("caller"))


def tool_daily_rollup(calls: DataFrame) -> DataFrame:
    return calls.groupBy("server", "tool", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("calls"), F.count_if("error").alias("errors"),
        F.sum("latency_ms").alias("total_latency_ms"),
    )


def error_rates(calls: DataFrame, *, window: str) -> DataFrame:
    """Calls and error rate per tumbling window; runs on batches and on streams."""
    return calls.groupBy(F.window("ts", window).alias("w"), "server", "tool").agg(
        F.count("*").alias("calls"), F.count_if("error").alias("errors")
    ).select(
        F.col("w.start").alias("window_start"), "server", "tool", "calls", "errors",
        (F.col("errors") / F.col("calls")).alias("error_rate"),
    )


def tool_degraded_alert(calls: DataFrame, *, window: str, threshold: float) -> DataFrame:
    return error_rates(calls, window=window).where(F.col("error_rate") > threshold)


def trace_tree(spans: DataFrame) -> DataFrame:
    """Each span with its parent's name and the time not covered by the parent's start."""
    parents = spans.select(
        "trace_id", F.col("span_id").alias("parent_id"), F.col("name").alias("parent_name"),
        F.col("started_at").alias("parent_started_at"),
    )
    return spans.join(parents, ["trace_id", "parent_id"], "left").select(
        "trace_id", "span_id", "parent_id", "name", "parent_name", "duration_ms",
        F.expr("timestampdiff(SECOND, parent_started_at, started_at)").alias("offset_s"),
    )
