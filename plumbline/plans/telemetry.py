"""Telemetry queries over the ``events`` table."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..operators import telemetry as op
from ..sources import bindings
from .registry import query

START, END = datetime(2024, 1, 5), datetime(2024, 1, 25)

EV = """
WITH ev AS (
  SELECT CAST(event_id AS VARCHAR) AS id,
         CASE event_type WHEN 'signup' THEN 'project.generated' WHEN 'view' THEN 'skill.invoked'
              WHEN 'error' THEN 'ci.run' WHEN 'purchase' THEN 'tool.executed'
              WHEN 'click' THEN 'knowledge.used' END AS event_type,
         'p' || (user_id % 20) AS project_slug, 'u' || user_id AS github_username, ts AS event_ts,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CAST(value AS DECIMAL(18,6)) AS cost
  FROM events),
w AS (SELECT *, 's' || k AS skill, CASE WHEN k % 10 <> 0 THEN 'm' || (k % 13) END AS model,
             (k % 5 <> 3 AND k % 2 = 0) AS passed
      FROM ev WHERE event_ts >= TIMESTAMP '2024-01-05' AND event_ts <= TIMESTAMP '2024-01-25')
"""

TYPES = ("(VALUES ('project.generated'), ('skill.invoked'), ('ci.run'), ('tool.executed'), "
         "('knowledge.created'), ('knowledge.used')) AS t(event_type)")

TOP_MODELS = """
, groups AS (SELECT model, count(*) AS calls, coalesce(sum(cost), 0) AS cost FROM w
             WHERE event_type = 'skill.invoked' GROUP BY model),
tm AS (SELECT *, row_number() OVER (ORDER BY calls DESC, model NULLS FIRST) AS rk FROM groups
       QUALIFY rk <= 10)
"""


def _events(spark, folder):
    return bindings.events(spark, folder)


def _window(spark, folder):
    return op.events_filter(_events(spark, folder), start=START, end=END)


@query("events_filter", EV + """
SELECT id, event_type, project_slug, event_ts FROM w
WHERE event_type = 'ci.run' AND project_slug = 'p3'""")
def events_filter(spark, folder):
    rows = op.events_filter(_events(spark, folder), event_type="ci.run", project_slug="p3", start=START, end=END)
    return rows.select("id", "event_type", "project_slug", "event_ts")


@query("events_total", EV + "SELECT count(*) AS total FROM w")
def events_total(spark, folder):
    return op.events_total(_window(spark, folder))


@query("events_page", EV + """
SELECT id, event_type, project_slug, github_username, event_ts FROM w
ORDER BY event_ts DESC, id LIMIT 100 OFFSET 50""")
def events_page(spark, folder):
    page = op.events_page(_window(spark, folder), limit=100, offset=50)
    return page.select("id", "event_type", "project_slug", "github_username", "event_ts")


@query("type_counts", EV + f"""
SELECT t.event_type, count(w.id) AS event_count FROM {TYPES} LEFT JOIN w ON w.event_type = t.event_type
GROUP BY t.event_type""")
def type_counts(spark, folder):
    return op.type_counts(_window(spark, folder))


CI = """
, c AS (SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS passed FROM w WHERE event_type = 'ci.run')
"""


@query("ci_stats", EV + CI + "SELECT total, passed, total - passed AS failed FROM c")
def ci_stats(spark, folder):
    return op.ci_stats(_window(spark, folder))


@query("ci_pass_rate", EV + CI + """
SELECT total, passed, total - passed AS failed,
       CAST(round_even(100.0 * passed / total, 0) AS BIGINT) AS rate_half_even,
       CAST(floor(100.0 * passed / total + 0.5) AS BIGINT) AS rate_half_up FROM c""")
def ci_pass_rate(spark, folder):
    return op.ci_pass_rate(op.ci_stats(_window(spark, folder)))


@query("top_skills", EV + """
SELECT coalesce(nullif(skill, ''), 'unknown') AS skill_name, calls FROM (
  SELECT skill, count(*) AS calls FROM w WHERE event_type = 'skill.invoked' GROUP BY skill
  ORDER BY calls DESC, skill NULLS FIRST LIMIT 10)""")
def top_skills(spark, folder):
    return op.top_skills(_window(spark, folder))


@query("top_models", EV + TOP_MODELS + """
SELECT coalesce(nullif(model, ''), 'unknown') AS model, calls, CAST(cost AS DOUBLE) AS total_cost_usd FROM tm""")
def top_models(spark, folder):
    return op.top_models(_window(spark, folder))


@query("total_cost_top10", EV + TOP_MODELS + """
SELECT (SELECT CAST(coalesce(sum(cost), 0) AS DOUBLE) FROM tm) AS total_cost_usd,
       (SELECT CAST(coalesce(sum(cost), 0) AS DOUBLE) FROM groups) AS total_cost_all_usd""")
def total_cost_top10(spark, folder):
    return op.total_cost(_window(spark, folder))


SUMMARY = EV + TOP_MODELS + """
, ts AS (SELECT skill, count(*) AS calls, row_number() OVER (ORDER BY count(*) DESC, skill NULLS FIRST) AS rk
         FROM w WHERE event_type = 'skill.invoked' GROUP BY skill QUALIFY rk <= 10),
s AS (SELECT count(*) FILTER (WHERE event_type = 'project.generated') AS projects_generated,
             count(*) FILTER (WHERE event_type = 'skill.invoked') AS skills_invoked,
             count(*) FILTER (WHERE event_type = 'ci.run') AS ci_total,
             count(*) FILTER (WHERE event_type = 'ci.run' AND passed) AS ci_passed,
             count(*) FILTER (WHERE event_type = 'tool.executed') AS tools_executed,
             count(*) FILTER (WHERE event_type = 'knowledge.created') AS knowledge_created,
             count(*) FILTER (WHERE event_type = 'knowledge.used') AS knowledge_used FROM w)
"""


@query("summary", SUMMARY + """
SELECT projects_generated, skills_invoked, ci_total, ci_passed, ci_total - ci_passed AS ci_failed,
       tools_executed, knowledge_created, knowledge_used,
       (SELECT string_agg(coalesce(nullif(skill, ''), 'unknown') || '=' || calls, ',' ORDER BY rk) FROM ts) AS top_skills,
       (SELECT string_agg(coalesce(nullif(model, ''), 'unknown') || '=' || calls, ',' ORDER BY rk) FROM tm) AS top_models,
       (SELECT CAST(sum(cost) AS DOUBLE) FROM tm) AS total_cost_usd, (SELECT CAST(sum(cost) AS DOUBLE) FROM groups) AS total_cost_all_usd
FROM s""")
def summary(spark, folder):
    """The nested report, its lists written as text so that both engines show the same value."""
    report = op.summary(_events(spark, folder), start=START, end=END)
    pair = lambda name: lambda s: F.concat_ws("=", s[name], s["count"].cast("string"))
    return report.select(
        "projects_generated", "skills_invoked",
        F.col("ci_runs.total").alias("ci_total"), F.col("ci_runs.passed").alias("ci_passed"),
        F.col("ci_runs.failed").alias("ci_failed"),
        "tools_executed", "knowledge_created", "knowledge_used",
        F.array_join(F.transform("top_skills", pair("skill_name")), ",").alias("top_skills"),
        F.array_join(F.transform("top_models", pair("model")), ",").alias("top_models"),
        "total_cost_usd", "total_cost_all_usd",
    )


@query("summary_top5_skills", SUMMARY + """
SELECT coalesce(nullif(skill, ''), 'unknown') AS skill_name, calls AS count FROM ts WHERE rk <= 5""")
def summary_top5_skills(spark, folder):
    return op.summary_top_skills(op.summary(_events(spark, folder), start=START, end=END))


@query("summary_flatten", SUMMARY + """
SELECT 'projects_generated' AS metric, CAST(projects_generated AS VARCHAR) AS value FROM s
UNION ALL SELECT 'skills_invoked', CAST(skills_invoked AS VARCHAR) FROM s
UNION ALL SELECT 'ci_runs.total', CAST(ci_total AS VARCHAR) FROM s
UNION ALL SELECT 'ci_runs.passed', CAST(ci_passed AS VARCHAR) FROM s
UNION ALL SELECT 'ci_runs.failed', CAST(ci_total - ci_passed AS VARCHAR) FROM s
UNION ALL SELECT 'tools_executed', CAST(tools_executed AS VARCHAR) FROM s
UNION ALL SELECT 'knowledge_created', CAST(knowledge_created AS VARCHAR) FROM s
UNION ALL SELECT 'knowledge_used', CAST(knowledge_used AS VARCHAR) FROM s
UNION ALL SELECT 'total_cost_usd', CAST((SELECT CAST(sum(cost) AS DOUBLE) FROM tm) AS VARCHAR)
UNION ALL SELECT 'total_cost_all_usd', CAST((SELECT CAST(sum(cost) AS DOUBLE) FROM groups) AS VARCHAR)""")
def summary_flatten(spark, folder):
    return op.summary_flatten(op.summary(_events(spark, folder), start=START, end=END))


@query("daily_rollup", EV + """
SELECT project_slug, event_type, CAST(date_trunc('day', event_ts) AS DATE) AS day, count(*) AS event_count,
       CAST(sum(cost) FILTER (WHERE event_type = 'skill.invoked') AS DOUBLE) AS daily_cost_usd
FROM ev GROUP BY ALL""")
def daily_rollup(spark, folder):
    rollup = op.daily_rollup(_events(spark, folder))
    return rollup.withColumn("daily_cost_usd", F.col("daily_cost_usd").cast("double"))


@query("rollup_unique_check", EV + """
SELECT project_slug, event_type, day, count(*) AS copies FROM (
  SELECT project_slug, event_type, CAST(date_trunc('day', event_ts) AS DATE) AS day FROM ev GROUP BY ALL)
GROUP BY ALL HAVING count(*) > 1""")
def rollup_unique_check(spark, folder):
    return op.rollup_unique_check(op.daily_rollup(_events(spark, folder)))


@query("rollup_type_counts", EV + f"""
SELECT t.event_type, count(ev.id) AS event_count,
       CAST(coalesce(sum(cost) FILTER (WHERE ev.event_type = 'skill.invoked'), 0) AS DOUBLE) AS cost_usd
FROM {TYPES} LEFT JOIN ev ON ev.event_type = t.event_type AND event_ts >= TIMESTAMP '2024-01-05' AND event_ts < TIMESTAMP '2024-01-26'
GROUP BY t.event_type""")
def rollup_type_counts(spark, folder):
    return op.counts_from_rollup(op.daily_rollup(_events(spark, folder)), first=date(2024, 1, 5), last=date(2024, 1, 25))


def _cost_check(by: str, column: str) -> str:
    return f"""
SELECT '{by}' AS grouping, coalesce(nullif({column}, ''), 'unknown') AS name, count(*) AS calls,
       CAST(coalesce(sum(cost), 0) AS DOUBLE) AS total_cost_usd
FROM w WHERE event_type = 'skill.invoked' GROUP BY {column}"""


@query("cost_by_group", EV + " UNION ALL ".join(
    _cost_check(by, col) for by, col in (("model", "model"), ("skill", "skill"), ("project", "project_slug"))))
def cost_by_group(spark, folder):
    return op.cost_by_groups(_window(spark, folder))


@query("estimate_cost", """
WITH rates AS (SELECT p_brand AS model, 3.0 * min(p_size) AS rin, 15.0 * min(p_size) AS rout FROM part
               WHERE p_brand <> 'Brand#7' GROUP BY p_brand),
u AS (SELECT l_orderkey, l_linenumber, p_brand AS model, CAST(l_quantity AS BIGINT) * 1000 AS tin,
             CAST(l_quantity AS BIGINT) * 500 AS tout
      FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, u.model,
       CAST(round((tin * rin + tout * rout) / 1000000.0, 8) AS DOUBLE) AS estimated_cost_usd
FROM u LEFT JOIN rates USING (model)""")
def estimate_cost(spark, folder):
    """Token usage from order lines, a rate card from parts; one brand has no rate."""
    part = bindings.table(spark, folder, "part")
    rates = part.where("p_brand <> 'Brand#7'").groupBy(F.col("p_brand").alias("model")).agg(
        (F.min("p_size") * F.lit(3.0)).alias("input_usd_per_m"),
        (F.min("p_size") * F.lit(15.0)).alias("output_usd_per_m"),
    )
    lines = bindings.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    usage = lines.join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("model")), "l_partkey")
    usage = usage.select(
        "l_orderkey", "l_linenumber", "model",
        (F.col("l_quantity").cast("bigint") * 1000).alias("input_tokens"),
        (F.col("l_quantity").cast("bigint") * 500).alias("output_tokens"),
    )
    return op.estimate_cost(usage, rates).select("l_orderkey", "l_linenumber", "model", "estimated_cost_usd")


@query("make_event", EV + """
SELECT 'skill.invoked' AS event_type, project_slug, github_username, '1.0' AS schema_version,
       '{"skill_name":"s' || k || '","tokens":' || k || '}' AS payload
FROM ev WHERE event_type = 'skill.invoked'""")
def make_event(spark, folder):
    from ..functions.payload import with_payload

    rows = with_payload(op.events_filter(_events(spark, folder), event_type="skill.invoked")).select(
        "project_slug", "github_username", F.col("event_ts").cast("string").alias("timestamp"),
        F.col("p.skill_name").alias("skill_name"), F.substring("p.skill_name", 2, 20).cast("bigint").alias("tokens"),
    )
    return op.make_event(rows, "skill.invoked", ["skill_name", "tokens"]).drop("timestamp")
