"""Cost queries; cost events are order lines joined to their customer, nation and part."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import finops as op
from ..sources import bindings
from .registry import query

C = """
WITH c AS (
  SELECT 'org-' || n_regionkey AS org, n_name AS team, c_mktsegment AS project, p_brand AS model, p_type AS skill,
         l_shipdate AS ts, CAST(l_quantity AS BIGINT) AS tokens_in,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,6)) AS cost
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
"""
BUDGET = 20_000_000.0


@query("finops_by_team", C + """
SELECT team, CAST(sum(cost) AS DOUBLE) AS total_cost_usd, count(*) AS event_count FROM c GROUP BY team""")
def finops_by_team(spark, folder):
    return op.by_team(bindings.finops(spark, folder))


@query("finops_by_project", C + """
SELECT project, team, CAST(sum(cost) AS DOUBLE) AS total_cost_usd, count(*) AS event_count FROM c
WHERE project = 'MACHINERY' GROUP BY project, team""")
def finops_by_project(spark, folder):
    return op.by_project(bindings.finops(spark, folder), "MACHINERY")


@query("finops_by_model", C + """
, pr AS (SELECT p_brand AS model, 'provider-' || min(p_size) AS provider FROM part WHERE p_brand <> 'Brand#7' GROUP BY p_brand)
SELECT c.model, provider, CAST(sum(cost) AS DOUBLE) AS total_cost_usd, count(*) AS event_count
FROM c LEFT JOIN pr ON pr.model = c.model GROUP BY c.model, provider""")
def finops_by_model(spark, folder):
    providers = bindings.table(spark, folder, "part").where("p_brand <> 'Brand#7'").groupBy(
        F.col("p_brand").alias("model")
    ).agg(F.concat(F.lit("provider-"), F.min("p_size").cast("string")).alias("provider"))
    return op.by_model(bindings.finops(spark, folder), providers)


@query("finops_period", C + """
SELECT team, CAST(sum(cost) AS DOUBLE) AS total_cost_usd, count(*) AS event_count,
       DATE '1997-03-01' AS period_from, DATE '1998-02-28' AS period_to
FROM c WHERE ts >= TIMESTAMP '1997-03-01' AND ts < TIMESTAMP '1998-03-01' GROUP BY team""")
def finops_period(spark, folder):
    rows = op.summary_for_period(bindings.finops(spark, folder), start=date(1997, 3, 1), end=date(1998, 2, 28))
    return rows.select("team", "total_cost_usd", "event_count",
                       F.col("period.from").alias("period_from"), F.col("period.to").alias("period_to"))


@query("burn_rate", C + """
, s AS (SELECT org, CAST(sum(cost) AS DOUBLE) AS spend FROM c
        WHERE ts >= TIMESTAMP '1998-05-01' AND ts < TIMESTAMP '1998-05-13' GROUP BY org)
SELECT org, spend AS spend_to_date_usd, spend / 12 AS daily_spend_usd, CAST(20000000.0 AS DOUBLE) AS monthly_budget_usd,
       CAST(19 AS BIGINT) AS days_remaining, spend / 12 * 31 AS projected_monthly_usd FROM s""")
def burn_rate(spark, folder):
    return op.burn_rate(bindings.finops(spark, folder), as_of=date(1998, 5, 12), monthly_budget_usd=BUDGET)


@query("burn_rate_daily", C + """
, d AS (SELECT team, CAST(ts AS DATE) AS day, sum(cost) AS spend FROM c GROUP BY ALL)
SELECT team, day, CAST(spend AS DOUBLE) AS spend_usd,
       CAST(sum(spend) OVER (PARTITION BY team, date_trunc('month', day) ORDER BY day) AS DOUBLE) AS month_to_date_usd
FROM d""")
def burn_rate_daily(spark, folder):
    return op.burn_rate_daily(bindings.finops(spark, folder))


CONSUMERS = C + """
, u AS (SELECT 'team' AS type, team AS name, cost FROM c UNION ALL SELECT 'model', model, cost FROM c
        UNION ALL SELECT 'skill', skill, cost FROM c UNION ALL SELECT 'project', project, cost FROM c),
g AS (SELECT type, name, CAST(sum(cost) AS DOUBLE) AS total_cost_usd, count(*) AS event_count FROM u GROUP BY ALL)
"""


@query("top_consumers", CONSUMERS + "SELECT * FROM g ORDER BY total_cost_usd DESC, type, name LIMIT 10")
def top_consumers(spark, folder):
    rows = op.top_consumers(bindings.finops(spark, folder))
    return rows.withColumn("event_count", F.col("event_count").cast("bigint"))


@query("top_consumers_by_type", CONSUMERS + """
SELECT * FROM g WHERE type = 'skill' ORDER BY total_cost_usd DESC, name LIMIT 10""")
def top_consumers_by_type(spark, folder):
    return op.top_consumers(bindings.finops(spark, folder), type="skill")


@query("budget_alert", C + """
, d AS (SELECT org, CAST(ts AS DATE) AS day, sum(cost) AS spend FROM c GROUP BY ALL),
r AS (SELECT org, day, spend, sum(spend) OVER (PARTITION BY org, date_trunc('month', day) ORDER BY day) AS mtd FROM d)
SELECT org, CAST(date_trunc('month', day) AS DATE) AS month, CAST(t.threshold AS DOUBLE) AS threshold, day,
       CAST(mtd AS DOUBLE) AS month_to_date_usd
FROM r, (VALUES (0.8), (1.0)) AS t(threshold)
WHERE CAST(mtd AS DOUBLE) >= t.threshold * 2000000 AND CAST(mtd - spend AS DOUBLE) < t.threshold * 2000000""")
def budget_alert(spark, folder):
    return op.budget_alert(bindings.finops(spark, folder), monthly_budget_usd=2_000_000.0)
