"""Cost reports over cost events: breakdowns, burn rate, top consumers and budget alerts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import top_k

CONSUMER_TYPES = ("team", "model", "skill", "project")


def in_period(cost_events: DataFrame, *, start: date | None = None, end: date | None = None) -> DataFrame:
    """Events of the days ``start`` to ``end``, both included. Compares ``ts`` itself, so it is pushed down."""
    if start:
        cost_events = cost_events.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        cost_events = cost_events.where(F.col("ts") < F.date_add(F.lit(end), 1).cast("timestamp_ntz"))
    return cost_events


def _totals():
    return F.sum("cost_usd").cast("double").alias("total_cost_usd"), F.count("*").alias("event_count")


def by_team(cost_events: DataFrame) -> DataFrame:
    return cost_events.groupBy("team").agg(*_totals())


def by_project(cost_events: DataFrame, project: str) -> DataFrame:
    """The team breakdown of one project."""
    return cost_events.where(F.col("project") == project).groupBy("project", "team").agg(*_totals())


def by_model(cost_events: DataFrame, providers: DataFrame) -> DataFrame:
    """Cost per model with its provider. Models are grouped before the lookup, so only groups are joined."""
    return cost_events.groupBy("model").agg(*_totals()).join(providers, "model", "left")


def summary_for_period(cost_events: DataFrame, *, start: date, end: date) -> DataFrame:
    """The team breakdown of a period, the period repeated on each row."""
    return by_team(in_period(cost_events, start=start, end=end)).withColumn(
        "period", F.struct(F.lit(start).alias("from"), F.lit(end).alias("to"))
    )


def burn_rate(cost_events: DataFrame, *, as_of: date, monthly_budget_usd: float | None = None) -> DataFrame:
    """Spend of the month up to ``as_of`` per org, and where it leads.

    Projection: spend to date / days elapsed x days in the month. ``days_remaining`` is the rest
    of the month. The budget stays NULL when none is set.
    """
    elapsed, length = as_of.day, F.dayofmonth(F.last_day(F.lit(as_of)))
    spend = in_period(cost_events, start=as_of.replace(day=1), end=as_of).groupBy("org").agg(
        F.sum("cost_usd").cast("double").alias("spend_to_date_usd")
    )
    return spend.select(
        "org", "spend_to_date_usd",
        (F.col("spend_to_date_usd") / F.lit(elapsed)).alias("daily_spend_usd"),
        F.lit(monthly_budget_usd).cast("double").alias("monthly_budget_usd"),
        (length - F.lit(elapsed)).cast("bigint").alias("days_remaining"),
        (F.col("spend_to_date_usd") / F.lit(elapsed) * length).alias("projected_monthly_usd"),
    )


def daily_spend(cost_events: DataFrame, key: str) -> DataFrame:
    return cost_events.groupBy(key, F.to_date("ts").alias("day")).agg(F.sum("cost_usd").alias("spend"))


def month_to_date(daily: DataFrame, key: str) -> DataFrame:
    """Running spend within the month; the window sees at most 31 pre-aggregated rows."""
    month = Window.partitionBy(key, F.trunc("day", "month")).orderBy("day")
    return daily.withColumn("month_to_date", F.sum("spend").over(month.rowsBetween(Window.unboundedPreceding, 0)))


def burn_rate_daily(cost_events: DataFrame) -> DataFrame:
    return month_to_date(daily_spend(cost_events, "team"), "team").select(
        "team", "day", F.col("spend").cast("double").alias("spend_usd"),
        F.col("month_to_date").cast("double").alias("month_to_date_usd"),
    )


def top_consumers(cost_events: DataFrame, *, type: str | None = None, k: int = 10) -> DataFrame:
    """Highest cost drivers over all four kinds from one scan.

    Events are first combined per (team, model, skill, project); only those groups are repeated
    per kind. With ``type`` given the other kinds are never built.
    """
    kinds = (type,) if type else CONSUMER_TYPES
    groups = cost_events.groupBy(*kinds).agg(F.sum("cost_usd").alias("cost"), F.count("*").alias("n"))
    pairs = F.array(*[F.struct(F.lit(t).alias("type"), F.col(t).alias("name")) for t in kinds])
    totals = (
        groups.select("cost", "n", F.inline(pairs)).groupBy("type", "name")
        .agg(F.sum("cost").cast("double").alias("total_cost_usd"), F.sum("n").alias("event_count"))
    )
    return top_k(totals, k, F.desc("total_cost_usd"), F.asc("type"), F.asc("name"))


def budget_alert(cost_events: DataFrame, *, monthly_budget_usd: float, thresholds=(0.8, 1.0)) -> DataFrame:
    """The day on which the running monthly spend of an org first reaches each share of the budget."""
    daily = month_to_date(daily_spend(cost_events, "org"), "org")
    marks = F.array(*[F.lit(t) for t in thresholds])
    limit = F.col("threshold") * F.lit(monthly_budget_usd)
    running, before = F.col("month_to_date").cast("double"), (F.col("month_to_date") - F.col("spend")).cast("double")
    return (
        daily.withColumn("threshold", F.explode(marks))
        .where((before < limit) & (running >= limit))
        .select("org", F.trunc("day", "month").alias("month"), "threshold", "day", running.alias("month_to_date_usd"))
    )
