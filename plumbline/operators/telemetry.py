"""Event telemetry: filtered listings, counts, CI results, top lists, costs and the daily rollup.

Every operator reads events in one pass and aggregates with map-side combine. The caller gives
all instants; nothing here looks at the clock.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.payload import money, unknown_if_blank, with_payload
from ..functions.ranking import top_k, top_k_per_group
from ..vocab import EVENT_TYPES, SUMMARY_COUNTERS

PAGE_LIMIT_MAX = 1000
TOP_LIST = 10


def page_bounds(limit: int = 100, offset: int = 0) -> tuple[int, int]:
    if not 1 <= limit <= PAGE_LIMIT_MAX:
        raise ValueError(f"limit must be between 1 and {PAGE_LIMIT_MAX}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    return limit, offset


def default_window(now: datetime, start: datetime | None = None, end: datetime | None = None):
    """Missing bounds become the 30 days up to ``now``."""
    return start or now - timedelta(days=30), end or now


def whole_days(first: str, last: str) -> tuple[datetime, datetime]:
    """Day-level bounds, to the last full second of the last day."""
    return datetime.fromisoformat(f"{first}T00:00:00"), datetime.fromisoformat(f"{last}T23:59:59")


def events_filter(
    events: DataFrame,
    *,
    event_type: str | None = None,
    project_slug: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Equality and inclusive range filters; an empty argument does not filter.

    Bounds are literals, so they reach the scan as pushed filters; on a table partitioned by
    ``event_date`` they also leave out whole days.
    """
    by_day = "event_date" in events.columns
    if event_type:
        events = events.where(F.col("event_type") == event_type)
    if project_slug:
        events = events.where(F.col("project_slug") == project_slug)
    if start:
        events = events.where(F.col("event_ts") >= _instant(start))
        if by_day:
            events = events.where(F.col("event_date") >= F.lit(start.date()))
    if end:
        events = events.where(F.col("event_ts") <= _instant(end))
        if by_day:
            events = events.where(F.col("event_date") <= F.lit(end.date()))
    return events


def _instant(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def events_projection(events: DataFrame) -> DataFrame:
    return events.select(
        "id", "event_type", "project_slug", "github_username", "schema_version",
        "received_at", "event_ts", "payload",
    )


def events_total(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("total"))


def events_page(events: DataFrame, *, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first, ``id`` breaks ties."""
    limit, offset = page_bounds(limit, offset)
    ordered = events_projection(events).orderBy(F.desc("event_ts"), F.asc("id"))
    return ordered.offset(offset).limit(limit)


def type_counts(events: DataFrame) -> DataFrame:
    """One row per known type in one pass, zero where a type does not occur."""
    counts = events.agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in EVENT_TYPES])
    pairs = F.array(*[
        F.struct(F.lit(t).alias("event_type"), F.col(f"`{t}`").alias("event_count")) for t in EVENT_TYPES
    ])
    return counts.select(F.inline(pairs))


def _passed() -> Column:
    return F.coalesce(F.col("p.tests_passed") == "true", F.lit(False))


def ci_stats(events: DataFrame) -> DataFrame:
    """Everything that did not explicitly pass counts as failed."""
    runs = with_payload(events.where(F.col("event_type") == "ci.run"))
    return runs.agg(F.count("*").alias("total"), F.count_if(_passed()).alias("passed")).select(
        "total", "passed", (F.col("total") - F.col("passed")).alias("failed")
    )


def ci_pass_rate(stats: DataFrame) -> DataFrame:
    """Whole percent, once rounded half to even and once half up; NULL without runs."""
    percent = F.try_divide(F.lit(100) * F.col("passed"), F.col("total"))
    return stats.select(
        "total", "passed", "failed",
        F.bround(percent).cast("bigint").alias("rate_half_even"),
        F.floor(percent + F.lit(0.5)).cast("bigint").alias("rate_half_up"),
    )


def _skill_calls(events: DataFrame) -> DataFrame:
    return with_payload(events.where(F.col("event_type") == "skill.invoked"))


def _cost() -> Column:
    return F.coalesce(F.sum(money(F.col("p.estimated_cost_usd"))), F.lit(0)).alias("cost")


def top_skills(events: DataFrame, *, k: int = TOP_LIST) -> DataFrame:
    counts = _skill_calls(events).groupBy(F.col("p.skill_name").alias("key")).agg(F.count("*").alias("calls"))
    best = top_k(counts, k, F.desc("calls"), F.asc_nulls_first("key"))
    return best.select(unknown_if_blank(F.col("key")).alias("skill_name"), "calls")


def top_models(events: DataFrame, *, k: int = TOP_LIST) -> DataFrame:
    """Ranked by number of calls, not by cost."""
    groups = _skill_calls(events).groupBy(F.col("p.model").alias("key")).agg(F.count("*").alias("calls"), _cost())
    best = top_k(groups, k, F.desc("calls"), F.asc_nulls_first("key"))
    return best.select(
        unknown_if_blank(F.col("key")).alias("model"), "calls", F.col("cost").cast("double").alias("total_cost_usd")
    )


def total_cost(events: DataFrame, *, k: int = TOP_LIST) -> DataFrame:
    """Cost of the ``k`` most called models, and next to it the cost of all of them; one scan."""
    groups = _skill_calls(events).groupBy(F.col("p.model").alias("key")).agg(F.count("*").alias("calls"), _cost())
    both = groups.groupingSets([[F.col("key")], []], F.col("key")).agg(
        F.grouping("key").alias("every"), F.sum("calls").alias("calls"), F.sum("cost").alias("cost"))
    ranked = top_k_per_group(both, ["every"], k, F.desc("calls"), F.asc_nulls_first("key"))
    of = lambda every: F.coalesce(F.sum(F.when(F.col("every") == every, F.col("cost"))), F.lit(0)).cast("double")
    return ranked.agg(of(0).alias("total_cost_usd"), of(1).alias("total_cost_all_usd"))


def _facets(events: DataFrame) -> DataFrame:
    """Counts by type, by skill and by model from one scan, through grouping sets.

    Events are combined per (type, skill, model) first, so only those groups are tripled.
    """
    skill_only = F.col("event_type") == "skill.invoked"
    typed = with_payload(events.where(F.col("event_type").isin(*EVENT_TYPES))).select(
        "event_type",
        F.when(skill_only, F.col("p.skill_name")).alias("skill"),
        F.when(skill_only, F.col("p.model")).alias("model"),
        F.when(skill_only, money(F.col("p.estimated_cost_usd"))).alias("cost"),
        F.when(F.col("event_type") == "ci.run", _passed()).alias("passed"),
    )
    groups = typed.groupBy("event_type", "skill", "model").agg(
        F.count("*").alias("n"), F.count_if("passed").alias("n_passed"), F.sum("cost").alias("cost"))
    sets = [[F.col("event_type")], [F.col("event_type"), F.col("skill")], [F.col("event_type"), F.col("model")]]
    facets = groups.groupingSets(sets, F.col("event_type"), F.col("skill"), F.col("model")).agg(
        F.grouping("skill").alias("no_skill"),
        F.grouping("model").alias("no_model"),
        F.sum("n").alias("n"),
        F.sum("n_passed").alias("n_passed"),
        F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"),
    )
    kind = (
        F.when((F.col("no_skill") == 1) & (F.col("no_model") == 1), "type")
        .when(F.col("no_skill") == 0, "skill")
        .otherwise("model")
    )
    facets = facets.select("event_type", "n", "n_passed", "cost", kind.alias("kind"),
                           F.coalesce(F.col("skill"), F.col("model")).alias("key"))
    return facets.where((F.col("kind") == "type") | (F.col("event_type") == "skill.invoked"))


def summary(
    events: DataFrame,
    *,
    start: datetime,
    end: datetime,
    project_slug: str | None = None,
    k: int = TOP_LIST,
) -> DataFrame:
    """The whole report as one nested row: counters, CI result, top lists, cost of the listed models and of all.

    One scan; the shuffles move grouped counts only, and only the ``k`` best rows of each list reach the
    final aggregate, so the collected arrays stay bounded.
    """
    facets = _facets(events_filter(events, project_slug=project_slug, start=start, end=end))
    # The type facet has at most one row per known type, so k never cuts it.
    keep = max(k, len(EVENT_TYPES))
    ranked = top_k_per_group(facets, ["kind"], keep, F.desc("n"), F.asc_nulls_first("key"))
    ranked = ranked.where((F.col("kind") == "type") | (F.col("rank") <= k))

    def count_of(event_type: str, column: str = "n") -> Column:
        hit = (F.col("kind") == "type") & (F.col("event_type") == event_type)
        return F.coalesce(F.sum(F.when(hit, F.col(column))), F.lit(0)).cast("bigint")

    def top(kind: str, *fields: Column) -> Column:
        hit = F.when(F.col("kind") == kind, F.struct("rank", *fields))
        return F.transform(F.array_sort(F.collect_list(hit)), lambda s: s.dropFields("rank"))

    name = unknown_if_blank(F.col("key"))
    calls = F.col("n").alias("count")
    skills = (F.col("kind") == "type") & (F.col("event_type") == "skill.invoked")
    every_cost = F.coalesce(F.sum(F.when(skills, F.col("cost"))), F.lit(0))
    listed_cost = F.coalesce(F.sum(F.when(F.col("kind") == "model", F.col("cost"))), F.lit(0))
    row = ranked.agg(
        *[count_of(t).alias(c) for t, c in SUMMARY_COUNTERS.items()],
        count_of("ci.run").alias("ci_total"),
        count_of("ci.run", "n_passed").alias("ci_passed"),
        top("skill", name.alias("skill_name"), calls).alias("top_skills"),
        top("model", name.alias("model"), calls, F.col("cost").cast("double").alias("total_cost_usd")).alias("top_models"),
        listed_cost.cast("double").alias("total_cost_usd"),
        every_cost.cast("double").alias("total_cost_all_usd"),
    )
    ci = F.struct(
        F.col("ci_total").alias("total"),
        F.col("ci_passed").alias("passed"),
        (F.col("ci_total") - F.col("ci_passed")).alias("failed"),
    )
    return row.select(
        "projects_generated", "skills_invoked", ci.alias("ci_runs"), "tools_executed",
        "knowledge_created", "knowledge_used", "top_skills", "top_models", "total_cost_usd", "total_cost_all_usd",
    )


def summary_top_skills(report: DataFrame, *, k: int = 5) -> DataFrame:
    """The part of the skill list a short display shows."""
    return report.select(F.inline(F.slice("top_skills", 1, k)))


def summary_flatten(report: DataFrame) -> DataFrame:
    """(metric, value) rows; nested keys joined with a dot, lists left out."""
    pairs = []
    for field in report.schema.fields:
        if isinstance(field.dataType, T.StructType):
            pairs += [(f"{field.name}.{sub.name}", F.col(f"{field.name}.{sub.name}")) for sub in field.dataType.fields]
        elif not isinstance(field.dataType, T.ArrayType):
            pairs.append((field.name, F.col(field.name)))
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("string").alias("value")) for m, v in pairs])
    return report.select(F.inline(rows))


def daily_rollup(events: DataFrame) -> DataFrame:
    """Count and cost by project, type and day; cost is NULL for types that carry none."""
    paid = F.when(F.col("event_type") == "skill.invoked", money(F.col("p.estimated_cost_usd")))
    return (
        with_payload(events)
        .groupBy("project_slug", "event_type", F.to_date("event_ts").alias("day"))
        .agg(F.count("*").alias("event_count"), F.sum(paid).alias("daily_cost_usd"))
    )


def counts_from_rollup(rollup: DataFrame, *, first: date, last: date, project_slug: str | None = None) -> DataFrame:
    """Count and cost per known type over whole days, from the rollup instead of the events."""
    days = rollup.where(F.col("day").between(F.lit(first), F.lit(last)))
    if project_slug:
        days = days.where(F.col("project_slug") == project_slug)
    of = lambda column, t: F.coalesce(F.sum(F.when(F.col("event_type") == t, F.col(column))), F.lit(0))
    row = days.agg(*[of("event_count", t).alias(f"{t}#n") for t in EVENT_TYPES],
                   *[of("daily_cost_usd", t).alias(f"{t}#c") for t in EVENT_TYPES])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("event_type"), F.col(f"`{t}#n`").alias("event_count"), F.col(f"`{t}#c`").cast("double").alias("cost_usd"))
        for t in EVENT_TYPES])))


def rollup_unique_check(rollup: DataFrame) -> DataFrame:
    """Keys that occur twice; an empty result is the expected one."""
    key = ["project_slug", "event_type", "day"]
    return rollup.groupBy(*key).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def cost_by_groups(events: DataFrame, *, by: tuple[str, ...] = ("model", "skill", "project")) -> DataFrame:
    """Calls and cost of skill invocations per model, skill or project, as (grouping, name, calls, total_cost_usd).

    One scan: events are combined per (model, skill, project) first, and only those groups are repeated for each grouping.
    """
    keys = {"model": F.col("p.model"), "skill": F.col("p.skill_name"), "project": F.col("project_slug")}
    groups = _skill_calls(events).groupBy(*[keys[b].alias(b) for b in by]).agg(F.count("*").alias("calls"), _cost())
    each = groups.groupingSets([[F.col(b)] for b in by], *[F.col(b) for b in by]).agg(
        *[F.grouping(b).alias(f"no_{b}") for b in by], F.sum("calls").alias("calls"), F.sum("cost").alias("cost"))
    of = lambda value: F.coalesce(*[F.when(F.col(f"no_{b}") == 0, value(b)) for b in by])
    return each.select(of(F.lit).alias("grouping"), unknown_if_blank(of(F.col)).alias("name"), "calls", F.col("cost").cast("double").alias("total_cost_usd"))


def cost_by_group(events: DataFrame, *, by: str) -> DataFrame:
    """:func:`cost_by_groups` for one grouping."""
    return cost_by_groups(events, by=(by,))


def estimate_cost(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds ``estimated_cost_usd`` from token counts; NULL for a model without a rate.

    A rate card has one row per model offered and is broadcast by Spark only while it is small.
    """
    price = (
        F.col("input_tokens") * F.col("input_usd_per_m") + F.col("output_tokens") * F.col("output_usd_per_m")
    ) / F.lit(1_000_000)
    joined = usage.join(rates.select("model", "input_usd_per_m", "output_usd_per_m"), "model", "left")
    return joined.withColumn("estimated_cost_usd", F.round(price, 8)).drop("input_usd_per_m", "output_usd_per_m")


def make_event(rows: DataFrame, event_type: str, payload: list[str]) -> DataFrame:
    """Wraps typed payload columns into the wire envelope."""
    return rows.select(
        F.lit(event_type).alias("event_type"), "project_slug", "github_username", "timestamp",
        F.lit("1.0").alias("schema_version"), F.to_json(F.struct(*payload)).alias("payload"),
    )
