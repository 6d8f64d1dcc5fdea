"""Project registry, server catalog, roles and webhook routing as joins and group-wise rules."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import first, latest
from ..functions.skew import PAIRS_A_TASK, pair_join, skew_join
from ..vocab import ADMIN_ROLE, SLUG_PATTERN


def slug_problem(slug: Column) -> Column:
    """NULL for a good slug, else why it is refused."""
    return F.when(F.coalesce(slug, F.lit("")) == "", "missing_slug").when(~slug.rlike(SLUG_PATTERN), "invalid_slug")


def slug_validate(requests: DataFrame) -> DataFrame:
    return requests.withColumn("reason", slug_problem(F.col("slug")))


def project_register(requests: DataFrame) -> DataFrame:
    """Labels each valid request: the first of an (org, slug) creates, later ones find it.

    The first request per key comes from a combining aggregate and is joined back, so a slug that
    is posted very often is never gathered in one task.
    """
    valid = requests.where(slug_problem(F.col("slug")).isNull())
    winners = valid.groupBy("org", "slug").agg(F.min(F.struct("ts", "id")).alias("winner"), F.count("*").alias("n"))
    status = F.when((F.col("winner.ts") == F.col("ts")) & (F.col("winner.id") == F.col("id")), "created").otherwise("existing")
    joined = skew_join(valid, winners.drop("n"), ["org", "slug"], sizes=winners.select("org", "slug", "n"))
    return joined.withColumn("status", status).withColumn("registered_at", F.col("winner.ts")).drop("winner")


def registered_projects(requests: DataFrame) -> DataFrame:
    return first(requests.where(slug_problem(F.col("slug")).isNull()), ["org", "slug"], "ts", "id")


def projects_list(projects: DataFrame, *, org: str, page: int = 1, page_size: int = 10) -> DataFrame:
    own = projects.where(F.col("org") == org)
    return own.orderBy("slug").offset((page - 1) * page_size).limit(page_size)


def projects_total(projects: DataFrame, *, org: str) -> DataFrame:
    return projects.where(F.col("org") == org).agg(F.count("*").alias("total"))


def project_detail(projects: DataFrame, slug: str) -> DataFrame:
    """An empty result means not found."""
    return projects.where(F.col("slug") == slug)


def project_status(signals: DataFrame, kinds: list[str]) -> DataFrame:
    """Latest value of each signal kind per project, one column per kind."""
    order = F.struct("ts", "id")
    latest_of = [
        F.max_by(F.when(F.col("signal") == kind, F.col("value")), F.when(F.col("signal") == kind, order)).alias(kind)
        for kind in kinds
    ]
    return signals.groupBy("project").agg(*latest_of)


def catalog_register(requests: DataFrame, open_entries: DataFrame) -> DataFrame:
    """Security-audit gate for registrations.

    Only passed audits go through; the first that does opens the change request of a server,
    unless one is already open, and later ones update it. Pending ones wait, failed ones are
    refused.
    """
    passed = requests.where(F.col("security_audit_status") == "passed")
    openers = passed.groupBy("server_name").agg(F.min(F.struct("ts", "id")).alias("opener"))
    known = open_entries.select("server_name").distinct().withColumn("open", F.lit(True))
    is_opener = (F.col("opener.ts") == F.col("ts")) & (F.col("opener.id") == F.col("id")) & F.col("open").isNull()
    audit = F.col("security_audit_status")
    servers = openers.join(known, "server_name", "full")
    labelled = skew_join(requests, servers, ["server_name"], "left")
    return labelled.withColumn(
        "status",
        F.when(audit == "passed", F.when(is_opener, "pr_opened").otherwise("pr_updated"))
        .when(audit == "pending", "deferred").otherwise("rejected"),
    ).withColumn(
        "reason", F.when(audit == "pending", "security_audit_pending").when(audit == "failed", "security_audit_failed")
    ).drop("opener", "open")


def catalog_upsert(requests: DataFrame) -> DataFrame:
    """Latest metadata per server."""
    return latest(requests, ["server_name"], "ts", "id")


def catalog_list(catalog: DataFrame, *, security_audit_status: str | None = None) -> DataFrame:
    if security_audit_status:
        catalog = catalog.where(F.col("security_audit_status") == security_audit_status)
    return catalog


def catalog_stale_audit(catalog: DataFrame, *, today: datetime, days: int) -> DataFrame:
    """Servers whose last audit is more than ``days`` days back, or that never had one."""
    age = F.datediff(F.lit(today.date()), F.col("audited_at"))
    return catalog.where(F.col("audited_at").isNull() | (age > days)).withColumn("days_since_audit", age.cast("bigint"))


def active(grants: DataFrame) -> DataFrame:
    return grants.where(F.col("revoked_at").isNull())


def admins(grants: DataFrame) -> DataFrame:
    return active(grants).where(F.col("role") == ADMIN_ROLE).select("user_id").distinct()


def catalog_update_check(requests: DataFrame, catalog: DataFrame, grants: DataFrame) -> DataFrame:
    """An update needs the administrator role or membership of the owning team."""
    admin = admins(grants).withColumn("is_admin", F.lit(True))
    owner = catalog.select("server_name", "owner_team")
    joined = skew_join(skew_join(requests, owner, ["server_name"], "left"), admin, ["user_id"], "left")
    decision = (
        F.when(F.col("owner_team").isNull(), "not_found")
        .when(F.col("is_admin") | (F.col("team") == F.col("owner_team")), "allowed").otherwise("denied")
    )
    return joined.withColumn("decision", decision).drop("is_admin")


def rbac_roles(grants: DataFrame, user_id: int | None = None) -> DataFrame:
    """Distinct active roles, one row each."""
    if user_id is not None:
        grants = grants.where(F.col("user_id") == user_id)
    return active(grants).select("user_id", "role").distinct()


def rbac_grant(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Decides each grant request: only administrators grant, and a role already held changes nothing.

    Inside one batch the first request for a (user, role) counts as the grant.
    """
    held = active(grants).select("user_id", "role").distinct().withColumn("held", F.lit(True))
    admin = admins(grants).select(F.col("user_id").alias("granted_by"), F.lit(True).alias("by_admin"))
    checked = skew_join(requests, admin, ["granted_by"], "left")
    firsts = checked.where(F.col("by_admin")).groupBy("user_id", "role").agg(F.min(F.struct("ts", "id")).alias("_first"))
    known = held.join(firsts, ["user_id", "role"], "full")
    decided = skew_join(checked, known, ["user_id", "role"], "left")
    is_first = (F.col("_first.ts") == F.col("ts")) & (F.col("_first.id") == F.col("id"))
    decision = (
        F.when(F.col("by_admin").isNull(), "forbidden")
        .when(F.col("held"), "unchanged").when(is_first, "granted").otherwise("unchanged")
    )
    return decided.withColumn("decision", decision).drop("held", "by_admin", "_first")


def rbac_revoke(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Outcome of each revocation; an unknown grant id is reported, not dropped."""
    known = grants.select(F.col("id").alias("grant_id"), "user_id", "role", "revoked_at")
    found = F.col("user_id").isNotNull()
    return requests.join(known, "grant_id", "left").select(
        "grant_id", "user_id", "role",
        F.when(found, F.coalesce("revoked_at", "ts")).alias("revoked_at"),
        F.when(found, "revoked").otherwise("not_found").alias("outcome"),
    )


def rbac_enforce(requests: DataFrame, grants: DataFrame, role_scopes: DataFrame) -> DataFrame:
    """Allowed when any active role of the user carries the required scope."""
    scopes = (
        active(grants).join(role_scopes, "role").select("user_id", F.col("scope").alias("required_scope")).distinct()
        .withColumn("_ok", F.lit(True))
    )
    decided = skew_join(requests, scopes, ["user_id", "required_scope"], "left")
    return decided.withColumn("decision", F.when(F.col("_ok"), "allowed").otherwise("denied")).drop("_ok")


def webhook_route(events: DataFrame, subscriptions: DataFrame, *, a_task: int = PAIRS_A_TASK) -> DataFrame:
    """One delivery per event and active subscription of its org that lists its type.

    Orgs and types are few, and each pair's deliveries are its events times its subscriptions. They are counted first, so that the
    events of a pair go to as many tasks as its deliveries ask for.
    """
    wanted = subscriptions.where(F.col("active")).select(
        F.col("id").alias("subscription_id"), "org", "target_url", F.explode(F.array_distinct("events")).alias("event_type")
    )
    return pair_join(events, wanted, ["org", "event_type"], a_task)
