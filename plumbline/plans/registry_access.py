"""Registry, catalog and access queries; rows come from customers, suppliers, orders and events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import registry_access as op
from ..sources.bindings import bind_events, table
from .registry import query

TODAY = datetime(1998, 8, 1)

# Each binding is one SQL projection read by both engines.
PROJECTS = """
  CAST(o_orderkey AS BIGINT) AS id,
  CASE WHEN o_custkey % 50 = 0 THEN 'My Project!!' WHEN o_custkey % 50 = 1 THEN NULL
       ELSE concat('proj-', o_custkey) END AS slug,
  concat('org-', o_custkey % 3) AS org, o_orderpriority AS starter, o_orderdate AS ts"""
GRANTS = """
  concat('grant-', c_custkey) AS id, c_custkey AS user_id,
  CASE c_custkey % 4 WHEN 0 THEN 'viewer' WHEN 1 THEN 'contributor' WHEN 2 THEN 'platform-admin' ELSE 'finops' END AS role,
  CASE WHEN c_custkey % 10 = 0 THEN DATE '1998-01-01' END AS revoked_on"""
GRANT_REQUESTS = """
  o_orderkey AS id, o_custkey AS granted_by, (o_custkey * 7) % 997 AS user_id,
  CASE o_orderkey % 2 WHEN 0 THEN 'viewer' ELSE 'contributor' END AS role, o_orderdate AS ts"""
REVOCATIONS = """
  concat('grant-', o_custkey * 2) AS grant_id, max(o_orderdate) AS ts"""
ACCESS = """
  o_orderkey AS id, o_custkey AS user_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'projects:write' WHEN 1 THEN 'finops:read' ELSE 'rbac:admin' END AS required_scope"""
SERVERS = """
  s_suppkey AS id, concat('srv-', s_suppkey % 60) AS server_name,
  CASE s_suppkey % 7 % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'pending' ELSE 'failed' END AS security_audit_status,
  concat('team-', s_nationkey) AS owner_team, concat('1.', s_suppkey) AS version, s_suppkey AS ts"""
UPDATES = """
  o_orderkey AS id, o_custkey AS user_id, concat('srv-', o_orderkey % 70) AS server_name,
  concat('team-', o_custkey % 25) AS team"""
SIGNALS = """
  concat(l_orderkey, '-', l_linenumber) AS id, concat('proj-', l_suppkey) AS project,
  CASE l_linenumber % 2 WHEN 0 THEN 'quality' ELSE 'build' END AS signal,
  concat(l_returnflag, l_linestatus) AS value, l_shipdate AS ts"""
SUBSCRIPTION_ROWS = """
  s_suppkey AS id, concat('org-', s_suppkey % 5) AS org, concat('https://hook/', s_suppkey) AS target_url,
  s_suppkey % 4 <> 0 AS active, s_suppkey % 3 AS kind"""

# Scopes each role gives.
ROLE_SCOPES = {
    "viewer": ("projects:read",),
    "contributor": ("projects:read", "projects:write"),
    "finops": ("projects:read", "finops:read"),
    "platform-admin": ("projects:read", "projects:write", "finops:read", "rbac:admin"),
}


def _rows(df, projection):
    return df.selectExpr(*_split(projection))


def _split(projection):
    """Top-level commas of a projection text."""
    parts, depth, current = [], 0, ""
    for ch in projection:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += ch
    return [p.strip() for p in [*parts, current]]


def _projects(spark, folder):
    return _rows(table(spark, folder, "orders"), PROJECTS)


def _grants(spark, folder):
    grants = _rows(table(spark, folder, "customer"), GRANTS)
    return grants.withColumn("revoked_at", F.col("revoked_on").cast("timestamp_ntz")).drop("revoked_on")


def _servers(spark, folder):
    return _rows(table(spark, folder, "supplier"), SERVERS)


P = f"WITH p AS (SELECT {PROJECTS} FROM orders), "
P += """good AS (SELECT * FROM p WHERE slug IS NOT NULL AND regexp_full_match(slug, '[a-z0-9]+(-[a-z0-9]+)*')),
reg AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY org, slug ORDER BY ts, id) = 1) """


@query("slug_validate", P + """
SELECT id, slug, CASE WHEN coalesce(slug, '') = '' THEN 'missing_slug'
                      WHEN NOT regexp_full_match(slug, '[a-z0-9]+(-[a-z0-9]+)*') THEN 'invalid_slug' END AS reason FROM p""")
def slug_validate(spark, folder):
    return op.slug_validate(_projects(spark, folder)).select("id", "slug", "reason")


@query("project_register", P + """
SELECT id, org, slug, CASE WHEN row_number() OVER w = 1 THEN 'created' ELSE 'existing' END AS status,
       first_value(ts) OVER w AS registered_at
FROM good WINDOW w AS (PARTITION BY org, slug ORDER BY ts, id)""")
def project_register(spark, folder):
    return op.project_register(_projects(spark, folder)).select("id", "org", "slug", "status", "registered_at")


@query("projects_list", P + """
SELECT org, slug, starter, (SELECT count(*) FROM reg WHERE org = 'org-1') AS total
FROM reg WHERE org = 'org-1' ORDER BY slug LIMIT 10 OFFSET 10""")
def projects_list(spark, folder):
    projects = op.registered_projects(_projects(spark, folder))
    total = op.projects_total(projects, org="org-1").scalar()
    page = op.projects_list(projects, org="org-1", page=2, page_size=10)
    return page.select("org", "slug", "starter", total.alias("total"))


@query("project_detail", P + "SELECT org, slug, starter, ts AS registered_at FROM reg WHERE slug = 'proj-77'")
def project_detail(spark, folder):
    detail = op.project_detail(op.registered_projects(_projects(spark, folder)), "proj-77")
    return detail.select("org", "slug", "starter", F.col("ts").alias("registered_at"))


@query("project_status", f"""
WITH s AS (SELECT {SIGNALS} FROM lineitem)
SELECT project, arg_max(value, (ts, id)) FILTER (WHERE signal = 'quality') AS quality,
       arg_max(value, (ts, id)) FILTER (WHERE signal = 'build') AS build FROM s GROUP BY project""")
def project_status(spark, folder):
    return op.project_status(_rows(table(spark, folder, "lineitem"), SIGNALS), ["quality", "build"])


S = f"WITH s AS (SELECT {SERVERS} FROM supplier) "


@query("catalog_register", S + """
, op AS (SELECT DISTINCT concat('srv-', s_suppkey % 60) AS server_name FROM supplier WHERE s_acctbal < 500)
SELECT s.id, s.server_name, security_audit_status,
       CASE security_audit_status
         WHEN 'passed' THEN CASE WHEN op.server_name IS NULL AND row_number() OVER (
                PARTITION BY s.server_name, security_audit_status ORDER BY ts, id) = 1 THEN 'pr_opened' ELSE 'pr_updated' END
         WHEN 'pending' THEN 'deferred' ELSE 'rejected' END AS status,
       CASE security_audit_status WHEN 'pending' THEN 'security_audit_pending'
                                  WHEN 'failed' THEN 'security_audit_failed' END AS reason
FROM s LEFT JOIN op ON op.server_name = s.server_name""")
def catalog_register(spark, folder):
    requests = _servers(spark, folder)
    opened = table(spark, folder, "supplier").where("s_acctbal < 500").selectExpr("concat('srv-', s_suppkey % 60) AS server_name")
    return op.catalog_register(requests, opened).select("id", "server_name", "security_audit_status", "status", "reason")


CATALOG = S + ", cat AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY server_name ORDER BY ts DESC, id DESC) = 1) "


@query("catalog_upsert", CATALOG + "SELECT server_name, owner_team, version, security_audit_status FROM cat")
def catalog_upsert(spark, folder):
    return op.catalog_upsert(_servers(spark, folder)).select("server_name", "owner_team", "version", "security_audit_status")


@query("catalog_list", CATALOG + "SELECT server_name, owner_team, version FROM cat WHERE security_audit_status = 'pending'")
def catalog_list(spark, folder):
    catalog = op.catalog_upsert(_servers(spark, folder))
    return op.catalog_list(catalog, security_audit_status="pending").select("server_name", "owner_team", "version")


@query("catalog_update_check", CATALOG + f"""
, u AS (SELECT {UPDATES} FROM orders), g AS (SELECT {GRANTS} FROM customer),
adm AS (SELECT DISTINCT user_id FROM g WHERE role = 'platform-admin' AND revoked_on IS NULL)
SELECT u.id, u.server_name, CASE WHEN cat.owner_team IS NULL THEN 'not_found'
  WHEN u.user_id IN (SELECT user_id FROM adm) OR u.team = cat.owner_team THEN 'allowed' ELSE 'denied' END AS decision
FROM u LEFT JOIN cat USING (server_name)""")
def catalog_update_check(spark, folder):
    updates = _rows(table(spark, folder, "orders"), UPDATES)
    checked = op.catalog_update_check(updates, op.catalog_upsert(_servers(spark, folder)), _grants(spark, folder))
    return checked.select("id", "server_name", "decision")


@query("catalog_stale_audit", """
WITH a AS (SELECT s_suppkey, max(l_shipdate) FILTER (WHERE l_returnflag = 'R' AND l_shipdate <= TIMESTAMP '1998-08-01') AS audited_at
           FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey)
SELECT concat('srv-', s_suppkey) AS server_name, audited_at,
       CAST(date_diff('day', CAST(audited_at AS DATE), DATE '1998-08-01') AS BIGINT) AS days_since_audit
FROM a WHERE audited_at IS NULL OR date_diff('day', CAST(audited_at AS DATE), DATE '1998-08-01') > 5""")
def catalog_stale_audit(spark, folder):
    audits = table(spark, folder, "lineitem").where(
        "l_returnflag = 'R' AND l_shipdate <= TIMESTAMP_NTZ '1998-08-01 00:00:00'"
    ).groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max("l_shipdate").alias("audited_at"))
    catalog = table(spark, folder, "supplier").select("s_suppkey").join(audits, "s_suppkey", "left").select(
        F.concat(F.lit("srv-"), F.col("s_suppkey").cast("string")).alias("server_name"), "audited_at"
    )
    return op.catalog_stale_audit(catalog, today=TODAY, days=5)


G = f"WITH g AS (SELECT *, CAST(revoked_on AS TIMESTAMP) AS revoked_at FROM (SELECT {GRANTS} FROM customer)), live AS (SELECT * FROM g WHERE revoked_at IS NULL) "


@query("rbac_roles", G + "SELECT DISTINCT user_id, role FROM live")
def rbac_roles(spark, folder):
    return op.rbac_roles(_grants(spark, folder))


@query("rbac_grant", G + f"""
, r AS (SELECT {GRANT_REQUESTS} FROM orders),
x AS (SELECT r.*, granted_by IN (SELECT user_id FROM live WHERE role = 'platform-admin') AS by_admin,
             (user_id, role) IN (SELECT (user_id, role) FROM live) AS held FROM r)
SELECT id, user_id, role, CASE WHEN NOT by_admin THEN 'forbidden' WHEN held THEN 'unchanged'
   WHEN row_number() OVER (PARTITION BY user_id, role, by_admin ORDER BY ts, id) = 1 THEN 'granted' ELSE 'unchanged' END AS decision
FROM x""")
def rbac_grant(spark, folder):
    requests = _rows(table(spark, folder, "orders"), GRANT_REQUESTS)
    return op.rbac_grant(requests, _grants(spark, folder)).select("id", "user_id", "role", "decision")


@query("rbac_revoke", G + f"""
, r AS (SELECT {REVOCATIONS} FROM orders GROUP BY o_custkey)
SELECT r.grant_id, g.user_id, g.role, CASE WHEN g.user_id IS NOT NULL THEN coalesce(g.revoked_at, r.ts) END AS revoked_at,
       CASE WHEN g.user_id IS NOT NULL THEN 'revoked' ELSE 'not_found' END AS outcome
FROM r LEFT JOIN g ON g.id = r.grant_id""")
def rbac_revoke(spark, folder):
    requests = table(spark, folder, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("ts")).select(
        F.concat(F.lit("grant-"), (F.col("o_custkey") * 2).cast("string")).alias("grant_id"), "ts"
    )
    return op.rbac_revoke(requests, _grants(spark, folder))


@query("rbac_enforce", G + f"""
, a AS (SELECT {ACCESS} FROM orders)
SELECT a.id, a.user_id, required_scope, CASE WHEN EXISTS (SELECT 1 FROM live WHERE live.user_id = a.user_id AND (
     role = 'platform-admin' OR (role = 'contributor' AND required_scope = 'projects:write')
     OR (role = 'finops' AND required_scope = 'finops:read'))) THEN 'allowed' ELSE 'denied' END AS decision
FROM a""")
def rbac_enforce(spark, folder):
    scopes = spark.createDataFrame([(r, s) for r, group in ROLE_SCOPES.items() for s in group], "role string, scope string")
    requests = _rows(table(spark, folder, "orders"), ACCESS)
    return op.rbac_enforce(requests, _grants(spark, folder), scopes).select("id", "user_id", "required_scope", "decision")


@query("webhook_route", f"""
WITH sub AS (SELECT {SUBSCRIPTION_ROWS} FROM supplier ),
e AS (SELECT event_id, 'org-' || (user_id % 5) AS org,
             CASE event_type WHEN 'signup' THEN 'project.generated' WHEN 'error' THEN 'ci.run' END AS event_type
      FROM events WHERE event_type IN ('signup', 'error'))
SELECT event_id, e.org, e.event_type, sub.id AS subscription_id
FROM e JOIN sub ON sub.org = e.org AND active
 AND ((kind = 0 AND e.event_type = 'project.generated') OR (kind = 1 AND e.event_type = 'ci.run') OR kind = 2)""")
def webhook_route(spark, folder):
    """Deliveries grow with events times the subscriptions of one org, which is the feature itself."""
    kinds = F.when(F.col("kind") == 0, F.array(F.lit("project.generated"))).when(
        F.col("kind") == 1, F.array(F.lit("ci.run"))
    ).otherwise(F.array(F.lit("project.generated"), F.lit("ci.run")))
    subs = _rows(table(spark, folder, "supplier"), SUBSCRIPTION_ROWS).withColumn("events", kinds)
    events = bind_events(table(spark, folder, "events")).select(
        F.col("id").cast("bigint").alias("event_id"),
        F.concat(F.lit("org-"), (F.substring("github_username", 2, 20).cast("bigint") % 5).cast("string")).alias("org"),
        "event_type",
    )
    return op.webhook_route(events, subs).select("event_id", "org", "event_type", "subscription_id")
