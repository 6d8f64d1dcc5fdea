from datetime import date, datetime

import pytest

from plumbline.operators import finops, policy, registry_access as op
from plumbline.operators import observability as obs

T1, T2, T3 = (datetime(2024, 1, d) for d in (1, 2, 3))


def test_slugs(spark):
    df = spark.createDataFrame([("my-api",), ("My Project!!",), ("",), (None,), ("a--b",), ("-a",), ("a1",)], "slug string")
    assert [r["reason"] for r in op.slug_validate(df).collect()] == [None, "invalid_slug", "missing_slug", "missing_slug", "invalid_slug", "invalid_slug", None]


def test_register_is_idempotent_per_org(spark, rows):
    df = spark.createDataFrame([(1, "a", "x", T2), (2, "a", "x", T1), (3, "b", "x", T3), (4, "a", "X!", T1)], "id int, org string, slug string, ts timestamp_ntz")
    assert rows(op.project_register(df).select("id", "status", "registered_at")) == [(1, "existing", T1), (2, "created", T1), (3, "created", T3)]


def test_pages_and_total(spark, rows):
    df = spark.createDataFrame([(f"p{i:02d}", "o") for i in range(25)] + [("other", "z")], "slug string, org string")
    assert op.projects_list(df, org="o", page=1, page_size=10).count() == 10 and op.projects_list(df, org="o", page=3, page_size=10).count() == 5
    assert rows(op.projects_total(df, org="o")) == [(25,)] and op.project_detail(df, "missing").count() == 0


def test_catalog_gate(spark, rows):
    df = spark.createDataFrame([(1, "s", "passed", T1), (2, "s", "passed", T2), (3, "t", "pending", T1), (4, "u", "failed", T1), (5, "v", "passed", T1)],
                               "id int, server_name string, security_audit_status string, ts timestamp_ntz")
    opened = spark.createDataFrame([("v",)], "server_name string")
    assert rows(op.catalog_register(df, opened).select("id", "status", "reason")) == [
        (1, "pr_opened", None), (2, "pr_updated", None), (3, "deferred", "security_audit_pending"),
        (4, "rejected", "security_audit_failed"), (5, "pr_updated", None)]


@pytest.fixture(scope="module")
def grants(spark):
    return spark.createDataFrame([("g1", 1, "platform-admin", None), ("g2", 2, "contributor", None), ("g3", 3, "platform-admin", T1), ("g4", 4, "viewer", None)],
                                 "id string, user_id int, role string, revoked_at timestamp_ntz")


def test_grants(spark, rows, grants):
    df = spark.createDataFrame([(1, 1, 9, "viewer", T1), (2, 1, 9, "viewer", T2), (3, 2, 9, "admin", T1), (4, 3, 9, "admin", T1), (5, 1, 4, "viewer", T1)],
                               "id int, granted_by int, user_id int, role string, ts timestamp_ntz")
    assert rows(op.rbac_grant(df, grants).select("id", "decision")) == [(1, "granted"), (2, "unchanged"), (3, "forbidden"), (4, "forbidden"), (5, "unchanged")]
    assert rows(op.rbac_roles(grants, 3)) == []


def test_revocations(spark, rows, grants):
    df = spark.createDataFrame([("g2", T2), ("g3", T2), ("nope", T2)], "grant_id string, ts timestamp_ntz")
    assert rows(op.rbac_revoke(df, grants).select("grant_id", "revoked_at", "outcome")) == [("g2", T2, "revoked"), ("g3", T1, "revoked"), ("nope", None, "not_found")]


def test_scopes(spark, rows, grants):
    scopes = spark.createDataFrame([("contributor", "projects:write"), ("platform-admin", "finops:read")], "role string, scope string")
    df = spark.createDataFrame([(1, 2, "projects:write"), (2, 2, "finops:read"), (3, 3, "finops:read"), (4, 1, "finops:read")], "id int, user_id int, required_scope string")
    assert rows(op.rbac_enforce(df, grants, scopes).select("id", "decision")) == [(1, "allowed"), (2, "denied"), (3, "denied"), (4, "allowed")]


def test_catalog_update(spark, rows, grants):
    catalog = spark.createDataFrame([("s", "team-a")], "server_name string, owner_team string")
    df = spark.createDataFrame([(1, 1, "s", "x"), (2, 2, "s", "team-a"), (3, 2, "s", "x"), (4, 1, "none", "x")], "id int, user_id int, server_name string, team string")
    assert rows(op.catalog_update_check(df, catalog, grants).select("id", "decision")) == [(1, "allowed"), (2, "allowed"), (3, "denied"), (4, "not_found")]


def test_webhooks(spark, rows):
    subs = spark.createDataFrame([(1, "o", "u", ["a", "b", "a"], True), (2, "o", "u", ["a"], False), (3, "z", "u", ["a"], True)],
                                 "id int, org string, target_url string, events array<string>, active boolean")
    events = spark.createDataFrame([(1, "o", "a"), (2, "o", "c")], "event_id int, org string, event_type string")
    assert rows(op.webhook_route(events, subs).select("event_id", "subscription_id")) == [(1, 1)]


def test_deliveries_of_one_org_go_to_many_tasks(spark, rows):
    """Tasks follow the deliveries, not the few bytes of events and subscriptions, and none is lost or doubled."""
    subs = spark.range(40).selectExpr("id", "'o' AS org", "'u' AS target_url", "array('a') AS events", "true AS active")
    events = spark.range(500).selectExpr("id AS event_id", "if(id = 7, 'z', 'o') AS org", "'a' AS event_type").coalesce(1)
    got = op.webhook_route(events, subs, a_task=1000)
    assert rows(got.select("event_id", "subscription_id")) == rows(events.where("org = 'o'").crossJoin(subs).select("event_id", "id"))
    made = [len(p) for p in got.rdd.glom().collect()]
    assert len(made) >= 20 and max(made) < 6000
    assert op.webhook_route(events.where("false"), subs).count() == 0


def test_status_per_signal(spark, rows):
    df = spark.createDataFrame([(1, "p", "quality", "A", T1), (2, "p", "quality", "B", T2), (3, "p", "build", "ok", T1)],
                               "id int, project string, signal string, value string, ts timestamp_ntz")
    assert rows(op.project_status(df, ["quality", "build"])) == [("p", "B", "ok")]


@pytest.fixture(scope="module")
def costs(spark):
    data = [("o", "t1", "p", "m1", "s", datetime(2024, 2, d), c) for d, c in ((1, 10.0), (2, 30.0), (2, 45.0), (10, 20.0))] + [("o", "t2", "q", "m2", "s", datetime(2024, 3, 1), 7.0)]
    return spark.createDataFrame(data, "org string, team string, project string, model string, skill string, ts timestamp_ntz, cost double").withColumn(
        "cost_usd", op.F.col("cost").cast("decimal(18,6)"))


def test_burn_rate(costs):
    r = finops.burn_rate(costs, as_of=date(2024, 2, 10)).first()
    assert (r["daily_spend_usd"], r["monthly_budget_usd"], r["days_remaining"], r["projected_monthly_usd"]) == (10.5, None, 19, 304.5)


def test_budget_alert_days(costs, rows):
    assert rows(finops.budget_alert(costs, monthly_budget_usd=100.0).select("threshold", "day")) == [(0.8, date(2024, 2, 2)), (1.0, date(2024, 2, 10))]


def test_consumers(costs):
    top = finops.top_consumers(costs).collect()
    assert len(top) == 7 and tuple(top[0])[:2] == ("skill", "s") and top[0]["total_cost_usd"] == 112.0
    assert {r["type"] for r in finops.top_consumers(costs, type="model").collect()} == {"model"}


@pytest.mark.parametrize("command, rule", [
    ("git push origin main", "GITOPS-001"), ("git push -f origin  master", "GITOPS-001"), ("git push origin maintenance", None),
    ("git tag v1; git merge x", "GITOPS-002"), ("gh pr merge 1 --admin", "GITOPS-003"), ("GH API repos/branches/main/protection -X put", "GITOPS-004"),
    ("git tag", "GITOPS-005"), ("git mergetool", None)])
def test_command_rules(spark, command, rule):
    assert policy.policy_first_match(spark.createDataFrame([(command,)], "command string")).first()["rule"] == rule


@pytest.mark.parametrize("payload, marker, decision", [
    ('{"tool_input": {"command": "git merge x"}}', True, "WARN"), ('{"tool_input": {"command": "git merge x"}, "why": "[skip-gitops]"}', True, "BYPASS"),
    ('{"tool_input": {"command": "git merge x"}}', False, "ALLOW"), ("git merge x", True, "WARN"), ('{"other": "git merge"}', True, "ALLOW"), ("", True, "ALLOW")])
def test_command_decisions(spark, payload, marker, decision):
    df = spark.createDataFrame([(payload, marker)], "payload string, has_marker boolean")
    assert policy.policy_bypass(df).first()["decision"] == decision


@pytest.mark.parametrize("path, needed", [("src/a.py", True), ("src/a.md", False), ("docs/adr/x.py", False), ("a/tests/b.py", False), ("a.yaml", True), ("", False), (None, False), ("Makefile", False)])
def test_record_rule(spark, path, needed):
    assert spark.createDataFrame([(path,)], "path string").select(policy.needs_record(op.F.col("path"))).first()[0] is needed


def test_version_history(spark, rows):
    data = [("r", 1, T1, 'version = "1.0.0"', ""), ("r", 2, T1, 'version = "1.0.0"', ""), ("r", 3, T2, 'version = "1.0.0"', "x [skip-semver]"),
            ("r", 4, T2, "nothing", ""), ("r", 5, T3, 'version = "1.1.0"', ""), ("r", 6, T3, 'version = "1.2.0"', ""), ("q", 7, T3, 'version = "1.2.0"', "")]
    df = spark.createDataFrame(data, "repo string, id int, ts timestamp_ntz, file_text string, commit_message string")
    assert rows(policy.policy_version_bump(df).select("id", "previous_version", "outcome")) == [
        (1, None, "first"), (2, "1.0.0", "not_bumped"), (3, "1.0.0", "bypass"), (4, "1.0.0", "unreadable"), (5, None, "unreadable"), (6, "1.1.0", "bumped"), (7, None, "first")]


def test_branches(spark):
    cases = [("main", "staging", True), ("main", "feature/x", False), ("staging", "feature/x", True), ("staging", "x", False), ("dev", "x", True), ("main", "", True), ("main", None, True)]
    df = spark.createDataFrame([c[:2] for c in cases], "base_ref string, head_ref string")
    assert [r["passed"] for r in policy.policy_branch_flow(df).collect()] == [c[2] for c in cases]


def test_trace(spark, rows):
    df = spark.createDataFrame([("t", "a", None, "root", T1, 5), ("t", "b", "a", "child", T2, 3), ("u", "c", "a", "lost", T2, 1)],
                               "trace_id string, span_id string, parent_id string, name string, started_at timestamp_ntz, duration_ms bigint")
    assert rows(obs.trace_tree(df).select("span_id", "parent_name", "offset_s")) == [("a", None, None), ("b", "root", 86400), ("c", None, None)]


def test_one_moment_of_one_repository_is_spread(spark):
    """A third of all rows, equal but for their ids or wholly equal, goes to several tasks with the outcomes of one walk."""
    data = [("hot", i // 2, T1, f'version = "1.0.{i % 3}"' if i % 5 else "none", "") for i in range(600)] + [("hot", 900, T2, 'version = "9.0.0"', "")] * 200
    data += [(f"r{i % 40}", i, T2, f'version = "1.{i % 2}.0"', "[skip-semver]" if i % 7 == 0 else "") for i in range(800)] + [(None, 1, T1, 'version = "1.0.0"', None)] * 2
    df = spark.createDataFrame(data, "repo string, id long, ts timestamp_ntz, file_text string, commit_message string").repartition(3)
    got = policy.policy_version_bump(df).cache()
    assert got.count() == len(data) and got.where("outcome = 'first'").count() == 42
    assert sorted(r["outcome"] for r in got.where("id = 900").collect()) == ["bumped", *["not_bumped"] * 199]
    walk = {}
    for repo, i, ts, text, message in sorted((d for d in data if d[0] and d[0] != "hot"), key=lambda d: (d[0], d[2], d[1])):
        version = text.split('"')[1]
        walk[repo, i] = "first" if not any(k[0] == repo for k in walk) else "bypass" if message else "not_bumped" if last == version else "bumped"
        last = version
    assert {(r["repo"], r["id"]): r["outcome"] for r in got.where("repo like 'r%'").collect()} == walk
