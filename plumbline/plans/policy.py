"""Policy queries; commands, changes, pull requests and versions come from orders."""

from __future__ import annotations


from ..operators import policy as op
from ..sources.bindings import table
from .registry import query

COMMAND = """CASE o_orderkey % 7 WHEN 0 THEN 'git push --force origin main' WHEN 1 THEN 'git push origin feature/x'
  WHEN 2 THEN 'cd a && git merge dev' WHEN 3 THEN 'gh pr merge 12 --squash --admin'
  WHEN 4 THEN 'gh api -X put repos/a/branches/main/protection -f m=PUT' WHEN 5 THEN 'git tag v1 && git merge x' ELSE 'git status' END"""
PAYLOAD = f"""CASE WHEN o_orderkey % 10 = 3 THEN {COMMAND}
  ELSE concat('{{"tool_input": {{"command": "', {COMMAND}, '"}}, "why": "', CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 2 = 0 OR o_orderkey % 11 = 0
              THEN '[skip-gitops]' ELSE 'x' END, '"}}') END"""
CHANGED = """concat(CASE o_orderkey % 8 WHEN 0 THEN 'src/' WHEN 1 THEN 'docs/adr/' WHEN 2 THEN 'pkg/tests/' WHEN 3 THEN 'tests/'
  WHEN 4 THEN 'x/docs/adr/' ELSE 'deploy/' END, 'f', o_orderkey,
  CASE o_orderkey % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.yml' WHEN 3 THEN '.PY' WHEN 4 THEN '.sh' ELSE '' END)"""
HEAD = """CASE o_orderkey % 9 WHEN 0 THEN 'staging' WHEN 1 THEN 'release/1' WHEN 2 THEN 'hotfix/2' WHEN 3 THEN 'feature/3' WHEN 4 THEN 'chore/4'
  WHEN 5 THEN 'docs/5' WHEN 6 THEN 'fix/6' WHEN 7 THEN 'mine' ELSE '' END"""
BASE = "CASE o_custkey % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'staging' ELSE 'develop' END"
VERSION_TEXT = """concat('[project]', chr(10), CASE WHEN o_orderkey % 13 = 0 THEN 'version = dynamic'
  ELSE concat('version = "1.', o_orderkey % 3, '.0"') END, chr(10))"""
MESSAGE = "CASE WHEN o_orderkey % 17 = 0 THEN 'fix [skip-semver]' ELSE 'fix' END"


def _orders(spark, folder, **columns):
    return table(spark, folder, "orders").selectExpr("o_orderkey AS id", *[f"{e} AS {n}" for n, e in columns.items()])


RULE = r"""CASE WHEN regexp_matches(command, 'git\s+push\s+(?:[-\w]+\s+)*origin\s+(?:master|main)\b') THEN 'GITOPS-001'
  WHEN regexp_matches(command, '\bgit\s+merge\b') THEN 'GITOPS-002' WHEN regexp_matches(command, 'gh\s+pr\s+merge\b.*--admin') THEN 'GITOPS-003'
  WHEN regexp_matches(command, '(?i)gh\s+api\b.*\bbranches/(?:master|main)/protection\b.*(PUT|DELETE|PATCH)') THEN 'GITOPS-004'
  WHEN regexp_matches(command, '\bgit\s+tag\b') THEN 'GITOPS-005' END"""


@query("policy_first_match", f"WITH c AS (SELECT o_orderkey AS id, {COMMAND} AS command FROM orders) SELECT id, command, {RULE} AS rule FROM c")
def policy_first_match(spark, folder):
    return op.policy_first_match(_orders(spark, folder, command=COMMAND))


@query("policy_bypass", f"""
WITH c AS (SELECT o_orderkey AS id, {COMMAND} AS command, {PAYLOAD} AS payload, o_orderkey % 19 <> 0 AS has_marker FROM orders),
r AS (SELECT *, CASE WHEN has_marker THEN {RULE} END AS rule FROM c)
SELECT id, command, rule, CASE WHEN rule IS NULL THEN 'ALLOW' WHEN contains(payload, '[skip-gitops]') THEN 'BYPASS' ELSE 'WARN' END AS decision FROM r""")
def policy_bypass(spark, folder):
    rows = op.policy_bypass(_orders(spark, folder, payload=PAYLOAD, has_marker="o_orderkey % 19 <> 0"))
    return rows.select("id", "command", "rule", "decision")


@query("policy_needs_record", f"""
WITH c AS (SELECT o_orderkey AS id, {CHANGED} AS path, CASE o_orderkey % 23 WHEN 0 THEN 'x [skip-adr]' WHEN 1 THEN '--skip-adr' ELSE '' END AS payload,
                  o_orderkey % 29 = 0 AS pending FROM orders)
SELECT id, path, CASE WHEN payload <> '' THEN 'bypass'
  WHEN path LIKE 'docs/adr/%' OR path LIKE '%/docs/adr/%' OR path LIKE '%tests/%' OR NOT regexp_matches(path, '\\.(py|sh|yml|yaml)$') OR pending THEN 'allow'
  ELSE 'deny' END AS decision FROM c""")
def policy_needs_record(spark, folder):
    token = "CASE o_orderkey % 23 WHEN 0 THEN 'x [skip-adr]' WHEN 1 THEN '--skip-adr' ELSE '' END"
    rows = _orders(spark, folder, path=CHANGED, payload=token, has_pending_record="o_orderkey % 29 = 0")
    return op.policy_needs_record(rows).select("id", "path", "decision")


@query("policy_branch_flow", f"""
WITH p AS (SELECT o_orderkey AS id, {BASE} AS base_ref, {HEAD} AS head_ref FROM orders)
SELECT id, base_ref, head_ref, CASE WHEN head_ref = '' OR base_ref = 'develop' THEN true
   WHEN base_ref = 'main' THEN regexp_matches(head_ref, '^(staging|release/|hotfix/)')
   ELSE regexp_matches(head_ref, '^(feature/|hotfix/|release/|chore/|docs/|fix/)') END AS passed FROM p""")
def policy_branch_flow(spark, folder):
    return op.policy_branch_flow(_orders(spark, folder, base_ref=BASE, head_ref=HEAD))


@query("policy_version_bump", f"""
WITH v AS (SELECT concat('repo-', o_custkey % 100) AS repo, o_orderkey AS id, o_orderdate AS ts, {MESSAGE} AS msg,
                  nullif(regexp_extract({VERSION_TEXT}, 'version = "([0-9.]+)"', 1), '') AS version FROM orders),
w AS (SELECT *, lag(version) OVER o AS prev, row_number() OVER o AS rn FROM v WINDOW o AS (PARTITION BY repo ORDER BY ts, id)),
x AS (SELECT *, CASE WHEN rn = 1 THEN 'first' WHEN contains(msg, '[skip-semver]') THEN 'bypass' WHEN prev IS NULL OR version IS NULL THEN 'unreadable'
                     WHEN prev = version THEN 'not_bumped' ELSE 'bumped' END AS outcome FROM w)
SELECT repo, id, ts, version, prev AS previous_version, outcome, outcome <> 'not_bumped' AS passed FROM x""")
def policy_version_bump(spark, folder):
    rows = _orders(spark, folder, repo="concat('repo-', o_custkey % 100)", ts="o_orderdate", file_text=VERSION_TEXT, commit_message=MESSAGE)
    return op.policy_version_bump(rows)
