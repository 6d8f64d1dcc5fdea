"""Repository policies over logs: commands, changed files, pull requests and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import suffix
from ..session import cut_lineage
from ..vocab import (BRANCH_PREFIXES, COMMAND_BYPASS, COMMAND_RULES, RECORD_BYPASS, RECORD_DIRECTORY,
                     RECORD_EXTENSIONS, VERSION_BYPASS)

# Fixed value: the line of a version file.
VERSION = r'(?m)^version\s*=\s*"(\d+\.\d+\.\d+)"'


def first_matching_rule(command: Column) -> Column:
    """Id of the first rule the command breaks, NULL for none."""
    rule = F
    for rule_id, pattern in COMMAND_RULES:
        rule = rule.when(command.rlike(f"(?Ud){pattern}"), rule_id)
    return rule


def policy_first_match(commands: DataFrame) -> DataFrame:
    return commands.withColumn("rule", first_matching_rule(F.col("command")))


def policy_bypass(commands: DataFrame) -> DataFrame:
    """Decision per command: WARN, BYPASS when the payload carries the token, else ALLOW.

    The command is read from the payload; a payload that is no JSON is the command itself.
    Repositories without the marker are not checked.
    """
    raw = F.col("payload")
    valid = F.get_json_object(raw, "$").isNotNull()
    command = F.when(valid, F.coalesce(F.get_json_object(raw, "$.tool_input.command"), F.lit(""))).otherwise(raw)
    rule = F.when(F.col("has_marker"), first_matching_rule(F.col("command")))
    decision = F.when(F.col("rule").isNull(), "ALLOW").when(raw.contains(COMMAND_BYPASS), "BYPASS").otherwise("WARN")
    return commands.withColumn("command", command).withColumn("rule", rule).withColumn("decision", decision)


def needs_record(path: Column) -> Column:
    """Code and configuration need a design record; tests, notes and the records themselves do not."""
    exempt = path.startswith(f"{RECORD_DIRECTORY}/") | path.contains(f"/{RECORD_DIRECTORY}/") | path.contains("tests/")
    return F.coalesce(~exempt & suffix(path).isin(*RECORD_EXTENSIONS), F.lit(False))


def policy_needs_record(changes: DataFrame) -> DataFrame:
    """allow or deny per change; a bypass token or a pending record allows it."""
    bypass = F.greatest(*[F.col("payload").contains(token) for token in RECORD_BYPASS])
    decision = F.when(bypass, "bypass").when(~needs_record(F.col("path")), "allow").when(
        F.col("has_pending_record"), "allow").otherwise("deny")
    return changes.withColumn("decision", decision)


def policy_branch_flow(pull_requests: DataFrame) -> DataFrame:
    """Whether the head branch may go into the base branch; other bases and empty heads pass."""
    head = F.col("head_ref")
    ok = F
    for base, prefixes in BRANCH_PREFIXES.items():
        ok = ok.when(F.col("base_ref") == base, F.greatest(*[head.startswith(p) for p in prefixes]))
    passed = F.when(F.coalesce(head, F.lit("")) == "", F.lit(True)).otherwise(ok.otherwise(F.lit(True)))
    return pull_requests.withColumn("passed", passed)


def policy_version_bump(versions: DataFrame) -> DataFrame:
    """Whether each version file differs from the one before it in its repository.

    A first, unreadable or exempted version passes. Rows are dealt to tasks by ranges of their order, so one repository, day or
    moment with very many rows is spread over many; each task finds predecessors among its own rows of a repository, and only
    the last row of a repository in each task is carried to the next one. Equal rows are told apart by a number of no other use.
    """
    order = ["ts", "id", "_n"]
    rows = versions.select(
        "repo", "id", "ts", F.nullif(F.regexp_extract("file_text", VERSION, 1), F.lit("")).alias("version"),
        F.coalesce(F.col("commit_message").contains(VERSION_BYPASS), F.lit(False)).alias("bypass"), F.monotonically_increasing_id().alias("_n"))
    dealt = cut_lineage(rows.repartitionByRange("repo", *order).withColumn("_task", F.spark_partition_id()))
    mark = F.struct(F.lit(True).alias("known"), F.col("version").alias("version"))
    inner = dealt.withColumn("before", F.lag(mark).over(Window.partitionBy("repo", "_task").orderBy(*order)))
    last = dealt.groupBy("repo", "_task").agg(F.max_by(mark, F.struct(*order)).alias("last"))
    carried = last.withColumn("carried", F.lag("last").over(Window.partitionBy("repo").orderBy("_task"))).drop("last")
    same = inner["repo"].eqNullSafe(carried["repo"]) & (inner["_task"] == carried["_task"])
    # One row for each repository and task that meet, at most repositories + tasks.
    joined = inner.join(carried, same).select(inner["*"], F.coalesce("before", "carried").alias("previous"))
    previous = F.col("previous.version")
    reason = (
        F.when(F.col("previous").isNull(), "first").when(F.col("bypass"), "bypass")
        .when(previous.isNull() | F.col("version").isNull(), "unreadable")
        .when(previous == F.col("version"), "not_bumped").otherwise("bumped")
    )
    return joined.select("repo", "id", "ts", "version", previous.alias("previous_version"), reason.alias("outcome"),
                         (reason != "not_bumped").alias("passed"))
