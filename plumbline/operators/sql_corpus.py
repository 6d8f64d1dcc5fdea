"""Stored-procedure corpus: dependencies, metrics, logic, topology and lineage from (path, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.ranking import top_k
from ..vocab import (SQL_NOT_TABLES, SQL_SUMMARY_MERGE, SQL_SUMMARY_QUERY, SQL_SUMMARY_REFRESH,
                     SQL_SUMMARY_TRANSFER, SQL_SUMMARY_UNREADABLE)

# Patterns of the statements looked for. No word boundary before EXEC is intended.
NAME = r"([\w.\[\]]+)"
EXEC_CALL = rf"(?iUd)EXEC(?:UTE)?\s+{NAME}"
TABLE_USE = rf"(?iUd)(FROM|JOIN|UPDATE|INTO)\s+{NAME}"
CREATE_PROC = rf"(?iUd)CREATE\s+PROC(?:EDURE)?\s+{NAME}"
BRANCH_WORD = r"(?iUd)\b(IF|WHILE|CASE|BEGIN)\b"
CRUD = (("C", r"(?iUd)INSERT\s+INTO"), ("R", r"(?iUd)SELECT\s+"), ("U", r"(?iUd)UPDATE\s+"), ("D", r"(?iUd)DELETE\s+"))
INSERT_TARGET = rf"(?iUd)INSERT\s+INTO\s+{NAME}"
JOIN_CLAUSE = (rf"(?iUsd)(?:INNER|LEFT|RIGHT|FULL)?\s+JOIN\s+{NAME}\s+ON\s+(.*?)"
               r"(?=INNER|LEFT|RIGHT|FULL|JOIN|WHERE|GROUP|ORDER|$)")
WHERE_CLAUSE = r"(?iUsd)WHERE\s+(.*?)($|GROUP|ORDER|HAVING)"
CASE_BLOCK = r"(?iUsd)CASE\s+.*?END"
RULE_SPLIT = r"(?iUd)\bAND\b|\bOR\b"

# Whether a table is read or written after each keyword.
DIRECTION = {"FROM": "INPUT", "JOIN": "INPUT", "UPDATE": "OUTPUT", "INTO": "OUTPUT"}


def _all(content: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(group))


def crud(content: Column) -> Column:
    return F.concat(*[F.when(content.rlike(p), letter).otherwise("") for letter, p in CRUD])


def complexity(content: Column) -> Column:
    return F.regexp_count(content, F.lit(BRANCH_WORD)).cast("bigint")


def proc_name(path: Column, content: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(content, CREATE_PROC, 1), F.lit("")), text.stem(path))


def analyse(corpus: DataFrame) -> DataFrame:
    """One narrow row per file with everything the operators below need, from one read.

    Columns an operator does not use are pruned away. Keep the result (as a table or with
    ``cut_lineage``) when several operators follow, so that the content is read only once.
    """
    path, content = F.col("path"), F.col("content")
    return corpus.select(
        "path", text.line_total(content).alias("line_count"), proc_name(path, content).alias("proc_name"),
        crud(content).alias("crud_operations"), complexity(content).alias("complexity_score"),
        F.sha2(F.encode(content, "UTF-8"), 256).alias("hash"),
        _all(content, EXEC_CALL, 1).alias("calls"), _all(content, TABLE_USE, 0).alias("uses"),
    )


def exec_deps(index: DataFrame) -> DataFrame:
    """Called procedures, duplicates kept."""
    found = index.select(F.col("path").alias("caller_path"), F.explode("calls").alias("dependency_name"))
    return found.select(
        "caller_path", "dependency_name", F.lit("PROCEDURE").alias("dependency_type"),
        F.concat(F.lit("EXEC "), F.col("dependency_name")).alias("raw_line"), F.lit(None).cast("string").alias("direction"),
    )


def table_deps(index: DataFrame) -> DataFrame:
    """Tables and views used, duplicates kept, with the direction the keyword implies."""
    uses = index.select(F.col("path").alias("caller_path"), F.explode("uses").alias("use"))
    found = uses.select(
        "caller_path", F.regexp_extract("use", TABLE_USE, 1).alias("keyword"),
        F.regexp_extract("use", TABLE_USE, 2).alias("dependency_name"),
    )
    word = F.upper("keyword")
    direction = F.when(word.isin(*[k for k, d in DIRECTION.items() if d == "INPUT"]), "INPUT").otherwise("OUTPUT")
    return found.where(~F.upper("dependency_name").isin(*SQL_NOT_TABLES)).select(
        "caller_path", "dependency_name", F.lit("TABLE/VIEW").alias("dependency_type"),
        F.concat(F.lit("REF "), F.col("dependency_name")).alias("raw_line"), direction.alias("direction"),
    )


def dependencies(index: DataFrame) -> DataFrame:
    return exec_deps(index).unionByName(table_deps(index))


def metrics(index: DataFrame) -> DataFrame:
    return index.select("path", "line_count", "proc_name", "crud_operations", "complexity_score")


def sql_files(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.col("path").endswith(".sql"))


def logic(corpus: DataFrame) -> DataFrame:
    """Target table, joins, row filters and CASE blocks of each file."""
    content = F.col("content")
    joins = F.arrays_zip(_all(content, JOIN_CLAUSE, 1).alias("table"), _all(content, JOIN_CLAUSE, 2).alias("on"))
    where = text.strip(F.regexp_extract(content, WHERE_CLAUSE, 1))
    return corpus.select(
        "path",
        F.nullif(F.regexp_extract(content, INSERT_TARGET, 1), F.lit("")).alias("target"),
        F.transform(joins, lambda j: F.struct(j["table"].alias("table"), text.strip(j["on"]).alias("on"))).alias("joins"),
        F.when(content.rlike(WHERE_CLAUSE), F.transform(F.split(where, RULE_SPLIT), text.strip))
        .otherwise(F.array().cast("array<string>")).alias("filters"),
        F.transform(_all(content, CASE_BLOCK, 0), text.strip).alias("complex_logic"),
    )


def spec_rows(parsed: DataFrame) -> DataFrame:
    """The parsed logic as (path, section, ordinal, text) rows."""
    def section(name: str, values: Column) -> Column:
        return F.transform(values, lambda v, i: F.struct(
            F.lit(name).alias("section"), (i + 1).cast("bigint").alias("ordinal"), v.alias("text")))

    parts = F.concat(
        section("objective", F.array(F.coalesce("target", F.lit("Result Set")))),
        section("join", F.transform("joins", lambda j: F.concat(j["table"], F.lit(" ON "), j["on"]))),
        section("rule", F.col("filters")),
        section("transformation", F.col("complex_logic")),
    )
    return parsed.select("path", F.inline(parts))


def leaves(metric_rows: DataFrame, deps: DataFrame, *, limit: int = 10, max_lines: int | None = None) -> DataFrame:
    """Most complex procedures that call no other procedure.

    NOT IN semantics: one NULL caller empties the result. It is written as an anti join plus a
    scalar check for that NULL, because the planner's own form of NOT IN would broadcast all
    callers.
    """
    callers = deps.where(F.col("dependency_type") == "PROCEDURE").select(F.col("caller_path").alias("path"))
    null_callers = callers.where(F.col("path").isNull()).limit(1).agg(F.count("*")).scalar()
    rows = metric_rows.where(F.col("path").ilike("%procedures%"))
    if max_lines:
        rows = rows.where(F.col("line_count") <= max_lines)
    rows = rows.join(callers, "path", "left_anti").where(null_callers == 0)
    best = top_k(rows, limit, F.desc("complexity_score"), F.asc("path"))
    return best.select("path", "complexity_score", "line_count")


def roots(deps: DataFrame, *, limit: int = 10) -> DataFrame:
    """Callers of the most different procedures."""
    calls = deps.where(F.col("dependency_type") == "PROCEDURE").groupBy("caller_path").agg(
        F.count_distinct("dependency_name").alias("call_count")
    )
    return top_k(calls, limit, F.desc("call_count"), F.asc("caller_path"))


def trace(metric_rows: DataFrame, files: DataFrame, term: str) -> DataFrame:
    """Procedures whose name contains ``term``; % and _ in it stay wildcards."""
    hits = metric_rows.where(F.col("proc_name").ilike(f"%{term}%"))
    return hits.join(files.select("path", "hash"), "path").select(
        "proc_name", "path", "line_count", "crud_operations", "complexity_score", "hash"
    )


def summary_line(content: Column) -> Column:
    upper = F.upper(content)
    has = upper.contains
    return (
        F.when(content.isNull(), SQL_SUMMARY_UNREADABLE)
        .when(has("TRUNCATE TABLE") & has("INSERT INTO"), SQL_SUMMARY_REFRESH)
        .when(has("MERGE INTO"), SQL_SUMMARY_MERGE)
        .when(has("INSERT INTO") & has("SELECT"), SQL_SUMMARY_TRANSFER)
        .otherwise(SQL_SUMMARY_QUERY)
    )


def summaries(corpus: DataFrame) -> DataFrame:
    return corpus.select("path", summary_line(F.col("content")).alias("summary"))


def _dataset(name: Column) -> Column:
    """Name without brackets, dots as underscores."""
    return F.translate(name, ".[]", "_")


def _procedure_paths(metric_rows: DataFrame) -> DataFrame:
    """One path per procedure name, the last in path order."""
    return metric_rows.groupBy("proc_name").agg(F.max("path").alias("path"))


def lineage(metric_rows: DataFrame, deps: DataFrame) -> DataFrame:
    """Input and output data sets per procedure: (proc, inputs, outputs).

    The sets of one row come from one file. A file that lost its name to a later one is listed
    under its path; a procedure without outputs gets a placeholder.
    """
    owners = _procedure_paths(metric_rows)
    uses = deps.where(F.col("dependency_type") == "TABLE/VIEW").select(
        F.col("caller_path").alias("path"), _dataset(F.col("dependency_name")).alias("dataset"), "direction"
    )
    sets = uses.groupBy("path").agg(
        F.array_sort(F.collect_set(F.when(F.col("direction") == "INPUT", F.col("dataset")))).alias("inputs"),
        F.array_sort(F.collect_set(F.when(F.col("direction") != "INPUT", F.col("dataset")))).alias("outputs"),
    )
    none = F.array().cast("array<string>")
    rows = owners.join(sets, "path", "full").withColumn("proc", F.coalesce("proc_name", "path"))
    outputs = F.coalesce("outputs", none)
    return rows.select(
        "proc", F.coalesce("inputs", none).alias("inputs"),
        F.when(F.size(outputs) == 0, F.array(F.concat("proc", F.lit("_output")))).otherwise(outputs).alias("outputs"),
    )


def lineage_catalog(deps: DataFrame) -> DataFrame:
    names = deps.where(F.col("dependency_type") == "TABLE/VIEW").select(_dataset(F.col("dependency_name")).alias("dataset"))
    return names.distinct().select(
        "dataset", F.lit("pandas.CSVDataset").alias("type"),
        F.concat(F.lit("data/01_raw/"), F.col("dataset"), F.lit(".csv")).alias("filepath"),
    )


def lineage_graph(lineage_rows: DataFrame) -> DataFrame:
    """Edges procedure -> data set and data set -> procedure.

    Two procedures are linked when a path of two edges joins them. The data set stays a node, so
    a table that many write and many read costs their sum, not their product.
    """
    out = lineage_rows.select(F.col("proc").alias("source"), F.explode("outputs").alias("target"), F.lit("writes").alias("kind"))
    into = lineage_rows.select(F.explode("inputs").alias("source"), F.col("proc").alias("target"), F.lit("feeds").alias("kind"))
    return out.unionByName(into)


def lineage_links(graph: DataFrame) -> DataFrame:
    """Per data set with both sides: writers, readers and the procedure links they imply."""
    writers = graph.where(F.col("kind") == "writes").groupBy(F.col("target").alias("dataset")).agg(F.count("*").alias("writers"))
    readers = graph.where(F.col("kind") == "feeds").groupBy(F.col("source").alias("dataset")).agg(F.count("*").alias("readers"))
    return writers.join(readers, "dataset").withColumn("links", F.col("writers") * F.col("readers"))
