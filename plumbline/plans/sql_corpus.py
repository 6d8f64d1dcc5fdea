"""Queries over a corpus of stored procedures.

No SQL text is among the tables, so one procedure per part is written by a projection of
``part``; the same projection runs in the SQL that checks the result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sql_corpus as op
from ..session import cut_lineage
from ..sources.bindings import TEXTS_A_TASK, spread, table
from .registry import query

PATH = """concat(CASE WHEN p_partkey % 6 = 0 THEN 'src/views/' ELSE 'src/Procedures/' END,
  'p_', p_partkey, '.sql') AS path"""
CONTENT = """concat('-- ', p_name, chr(10),
  CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN concat('CREATE PROC [dbo].[p_', p_partkey, ']', chr(10), 'AS')
       ELSE concat('create procedure  p_', p_partkey - p_partkey % 13 % 2, chr(13), chr(10), 'AS') END, chr(10),
  'BEGIN', chr(10),
  CASE WHEN p_partkey % 4 <> 0 THEN concat('  IF @x > ', p_size, ' EXEC p_', (p_partkey * 7 + 1) % 2003, chr(10)) ELSE '' END,
  CASE WHEN p_partkey % 4 IN (1, 2) THEN concat('  execute [dbo].[p_', (p_partkey * 11 + 3) % 2003, ']', chr(10),
     '  WHILE 1 = 1 sp_exec p_', p_size, chr(10)) ELSE '' END,
  CASE WHEN p_partkey % 8 = 0 THEN concat('  TRUNCATE TABLE [stage].[t_', p_size, '];', chr(10)) ELSE '' END,
  CASE WHEN p_partkey % 9 = 0 THEN concat('  MERGE INTO m_', p_size, ' USING s_', p_size, ' ON m.id = s.id;', chr(10)) ELSE '' END,
  CASE WHEN p_partkey % 10 <> 9 THEN concat('  INSERT INTO [stage].[t_', p_size, ']', chr(10)) ELSE '' END,
  '  SELECT a.x, CASE WHEN b.y > ', p_size, ' THEN 1 ELSE 2 END', chr(10),
  '  FROM [raw].[s_', p_partkey % 40, '] a', chr(10),
  '  INNER JOIN dim.d_', p_partkey % 30, CASE WHEN p_partkey % 14 = 5 THEN ' b' ELSE '' END, ' ON a.id = b.id', chr(10),
  CASE WHEN p_partkey % 3 <> 1 THEN concat('  LEFT JOIN dim.e_', p_partkey % 25, ' ON b.k = c.k AND c.v = 5', chr(10)) ELSE '' END,
  CASE WHEN p_partkey % 11 <> 0 THEN concat('  WHERE a.v > ', p_size, ' AND b.w = 2 or c.z IS NULL', chr(10)) ELSE '' END,
  CASE WHEN p_partkey % 5 = 2 THEN concat('  GROUP BY a.x', chr(10)) ELSE '' END,
  CASE WHEN p_partkey % 3 = 0 THEN concat('  UPDATE t_', p_partkey % 50, ' SET z = 1;', chr(10)) ELSE '' END,
  CASE WHEN p_partkey % 5 = 0 THEN concat('  DELETE FROM t_', p_partkey % 20, ';', chr(10)) ELSE '' END,
  'END', chr(10)) AS content"""


def corpus(spark, folder):
    part = spread(table(spark, folder, "part"), "p_partkey", TEXTS_A_TASK)
    return part.selectExpr(PATH, CONTENT)


def analysed(spark, folder):
    return op.analyse(corpus(spark, folder))


def indexed(spark, folder):
    """The analysed files, kept for queries that use them more than once."""
    return cut_lineage(analysed(spark, folder))


X = f"WITH x AS (SELECT {PATH}, {CONTENT} FROM part), " + r"""
ex AS (SELECT path AS caller_path, unnest(regexp_extract_all(content, '(?i)EXEC(?:UTE)?\s+([\w.\[\]]+)', 1)) AS dependency_name FROM x),
tk AS (SELECT path AS caller_path, unnest(regexp_extract_all(content, '(?i)(?:FROM|JOIN|UPDATE|INTO)\s+[\w.\[\]]+')) AS use FROM x),
td AS (SELECT caller_path, regexp_extract(use, '([\w.\[\]]+)$', 1) AS dependency_name,
              CASE WHEN regexp_matches(use, '^(?i:FROM|JOIN)') THEN 'INPUT' ELSE 'OUTPUT' END AS direction FROM tk
       WHERE upper(regexp_extract(use, '([\w.\[\]]+)$', 1)) NOT IN ('SELECT','INSERT','UPDATE','DELETE','VALUES')),
m AS (SELECT path, CAST(len(string_split(replace(rtrim(content, chr(10)), chr(13) || chr(10), chr(10)), chr(10))) AS BIGINT) AS line_count,
       coalesce(nullif(regexp_extract(content, '(?i)CREATE\s+PROC(?:EDURE)?\s+([\w.\[\]]+)', 1), ''),
                regexp_extract(path, '([^/]+)\.sql$', 1)) AS proc_name,
       concat(CASE WHEN regexp_matches(content, '(?i)INSERT\s+INTO') THEN 'C' ELSE '' END,
              CASE WHEN regexp_matches(content, '(?i)SELECT\s+') THEN 'R' ELSE '' END,
              CASE WHEN regexp_matches(content, '(?i)UPDATE\s+') THEN 'U' ELSE '' END,
              CASE WHEN regexp_matches(content, '(?i)DELETE\s+') THEN 'D' ELSE '' END) AS crud_operations,
       CAST(len(regexp_extract_all(content, '(?i)\b(IF|WHILE|CASE|BEGIN)\b')) AS BIGINT) AS complexity_score FROM x)
"""


@query("sql_exec_deps", X + "SELECT caller_path, dependency_name, 'PROCEDURE' AS dependency_type, 'EXEC ' || dependency_name AS raw_line FROM ex")
def sql_exec_deps(spark, folder):
    return op.exec_deps(analysed(spark, folder)).drop("direction")


@query("sql_table_deps", X + """
SELECT caller_path, dependency_name, 'TABLE/VIEW' AS dependency_type, 'REF ' || dependency_name AS raw_line, direction FROM td""")
def sql_table_deps(spark, folder):
    return op.table_deps(analysed(spark, folder))


for _name, _column in (("sql_crud", "crud_operations"), ("sql_complexity", "complexity_score"), ("sql_proc_name", "proc_name")):
    def _build(spark, folder, _column=_column):
        return op.metrics(analysed(spark, folder)).select("path", _column)

    _build.__name__ = _name
    query(_name, X + f"SELECT path, {_column} FROM m")(_build)


@query("sql_metrics", X + "SELECT * FROM m")
def sql_metrics(spark, folder):
    return op.metrics(analysed(spark, folder))


LOGIC = X + r"""
, marked AS (SELECT path, content, regexp_replace(content, '(?i)(INNER|LEFT|RIGHT|FULL|JOIN|WHERE|GROUP|ORDER)', chr(1) || '\1', 'g') AS mk FROM x),
j AS (SELECT path, list_transform(regexp_extract_all(mk, '(?i)\s\x01JOIN\s+[\w.\[\]]+\s+ON\s+[^\x01]*'),
             lambda t: regexp_replace(trim(regexp_extract(t, '(?is)JOIN\s+([\w.\[\]]+\s+ON\s+.*)', 1), ' ' || chr(10)), '(?i)\s+ON\s+', ' ON ')) AS joins
      FROM marked),
w AS (SELECT path, CASE WHEN regexp_matches(content, '(?i)WHERE\s') THEN list_transform(
        regexp_split_to_array(trim(regexp_extract(content, '(?is)WHERE\s+(.*?)(?:$|GROUP|ORDER|HAVING)', 1), ' ' || chr(10)), '(?i)\bAND\b|\bOR\b'),
        lambda t: trim(t, ' ' || chr(10))) ELSE [] END AS rules,
      nullif(regexp_extract(content, '(?i)INSERT\s+INTO\s+([\w.\[\]]+)', 1), '') AS target,
      regexp_extract_all(content, '(?is)CASE\s+.*?END') AS cases FROM x)
"""


@query("sql_logic", LOGIC + """
SELECT path, target, array_to_string(joins, '|') AS joins, array_to_string(rules, '|') AS filters,
       array_to_string(cases, '|') AS complex_logic FROM w JOIN j USING (path)""")
def sql_logic(spark, folder):
    """Lists are joined with a bar so that both engines show the same value."""
    joins = F.transform("joins", lambda j: F.concat(j["table"], F.lit(" ON "), j["on"]))
    return op.logic(corpus(spark, folder)).select(
        "path", "target", F.array_join(joins, "|").alias("joins"), F.array_join("filters", "|").alias("filters"),
        F.array_join("complex_logic", "|").alias("complex_logic"),
    )


def _section(name: str, column: str, source: str) -> str:
    return (f"SELECT path, '{name}' AS section, unnest(range(1, len({column}) + 1)) AS ordinal, unnest({column}) AS text FROM {source}")


@query("sql_spec_rows", LOGIC + "SELECT path, 'objective' AS section, CAST(1 AS BIGINT) AS ordinal, coalesce(target, 'Result Set') AS text FROM w UNION ALL "
       + " UNION ALL ".join([_section("join", "joins", "j"), _section("rule", "rules", "w"), _section("transformation", "cases", "w")]))
def sql_spec_rows(spark, folder):
    return op.spec_rows(op.logic(corpus(spark, folder)))


@query("sql_leaves", X + """
SELECT path, complexity_score, line_count FROM m
WHERE path NOT IN (SELECT DISTINCT caller_path FROM ex) AND path ILIKE '%procedures%' AND line_count <= 13
ORDER BY complexity_score DESC, path LIMIT 10""")
def sql_leaves(spark, folder):
    files = indexed(spark, folder)
    return op.leaves(op.metrics(files), op.exec_deps(files), limit=10, max_lines=13)


@query("sql_roots", X + """
SELECT caller_path, count(DISTINCT dependency_name) AS call_count FROM ex GROUP BY caller_path
ORDER BY call_count DESC, caller_path LIMIT 10""")
def sql_roots(spark, folder):
    return op.roots(op.exec_deps(analysed(spark, folder)))


@query("sql_trace", X + """
SELECT proc_name, m.path, line_count, crud_operations, complexity_score, sha256(content) AS hash
FROM m JOIN x ON x.path = m.path WHERE proc_name ILIKE '%P_1_7%'""")
def sql_trace(spark, folder):
    files = indexed(spark, folder)
    return op.trace(op.metrics(files), files.select("path", "hash"), "P_1_7")


LINEAGE = X + """
, own AS (SELECT proc_name, max(path) AS path FROM m GROUP BY proc_name),
u AS (SELECT coalesce(own.proc_name, td.caller_path) AS proc, direction,
             replace(replace(replace(dependency_name, '[', ''), ']', ''), '.', '_') AS dataset
      FROM td LEFT JOIN own ON own.path = td.caller_path),
procs AS (SELECT proc_name AS proc FROM own UNION SELECT proc FROM u),
i AS (SELECT DISTINCT proc, dataset FROM u WHERE direction = 'INPUT'),
o AS (SELECT DISTINCT proc, dataset FROM u WHERE direction = 'OUTPUT'
      UNION ALL SELECT proc, proc || '_output' FROM procs WHERE proc NOT IN (SELECT proc FROM u WHERE direction = 'OUTPUT'))
"""


@query("sql_lineage", LINEAGE + """
, ia AS (SELECT proc, string_agg(dataset, ',' ORDER BY dataset) AS inputs FROM i GROUP BY proc),
oa AS (SELECT proc, string_agg(dataset, ',' ORDER BY dataset) AS outputs FROM o GROUP BY proc)
SELECT proc, coalesce(inputs, '') AS inputs, outputs FROM procs LEFT JOIN ia USING (proc) LEFT JOIN oa USING (proc)""")
def sql_lineage(spark, folder):
    files = indexed(spark, folder)
    rows = op.lineage(op.metrics(files), op.table_deps(files))
    return rows.select("proc", F.array_join("inputs", ",").alias("inputs"), F.array_join("outputs", ",").alias("outputs"))


@query("lineage_catalog", LINEAGE + """
SELECT DISTINCT dataset, 'pandas.CSVDataset' AS type, 'data/01_raw/' || dataset || '.csv' AS filepath FROM u""")
def lineage_catalog(spark, folder):
    return op.lineage_catalog(op.table_deps(analysed(spark, folder)))


@query("lineage_graph", LINEAGE + """
SELECT proc AS source, dataset AS target, 'writes' AS kind FROM o UNION ALL SELECT dataset, proc, 'feeds' FROM i""")
def lineage_graph(spark, folder):
    files = indexed(spark, folder)
    return op.lineage_graph(op.lineage(op.metrics(files), op.table_deps(files)))


@query("lineage_links", LINEAGE + """
SELECT dataset, count(DISTINCT o.proc) AS writers, count(DISTINCT i.proc) AS readers,
       count(DISTINCT o.proc) * count(DISTINCT i.proc) AS links FROM o JOIN i USING (dataset) GROUP BY dataset""")
def lineage_links(spark, folder):
    files = indexed(spark, folder)
    return op.lineage_links(op.lineage_graph(op.lineage(op.metrics(files), op.table_deps(files))))


@query("sql_summary", X + """
SELECT path, CASE WHEN contains(upper(content), 'TRUNCATE TABLE') AND contains(upper(content), 'INSERT INTO')
                    THEN 'Full Refresh: Clears and repopulates target table.'
                  WHEN contains(upper(content), 'MERGE INTO') THEN 'Upsert: Synchronizes source and target data.'
                  WHEN contains(upper(content), 'INSERT INTO') AND contains(upper(content), 'SELECT')
                    THEN 'Data Transfer: Transformation and ingestion into target table.'
                  ELSE 'Data Retrieval: Pure query or view definition.' END AS summary FROM x""")
def sql_summary(spark, folder):
    return op.summaries(corpus(spark, folder))
