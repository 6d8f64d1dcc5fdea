"""Queries over whole trees of several languages, one led by Python and one by C."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import code_decisions, code_structure
from ..operators import code_tree as op
from ..vocab import CALL_KEYWORDS
from .code_calls import EDGES_C, GEN_DEF, GROUPS, _tokens, _words
from .code_corpus import code, tree, tree_sql
from .code_decisions import D
from .code_structure import C, PY, _flat
from .registry import CHECKS, query

SOURCE = r"\.(c|h|py|js|ts|cs|go)$"
# The language that leads has its own parser, all others are read as any language's.
OWN = {"python": "path LIKE '%.py' AND path NOT IN (FROM bad)", "c": r"regexp_matches(path, '\.[ch]$')"}


def T(first: str) -> str:
    """The tree, numbered lines of its source files, broken Python files, and the files read as any language's."""
    return f"""
WITH x AS (SELECT * FROM ({tree_sql(first)}) WHERE regexp_matches(path, '{SOURCE}')),
l AS (SELECT path, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line, unnest(string_split(content, chr(10))) AS text FROM x),
bad AS (SELECT DISTINCT path FROM l WHERE text LIKE 'def broken%'),
own AS (SELECT path FROM x WHERE {OWN[first]}),
other AS (SELECT path FROM x WHERE path NOT IN (FROM own))
"""


def _after(head: str, body: str) -> str:
    """What follows ``head`` in a query that starts with it."""
    return body[len(head):]


GENERIC_SYMBOLS = r"""
SELECT path, 'function' AS kind, 'broken' AS name, line, '' AS args, '' AS bases FROM l WHERE text LIKE 'def broken%' AND path IN (FROM other)
UNION ALL SELECT path, 'function', name, min(line), '', '' FROM (
  SELECT path, line, unnest(regexp_extract_all(text, '\b(\w+)\s*\([^)]*\)\s*[{:]', 1)) AS name FROM l
  WHERE path IN (FROM other) AND NOT (path IN (FROM bad) AND text LIKE 'class %')) GROUP BY path, name"""
# The checks of one language, on the lines of its files in the tree.
OWN_LINES = ", tl AS (SELECT * FROM l WHERE path IN (FROM own)), tx AS (SELECT * FROM x WHERE path IN (FROM own))"


def _of_own(body: str) -> str:
    return body.replace("FROM l ", "FROM tl ").replace("FROM l\n", "FROM tl\n").replace("JOIN l ON l.", "JOIN tl AS l ON l.").replace("FROM x ", "FROM tx ")


PYTHON_SYMBOLS = _of_own(_after(C("python"), PY).split("sym AS (", 1)[1].split("-- the unclosed bracket")[0])
C_FUNCTIONS, C_SYMBOLS = _after(C("c"), CHECKS["modules_c"]).split("\nSELECT ", 1)
SYMBOLS = {
    "python": T("python") + OWN_LINES + f", sym AS ({PYTHON_SYMBOLS} UNION ALL {GENERIC_SYMBOLS})",
    "c": T("c") + OWN_LINES + _of_own(C_FUNCTIONS) + f", sym AS (SELECT {_of_own(C_SYMBOLS)} UNION ALL {GENERIC_SYMBOLS})",
}
LABEL = {"python": ("'Python'", "contains(content, 'if __name__') OR path LIKE '%/main.py'"),
         "c": ("'C/C++'", "contains(content, 'main(')")}

OTHER_EDGES = rf"""
od AS (SELECT path, line, text, CASE WHEN regexp_matches(text, '{GEN_DEF}') THEN regexp_extract(text, '{GEN_DEF}', 1) END AS def FROM l WHERE path IN (FROM other)),
oc AS (SELECT *, last_value(def IGNORE NULLS) OVER (PARTITION BY path ORDER BY line) AS now FROM od),
ot AS ({_tokens("oc", "text", "now AS caller, path, line")}),
oe AS (SELECT caller, callee, line, path AS location FROM ot WHERE caller IS NOT NULL AND callee <> caller AND callee NOT IN ({_words(CALL_KEYWORDS["generic"])}))
"""
OWN_EDGES = {
    "python": r"""
k AS (SELECT path, regexp_extract(content, 'def helper_(\w+)', 1) AS k FROM tx),
e AS (SELECT CASE WHEN text LIKE '        return%' THEN 'run' ELSE 'helper_' || k END AS caller, regexp_extract(text, '(\w+)\(', 1) AS callee, line, tl.path AS location
      FROM tl JOIN k USING (path) WHERE text LIKE '        return%' OR text LIKE '    return%' OR text LIKE '    obj.%' OR text LIKE '    hid_%')""",
    "c": _of_own(_after(C("c"), EDGES_C)).strip().removeprefix(",").replace("FROM l)", "FROM tl)"),
}
SITES = rf"""
, g AS (SELECT * FROM (VALUES {GROUPS}) AS t(function, grp)),
h AS (SELECT path AS file, line, unnest(regexp_extract_all(text, '\b\w+\s*\([^)]*\)')) AS hit FROM l)
SELECT function, file, line, replace(regexp_extract(hit, '\((.*)\)', 1), ', ', ',') AS args, grp AS "group" FROM h JOIN g ON g.function = regexp_extract(hit, '^(\w+)', 1)"""


def _files(spark, folder, first):
    return op.tree_files(tree(spark, folder, first))


def _register(first: str) -> None:
    label, entry = LABEL[first]

    @query(f"tree_symbols_{first}", SYMBOLS[first] + "SELECT * FROM sym")
    def symbols(spark, folder):
        return _flat(op.tree_symbols(_files(spark, folder, first)))

    @query(f"tree_modules_{first}", SYMBOLS[first] + f"""
SELECT x.path, CASE WHEN {OWN[first].split(" AND ")[0]} THEN {label} ELSE regexp_extract(path, '(\\.[a-z]+)$', 1) END AS language,
       ({OWN[first].split(" AND ")[0]}) AND ({entry}) AS is_entry_point, CAST(length(content) - length(replace(content, chr(10), '')) AS BIGINT) AS line_count,
       {", ".join(f"CAST((SELECT count(*) FROM sym WHERE sym.path = x.path AND kind = '{k}') AS INTEGER) AS {n}" for k, n in (("import", "imports"), ("class", "classes"), ("function", "functions"), ("define", "defines")))} FROM x""")
    def modules(spark, folder):
        rows = op.tree_modules(_files(spark, folder, first))
        return rows.select("path", "language", "is_entry_point", "line_count", *[F.size(c).alias(c) for c in ("imports", "classes", "functions", "defines")])

    @query(f"tree_public_api_{first}", SYMBOLS[first] + "SELECT name, kind, path AS location FROM sym WHERE kind = 'class' OR (kind = 'function' AND name NOT LIKE '\\_%' ESCAPE '\\')")
    def public_api(spark, folder):
        return op.tree_public_api(_files(spark, folder, first)).drop("ordinal")

    @query(f"tree_call_edges_{first}", T(first) + OWN_LINES + f", {OWN_EDGES[first]}, {OTHER_EDGES} SELECT * FROM e UNION ALL SELECT * FROM oe")
    def call_edges(spark, folder):
        return op.tree_call_edges(_files(spark, folder, first)).drop("pos")

    @query(f"tree_api_calls_{first}", T(first) + SITES)
    def api_calls(spark, folder):
        return op.tree_api_calls(_files(spark, folder, first)).select("function", "file", "line", F.array_join("args", ",").alias("args"), "group")

    @query(f"tree_decisions_{first}", T(first) + _after(C("c"), D) + "SELECT * FROM d")
    def decisions(spark, folder):
        return code_decisions.decisions(code_structure.source_files(tree(spark, folder, first)))


for _first in ("python", "c"):
    _register(_first)


@query("python_rejects", C("python") + "SELECT DISTINCT path, 'syntax error' AS problem FROM l WHERE text LIKE 'def broken%'")
def python_rejects(spark, folder):
    return code_structure.python_rejects(code_structure.describe_python(code(spark, folder, "python")))
