"""Call and API queries over the generated source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import code_calls as op
from ..operators import code_structure
from ..vocab import API_GROUPS, CALL_KEYWORDS, TECHNOLOGY_PATTERNS
from .code_corpus import code
from .code_structure import C
from .registry import query


def _words(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _tokens(source: str, column: str, extra: str) -> str:
    """One row per call token of a text column, in order."""
    return (f"SELECT {extra}, unnest(range(0, len(regexp_extract_all({column}, '\\b(\\w+)\\s*\\(')))) AS pos, "
            f"unnest(regexp_extract_all({column}, '\\b(\\w+)\\s*\\(', 1)) AS callee FROM {source}")


DEF = r"^[\w*\s]+\s+(\w+)\s*\([^)]*\)\s*(?:const\s*)?\{"
EDGES_C = C("c") + rf"""
, d AS (SELECT path, line, text, nullif(regexp_extract(text, '{DEF}', 1), '') AS def, regexp_extract(text, '{DEF}') AS head FROM l),
cur AS (SELECT *, last_value(def IGNORE NULLS) OVER (PARTITION BY path ORDER BY line) AS now,
               last_value(def IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
               substring(text, length(head) + 1) AS tail FROM d),
tok AS ({_tokens("cur", "head", "prev AS caller, path, line")} UNION ALL {_tokens("cur", "tail", "now AS caller, path, line")}),
e AS (SELECT caller, callee, line, path AS location FROM tok
      WHERE caller IS NOT NULL AND callee <> caller AND callee NOT IN ({_words(CALL_KEYWORDS["c"])}))
"""


@query("call_edges_c", EDGES_C + "SELECT * FROM e")
def call_edges_c(spark, folder):
    return op.call_edges_c(code(spark, folder, "c")).drop("pos")


def _line_check(language: str, definition: str, name: str) -> str:
    return C(language) + rf"""
, d AS (SELECT path, line, text, CASE WHEN regexp_matches(text, '{definition}') THEN {name} END AS def FROM l),
cur AS (SELECT *, last_value(def IGNORE NULLS) OVER (PARTITION BY path ORDER BY line) AS now FROM d),
tok AS ({_tokens("cur", "text", "now AS caller, path, line")})
SELECT caller, callee, line, path AS location FROM tok
WHERE caller IS NOT NULL AND callee <> caller AND callee NOT IN ({_words(CALL_KEYWORDS[language])})"""


JS_DEF = r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(?)\s*(?:[^)]*\))?\s*(?:=>)?\s*\{"
CS_DEF = r"(?:public|private|protected|internal|static|override|virtual|async)\s+[\w<>\[\]]+\s+(\w+)\s*\("
GEN_DEF = r"\b(\w+)\s*\([^)]*\)\s*(?:->[\w\s]+)?\s*[\{:]"


def _lines_query(language: str):
    def build(spark, folder):
        return op.call_edges_line(code(spark, folder, language), language).drop("pos")

    build.__name__ = f"call_edges_{language}"
    return build


query("call_edges_js", _line_check("js", JS_DEF, f"coalesce(nullif(regexp_extract(text, '{JS_DEF}', 1), ''), regexp_extract(text, '{JS_DEF}', 2))"))(_lines_query("js"))
query("call_edges_csharp", _line_check("csharp", CS_DEF, f"regexp_extract(text, '{CS_DEF}', 1)"))(_lines_query("csharp"))
query("call_edges_generic", _line_check("generic", GEN_DEF, f"regexp_extract(text, '{GEN_DEF}', 1)"))(_lines_query("generic"))


@query("call_edges_python", C("python") + r"""
, bad AS (SELECT DISTINCT path FROM l WHERE text LIKE 'def broken%'),
k AS (SELECT path, regexp_extract(content, 'def helper_(\w+)', 1) AS k FROM x),
good AS (SELECT CASE WHEN text LIKE '        return%' THEN 'run' ELSE 'helper_' || k END AS caller, regexp_extract(text, '(\w+)\(', 1) AS callee, line, l.path AS location
         FROM l JOIN k USING (path) WHERE path NOT IN (FROM bad) AND (text LIKE '        return%' OR text LIKE '    return%' OR text LIKE '    obj.%' OR text LIKE '    hid_%')),
d AS (SELECT path, line, text, nullif(regexp_extract(text, '\b(\w+)\s*\([^)]*\)\s*(?:->[\w\s]+)?\s*[\{:]', 1), '') AS def FROM l WHERE path IN (FROM bad)),
cur AS (SELECT *, last_value(def IGNORE NULLS) OVER (PARTITION BY path ORDER BY line) AS now FROM d),
tok AS (SELECT now AS caller, unnest(regexp_extract_all(text, '\b(\w+)\s*\(', 1)) AS callee, line, path AS location FROM cur)
SELECT * FROM good UNION ALL SELECT * FROM tok WHERE caller IS NOT NULL AND callee <> caller
  AND callee NOT IN ('if','while','for','switch','return','new','throw','import','from','class','def','function')""")
def call_edges_python(spark, folder):
    return op.call_edges(code(spark, folder, "python"), "python").drop("pos")


def _edges(spark, folder):
    return op.call_edges_c(code(spark, folder, "c"))


@query("call_graph", EDGES_C + """
SELECT caller, callee, first(location ORDER BY location, line) AS first_location, first(line ORDER BY location, line) AS first_line,
       count(*) AS calls FROM e GROUP BY caller, callee""")
def call_graph(spark, folder):
    return op.call_graph(_edges(spark, folder))


HITS = f"""
, hit AS (SELECT DISTINCT pattern FROM x, (VALUES {", ".join(f"('{p}')" for p, _, _ in TECHNOLOGY_PATTERNS)}) AS t(pattern) WHERE contains(content, pattern))
"""


@query("call_graph_nodes", EDGES_C + HITS + """
SELECT name, name IN (FROM hit) AS highlight FROM (SELECT caller AS name FROM e UNION SELECT callee FROM e)""")
def call_graph_nodes(spark, folder):
    patterns = code_structure.pattern_scan(code(spark, folder, "c"))
    return op.call_graph_nodes(op.call_graph(_edges(spark, folder)), patterns)


@query("external_calls", EDGES_C + HITS + """
SELECT caller, callee, line, location FROM e WHERE callee IN (FROM hit)
   OR (regexp_matches(callee, '^[A-Z]') AND upper(callee) <> callee) OR regexp_matches(callee, '^(Sc|Win|Nfc|Usb)')""")
def external_calls(spark, folder):
    patterns = code_structure.pattern_scan(code(spark, folder, "c"))
    return op.external_calls(_edges(spark, folder), patterns).select("caller", "callee", "line", "location")


@query("entry_flows", EDGES_C.replace("WITH x", "WITH RECURSIVE x") + r"""
, adj AS (SELECT DISTINCT caller, callee FROM e),
ent AS (SELECT path FROM x WHERE contains(content, 'main(')),
roots AS (SELECT DISTINCT regexp_extract(text, '(\w+)\s*\(', 1) AS entry, path AS file FROM l
          WHERE path IN (FROM ent) AND regexp_matches(text, '^(static )?int \w+\(')),
seen(entry, file, name, depth) USING KEY (entry, file, name) AS (
  SELECT entry, file, entry, CAST(0 AS BIGINT) FROM roots
  UNION SELECT DISTINCT s.entry, s.file, adj.callee, s.depth + 1 FROM seen s JOIN adj ON adj.caller = s.name
        LEFT JOIN recurring.seen r ON r.entry = s.entry AND r.file = s.file AND r.name = adj.callee WHERE r.name IS NULL)
SELECT a.entry, a.file, a.depth + 1 AS depth, caller, callee, b.depth <= a.depth AS again
FROM seen a JOIN adj ON adj.caller = a.name JOIN seen b ON b.entry = a.entry AND b.file = a.file AND b.name = callee""")
def entry_flows(spark, folder):
    files = code(spark, folder, "c")
    roots = op.entry_roots(files, "c")
    return op.entry_flows(op.call_graph(op.call_edges_c(files)), roots)


GROUPS = ", ".join(f"('{fn}', '{g}')" for g, names in API_GROUPS.items() for fn in names)
API = C("c") + rf"""
, g AS (SELECT * FROM (VALUES {GROUPS}) AS t(function, grp)),
h AS (SELECT path AS file, line, unnest(regexp_extract_all(text, '\b\w+\s*\([^)]*\)')) AS hit FROM l),
a AS (SELECT function, file, line, replace(regexp_extract(hit, '\((.*)\)', 1), ', ', ',') AS args, grp AS "group"
      FROM h JOIN g ON g.function = regexp_extract(hit, '^(\w+)', 1))
"""


def _calls(spark, folder):
    return op.api_calls(code(spark, folder, "c"), "c")


def _shown(calls):
    return calls.select("function", "file", "line", F.array_join("args", ",").alias("args"), "group")


@query("api_calls", API + "SELECT * FROM a")
def api_calls(spark, folder):
    return _shown(_calls(spark, folder))


@query("api_calls_python", C("python") + r"""
SELECT 'hid_open' AS function, path AS file, line, 'a,' || regexp_extract(text, ', (\d+)\)', 1) AS args, 'hidapi' AS "group" FROM l WHERE text LIKE '    hid_open(%'""")
def api_calls_python(spark, folder):
    return _shown(op.api_calls(code(spark, folder, "python"), "python"))


@query("api_by_group", API + """
SELECT "group", function, count(*) AS sites, count(DISTINCT file) AS files FROM a GROUP BY ALL""")
def api_by_group(spark, folder):
    return op.api_by_group(_calls(spark, folder))


@query("api_by_file", API + """
SELECT file, "group", count(*) AS sites, min(line) AS first_line FROM a GROUP BY ALL""")
def api_by_file(spark, folder):
    return op.api_by_file(_calls(spark, folder))


@query("api_summary", API + 'SELECT "group", count(*) AS calls FROM a GROUP BY ALL')
def api_summary(spark, folder):
    return op.api_summary(_calls(spark, folder))


CS_EDGES = _line_check("csharp", CS_DEF, f"regexp_extract(text, '{CS_DEF}', 1)")


@query("api_unknown", f"""
SELECT * FROM ({CS_EDGES}) WHERE callee NOT IN (SELECT function FROM (VALUES {GROUPS}) AS t(function, grp))
  AND ((length(callee) > 3 AND regexp_matches(callee, '^[A-Z][a-z]')) OR regexp_matches(callee, '^(nfc_|hid_|usb_|scard|win32|ctypes)'))""")
def api_unknown(spark, folder):
    return op.api_unknown(op.call_edges_line(code(spark, folder, "csharp"), "csharp")).drop("pos")


@query("report_api_calls", API + """
SELECT "group", file, line, function, CAST(row_number() OVER (PARTITION BY "group" ORDER BY file, line, function) AS INTEGER) AS rank,
       greatest(count(*) OVER (PARTITION BY "group") - 20, 0) AS more FROM a QUALIFY rank <= 20""")
def report_api_calls(spark, folder):
    sites = _calls(spark, folder).select("group", "file", "line", "function")
    return code_structure.head_per_group(sites, ["group"], 20, "file", "line", "function")


@query("report_external_calls", EDGES_C + HITS + """
SELECT caller, callee, line, location FROM e WHERE callee IN (FROM hit)
   OR (regexp_matches(callee, '^[A-Z]') AND upper(callee) <> callee) OR regexp_matches(callee, '^(Sc|Win|Nfc|Usb)')
ORDER BY location, line, caller, callee LIMIT 50""")
def report_external_calls(spark, folder):
    return external_calls(spark, folder).orderBy("location", "line", "caller", "callee").limit(50)
