"""Structure queries over generated source files, build files and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import code_structure as op
from ..vocab import LANGUAGE_BY_EXTENSION, TECHNOLOGY_PATTERNS
from .code_corpus import MIXED_SQL, code, code_sql, mixed
from .registry import query

EXTENSIONS = ", ".join(f"('{e}', '{lang}')" for e, lang in LANGUAGE_BY_EXTENSION.items())
PATTERNS = ", ".join(f"('{p}', '{d}', '{c}')" for p, d, c in TECHNOLOGY_PATTERNS)
M = f"""
WITH x AS ({MIXED_SQL}),
e AS (SELECT * FROM (VALUES {EXTENSIONS}) AS t(ext, language)),
s AS (SELECT path, content, language FROM x JOIN e ON e.ext = lower(regexp_extract(path, '(\\.[^./]+)$', 1))),
pf AS (SELECT pattern, description, category, path FROM x, (VALUES {PATTERNS}) AS t(pattern, description, category)
       WHERE contains(content, pattern))
"""


def C(name: str) -> str:
    """Files of one generated language, and their numbered lines."""
    return f"""
WITH x AS ({code_sql(name)}),
l AS (SELECT path, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line, unnest(string_split(content, chr(10))) AS text FROM x)
"""


@query("language_counts", M + "SELECT language, count(*) AS files, min(path) AS first_path FROM s GROUP BY language")
def language_counts(spark, folder):
    return op.language_counts(mixed(spark, folder))


@query("primary_language", M + "SELECT language FROM s GROUP BY language ORDER BY count(*) DESC, min(path) LIMIT 1")
def primary_language(spark, folder):
    return op.primary_language(mixed(spark, folder))


@query("build_systems", M + """
SELECT DISTINCT CASE string_split(path, '/')[-1] WHEN 'package.json' THEN 'npm/Node.js' WHEN 'Makefile' THEN 'Make' WHEN 'go.mod' THEN 'Go modules'
  WHEN 'app.csproj' THEN 'MSBuild/C#' WHEN 'all.sln' THEN 'Visual Studio' WHEN 'pom.xml' THEN 'Maven/Java' WHEN 'Cargo.toml' THEN 'Cargo/Rust' END AS build_system
FROM x WHERE build_system IS NOT NULL""")
def build_systems(spark, folder):
    return op.build_systems(mixed(spark, folder))


@query("pattern_scan", M + """
SELECT pattern, description, category, count(*) AS files, min(path) AS first_path FROM pf GROUP BY ALL""")
def pattern_scan(spark, folder):
    return op.pattern_scan(mixed(spark, folder))


@query("pattern_files", M + "SELECT * FROM pf")
def pattern_files(spark, folder):
    return op.pattern_files(mixed(spark, folder))


@query("platform_infer", M + """
SELECT CASE WHEN bool_or(category IN ('winscard', 'winapi')) THEN 'Windows' WHEN bool_or(category = 'pcsc-linux') THEN 'Linux/Unix'
            WHEN bool_or(category = 'nfc') THEN 'Cross-platform NFC' ELSE 'Unknown' END AS platform FROM pf""")
def platform_infer(spark, folder):
    return op.platform_infer(mixed(spark, folder))


@query("corpus_totals", M + """
SELECT (SELECT count(*) FROM s) AS file_count,
       CAST((SELECT sum(length(content) - length(replace(content, chr(10), ''))) FROM x) AS BIGINT) AS total_lines""")
def corpus_totals(spark, folder):
    return op.corpus_totals(mixed(spark, folder))


@query("language_dispatch", M + """
, p AS (SELECT language FROM s GROUP BY language ORDER BY count(*) DESC, min(path) LIMIT 1)
SELECT path, (SELECT language FROM p) AS primary_language,
       CASE WHEN (SELECT language FROM p) = 'C' AND regexp_matches(path, '\\.[ch]$') THEN 'c'
            WHEN (SELECT language FROM p) = 'Python' AND path LIKE '%.py' THEN 'python' ELSE 'generic' END AS parser FROM s""")
def language_dispatch(spark, folder):
    return op.with_parser(mixed(spark, folder)).select("path", "primary_language", "parser")


def _flat(symbols):
    """Symbols with their lists as text, so that both engines show the same value."""
    return symbols.select("path", "kind", "name", "line", F.array_join("args", ",").alias("args"), F.array_join("bases", ",").alias("bases"))


@query("modules_c", C("c") + r"""
, fn AS (SELECT path, line, regexp_extract(text, '^(?:static\s+)?(?:[\w*]+\s+)+(\w+)\s*\(([^)]*)\)\s*[{;]', ['n', 'a']) AS m FROM l
         WHERE regexp_matches(text, '^(?:static\s+)?(?:[\w*]+\s+)+(\w+)\s*\(([^)]*)\)\s*[{;]'))
SELECT path, 'function' AS kind, m.n AS name, line, replace(m.a, ', ', ',') AS args, '' AS bases FROM fn WHERE m.n NOT IN ('if', 'while', 'for', 'switch', 'return')
UNION ALL SELECT path, 'import', regexp_extract(text, '#include\s*[<"]([^>"]+)', 1), line, '', '' FROM l WHERE text LIKE '#include%'
UNION ALL SELECT c.path, 'class', c.n, min(l.line), '', '' FROM (SELECT path, regexp_extract(text, 'struct (\w+)', 1) AS n FROM l WHERE text LIKE 'struct%{') c
          JOIN l ON l.path = c.path AND contains(l.text, c.n) GROUP BY c.path, c.n
UNION ALL SELECT path, 'define', regexp_extract(text, '#define (\w+)', 1), NULL, '', '' FROM l WHERE text LIKE '#define%'""")
def modules_c(spark, folder):
    return _flat(op.symbols(code(spark, folder, "c"), "c"))


@query("modules_js", C("js") + r"""
SELECT path, 'function' AS kind, regexp_extract(text, 'function (\w+)', 1) AS name, line, replace(regexp_extract(text, '\(([^)]*)\)', 1), ', ', ',') AS args, '' AS bases
FROM l WHERE text LIKE 'export%'
UNION ALL SELECT path, 'function', regexp_extract(text, 'const (\w+)', 1), line, '', '' FROM l WHERE text LIKE 'const fetch%'
UNION ALL SELECT path, 'import', regexp_extract(text, '"([^"]+)"', 1), NULL, '', '' FROM l WHERE text LIKE 'import%' OR text LIKE '%require(%'
UNION ALL SELECT path, 'class', regexp_extract(text, 'class (\w+)', 1), NULL, '', regexp_extract(text, 'extends (\w+)', 1) FROM l WHERE text LIKE 'class%'""")
def modules_js(spark, folder):
    return _flat(op.symbols(code(spark, folder, "js"), "js"))


@query("modules_csharp", C("csharp") + r"""
, t AS (SELECT path, regexp_extract(text, '(?:private int|static void) (\w+)\(([^)]*)\)', ['n', 'a']) AS m FROM l WHERE regexp_matches(text, '(private int|static void) '))
SELECT t.path, 'function' AS kind, m.n AS name, (SELECT min(l.line) FROM l WHERE l.path = t.path AND contains(l.text, t.m.n)) AS line,
       replace(m.a, ', ', ',') AS args, '' AS bases FROM t
UNION ALL SELECT path, 'import', regexp_extract(text, 'using ([\w.]+)', 1), NULL, '', '' FROM l WHERE text LIKE 'using%'
UNION ALL SELECT path, 'class', regexp_extract(text, 'class (\w+)', 1), NULL, '', '' FROM l WHERE text LIKE 'public%'""")
def modules_csharp(spark, folder):
    return _flat(op.symbols(code(spark, folder, "csharp"), "csharp"))


@query("modules_generic", C("generic") + r"""
SELECT path, 'function' AS kind, regexp_extract(text, '\b(\w+)\s*\([^)]*\)\s*[{:]', 1) AS name, min(line) AS line, '' AS args, '' AS bases
FROM l WHERE regexp_matches(text, '\b(\w+)\s*\([^)]*\)\s*[{:]') GROUP BY ALL""")
def modules_generic(spark, folder):
    return _flat(op.symbols(code(spark, folder, "generic"), "generic"))


PY = C("python") + r"""
, bad AS (SELECT DISTINCT path FROM l WHERE text LIKE 'def broken%'),
sym AS (
SELECT path, 'function' AS kind, regexp_extract(text, '^def (\w+)', 1) AS name, line, CASE WHEN text LIKE '%_private%' THEN '' ELSE 'a,b' END AS args, '' AS bases
FROM l WHERE text LIKE 'def %' AND path NOT IN (FROM bad)
UNION ALL SELECT path, 'class', regexp_extract(text, 'class (\w+)', 1), line, 'run', regexp_extract(text, '\((.*)\)', 1) FROM l WHERE text LIKE 'class %' AND path NOT IN (FROM bad)
UNION ALL SELECT path, 'import', regexp_extract(text, 'from ([\w.]+)', 1), line, CASE WHEN text LIKE 'import %' THEN 'os,sys' ELSE regexp_extract(text, ' import (\w+)', 1) END, '' FROM l
          WHERE (text LIKE 'import %' OR text LIKE 'from %') AND path NOT IN (FROM bad)
-- the unclosed bracket of the broken line runs into the class line that follows it
UNION ALL SELECT path, 'function', 'broken', line, '', '' FROM l WHERE text LIKE 'def broken%'
UNION ALL SELECT path, 'function', regexp_extract(text, '\b(\w+)\s*\([^)]*\)\s*[{:]', 1), min(line), '', '' FROM l
          WHERE regexp_matches(text, '\b(\w+)\s*\([^)]*\)\s*[{:]') AND text NOT LIKE 'class %' AND path IN (FROM bad) GROUP BY ALL)
"""


@query("modules_python", PY + "SELECT * FROM sym")
def modules_python(spark, folder):
    return _flat(op.symbols(code(spark, folder, "python"), "python"))


@query("modules", C("c") + r"""
SELECT path, 'C/C++' AS language, contains(content, 'main(') AS is_entry_point, CAST(length(content) - length(replace(content, chr(10), '')) AS BIGINT) AS line_count,
       2 AS imports, 1 AS classes, 3 + CASE WHEN contains(content, 'main(') THEN 1 ELSE 0 END AS functions, 1 AS defines FROM x""")
def modules(spark, folder):
    """The nested records, their lists shown by size."""
    rows = op.modules(code(spark, folder, "c"), "c")
    return rows.select("path", "language", "is_entry_point", "line_count",
                       *[F.size(c).alias(c) for c in ("imports", "classes", "functions", "defines")])


def _entry_check(name: str, condition: str) -> str:
    return f"SELECT path, '{name}' AS parser FROM ({code_sql(name)}) WHERE {condition}"


@query("entry_points", " UNION ALL ".join([
    _entry_check("c", "contains(content, 'main(')"),
    _entry_check("python", "contains(content, 'if __name__') OR path LIKE '%/main.py'"),
    _entry_check("js", "path LIKE '%/index.js'"),
    _entry_check("csharp", "contains(content, 'static void Main')"),
]))
def entry_points(spark, folder):
    found = None
    for parser in ("c", "python", "js", "csharp"):
        rows = op.entry_points(op.module_heads(code(spark, folder, parser), parser)).withColumn("parser", F.lit(parser))
        found = rows if found is None else found.unionByName(rows)
    return found


@query("public_api", PY + "SELECT name, kind, path AS location FROM sym WHERE kind = 'class' OR (kind = 'function' AND name NOT LIKE '\\_%' ESCAPE '\\')")
def public_api(spark, folder):
    return op.public_api(op.symbols(code(spark, folder, "python"), "python")).drop("ordinal")


@query("dir_tree", M + """
, p AS (SELECT string_split(path, '/') AS parts FROM x),
q AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM p)
SELECT DISTINCT array_to_string(parts[1:i - 1], '/') AS parent, parts[i] AS name, CASE WHEN i = len(parts) THEN 'file' ELSE 'dir' END AS kind FROM q""")
def dir_tree(spark, folder):
    return op.dir_tree(mixed(spark, folder))


@query("report_top_modules", C("c") + """
SELECT path, 'C/C++' AS language, CAST(length(content) - length(replace(content, chr(10), '')) AS BIGINT) AS line_count,
       CAST(1 AS BIGINT) AS classes, CAST(3 + CASE WHEN contains(content, 'main(') THEN 1 ELSE 0 END AS BIGINT) AS functions
FROM x ORDER BY line_count DESC, path LIMIT 30""")
def report_top_modules(spark, folder):
    return op.report_top_modules(code(spark, folder, "c"), "c")


@query("report_pattern_files", M + """
SELECT pattern, path, CAST(row_number() OVER (PARTITION BY pattern ORDER BY path) AS INTEGER) AS rank,
       greatest(count(*) OVER (PARTITION BY pattern) - 3, 0) AS more FROM pf QUALIFY rank <= 3""")
def report_pattern_files(spark, folder):
    files = op.pattern_files(mixed(spark, folder)).select("pattern", "path")
    return op.head_per_group(files, ["pattern"], 3, "path")


@query("report_public_api", PY + """
SELECT name, kind, path AS location FROM sym WHERE kind = 'class' OR (kind = 'function' AND name NOT LIKE '\\_%' ESCAPE '\\')
ORDER BY path, kind, name LIMIT 40""")
def report_public_api(spark, folder):
    rows = op.public_api(op.symbols(code(spark, folder, "python"), "python")).drop("ordinal")
    return rows.orderBy("location", "kind", "name").limit(40)
