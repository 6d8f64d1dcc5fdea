"""Source files for the code queries, one per part and language.

No program text is among the tables, so it is written by a projection of ``part`` that both
engines can run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.bindings import TEXTS_A_TASK, document_files, spread, table


def _text(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


NL = "chr(10)"
K = "p_partkey"
TAG = "concat(CASE p_partkey % 5 WHEN 0 THEN 'TODO' WHEN 1 THEN 'fixme' WHEN 2 THEN 'HACK' WHEN 3 THEN 'note' ELSE 'BUG' END, ': ', p_name)"

# Paths put five directories under two roots; a few files have entry names.
C_PATH = "concat('src/m', p_partkey % 5, '/f_', p_partkey, CASE WHEN p_partkey % 4 = 3 THEN '.h' ELSE '.c' END)"
C_CONTENT = _text(
    "'#include <stdio.h>'", NL, "'#include \"dev_'", f"{K} % 7", "'.h\"'", NL,
    "'#define LIMIT_'", K, "' '", "p_size", NL, NL,
    "'struct dev_'", K, "' {'", NL, "'  int fd;'", NL, "'};'", NL, NL,
    "'static int f_'", K, "'(int a, char *b) {'", NL,
    f"'  // '", TAG, NL,
    "'  if (a > '", "p_size", "') { f_'", f"({K} * 7 + 1) % 2003", "'(a, b); }'", NL,
    f"CASE WHEN {K} % 3 = 0 THEN " + _text("'  SCardConnect(ctx, 0x'", "lpad('', 2, 'A')", f"1000 + {K} % 9000",
                                            "', SCARD_SHARE_SHARED);'", NL) + " ELSE '' END",
    f"CASE WHEN {K} % 5 = 1 THEN " + _text("'  timeout = '", "p_size", "'; max_retry: '", "p_size", NL) + " ELSE '' END",
    f"CASE WHEN {K} % 6 = 2 THEN " + _text("'  BYTE cmd[] = {'", NL, "'    0xFF, 0xCA,'", NL, "'    0x00, 0x'", f"10 + {K} % 80",
                                            "', 0x04 };'", NL) + " ELSE '' END",
    f"CASE WHEN {K} % 7 = 3 THEN " + _text("'  mutex_t m; lock(m); Thread t;'", NL, "'  wait(queue, lock);'", NL) + " ELSE '' END",
    f"CASE WHEN {K} % 9 = 4 THEN " + _text("'  SCardDisconnect(card, SCARD_UNPOWER_CARD);'", NL,
                                            "'  libusb_open(dev); DeviceIoControl(h, 0xDEADBEEF, n);'", NL) + " ELSE '' END",
    "'  return g_'", f"({K} * 11 + 3) % 2003", "'(a);'", NL, "'}'", NL, NL,
    "'int g_'", K, "'(int a);'", NL,
    "'int g_'", K, "'(int a) {'", NL,
    "'  WriteFile(a); return f_'", f"({K} * 11 + 3) % 2003", "'(a, 0);'", NL, "'}'", NL,
    f"CASE WHEN {K} % 40 = 0 THEN " + _text("'int main(int argc) {'", NL, "'  return f_'", K, "'(argc, 0);'", NL, "'}'", NL) + " ELSE '' END",
)

PY_PATH = "concat('app/m', p_partkey % 5, CASE WHEN p_partkey % 50 = 7 THEN concat('/d', p_partkey, '/main.py') ELSE concat('/mod_', p_partkey, '.py') END)"
PY_CONTENT = _text(
    "'import os, sys'", NL, "'from pkg.m'", f"{K} % 9", "' import a'", f"{K} % 4", NL, NL,
    f"CASE WHEN {K} % 17 = 5 THEN " + _text("'def broken(:'", NL) + " ELSE '' END",
    "'class C'", K, "'(base.B'", f"{K} % 6", "'):'", NL,
    "'    def run(self, x):'", NL, "'        return helper_'", f"({K} * 7 + 1) % 2003", "'(x)'", NL, NL,
    "'@deco'", NL, "'def helper_'", K, "'(a, b=1):'", NL,
    "'    obj.send(a)'", NL, "'    hid_open(a, '", "p_size", "')'", NL,
    "'    return helper_'", f"({K} * 11 + 3) % 2003", "'(b)'", NL, NL,
    "'def _private():'", NL, "'    pass'", NL,
    f"CASE WHEN {K} % 10 = 1 THEN " + _text("'if __name__ == \"__main__\":'", NL, "'    helper_'", K, "'(1)'", NL) + " ELSE '' END",
)

JS_PATH = "concat('web/m', p_partkey % 5, CASE WHEN p_partkey % 30 = 4 THEN concat('/d', p_partkey, '/index.js') ELSE concat('/w_', p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '.js' ELSE '.ts' END) END)"
JS_CONTENT = _text(
    "'import \"./lib'", f"{K} % 8", "'\"'", NL, "'const q = require(\"pkg'", f"{K} % 5", "'\")'", NL,
    "'class W'", K, f"CASE WHEN {K} % 2 = 0 THEN ' extends Base' ELSE '' END", "' {'", NL, "'}'", NL,
    "'export async function load_'", K, "'(a, b) {'", NL, "'  fetch_'", f"({K} * 7 + 1) % 2003", "'(a); if (b) { draw(b); }'", NL, "'}'", NL,
    "'const fetch_'", K, "' = async (u) => {'", NL, "'  return load_'", f"({K} * 11 + 3) % 2003", "'(u, typeof (u));'", NL, "'}'", NL,
)

CS_PATH = "concat('net/m', p_partkey % 5, '/T_', p_partkey, '.cs')"
CS_CONTENT = _text(
    "'using System;'", NL, "'using Lib.N'", f"{K} % 6", "';'", NL,
    "'public partial class T'", K, "' {'", NL,
    "'  private int Calc_'", K, "'(int a, string b) {'", NL, "'    return Calc_'", f"({K} * 7 + 1) % 2003", "'(a, nameof(b));'", NL, "'  }'", NL,
    f"CASE WHEN {K} % 20 = 3 THEN " + _text("'  static void Main(string[] args) {'", NL, "'    Calc_'", K, "'(1, null); Console.WriteLine(2);'", NL, "'  }'", NL) + " ELSE '' END",
    "'}'", NL,
)

GO_PATH = "concat('svc/m', p_partkey % 5, '/g_', p_partkey, '.go')"
GO_CONTENT = _text(
    "'package m'", NL, "'func Serve_'", K, "'(a int) {'", NL, "'  if (a > '", "p_size", "') { Stop_'", f"{K} % 50", "'(a) }'", NL,
    "'  Serve_'", f"({K} * 7 + 1) % 2003", "'(a)'", NL, "'}'", NL, "'func Stop_'", K, "'(a int) {'", NL, "'}'", NL,
)

LANGUAGES = {"c": (C_PATH, C_CONTENT), "python": (PY_PATH, PY_CONTENT), "js": (JS_PATH, JS_CONTENT),
             "csharp": (CS_PATH, CS_CONTENT), "generic": (GO_PATH, GO_CONTENT)}


def code(spark, folder: str, name: str) -> DataFrame:
    path, content = LANGUAGES[name]
    return spread(table(spark, folder, "part"), "p_partkey", TEXTS_A_TASK).selectExpr(f"{path} AS path", f"{content} AS content")


def code_sql(name: str) -> str:
    path, content = LANGUAGES[name]
    return f"SELECT {path} AS path, {content} AS content FROM part"


BUILD_NAME = """CASE p_partkey % 9 WHEN 0 THEN 'package.json' WHEN 1 THEN 'Makefile' WHEN 2 THEN 'go.mod' WHEN 3 THEN 'app.csproj'
  WHEN 4 THEN 'all.sln' WHEN 5 THEN 'pom.xml' WHEN 6 THEN 'makefile' WHEN 7 THEN 'Cargo.toml' ELSE 'README.md' END"""
BUILD_PATH = f"concat('build_', p_partkey, '/', {BUILD_NAME})"
BUILD_CONTENT = "concat('# ', p_name, chr(10), CASE WHEN p_partkey % 12 = 5 THEN 'uses libnfc and ACR122' ELSE '' END)"


def mixed(spark, folder: str) -> DataFrame:
    """C files, build files and documents in one tree; C is not the primary language here."""
    builds = table(spark, folder, "part").selectExpr(f"{BUILD_PATH} AS path", f"{BUILD_CONTENT} AS content")
    return code(spark, folder, "c").unionByName(builds).unionByName(document_files(spark, folder))


MIXED_SQL = f"""
{code_sql('c')} UNION ALL SELECT {BUILD_PATH}, {BUILD_CONTENT} FROM part
UNION ALL SELECT source || '/' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.c' WHEN 'fr' THEN '.js'
                 WHEN 'es' THEN '.cs' ELSE '.txt' END, text FROM documents"""


def tree(spark, folder: str, first: str) -> DataFrame:
    """Files of all languages and build files; C leads where it is also vendored, else Python does, which comes first by path."""
    files = table(spark, folder, "part").selectExpr(f"{BUILD_PATH} AS path", f"{BUILD_CONTENT} AS content")
    for name in LANGUAGES:
        files = files.unionByName(code(spark, folder, name))
    if first == "c":
        files = files.unionByName(code(spark, folder, "c").selectExpr("concat('vendor/', path) AS path", "content"))
    return files


def tree_sql(first: str) -> str:
    parts = [f"SELECT {BUILD_PATH} AS path, {BUILD_CONTENT} AS content FROM part", *map(code_sql, LANGUAGES)]
    if first == "c":
        parts.append(f"SELECT 'vendor/' || path, content FROM ({code_sql('c')})")
    return " UNION ALL ".join(parts)
