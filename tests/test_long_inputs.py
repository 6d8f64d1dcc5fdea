"""Ordinary but long inputs: no pattern recurses or takes time that grows with the square of a file."""

import random
import re
import time

from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import code_calls, code_decisions, code_structure, policy

OLD_FUNCTION = re.compile(r"^(?:(?:static|extern|inline|virtual|WINAPI|STDCALL|__cdecl)\s+)*(?:[\w\*]+\s+)+(\w+)\s*\(([^)]*)\)\s*(?:const\s*)?(?:\{|;)", re.MULTILINE)
OLD_DEFINITION = re.compile(r"^[\w\*\s]+\s+(\w+)\s*\([^)]*\)\s*(?:const\s*)?\{", re.MULTILINE)


def test_long_files_end_soon(corpus):
    files = corpus({
        "words.c": "word " * 100_000,
        "bytes.c": "unsigned char icon[] = { " + "0x12, " * 100_000 + "};",
        "numbers.c": "\n".join(str(i) for i in range(100_000)) + "\nint main(void) {\n  go(1);\n}\n",
    })
    started = time.time()
    found = {(r.path, r["name"], r.line) for r in code_structure.symbols(files, "c").where("kind = 'function'").collect()}
    assert found == {("numbers.c", "main", 1)}
    edges = code_calls.call_edges_c(files).collect()
    assert [(e.caller, e.callee, e.line) for e in edges] == [("main", "go", 100_002)]
    kinds = [r.kind for r in code_decisions.decisions(files).where("file = 'bytes.c'").collect()]
    assert "protocol" in kinds
    assert time.time() - started < 90


def test_long_command(spark):
    commands = spark.createDataFrame([("git push " + "word " * 100_000 + "origin main",), ("git push " + "word " * 100_000,), ("git push origin main",)], "command string")
    got = [r.rule for r in commands.select(policy.first_matching_rule(F.col("command")).alias("rule")).collect()]
    assert got == ["GITOPS-001", None, "GITOPS-001"]


def test_patterns_match_as_plain_search(spark):
    """Random pieces of C: the same names, arguments and lines as a plain search gives."""
    rng = random.Random(4)
    pieces = ["int", "foo", " ", " ", "\n", "\n", "(", "(x)", "(void)", " {", ";", ");", "* ", "const ", "static ", "\t", "a1", "}", "\n ", "bar(int a,\n b)", " {\n"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 40)))) for i in range(600)]
    files = spark.createDataFrame([(f"{i:04d}.c", t) for i, t in rows], "path string, content string")
    got = {}
    for r in code_structure.symbols(files, "c").where("kind = 'function'").orderBy("path", "ordinal").collect():
        got.setdefault(r.path, []).append((r["name"], r.line))
    heads = files.select("path", F.regexp_extract_all(F.concat(F.lit("\n"), "content"), F.lit(code_calls.C_DEFINITION), F.lit(1)).alias("names"))
    names = {r.path: r.names for r in heads.collect()}
    keywords = ("if", "while", "for", "switch", "return")
    for i, t in rows:
        want = [(m[1], t.count("\n", 0, m.start()) + 1) for m in OLD_FUNCTION.finditer(t) if m[1] not in keywords]
        assert got.get(f"{i:04d}.c", []) == want, t
        assert names[f"{i:04d}.c"] == [m[1] for m in OLD_DEFINITION.finditer(t)], t


def test_twenty_thousand_classes_in_a_file(corpus):
    """First lines of all names come from one pass over the file."""
    structs = "".join(f"struct node_{i} {{\n  int a;\n}};\n" for i in range(20_000))
    started = time.perf_counter()
    found = code_structure.symbols(corpus({"a.c": structs}), "c").where("kind = 'class'")
    assert sum(r["line"] == 3 * r["ordinal"] + 1 for r in found.collect()) == 20_000
    methods = "class T {\n" + "".join(f"  public int Run{i}(int a) {{ return Run{i - 1}(a); }}\n" for i in range(20_000)) + "}\n"
    found = code_structure.symbols(corpus({"a.cs": methods}), "csharp").where("kind = 'function'")
    assert all(r["line"] >= 2 for r in found.collect()) and time.perf_counter() - started < 30


def test_first_lines_like_a_search_for_each():
    content = "ab\nabc b\n\nbca\r\nx é ab"
    names = ["ab", "b", "abc", "bca", "ca", "x", "é", "none", "", "ab", "\n"]
    assert text.lines_of(content, names) == [content[:content.find(n)].count("\n") + 1 if n in content else 0 for n in names]
