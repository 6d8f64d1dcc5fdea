import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import code_calls as calls
from plumbline.operators import code_decisions as dec
from plumbline.operators import code_structure as st

C = """#include <a.h>
#include   "b/c.h" // two
#define MAX_N 4
struct dev_t
{
  int fd;
};
static inline int
open_dev(const char *name,
         int flags)
{
  if (flags) { log_it(name); }
  return real_open(name,
      more(flags));
}
int proto(int a);
int close_dev(int fd) {
  close_dev(fd); sizeof(fd);
  return shut(fd);
}
"""


def names(df, kind):
    return [(r["name"], r["line"]) for r in df.where(f"kind = '{kind}'").orderBy("ordinal").collect()]


def test_c_symbols(corpus):
    df = st.symbols(corpus({"a.c": C}), "c").cache()
    assert names(df, "function") == [("open_dev", 8), ("proto", 16), ("close_dev", 17)]
    assert names(df, "import") == [("a.h", 1), ("b/c.h", 2)]
    assert names(df, "class") == [("dev_t", 4)] and names(df, "define") == [("MAX_N", None)]
    assert [r["args"] for r in df.where("name = 'open_dev'").collect()] == [["const char *name", "int flags"]]


def test_c_calls_run_to_the_end_of_the_next_head(corpus):
    got = [(r["caller"], r["callee"], r["line"]) for r in calls.call_edges_c(corpus({"a.c": C})).orderBy("line", "pos").collect()]
    assert got == [("if", "log_it", 12), ("if", "real_open", 13), ("if", "more", 14), ("if", "proto", 16), ("if", "close_dev", 17), ("close_dev", "shut", 19)]


def test_lone_carriage_returns_count_for_includes_only(corpus):
    df = st.symbols(corpus({"a.c": "x\r#include <a>\nint f(int a);\n"}), "c")
    assert names(df, "import") == [("a", 2)] and names(df, "function") == [("f", 2)]


JS = """import "x"
const y = require('y')
class A extends B {}
class C {}
export async function load(a, b) {
  fetch(a); if (b) { draw(b) }
}
const go = async (u) => {
  load(u)
}
let plain = 1
"""


def test_js(corpus):
    df = st.symbols(corpus({"a.js": JS}), "js").cache()
    assert names(df, "function") == [("load", 5), ("go", 8)] and names(df, "import") == [("x", None), ("y", None)]
    assert [(r["name"], r["bases"]) for r in df.where("kind = 'class'").orderBy("ordinal").collect()] == [("A", ["B"]), ("C", [])]
    edges = [(r["caller"], r["callee"], r["line"]) for r in calls.call_edges_line(corpus({"a.js": JS}), "js").orderBy("line", "pos").collect()]
    assert edges == [("load", "fetch", 6), ("load", "draw", 6), ("go", "async", 8), ("go", "load", 9)]


def test_csharp(corpus):
    text = "using System.IO;\npublic sealed class T {\n  // Run\n  public int Run(int a, string b) { return Help(a); }\n  static void Main(string[] x) { Run(1, null); }\n}\n"
    files = corpus({"t.cs": text})
    df = st.symbols(files, "csharp").cache()
    assert names(df, "function") == [("Run", 3), ("Main", 5)] and names(df, "class") == [("T", None)] and names(df, "import") == [("System.IO", None)]
    assert st.entry_points(st.module_heads(files, "csharp")).count() == 1
    edges = [(r["caller"], r["callee"]) for r in calls.call_edges_line(files, "csharp").orderBy("line", "pos").collect()]
    assert edges == [("Run", "Help"), ("Main", "Run")]


def test_generic_names_once(corpus):
    df = st.symbols(corpus({"a.go": "func A(x\n int) {\n}\nfunc B() {\n}\nfunc A() {\n}\n"}), "generic")
    assert names(df, "function") == [("A", 1), ("B", 4)]


PY = '''import os, sys
from pkg.m import a as b

@deco(1)
def top(x, y=1, *z):
    def inner():
        return deep(x)
    obj.send(inner())
    return lambda: hid_open(x, y + 1)

class K(base.B, C, make()):
    @staticmethod
    def run(self):
        return top(self)
    async def later(self):
        await wait()

async def loose():
    await top(1)

top(0)
'''


def test_python(corpus):
    files = corpus({"app.py": PY, "bad.py": "def broken(:\n  f(x)\ndef g(y):\n  h(y)\n", "nul.py": "a = 1\x00"})
    described = calls.described_files(files)
    df = st.symbols(described, "python").where("path = 'app.py'").cache()
    assert sorted(names(df, "function")) == [("inner", 6), ("top", 5)]
    assert names(df, "import") == [("", 1), ("pkg.m", 2)]
    assert [(r["name"], r["bases"], r["args"]) for r in df.where("kind = 'class'").collect()] == [("K", ["base.B", "C", "?"], ["run"])]
    edges = [(r["caller"], r["callee"], r["line"]) for r in calls.call_edges_python(described).where("location = 'app.py'").orderBy("pos").collect()]
    assert sorted(edges) == sorted([("top", "deco", 4), ("inner", "deep", 7), ("top", "send", 8), ("top", "inner", 8), ("top", "hid_open", 9),
                                    ("run", "top", 14), ("later", "wait", 16), ("loose", "top", 19)])
    assert [(r["caller"], r["callee"], r["line"]) for r in calls.call_edges_python(described).where("location = 'bad.py'").orderBy("line", "pos").collect()] == [("g", "h", 4)]
    assert [(r["function"], r["line"], r["args"], r["group"]) for r in calls.api_calls_python(described).collect()] == [("hid_open", 9, ["x", "y + 1"], "hidapi")]
    assert names(st.symbols(described, "python").where("path = 'bad.py'"), "function") == [("g", 3)]


def test_modules_keep_files_without_symbols(corpus, rows):
    got = st.modules(corpus({"a.c": C, "none.c": "/* nothing */\n", "main.c": "int main(void) {\n}\n"}), "c")
    assert rows(got.selectExpr("path", "is_entry_point", "line_count", "size(functions)", "size(imports)")) == [
        ("a.c", False, 20, 3, 2), ("main.c", True, 2, 1, 0), ("none.c", False, 1, 0, 0)]
    python = st.modules(corpus({"run.py": PY, "empty.py": ""}), "python")
    assert rows(python.selectExpr("path", "is_entry_point", "size(functions)", "size(classes)")) == [("empty.py", False, 0, 0), ("run.py", True, 2, 1)]


def test_languages(corpus, rows):
    files = corpus({"a/x.PY": "", "a/y.py": "", "b/z.c": "winscard\n", "b/pom.xml": "<x/>\n", "p.csproj": "", "Makefile": "APDU\n", ".py": "", "w.unknown": "\n\n"})
    assert [tuple(r)[:2] for r in st.language_counts(files).collect()] == [("Python", 2), ("C", 1)]
    assert {r[0] for r in st.build_systems(files).collect()} == {"Maven/Java", "MSBuild/C#", "Make"}
    assert rows(st.corpus_totals(files)) == [(3, 5)] and st.platform_infer(files).first()[0] == "Windows"
    assert {(r["path"], r["parser"]) for r in st.with_parser(files).collect()} == {("a/x.PY", "generic"), ("a/y.py", "python"), ("b/z.c", "generic")}
    assert rows(st.pattern_scan(files).select("pattern", "files")) == [("APDU", 1), ("winscard", 1)]
    assert ("a", "y.py", "file") in rows(st.dir_tree(files)) and ("", "a", "dir") in rows(st.dir_tree(files))


def test_flows_stop_at_cycles_and_depth(spark):
    edges = [("m", "a"), ("a", "b"), ("b", "a")] + [(f"n{i}", f"n{i + 1}") for i in range(12)]
    graph = spark.createDataFrame(edges, "caller string, callee string")
    roots = spark.createDataFrame([("m", "f"), ("n0", "f"), ("leaf", "f")], "entry string, file string")
    got = [tuple(r) for r in calls.entry_flows(graph, roots, max_depth=6).collect()]
    assert sorted(r[2:] for r in got if r[0] == "m") == [(1, "m", "a", False), (2, "a", "b", False), (3, "b", "a", True)]
    assert max(r[2] for r in got if r[0] == "n0") == 7 and not [r for r in got if r[0] == "leaf"]
    assert max(r["depth"] for r in calls.entry_flows(graph, roots).collect()) == 12
    assert calls.entry_flows(graph, roots.where("false")).count() == calls.entry_flows(graph, roots.where("entry = 'leaf'")).count() == 0


def test_a_hub_of_calls_stays_linear(spark):
    names = [f"h{i}" for i in range(1000)]
    edges = [("m", n) for n in names] + [(n, "log") for n in names] + [("log", n) for n in names]
    graph = spark.createDataFrame(edges, "caller string, callee string")
    roots = spark.createDataFrame([("m", f"f{i}") for i in range(7)], "entry string, file string")
    assert calls.entry_flows(graph, roots).count() == 7 * 3000


def test_all_entry_modules_are_looked_into(corpus):
    files = corpus({f"{i}.c": f"int start_{i}(void) {{\n  int main(void) {{\n}}\n" for i in range(9)})
    assert calls.entry_roots(files, "c").select("file").distinct().count() == 9
    assert calls.entry_roots(files, "c", k=2).select("file").distinct().count() == 2


def test_external(spark, rows):
    edges = spark.createDataFrame([("f", c, 1, "x") for c in ("CreateFile", "LIMIT", "WinX", "Scan", "libusb", "plain", "Übung")], "caller string, callee string, line bigint, location string")
    found = spark.createDataFrame([("libusb",)], "pattern string")
    assert [r[0] for r in rows(calls.external_calls(edges, found))] == ["CreateFile", "Scan", "WinX", "libusb", "Übung"]


def test_api_arguments(corpus, rows):
    files = corpus({"a.c": "x = SCardConnect( ctx , 1,, y );\nfoo(CloseHandle(h));\n  ReadFile (f)"})
    assert rows(calls.api_calls_by_text(files).select("function", "line", "args")) == [("ReadFile", 3, ["f"]), ("SCardConnect", 1, ["ctx", "1", "y"])]


DECISIONS = """// TODO check this
x = 1; # fixme : later
/* nothing */
  BYTE cmd[] = {
    0xFF, 0xCA, 0x00,
    0x01 };
a = 0xDEADBEEF + 0x12 + 12345; // wait = 5
// id 0xFFFFFF in a comment
timeout: 30, retries = 3
Thread t; mutex m;
lock(m); thread.run();
await lock;
SCardConnect(c, SCARD_SHARE_SHARED, SCARD_S_SUCCESS, SCARD_LEAVE_CARD);
if (r == SCARD_S_SUCCESS) {}
char small[] = { 0x01, 0x02 };
byte one[] = {
byte two[] = { 0x01,0x02,0x03,
0x04,0x05 }
byte open_ended[] = { 0x01,0x02,0x03,0x04,
"""


def test_decisions(corpus):
    got = {(r["kind"], r["line"], r["description"]) for r in dec.decisions(corpus({"a.c": DECISIONS})).collect()}
    run = "Hardcoded byte sequence (possible APDU or device command)"
    assert got == {
        ("comment", 1, "TODO: check this"), ("comment", 2, "fixme: later"),
        ("protocol", 5, run), ("protocol", 15, run),
        ("protocol", 17, run), ("protocol", 18, run), ("protocol", 19, run),
        ("constant", 7, "Hardcoded hex constant: 0xDEADBEEF"),
        ("constant", 7, "Timing decision: a = 0xDEADBEEF + 0x12 + 12345; // wait = 5"),
        ("constant", 9, "Timing decision: timeout: 30, retries = 3"), ("constant", 9, "Retry/attempt limit: timeout: 30, retries = 3"),
        ("threading", 10, "Concurrency/threading: thread"), ("threading", 11, "Concurrency/threading: lock"),
        ("threading", 12, "Concurrency/threading: await"),
        ("protocol", 13, "PC/SC share mode choice: SCARD_SHARE_SHARED — affects multi-app access"),
        ("protocol", 13, "PC/SC card disposition on disconnect: SCARD_LEAVE_CARD — affects card state"),
        ("protocol", 13, "PC/SC constant usage: SCARD_SHARE_SHARED"),
        ("protocol", 4, "Byte array (4 bytes): 0xFF 0xCA 0x00 0x01"),
        ("protocol", 17, "Byte array (5 bytes): 0x01 0x02 0x03 0x04 0x05"),
    }


def test_critical_and_summary(spark):
    rows = spark.createDataFrame([("comment", "HACK: x"), ("comment", "hack: x"), ("comment", "TODO: x"), ("constant", "c"), ("threading", "t")], "kind string, description string")
    assert dec.critical(rows).count() == 2
    assert dec.summary(rows).first()[0] == "Found 5 decisions: 3 comment, 1 constant, 1 threading"


def test_head_per_group(spark, rows):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0)], "g string, n int")
    assert rows(st.head_per_group(df, ["g"], 2, "n")) == [("a", 0, 1, 3), ("a", 1, 2, 3), ("b", 0, 1, 0)]


def test_a_file_too_deep_to_parse_keeps_its_symbols(corpus, rows):
    deep = "import os\n@deco\ndef before(a):\n  return run(a)\n\ndef f():\n  return " + "-" * 60_000 + "g(1)\n\nclass K(B):\n  def m(self):\n    hid_open(self)\n"
    files = corpus({"deep.py": deep, "bad.py": "def (:\n", "good.py": "def g():\n  pass\n", "nul.py": "x = 1\x00"})
    described = calls.described_files(files)
    found = dict(rows(st.python_rejects(described)))
    assert found.pop("nul.py") in ("null character", "syntax error")  # by Python version
    assert found == {"bad.py": "syntax error", "deep.py": "nested too deeply"}
    own = st.symbols(described, "python").where("path = 'deep.py'").cache()
    assert sorted(names(own, "function")) == [("before", 3), ("f", 6)] and names(own, "class") == [("K", 9)] and names(own, "import") == [("", 1)]
    edges = {(r["caller"], r["callee"], r["line"]) for r in calls.call_edges_python(described).where("location = 'deep.py'").collect()}
    assert edges == {("before", "run", 4), ("f", "g", 7), ("m", "hid_open", 11)}
    assert [(r["function"], r["line"]) for r in calls.api_calls_python(described).where("file = 'deep.py'").collect()] == [("hid_open", 11)]


def test_long_chains_of_names_and_calls(corpus):
    text = "x = " + ".".join(["a"] * 900) + ".go()\nhid_open(" + "+".join(["1"] * 900) + ")\n"
    [row] = st.describe_python(corpus({"chain.py": text})).collect()
    assert row["parsed"] and [c["callee"] for c in row["calls"]] == ["go", "hid_open"]


def test_one_walk_of_a_syntax_tree(monkeypatch):
    """Definitions and imports come level by level, calls in source order, from one walk that leaves names and values out."""
    import ast

    from plumbline.functions import pyast

    source = "def f(a=g(1)):\n  import x, y\n  class D(B(), p.Q):\n    @deco(h())\n    async def m(self): return k(n.o(2))(3)\n    def l(self, b): pass\n" \
             "from . import z\nclass C:\n  def r(self):\n    def inner(): return [u(v) for v in w() if t]\nf(lambda: e())\n"
    nodes = list(ast.walk(ast.parse(source)))
    visited = []
    monkeypatch.setattr(ast, "walk", lambda tree: visited.append(tree) or [])
    got = pyast.describe(source, frozenset("gu"))
    assert not visited
    assert [c["name"] for c in got["classes"]] == [n.name for n in nodes if isinstance(n, ast.ClassDef)] == ["C", "D"]
    assert [f["name"] for f in got["functions"]] == ["f", "inner"] and [i["line"] for i in got["imports"]] == [7, 2]
    assert [(c["caller"], c["callee"], c["args"]) for c in got["calls"]] == [
        ("f", "g", ["1"]), ("f", "B", []), ("m", "k", []), ("m", "o", []), ("m", "deco", []), ("m", "h", []), ("inner", "u", ["v"]), ("inner", "w", []),
        (None, "f", []), (None, "e", [])]


def test_most_lines_meet_no_pattern(spark, corpus, rows):
    """Signs tell lines apart before patterns do, folded letters and declarations over files included; kept lines are those that tell anything."""
    from plumbline.operators import code_decisions as cd

    files = corpus({"a.c": "TIMEOUT : 7\nſemaphore x;\nwait=3 0xABCDEF\nK LOCK\n}", "b.c": "int x; }\n0xAA, 0xBB, 0xCC\n" * 9,
                    "c.c": "char" + "\n" * 30000 + "b\nBYTE b[] = {0x01,\n0x02, 0x03, 0x04 };"})
    lines = cd.scan_lines(files)
    assert rows(lines.where("token IS NOT NULL").select("file", "line", "token")) == [("a.c", 2, "ſemaphore"), ("a.c", 4, "lock")]
    assert lines.where("file = 'b.c' AND (starts OR ends OR size(bytes) > 0)").isEmpty()
    got = {(r["file"], r["line"], r["description"]) for r in cd.decisions(files).where("file <> 'b.c'").collect()}
    assert got == {("a.c", 1, "Timing decision: TIMEOUT : 7"), ("a.c", 2, "Concurrency/threading: ſemaphore"), ("a.c", 4, "Concurrency/threading: lock"),
                   ("a.c", 3, "Timing decision: wait=3 0xABCDEF"), ("a.c", 3, "Hardcoded hex constant: 0xABCDEF"),
                   ("c.c", 30002, "Byte array (4 bytes): 0x01 0x02 0x03 0x04"), ("c.c", 30003, cd.BYTE_RUN_TEXT)}


def test_an_entry_name_of_many_files_is_walked_once(spark, tmp_path, monkeypatch):
    """What is written for the walk doesn't grow with the files that have an entry of one name; the flow is listed for each of them."""
    seen = []
    monkeypatch.setattr(calls, "scratch_dir", lambda spark, label: seen.append(f"{tmp_path}/{label}") or seen[-1])
    graph = spark.createDataFrame([("main", "a"), ("a", "b"), ("b", "a")], "caller string, callee string")
    roots = spark.range(300).selectExpr("'main' AS entry", "concat(id, '.c') AS file")
    got = calls.entry_flows(graph, roots)
    assert got.count() == 900 and got.where("file = '7.c'").count() == 3 and got.where("again").count() == 300
    assert spark.read.parquet(f"{seen[0]}/steps").count() == 3 and spark.read.parquet(f"{seen[0]}/reached").count() == 3


def test_entries_with_a_flow_in_common_share_its_rows(spark, tmp_path, monkeypatch):
    """What is written for the walk doesn't grow with the product of entries and the steps they have in common; all of these are listed."""
    seen = []
    monkeypatch.setattr(calls, "scratch_dir", lambda spark, label: seen.append(f"{tmp_path}/{label}") or seen[-1])
    entries = spark.range(640).selectExpr("concat('e', id) AS entry", "concat(id, '.c') AS file")
    graph = entries.selectExpr("entry AS caller", "'hub' AS callee").unionByName(
        spark.range(200).selectExpr("'hub' AS caller", "concat('f', id) AS callee")).unionByName(
        spark.range(100).selectExpr("concat('f', id) AS caller", "concat('f', id + 100) AS callee"))
    got = calls.entry_flows(graph, entries)
    assert got.count() == 640 * 301 and got.where("again").count() == 640 * 100 and got.where("entry = 'e7' AND file = '7.c'").count() == 301
    blocks = 640 // calls.BLOCK + spark.sparkContext.defaultParallelism
    assert spark.read.parquet(f"{seen[0]}/steps").count() <= 640 + blocks * 300
    assert spark.read.parquet(f"{seen[0]}/reached").count() <= 640 + blocks * 201


@pytest.mark.parametrize("seed", range(4))
def test_flows_are_those_of_a_plain_walk(spark, monkeypatch, seed):
    """Cycles, calls of itself, entries that are called, entry names of one, few and many files, entries that call nothing; joins dealt out or not."""
    import random

    pick = random.Random(seed)
    names = [f"n{i}" for i in range(90)]
    edges = {(pick.choice(names), pick.choice(names)) for _ in range((40, 90, 130, 400)[seed])} | {(n, "log") for n in names[::3]}
    roots = {(n, f"{i}.c") for n in [*names, "none"] for i in range(pick.choice((1, 1, 1, 3, calls.BLOCK_FILES + 1)) if pick.random() < 0.9 else 0)}
    depth = (None, 2, None, 1)[seed]
    if seed % 2:
        monkeypatch.setattr(calls, "PAIRS_A_TASK", 10)
    want = set()
    for entry in {e for e, _ in roots}:
        level, at = {entry: 0}, 0
        front = [entry]
        while front and (depth is None or at <= depth):
            steps = [(a, b) for a, b in edges if a in front]
            fresh = {b for _, b in steps} - set(level)
            want |= {(entry, f, at + 1, a, b, b in level) for a, b in steps for e, f in roots if e == entry}
            at += 1
            level |= dict.fromkeys(fresh, at)
            front = fresh
    graph = spark.createDataFrame(sorted(edges), "caller string, callee string")
    got = [tuple(r) for r in calls.entry_flows(graph, spark.createDataFrame(sorted(roots), "entry string, file string"), max_depth=depth).collect()]
    assert len(got) == len(want) and set(got) == want


def test_words_are_found_by_a_pattern_of_their_beginnings(spark):
    words = ("hid_open", "hid_open_path", "hid_close", "Read", "a.b", "x-y]")
    pattern = text.any_of(words)
    lines = [*words, "", "zhid_openz", "hid_ope", "hid_clos", "hid_", "Rea", "aXb", "x-y", "a.", "öhid_close", "\n\nRead"]
    found = spark.createDataFrame([(x,) for x in lines], "text string").where(F.col("text").rlike(pattern)).collect()
    assert sorted(r["text"] for r in found) == sorted(x for x in lines if any(w in x for w in words))
    known = text.any_of(st.KNOWN_FUNCTIONS)
    assert all(re.search(known, f"  {n}(a)") for n in st.KNOWN_FUNCTIONS)
    assert known.count("Card(") == known.count("libusb_(") == 1  # names with one beginning are not tried one by one


def test_cuts_tell_groups_and_lines_with_or_without_the_mark(spark):
    content = ["f(1)\r\ng(2)\x0b", "", "none\n", "a\nb\u2028f(3)", None]
    rows = [(c,) for c in content] + [("\x01" + c if c is not None else None,) for c in content]
    df = spark.createDataFrame(rows, "t string").select(
        text.cut_at(F.col("t"), r"(\w)\((\d)\)|(q)", text.LINE_END, (1, 3)).alias("whole"), text.cut_at(F.col("t"), r"(\w)\((\d)\)|(q)", groups=(2,), tail=False).alias("hits"))
    got = [(None if r["whole"] is None else [tuple(z) for z in r["whole"]], None if r["hits"] is None else [tuple(z) for z in r["hits"]]) for r in df.collect()]
    want = [([(0, "f(1)", "f", ""), (1, "g(2)", "g", ""), (1, None, None, None)], [(0, "f(1)", "1"), (1, "g(2)", "2")]), ([(0, None, None, None)], []),
            ([(1, None, None, None)], []), ([(2, "f(3)", "f", ""), (0, None, None, None)], [(1, "f(3)", "3")]), (None, None)]
    assert got == want + want


def test_lines_are_stripped_by_their_kind(spark):
    """Most lines are trimmed of blanks alone, with the same result as of all white space."""
    lines = ["", " ", "  a b  ", "\ta\t ", " \x1fa \x1f", "\u3000a b\xa0 ", " \u2003", "\t", "ä ", " a\tb ", "a"]
    line = F.col("t")
    stripped = text.strip_line(line, F.octet_length(line) == F.length(line))
    got = spark.createDataFrame([(x,) for x in lines], "t string").select("t", stripped.alias("s"), text.strip(line).alias("w")).collect()
    assert all(r["s"] == r["w"] == r["t"].strip() for r in got) and len(got) == len(lines)
    assert spark.createDataFrame([("a.c", "x\n")], "path string, content string").transform(dec.scan_lines).where("size(found) > 0").isEmpty()
