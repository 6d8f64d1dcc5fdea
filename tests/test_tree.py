"""Whole trees: the parser follows the primary language, and the contents are read once."""

import pytest

from plumbline.operators import code_calls as calls
from plumbline.operators import code_structure as st
from plumbline.operators import code_tree as tree

C = "#include <a.h>\nstruct S {\n};\nstatic int run(int a) {\n  if (a > 1) { hid_open(a, 2); }\n  return other(a);\n}\nint last(int b) {\n  return run(b);\n}\n"
PY = "import os\n\ndef top(a):\n  return hid_open(a, 1)\n\nclass K(B):\n  def m(self):\n    return top(self)\n"
JS = "import \"x\"\nfunction load(a) {\n  fetch(a)\n}\n"
CS = "using A.B;\npublic class T {\n  public int Calc(int a) { return Help(a); }\n  static void Main(string[] x) { Calc(1); }\n}\n"
GO = "func Serve(a int) {\n  Stop(a)\n}\n"
FILES = {"a.c": C, "b.h": C, "p.py": PY, "bad.py": "def broken(:\n  f(x)\n", "w.js": JS, "t.cs": CS, "s.go": GO, "empty.c": "", "notes.txt": "run(1) {"}
LEADS = {"python": {f"q{i}.py": PY for i in range(4)}, "c": {f"q{i}.c": C for i in range(4)}, "js": {f"q{i}.js": JS for i in range(4)}, "csharp": {f"q{i}.cs": CS for i in range(4)}}
TEXT_LEADS = ("c", "js", "csharp")
OWN = {"python": (".py",), "c": (".c", ".h"), "js": (".js",), "csharp": (".cs",)}


def by_parts(files, lead, corpus, own, other):
    """Each file by the operators of one parser."""
    mine = {p: c for p, c in files.items() if p.endswith(OWN[lead])}
    rest = {p: c for p, c in files.items() if p not in mine and not p.endswith(".txt")}
    return own(corpus(mine)).unionByName(other(corpus(rest)))


@pytest.mark.parametrize("lead", list(LEADS))
def test_like_the_parsers_one_by_one(corpus, rows, lead):
    files = FILES | LEADS[lead]
    found = tree.tree_files(corpus(files))
    shown = ["path", "kind", "name", "line", "args", "bases"]
    want = by_parts(files, lead, corpus, lambda f: st.symbols(f, lead), lambda f: st.symbols(f, "generic"))
    assert rows(tree.tree_symbols(found).select(*shown)) == rows(want.select(*shown))
    want = by_parts(files, lead, corpus, lambda f: calls.call_edges(f, lead), lambda f: calls.call_edges(f, "generic"))
    assert rows(tree.tree_call_edges(found).drop("pos")) == rows(want.drop("pos"))
    want = by_parts(files, lead, corpus, lambda f: calls.api_calls(f, lead), lambda f: calls.api_calls(f, "c"))
    assert rows(tree.tree_api_calls(found).drop("pos")) == rows(want.drop("pos"))
    want = by_parts(files, lead, corpus, lambda f: st.modules(f, lead), lambda f: st.modules(f, "generic"))
    assert rows(tree.tree_modules(found)) == rows(want)
    assert rows(tree.tree_public_api(found)) == rows(st.public_api(tree.tree_symbols(found)))
    assert rows(tree.tree_rejects(found)) == ([("bad.py", "syntax error")] if lead == "python" else [])


@pytest.mark.parametrize("lead", ["python", "c"])
def test_contents_are_read_once(spark, tmp_path, lead, corpus):
    corpus(FILES | LEADS[lead]).repartition(3).write.parquet(str(tmp_path / "files"))
    found = tree.tree_files(spark.read.parquet(str(tmp_path / "files")))
    for made in (tree.tree_symbols(found), tree.tree_modules(found), tree.tree_call_edges(found), tree.tree_api_calls(found), tree.tree_public_api(found)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1 and plan.count("MapInPandas") == (lead == "python")


def test_only_symbols_are_shuffled(corpus):
    """The rows that are numbered are symbols alone: no file has one more for what follows its last symbol."""
    found = tree.tree_files(corpus(FILES | LEADS["c"]))
    made = tree._symbol_rows(found, ())
    assert made.where("hit IS NULL").isEmpty() and made.count() == tree.tree_symbols(found).count() > 0


@pytest.mark.parametrize("lead", TEXT_LEADS)
def test_texts_with_the_mark_of_cuts_are_read_alike(corpus, rows, lead):
    """The mark set between matches may be in a text itself, next to a match or inside it."""
    marked = {p: c.replace("(a", "(\x01a") + "// \x01\n" for p, c in (FILES | LEADS[lead]).items() if not p.endswith(".py")}
    files, other = LEADS[lead] | marked, LEADS[lead] | {p: c.replace("\x01", "\x02") for p, c in marked.items()}
    got, want = (rows(tree.tree_symbols(tree.tree_files(corpus(f)))) for f in (files, other))
    assert len(got) > 10 and str(got).replace("x01", "x02") == str(want)


def test_empty_tree(corpus):
    found = tree.tree_files(corpus({"notes.txt": "x"}))
    assert tree.tree_modules(found).count() == tree.tree_call_edges(found).count() == tree.tree_rejects(found).count() == 0
