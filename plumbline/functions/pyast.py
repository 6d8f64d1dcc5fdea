"""Python sources through the standard ``ast`` module: one Arrow-batched job for all readers of it.

No walk recurses. A file that the parser itself refuses for its depth is read block by block, a block being a top-level
statement, so that only the blocks that are too deep are left to be read as text.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = """
  path string, parsed boolean, problem string, source string,
  imports array<struct<module:string,names:array<string>,line:bigint>>,
  classes array<struct<name:string,line:bigint,bases:array<string>,
    methods:array<struct<name:string,line:bigint,args:array<string>,decorators:array<string>>>>>,
  functions array<struct<name:string,line:bigint,args:array<string>,decorators:array<string>>>,
  calls array<struct<caller:string,callee:string,line:bigint,args:array<string>>>
"""

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def dotted(node: ast.AST) -> str:
    names: list[str] = []
    while True:
        if isinstance(node, ast.Call):
            node = node.func
        elif isinstance(node, ast.Attribute):
            names.append(node.attr)
            node = node.value
        else:
            return ".".join([node.id if isinstance(node, ast.Name) else "?", *reversed(names)])


def base_name(node: ast.AST) -> str:
    return "?" if isinstance(node, ast.Call) else dotted(node)


def signature(node: ast.FunctionDef) -> dict:
    return {"name": node.name, "line": node.lineno, "args": [a.arg for a in node.args.args],
            "decorators": [dotted(d) for d in node.decorator_list]}


def written(node: ast.AST, source: str) -> str:
    """An expression in plain form; as it stands in the source where it is too deep to be written out."""
    try:
        return ast.unparse(node)
    except RecursionError:
        return ast.get_source_segment(source, node) or "?"


# Kinds of nodes below which nothing is looked for.
LEAVES = frozenset([ast.Name, ast.Constant, ast.alias, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal, *(
    kind for base in (ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop) for kind in base.__subclasses__())])
IMPORTS = (ast.Import, ast.ImportFrom)
WANTED = (ast.Call, ast.ClassDef, *FUNCTIONS, *IMPORTS)


def wanted_nodes(tree: ast.AST) -> list[tuple[int, ast.AST, str | None]]:
    """(depth, node, innermost function above) of calls, definitions and imports in source order, in one walk of the tree."""
    found, stack = [], [(0, tree, None)]
    while stack:
        depth, node, inside = stack.pop()
        kind = type(node)
        if kind in WANTED:
            found.append((depth, node, inside))
            if kind in FUNCTIONS:
                inside = node.name
        below = []
        for name in kind._fields:
            value = getattr(node, name, None)
            if type(value) is list:
                below += [(depth + 1, v, inside) for v in value if isinstance(v, ast.AST) and type(v) not in LEAVES]
            elif isinstance(value, ast.AST) and type(value) not in LEAVES:
                below.append((depth + 1, value, inside))
        below.reverse()
        stack += below
    return found


def call(node: ast.Call, inside: str | None, wanted_args: frozenset[str], source: str) -> dict | None:
    """A call of a name; arguments only for wanted names."""
    callee = getattr(node.func, "id", None) or getattr(node.func, "attr", None)
    if callee:
        return {"caller": inside, "callee": callee, "line": node.lineno,
                "args": [written(a, source) for a in node.args] if callee in wanted_args else []}


def describe(source: str, wanted_args: frozenset[str]) -> dict:
    """Calls in source order with their innermost function, all else level by level."""
    found = wanted_nodes(ast.parse(source))
    calls = [call(n, inside, wanted_args, source) for _, n, inside in found if type(n) is ast.Call]
    nodes = [n for _, n, _ in sorted(found, key=lambda f: f[0]) if type(n) is not ast.Call]
    types = [n for n in nodes if type(n) is ast.ClassDef]
    methods = {id(m) for c in types for m in c.body}
    return {
        "imports": [{"module": getattr(n, "module", None) or "", "names": [a.name for a in n.names], "line": n.lineno}
                    for n in nodes if type(n) in IMPORTS],
        "classes": [{"name": c.name, "line": c.lineno, "bases": [base_name(b) for b in c.bases],
                     "methods": [signature(m) for m in c.body if type(m) is ast.FunctionDef]} for c in types],
        "functions": [signature(n) for n in nodes if type(n) is ast.FunctionDef and id(n) not in methods],
        "calls": [c for c in calls if c],
    }


FIELDS = ("imports", "classes", "functions", "calls")
# A line that starts a top-level statement, decorators and clauses of one being part of it.
_TOP = re.compile(r"^(?=[^\s#)\]}])(?!(?:elif|else|except|finally)\b)", re.MULTILINE)


def describe_blocks(source: str, wanted_args: frozenset[str]) -> tuple[dict, str]:
    """What the top-level blocks that parse tell, and the source with those blocks blanked, its lines in place."""
    starts = [m.start() for m in _TOP.finditer(source)]
    starts = [at for i, at in enumerate(starts) if not (i and source[starts[i - 1]] == "@")]  # decorators stay with what they decorate
    found: dict[str, list] = {f: [] for f in FIELDS}
    left, line = [source[:starts[0]] if starts else source], 0
    line = left[0].count("\n")
    for at, end in zip(starts, [*starts[1:], len(source)]):
        block = source[at:end]
        try:
            part = describe(block, wanted_args)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            left.append(block)
        else:
            for field in FIELDS:
                for row in part[field]:
                    row["line"] += line
                    for method in row.get("methods", ()):
                        method["line"] += line
                    found[field].append(row)
            left.append("\n" * block.count("\n"))
        line += block.count("\n")
    return found, "".join(left)


def describe_one(source: str, wanted_args: frozenset[str]) -> dict:
    """The facts of one file; ``source`` is what has to be read as text, null for nothing."""
    nothing = {f: [] for f in FIELDS}
    try:
        return {"parsed": True, "problem": None, "source": None, **describe(source, wanted_args)}
    except SyntaxError:
        return {"parsed": False, "problem": "syntax error", "source": source, **nothing}
    except ValueError:  # null characters
        return {"parsed": False, "problem": "null character", "source": source, **nothing}
    except (RecursionError, MemoryError):
        found, left = describe_blocks(source, wanted_args)
        return {"parsed": False, "problem": "nested too deeply", "source": left, **found}


def describe_files(corpus: DataFrame, wanted_args: tuple[str, ...], *, keep: tuple[str, ...] = (), only: str | None = None) -> DataFrame:
    """One row per file; ``problem`` tells why it isn't read as a whole, and ``source`` is then what is left to be read as text.

    With ``only``, a boolean column, the other files have a null ``parsed`` and all their text in ``source``.
    """
    wanted = frozenset(wanted_args)
    kept = ", ".join(f"`{c}` {t}" for c, t in corpus.select(*keep).dtypes) if keep else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            flags = batch[only] if only else [True] * len(batch)
            other = {"parsed": None, "problem": None, **{f: [] for f in FIELDS}}
            rows = [describe_one(content, wanted) if own else {**other, "source": content} for content, own in zip(batch["content"], flags)]
            out = pd.DataFrame(rows, columns=["parsed", "problem", "source", *FIELDS])
            out.insert(0, "path", batch["path"].to_numpy())
            for column in keep:
                out[column] = batch[column].to_numpy()
            yield out

    schema = SCHEMA + (f", {kept}" if kept else "")
    return corpus.select("path", "content", *keep, *[only] * bool(only and only not in keep)).mapInPandas(run, schema)
