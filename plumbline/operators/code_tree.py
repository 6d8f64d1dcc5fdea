"""A source tree of several languages: each file by the parser that the tree's primary language selects, in one read of the contents.

The primary language follows from the paths alone and is known before the contents are read. Every file becomes one array, of symbols, call
events or API sites, that its parser makes; one CASE chooses the parser per row. In a Python tree all files pass one
Arrow job that parses the Python ones; the others, and what doesn't parse, keep their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.pyast import FIELDS, describe_files
from ..vocab import CALL_KEYWORDS
from . import code_calls as calls
from . import code_structure as st

HEADS = ("language", "is_entry_point", "line_count")
TEXT_PARSERS = ("c", "js", "csharp")
PARSERS = ("python", *TEXT_PARSERS)


def tree_files(corpus: DataFrame, *, primary: str | None = None) -> DataFrame:
    """(path, parser, language, is_entry_point, line_count, content) of the source files of ``corpus``.

    In a Python tree also what the syntax trees tell; ``content`` is then what is left to be read as text, null for nothing.
    ``primary`` is the tree's primary language, found from the paths if not given.
    """
    if primary is None:
        found = st.primary_language(corpus).first()
        primary = found["language"] if found else ""
    files = st.with_parser(corpus, primary)
    other = F.coalesce(F.nullif(text.suffix(F.col("path")), F.lit("")), F.lit("unknown"))
    language = _by_parser({p: F.lit(st.PARSER_LANGUAGE[p]) for p in PARSERS}, other)
    entry = _by_parser({p: st.entry_flag(p) for p in PARSERS}, F.lit(False))
    files = files.select("path", "parser", language.alias("language"), entry.alias("is_entry_point"),
                         text.newline_count(F.col("content")).alias("line_count"), "content")
    if primary != "Python":
        return files
    marked = files.withColumn("is_python", F.col("parser") == "python")
    described = describe_files(marked, st.KNOWN_FUNCTIONS, keep=("parser", *HEADS), only="is_python")
    return described.select("path", "parser", *HEADS, F.col("source").alias("content"), "problem", *FIELDS)


def _by_parser(arrays: dict[str, Column], otherwise: Column) -> Column:
    chosen = F
    for name, array in arrays.items():
        chosen = chosen.when(F.col("parser") == name, array)
    return chosen.otherwise(otherwise)


def _is_python_tree(files: DataFrame) -> bool:
    return "problem" in files.columns


def tree_symbols(files: DataFrame, *keep: str) -> DataFrame:
    """(path, kind, ordinal, name, line, args, bases) of all files."""
    return st._finish(_symbol_rows(files, keep), keep)


def _symbol_rows(files: DataFrame, keep: tuple[str, ...], more: Column | None = None) -> DataFrame:
    if _is_python_tree(files):
        # What the tree tells needs no text, so the same array serves parsed files and others.
        array = st._arrays_python(F.col("content"))
    else:
        # What Spark computes ahead of the CASE, such as first lines, meets only the texts of its own parser.
        own = {p: F.when(F.col("parser") == p, F.col("content")) for p in TEXT_PARSERS}
        array = _by_parser({p: st.ARRAYS[p](own[p]) for p in TEXT_PARSERS}, st._arrays_generic())
    return files.select("path", *keep, (F.col("parser") == "c").alias("c_like"), F.inline(array if more is None else F.concat(array, more)))


def tree_modules(files: DataFrame) -> DataFrame:
    """One row per file with its symbols as nested lists."""
    nothing = F.array(st._symbol("none", F.lit(0), name=F.lit(None)))
    return st.nested(st._finish(_symbol_rows(files, HEADS, nothing), HEADS), HEADS)


def tree_public_api(files: DataFrame) -> DataFrame:
    return st.public_api(tree_symbols(files))


def tree_rejects(files: DataFrame) -> DataFrame:
    """(path, problem) of the Python files that are read as text; none in other trees."""
    if not _is_python_tree(files):
        return files.where("false").select("path", F.lit(None).cast("string").alias("problem"))
    return st.python_rejects(files)


# Call events of one file in the order of its text: (before, inside, sure, defines, caller, callee, line). `defines` names the function
# that later calls belong to; `sure` events are from a syntax tree. Without `line` the newlines of `before` and `inside` tell it.
EVENT = "struct<before:bigint,inside:bigint,sure:boolean,defines:string,caller:string,callee:string,line:bigint>"


def _event(*, before=None, inside=None, sure: bool = False, defines=None, caller=None, callee=None, line=None) -> Column:
    null = F.lit(None)
    return F.struct(
        (F.lit(0) if before is None else before).alias("before"), (F.lit(0) if inside is None else inside).alias("inside"), F.lit(sure).alias("sure"),
        (null if defines is None else defines).alias("defines"), (null if caller is None else caller).alias("caller"),
        (null if callee is None else callee).alias("callee"), (null if line is None else line).alias("line")).cast(EVENT)


def _no_events() -> Column:
    return F.array().cast(f"array<{EVENT}>")


def _events_c() -> Column:
    """Calls from each definition to the end of the next one's head; the first event holds the lines up to the first body."""
    content = F.concat(F.lit("\n"), F.col("content"))
    cut = F.struct(F.split(content, calls.C_DEFINITION, -1).alias("pieces"), F.regexp_extract_all(content, F.lit(calls.C_DEFINITION), F.lit(0)).alias("heads"))

    def events(c: Column) -> Column:
        heads, pieces = c["heads"], c["pieces"]
        count = F.size(heads)
        # The line end put in front doesn't count.
        first = _event(before=text.newline_count(pieces[0]) - 1 + text.newline_count(heads[0]))

        def body(head: Column, i: Column) -> Column:
            rest = F.concat(F.get(pieces, i + 1), F.coalesce(F.get(heads, i + 1), F.lit("")))
            return F.transform(text.cut_at(rest, calls.CALL), lambda z: _event(
                before=z["before"], inside=F.coalesce(text.newline_count(z["hit"]), F.lit(0)), caller=F.regexp_extract(head, calls.C_DEFINITION, 1),
                callee=F.regexp_extract(z["hit"], calls.CALL, 1)))

        return F.when(count > 0, F.concat(F.array(first), F.flatten(F.transform(heads, body)))).otherwise(_no_events())

    return text.let(cut, events)


def _events_by_line(language: str) -> Column:
    """Lines with a definition or a call; calls belong to the definition last seen above or on the line."""
    pattern, groups = calls.DEFINITIONS[language]

    def of_line(line: Column, i: Column) -> Column:
        name = F.coalesce(*[F.nullif(F.regexp_extract(line, pattern, g), F.lit("")) for g in groups], F.lit(""))
        at = (i + 1).cast("bigint")
        return F.concat(
            F.when(line.rlike(pattern), F.array(_event(defines=name, line=at))).otherwise(_no_events()),
            F.transform(F.regexp_extract_all(line, F.lit(calls.CALL), F.lit(1)), lambda callee: _event(callee=callee, line=at)))

    return F.when(F.col("content").rlike(pattern), F.flatten(F.transform(text.line_array(F.col("content")), of_line))).otherwise(_no_events())


def _events_python() -> Column:
    inside = F.filter("calls", lambda c: c["caller"].isNotNull())
    return F.transform(inside, lambda c: _event(sure=True, caller=c["caller"], callee=c["callee"], line=c["line"]))


def tree_call_edges(files: DataFrame) -> DataFrame:
    """(caller, callee, line, location, pos) of all files; only names and counts are shuffled, to order those of a file."""
    generic = _events_by_line("generic")
    if _is_python_tree(files):  # all other files of such a tree are read as any language's
        array = F.concat(F.coalesce(_events_python(), _no_events()), F.coalesce(generic, _no_events()))
    else:
        array = F.coalesce(_by_parser({"c": _events_c(), "js": _events_by_line("js"), "csharp": _events_by_line("csharp")}, generic), _no_events())
    rows = files.select("path", "parser", F.posexplode(array).alias("pos", "e")).select("path", "parser", "pos", "e.*")
    upto = Window.partitionBy("path").orderBy("pos")
    counted = F.sum(F.col("before") + F.col("inside")).over(upto) - F.col("inside") + 1
    rows = rows.withColumns({"line": F.coalesce("line", counted), "caller": F.coalesce("caller", F.last("defines", ignorenulls=True).over(upto))})
    keyword = _by_parser({p: F.col("callee").isin(*CALL_KEYWORDS[p]) for p in TEXT_PARSERS}, F.col("callee").isin(*CALL_KEYWORDS["generic"]))
    plain = ~keyword & (F.col("callee") != F.col("caller")) & (F.col("caller") != "")
    found = rows.where(F.col("callee").isNotNull() & F.col("caller").isNotNull() & (F.col("sure") | plain))
    return found.select("caller", "callee", "line", F.col("path").alias("location"), F.col("pos").cast("bigint").alias("pos"))


SITE = "struct<function:string,line:bigint,args:array<string>>"


def tree_api_calls(files: DataFrame) -> DataFrame:
    """(function, file, line, pos, args, group): call sites of known functions in all files."""
    known = text.any_of(st.KNOWN_FUNCTIONS)

    def of_line(line: Column, i: Column) -> Column:
        sites = F.transform(F.regexp_extract_all(line, F.lit(calls.CALL_WITH_ARGS), F.lit(0)), lambda hit: F.struct(
            F.regexp_extract(hit, calls.CALL_WITH_ARGS, 1), (i + 1).cast("bigint"), text.comma_parts(F.regexp_extract(hit, calls.CALL_WITH_ARGS, 2))).cast(SITE))
        return F.when(line.rlike(known), sites).otherwise(F.array().cast(f"array<{SITE}>"))

    content = F.col("content")
    by_lines = F.when(content.rlike(known), F.flatten(F.transform(text.line_array(content), of_line)))
    tree = F.transform("calls", lambda c: F.struct(c["callee"], c["line"], c["args"]).cast(SITE)) if _is_python_tree(files) else None
    nothing = F.array().cast(f"array<{SITE}>")
    array = F.coalesce(by_lines, nothing) if tree is None else F.concat(F.coalesce(tree, nothing), F.coalesce(by_lines, nothing))
    sites = files.select("path", F.posexplode(array).alias("pos", "s")).select(
        "s.function", F.col("path").alias("file"), "s.line", F.col("pos").cast("bigint").alias("pos"), "s.args")
    return sites.withColumn("group", calls._group(F.col("function"))).where(F.col("group").isNotNull())
