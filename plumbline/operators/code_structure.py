"""What a source tree is made of: languages, build systems, technologies, modules and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.pyast import describe_files
from ..functions.ranking import top_k, top_k_per_group
from ..session import cut_lineage
from ..vocab import (API_GROUPS, BUILD_SYSTEM_BY_EXTENSION, BUILD_SYSTEM_BY_NAME, C_DEFINITION_KEYWORDS, C_SUFFIXES,
                     JS_ENTRY_NAMES, JS_SUFFIXES, LANGUAGE_BY_EXTENSION, PLATFORM_PRIORITY, PYTHON_ENTRY_NAMES,
                     TECHNOLOGY_PATTERNS)

# Definition patterns by language.
# One start for each run of words, stars and white space, whose end is looked at before its lines: no
# repeated groups, which recurse, and no second look at a run. The content must begin with a line end.
LINE_BREAK = r"(?>\r\n|[\n\r\x85\u2028\u2029])"
C_HEAD = r"\([^)]*\)\s*(?:const\s*)?[{;]"
C_LEAD = rf"[\w*\s]*?{LINE_BREAK}(?=[\w*])"
C_FUNCTION = rf"(?U)(?<![\w*\s])(?=[\w*\s]++{C_HEAD}){C_LEAD}[\w*\s]*\s(\w+)\s*\(([^)]*)\)\s*(?:const\s*)?[{{;]"
# An include ends on its own line, so the white space and the name stop at a line end.
C_INCLUDE = r"""(?U)#include[\s&&[^\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]]*[<"]([^>"\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]+)[>"]"""
C_CLASS = r"(?U)(?:class|struct)\s+(\w+)\s*(?::\s*(?:public|private|protected)\s+\w+)?\s*\{"
C_DEFINE = r"(?U)#define\s+(\w+)"
JS_IMPORT = r"""(?U)(?:import|require)\s*\(?['"]([^'"]+)['"]"""
JS_FUNCTION = (r"(?U)(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)|"
               r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(?[^)]*\)?\s*=>")
JS_CLASS = r"(?U)class\s+(\w+)(?:\s+extends\s+(\w+))?"
CS_CLASS = r"(?U)(?:public|private|internal|protected|static|sealed|abstract)\s+(?:partial\s+)?class\s+(\w+)"
CS_METHOD = (r"(?U)(?:public|private|protected|internal|static|override|virtual|async)\s+[\w<>\[\]]+\s+(\w+)"
             r"\s*\(([^)]*)\)")
CS_USING = r"(?U)using\s+([\w\.]+)\s*;"
GENERIC_FUNCTION = r"(?U)\b(\w+)\s*\([^)]*\)\s*(?:\{|:)"


def _lookup(table: dict[str, str], key: Column) -> Column:
    """A fixed small table as a map literal; no join."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def language(path: Column) -> Column:
    return _lookup(LANGUAGE_BY_EXTENSION, F.lower(text.suffix(path)))


def source_files(corpus: DataFrame) -> DataFrame:
    return corpus.where(language(F.col("path")).isNotNull())


def language_counts(corpus: DataFrame) -> DataFrame:
    """Files per language, most frequent first; ties by the first path."""
    named = corpus.select("path", language(F.col("path")).alias("language")).where(F.col("language").isNotNull())
    counts = named.groupBy("language").agg(F.count("*").alias("files"), F.min("path").alias("first_path"))
    return counts.orderBy(F.desc("files"), F.asc("first_path"))


def primary_language(corpus: DataFrame) -> DataFrame:
    return language_counts(corpus).limit(1).select("language")


def build_systems(corpus: DataFrame) -> DataFrame:
    path = F.col("path")
    hits = F.array(_lookup(BUILD_SYSTEM_BY_NAME, text.file_name(path)), _lookup(BUILD_SYSTEM_BY_EXTENSION, text.suffix(path)))
    return corpus.select(F.explode(F.array_compact(hits)).alias("build_system")).distinct()


def pattern_files(corpus: DataFrame) -> DataFrame:
    """(pattern, description, category, path) for every technology pattern a file contains; one pass."""
    table = F.array(*[
        F.when(F.col("content").contains(p), F.struct(
            F.lit(p).alias("pattern"), F.lit(d).alias("description"), F.lit(c).alias("category")))
        for p, d, c in TECHNOLOGY_PATTERNS
    ])
    return corpus.select("path", F.inline(F.array_compact(table)))


def pattern_scan(corpus: DataFrame) -> DataFrame:
    return pattern_files(corpus).groupBy("pattern", "description", "category").agg(
        F.count("*").alias("files"), F.min("path").alias("first_path")
    )


def platform_infer(corpus: DataFrame) -> DataFrame:
    seen = pattern_files(corpus).agg(*[
        F.coalesce(F.bool_or(F.col("category") == c), F.lit(False)).alias(c) for c, _ in PLATFORM_PRIORITY
    ])
    platform = F
    for category, name in PLATFORM_PRIORITY:
        platform = platform.when(F.col(f"`{category}`"), name)
    return seen.select(platform.otherwise("Unknown").alias("platform"))


def corpus_totals(corpus: DataFrame) -> DataFrame:
    """Source files, and line ends over all files."""
    return corpus.agg(
        F.count_if(language(F.col("path")).isNotNull()).alias("file_count"),
        F.coalesce(F.sum(text.newline_count(F.col("content"))), F.lit(0)).alias("total_lines"),
    )


def with_parser(corpus: DataFrame, primary: str | None = None) -> DataFrame:
    """Source files with the parser that the primary language, of the whole corpus if not given, selects for them."""
    files, suffix = source_files(corpus), text.suffix(F.col("path"))
    named = primary_language(corpus).scalar() if primary is None else F.lit(primary)
    primary = F.col("primary_language")
    parser = (
        F.when((primary == "Python") & (suffix == ".py"), "python")
        .when(primary.isin("C", "C++") & suffix.isin(*C_SUFFIXES), "c")
        .when(primary.isin("JavaScript", "TypeScript") & suffix.isin(*JS_SUFFIXES), "js")
        .when((primary == "C#") & (suffix == ".cs"), "csharp").otherwise("generic")
    )
    return files.withColumn("primary_language", named).withColumn("parser", parser)


# Symbols: (path, kind, ordinal, name, line, args, bases). `line` is NULL where none is reported.
# All kinds of one file come out of one array, so the content is read once.

SYMBOL = "struct<kind:string,ordinal:bigint,before:bigint,hit:string,name:string,line:bigint,args:array<string>,bases:array<string>>"


def _symbol(kind: str, ordinal: Column, *, name: Column, before=None, hit=None, line=None, args=None, bases=None) -> Column:
    none = F.array()
    return F.struct(
        F.lit(kind).alias("kind"), ordinal.alias("ordinal"), (F.lit(0) if before is None else before).alias("before"),
        (F.lit("") if hit is None else hit).alias("hit"), name.alias("name"), (F.lit(None) if line is None else line).alias("line"),
        (none if args is None else args).alias("args"), (none if bases is None else bases).alias("bases"),
    ).cast(SYMBOL)


def _matches(kind: str, pattern: str, *, name: int = 1, args: int = 0, base: int = 0, first_line: bool = False, content: Column | None = None) -> Column:
    """Matches whose own line is not asked for; ``first_line`` reports where the name first occurs."""
    content = F.col("content") if content is None else content

    def told(group: int) -> Column:
        return F.regexp_extract_all(content, F.lit(pattern), F.lit(group))

    def one(hit: Column, i: Column, lines: Column | None = None) -> Column:
        return _symbol(
            kind, i, name=hit["name"], line=None if lines is None else F.get(lines, i), args=text.comma_parts(hit["args"]) if args else None,
            bases=F.filter(F.array(hit["base"]), lambda b: b != "") if base else None)

    hits = F.arrays_zip(*[told(group).alias(part) for part, group in (("name", name), ("args", args), ("base", base)) if group])
    if not first_line:
        return F.transform(hits, lambda hit, i: one(hit, i))
    return text.let(text.first_lines(content, told(name)), lambda lines: F.transform(hits, lambda hit, i: one(hit, i, lines)))


def _located(kind: str, pattern: str, *names: int, args: int = 0, line_end: str = "\n", content: Column | None = None, lead: str | None = None) -> Column:
    """Matches with the line they start on, filled in by the running sum of :func:`_finish`. The first of the groups ``names`` that holds anything names them.

    With ``lead`` the pattern wants a line end in front of the content, and what ``lead`` matches at the start of a hit is no part of it.
    """
    source = F.col("content") if content is None else content

    def symbol(z: Column, i: Column, hit: Column, before: Column) -> Column:
        name = F.coalesce(*[F.nullif(z[f"g{g}"], F.lit("")) for g in names])
        return _symbol(kind, i, name=name, before=before, hit=hit, line=F.lit(-1), args=text.comma_parts(z[f"g{args}"]) if args else None)

    def led(z: Column, i: Column) -> Column:
        def symbol_of(own: Column) -> Column:
            skipped = F.coalesce(text.newline_count(z["hit"]) - text.newline_count(own), F.lit(0)) - F.when(i == 0, 1).otherwise(0)
            return symbol(z, i, own, z["before"] + skipped)

        return text.let(F.regexp_replace(z["hit"], rf"(?U)\A{lead}", ""), symbol_of)

    def cut(source: Column) -> Column:
        return text.cut_at(source, pattern, line_end, (*names, args) if args else names, tail=False)

    if lead:
        return F.transform(text.let(F.concat(F.lit("\n"), source), cut), led)
    return F.transform(cut(source), lambda z, i: symbol(z, i, z["hit"], z["before"]))


def _arrays_c(content: Column | None = None) -> Column:
    return F.concat(
        _located("function", C_FUNCTION, 1, args=2, lead=C_LEAD, content=content),
        _located("import", C_INCLUDE, 1, line_end=text.LINE_END, content=content),
        _matches("class", C_CLASS, first_line=True, content=content), _matches("define", C_DEFINE, content=content))


def _arrays_js(content: Column | None = None) -> Column:
    return F.concat(_located("function", JS_FUNCTION, 1, 3, args=2, content=content),
                    _matches("import", JS_IMPORT, content=content), _matches("class", JS_CLASS, base=2, content=content))


def _arrays_csharp(content: Column | None = None) -> Column:
    return F.concat(_matches("function", CS_METHOD, args=2, first_line=True, content=content),
                    _matches("import", CS_USING, content=content), _matches("class", CS_CLASS, content=content))


def _arrays_generic(content: Column | None = None) -> Column:
    return _located("once", GENERIC_FUNCTION, 1, content=content)


def _arrays_python(source: Column | None = None) -> Column:
    """Over described files: symbols of the syntax tree, and those of any language in what it doesn't cover."""
    tree = F.concat(
        F.transform("functions", lambda s, i: _symbol("function", i, name=s["name"], line=s["line"], args=s["args"])),
        F.transform("classes", lambda s, i: _symbol(
            "class", i, name=s["name"], line=s["line"], args=F.transform(s["methods"], lambda m: m["name"]), bases=s["bases"])),
        F.transform("imports", lambda s, i: _symbol("import", i, name=s["module"], line=s["line"], args=s["names"])))
    source = F.col("source") if source is None else source
    return F.when(source.isNull(), tree).otherwise(F.concat(tree, _arrays_generic(source)))


ARRAYS = {"python": _arrays_python, "c": _arrays_c, "js": _arrays_js, "csharp": _arrays_csharp, "generic": _arrays_generic}


def _finish(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines for located symbols, keywords out, and repeated names of generic files once."""
    rows = rows.withColumn("asked", F.col("line") == -1).withColumn("given", F.col("line"))
    rows = text.with_lines(rows, "path", "kind")
    rows = rows.withColumn("line", F.when(F.col("asked"), F.col("line")).otherwise(F.col("given")))
    named = rows.where(~((F.col("kind") == "function") & F.col("c_like") & F.col("name").isin(*C_DEFINITION_KEYWORDS)))
    repeat = F.row_number().over(Window.partitionBy("path", "kind", "name").orderBy("ordinal"))
    once = named.withColumn("nth", repeat).where((F.col("kind") != "once") | (F.col("nth") == 1))
    kind = F.when(F.col("kind") == "once", "function").otherwise(F.col("kind"))
    return once.select("path", kind.alias("kind"), "ordinal", "name", "line", "args", "bases", *keep)


def symbols(corpus: DataFrame, parser: str) -> DataFrame:
    """All symbols of the files by one parser. For Python the input may be described files."""
    files = _described(corpus) if parser == "python" else corpus
    rows = files.select("path", F.lit(parser == "c").alias("c_like"), F.inline(ARRAYS[parser]()))
    return _finish(rows)


KNOWN_FUNCTIONS = tuple(name for group in API_GROUPS.values() for name in group)


def describe_python(corpus: DataFrame) -> DataFrame:
    """Syntax-tree facts per file; what fails to parse keeps its text in ``source``."""
    return describe_files(corpus, KNOWN_FUNCTIONS)


def python_rejects(described: DataFrame) -> DataFrame:
    """(path, problem): files that are read as text, in part or as a whole, and why."""
    return described.where(F.col("problem").isNotNull()).select("path", "problem")


def _described(files: DataFrame) -> DataFrame:
    return files if "parsed" in files.columns else describe_python(files)


def entry_flag(parser: str) -> Column:
    name, content = text.file_name(F.col("path")), F.col("content")
    return {
        "python": name.isin(*PYTHON_ENTRY_NAMES) | content.contains("if __name__"),
        "c": content.contains("main(") | content.contains("WinMain("),
        "js": name.isin(*JS_ENTRY_NAMES),
        "csharp": content.contains("static void Main") | content.contains("static async Task Main"),
        "generic": F.lit(False),
    }[parser]


# Language label of the modules each parser reads.
PARSER_LANGUAGE = {"python": "Python", "c": "C/C++", "js": "JavaScript/TypeScript", "csharp": "C#"}


def module_heads(corpus: DataFrame, parser: str, *keep: str) -> DataFrame:
    """(path, language, is_entry_point, line_count) without looking for symbols."""
    label = F.lit(PARSER_LANGUAGE[parser]) if parser in PARSER_LANGUAGE else F.coalesce(
        F.nullif(text.suffix(F.col("path")), F.lit("")), F.lit("unknown"))
    return corpus.select("path", label.alias("language"), entry_flag(parser).alias("is_entry_point"),
                         text.newline_count(F.col("content")).alias("line_count"), *keep)


def modules(corpus: DataFrame, parser: str) -> DataFrame:
    """One row per file with its symbols as nested lists, which one file bounds. One read of the corpus."""
    heads = ("language", "is_entry_point", "line_count")
    headed = module_heads(corpus, parser, "content")
    files = describe_files(headed, KNOWN_FUNCTIONS, keep=heads) if parser == "python" else headed
    # One more element per file keeps the files without symbols.
    nothing = F.array(_symbol("none", F.lit(0), name=F.lit(None)))
    found = files.select("path", *heads, F.lit(parser == "c").alias("c_like"), F.inline(F.concat(ARRAYS[parser](), nothing)))
    return nested(_finish(found, heads), heads)


def nested(rows: DataFrame, heads: tuple[str, ...]) -> DataFrame:
    """Symbols as lists of their file, which bounds them."""
    entry = F.struct("ordinal", "name", "line", "args", "bases")

    def of(kind: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, entry))), lambda s: s.dropFields("ordinal"))

    return rows.groupBy("path", *heads).agg(of("import").alias("imports"), of("class").alias("classes"),
                                            of("function").alias("functions"), of("define").alias("defines"))


def entry_points(heads: DataFrame) -> DataFrame:
    return heads.where("is_entry_point").select("path")


def public_api(rows: DataFrame) -> DataFrame:
    """All classes, and functions without a leading underscore."""
    kept = (F.col("kind") == "class") | ((F.col("kind") == "function") & ~F.col("name").startswith("_"))
    return rows.where(kept).select("name", "kind", F.col("path").alias("location"), "ordinal")


def dir_tree(corpus: DataFrame) -> DataFrame:
    """Directory entries (parent, name, kind) implied by the paths, each once."""
    parts = F.split("path", "/")
    level = F.explode(F.sequence(F.lit(1), F.size(parts)))
    rows = corpus.select(parts.alias("parts"), level.alias("i"))
    return rows.select(
        F.array_join(F.slice("parts", 1, F.col("i") - 1), "/").alias("parent"), F.col("parts")[F.col("i") - 1].alias("name"),
        F.when(F.col("i") == F.size("parts"), "file").otherwise("dir").alias("kind"),
    ).distinct()


def report_top_modules(corpus: DataFrame, parser: str, *, k: int = 30) -> DataFrame:
    """Longest modules with their class and function counts; only those ``k`` files are looked into."""
    best = top_k(module_heads(corpus, parser).select("path", "language", "line_count"), k, F.desc("line_count"), F.asc("path"))
    files = corpus.join(F.broadcast(best.select("path")), "path", "left_semi")
    counts = symbols(files, parser).groupBy("path").agg(
        F.count_if(F.col("kind") == "class").alias("classes"), F.count_if(F.col("kind") == "function").alias("functions"))
    return best.join(counts, "path", "left").fillna(0, ["classes", "functions"])


def head_per_group(rows: DataFrame, group: list[str], k: int, *order: str) -> DataFrame:
    """The first ``k`` rows of each group, and how many ``more`` the group has. The rows are kept once for both, so what they come from is read once."""
    rows = cut_lineage(rows)
    totals = rows.groupBy(*group).agg(F.greatest(F.count("*") - k, F.lit(0)).alias("more"))
    return top_k_per_group(rows, group, k, *[F.asc(o) for o in order]).join(totals, group)
