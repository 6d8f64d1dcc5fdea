"""Who calls whom: call edges by language, the call graph, bounded flows, external and API calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.skew import PAIRS_A_TASK, pair_join, skew_join
from ..session import cut_lineage, scratch_dir, written
from ..vocab import API_GROUPS, CALL_KEYWORDS
from .code_structure import KNOWN_FUNCTIONS, LINE_BREAK, describe_python, module_heads, symbols

# Definition and call patterns by language.
# One start for each run of words, stars and white space; the content must begin with a line end.
C_DEFINITION = (rf"(?U)(?<![\w*\s])(?=[\w*\s]++\([^)]*\)\s*(?:const\s*)?\{{)[\w*\s&&[^\n\r\x85\u2028\u2029]]*+{LINE_BREAK}"
                r"[\w*\s]+\s(\w+)\s*\([^)]*\)\s*(?:const\s*)?\{")
JS_DEFINITION = (r"(?U)(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(?)\s*(?:[^)]*\))?\s*(?:=>)?\s*\{")
CS_DEFINITION = r"(?U)(?:public|private|protected|internal|static|override|virtual|async)\s+[\w<>\[\]]+\s+(\w+)\s*\("
GENERIC_DEFINITION = r"(?U)\b(\w+)\s*\([^)]*\)\s*(?:->[\w\s]+)?\s*[\{:]"
CALL = r"(?U)\b(\w+)\s*\("
CALL_WITH_ARGS = r"(?U)\b(\w+)\s*\(([^)]*)\)"
DEFINITIONS = {"js": (JS_DEFINITION, (1, 2)), "csharp": (CS_DEFINITION, (1,)), "generic": (GENERIC_DEFINITION, (1,))}
EXTERNAL_PREFIXES = ("Sc", "Win", "Nfc", "Usb")
# Prefixes that hint at a system interface.
SYSTEM_PREFIXES = ("nfc_", "hid_", "usb_", "scard", "win32", "ctypes")

# Edges: (caller, callee, line, location, pos); `pos` orders the calls of one line.


def call_edges_c(corpus: DataFrame) -> DataFrame:
    """Calls between one definition and the end of the next one's head, attributed to the former.

    The body after each definition is cut at its calls; lines are running sums of newline counts
    over the small pieces, so no content is shuffled.
    """
    content = F.concat(F.lit("\n"), F.col("content"))
    # Selected first, so that both arrays are computed once per file.
    cut = corpus.select(
        "path", F.split(content, C_DEFINITION, -1).alias("pieces"),
        F.regexp_extract_all(content, F.lit(C_DEFINITION), F.lit(0)).alias("heads"),
    )
    # The line end put in front doesn't count.
    rows = cut.select("path", (text.newline_count(F.col("pieces")[0]) - 1).alias("first"), F.posexplode(F.arrays_zip(
        F.col("heads").alias("head"), F.slice("pieces", 2, F.size("pieces")).alias("rest"),
        F.slice("heads", 2, F.size("heads")).alias("next"),
    )).alias("fn", "z"))
    bodies = rows.select(
        "path", "fn", F.regexp_extract("z.head", C_DEFINITION, 1).alias("caller"),
        (F.col("first") + text.newline_count(F.col("z.head"))).alias("start"),
        F.concat("z.rest", F.coalesce("z.next", F.lit(""))).alias("body"),
    )
    calls = bodies.select("path", "fn", "caller", "start", F.posexplode(text.cut_at(F.col("body"), CALL)).alias("pos", "c")).select(
        "path", "fn", "caller", "start", "pos", "c.before", "c.hit",
        F.coalesce(text.newline_count(F.col("c.hit")), F.lit(0)).alias("inside"),
    )
    upto = Window.partitionBy("path").orderBy("fn", "pos")
    # Lines before the first body; every later body follows the one before it without a gap.
    base = F.first("start").over(upto)
    line = base + F.sum(F.col("before") + F.col("inside")).over(upto) - F.col("inside") + 1
    found = calls.withColumn("line", line).where(F.col("hit").isNotNull()).select(
        "caller", F.regexp_extract("hit", CALL, 1).alias("callee"), "line", F.col("path").alias("location"),
        (F.col("fn").cast("bigint") * 2**31 + F.col("pos")).alias("pos"),
    )
    return _real(found, "c")


def _real(edges: DataFrame, language: str) -> DataFrame:
    return edges.where(~F.col("callee").isin(*CALL_KEYWORDS[language]) & (F.col("callee") != F.col("caller")))


def call_edges_line(corpus: DataFrame, language: str) -> DataFrame:
    """JavaScript, C# and other languages: calls belong to the definition last seen above or on the line.

    Only lines with a definition or a call are kept before the names are carried forward.
    """
    pattern, groups = DEFINITIONS[language]
    name = F.coalesce(*[F.nullif(F.regexp_extract("text", pattern, g), F.lit("")) for g in groups])
    has_def = F.col("text").rlike(pattern)
    calls = F.regexp_extract_all("text", F.lit(CALL), F.lit(1))
    lines = text.explode_lines(corpus.where(F.col("content").rlike(pattern))).select(
        "path", "line", has_def.alias("is_def"), F.when(has_def, F.coalesce(name, F.lit(""))).alias("name"), calls.alias("calls")
    ).where(F.col("is_def") | (F.size("calls") > 0))
    above = Window.partitionBy("path").orderBy("line")
    current = lines.withColumn("caller", F.last("name", ignorenulls=True).over(above)).where(F.col("caller") != "")
    edges = current.select("caller", F.posexplode("calls").alias("pos", "callee"), "line", F.col("path").alias("location"))
    return _real(edges.select("caller", "callee", "line", "location", F.col("pos").cast("bigint").alias("pos")), language)


def described_files(corpus: DataFrame) -> DataFrame:
    """Described Python files, kept once in the shared folder for calls, API calls and symbols."""
    return cut_lineage(describe_python(corpus))


def _broken(described: DataFrame) -> DataFrame:
    return described.where(F.col("source").isNotNull()).select("path", F.col("source").alias("content"))


def call_edges_python(described: DataFrame) -> DataFrame:
    """Calls inside functions from the syntax tree; what does not parse goes by lines."""
    edges = described.select("path", F.posexplode("calls").alias("pos", "c")).where(F.col("c.caller").isNotNull()).select(
        "c.caller", "c.callee", "c.line", F.col("path").alias("location"), F.col("pos").cast("bigint").alias("pos"))
    return edges.unionByName(call_edges_line(_broken(described), "generic"))


def call_edges(corpus: DataFrame, parser: str) -> DataFrame:
    if parser == "python":
        return call_edges_python(described_files(corpus))
    return call_edges_c(corpus) if parser == "c" else call_edges_line(corpus, parser)


def call_graph(edges: DataFrame) -> DataFrame:
    """Distinct (caller, callee) by name over all files, with the first place and the number of calls.

    Sorting a caller's rows by their first place gives its callees in first-seen order.
    """
    return edges.groupBy("caller", "callee").agg(
        F.min(F.struct("location", "line", "pos")).alias("first"), F.count("*").alias("calls")
    ).select("caller", "callee", F.col("first.location").alias("first_location"), F.col("first.line").alias("first_line"), "calls")


def call_graph_nodes(graph: DataFrame, found_patterns: DataFrame) -> DataFrame:
    """Each node once; ``highlight`` marks names that are technology patterns found in the corpus."""
    nodes = graph.select(F.inline(F.array(F.struct(F.col("caller").alias("name")), F.struct(F.col("callee").alias("name"))))).distinct()
    marks = found_patterns.select(F.col("pattern").alias("name")).distinct().withColumn("_hit", F.lit(True))
    return nodes.join(F.broadcast(marks), "name", "left").select("name", F.coalesce("_hit", F.lit(False)).alias("highlight"))


def looks_external(name: Column) -> Column:
    """Starts with a capital without being all capitals, or has a known prefix."""
    capital = name.rlike(r"^\p{Lu}") & (F.upper(name) != name)
    prefixed = F.greatest(*[name.startswith(p) for p in EXTERNAL_PREFIXES])
    return capital | prefixed


def external_calls(edges: DataFrame, found_patterns: DataFrame) -> DataFrame:
    """Edges to a found technology pattern or to a name that looks external.

    The patterns are a fixed short list, so the found ones are broadcast.
    """
    marks = found_patterns.select(F.col("pattern").alias("callee")).distinct().withColumn("_hit", F.lit(True))
    return edges.join(F.broadcast(marks), "callee", "left").where(F.col("_hit") | looks_external(F.col("callee"))).drop("_hit")


# Entries that are walked together, a bit of a number each.
BLOCK = 64
# An entry name of more files than this has a block of its own, so that a step of other entries isn't held against all of them.
BLOCK_FILES = 16


def _told_edges(graph: DataFrame, files: DataFrame) -> DataFrame:
    """Each edge once, with the number of functions its callee calls, and whether it is the only way to the callee."""
    edges = written(graph.select("caller", "callee").distinct())
    into = edges.groupBy("callee").agg(F.count("*").alias("n"))
    onward = edges.groupBy(F.col("caller").alias("callee")).agg(F.count("*").alias("calls"))
    entries = files.select(F.col("entry").alias("callee"), F.lit(True).alias("_entry")).distinct()
    told = into.join(onward, "callee", "left").join(entries, "callee", "left").select(
        "callee", F.coalesce("calls", F.lit(0)).alias("calls"), ((F.col("n") == 1) & F.col("_entry").isNull()).alias("sole"))
    return written(skew_join(edges, told, ["callee"], sizes=into).select("caller", "callee", "calls", "sole"))


def _blocks(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(entry, calls, block, mask) of the entries that call something. Neighbours in a file, whose flows are likely alike, share a block."""
    calls = edges.groupBy(F.col("caller").alias("entry")).agg(F.count("*").alias("calls"))
    first = files.groupBy("entry").agg(F.count("*").alias("files"), F.min("file").alias("first")).join(calls, "entry")
    # Numbers start anew at a multiple of BLOCK in each partition, so none is counted in one task; written, they stay as they are.
    numbered = written(first.orderBy("first", "entry").select("entry", "files", "calls", F.monotonically_increasing_id().alias("id")))
    alone = F.col("files") > BLOCK_FILES
    bit = F.when(alone, 0).otherwise(F.col("id") % BLOCK).cast("int")
    return numbered.select("entry", "calls", F.when(alone, -1 - F.col("id")).otherwise(F.floor(F.col("id") / BLOCK)).alias("block"), bit.alias("bit")).selectExpr(
        "entry", "calls", "block", "shiftleft(1L, bit) AS mask")


def entry_flows(graph: DataFrame, roots: DataFrame, *, max_depth: int | None = None) -> DataFrame:
    """Steps of the flows from entry functions: (entry, file, depth, caller, callee, again).

    A level holds each step once, whatever number of paths lead to it, and a function is left only at the
    first level that reaches it, so rows grow with the edges. ``again`` marks steps to a function of an earlier level
    (cycles among them), where the flow isn't followed further. Levels are parts of one table of steps and one of the functions
    reached, so the plan of a level is as long at the last as at the first, and no level is worked out again; with ``max_depth``
    only steps up to that many calls below the entry's own are listed.

    Functions go by their names, so the flow of an entry is walked once however many files have one of that name. Entries are walked
    in blocks of 64: a row of either table stands for those entries of a block that take the step, or reach the function, on one level,
    a bit each. The rows for each entry and file, which are entries times steps, are made at the end and not kept or moved. A callee
    that is no entry and has one caller is new whenever it is reached, so it is looked up in no earlier level, and kept only to go on from it.
    """
    spark, folder, depth = graph.sparkSession, scratch_dir(graph.sparkSession, "flows"), 0
    files = written(roots.select("entry", "file").distinct())
    edges = _told_edges(graph, files)
    blocks = _blocks(files, edges)
    members = files.join(blocks.select("entry", "block", "mask"), "entry")
    first = blocks.select(F.col("entry").alias("name"), "block", F.col("mask").alias("bits"), "calls")
    first.write.parquet(f"{folder}/reached/level=0")
    step = T.StructType([first.schema["block"], *edges.schema.fields, first.schema["bits"]])
    while max_depth is None or depth <= max_depth:
        reached = spark.read.schema(T.StructType([*first.schema.fields, T.StructField("level", T.LongType())])).parquet(f"{folder}/reached")
        last = reached.where((F.col("level") == depth) & (F.col("calls") > 0))
        pairs = last.agg(F.sum("calls")).first()[0] or 0
        if depth and not pairs:
            break
        last = last.select(F.col("name").alias("caller"), "block", "bits")
        depth += 1
        path = f"{folder}/steps/depth={depth}"
        # Few steps need no dealing out, and a short list of functions is sent to the edges.
        found = pair_join(last, edges, ["caller"]) if pairs > PAIRS_A_TASK else last.join(edges, "caller")
        found.select(*step.names).write.parquet(path)
        steps = spark.read.schema(step).parquet(path).withColumnRenamed("callee", "name")
        met = steps.where(~F.col("sole")).select("name", "block", "calls", F.col("bits").alias("_now"), F.lit(0).cast("bigint").alias("_before")).unionByName(
            reached.select("name", "block", "calls", F.lit(0).cast("bigint").alias("_now"), F.col("bits").alias("_before")))
        new = met.groupBy("name", "block").agg(F.max("calls").alias("calls"), F.bit_or("_now").alias("_now"), F.bit_or("_before").alias("_before")).withColumn(
            "bits", F.col("_now").bitwiseAND(F.bitwise_not("_before"))).where(F.col("bits") != 0)
        steps.where(F.col("sole") & (F.col("calls") > 0)).select(*first.columns).unionByName(new.select(*first.columns)).write.parquet(
            f"{folder}/reached/level={depth}")
    steps = spark.read.schema(T.StructType([*step.fields, T.StructField("depth", T.LongType())])).parquet(f"{folder}/steps")
    reached = spark.read.schema(T.StructType([*first.schema.fields, T.StructField("level", T.LongType())])).parquet(f"{folder}/reached")
    kept = ["block", "depth", "caller", "callee", "bits"]
    new = reached.select(F.col("name").alias("callee"), "block", F.col("level").alias("depth"), F.col("bits").alias("new"))
    told = steps.where(~F.col("sole")).join(new, ["callee", "block", "depth"], "left").select(*kept, F.coalesce("new", F.lit(0)).alias("new")).unionByName(
        steps.where("sole").select(*kept, F.col("bits").alias("new")))
    taken = pair_join(told, members, ["block"], counted=steps).where(F.col("bits").bitwiseAND(F.col("mask")) != 0)
    return taken.select("entry", "file", "depth", "caller", "callee", (F.col("new").bitwiseAND(F.col("mask")) == 0).alias("again"))


def entry_roots(corpus: DataFrame, parser: str, *, k: int | None = None) -> DataFrame:
    """Functions of the entry modules, of the first ``k`` in path order if given; only those files are looked into."""
    first = module_heads(corpus, parser).where("is_entry_point").select("path")
    files = corpus.join(first if k is None else first.orderBy("path").limit(k), "path", "left_semi")
    own = symbols(files, parser).where(F.col("kind") == "function")
    return own.select(F.col("name").alias("entry"), F.col("path").alias("file"))


def _group(name: Column) -> Column:
    pairs = [(fn, group) for group, names in API_GROUPS.items() for fn in names]
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])[name]


def api_calls_by_text(corpus: DataFrame) -> DataFrame:
    """Call sites of known functions, line by line: (function, file, line, pos, args, group)."""
    known = text.any_of(KNOWN_FUNCTIONS)
    lines = text.explode_lines(corpus.where(F.col("content").rlike(known))).where(F.col("text").rlike(known))
    sites = lines.select("path", "line", F.posexplode(F.regexp_extract_all("text", F.lit(CALL_WITH_ARGS), F.lit(0))).alias("pos", "hit"))
    sites = sites.select(
        F.regexp_extract("hit", CALL_WITH_ARGS, 1).alias("function"), F.col("path").alias("file"), "line",
        F.col("pos").cast("bigint").alias("pos"), text.comma_parts(F.regexp_extract("hit", CALL_WITH_ARGS, 2)).alias("args"))
    return sites.withColumn("group", _group(F.col("function"))).where(F.col("group").isNotNull())


def api_calls_python(described: DataFrame) -> DataFrame:
    sites = described.select("path", F.posexplode("calls").alias("pos", "c")).select(
        F.col("c.callee").alias("function"), F.col("path").alias("file"), F.col("c.line").alias("line"),
        F.col("pos").cast("bigint").alias("pos"), F.col("c.args").alias("args"))
    known = sites.withColumn("group", _group(F.col("function"))).where(F.col("group").isNotNull())
    return known.unionByName(api_calls_by_text(_broken(described)))


def api_calls(corpus: DataFrame, parser: str) -> DataFrame:
    return api_calls_python(described_files(corpus)) if parser == "python" else api_calls_by_text(corpus)


def api_summary(calls: DataFrame) -> DataFrame:
    return calls.groupBy("group").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), F.asc("group"))


def api_by_group(calls: DataFrame) -> DataFrame:
    """Functions used per group with their sites counted."""
    return calls.groupBy("group", "function").agg(F.count("*").alias("sites"), F.count_distinct("file").alias("files"))


def api_by_file(calls: DataFrame) -> DataFrame:
    return calls.groupBy("file", "group").agg(F.count("*").alias("sites"), F.min("line").alias("first_line"))


def api_unknown(edges: DataFrame) -> DataFrame:
    """Callees outside the known functions whose name hints at a system interface."""
    name = F.col("callee")
    hint = ((F.length(name) > 3) & name.rlike(r"^\p{Lu}\p{Ll}")) | F.greatest(*[name.startswith(p) for p in SYSTEM_PREFIXES])
    return edges.where(_group(name).isNull() & hint)
