"""Decisions written into source code: intent comments, constants, timing, byte data, threading.

One pass over the lines finds everything, without a shuffle; the first-per-file threading tokens
and the multi-line byte arrays each add one shuffle of small rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import written

# Patterns of the scanners.
INTENT = (r"(?iUd)(?://|#|/\*|\*)\s*(TODO|FIXME|HACK|NOTE|WORKAROUND|BUG|OPTIMIZE|REVIEW|XXX|IMPORTANT|WARNING)"
          r"\s*:?\s*(.+)")
NUMBER = r"(?U)\b(0x[0-9A-Fa-f]{2,8}|[0-9]{3,})\b"
TIMEOUT = r"(?iU)(?:timeout|delay|sleep|wait|interval|period|ms|msec|millisec)\s*[=:]\s*(\d+)"
RETRY = r"(?iU)(?:retry|retries|attempts|max_attempts|max_retry)\s*[=:]\s*(\d+)"
# Two bytes show a run and four a command, however many follow.
BYTE_RUN = r"(?U)0x[0-9A-Fa-f]{2}[,\s]++0x[0-9A-Fa-f]{2}[,\s]"
COMMAND_BYTES = r"(?U)(?:0x[0-9A-Fa-f]{2},?\s*+){4}"
THREADING = r"(?iU)\b(Thread|threading|mutex|semaphore|lock|async|await|concurrent|queue|event|signal)\b"
CARD_CONSTANT = r"(?U)\bSCARD_[A-Z_]+\b"
SHARE_MODE = r"SCARD_SHARE_(SHARED|EXCLUSIVE|DIRECT)"
DISPOSITION = r"SCARD_(LEAVE_CARD|RESET_CARD|UNPOWER_CARD|EJECT_CARD)"
# Nothing is given back, as a file's blank lines may be many.
ARRAY_START = r"(?U)(?:byte|uint8|BYTE|char)\s*+\w*+\s*+\["
HEX_BYTE = r"0x[0-9A-Fa-f]{2}"

# Signs without which a line can't match, so that most lines meet no pattern. Case folds more letters than ASCII ones into
# those of a word, so only plain lines are told by words.
INTENT_SIGNS = ("//", "#", "*")
SETTING = r"(?U)[=:]\s*\d"
SETTING_SIGNS = ("=", ":")
HEX_SIGN = "0x"
CARD_SIGN = "SCARD_"
ARRAY_SIGN = "["
THREADING_SIGNS = ("thread", "mutex", "semaphore", "lock", "async", "await", "concurrent", "queue", "event", "signal")

# Texts of the descriptions.
BYTE_RUN_TEXT = "Hardcoded byte sequence (possible APDU or device command)"
COMMAND_TEXT = "Possible APDU command bytes"
SHARE_TEXT = "PC/SC share mode choice: {} — affects multi-app access"
DISPOSITION_TEXT = "PC/SC card disposition on disconnect: {} — affects card state"

# Constants not reported, line starts of comments, urgent tags, critical kinds.
CARD_CONSTANTS_IGNORED = ("SCARD_S_SUCCESS", "SCARD_E_NO_SERVICE")
COMMENT_STARTS = ("//", "#", "*", "/*")
URGENT_TAGS = ("HACK", "WORKAROUND", "BUG", "FIXME")
CRITICAL_KINDS = ("protocol", "constant")

DECISIONS = "array<struct<kind:string,description:string,snippet:string>>"
COLUMNS = ("kind", "description", "file", "line", "snippet", "rationale")


def _line() -> Column:
    return F.col("text")


def _bare() -> Column:
    return F.col("bare")


def _any(line: Column, signs: tuple[str, ...]) -> Column:
    found = line.contains(signs[0])
    for sign in signs[1:]:
        found = found | line.contains(sign)
    return found


def _like(pattern: str, *signs: str) -> Column:
    """The line matches, which it is asked only if it holds one of the signs."""
    return _any(_line(), signs) & _line().rlike(pattern)


def _decision(kind: str, description: Column, snippet: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), description.alias("description"), snippet.alias("snippet"))


def _none() -> Column:
    return F.array().cast(DECISIONS)


def _one(condition: Column, kind: str, description: Column, snippet: Column | None = None) -> Column:
    """An array with one decision or none."""
    decision = _decision(kind, description, _bare() if snippet is None else snippet)
    return F.when(condition, F.array(decision).cast(DECISIONS)).otherwise(_none())


def _asked(sign: Column, *arrays: Column) -> Column:
    """Decisions that only a line with the sign can tell."""
    return F.when(sign, F.concat(*arrays)).otherwise(_none())


def _worded(template: str, value: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def comment() -> Column:
    tag, rest = F.regexp_extract("text", INTENT, 1), F.regexp_extract("text", INTENT, 2)
    return _one(_like(INTENT, *INTENT_SIGNS), "comment", F.concat(tag, F.lit(": "), text.strip(rest)), _bare())


def _in_code() -> Column:
    return ~F.greatest(*[_bare().startswith(s) for s in COMMENT_STARTS])


def byte_sequence() -> Column:
    """A run of byte literals, or command-like bytes with FF or 00 among them."""
    run = _like(BYTE_RUN, HEX_SIGN)
    marked = _line().contains("0x00") | F.upper("text").contains("FF")
    command = ~run & _like(COMMAND_BYTES, HEX_SIGN) & marked
    return _asked(_line().contains(HEX_SIGN) & _in_code(), _one(run, "protocol", F.lit(BYTE_RUN_TEXT)), _one(command, "protocol", F.lit(COMMAND_TEXT)))


def constant() -> Column:
    """Hex literals of six or more characters, outside comments and byte runs."""
    numbers = F.regexp_extract_all("text", F.lit(NUMBER), F.lit(1))
    hexes = F.filter(numbers, lambda v: v.startswith("0x") & (F.length(v) >= 6))
    rows = F.transform(hexes, lambda v: _decision("constant", F.concat(F.lit("Hardcoded hex constant: "), v), _bare()))
    asked = _line().contains(HEX_SIGN) & _in_code() & ~_line().rlike(BYTE_RUN)
    return F.when(asked, rows).otherwise(_none())


def timing() -> Column:
    return _asked(
        _like(SETTING, *SETTING_SIGNS),
        _one(_line().rlike(TIMEOUT), "constant", F.concat(F.lit("Timing decision: "), _bare())),
        _one(_line().rlike(RETRY), "constant", F.concat(F.lit("Retry/attempt limit: "), _bare())),
    )


def smart_card() -> Column:
    """Share mode, disposition, and the first other constant of a line."""
    constants = F.regexp_extract_all("text", F.lit(CARD_CONSTANT), F.lit(0))
    first = F.get(F.filter(constants, lambda v: ~v.isin(*CARD_CONSTANTS_IGNORED)), F.lit(0))
    return _asked(
        _line().contains(CARD_SIGN),
        _one(_line().rlike(SHARE_MODE), "protocol", _worded(SHARE_TEXT, F.regexp_extract("text", SHARE_MODE, 0))),
        _one(_line().rlike(DISPOSITION), "protocol", _worded(DISPOSITION_TEXT, F.regexp_extract("text", DISPOSITION, 0))),
        _one(first.isNotNull(), "protocol", F.concat(F.lit("PC/SC constant usage: "), first)),
    )


LINE_SCANNERS = {"comment": comment, "byteseq": byte_sequence, "constant": constant, "timing": timing, "winscard": smart_card}


def scan_lines(corpus: DataFrame, *scanners: str) -> DataFrame:
    """One narrow row per line with what the scanners found; unused columns are pruned away.

    What ends a byte array, and its bytes, are told only in files that declare one.
    """
    line, found = F.col("text"), F.concat(*[LINE_SCANNERS[s]() for s in (scanners or tuple(LINE_SCANNERS))])
    content = F.col("content")
    files = corpus.select("path", "content", (content.contains(ARRAY_SIGN) & content.rlike(ARRAY_START)).alias("declares"))
    plain = F.octet_length(line) == F.length(line)
    lines = text.explode_lines(files, "declares").withColumns({"bare": text.strip_line(line, plain), "lower": F.lower(line), "plain": plain})
    concurrent = ~F.col("plain") | _any(F.col("lower"), THREADING_SIGNS)
    return lines.select(
        F.col("path").alias("file"), "line", found.alias("found"),
        F.when(concurrent, F.nullif(F.lower(F.regexp_extract(line, THREADING, 1)), F.lit(""))).alias("token"),
        F.col("bare").alias("snippet"),
        (F.col("declares") & _like(ARRAY_START, ARRAY_SIGN)).alias("starts"),
        (F.col("declares") & (line.contains(";") | line.contains("}"))).alias("ends"),
        F.when(F.col("declares") & line.contains(HEX_SIGN), F.regexp_extract_all(line, F.lit(HEX_BYTE), F.lit(0))).otherwise(
            F.array().cast("array<string>")).alias("bytes"),
    )


def _shape(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rationale", F.lit(None).cast("string")).select(*COLUMNS)


def line_decisions(lines: DataFrame) -> DataFrame:
    """Decisions a single line tells."""
    return _shape(lines.select("file", "line", F.inline("found")))


def threading(lines: DataFrame) -> DataFrame:
    """First line of each concurrency word per file; only the first word of a line counts."""
    first = lines.where(F.col("token").isNotNull()).groupBy("file", "token").agg(F.min(F.struct("line", "snippet")).alias("f"))
    return _shape(first.select(
        F.lit("threading").alias("kind"), F.concat(F.lit("Concurrency/threading: "), F.col("token")).alias("description"),
        "file", "f.line", "f.snippet"))


def byte_arrays(lines: DataFrame) -> DataFrame:
    """Arrays of at least four byte literals from their declaration to the first ``;`` or ``}``.

    A new declaration before the end starts over. Lines are grouped by a running count of
    declarations; only line numbers and byte literals are shuffled.
    """
    lines = lines.select("file", "line", "starts", "ends", "bytes").where(
        F.col("starts") | F.col("ends") | (F.size("bytes") > 0))
    above = Window.partitionBy("file").orderBy("line")
    grouped = lines.withColumn("array_id", F.count_if("starts").over(above)).where(F.col("array_id") > 0)
    ended_before = F.count_if("ends").over(
        Window.partitionBy("file", "array_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    inside = grouped.withColumn("ended_before", ended_before).where(F.col("ended_before") == 0)
    arrays = inside.groupBy("file", "array_id").agg(
        F.min("line").alias("line"), F.bool_or("ends").alias("closed"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line", "bytes"))), lambda s: s["bytes"])).alias("bytes"),
    ).where(F.col("closed") & (F.size("bytes") >= 4))
    count = F.size("bytes")
    description = F.concat(F.lit("Byte array ("), count.cast("string"), F.lit(" bytes): "), F.array_join("bytes", " "))
    return _shape(arrays.select(
        F.lit("protocol").alias("kind"), description.alias("description"), "file", "line",
        F.concat(F.lit("Array starting line "), F.col("line").cast("string")).alias("snippet")))


def decisions(corpus: DataFrame) -> DataFrame:
    """All decisions. The lines that tell anything are written once, so the content is read once, and each reader takes its columns."""
    lines = scan_lines(corpus)
    telling = (F.size("found") > 0) | F.col("token").isNotNull() | F.col("starts") | F.col("ends") | (F.size("bytes") > 0)
    kept = written(lines.where(telling).withColumn("snippet", F.when(F.col("token").isNotNull(), F.col("snippet"))))
    return line_decisions(kept).unionByName(threading(kept)).unionByName(byte_arrays(kept))


def critical(rows: DataFrame) -> DataFrame:
    urgent = F.greatest(*[F.col("description").startswith(t) for t in URGENT_TAGS])
    return rows.where(F.col("kind").isin(*CRITICAL_KINDS) | ((F.col("kind") == "comment") & urgent))


def by_kind(rows: DataFrame) -> DataFrame:
    """Decisions per kind, most frequent first."""
    return rows.groupBy("kind").agg(F.count("*").alias("decisions"), F.count_distinct("file").alias("files")).orderBy(
        F.desc("decisions"), F.asc("kind"))


def summary(rows: DataFrame) -> DataFrame:
    """One line of text with the total and the count of each kind."""
    counts = rows.groupBy("kind").agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "kind")))
    parts = F.transform(listed, lambda s: F.concat((-s["n"]).cast("string"), F.lit(" "), s["kind"]))
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("string")
    return counts.agg(F.concat(F.lit("Found "), total, F.lit(" decisions: "), F.array_join(parts, ", ")).alias("summary"))
