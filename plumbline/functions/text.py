"""Text columns: paths, lines, and all matches of a pattern with their line numbers."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a costly column that several later expressions and filters use.

    As a plain projection it would be copied into each of them and computed again; the generator
    keeps it in its place.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Extension with its dot; '' for none, for a leading dot alone and for a trailing dot."""
    return F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.left(name, F.length(name) - F.length(suffix(path)))


def newline_count(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint")


LINE_END = r"\R|[\x1c\x1d\x1e]"
# Any end of a line but a plain newline.
RARE_LINE_END = r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def line_end_count(text: Column) -> Column:
    """Line ends of all kinds; only texts with one that isn't a plain newline are searched for them."""
    return F.when(text.rlike(RARE_LINE_END), F.regexp_count(text, F.lit(LINE_END)).cast("bigint")).otherwise(newline_count(text))


def line_array(text: Column) -> Column:
    r"""Lines without their ends; a final line end opens no further line.

    ``\R`` covers the line ends in use; the three information separators are added to match the
    usual universal-newline rule.
    """
    return let(
        F.split(text, LINE_END),
        lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts),
    )


def line_total(text: Column) -> Column:
    return F.size(line_array(text)).cast("bigint")


def explode_lines(corpus: DataFrame, *keep: str) -> DataFrame:
    """(path, content) to (path, line, text), numbered from 1, and the columns to ``keep``; no shuffle."""
    return corpus.select(
        "path", *keep, F.posexplode(line_array(F.col("content"))).alias("_i", "text")
    ).select("path", (F.col("_i") + 1).cast("bigint").alias("line"), "text", *keep)


# Characters that count as white space at the ends of a text.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def strip_line(line: Column, plain: Column) -> Column:
    """:func:`strip` of one line of :func:`line_array`. A ``plain`` one, all ASCII, can hold no white space but blanks, tabs and unit separators,
    and most have blanks alone, which Spark trims without a look at what is between the ends."""
    blanks = ~line.contains("\t") & ~line.contains("\x1f")
    return F.when(plain & blanks, F.trim(line)).when(plain, F.btrim(line, F.lit(" \t\x1f"))).otherwise(strip(line))


def comma_parts(text: Column) -> Column:
    """Trimmed, non-empty comma-separated parts."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda part: part != "")


# Set between matches and what is around them to cut a text; texts that hold it are searched once for each part instead.
MARK = "\x01"


def cut_at(content: Column, pattern: str, line_end: str = "\n", groups: tuple[int, ...] = (), *, tail: bool = True) -> Column:
    """Array of (before, hit, g1, g2, ...): each match of ``pattern``, the line ends in the text before it, and what its ``groups`` hold,
    '' for nothing. One search tells all of it.

    The last element has no hit; without ``tail`` it is left out. The line of a match is a running sum over the array, see
    :func:`with_lines`.
    """
    count = {"\n": newline_count, LINE_END: line_end_count}[line_end]
    parts = {"hit": 0, **{f"g{g}": g for g in groups}}
    width = len(parts) + 1
    searched = F.arrays_zip(
        F.transform(F.split(content, pattern, -1), count).alias("before"),
        *[F.regexp_extract_all(content, F.lit(pattern), F.lit(g)).alias(name) for name, g in parts.items()])

    def of_pieces(pieces: Column) -> Column:
        hits = ((F.size(pieces) - 1) / width).cast("int")
        places = F.sequence(F.lit(0), hits) if tail else F.slice(F.sequence(F.lit(0), hits), F.lit(1), hits)
        return F.transform(places, lambda i: F.struct(
            count(pieces[i * width]).alias("before"), *[F.get(pieces, i * width + k).alias(name) for k, name in enumerate(parts, 1)]))

    if not tail:
        searched = F.filter(searched, lambda z: z["hit"].isNotNull())
    marked = F.regexp_replace(content, pattern, "".join(f"{MARK}${g}" for g in parts.values()) + MARK)
    return F.when(content.contains(MARK), searched).when(content.isNotNull(), let(F.split(marked, MARK, -1), of_pieces))


def with_lines(rows: DataFrame, *group: str, order: str = "ordinal") -> DataFrame:
    """Adds ``line`` to exploded (before, hit) rows and drops the ends without a hit.

    The rows hold counts and short matches, no content, and one file bounds each group.
    """
    inside = F.coalesce(newline_count(F.col("hit")), F.lit(0))
    upto = Window.partitionBy(*group).orderBy(order)
    line = F.sum(F.col("before") + inside).over(upto) - inside + 1
    return rows.withColumn("line", line).where(F.col("hit").isNotNull())


def line_of(content: Column, token: Column) -> Column:
    """Line of the first occurrence of ``token``, 0 when it does not occur."""
    at = F.position(token, content)
    return F.when(at > 0, newline_count(F.left(content, at - 1)) + 1).otherwise(F.lit(0).cast("bigint"))


def any_of(words: tuple[str, ...]) -> str:
    """A pattern that finds any of the words, none of them empty. Their common beginnings are tried once, and only where one of them can start, so a search costs
    about the same however many words there are."""
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def written(node: dict) -> str:
        if "" in node:  # a shorter word tells it already
            return ""
        ways = [re.escape(letter) + written(below) for letter, below in node.items()]
        return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"

    return f"(?=[{''.join(map(re.escape, tree))}])" + written(tree)


# Names of one file that are looked up one by one.
FEW_NAMES = 8


def lines_of(content: str, names: list[str]) -> list[int]:
    """Line of the first occurrence of each name, in one pass over the content however many names there are."""
    import ahocorasick

    found: dict[str, int] = {}
    searched = ahocorasick.Automaton()
    for name in set(names):
        if name:
            searched.add_word(name, name)
    if len(searched):
        searched.make_automaton()
        for end, name in searched.iter(content):
            if name not in found:
                found[name] = end - len(name) + 1
                if len(found) == len(searched):
                    break
    ends = [m.start() for m in re.finditer("\n", content)]
    return [bisect_left(ends, found[n]) + 1 if n in found else int(not n) for n in names]


def first_lines(content: Column, names: Column) -> Column:
    """:func:`line_of` for each of ``names``, which hold no line end; files with many names send their content to one linear search."""

    @F.pandas_udf("array<bigint>")
    def many(asked: pd.Series) -> pd.Series:
        def of_file(count: str, rest: str) -> list[int]:
            *wanted, text = rest.split("\n", int(count))
            return lines_of(text, wanted)

        return pd.Series([None if a is None else of_file(*a.split("\n", 1)) for a in asked], dtype=object)

    # Null for few names, so that they are looked for once here and once below; else how many names, the names and the content, in one text,
    # as lists take Spark longer to send, even null ones.
    asked = let(names, lambda n: F.when(F.size(n) > FEW_NAMES, F.concat_ws("\n", F.size(n).cast("string"), n, content)))
    return F.coalesce(many(asked), F.transform(names, lambda n: line_of(content, n)))
