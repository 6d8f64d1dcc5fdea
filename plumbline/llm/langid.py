"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent character n-grams (1 to 3, words padded with blanks) by rank. A document is
given the language from whose profile its own ranks are least out of place; an n-gram that a profile
lacks counts as misplaced by the whole length of the profile.

Null texts, and texts without a letter, have no language: ``und`` and score 0. Ties go to the language
first in order of its name, and equally frequent n-grams rank by their code points. Without labelled text every
document is ``und``. Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import added, extend

PROFILE = 300
UNKNOWN = "und"
# n-grams of one language that a task counts before it hands its counts on.
FLUSH_GRAMS = 1_000_000
# Letters of a long text that are counted at a time.
_CHUNK = 1 << 20
# Stands for a blank; a code point that is no letter, and not 0, so that a blank ahead of a letter is not the letter alone.
_BLANK = 1


def letter_table() -> np.ndarray:
    """For each code point itself if it is a letter, else a blank."""
    points = np.arange(0x110000, dtype=np.int64)
    return np.where([chr(i).isalpha() for i in range(0x110000)], points, _BLANK)


def grams(text: str | None, letters: np.ndarray) -> np.ndarray:
    """Codes of all 1- to 3-grams of the lower-cased words of ``text``; 21 bits for each character."""
    if not text:
        return np.empty(0, np.int64)
    points = letters[np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")]
    points = np.concatenate([[_BLANK], points, [_BLANK]])
    points = points[np.concatenate([[True], (points[1:] != _BLANK) | (points[:-1] != _BLANK)])]  # runs of blanks become one
    if len(points) == 1:
        return np.empty(0, np.int64)
    one, two = points[points != _BLANK], points[:-1] << 21 | points[1:]
    three = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
    return np.concatenate([one, two, three[points[1:-1] != _BLANK]])  # no trigram reaches across two words


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.diff(np.concatenate([first, [len(codes)]]))


def ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, by falling count, then by code."""
    values, counts = _runs(codes)
    if len(values) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        values, counts = values[keep], counts[keep]
    return values[np.lexsort((values, -counts))[:size]]


def gram_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) over all labelled texts: tasks count, sums are combined."""
    schema = "lang string, gram long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        held: dict[str, list] = {}

        def merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
            values, inverse = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
            return values, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)

        def out(name: str) -> pa.RecordBatch:
            values, counts = merge(held.pop(name))
            return pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values), pa.array(counts)], names=["lang", "gram", "n"])

        for batch in batches:
            by: dict[str, list] = {}
            for name, value in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
                for at in range(0, len(value), _CHUNK):
                    by.setdefault(name, []).append(grams(value[at:at + _CHUNK], letters))
                if sum(map(len, by.get(name, []))) > 4_000_000:
                    held.setdefault(name, []).append(_runs(np.concatenate(by.pop(name))))
            for name, codes in by.items():
                codes = np.concatenate(codes)
                if len(codes):
                    held.setdefault(name, []).append(_runs(codes))
            for name in list(held):
                held[name] = [merge(held[name])]
                if len(held[name][0][0]) > FLUSH_GRAMS:
                    yield out(name)
        for name in list(held):
            yield out(name)

    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    return labelled.mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(counts: DataFrame, *, size: int = PROFILE) -> dict[str, np.ndarray]:
    """The ranked n-grams of each language; ``size`` for each is all that reaches the driver."""
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size).select("lang", "gram", "rank").collect()
    made: dict[str, list] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        made.setdefault(row["lang"], []).append(row["gram"])
    return {name: np.array(codes, np.int64) for name, codes in made.items()}


def out_of_place(ranks: np.ndarray, known: tuple[np.ndarray, np.ndarray], size: int) -> float:
    """Mean distance of the document's ranks from those of a profile, from 0 to 1."""
    codes, places = known
    at = np.minimum(np.searchsorted(codes, ranks), len(codes) - 1)
    found = codes[at] == ranks
    return float(np.where(found, np.minimum(np.abs(places[at] - np.arange(len(ranks))), size), size).mean()) / size


def identify(docs: DataFrame, known: dict[str, np.ndarray], *, text: str = "text", size: int = PROFILE) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, which is 1 for a document that ranks like its language's profile.

    The score is what the best profile leaves of the distance to the second best, scaled to 0 to 1.
    """
    schema = added(docs, [("lang_pred", T.StringType()), ("score", T.DoubleType())])
    names = sorted(known)
    sorted_ = [(known[n][order], order) for n in names for order in [np.argsort(known[n])]]

    def guess(value: str | None, letters: np.ndarray) -> tuple[str, float]:
        codes = grams(value, letters)
        if not len(codes) or not names:
            return UNKNOWN, 0.0
        ranks = ranked(codes, size)
        far = [out_of_place(ranks, k, size) for k in sorted_]
        best = int(np.argmin(far))
        others = [f for i, f in enumerate(far) if i != best]
        return names[best], 1.0 - (far[best] / min(others) if others and min(others) > 0 else far[best]) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            made = [guess(v, letters) for v in batch.column(text).to_pylist()]
            yield extend(batch, schema, {"lang_pred": pa.array([m[0] for m in made], pa.string()), "score": pa.array([m[1] for m in made], pa.float64())})

    return docs.mapInArrow(run, schema)


def language_id(docs: DataFrame, train: Column, *, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """Learns from the rows where ``train`` holds and identifies all rows."""
    known = profiles(gram_counts(docs.where(train), text=text, lang=lang), size=size)
    return identify(docs, known, text=text, size=size)
