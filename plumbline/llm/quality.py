"""Quality rules: a decision list learned by sequential covering, in DataFrame and SQL functions alone.

Text statistics are columns. Labelled rows are reduced to bin numbers of the statistics, cut at quantiles, and
counted once for each combination, so growing and pruning rules only sums small counts in Spark. A rule is a
conjunction of thresholds that finds bad documents. It is grown on two thirds of the labelled rows by
information gain, pruned on the rest, and kept if its precision there holds up. Rows it covers are set aside and the next
rule is learned, until no rule is good enough. The list becomes one CASE expression.

Null and empty texts have no words and fail the base rules. Labels that are null or of no document count for
nothing; a document with two labels counts for both. Without labelled rows of both kinds the list is empty.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import SPACE_CLASS

MIN_WORDS = 50
BINS = 24
MAX_RULES = 12
MAX_CONDITIONS = 3
MIN_PRECISION = 0.9
MIN_COVER = 5


def _once(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed a single time."""
    return F.element_at(F.transform(F.array(value), then), 1)


def repeated_words(words: Column) -> Column:
    """Words that stand in a three-word window found twice or more.

    Hashes of all windows are sorted first, which settles texts without a repeat. Else (hash, place) pairs are
    sorted, places next to an equal hash are taken, and each counts the words up to the next place, three at most.
    """
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

        def of_pairs(s: Column) -> Column:
            last = F.size(s)
            same = lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j < last - 1) & (F.get(s, j + 1)["h"] == x["h"]))
            places = F.array_sort(F.transform(F.filter(s, same), lambda x: x["at"]))
            return _once(places, lambda p: F.aggregate(
                F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))

        repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(repeats, _once(pairs, of_pairs)).otherwise(F.lit(0))

    return F.when(n < 3, F.lit(0)).otherwise(_once(windows, covered))


def statistics(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars, n_upper of every whole text."""
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(F.col(doc_id).alias("doc_id"), body.alias("t"), F.array_remove(F.split(body, SPACE_CLASS + "+"), "").alias("w"),
                        F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"))
    return split.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.char_length("t").cast("long").alias("n_chars"), F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"))


# The measures that conditions may use, from the columns of ``statistics``.
MEASURES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "cast(n_dup_lines AS double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "words": "cast(n_words AS double)",
}

Condition = tuple[str, str, float]  # measure, ">" or "<=", threshold


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_column(rule: list[Condition]) -> Column:
    parts = [F.expr(f"({MEASURES[m]}) {op} {threshold!r}D") for m, op, threshold in rule]
    return reduce(lambda a, b: a & b, parts)


def verdict(rules: list[list[Condition]]) -> Column:
    """Number of the first rule that a row falls under, from 1; 0 if none does."""
    out = F
    for i, rule in enumerate(rules):
        out = out.when(rule_column(rule), F.lit(i + 1))
    return out.otherwise(F.lit(0)) if rules else F.lit(0)


def binned(labelled: DataFrame, bins: int) -> tuple[DataFrame, dict[str, list[float]]]:
    """Counts of labelled rows by bin numbers, label (bad) and part (grow), and the cuts between bins.

    A bin number is how many cuts a value exceeds. Cuts are quantiles of the good and of the bad rows.
    """
    shares = [0.0, 0.02] + [i / bins for i in range(1, bins)] + [0.98, 1.0]
    rows = labelled.groupBy("bad").agg(*[F.percentile_approx(F.expr(e), shares, 20_000).alias(m) for m, e in MEASURES.items()]).collect()
    cuts = {m: sorted({c for row in rows for c in row[m] or []}) for m in MEASURES}
    number = [reduce(lambda a, b: a + b, [(F.expr(e) > c).cast("int") for c in cuts[m]], F.lit(0)).alias(m) for m, e in MEASURES.items()]
    return labelled.select(*number, "bad", "grow").groupBy(*MEASURES, "bad", "grow").agg(F.count("*").alias("n")), cuts


def _holds(conditions: list[tuple[str, str, int]]) -> Column:
    """Conditions over bin numbers: above the i-th cut (from 0) means a number over i."""
    return reduce(lambda a, b: a & b, [F.col(m) > i if op == ">" else F.col(m) <= i for m, op, i in conditions], F.lit(True))


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2((p + 1e-9) / (p + n + 1e-9)) - math.log2((p0 + 1e-9) / (p0 + n0 + 1e-9))) if p else -math.inf


def learn(stats: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", label: str = "quality", bad: int = 0, bins: int = BINS, max_rules: int = MAX_RULES,
          max_conditions: int = MAX_CONDITIONS, min_precision: float = MIN_PRECISION, min_cover: int = MIN_COVER) -> list[list[Condition]]:
    """The ordered rules for documents labelled ``bad``, from all labelled rows that pass the base rules."""
    marked = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("doc_id"), (F.col(label) == bad).alias("bad"))
    labelled = stats.where(~base_failed()).join(marked, "doc_id").withColumn("grow", F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0)
    table, cuts = binned(cut_lineage(labelled), bins)
    table = cut_lineage(table)
    options = [(m, op, i) for m in MEASURES for op in (">", "<=") for i in range(len(cuts[m]))]
    rules: list[list[tuple[str, str, int]]] = []

    def counts(frame: DataFrame, grow: bool, tried: list[Column]) -> list[tuple[int, int]]:
        """(bad, good) rows under each condition tried."""
        sums = [F.sum(F.when(c & (F.col("bad") == b), F.col("n")).otherwise(0)) for c in tried for b in (F.lit(True), F.lit(False))]
        row = frame.where(F.col("grow") == grow).agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
        return [(row[2 * i] or 0, row[2 * i + 1] or 0) for i in range(len(tried))]

    def counts_of_all(frame: DataFrame) -> list[tuple[int, int]]:
        """(bad, good) growing rows under each of the options: one count by measure, bin and label, summed up from bin to bin."""
        places = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("int").alias("bin")) for m in MEASURES]))
        rows = frame.where("grow").select(places.alias("p"), "bad", "n").groupBy("p.m", "p.bin", "bad").agg(F.sum("n").alias("n")).collect()
        by_bin = {m: [[0, 0] for _ in range(len(cuts[m]) + 1)] for m in MEASURES}
        for r in rows:
            by_bin[r["m"]][r["bin"]][0 if r["bad"] else 1] += r["n"]
        upto = {m: [tuple(map(sum, zip(*by_bin[m][:i + 1]))) for i in range(len(by_bin[m]))] for m in MEASURES}
        return [upto[m][i] if op == "<=" else tuple(a - b for a, b in zip(upto[m][-1], upto[m][i])) for m, op, i in options]

    left = table
    while options and len(rules) < max_rules:
        rule: list[tuple[str, str, int]] = []
        p0, n0 = counts(left, True, [F.lit(True)])[0]
        if p0 < min_cover:
            break
        inside = left
        while len(rule) < max_conditions and n0:
            found = counts_of_all(inside)
            # Of conditions that gain alike the widest wins.
            best = max(range(len(options)), key=lambda i: (_gain(*found[i], p0, n0), options[i][2] if options[i][1] == "<=" else -options[i][2], -i))
            if _gain(*found[best], p0, n0) <= 0:
                break
            rule.append(options[best])
            p0, n0 = found[best]
            inside = inside.where(_holds([options[best]]))
        if not rule:
            break
        shorter = [rule[:k] for k in range(1, len(rule) + 1)]
        held = counts(left, False, [_holds(r) for r in shorter])
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in held]
        best = max(range(len(shorter)), key=lambda k: (worth[k], -k))
        p, n = held[best]
        if p + n < max(1, min_cover // 2) or p < min_precision * (p + n):
            break
        rules.append(shorter[best])
        left = left.where(~_holds(shorter[best]))
    # Halfway to the next cut, a threshold keeps clear of the good and the bad rows beside it.
    return [[(m, op, float(cuts[m][i] + cuts[m][min(i + 1, len(cuts[m]) - 1)]) / 2) for m, op, i in rule] for rule in rules]


def judged(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """The statistics with base_failed, rule (0: none) and kept."""
    stats = cut_lineage(statistics(docs, text=text, doc_id=doc_id))
    rules = learn(stats, labels, doc_id=doc_id, label=label)
    failed = base_failed()
    return stats.withColumn("base_failed", failed).withColumn("rule", verdict(rules)).withColumn("kept", ~failed & (F.col("rule") == 0))
