"""Operators that SQL can't express against plain versions of their methods."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontam, langid, lexical, toxicity
from plumbline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    out = Counter(c for w in words for c in w)
    line = f" {' '.join(words)} "
    if words:
        out.update(line[i:i + 2] for i in range(len(line) - 1))
        out.update(line[i:i + 3] for i in range(len(line) - 2) if line[i + 1] != " ")
    return out


def rank_list(counts):
    """The 300 most frequent; equal ones as the operator numbers them: shorter first, then by code points, a blank first."""
    place = lambda g: (-counts[g], len(g), [1 if c == " " else ord(c) for c in g])
    return sorted(counts, key=place)[:300]


def test_op5_like_plain_profiles(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").toPandas()
    learned = {}
    for row in docs.itertuples():
        if zlib.crc32(str(row.doc_id).encode()) % 3 != 1 and row.text is not None and row.lang is not None:
            learned.setdefault(row.lang, Counter()).update(plain_grams(row.text))
    profiles = {lang: {g: i for i, g in enumerate(rank_list(c))} for lang, c in learned.items()}
    got = {r.doc_id: r for r in QUERIES["op5_rank_order_language_id"](spark, FOLDER).collect()}
    for row in docs.itertuples():
        own = rank_list(plain_grams(row.text))
        if not own:
            assert (got[row.doc_id].lang_pred, got[row.doc_id].score) == ("und", 0.0)
            continue
        far = {lang: sum(min(abs(p[g] - i), 300) if g in p else 300 for i, g in enumerate(own)) / len(own) / 300 for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        second = min(f for lang, f in far.items() if lang != best)
        assert got[row.doc_id].lang_pred == best and got[row.doc_id].score == pytest.approx(1 - far[best] / second / 2)


def test_a_blank_ahead_of_a_letter_is_a_gram_of_its_own():
    assert len(set(langid.grams("b", langid.letter_table()).tolist())) == 4  # b, blank b, b blank, blank b blank


def bucket(gram):
    h = ord(gram[0])
    for c in gram[1:]:
        h = (h * 0x100000001B3 + ord(c)) % 2**64
    return (h + len(gram)) * 0x9E3779B97F4A7C15 % 2**64 >> 46


def plain_buckets(text):
    return {bucket(w[i:i + n]) for w in (f" {w} " for w in text.lower().split()) for n in (3, 4, 5, 6) for i in range(len(w) - n + 1)}


def test_op8_like_a_plain_fit(spark):
    rng = random.Random(12)
    mild, rude = (["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(25)] for letters in ("abcde", "vwxyz"))
    texts = [" ".join(rng.choice(rude if i % 3 == 0 and rng.random() < 0.3 else mild) for _ in range(30)) for i in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    weights, bias = toxicity.classifier(docs, labels, F.col("doc_id") < 60)

    sets, y = [plain_buckets(t) for t in texts], np.array([i % 3 == 0 for i in range(60)], float)
    seen = Counter(b for s in sets[:60] for b in s)
    kept = sorted(b for b, n in seen.items() if n >= 3)
    toxic = Counter(b for s, t in zip(sets, y) if t for b in s)
    ratio = np.array([math.log((toxic[b] + 1) / (y.sum() + 2) / ((seen[b] - toxic[b] + 1) / (60 - y.sum() + 2))) for b in kept])
    x = np.array([[b in s for b in kept] for s in sets], float) * ratio

    def loss(w, b):
        z = x[:60] @ w + b
        return (np.logaddexp(0, z) - y * z).sum() + 4.0 * (w @ w)

    w, b = np.zeros(len(kept)), 0.0
    for _ in range(100):  # Newton's method on the same loss
        p = 1 / (1 + np.exp(-(x[:60] @ w + b)))
        ones = np.column_stack([x[:60], np.ones(60)])
        g = ones.T @ (p - y) + np.append(8.0 * w, 0)
        h = (ones * (p * (1 - p))[:, None]).T @ ones + np.diag([8.0] * len(kept) + [1e-9])
        step = np.linalg.solve(h, g)
        w, b = w - step[:-1], b - step[-1]
    fitted = np.divide(weights[kept], ratio, out=np.zeros(len(kept)), where=ratio != 0)
    assert set(np.flatnonzero(weights)) <= set(kept)
    # Its steps are a fixed number: they close all but a hundredth of the gap between no weights and the best ones.
    none, least = loss(np.zeros(len(kept)), math.log(y.mean() / (1 - y.mean()))), loss(w, b)
    assert loss(fitted, bias) - least <= 0.01 * (none - least)
    got = {r.doc_id: r for r in toxicity.score(docs, (weights, bias)).collect()}
    for i, s in enumerate(sets):
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-(sum(weights[k] for k in s) + bias))))
    plain = 1 / (1 + np.exp(-(x @ w + b)))
    assert all((got[i].score >= 0.5) == (plain[i] >= 0.5) for i in range(90) if abs(plain[i] - 0.5) > 0.1)


def test_seeds_and_left_out_items_like_all_items():
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(("the", "a", "cat", "dog", "sat", "on", "mat")) for _ in range(n))
    for _ in range(40):
        items = [(i, text(rng.choice((0, 1, 3, 4, 5, 8, 20)))) for i in range(12)] + [(12, None)]
        doc = f"{text(30)} strange {items[5][1]} words {text(15)}"
        known = decontam.Items(items, 5)
        vocabulary = {}
        ids = lambda t: [vocabulary.setdefault(w, len(vocabulary)) for w in decontam.words_of(t)]
        plain = {}
        for i, body in items:
            found = decontam.tiles(ids(doc), ids(body), min(5, len(ids(body)))) if ids(body) else []
            if found:
                plain[i] = found
        assert dict(known.compare(doc)) == plain
        share = lambda i, found: sum(f[2] for f in found) / len(ids(items[i][1]))
        for least in (0.5, 0.9):
            got = {i: t for i, t in known.compare(doc, least) if share(i, t) >= least}
            assert got == {i: t for i, t in plain.items() if share(i, t) >= least}


def test_search_in_small_blocks_of_documents(spark, monkeypatch):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("abcdefghij") for _ in range(n))
    docs = spark.createDataFrame([(i, text(rng.randint(0, 12))) for i in range(300)], "doc_id long, text string").repartition(3).cache()
    items = spark.createDataFrame([(i, text(4)) for i in range(10)], "item_id long, text string")
    rows = lambda: sorted(map(tuple, lexical.search(docs, items, k=7).collect()))
    whole = rows()
    monkeypatch.setattr(lexical, "BLOCK_MARKS", 40)
    assert rows() == whole and len(whole) == 70
