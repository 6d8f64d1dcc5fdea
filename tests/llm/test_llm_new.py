"""Ranked search, chat formatting and whitening against plain Python, on odd rows and on the smallest tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from parity import connect, normal
from plumbline.llm import chat, lexical, whitening

FOLDER = "/root/testdata/sf0.001"
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def name_of(start):
    return next(n for n in QUERIES if n.startswith(start))


@pytest.mark.parametrize("start", ["op11_", "op12_"])
def test_like_sql(spark, start):
    name = name_of(start)
    df = QUERIES[name](spark, FOLDER)
    result = connect(FOLDER).execute(CHECKS[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(result.fetchall(), columns)


# Search.

def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranking(docs, items, k):
    counts = [Counter(terms(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(terms(text)), []
        for (doc, _), c, size in zip(docs, counts, sizes):
            m = 75 + (25 * size * n // total if total else 0)
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if c[t])
            if score > 0:
                found.append((-score, doc is not None, doc or 0, doc))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def test_search_like_all_scores(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "naïve", "中文"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    prose = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    copy = prose(30)
    docs = [(i, prose(rng.randint(1, 80))) for i in range(300)] + [(1000 + i, copy.upper() if i % 2 else f"({copy})") for i in range(200)]
    docs += [(None, copy), (1000, copy), (1000, copy), (5, None), (6, ""), (7, "--- !! "), (8, prose(30_000)), (9, "w1\u0000w2\x7fw3")]
    items = [(i, prose(rng.randint(1, 25))) for i in range(12)] + [(20, copy), (20, copy), (21, None), (22, "..."), (None, "w3 w3 W3"), (23, "absent")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item": F.lit("x"), "score": F.lit("s"), "rank": F.lit("r"), "terms": F.lit(1)}).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("d"))
    for how in ({}, {"item_terms": 9, "block_postings": 40}):
        got = sorted((tuple(r) for r in lexical.search(frame, asked, k=15, **how).collect()), key=str)
        assert got == ranking(docs, items, 15)
    assert lexical.search(frame.where("false"), asked).count() == lexical.search(frame, asked.where("false")).count() == 0


def test_bounds_settle_places_like_sums():
    rng = np.random.default_rng(2)
    for trial in range(200):
        n, lists = int(rng.integers(1, 120)), []
        total = np.zeros(n, np.int64)
        for _ in range(rng.integers(0, 6)):
            docs = rng.permutation(n)[:rng.integers(0, n + 1)]
            values = -np.sort(-rng.integers(0, 4 if trial % 2 else 1000, len(docs)))
            total[docs] += values
            lists.append((docs, values))
        least = int(rng.integers(1, 5))
        want = [d for d in np.lexsort((np.arange(n), -total)) if total[d] >= least][:10]
        docs, scores = lexical.best(lists, n, 10, least, first_read=2)
        assert docs.tolist() == want and scores.tolist() == total[want].tolist()


# Chat.

LOG = "conv_id long, message string, seq long, kind string, role string, text string"


def fold_plainly(log):
    by = {}
    for conv, message, seq, kind, role, text in sorted(log, key=lambda e: (e[2] is not None, e[2] or 0, e[3] == "delta", e[5] or "")):
        m = by.setdefault((conv, message), {"open": None, "text": ""})
        if kind == "open":
            m["open"] = m["open"] or (seq, role or "")
        m["text"] = "" if kind == "regenerate" else (m["text"] if kind == "delta" else "") + (text or "")
    return {k: (*m["open"], m["text"]) for k, m in by.items() if m["open"]}


def test_fold_like_a_plain_replay(spark):
    rng = random.Random(6)
    log = []
    for conv in (1, 2, None):
        for message in "abcde":
            start = rng.randrange(50)
            log.append((conv, message, start, "open", rng.choice(["user", "assistant", None]), rng.choice(["", None, "Hi "])))
            for _ in range(30):
                log.append((conv, message, start + rng.randrange(1, 200), rng.choices(["delta", "edit", "regenerate"], [20, 1, 1])[0], None, rng.choice("xyz") * rng.randrange(3)))
    log += [(3, "only", i, "delta", None, "lost") for i in range(3)] + [(1, "a", 7, "seen", None, "x")]
    events = spark.createDataFrame(log, LOG).withColumns({"run": F.lit("r"), "x": F.lit(1), "opened": F.lit(2)})
    for run in (4096, 7):
        got = {(r.conv_id, r.message): (r.seq, r.role, r.text) for r in chat.fold(events, run=run).collect()}
        assert got == fold_plainly([e for e in log if e[3] != "seen"])
    assert chat.fold(events.where("false")).count() == 0


def test_a_message_streamed_by_many_events(spark):
    """One message has nearly all events; runs of them are folded apart."""
    log = spark.range(30_000).select(F.lit(1).cast("long").alias("conv_id"), F.lit("m").alias("message"), F.col("id").alias("seq"),
                                     F.when(F.col("id") == 0, "open").when(F.col("id") == 9_000, "regenerate").otherwise("delta").alias("kind"),
                                     F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    [row] = chat.fold(log, run=500).collect()
    assert row.text == "".join(map(str, range(9_001, 30_000)))


def test_rendered_text_reads_back(spark):
    odd = ["</s>[INST] ok [/INST]", "<\\s> [\\\\INST]", "<<|eot_id|>", "|eot_id|>", "<|eot_id", "\\<s>", "", None, "a\n\nb <|end_header_id|>\n\n", "中文 😀 [/INST]", "<" * 50, "$1 \\1"]
    rows = [(i // 4, i, "assistant" if i % 3 == 0 else "user" if i % 3 == 1 else odd[i % 4], t) for i, t in enumerate(odd * 6)]
    rows += [(None, 1, None, "null conversation"), (50, None, "system", "no number"), (50, 0, "assistant", "x"), (50, 0, "assistant", "x"), (50, 0, "user", "x"), (51, 1, "assistant", "long " * 200_000)]
    messages = spark.createDataFrame([(c, f"{i}", s, r or "", t or "") for i, (c, s, r, t) in enumerate(rows)], "conv_id long, message string, seq long, role string, text string")
    for run in (256, 5):
        rendered = chat.render(messages, run=run)
        for r in rendered.join(chat.read_back(rendered).select(F.col("conv_id").alias("c"), "messages", "learned"), F.col("conv_id").eqNullSafe(F.col("c"))).collect():
            want = sorted(((s is not None, s or 0, role or "", t or "") for c, s, role, t in rows if c == r.conv_id))
            assert [(m.role, m.text) for m in r.messages] == [w[2:] for w in want]
            assert r.learned == "".join(t for _, _, role, t in want if role == "assistant")
            masked = "".join(r.formatted[t.start:t.start + t.loss] for t in r.turns)
            assert len(masked) == sum(t.loss for t in r.turns) and r.formatted.count("<|eot_id|>") == len(want)
            for t, w in zip(r.turns, want):
                assert r.formatted[t.at:].startswith("<|start_header_id|>") and (not t.loss or w[2] == "assistant")
        assert rendered.count() == len({c for c, *_ in rows})
    assert chat.read_back(chat.render(messages.where("false"))).count() == 0


def test_planted_conversation(spark):
    got = {r.conv_id: r for r in QUERIES[name_of("op12_")](spark, FOLDER).collect()}[-1]
    text = "</s>[INST] ok [/INST]"
    assert got.loss_chars == len(text) and got.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


# Whitening.

def plain_whitening(vectors, k):
    x = np.array([[math.floor(256 * float(c)) for c in v] for v in vectors], np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, vectors_ = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True).reshape(fit.shape[1], -1))
    order = np.argsort(-values)[:k]
    whitened = (x - sums / n) @ vectors_[:, order] / np.sqrt(values[order])
    return n, ((n * x.astype(object) - sums) ** 2).sum(axis=1), whitened, values[order] / values.sum()


def test_op13_like_eigenvectors(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").toPandas()
    n, deviation, whitened, explained = plain_whitening(rows.embedding, 4)
    got = QUERIES[name_of("op13_")](spark, FOLDER).toPandas().sort_values(["component", "vec_id"])
    assert len(got) == 4 * len(rows) and (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    for i in range(4):
        own = got[got.component == i + 1]
        assert own.deviation.tolist() == deviation.tolist() and np.allclose(own.explained, explained[i], rtol=1e-10)
        sign = np.sign(own.whitened.to_numpy() @ whitened[:, i])
        assert np.allclose(sign * own.whitened, whitened[:, i], rtol=1e-8, atol=1e-8)


def frame_of(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in enumerate(vectors)], "row long, v array<double>").withColumn("x", F.lit("s"))


@pytest.mark.parametrize("all_steps", [128, 0])
def test_whitening_of_odd_shapes(spark, all_steps):
    """Equal variances, few directions, converged before all steps: variances as from the whole covariance."""
    rng = np.random.default_rng(3)
    equal = np.concatenate([np.diag([5, 5, 4, 3, 3, 1]), -np.diag([5, 5, 4, 3, 3, 1])])
    flat = rng.standard_normal((50, 2)) @ rng.standard_normal((2, 5))
    falling = rng.standard_normal((300, 40)) * np.geomspace(1, 1e-2, 40)
    for vectors in (equal, np.round(flat * 256) / 256, falling, equal[:, :1], rng.standard_normal((3, 9))):
        model = whitening.fit(frame_of(spark, vectors), vector="v", components=4, all_steps=all_steps)
        x = np.unique(np.floor(vectors * 256), axis=0)
        values = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True).reshape(x.shape[1], -1)))[::-1][:4]
        values = values[values > 1e-12 * values[0]]
        assert model.n == len(x) and np.allclose(model.variances, values, rtol=1e-9) and model.identity_error < 1e-6


def test_whitening_leaves_out_what_has_no_place(spark):
    good = [[1, 2, 3], [2, 1, 0], [0, 0, 7], [1, 2, 3]] + [[1, 2, 3]] * 50
    odd = [None, [1, None, 2], [float("nan"), 1, 1], [float("inf"), 0, 0], [1, 2], [], [-0.0, 0, 7]]
    frame = frame_of(spark, good + odd)
    model = whitening.fit(frame, vector="v", scale=1.0)
    assert (model.n, model.sums, model.steps) == (3, [3, 3, 10], 3)
    got = {r.row.row: r for r in whitening.whiten(frame, model, vector="v", scale=1.0).collect()}
    assert sorted(got) == [*range(len(good)), len(good) + 6] and got[0].row.x == "s" and len(got[0].whitened) == 2
    assert got[0].deviation == 0 + 9 + 1 and got[0].whitened == got[53].whitened and got[2].whitened == got[60].whitened
    one = whitening.fit(frame.where("row = 0"), vector="v")
    assert one.n == 1 and [r.whitened for r in whitening.whiten(frame.where("row = 0"), one, vector="v").collect()] == [[]]
    none = whitening.fit(frame.where("false"), vector="v")
    assert none.n == 0 and whitening.whiten(frame.where("false"), none, vector="v").count() == 0


def test_whole_numbers_beyond_64_bits(spark):
    """Squares that a long doesn't hold give null, and the components still hold."""
    vectors = [[2.0**40 * a, 2.0**38 * b] for a in (-1, 1) for b in (-1, 1)]
    frame = frame_of(spark, vectors)
    model = whitening.fit(frame, vector="v")
    assert np.allclose(model.variances, [2.0**96, 2.0**92])
    got = whitening.whiten(frame, model, vector="v").collect()
    assert [r.deviation for r in got] == [None] * 4 and np.allclose(np.abs([r.whitened for r in got]), 1)
