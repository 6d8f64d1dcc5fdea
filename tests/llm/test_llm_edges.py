"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import chunks, decontam, graph, html, langid, lines, mph, packing, quality, sharding, simhash, toxicity

SCHEMA = ("doc_id long, text string, lang string, source string, node long, shard string, bucket int, k string, n long, size string, _crc string, label string, "
          "score string, root string")
EXTRA = ("x",) * 2
RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


LONG = prose(60_000, 1)
TEXTS = {1: None, 2: "", 3: "   \n\t ", 4: prose(80, 4), 5: prose(80, 4), 6: prose(300, 6), 7: LONG, 8: LONG + " tail", 9: "word", None: prose(90, 9)}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 7, "shard", 1, "k", 5, "size", "c", "l", "s", "r") for i, t in TEXTS.items()]
    rows += [rows[5], rows[5]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.where("false")


def test_sharding(docs, none):
    got = sharding.kd_shards(docs, shards=3).toPandas()
    assert len(got) == 12 and set(got.columns) >= {"doc", "size", "crc", "shard", "slot"}
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert got[got.doc == 4].shard.item() == got[got.doc == 5].shard.item()
    assert sharding.kd_shards(none, shards=8).count() == 0
    sized = sharding.kd_shards(docs, target_bytes=500_000).toPandas()
    assert 1 < sized.shard.nunique() <= 3


def test_sharding_splits_a_group_that_is_too_large(spark):
    same = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("equal text").alias("text"))
    counts = sharding.kd_shards(same, shards=8, dims=[]).groupBy("shard").count().toPandas()["count"]
    assert len(counts) == 8 and counts.max() - counts.min() <= 2


def test_sharding_like_a_plain_tree(spark):
    """Each split is along the widest dimension, parts the rows in their order, and gives the left side its share."""
    rng, shards = random.Random(11), 6
    rows = [(i, prose(rng.randint(1, 60), rng.randrange(250)), rng.choice(["en", "de", None]), f"https://a.example/{rng.choice('abcdefgh')}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    dims = ["lang", "source"]
    known = {r["doc"]: r for r in sharding.metadata(docs, dims=dims).collect()}
    names = ["k0", "k1", "k2"]
    # Places of the values, by hand; copies take those of their smallest.
    places = {v: i + 1 for i, v in enumerate(sorted({r[3] for r in rows}))}
    least = {}
    for r in rows:
        least[r[1]] = min(least.get(r[1], 99), places[r[3]])
    assert all(known[r[0]]["k2"] == least[r[1]] for r in rows)
    got = sharding.kd_shards(docs, shards=shards, dims=dims).collect()
    total, depth = sum(r["size"] for r in got), 3
    width = {k: max(1, max(r[k] for r in known.values()) - min(r[k] for r in known.values())) for k in names}
    sides, split_dims = [(got, shards, depth)], set()
    while sides:
        part, leaves, left = sides.pop()
        if leaves == 1:
            assert len({r["shard"] for r in part}) == 1
            continue
        low = [r for r in part if not r["node"] >> (left - 1) & 1]
        high = [r for r in part if r["node"] >> (left - 1) & 1]
        spread = {k: (max(known[r["doc"]][k] for r in part) - min(known[r["doc"]][k] for r in part)) / width[k] for k in names}
        dim = max(names, key=lambda k: (spread[k], -names.index(k)))
        split_dims.add(dim)
        key = lambda r: (known[r["doc"]][dim], known[r["doc"]]["h"], known[r["doc"]]["d"])  # noqa: B023, E731
        assert max(map(key, low)) < min(map(key, high))
        bytes_of = lambda rows: sum(r["size"] for r in rows)
        # A split falls between rows or whole groups of equal texts where the tolerance allows it.
        assert abs(bytes_of(low) - leaves // 2 / leaves * bytes_of(part)) <= max(sharding.TOLERANCE * total / shards, max(r["size"] for r in part))
        sides += [(low, leaves // 2, left - 1), (high, leaves - leaves // 2, left - 1)]
    assert len(split_dims) > 1


def test_simhash(docs, none):
    for how in ({}, {"words": 5, "bits": 128, "radius": 6}):
        got = simhash.near_duplicates(docs, **how).toPandas()
        of = {(-1 if np.isnan(i) else int(i)): c for i, c in zip(got.doc_id, got.component_id)}
        assert len(got) == 12 and of[1] == of[2] == of[3] == 1 and of[4] == 4 and of[7] == of[8] == 7 and of[9] == 9
        assert simhash.near_duplicates(none, **how).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i or 0 for i in ids) == [0, 1, 4, 6, 7, 9]


def test_trees_of_one_shard_in_parts(spark):
    """Small trees give the components of one large tree."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40)
    flips = [int(b) ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))) for b in base for _ in range(6)]
    frame = spark.createDataFrame([(0, f) for f in {*flips, *base.tolist()}], "fp_hi long, fp_lo long")
    masks = simhash.block_masks(64, 4, 300)

    def parts(nodes):
        found = simhash.links(frame, masks, 4, tree_nodes=nodes).select(F.col("a_lo").alias("a"), F.col("b_lo").alias("b"))
        return sorted(map(tuple, graph.connected_components(found).collect()))

    assert parts(20_000) == parts(3) != []


def test_pigeonhole_masks_lose_no_pair():
    rng = random.Random(2)
    for n in (100, 10**6, 10**9):
        masks = simhash.block_masks(64, 4, n)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 6)] + [(100, i) for i in range(101, 120)] + [(7, 7), (None, 3)]
    RNG.shuffle(chain)
    for few in (10**6, 0):
        got = dict(map(tuple, graph.connected_components(spark.createDataFrame(chain, "a long, b long"), few_links=few).collect()))
        assert got == {i: 0 for i in range(7)} | {i: 100 for i in range(100, 120)}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys, marks = rng.integers(0, 2**64, (2, 20_000), dtype=np.uint64)
    keys[1] = keys[2]
    table = mph.Table(mph.build(keys, marks, {"v": np.arange(20_000)}))
    at = table.find(keys, marks)
    assert sorted(at) == list(range(20_000)) and (table.values["v"][at] == np.arange(20_000)).all()
    assert (table.find(marks, keys) == -1).all()
    empty = mph.Table(mph.build(keys[:0], marks[:0], {"v": np.arange(0)}))
    assert (empty.find(keys[:5], marks[:5]) == -1).all()


def test_lines(spark, docs, none):
    line = "A line that is long enough to count"
    rows = [(1, f"{line}\nx"), (2, f"  {line.upper()}\t\ny"), (3, f"{line}\n{line}\nz"), (None, line), (4, None), (5, ""), (5, f"short\n{'ä' * 19}")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for how in ({}, {"broadcast_bytes": 0, "shard_keys": 1}):
        got = sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in lines.dedup_lines(frame, **how).collect())
        assert got == [("1", "x", 2, 1), ("2", "y", 2, 1), ("3", f"{line}\n{line}\nz", 3, 0), ("4", "", 1, 0), ("5", "", 1, 0), ("5", f"short\n{'ä' * 19}", 2, 0), ("None", "", 1, 1)]
    assert lines.dedup_lines(docs).count() == 12 and lines.dedup_lines(none).count() == 0


def test_packing(docs, none):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    cut = packing.pieces(docs, path, with_ids=True)
    packed = packing.pack(cut, block_pieces=4, epochs=2)
    got = packed.toPandas()
    assert (got.groupby("sequence_id").length.sum() <= 2048).all() and len(got) == cut.count()
    whole = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in whole) == got.length.sum() and all(len(r.ids) <= 2048 for r in whole)
    assert packing.pack(packing.pieces(none, path)).count() == 0


def test_encoder_gives_the_tokenizers_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    odd = ["", " ", "  a", "a  ", "\n\n x", "it's we'll", "naïve é 中文字 😀 ا", "1234 5x", "a<|endoftext|>b", "<|endoftext|><|endoftext|> <|endoftext|", "\t x y", "x" * 300,
           "!?#% ...", "́a ᾳ Ⅷ ²"]
    odd += [f"{LONG} it's {LONG}", f"{LONG}<|endoftext|>{' ' * 70_000}{LONG}", "ab" * 30_000 + f" {LONG}", "word " * 5_000 + "\n" * 90_000, "a b" * 50_000]
    assert encoder.ranked is not None
    for text in odd:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == model.encode(text, add_special_tokens=False).ids, text[:99]
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0xD800), rng.randrange(0xE000, 0x20000), 32, 10])) for _ in range(200))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == model.encode(text, add_special_tokens=False).ids, text


def test_encoder_takes_runs_of_millions():
    import public_tokenizers

    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (" " * 1_500_000, "a" * 1_500_000, "\n" * 1_000_000 + "x", "!" * 1_000_000):
        assert encoder.ranked.decode(np.frombuffer(encoder.encode(text), "<u4").tolist()) == text


def test_genetic_packing_gets_near_a_perfect_packing():
    """Triplets that fill their bins exactly (20 bins); best fit alone needs more than the search does."""
    rng = np.random.default_rng(4)
    size = []
    for _ in range(20):
        a, b = int(rng.integers(30, 40)), int(rng.integers(28, 36))
        size += [a, b, 100 - a - b]
    falling = sorted(range(len(size)), key=lambda i: -size[i])
    plain = packing.best_fit(falling, size, 100, packing.Bins([], []))
    best = packing.evolve(size, 100, (1,), [], population=16, generations=600)
    assert sorted(i for b in best.members for i in b) == list(range(60))
    assert len(best.fill) < len(plain.fill) and len(best.fill) <= 21


def test_language_id(spark, docs, none):
    rows = [(1, "das ist nicht gut und der Hund", "de"), (2, "the dog is not good and that", "en"), (3, None, "en"), (4, "123 !?", "de"), (5, "der Hund und das", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.language_id(frame, F.lit(True)).collect()}
    assert got[5][0] == got[1][0] == "de" and got[2][0] == "en" and got[3] == got[4] == ("und", 0.0)
    assert langid.language_id(docs, F.lit(True)).count() == 12 and langid.language_id(none, F.lit(True)).count() == 0
    assert {r.lang_pred for r in langid.language_id(docs, F.lit(False)).collect()} == {"und"}


def test_toxicity(spark, docs, none):
    rows = [(i, prose(30, i) + (" nastyword" if i % 2 else "")) for i in range(120)]
    frame = spark.createDataFrame([*rows, (500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*[(i, i % 2) for i in range(120)], (1, None), (999, 1)], "doc_id long, toxic int")
    model = toxicity.classifier(frame, labels, F.col("doc_id") < 90)
    got = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    assert all(got[i].predicted == i % 2 for i in range(90, 120)) and got[500].score == got[501].score
    unlearned = toxicity.classifier(frame, labels, F.lit(False))
    assert {r.score for r in toxicity.score(docs, unlearned).collect()} == {0.0} and toxicity.score(none, unlearned).count() == 0


def test_tiles_catch_moved_passages(spark, docs, none):
    item = prose(40, 77)
    half = item.split()
    moved = f"{prose(30, 1)} {' '.join(half[20:])} {prose(10, 2)} {' '.join(half[:20])}"
    texts = [(1, f"{prose(50, 3)} {item.upper()}"), (2, moved), (3, prose(500, 4)), (4, None), (5, "")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, None), (3, "rare pair"), (1, item)], "item_id long, text string")
    for how in ({}, {"block_words": 20}):
        got = decontam.overlaps(frame, items, **how).toPandas()
        assert sorted(zip(got.doc_id, got.item_id, got.coverage)) == [(1, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0), (2, 1, 1.0)]
    assert [r.doc_id for r in decontam.decontaminate(frame, items).orderBy("doc_id").collect()] == [3, 4, 5]
    assert decontam.decontaminate(docs, items).count() == 12 and decontam.overlaps(none, items).count() == 0
    assert decontam.overlaps(frame, items.where("false")).count() == 0


def test_tiles_like_plain_greedy_search():
    rng = random.Random(8)
    for _ in range(60):
        doc, item = ([rng.randrange(4) for _ in range(n)] for n in (40, 15))
        free_d, free_i, want = [True] * 40, [True] * 15, []
        while True:
            best = (0, 0, 0)
            for d in range(40):
                for i in range(15):
                    n = 0
                    while d + n < 40 and i + n < 15 and free_d[d + n] and free_i[i + n] and doc[d + n] == item[i + n]:
                        n += 1
                    if n > best[0]:
                        best = (n, d, i)
            if best[0] < 3:
                break
            n, d, i = best
            want.append((d, i, n))
            free_d[d:d + n] = free_i[i:i + n] = [False] * n
        assert decontam.tiles(doc, item, 3) == want


def test_chunks(spark, docs, none):
    got = chunks.repeated_passages(docs).toPandas()
    assert {(int(d), int(f)) for d, f in zip(got.doc_id, got.first_doc_id) if d == d} >= {(4, 4), (5, 4), (7, 7), (8, 7)}
    assert chunks.repeated_passages(none).count() == 0
    kept = {r.doc_id: r.text for r in chunks.drop_repeats(docs, chunks.repeated_passages(docs)).collect()}
    assert kept[4] == TEXTS[4] and len(kept[8]) < 200 and kept[7] == LONG and kept[1] is None
    data = prose(500, 5).encode()
    ends = chunks.chunk_ends(data)
    shifted = chunks.chunk_ends(b"inserted bytes " + data) - 15
    assert ends[-1] == len(data) and len(set(ends.tolist()) - set(shifted.tolist())) <= 3
    assert np.diff(chunks.chunk_ends(b"same " * 400)).max() <= 2 * chunks.REACH + 1


def test_rules(spark, docs, none):
    rows = [(i, prose(80, i) + (" ## $$ %%" * 6 if i % 4 == 0 else "")) for i in range(240)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*[(i, int(i % 4 > 0)) for i in range(240)], (9999, 0), (1, None)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.judged(frame, labels).collect()}
    assert all(got[i] == (i % 4 > 0) for i in range(240))
    assert all(r.kept == (not r.base_failed) for r in quality.judged(docs, labels.where("false")).collect())
    assert quality.judged(none, labels).count() == 0


def test_rules_like_plain_covering(spark):
    """The list learned from counts by bin is that of sequential covering over the rows themselves."""
    rng = random.Random(4)
    rows = []
    for i in range(400):
        bad = rng.random() < 0.35
        noise = " ##" * rng.choice((4, 9, 15)) if bad and i % 2 else " LOUD" * rng.choice((10, 25)) if bad else " #" * rng.choice((0, 0, 1, 5))
        rows.append((i, prose(rng.randint(60, 120), i) + noise, int(not bad) if rng.random() < 0.97 else int(bad)))
    stats = quality.statistics(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).cache()
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    labelled = stats.where(~quality.base_failed()).join(labels, "doc_id").select(
        *[F.expr(e).alias(m) for m, e in quality.MEASURES.items()], (F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow"), "*")
    _, cuts = quality.binned(labelled.select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_upper", "bad", "grow"), quality.BINS)
    left = [r.asDict() for r in labelled.collect()]
    options = [(m, op, i) for m in quality.MEASURES for op in (">", "<=") for i in range(len(cuts[m]))]
    holds = lambda r, o: (r[o[0]] > cuts[o[0]][o[2]]) == (o[1] == ">")
    split = lambda part: (sum(r["bad"] for r in part), sum(not r["bad"] for r in part))
    want = []
    while len(want) < quality.MAX_RULES:
        inside, rule = [r for r in left if r["grow"]], []
        if split(inside)[0] < quality.MIN_COVER:
            break
        while len(rule) < quality.MAX_CONDITIONS and split(inside)[1]:
            gains = [quality._gain(*split([r for r in inside if holds(r, o)]), *split(inside)) for o in options]
            best = max(range(len(options)), key=lambda j: (gains[j], options[j][2] * (1 if options[j][1] == "<=" else -1), -j))
            if gains[best] <= 0:
                break
            rule.append(options[best])
            inside = [r for r in inside if holds(r, options[best])]
        tested = [split([r for r in left if not r["grow"] and all(holds(r, o) for o in rule[:k])]) for k in range(1, len(rule) + 1)]
        if not tested:
            break
        best = max(range(len(tested)), key=lambda k: ((tested[k][0] - tested[k][1]) / max(1, sum(tested[k])) if sum(tested[k]) else -1, -k))
        p, n = tested[best]
        if p + n < max(1, quality.MIN_COVER // 2) or p < quality.MIN_PRECISION * (p + n):
            break
        want.append(rule[:best + 1])
        left = [r for r in left if not all(holds(r, o) for o in want[-1])]
    between = lambda m, i: (cuts[m][i] + cuts[m][min(i + 1, len(cuts[m]) - 1)]) / 2
    assert want and quality.learn(stats, labels) == [[(m, op, between(m, i)) for m, op, i in rule] for rule in want]


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=/x>Menu item here</a></nav>
<div id="cookie-notice">We use cookies and more cookies here</div><div class="content"><h1>Title &amp; more</h1><p>First   para <b>bold</b>
text with many words.<p>Second&nbsp;para it's <a href="it's">linked</a> words<script>var a = "<p>no</p>";</script> end.</p>
<aside>Side story text</aside><div class="ad">Buy now buy now</div><form><input name=q>Search</form></div>
<section class="comments"><p>First reader says many many words in this comment about nothing</p></section><footer>&copy; all rights</footer>"""


def test_html(spark, none):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "<p>" * 3000 + "deep words here" + "</div>" * 50), (5, "u", "plain words only"), (6, "u", "<p title=\"unclosed>a b"), (1, "u", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kind", F.lit("x"))
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got[1] == "Title & more\n\nFirst para bold text with many words.\n\nSecond para it's linked words end."
    assert got[2] == got[3] == "" and got[4] == "deep words here" and got[5] == "plain words only"
    assert html.extract(pages.where("false")).count() == 0


ARTICLE = "<p>" + "many plain words of the story " * 8 + "</p>"


@pytest.mark.parametrize("inner, kept", [
    ('<p title="The hidden valley">Valley text here</p>', "Valley text here"), ('<p>See <a href="/hidden-costs">costs</a> too</p>', "See costs too"),
    ('<div class="legal-history"><p>Law text here</p></div>', "Law text here"), ('<p data-id="tags-1">Data text</p>', "Data text"), ('<p>A <label>word</label> b</p>', "A word b"),
    ("<p>Sum <math><mi>x</mi></math> y</p>", "Sum x y"), ('<figure class="share"><figcaption>Caption text</figcaption></figure>', "Caption text"),
    ('<fieldset><p>Set text here</p></fieldset>', "Set text here"), ('<p><a href="/x?id=comments&class=ad">link words</a></p>', "link words"), ('<p id=side-effects>Effects text</p>', "Effects text"),
    ('<div class="ad">Buy now</div>', None), ('<div class="cookie-notice">We use cookies</div>', None), ('<div class=\'ad-slot-3\'>Buy</div>', None), ('<section id="comments"><p>First reader</p></section>', None),
    ('<ul class="navLinks"><li>Home</li></ul>', None), ('<form><label>Name</label><input name=q></form>', None), ('<aside>Aside words</aside>', None), ('<p hidden>Unseen</p>', None), ('<p style="display: none">Unseen</p>', None),
    ('<!-- <p>no</p> -->', None), ('<script>var a = "<p>no</p>"</script>', None)])
@pytest.mark.parametrize("learned", [{}, {"word p": 2.0, "word nav cut": -5.0, "tag p": 1.0}])
def test_html_keeps_the_article_alone(inner, kept, learned):
    page = f"<html><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><article><header><h1>Headline</h1></header>{ARTICLE}{inner}{ARTICLE}</article><footer>End</footer>"
    story = ("many plain words of the story " * 8).strip()
    assert html.main_text(page, learned).split("\n\n") == ["Headline", story, *[kept] * bool(kept), story]


def test_html_of_a_page_in_a_form():
    page = f"<body><form action=/p><div class=menu>Home</div><h1>Title</h1>{ARTICLE}<p><input name=a>Last words here</p></form>"
    assert html.main_text(page, {}).split("\n\n")[0] == "Title" and html.main_text(page, {}).endswith("Last words here")


def test_html_takes_linear_time():
    import time

    for page in ("<div><b>" * 10_000 + "</i>" * 10_000, "<div><b>" * 10_000 + "</b>" * 10_000, "<form>" * 10_000 + "x", "<p><b>" * 10_000, "<ul><li>" * 10_000 + "</p>" * 10_000,
                 "<script>" * 10_000, "<b><div>" * 10_000 + "</b>" * 10_000, '<a href="' * 10_000, "<a '" * 10_000):
        started = time.perf_counter()
        html.main_text(page, {})
        assert time.perf_counter() - started < 1, page[:20]


def test_best_run_like_all_runs():
    rng = random.Random(5)
    for _ in range(500):
        scores = [rng.choice([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 3.0]) for _ in range(rng.randrange(0, 14))]
        runs = [(0, 0), *[(i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]]
        most = max(sum(scores[i:j]) for i, j in runs)
        start, end = html.best_run(scores)
        assert sum(scores[start:end]) == most and (most > 0 or (start, end) == (0, 0))
