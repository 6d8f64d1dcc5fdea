"""Work that must be whole: results against brute force where a shortcut would leave something out."""

import random
from itertools import combinations
from os.path import commonprefix

from pyspark.sql import functions as F

from plumbline.llm import chunks, lines, simhash, toxicity

RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(3, 8))) for _ in range(3000)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def family(size, seed, least, most):
    """Texts that differ from one another in some of 200 words."""
    rng, base = random.Random(seed), prose(200, seed).split()
    out = []
    for _ in range(size):
        own = base[:]
        for at in rng.sample(range(200), rng.randint(least, most)):
            own[at] = rng.choice(VOCABULARY)
        out.append(" ".join(own))
    return out


def test_components_are_those_of_all_pairs_within_the_radius(spark):
    """Families of near copies, some of which only chains of links join."""
    texts = [t for k in range(8) for t in family(24, 100 + k, 0, 4)]
    prints = [int.from_bytes(simhash.fingerprint(t.encode(), 4, 64), "big") for t in texts]
    name = list(range(len(texts)))
    for i, j in combinations(name[:], 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            low, high = sorted((name[i], name[j]))
            name = [low if n == high else n for n in name]
    assert 20 < len(set(name)) < 180
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for nodes in (20_000, 7):
        got = simhash.near_duplicates(docs, tree_nodes=nodes).collect()
        assert [r.component_id for r in sorted(got, key=lambda r: r.doc_id)] == name
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(name))


def test_a_family_of_one_template_costs_its_texts(spark):
    """Edges of a tree are fewer than its nodes, however many pairs are near."""
    for size in (100, 400):
        prints = [(0, 1 << (i % 60) | i) for i in range(size)]
        frame = spark.createDataFrame(prints, "fp_hi long, fp_lo long").distinct()
        masks = simhash.block_masks(64, 4, size)
        assert simhash.links(frame, masks, 4).count() <= len(masks) * size


def test_rows_without_or_with_one_doc_id_are_no_copies_for_that(spark):
    """A third of the rows have no doc_id, some share one; only a copy goes."""
    texts = [prose(100, 300 + i) for i in range(30)]
    ids = [None] * 10 + [7] * 5 + list(range(100, 115))
    rows = [*zip(ids, texts), (500, texts[0]), (501, texts[12].upper()), (7, texts[20].upper())]
    kept = sorted(r.text for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == sorted([*texts[:20], texts[20].upper(), *texts[21:]])


def test_a_passage_of_an_earlier_document_inside_of_what_a_later_one_repeats(spark):
    p, x, y = prose(80, 1), prose(90, 2), prose(70, 3)
    texts = {3: f"{prose(30, 4)} {p} {prose(30, 5)}", 10: f"{x} {p} {y}", 50: f"{x} {p} {y}"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = chunks.repeated_passages(docs)
    got = [(r.doc_id, r.first_doc_id, texts[r.doc_id][r.start:r.end]) for r in found.orderBy("doc_id", "start").collect()]
    assert [g[:2] for g in got] == [(3, 3), (10, 10), (10, 3), (10, 10), (50, 10), (50, 3), (50, 10)]
    assert all(text in texts[first] for _, first, text in got)
    kept = {r.doc_id: r.text for r in chunks.drop_repeats(docs, found).collect()}
    assert kept[3] == texts[3] and len(kept[10]) < len(x) + len(y) + 200 and kept[10].startswith(x)
    # A text that starts like what follows the passage elsewhere loses no more than that.
    assert y.removeprefix(commonprefix([y, prose(30, 5)])) in kept[10]
    assert len(kept[50]) < 200


def test_chunks_of_rows_without_or_with_one_doc_id(spark):
    """Rows without a doc_id are documents of their own; no row is cut at another's offsets."""
    p, q = prose(80, 21), prose(80, 22)
    rows = [(None, f"{p} {prose(60, 23)}"), (None, f"{prose(60, 24)} {p}"), (None, prose(150, 25)), (5, f"{q} {prose(60, 26)}"), (8, f"{prose(60, 27)} {q}"), (8, prose(150, 28))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.text for r in chunks.drop_repeats(docs, chunks.repeated_passages(docs)).collect()]
    whole = [t for _, t in rows if t in kept]
    assert rows[2][1] in whole and rows[3][1] in whole and rows[5][1] in whole and len(whole) == 4
    assert all(len(t) < 700 for t in kept if t not in whole)


def test_many_equal_rows_are_one_list(spark):
    """A third of the rows is one text under one id: its windows count once."""
    text, other = prose(120, 31), prose(120, 32)
    rows = [(5, f"{text} {other}")] * 400 + [(6, text)] + [(i, prose(60, i)) for i in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = chunks.repeated_passages(docs).collect()
    assert sorted((r.doc_id, r.first_doc_id) for r in found) == [(5, 5), (6, 5)]


def test_lines_of_rows_without_or_with_one_doc_id(spark):
    """A list of dropped lines is that of one text, also where the arrays stay in their shards."""
    line = [f"A line that is repeated, number {i}" for i in range(40)]
    rows = [(None, "\n".join(line[i % 40:] + [f"own {i}"])) for i in range(120)] + [(9, line[0]), (9, f"{line[1]}\nkept"), (10, "\n".join(line))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("_doc", "_row", "_text", "_gone", "_hash", "row", "h1", "shard")}).repartition(3)
    plain, routed = (sorted(tuple(r) for r in lines.dedup_lines(docs, **how).select("text", "n_lines", "n_dropped", "_doc", "_gone", "h1").collect())
                     for how in ({}, {"broadcast_bytes": 0, "shard_keys": 7}))
    assert plain == routed and len(plain) == len(rows) and plain[0][3:] == ("_doc", "_gone", "h1")
    assert sorted(r[0] for r in plain)[:3] == ["", "\n".join(line), "kept"] and all(r[0].startswith("own") for r in plain if r[1] > 41 or r[0].startswith("own"))


def test_a_labelled_id_with_many_rows_is_few_examples(spark):
    rows = [(1, "same text")] * 3000 + [(1, f"text {i}") for i in range(2000)] + [(i, prose(20, i)) for i in range(2, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(1, 1)], "doc_id long, toxic int")
    drawn = toxicity.sample(docs, labels, F.lit(True), text="text", doc_id="doc_id", label="toxic", rows=500)
    assert 350 < drawn.count() < 650
    assert toxicity.sample(docs, labels, F.lit(True), text="text", doc_id="doc_id", label="toxic", rows=10**6).where("text = 'same text'").count() == 1


CLASHING = ("_key", "_crc", "_doc", "_row", "row", "at", "name", "score", "predicted", "_gone", "own", "n", "node", "root")


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, equal rows, clashing names, no rows: every stage keeps clean rows and the columns."""
    import corpus_pipeline

    toxic = [(i, prose(30, i) + " nastyword" * 3, "en") for i in range(1000, 1100)]
    clean = [(i, prose(60, i), "en") for i in range(60)]
    odd = [(None, None, None), (None, None, None), (300, "", "en"), (301, prose(50_000, 301), "en"), (302, None, "de"), (303, " \n\t", "en")] + [(304, prose(80, 304), "en")] * 40
    item = prose(40, 900)
    leaks = [(400, f"{prose(30, 1)} {item} {prose(30, 2)}", "en")] * 3
    schema = "doc_id long, text string, lang string"
    made = spark.createDataFrame(toxic + clean + odd + leaks, schema).withColumns({c: F.lit("x") for c in CLASHING}).withColumn("n_chars", F.char_length("text").cast("long"))
    folder = str(tmp_path)
    made.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 1000)) for i in [*range(60), *range(1000, 1100)]], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert k == 4 or out.columns == made.columns
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        counts.append(docs.count())
        assert stage(spark, made.where("false"), folder).count() == 0
    # Toxic rows go; one row stays of the text-less ones and of each group of equal rows; the leak goes.
    assert counts[0] == counts[1] == len(clean + odd + leaks) and counts[2] == len(clean) + 1 + 1 + 1 + 1 and counts[3] == counts[2] - 1
    assert docs.select("doc_id").distinct().count() == counts[3]
