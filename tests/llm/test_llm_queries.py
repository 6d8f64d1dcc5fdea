"""The registered queries over the smallest tables, against SQL or plain Python."""

import re
import zlib
from collections import Counter
from html import unescape

import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas().set_index("doc_id")


def run(spark, start):
    name = next(n for n in QUERIES if n.startswith(start))
    return QUERIES[name](spark, FOLDER).toPandas()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_all_are_registered():
    assert [sum(n.startswith(f"op{i}_") for n in QUERIES) for i in range(1, 14)] == [1] * 13 and "pipeline" in QUERIES


def test_op1_shards_are_even_and_gapless(spark, docs):
    got = run(spark, "op1_")
    assert sorted(got.doc_id) == sorted(docs.index)
    for row in got.itertuples():
        data = docs.text[row.doc_id].encode()
        assert (row.size, row.text_crc32, row.law) == (len(data) + 1, zlib.crc32(data), "bytes")
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() - sums.min() <= 2 * got["size"].max()


def test_op2_components_like_brute_force(spark, docs):
    got = run(spark, "op2_").set_index("doc_id")

    def simhash(text):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), seed=42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    ids = list(docs.index)
    prints = {i: simhash(docs.text[i]) for i in ids}
    name = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (prints[i] ^ prints[j]).bit_count() <= 4 and name[i] != name[j]:
                    name[i] = name[j] = min(name[i], name[j])
                    changed = True
    assert {i: (f"{prints[i]:016x}", name[i]) for i in ids} == {i: (got.fingerprint[i], got.component_id[i]) for i in ids}


def test_op4_ids_and_places(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = run(spark, "op4_")
    ids = {i: np.array([*model.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in docs.text.items()}
    assert got.groupby("doc_id").length.sum().to_dict() == {i: len(v) for i, v in ids.items()}
    for row in got.itertuples():
        own = ids[row.doc_id][row.start:row.start + row.length]
        assert zlib.crc32(own.tobytes()) == row.ids_crc32 and (row.piece == 0 or row.length == 2048)
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part.length.sum() <= 2048 and list(part.offset) == [0, *part.length.cumsum()[:-1]]
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) * 1.02 + 1


def test_op5_held_out_languages(spark, docs):
    got = run(spark, "op5_").join(docs.lang, on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in zip(got.doc_id, got.held_out))


def test_op6_like_brute_force(spark, docs):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").toPandas()
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    whole = {(d, i) for d, t in docs.text.items() for i, x in zip(items.item_id, items.text) if f" {plain(x)} " in f" {plain(t)} "}
    got = run(spark, "op6_")
    assert whole <= set(zip(got.doc_id, got.item_id)) and (got.coverage >= 0.5).all()
    assert {(r.doc_id, r.item_id) for r in got.itertuples() if r.coverage == 1 and r.n_tiles == 1} == whole


def test_op7_finds_what_repeats(spark, docs):
    got = run(spark, "op7_")
    first = {}
    for d, t in docs.text.items():
        for w in {tuple(words(t)[i:i + 60]) for i in range(len(words(t)) - 59)}:
            first.setdefault(w, set()).add(d)
    repeated = {d for s in first.values() if len(s) > 1 for d in s}
    assert repeated <= set(got.doc_id)
    short = Counter()
    for t in docs.text:
        short.update({tuple(words(t)[i:i + 20]) for i in range(len(words(t)) - 19)})
    for row in got.itertuples():
        inner = words(docs.text[row.doc_id].encode()[row.start:row.end].decode(errors="ignore"))[1:-1]
        assert any(short[tuple(inner[i:i + 20])] > 1 for i in range(len(inner) - 19))


def test_op8_scores(spark, docs):
    got = run(spark, "op8_")
    assert len(got) == len(docs) and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_op8_held_out_labels(spark):
    """Rows that the classifier never saw, over the table of a size that has hundreds of labels."""
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op8_nb_ngram_toxicity"](spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()[["doc_id", "toxic"]].dropna().drop_duplicates("doc_id")
    held = got[got.held_out].merge(labels, on="doc_id")
    assert len(held) > 30 and (held.predicted == held.toxic).mean() > 0.9
    toxic, clean = held.score[held.toxic == 1], held.score[held.toxic == 0]
    assert np.mean([(t > clean).mean() + (t == clean).mean() / 2 for t in toxic]) > 0.9


def test_op9_statistics(spark, docs):
    for row in run(spark, "op9_").itertuples():
        text = docs.text[row.doc_id]
        w, lines = words(text), [x for x in text.split("\n") if words(x)]
        at = {}
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i:i + 3]), []).append(i)
        covered = {p + k for places in at.values() if len(places) > 1 for p in places for k in range(3)}
        want = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
        assert want == (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words)
        assert row.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (row.base_failed and row.kept)


def test_op10_articles(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").toPandas().set_index("page_id")
    for row in run(spark, "op10_").itertuples():
        article = re.search(r"<article>(.*?)</article>", pages.html[row.page_id], re.DOTALL)[1]
        parts = [re.sub(r"<[^>]*>", "", p.replace("<br>", " ")) for p in re.split(r"</?(?:p|h1)>", article)]
        want = "\n\n".join(b for b in (re.sub(r"\s+", " ", unescape(p)).strip() for p in parts) if b)
        assert (row.text, row.n_chars) == (want, len(want))


def test_pipeline_stages(spark):
    import corpus_pipeline

    packed = corpus_pipeline.run(spark, FOLDER).toPandas()
    kept = spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()
    columns = list(kept.columns)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns
    assert set(packed.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()}
