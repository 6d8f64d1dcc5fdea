import itertools
import random
import re

import numpy as np
import pytest

from plumbline.functions import sketch
from plumbline.operators import duplicates as op


def normal(text):
    text = text.lower()
    for pattern, flags in ((r"#.*", 0), (r"//.*", 0), (r"/\*.*?\*/", re.S), (r"\s+", 0)):
        text = re.sub(pattern, "", text, flags=flags)
    return text


def shingle_set(text):
    text = normal(text)
    return {text[i:i + 5] for i in range(len(text) - 4)} if len(text) > 5 else {text}


CASES = {
    "a.py": "def f(a):  # one\n    return a\n",
    "b.py": "DEF f(a):\n\treturn a  # two\n",
    "c.js": "/* a // b */ c",
    "empty1": "", "empty2": "# only a comment",
    "short": "abc", "five": "abcde", "six": "abcdef", "wide": "ñandú añb  x y\x1cz", "emoji": "😀😀ab cd😀",
    "block": "x = 1 /* gone\n over lines */ + 2",
}


def test_shingles(corpus):
    got = {r["path"]: set(r["s"]) for r in corpus(CASES).select("path", op.shingles(op.F.col("content")).alias("s")).collect()}
    assert got == {path: shingle_set(text) for path, text in CASES.items()}


def test_hashes_tell_shingles_apart():
    seen = {}
    for text in CASES.values():
        plain = normal(text)
        units = [plain[i:i + 5] for i in range(len(plain) - 4)] if len(plain) > 5 else [plain]
        with np.errstate(over="ignore"):
            for unit, value in zip(units, sketch.shingle_hashes(plain).tolist(), strict=True):
                assert seen.setdefault(unit, value) == value
    assert len(set(seen.values())) == len(seen)


def test_modulus_and_families():
    rng = np.random.default_rng(1)
    with np.errstate(over="ignore"):
        x = np.concatenate([rng.integers(0, 2**31 - 1, 1000, dtype=np.uint64) * np.uint64(2**31 - 2), np.arange(5, dtype=np.uint64),
                            sketch.PRIME + np.arange(3, dtype=np.uint64), np.array([(2**31 - 1) * (2**31 - 2)], dtype=np.uint64)])
        assert (sketch._reduce(x) == x % sketch.PRIME).all()
    a, b = sketch.permutations(128, 1)
    assert len(set(a.tolist())) == len(set(b.tolist())) == 128 and a.min() > 0


def test_signature_estimates_jaccard():
    """The share of equal positions is close to the similarity over many pairs."""
    rng, errors = random.Random(7), []
    a, b = sketch.permutations(128, 1)
    with np.errstate(over="ignore"):
        for _ in range(60):
            words = [f"w{rng.randrange(400)}" for _ in range(150)]
            other = [w if rng.random() < 0.9 else f"v{rng.randrange(400)}" for w in words]
            left, right = "".join(words), "".join(other)
            same = sketch.signature(sketch.shingle_hashes(left), a, b) == sketch.signature(sketch.shingle_hashes(right), a, b)
            errors.append(same.mean() - sketch.jaccard(sketch.gram_hashes(left), sketch.gram_hashes(right)))
            assert sketch.jaccard(sketch.gram_hashes(left), sketch.gram_hashes(right)) == pytest.approx(len(shingle_set(left) & shingle_set(right)) / len(shingle_set(left) | shingle_set(right)))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.07


def test_equal_after_normalising_have_one_signature(corpus):
    signed = {r["path"]: r["signature"] for r in op.minhash_signature(corpus(CASES)).collect()}
    assert signed["a.py"] == signed["b.py"] and signed["empty1"] == signed["empty2"]
    assert len({tuple(s) for s in signed.values()}) == len(CASES) - 2 and len(signed["a.py"]) == 128


def test_long_texts_are_read_whole():
    body = "".join(random.Random(1).choices("abcdefgh", k=20_000))
    a, b = sketch.permutations(16, 1)
    with np.errstate(over="ignore"):
        hashes = sketch.shingle_hashes(body)
        whole = ((a[:, None] * hashes[None, :] + b[:, None]) % sketch.PRIME).min(axis=1)
        assert (sketch.signature(hashes, a, b) == whole).all()


@pytest.mark.parametrize("threshold, shape", [(0.9, (5, 25)), (0.8, (9, 13)), (0.5, (25, 5))])
def test_banding(threshold, shape):
    assert sketch.banding(threshold) == shape


def greedy(signatures, bands, rows):
    """Clusters by walking the paths in order, straight from the definition."""
    keys = {p: {(b, tuple(s[b * rows:(b + 1) * rows])) for b in range(bands)} for p, s in signatures.items()}
    clusters, seen = {}, set()
    for path in sorted(keys):
        near = {q for q in keys if keys[q] & keys[path]}
        if path not in seen and len(near) > 1:
            clusters[path] = near
            seen |= near
    return clusters


def variants(seed, count):
    """Texts in families of drifting copies, so that neighbourhoods overlap without being equal."""
    rng, files = random.Random(seed), {}
    for family in range(count // 10):
        words = [f"w{rng.randrange(500)}" for _ in range(120)]
        for i in range(10):
            for _ in range(rng.choice((0, 1, 1, 2, 4))):
                words[rng.randrange(len(words))] = f"v{rng.randrange(500)}"
            files[f"{rng.randrange(10**6):06d}-{family}-{i}"] = " ".join(words)
    return files


@pytest.mark.parametrize("threshold, part_rows", [(0.9, op.PART_ROWS), (0.5, op.PART_ROWS), (0.9, 0)])
def test_clusters_equal_the_greedy_walk(spark, corpus, threshold, part_rows):
    signed = op.minhash_signature(corpus(variants(3, 120))).cache()
    expected = greedy({r["path"]: r["signature"] for r in signed.collect()}, *sketch.banding(threshold))
    got = {}
    for r in op.dedup_clusters(signed, threshold=threshold, part_rows=part_rows).collect():
        got.setdefault(r["seed"], set()).add(r["path"])
        assert r["size"] == len(expected[r["seed"]])
    assert got == expected
    if threshold == 0.9:  # some clusters overlap
        assert sum(len(c) for c in got.values()) > len(set().union(*got.values()))


@pytest.mark.parametrize("part_rows, length, most", [(1000, 50, 0), (120, 50, 1), (10, 12, 4)])
def test_chains_take_few_rounds(spark, part_rows, length, most):
    """Chains of files, each near only the next: every other file is a seed, and parts that fit a task take one round.

    A round takes two files, so four rows, from the head of each chain: of 22 rows at most ten are left after four.
    """
    rows = [(f"{c}:{i}", f"{c:02d}-{i + j:03d}") for c in range(5) for i in range(length - 1) for j in (0, 1)]
    graph = spark.createDataFrame(rows, "bucket string, rep string")
    seeds, rounds = op.seeds_of(graph, part_rows=part_rows)
    assert sorted(r["rep"] for r in seeds.collect()) == [f"{c:02d}-{i:03d}" for c in range(5) for i in range(0, length, 2)]
    assert rounds <= most


def test_connected_parts(spark):
    rng = random.Random(2)
    names = rng.sample(range(10**6), 300)
    edges = [(f"b{i}", f"{names[i + j]:07d}") for i in range(299) if i % 100 != 99 for j in (0, 1)]
    parts = {r["rep"]: r["part"] for r in op._connected(spark.createDataFrame(edges, "bucket string, rep string")).collect()}
    for start in (0, 100, 200):
        own = [f"{n:07d}" for n in names[start:start + 100]]
        assert {parts[n] for n in own} == {min(own)}


def test_buckets_hold_exactly_the_candidate_pairs(corpus):
    signed = op.minhash_signature(corpus(variants(4, 60))).cache()
    signatures = {r["path"]: r["signature"] for r in signed.collect()}
    bands, rows = sketch.banding(0.9)
    expected = {(p, q) for p, q in itertools.combinations(sorted(signatures), 2)
                if any(signatures[p][b * rows:(b + 1) * rows] == signatures[q][b * rows:(b + 1) * rows] for b in range(bands))}
    buckets = {}
    for r in op.lsh_candidates(signed).collect():
        buckets.setdefault((r["band"], r["bucket"]), []).append(r["path"])
    assert {pair for members in buckets.values() for pair in itertools.combinations(sorted(members), 2)} == expected


def test_near_duplicates_compare_whole_texts(corpus):
    files = variants(5, 80)
    df = corpus(files)
    clusters = op.dedup_clusters(op.minhash_signature(df))
    sets = {p: shingle_set(t) for p, t in files.items()}
    exact = {(r["seed"], r["path"]): len(sets[r["seed"]] & sets[r["path"]]) / len(sets[r["seed"]] | sets[r["path"]])
             for r in clusters.collect() if r["seed"] != r["path"]}
    got = {(r["seed"], r["path"]): r["jaccard"] for r in op.near_duplicates(df, clusters).collect()}
    assert got == pytest.approx({k: v for k, v in exact.items() if v >= 0.9})


def test_one_text_as_a_third_of_all_files(corpus, rows):
    files = {f"same{i:03d}": "copied text of a licence file" for i in range(60)} | {f"own{i:03d}": f"text {i} {i * i} {i ** 3} alone" for i in range(120)}
    df = corpus(files)
    clusters = op.dedup_clusters(op.minhash_signature(df))
    assert {r["path"] for r in clusters.where("seed = 'same000'").collect()} == {p for p in files if p.startswith("same")}
    prints = op.file_fingerprint(df, project_root="p")
    assert op.exact_duplicates(prints).where("copies = 60").count() == 60
    assert rows(op.duplicate_groups(prints).select("copies", "first_path")) == [(60, "same000")]


def test_clones_of_lists_each_hash_once(spark, corpus, rows):
    prints = op.file_fingerprint(corpus({"a": "x", "b": "x", "c": "x", "d": "y", "e": "z", "f": "z"}), project_root="p")
    names = spark.createDataFrame([("a", "get_order"), ("b", "get_item"), ("d", "get_order2"), ("e", "other")], "path string, proc_name string")
    assert rows(op.clones_of(names, prints, "ORDER").select("path", "matched", "clones")) == [("a", True, 2), ("b", False, 2), ("c", False, 2)]


def test_last_row_of_a_path_wins(spark, rows):
    schema = "path string, batch int, seq int, hash string"
    old = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 2, "y"), ("b", 1, 1, "z")], schema)
    new = spark.createDataFrame([("a", 2, 1, "w")], schema)
    assert rows(op.index_upsert(old, new).select("path", "hash")) == [("a", "w"), ("b", "z")]
