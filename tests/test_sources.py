import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import duplicates, manifests
from plumbline.session import cut_lineage, scratch_dir
from plumbline.sources import corpus as source
from plumbline.sources import sinks
from plumbline.operators import sql_corpus


def test_tree(spark, tmp_path, rows):
    for name, data in {"a/x.py": b"print(1)\n", "a/.git/y.py": b"no", "b/build/z.c": b"no", "b/n.c": b"\xff\xfeint", "m.md": b"#", "a/__init__.py": b"", ".hidden/_z.c": b"x\r\ny\rz"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "loop").symlink_to(tmp_path, target_is_directory=True)
    files = source.read_tree(spark, str(tmp_path))
    assert [r[0] for r in rows(files.select("path"))] == [".hidden/_z.c", "a/__init__.py", "a/x.py", "b/n.c", "m.md"]
    assert [r[0] for r in rows(source.with_extension(files).select("path"))] == [".hidden/_z.c", "a/__init__.py", "a/x.py", "b/n.c"]
    prints = {r["path"]: r for r in duplicates.file_fingerprint(files, project_root="p").collect()}
    assert prints["b/n.c"]["size"] == 5 and prints["b/n.c"]["extension"] == ".c" and len(prints["a/x.py"]["hash"]) == 64
    assert {r["path"]: r["content"] for r in files.collect()} == {"a/x.py": "print(1)\n", "b/n.c": "int", "m.md": "#", "a/__init__.py": "", ".hidden/_z.c": "x\ny\nz"}
    found = source.read_for_duplicates(spark, str(tmp_path))
    assert [r[0] for r in rows(found.where("problem IS NULL").select("path"))] == [".hidden/_z.c", "a/__init__.py", "a/x.py"]
    assert rows(source.rejects(found)) == rows(source.rejects(files)) == [("b/n.c", "not UTF-8")]


def test_what_cannot_be_read_is_told(spark, tmp_path, rows):
    for i in range(30):
        (tmp_path / f"{i:02d}.c").write_text("x" * (1000 if i == 7 else 10))
    listed = source.list_tree(spark, str(tmp_path))
    (tmp_path / "03.c").unlink()
    read = source.read_files(listed.withColumn("problem", F.when(F.col("path") == "05.c", "not listed: x")), str(tmp_path), task_bytes=100).cache()
    assert read.count() == 30 and [r[0] for r in rows(source.rejects(read))] == ["03.c", "05.c"]
    assert rows(source.rejects(read))[0][1].startswith("not read: ") and read.where("raw IS NULL AND content IS NULL").count() == 2
    sizes = [r["n"] for r in read.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("raw")).alias("n")).collect()]
    assert len(sizes) >= 4 and max(s for s in sizes if s < 1000) <= 110 + 10 + (1280 // max(spark.sparkContext.defaultParallelism, 13))
    assert source.read_files(listed.where("false"), str(tmp_path)).count() == 0


def test_a_large_folder_is_listed_piece_by_piece(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source, "LISTED", 10)
    for i in range(95):
        (tmp_path / f"{i}.c").touch()
    assert source.list_tree(spark, str(tmp_path)).select("path").distinct().count() == 95


def test_manifests_in_a_tree(spark, tmp_path, rows):
    for name, data in {"requirements.txt": b"a\r\nb\rc\n", "x/y/requirements.txt": b"c\nb\na", "node_modules/requirements.txt": b"a\nb\nc", "x/target/app.csproj": b""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = source.read_manifests(spark, str(tmp_path))
    assert rows(files.select("root", "filename")) == [("", "requirements.txt"), ("x/target", "app.csproj"), ("x/y", "requirements.txt")]
    assert rows(manifests.deps_clusters(files)) == [("pip:a,b,c", "", 2), ("pip:a,b,c", "x/y", 2)]


@pytest.mark.parametrize("path, suffix, stem", [("a/b.tar.gz", ".gz", "b.tar"), ("a/.bashrc", "", ".bashrc"), ("x.d/name", "", "name"), ("a.", "", "a."), ("p.SQL", ".SQL", "p")])
def test_names(spark, path, suffix, stem):
    from plumbline.functions import text

    df = spark.createDataFrame([(path,)], "p string")
    assert tuple(df.select(text.suffix(df.p), text.stem(df.p)).first()) == (suffix, stem)


@pytest.mark.parametrize("content", ["a\r\nb\nc\n", "", "a", "a\n\n", "\n", "a\x0bb\x1cc d\re", "a\r\n\r\nb"])
def test_lines_as_in_universal_newlines(spark, content):
    from plumbline.functions import text

    df = spark.createDataFrame([("p", content)], "path string, content string")
    assert [(r["line"], r["text"]) for r in text.explode_lines(df).orderBy("line").collect()] == list(enumerate(content.splitlines(), 1))
    assert df.select(text.strip(df.content)).first()[0] == content.strip()


def test_index_runs(spark, corpus, tmp_path, rows):
    folder, of = str(tmp_path / "index"), lambda files, root: duplicates.file_fingerprint(corpus(files), project_root=root)
    first = of({"a": "1", "b": "1"} | {f"x{i}": "1" for i in range(50)}, "p")
    assert sinks.read_index(spark, folder, first.schema, buckets=4).count() == 0
    assert sinks.merge_index(first, folder, 1, buckets=4) == 1
    second = of({"a": "2", "c": "3"}, "q")
    assert sinks.merge_index(second, folder, 2, buckets=4) == 2 == sinks.merge_index(first, folder, 1, buckets=4)
    index = sinks.read_index(spark, folder, first.schema, buckets=4)
    assert rows(index.where("length(path) = 1").select("path", "project_root")) == [("a", "q"), ("b", "p"), ("c", "q")] and index.count() == 53
    # Only the new rows of a merge are shuffled.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.join(second.repartition(3).select("path"), "path", "full")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1
    again = of({"b": "5"}, "r").union(of({"b": "5"}, "r"))
    sinks.merge_index(again, folder, 3, buckets=4)
    assert rows(sinks.read_index(spark, folder, first.schema, buckets=4).where("path = 'b'").select("project_root")) == [("r",)]


def test_reports(spark, corpus, tmp_path):
    index = sql_corpus.analyse(corpus({"p.sql": "CREATE PROC p AS INSERT INTO t SELECT 1 FROM s"}))
    deps = sql_corpus.table_deps(index)
    sinks.write_lineage(sql_corpus.lineage_catalog(deps), sql_corpus.lineage(sql_corpus.metrics(index), deps), str(tmp_path / "lineage"))
    nodes = [json.loads(line) for f in (tmp_path / "lineage" / "nodes").glob("*.json") for line in f.read_text().splitlines()]
    assert nodes == [{"proc": "p", "inputs": ["s"], "outputs": ["t"]}]
    sinks.write_csv(spark.createDataFrame([("ci_runs.total", "3")], "metric string, value string"), str(tmp_path / "csv"))
    assert "ci_runs.total,3" in "".join(f.read_text() for f in (tmp_path / "csv").glob("*.csv"))


def test_lineage_is_cut_in_the_shared_folder(spark):
    df = cut_lineage(spark.range(10))
    assert df.count() == 10 and "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")


def test_narrow_rows_that_become_files_are_dealt_to_tasks(spark, tmp_path):
    """One split of many parts is no single task, with nothing asked by the session."""
    from plumbline.plans.code_corpus import code
    from plumbline.sources.bindings import spread

    spark.range(2500).selectExpr("id AS p_partkey", "id % 50 AS p_size", "'part' AS p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    part = spark.read.parquet(f"{tmp_path}/part.parquet")
    dealt = spread(part, "p_partkey", 100)
    assert part.rdd.getNumPartitions() == 1 and spread(part, "p_partkey").rdd.getNumPartitions() == 1
    assert dealt.rdd.getNumPartitions() == 25 and max(dealt.rdd.glom().map(len).collect()) < 250
    assert sorted(r["p_partkey"] for r in dealt.collect()) == list(range(2500))
    assert code(spark, str(tmp_path), "c").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
