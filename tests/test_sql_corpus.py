import pytest

from plumbline.operators import sql_corpus as op

PROC = """CREATE PROCEDURE [dbo].[load]
AS BEGIN
  IF 1 = 1 EXEC [dbo].[a]; execute b; sp_exec c
  INSERT INTO stage.t SELECT a.x, CASE WHEN a.y > 0
    THEN 1 ELSE 2 END
  FROM raw.s a INNER JOIN d1 ON a.id = b.id
    and a.k = b.k LEFT JOIN d2 ON c.id = b.id JOIN d3 alias ON 1 = 1
  WHERE a.v > 1 AND b.brand = 'x' OR
    c.z IS NULL
  GROUP BY a.x
  UPDATE t2 SET z = 1
END"""


@pytest.fixture(scope="module")
def index(corpus):
    return op.analyse(corpus({"src/Procedures/load.sql": PROC, "src/procedures/leaf.sql": "SELECT 1\r\nWHILE 1\n", "src/views/v.sql": "select * FROM (select 1) x",
                              "src/procedures/añb.sql": "CREATE PROC añb AS SELECT 1 FROM añb.t"})).cache()


def test_calls_and_tables(index, rows):
    assert [r[1] for r in rows(op.exec_deps(index))] == ["[dbo].[a]", "b", "c"]
    uses = {(r["dependency_name"], r["direction"]) for r in op.table_deps(index).collect()}
    assert uses == {("stage.t", "OUTPUT"), ("raw.s", "INPUT"), ("d1", "INPUT"), ("d2", "INPUT"), ("d3", "INPUT"), ("t2", "OUTPUT"), ("añb.t", "INPUT")}


def test_metrics(index):
    got = {r["path"].split("/")[-1]: (r["line_count"], r["proc_name"], r["crud_operations"], r["complexity_score"]) for r in op.metrics(index).collect()}
    assert got == {"load.sql": (12, "[dbo].[load]", "CRU", 3), "leaf.sql": (2, "leaf", "R", 1), "v.sql": (1, "v", "R", 0), "añb.sql": (1, "añb", "R", 0)}


def test_logic(corpus):
    r = op.logic(corpus({"p": PROC, "q": "SELECT 1"})).where("path = 'p'").first()
    assert r["target"] == "stage.t"
    assert [tuple(j) for j in r["joins"]] == [("d1", "a.id = b.id\n    and a.k = b.k"), ("d2", "c.id = b.id")]
    assert r["filters"] == ["a.v > 1", "b.brand = 'x'", "c.z IS NULL"]
    assert r["complex_logic"] == ["CASE WHEN a.y > 0\n    THEN 1 ELSE 2 END"]
    sections = {(s["section"], s["ordinal"], s["text"]) for s in op.spec_rows(op.logic(corpus({"q": "SELECT 1"}))).collect()}
    assert sections == {("objective", 1, "Result Set")}


def test_leaves(spark, index, rows):
    deps = op.exec_deps(index)
    assert [r["path"] for r in op.leaves(op.metrics(index), deps).collect()] == ["src/procedures/leaf.sql", "src/procedures/añb.sql"]
    assert op.leaves(op.metrics(index), deps, max_lines=1).count() == 1 and op.leaves(op.metrics(index), deps, max_lines=0).count() == 2
    unknown = deps.withColumn("caller_path", op.F.lit(None).cast("string"))
    assert op.leaves(op.metrics(index), deps.unionByName(unknown)).count() == 0


def test_lineage(index, corpus, rows):
    sets = {r["proc"]: (r["inputs"], r["outputs"]) for r in op.lineage(op.metrics(index), op.table_deps(index)).collect()}
    assert sets == {"[dbo].[load]": (["d1", "d2", "d3", "raw_s"], ["stage_t", "t2"]), "leaf": ([], ["leaf_output"]), "v": ([], ["v_output"]),
                    "añb": (["añb_t"], ["añb_output"])}
    twice = op.analyse(corpus({"a.sql": "CREATE PROC p AS SELECT 1 FROM x", "b.sql": "CREATE PROC p AS INSERT INTO y SELECT 1"}))
    sets = {r["proc"]: (r["inputs"], r["outputs"]) for r in op.lineage(op.metrics(twice), op.table_deps(twice)).collect()}
    assert sets == {"p": ([], ["y"]), "a.sql": (["x"], ["a.sql_output"])}


@pytest.mark.parametrize("text, start", [("truncate table a; insert into a select 1", "Full Refresh"), ("MERGE INTO a", "Upsert"),
                                         ("insert into a select 1", "Data Transfer"), ("select 1", "Data Retrieval"), (None, "Procedural Logic")])
def test_summaries(spark, text, start):
    df = spark.createDataFrame([("p", text)], "path string, content string")
    assert op.summaries(df).first()["summary"].startswith(start)
