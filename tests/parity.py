"""Compares registered queries with their SQL in DuckDB. Also a command: parity.py [folder] [name...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([row[i] for i in order] for row in rows), key=lambda r: [str(v) for v in r])


def plan_problem(df) -> str:
    """All-pairs joins and row-at-a-time Python have no place in any plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = [n for n in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if n in plan]
    return f"plan has {found}" if found else ""


def compare(spark, con, build, sql: str, folder: str) -> str:
    """Empty text when both give the same rows, else what differs."""
    df = build(spark, folder)
    unwanted = plan_problem(df)
    if unwanted:
        return unwanted
    mine = normal([tuple(r) for r in df.collect()], df.columns)
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = normal(result.fetchall(), columns)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    kinds = {c: t for c, t in df.dtypes}
    widths = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
              "timestamp_ntz": "TIMESTAMP"}
    wrong = [(d[0], kinds[d[0]], str(d[1])) for d in result.description if str(d[1]) not in (widths.get(kinds[d[0]]), "STRING")
             and not (kinds[d[0]] == "string" and str(d[1]) == "VARCHAR")]
    if wrong:
        return f"types {wrong}"
    if len(mine) != len(theirs):
        only = [r for r in theirs if r not in mine][:2] if len(theirs) < 20000 else ""
        also = [r for r in mine if r not in theirs][:2] if len(mine) < 20000 else ""
        return f"rows {len(mine)} vs {len(theirs)}; only sql {only}; only spark {also}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{sorted(df.columns)}\n   spark {a}\n   sql   {b}"
    return ""


def main(argv: list[str]) -> int:
    import __spark_entry__ as e
    from plumbline.session import build_session

    folder = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")]
    spark = build_session("parity", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, checks, bad = e.queries(), e.oracle_sql(), 0
    for name, build in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t0 = time.time()
        try:
            if name in checks:
                problem = compare(spark, con, build, checks[name], folder)
                note = "same"
            else:
                problem, note = "", f"rows only: {build(spark, folder).count()}"
        except Exception as ex:  # report and go on with the next query
            problem, note = f"{type(ex).__name__}: {str(ex)[:1200]}", ""
        bad += bool(problem)
        print(f"{name:28s} {time.time() - t0:6.1f}s  {('DIFFERENT ' + problem) if problem else note}", flush=True)
    print("different:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
