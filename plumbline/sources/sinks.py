"""Writers of reports, lineage and index tables, and the readers of the index."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import latest


def write_json(df: DataFrame, folder: str) -> None:
    """A report or an event dump as JSON lines."""
    df.write.mode("overwrite").json(folder)


def write_csv(df: DataFrame, folder: str) -> None:
    """Flat rows, such as the (metric, value) form of the summary."""
    df.write.mode("overwrite").option("header", "true").csv(folder)


def write_lineage(catalog: DataFrame, nodes: DataFrame, folder: str) -> None:
    """Data-set entries and procedure nodes of the lineage, each a set of JSON lines."""
    write_json(catalog, f"{folder}/catalog")
    write_json(nodes, f"{folder}/nodes")


# Buckets of an index; a run's rows are shuffled to them, rows that are there already are not.
INDEX_BUCKETS = 64


def _index_table(spark: SparkSession, folder: str, run: int, schema: T.StructType, buckets: int) -> str:
    """A table name for one run of an index; the files of the run, in buckets by path, belong to the folder."""
    name = f"index_{zlib.crc32(folder.encode()):08x}_{run}"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (path) SORTED BY (path) INTO {buckets} BUCKETS LOCATION '{folder}/run={run}'")
    return name


def last_run(spark: SparkSession, folder: str) -> int:
    """The last run that is complete, 0 for none."""
    spark.createDataFrame([(True,)], "complete boolean").coalesce(1).write.mode("ignore").parquet(f"{folder}/runs/run=0")
    return spark.read.schema("complete boolean, run int").parquet(f"{folder}/runs").agg(F.max("run")).first()[0]


def merge_index(rows: DataFrame, folder: str, run: int, *, buckets: int = INDEX_BUCKETS) -> int:
    """Merges one indexing run into the index and returns the run it then stands at; a repeated or older run changes nothing.

    The index is bucketed and sorted by path, so only ``rows`` are shuffled: they meet their bucket, replace rows of their path, and
    the merged bucket is written as the files of the new run. Of several rows of a path the one with the largest hash of its values stays.
    Readers switch by the mark that is written last. All runs have the buckets of the first.
    """
    spark = rows.sparkSession
    before = last_run(spark, folder)
    if run <= before:
        return before
    names = rows.columns
    new = latest(rows.withColumn("_tie", F.xxhash64(*names)), ["path"], "_tie").select(*names)
    if before:
        old = spark.table(_index_table(spark, folder, before, rows.schema, buckets))
        both = old.select("path", F.struct(*names).alias("old")).join(new.select("path", F.struct(*names).alias("new")), "path", "full")
        new = both.select(F.coalesce("new", "old").alias("row")).select("row.*")
    name = _index_table(spark, folder, run, rows.schema, buckets)
    new.select(*names).write.mode("overwrite").insertInto(name)
    spark.createDataFrame([(True,)], "complete boolean").coalesce(1).write.mode("overwrite").parquet(f"{folder}/runs/run={run}")
    return run


def read_index(spark: SparkSession, folder: str, schema: T.StructType, *, buckets: int = INDEX_BUCKETS) -> DataFrame:
    """The latest row of each path, in buckets by path: lookups and joins on the path need no shuffle of it."""
    run = last_run(spark, folder)
    return spark.table(_index_table(spark, folder, run, schema, buckets)) if run else spark.createDataFrame([], schema)
