"""A source tree as (path, content) rows.

Spark's file sources leave out empty files and names that start with ``_`` or ``.``, such as
``__init__.py``, so directories are listed and files read here, by tasks, through Arrow's file
systems.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import file_name, suffix
from ..session import cut_lineage
from ..vocab import DUPLICATE_SCAN_EXTENSIONS, IGNORED_DIRECTORIES, IGNORED_DIRECTORIES_SHORT

# Bytes one reading task is planned for, bytes of one batch it hands on, and entries of a folder that are handed on at a time.
TASK_BYTES = 128 * 2**20
BATCH_BYTES = 16 * 2**20
LISTED = 10_000


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    filesystem, base = pafs.FileSystem.from_uri(root if "://" in root else f"file://{os.path.abspath(root)}")
    return filesystem, base.rstrip("/")


def _entries(filesystem: pafs.FileSystem, folder: str) -> Iterator[tuple[str, int, bool]]:
    """(name, size, is_dir) of a folder. Links to folders are not followed, so links cannot loop."""
    if isinstance(filesystem, pafs.LocalFileSystem):
        with os.scandir(folder) as listing:
            for entry in listing:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.name, 0, True
                elif entry.is_file():
                    yield entry.name, entry.stat().st_size, False
    else:
        for info in filesystem.get_file_info(pafs.FileSelector(folder)):
            yield info.base_name, info.size or 0, info.type == pafs.FileType.Directory


def list_tree(spark: SparkSession, root: str, *, ignore: tuple[str, ...] = IGNORED_DIRECTORIES) -> DataFrame:
    """(path, size, problem) of all files below ``root``, paths relative to it; ignored directories are not entered.

    One job per directory level, each listing its directories in parallel and a large one piece by piece. A directory that can't be
    listed is a row with its ``problem``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, base = _open(root)
        for batch in batches:
            for folder in batch["path"]:
                rows: list[tuple] = []
                try:
                    for name, size, is_dir in _entries(filesystem, f"{base}/{folder}".rstrip("/")):
                        if not (is_dir and name in ignore):
                            rows.append((f"{folder}/{name}".lstrip("/"), size, is_dir, None))
                        if len(rows) == LISTED:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                except OSError as problem:
                    if not folder:  # without its root there is no tree
                        raise
                    rows.append((folder, 0, False, f"not listed: {problem.strerror or type(problem).__name__}"))
                yield pd.DataFrame(rows, columns=columns)

    columns = ["path", "size", "is_dir", "problem"]
    level, found = spark.createDataFrame([("",)], "path string"), []
    while not level.isEmpty():
        listed = cut_lineage(level.mapInPandas(run, "path string, size bigint, is_dir boolean, problem string"))
        found.append(listed.where(~F.col("is_dir")).select("path", "size", "problem"))
        level = listed.where("is_dir").select("path").repartition("path")
    files = found[0]
    for more in found[1:]:
        files = files.unionByName(more)
    return files


def planned(files: DataFrame, task_bytes: int) -> DataFrame:
    """``files`` dealt to tasks in path order by running sums of their sizes: each task has about ``task_bytes``, or one larger file."""
    spark = files.sparkSession
    placed = cut_lineage(files.repartitionByRange("path").withColumn("_range", F.spark_partition_id()))
    sums = sorted((r["_range"], r["total"]) for r in placed.groupBy("_range").agg(F.sum("size").alias("total")).collect())  # one row a task
    before, at = {}, 0
    for place, total in sums:
        before[place] = at
        at += total
    if not before:
        return placed.drop("_range")
    offset = F.broadcast(spark.createDataFrame(list(before.items()), "_range int, _offset bigint"))
    upto = Window.partitionBy("_range").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_offset") + F.coalesce(F.sum("size").over(upto), F.lit(0))
    tasks = max(spark.sparkContext.defaultParallelism, -(-at // task_bytes))
    share = max(1, -(-at // tasks))
    return placed.join(offset, "_range").withColumn("_task", F.floor(start / share).cast("int")).repartitionById(int(tasks), "_task").drop("_range", "_offset", "_task")


def read_files(files: DataFrame, root: str, *, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(path, raw, content, problem) of listed files, each task reading about as many bytes.

    A file that cannot be read has a null ``raw`` and ``content``; one that is not UTF-8 keeps what is. ``problem`` tells both, and null for none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, base = _open(root)
        rows, held = [], 0
        for batch in batches:
            for path, problem in zip(batch["path"], batch["problem"]):
                raw = None
                if problem is None:
                    try:
                        with filesystem.open_input_stream(f"{base}/{path}") as stream:
                            raw = stream.read()
                    except OSError as error:
                        problem = f"not read: {error.strerror or type(error).__name__}"
                rows.append((path, raw, problem))
                held += len(raw or b"")
                if held >= BATCH_BYTES or len(rows) >= LISTED:
                    yield pd.DataFrame(rows, columns=["path", "raw", "problem"])
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["path", "raw", "problem"])

    if "problem" not in files.columns:
        files = files.withColumn("problem", F.lit(None).cast("string"))
    read = planned(files.select("path", "size", "problem"), task_bytes).select("path", "problem").mapInPandas(run, "path string, raw binary, problem string")
    odd = F.when(F.col("raw").isNotNull() & ~F.is_valid_utf8(F.col("raw").cast("string")), "not UTF-8")
    return read.select("path", "raw", as_text(F.col("raw")).alias("content"), F.coalesce("problem", odd).alias("problem"))


def rejects(files: DataFrame) -> DataFrame:
    """(path, problem) of read files that are not there as a whole."""
    return files.where(F.col("problem").isNotNull()).select("path", "problem")


def as_text(raw: Column) -> Column:
    """Bytes as text: undecodable bytes are dropped, and every line end becomes a line feed."""
    text = raw.cast("string")
    clean = F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit("")))
    return F.regexp_replace(clean, r"\r\n?", "\n")


def read_tree(spark: SparkSession, root: str, *, ignore: tuple[str, ...] = IGNORED_DIRECTORIES) -> DataFrame:
    """All files below ``root`` with what is wrong with them, see :func:`rejects`. A file named like an ignored directory is left out too."""
    files = list_tree(spark, root, ignore=ignore)
    return read_files(files.where(~file_name(F.col("path")).isin(*ignore)) if ignore else files, root)


def with_extension(files: DataFrame, extensions: tuple[str, ...] = DUPLICATE_SCAN_EXTENSIONS) -> DataFrame:
    return files.where(suffix(F.col("path")).isin(*extensions))


def read_for_duplicates(spark: SparkSession, root: str) -> DataFrame:
    """Code files for the near-duplicate scan; files that can't be read or are not UTF-8 have a ``problem`` and a null ``content``."""
    listed = with_extension(list_tree(spark, root, ignore=IGNORED_DIRECTORIES_SHORT))
    return read_files(listed, root).select("path", F.when(F.col("problem").isNull(), F.col("content")).alias("content"), "problem")


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Manifests as (root, filename, content) for the dependency operators; ``root`` is the directory."""
    name = file_name(F.col("path"))
    listed = list_tree(spark, root, ignore=IGNORED_DIRECTORIES_SHORT)
    listed = listed.where(name.isin("package.json", "requirements.txt", "pom.xml") | name.endswith(".csproj"))
    directory = F.left("path", F.greatest(F.length("path") - F.length(name) - 1, F.lit(0)))
    return read_files(listed, root).where(F.col("raw").isNotNull()).select(directory.alias("root"), name.alias("filename"), "content")
