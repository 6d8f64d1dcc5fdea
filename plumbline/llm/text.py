"""Words, columns and stable row numbers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

# White space between words.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SPACE_CLASS = r"[\x20\x09-\x0D]"

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words of UTF-8 text start and end."""
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_IS_SPACE[np.frombuffer(data, np.uint8)]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, null where it is null."""
    return column.cast(pa.binary()).to_pylist()


def added(df: DataFrame, columns: list[tuple[str, T.DataType]], drop: tuple[str, ...] = ()) -> T.StructType:
    """The schema of ``df`` without ``drop`` and with ``columns``, which replace columns of the same name."""
    names = {name for name, _ in columns} | set(drop)
    kept = [f for f in df.schema.fields if f.name not in names]
    return T.StructType([*kept, *[T.StructField(n, t) for n, t in columns]])


def extend(batch: pa.RecordBatch, schema: T.StructType, values: dict[str, pa.Array]) -> pa.RecordBatch:
    """A batch in the order of ``schema`` with ``values`` put in."""
    arrays = [values[f.name] if f.name in values else batch.column(f.name) for f in schema.fields]
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


def text_hash_mod(column, n: int):
    """crc32 of a value as text, modulo ``n``."""
    return F.crc32(column.cast("string")) % n


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` with what tells its rows apart: ``_key``, the id (null: smaller than any), and ``_crc``, a hash of the text."""
    return docs.withColumn("_key", F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))).withColumn("_crc", F.xxhash64(text))


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Numbers the rows of each group from 0 without a gap, in the given order.

    A range sort spreads even one large group over many tasks; each task counts its rows of a group,
    and the counts of the tasks before it are added. There is one count for each task and group in it.
    """
    placed = cut_lineage(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
                         .withColumn("_task", F.spark_partition_id()))
    schema = T.StructType([*placed.schema.fields, T.StructField("_local", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for batch in batches:
            keys = list(zip(*[batch.column(g).to_pylist() for g in group])) if group else [()] * batch.num_rows
            local = np.empty(len(keys), np.int64)
            for i, key in enumerate(keys):
                if key != last:
                    last, at = key, 0
                local[i] = at
                at += 1
            yield extend(batch, schema, {"_local": pa.array(local)})

    counts = placed.groupBy(*group, "_task").agg(F.count("*").alias("_n")).collect()
    before, offsets = {}, []
    for row in sorted(counts, key=lambda r: r["_task"]):
        key = tuple(row[g] for g in group)
        offsets.append((*key, row["_task"], before.get(key, 0)))
        before[key] = before.get(key, 0) + row["_n"]
    fields = [placed.schema[g] for g in group]
    table = df.sparkSession.createDataFrame(
        offsets, T.StructType([*fields, T.StructField("_task", T.IntegerType()), T.StructField("_before", T.LongType())]))
    # One row for each task and group that meet, at most tasks + groups.
    joined = placed.mapInArrow(count, schema).join(F.broadcast(table), [*group, "_task"])
    return joined.withColumn(name, F.col("_before") + F.col("_local")).drop("_task", "_before", "_local")
