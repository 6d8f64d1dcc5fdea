"""Top-k helpers with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """Global top-k; planned as one bounded heap per task."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, group: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group.

    ``row_number() <= k`` is pushed below the shuffle, so at most ``k`` rows per group and map
    task move, however large one group is.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def latest(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """Last row per key as an aggregate with map-side combine, safe for keys with many rows."""
    rest = [c for c in df.columns if c not in key]
    return (
        df.groupBy(*key)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
        .select(*key, "_r.*")
    )


def first(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """First row per key, as :func:`latest`."""
    rest = [c for c in df.columns if c not in key]
    return (
        df.groupBy(*key)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
        .select(*key, "_r.*")
    )
