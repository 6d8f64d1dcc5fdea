"""Joins whose left side may have a third of its rows on one key.

AQE splits a skewed join only when both inputs come straight from a shuffle. A side that was just
aggregated or made distinct on the join key does not, so these joins are split here by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Left rows of one key that one task takes.
SLICE_ROWS = 1_000_000
# Tasks over which rows with a NULL key, which match nothing, are spread.
NULL_SLICES = 512


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", *,
              sizes: DataFrame | None = None, slice_rows: int = SLICE_ROWS, salt: Column | None = None,
              partitions: int | None = None) -> DataFrame:
    """``left.join(right, on, how)`` with hot keys of ``left`` cut into slices of ``slice_rows``.

    ``sizes`` holds ``on`` and ``n``, the left rows per key; it is counted (with map-side combine)
    when not given. Keys above ``slice_rows`` number at most left rows / slice_rows, which bounds
    the broadcast. A left row goes to a slice by its own hash, or by ``salt``, a number that is the same whenever a task is run
    again: equal rows then go to different slices, and long columns aren't hashed. Right rows of a hot key are copied to each slice.
    ``how`` may be inner, left, left_semi or left_anti. ``partitions`` is for joins whose rows are many more than those joined: both sides
    are then dealt to that many tasks, where AQE would size them by the few bytes that go in.
    """
    if sizes is None:
        sizes = left.groupBy(*on).agg(F.count("*").alias("n"))
    hot = F.broadcast(sizes.where(F.col("n") > slice_rows).select(*on, F.ceil(F.col("n") / slice_rows).cast("int").alias("_slices")))
    slices = F.coalesce("_slices", F.lit(1))
    no_key = F.greatest(*[F.col(k).isNull() for k in on], F.lit(False))
    row_hash = F.xxhash64(*left.columns) if salt is None else salt
    cut = left.join(hot, on, "left").withColumn(
        "_slice", F.pmod(row_hash, F.when(no_key, NULL_SLICES).otherwise(slices)).cast("int")).drop("_slices")
    copies = right.join(hot, on, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("_slices")
    if partitions:
        cut, copies = cut.repartition(partitions, *on, "_slice"), copies.repartition(partitions, *on, "_slice")
    return cut.join(copies, [*on, "_slice"], how).drop("_slice")


# Rows that one task makes where both sides of a join have many rows of a key.
PAIRS_A_TASK = 10_000_000


def pair_join(left: DataFrame, right: DataFrame, on: list[str], a_task: int = PAIRS_A_TASK, *, counted: DataFrame | None = None) -> DataFrame:
    """Inner join whose rows are the pairs of each key: they are counted first, and left rows go to as many tasks as their pairs ask for.

    ``counted`` is a table with as many rows of each key as ``left``, where that is less work to read.
    """
    rows = left if counted is None else counted
    counted = rows.groupBy(*on).agg(F.count("*").alias("_left")).join(right.groupBy(*on).agg(F.count("*").alias("_right")), on)
    # No more slices than left rows.
    sizes = counted.select(*on, F.least(F.col("_left") * F.col("_right"), F.col("_left") * a_task).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, -(-total // a_task))
    return skew_join(left, right, on, sizes=sizes, slice_rows=a_task, partitions=tasks)


def members_of_repeated_groups(df: DataFrame, key: str, size: str, min_size: int = 2) -> DataFrame:
    """Rows whose ``key`` occurs at least ``min_size`` times, with the group size added.

    Sizes come from a combining count and are joined back, so no task holds a whole group.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    return skew_join(df, sizes, [key], sizes=sizes).withColumnRenamed("n", size)
