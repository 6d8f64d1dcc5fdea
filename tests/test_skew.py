import pytest
from pyspark.sql import functions as F

from plumbline.functions.skew import members_of_repeated_groups, skew_join


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), (F.col("id") % 2).alias("j"))
    right = spark.createDataFrame([("hot", 0, "a"), ("hot", 1, "b"), ("k1", 1, "c"), ("k1", 1, "d"), ("k2", 0, "e"), (None, 0, "f")], "k string, j bigint, v string")
    return left, right


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("on", [["k"], ["k", "j"]])
@pytest.mark.parametrize("slice_rows", [10, 10**6])
def test_same_rows_as_a_plain_join(sides, rows, how, on, slice_rows):
    left, right = sides
    right = right if len(on) == 2 else right.drop("j")
    split = skew_join(left, right, on, how, slice_rows=slice_rows)
    plain = left.join(right, on, how)
    assert rows(split.select(*plain.columns)) == rows(plain)


def test_hot_key_is_spread(spark, sides):
    left, right = sides
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        parts = skew_join(left, right.drop("j"), ["k"], slice_rows=10).where("k = 'hot'").select(F.spark_partition_id().alias("p"))
        counts = [r["count"] for r in parts.groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(counts) == 600 and len(counts) >= 10 and max(counts) < 200


def test_group_sizes(sides):
    left, _ = sides
    got = members_of_repeated_groups(left.select("id", "k"), "k", "copies")
    assert {(r["k"], r["copies"], r["count"]) for r in got.where("k = 'hot'").groupBy("k", "copies").count().collect()} == {("hot", 300, 300)}
