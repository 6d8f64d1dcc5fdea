"""Declared schemas of the engine tables; nothing is inferred at read time."""

from pyspark.sql import types as T

WIRE_EVENT = T.StructType([
    T.StructField("event_type", T.StringType()),
    T.StructField("project_slug", T.StringType()),
    T.StructField("github_username", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("schema_version", T.StringType()),
    T.StructField("payload", T.StringType()),
])

# Timestamps are UTC wall-clock values without a zone, so no result depends on the session zone.
EVENTS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("project_slug", T.StringType()),
    T.StructField("github_username", T.StringType()),
    T.StructField("schema_version", T.StringType()),
    T.StructField("received_at", T.TimestampNTZType()),
    T.StructField("event_ts", T.TimestampNTZType()),
    T.StructField("payload", T.StringType()),
])

# Every value is read as text, as the JSON text operator does: true and "true" are the same.
PAYLOAD = T.StructType([
    T.StructField("tests_passed", T.StringType()),
    T.StructField("skill_name", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("estimated_cost_usd", T.StringType()),
])

MONEY = T.DecimalType(18, 6)

DAILY_ROLLUP = T.StructType([
    T.StructField("project_slug", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("day", T.DateType()),
    T.StructField("event_count", T.LongType()),
    T.StructField("daily_cost_usd", T.DecimalType(38, 6)),
])

RATE_CARD = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("input_usd_per_m", T.DoubleType()),
    T.StructField("output_usd_per_m", T.DoubleType()),
])
