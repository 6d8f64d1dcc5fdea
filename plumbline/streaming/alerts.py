"""Alerts over streams: budget thresholds and degraded tools."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.observability import error_rates

# Keyed state lives in RocksDB, whose size the memory of a task doesn't bound.
STATE_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
ALERT = "org string, month date, threshold double, spend_usd double"


class MonthlySpend(StatefulProcessor):
    """The spend of one org and month so far, one row of state; a micro-batch that carries it over a threshold gives an alert."""

    def __init__(self, monthly_budget_usd: float, thresholds: tuple[float, ...]):
        self.limits = [(t, t * monthly_budget_usd) for t in thresholds]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spend = handle.getValueState("spend", "spend decimal(38,6)")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.spend.get()[0] if self.spend.exists() else Decimal(0)
        after = before + sum((amount for frame in rows for amount in frame["spend"]), Decimal(0))
        self.spend.update((after,))
        crossed = [(*key, share, float(after)) for share, limit in self.limits if float(before) < limit <= float(after)]
        if crossed:
            yield pd.DataFrame(crossed, columns=["org", "month", "threshold", "spend_usd"])

    def close(self) -> None:
        pass


def partial_spend(costs: DataFrame) -> DataFrame:
    """(org, month, spend): sums of the rows that one Arrow batch holds, so a busy org sends few rows to its key."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sums: dict[tuple, Decimal] = {}
            for org, month, cost in zip(frame["org"], frame["month"], frame["cost_usd"]):
                if cost is not None:
                    sums[org, month] = sums.get((org, month), Decimal(0)) + cost
            yield pd.DataFrame([(*k, v) for k, v in sums.items()], columns=["org", "month", "spend"])

    months = costs.select("org", F.trunc("ts", "month").alias("month"), "cost_usd")
    return months.mapInPandas(run, "org string, month date, spend decimal(38,6)")


def budget_alerts(costs: DataFrame, *, monthly_budget_usd: float, thresholds=(0.8, 1.0)) -> DataFrame:
    """Streaming (org, month, threshold, spend_usd): the spend that first reached a share of the budget, once each time it is crossed."""
    return partial_spend(costs).groupBy("org", "month").transformWithStateInPandas(
        MonthlySpend(monthly_budget_usd, tuple(thresholds)), outputStructType=ALERT, outputMode="Append", timeMode="None")


def start_budget_alerts(costs: DataFrame, store: str, *, monthly_budget_usd: float, thresholds=(0.8, 1.0),
                        available_now: bool = True) -> StreamingQuery:
    """Writes the alerts of a stream to ``store``; a replayed batch finds its state and its files as they were before it."""
    spark, (setting, provider) = costs.sparkSession, STATE_PROVIDER
    before = spark.conf.get(setting)
    spark.conf.set(setting, provider)
    try:
        writer = budget_alerts(costs, monthly_budget_usd=monthly_budget_usd, thresholds=thresholds).writeStream.outputMode("append").format(
            "parquet").option("path", f"{store}/alerts").option("checkpointLocation", f"{store}/_progress")
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.set(setting, before)


def read_budget_alerts(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(ALERT).parquet(f"{store}/alerts")


def degraded_tools(calls: DataFrame, *, window: str, lateness: str, threshold: float) -> DataFrame:
    """Streaming form of the degraded-tool report: tumbling windows, closed by the watermark.

    A late row counts as long as its window is open, and is left out once that is closed.
    """
    return error_rates(calls.withWatermark("ts", lateness), window=window).where(F.col("error_rate") > threshold)


def start_degraded_alerts(calls: DataFrame, store: str, *, window: str, lateness: str, threshold: float, available_now: bool = True) -> StreamingQuery:
    """Writes the windows above the threshold to ``store`` as they close."""
    writer = degraded_tools(calls, window=window, lateness=lateness, threshold=threshold).writeStream.outputMode("append").format(
        "parquet").option("path", f"{store}/alerts").option("checkpointLocation", f"{store}/_progress")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_degraded_alerts(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema("window_start timestamp, server string, tool string, calls bigint, errors bigint, error_rate double").parquet(f"{store}/alerts")
