"""Typed access to the JSON payload of an event."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import MONEY, PAYLOAD
from .text import once


def with_payload(events: DataFrame, name: str = "p") -> DataFrame:
    """Adds the parsed ``payload`` as a struct, unless it is stored next to it already."""
    if name in events.columns:
        return events
    return once(events, name, F.from_json("payload", PAYLOAD))


def money(text: Column) -> Column:
    """Text to a decimal amount, NULL when it is no number. Sums of it are exact in any order."""
    return text.try_cast("double").try_cast(MONEY)


def unknown_if_blank(key: Column) -> Column:
    """Label applied after grouping: NULL and '' both read 'unknown' but stay separate groups."""
    return F.coalesce(F.nullif(key, F.lit("")), F.lit("unknown"))
