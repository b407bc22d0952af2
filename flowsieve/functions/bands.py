"""Named bands for correlations and class imbalance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation_band(r: Column) -> Column:
    a = F.abs(r)
    return (
        F.when(a >= 0.99, "perfect").when(a >= 0.95, "strong").when(a >= 0.90, "high").otherwise("none")
    )


def imbalance_severity(largest_ratio: Column) -> Column:
    return (
        F.when(largest_ratio > 1000, "EXTREME")
        .when(largest_ratio > 100, "HIGH")
        .when(largest_ratio > 10, "MODERATE")
        .otherwise("LOW")
    )


def minute_of(ts: Column) -> Column:
    """Start of the minute; rows without a readable time fall to the current minute."""
    return F.date_trunc("minute", F.coalesce(ts, F.current_timestamp()))


def minute_label(ts: Column) -> Column:
    return F.date_format(ts, "HH-mm")
