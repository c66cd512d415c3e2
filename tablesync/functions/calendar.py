"""Calendar buckets and ages, in UTC (timestamps without zone)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(when: Column, tier: str) -> Column:
    """Name of the day, ISO week or month that holds a timestamp."""
    if tier == "daily":
        return F.date_format(when, "yyyy-MM-dd")
    if tier == "weekly":
        return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), when), F.weekofyear(when))
    if tier == "monthly":
        return F.date_format(when, "yyyy-MM")
    raise ValueError(f"unknown tier {tier}")


def younger_than(when: Column, now: Column, seconds: Column) -> Column:
    """now - when < seconds, strictly."""
    return (now - when) < F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
