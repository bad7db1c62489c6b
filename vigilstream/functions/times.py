"""Intervals and the times of flows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of each unit; a year has 52 weeks.
UNITS = (("y", 52 * 7 * 86400), ("w", 7 * 86400), ("d", 86400), ("h", 3600), ("m", 60))


def interval_format(seconds: Column) -> Column:
    """1y2w3d4h5m6s: units that are zero are left out, seconds never."""
    left, out = seconds.cast("long"), []
    for name, size in UNITS:
        n = F.floor(left / size)
        out.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(name))).otherwise(F.lit("")))
        left = F.pmod(left, F.lit(size))
    return F.concat(*out, left.cast("string"), F.lit("s"))


def flow_millis(sec: Column, usec: Column) -> Column:
    return F.round(sec * 1000 + usec / F.lit(1000.0)).cast("long")


def millis(sec: Column, msec: Column) -> Column:
    return sec * 1000 + msec


def sys_millis(sec: Column, nsec: Column) -> Column:
    return F.round(sec * 1000 + nsec / F.lit(1e6)).cast("long")


def iso_time(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
