"""Timestamp rendering for transcript sinks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_timestamp(ms: Column, always_include_hours: bool = False, decimal_marker: str = ".") -> Column:
    """[HH:]MM:SS<marker>mmm from integer milliseconds (hours shown when asked or > 0)."""
    ms = ms.cast("long")
    h = F.floor(ms / 3_600_000)
    rest = ms - h * 3_600_000
    m = F.floor(rest / 60_000)
    rest = rest - m * 60_000
    s = F.floor(rest / 1000)
    milli = rest - s * 1000
    body = F.format_string(f"%02d:%02d{decimal_marker}%03d", m.cast("int"), s.cast("int"), milli.cast("int"))
    hours = F.format_string("%02d:", h.cast("int"))
    if always_include_hours:
        return F.concat(hours, body)
    return F.when(h > 0, F.concat(hours, body)).otherwise(body)
