"""Epoch handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: seconds beyond a signed 32-bit count are taken for milliseconds.
LAST_SECOND = 2147483647


def norm_epoch(value: Column, digits: int | None = 3) -> Column:
    """Seconds since the epoch from seconds or milliseconds."""
    seconds = F.when(value > LAST_SECOND, value / 1000).otherwise(value)
    return seconds if digits is None else F.round(seconds, digits)


def utc(ts: Column) -> Column:
    """TIMESTAMP_NTZ read as UTC to TIMESTAMP, whatever the session time zone."""
    return F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone())


def epoch(ts: Column) -> Column:
    """TIMESTAMP to DOUBLE epoch seconds with microseconds."""
    return F.unix_micros(ts) / F.lit(1000000.0)


def emit_ts(cust_ts: Column, window_end: Column, add_timestamps: bool) -> Column:
    """Custom time if there is one (zero counts as none), else the window end or NULL."""
    own = F.nullif(cust_ts, F.lit(0.0))
    return F.coalesce(own, epoch(window_end)) if add_timestamps else own


def micros(seconds: float) -> str:
    """Interval text for ``window`` and ``withWatermark``."""
    return f"{round(seconds * 1000000)} microseconds"
