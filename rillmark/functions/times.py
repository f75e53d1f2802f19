"""Minutes, windows and durations. The session's time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats, watch bands (upper bound in seconds) and histogram bounds.
MINUTE_KEY = "dd/MMM/yyyy HH:mm"
ISO_STAMP = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"
BANDS = ((60, "0_1m"), (300, "1_5m"), (1200, "5_20m"), (3600, "20_60m"), (None, "60m_plus"))
BUCKETS = (60, 180, 300, 600, 1200, 1800, 3600, 7200)
WINDOW_ALIGN, WINDOW_SECONDS = 30, 29


def parsed_stamp(text: Column) -> Column:
    """An ISO-8601 stamp, or null."""
    return F.when(F.rlike(text, F.lit(ISO_STAMP)), F.try_to_timestamp(text))


def minute(t: Column) -> Column:
    return F.date_trunc("MINUTE", t)


def minute_ms(t: Column, offset_ms: int | Column = 0) -> Column:
    """Start of the minute in milliseconds, with an offset."""
    return F.unix_millis(minute(t)) + (F.lit(offset_ms) if isinstance(offset_ms, int) else offset_ms)


def minute_key(t: Column) -> Column:
    return F.date_format(t, MINUTE_KEY)


def from_minute_key(key: Column) -> Column:
    return F.try_to_timestamp(key, F.lit(MINUTE_KEY))


def seconds_between(a: Column, b: Column) -> Column:
    """``b - a`` in seconds with fractions."""
    return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(1_000_000.0)


def watch_band(seconds: Column) -> Column:
    out = F.lit(BANDS[-1][1])
    for bound, label in reversed(BANDS[:-1]):
        out = F.when(seconds <= bound, label).otherwise(out)
    return out


def window_start(t: Column) -> Column:
    """The half minute that a stamp lies in."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(t) / WINDOW_ALIGN) * WINDOW_ALIGN)
