"""Watch-time counters, histogram and bands of closed sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.functions.times import BANDS, BUCKETS, watch_band

_COUNTS = ["sessions", "seconds", *[f"le_{b}" for b in BUCKETS], *[f"band_{label}" for _, label in BANDS]]


def watch_totals(closed: DataFrame) -> DataFrame:
    """One row a stream: sessions, their seconds, and counts below each bound and in each band."""
    below = [F.count(F.when(F.col("seconds") <= b, 1)).alias(f"le_{b}") for b in BUCKETS]
    bands = [F.count(F.when(watch_band(F.col("seconds")) == label, 1)).alias(f"band_{label}") for _, label in BANDS]
    return closed.groupBy(F.col("stream_id").alias("stream")).agg(
        F.count("*").alias("sessions"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), *below, *bands
    )


def add_totals(a: DataFrame, b: DataFrame) -> DataFrame:
    """Totals are additive: those of two sets of sessions are the sums."""
    return a.unionByName(b).groupBy("stream").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def watch_metrics(totals: DataFrame, prefix: str = "") -> DataFrame:
    """``metric_name, stream, le, band, value``; all bands and bounds of a stream, zeros too."""
    none = F.lit(None).cast("string")
    row = lambda name, value, le=none, band=none: F.struct(
        F.lit(prefix + name).alias("metric_name"), le.alias("le"), band.alias("band"), F.col(value).cast("double").alias("value")
    )
    rows = [
        row("watch_sessions_total", "sessions"),
        row("watch_time_seconds_total", "seconds"),
        row("watch_session_duration_seconds_sum", "seconds"),
        row("watch_session_duration_seconds_count", "sessions"),
        *[row("watch_session_duration_band_total", f"band_{label}", band=F.lit(label)) for _, label in BANDS],
        *[row("watch_session_duration_seconds_bucket", f"le_{b}", le=F.lit(str(b))) for b in BUCKETS],
        row("watch_session_duration_seconds_bucket", "sessions", le=F.lit("+Inf")),
    ]
    return totals.select("stream", F.explode(F.array(*rows)).alias("m")).select("m.metric_name", "stream", "m.le", "m.band", "m.value")
