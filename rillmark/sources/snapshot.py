"""Session snapshots in the compressed JSON form, version 2, and older rows."""

from __future__ import annotations

import gzip
import json
import os
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark import schema
from rillmark.functions.times import BANDS, BUCKETS

#: Format version, and keys of the watch part with the totals they hold.
VERSION = 2
_SIMPLE = {"sessions_total": "sessions", "time_seconds_total": "seconds", "duration_sum": "seconds", "duration_count": "sessions"}


def save(state: DataFrame, totals: DataFrame, path: str, window_seconds: int, gap_seconds: int, saved_at: datetime | None = None) -> int:
    """Write one snapshot file, whole or not at all; returns its sessions.

    The form is a single document, so rows stream through the driver a partition at a time.
    State that has to scale stays in the stream's Parquet tables.
    """
    saved_at = saved_at or datetime.now(timezone.utc)
    rows = state.select("stream_id", "client_ip", F.unix_seconds("first_seen"), F.unix_seconds("last_seen"), "device_type", "country", "region", "closed")
    watch = _watch_part([r.asDict() for r in totals.collect()])
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    partial = target.with_name(target.name + ".tmp")
    head = {"version": VERSION, "saved_at": saved_at.isoformat(), "window_seconds": window_seconds, "session_gap_seconds": gap_seconds}
    n = 0
    with gzip.open(partial, "wt", encoding="utf-8") as out:
        out.write(json.dumps(head, separators=(",", ":"))[:-1] + ',"rows":[')
        for row in rows.toLocalIterator():
            out.write(("," if n else "") + json.dumps(list(row), separators=(",", ":")))
            n += 1
        out.write('],"watch":' + json.dumps(watch, separators=(",", ":")) + "}")
    os.replace(partial, target)
    return n


def _watch_part(totals: list[dict]) -> dict:
    part = {key: {t["stream"]: t[own] for t in totals} for key, own in _SIMPLE.items()}
    part["duration_band_counts"] = {t["stream"]: {label: t[f"band_{label}"] for _, label in BANDS} for t in totals}
    part["duration_bucket_counts"] = {t["stream"]: {str(b): t[f"le_{b}"] for b in BUCKETS} for t in totals}
    return part


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """State and watch totals of a snapshot. Rows of eight, seven (no closed) and six columns (no first seen) are read."""
    text = spark.read.option("wholetext", "true").text(path)
    counts = "map<string,bigint>"
    shape = (
        "rows array<array<string>>, watch struct<sessions_total:{c},time_seconds_total:map<string,double>,"
        "duration_band_counts:map<string,{c}>,duration_bucket_counts:map<string,{c}>>"
    ).format(c=counts)
    doc = text.select(F.from_json("value", shape).alias("d")).select("d.*")
    row, size = F.col("r"), F.size("r")
    rows = doc.select(F.explode("rows").alias("r")).where(size.isin(6, 7, 8))
    # six columns lack the third of the others
    at = lambda i: F.when(size == 6, F.get(row, i - 1)).otherwise(F.get(row, i))
    stamp = lambda x: F.timestamp_seconds(x.cast("bigint"))
    state = rows.select(
        F.get(row, 0).alias("stream_id"), F.get(row, 1).alias("client_ip"), stamp(F.get(row, 2)).alias("first_seen"), stamp(at(3)).alias("last_seen"),
        at(4).alias("device_type"), at(5).alias("country"), at(6).alias("region"), F.coalesce(F.get(row, 7) == "true", F.lit(False)).alias("closed"),
    )
    streams = doc.select(F.explode("watch.sessions_total").alias("stream", "sessions"), "watch")
    of = lambda part, key: F.coalesce(F.col(f"watch.{part}")[F.col("stream")][key], F.lit(0)).alias(
        f"{'band' if 'band' in part else 'le'}_{key}"
    )
    totals = streams.select(
        "stream", "sessions", F.coalesce(F.col("watch.time_seconds_total")[F.col("stream")], F.lit(0.0)).alias("seconds"),
        *[of("duration_bucket_counts", str(b)) for b in BUCKETS], *[of("duration_band_counts", label) for _, label in BANDS],
    )
    return spark.createDataFrame([], schema.SESSION).union(state), totals


def restore(spark: SparkSession, path: str, ref: datetime, gap_seconds: int, window_seconds: int) -> tuple[DataFrame, DataFrame]:
    """A loaded snapshot after what is stale at ``ref`` was closed and dropped."""
    from rillmark.operators.sessions import advance, session_batch_schema
    from rillmark.operators.watch import add_totals, watch_totals

    state, totals = load(spark, path)
    none = spark.createDataFrame([], session_batch_schema())
    kept, closed = advance(state, none, F.timestamp_micros(F.lit(int(ref.timestamp() * 1_000_000))), gap_seconds, window_seconds)
    return kept, add_totals(totals, watch_totals(closed))
