"""Labelled samples of metrics, as they are written out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.functions.text import series_text

RETENTION_DAYS = 7


def label_map(columns: Sequence[str], legacy: bool = True) -> dict[str, Column]:
    """Columns by label; with ``legacy`` the stream stands under ``stream_name`` too unless there is one."""
    labels = {c: F.col(c) for c in columns}
    if legacy and "stream" in labels and "stream_name" not in labels:
        labels["stream_name"] = F.col("stream")
    return labels


def recent(samples: DataFrame, now_ms: int | Column, time: str = "timestamp_ms") -> DataFrame:
    """Samples that aren't older than the retention at ``now_ms``."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return samples.where(F.col(time) >= now - F.lit(RETENTION_DAYS * 86_400_000))


def samples(metrics: DataFrame, labels: Sequence[str], now_ms: int | Column | None = None, offset_ms: int | Column = 0, legacy: bool = True, prefix: str = "") -> DataFrame:
    """``series, metric_name, labels, value, timestamp_ms`` of metrics with a ``minute`` or ``timestamp_ms``.

    ``series`` is the text form, ``labels`` the sorted pairs that a remote write sends. Where
    ``now_ms`` is given samples beyond the retention are dropped.
    """
    if "timestamp_ms" in metrics.columns:
        stamp = F.col("timestamp_ms") + offset_ms
    else:
        stamp = F.unix_millis("minute") + offset_ms
    own = label_map(labels, legacy)
    pairs = F.filter(
        F.array(*[F.struct(F.lit(k).alias("name"), own[k].cast("string").alias("value")) for k in sorted(own)]), lambda p: p["value"].isNotNull()
    ) if own else F.array().cast("array<struct<name:string,value:string>>")
    name = F.concat(F.lit(prefix), F.col("metric_name"))
    out = metrics.select(series_text(name, own).alias("series"), name.alias("metric_name"), pairs.alias("labels"), F.col("value").cast("double").alias("value"), stamp.cast("long").alias("timestamp_ms"))
    return out if now_ms is None else recent(out, now_ms)
