"""Log lines and events for tests."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from rillmark.sources import logs

T0 = datetime(2026, 2, 3, 12, 0, tzinfo=timezone.utc)
STREAM = "9964aabb"


def line(seconds: float = 0.0, stream: str = STREAM, track: str = "v3", **fields) -> dict:
    stamp = (T0 + timedelta(seconds=seconds)).isoformat().replace("+00:00", "Z")
    return {
        "timestamp": stamp, "clientRequestPath": f"/{stream}/tracks-{track}/seg.m3u8", "resourceID": 1, "cacheStatus": "HIT", "responseBytes": 1000,
        "timeToFirstByteMs": 100, "tcpRTTus": 5, "requestTimeMs": 7, "responseStatus": 200, "clientCountry": "US", "locationID": "pop1",
        "clientIP": "10.0.0.1", "clientRequestUserAgent": "Roku/DVP-11.0",
    } | fields


def texts(*lines: dict | str) -> list[str]:
    return [x if isinstance(x, str) else json.dumps(x) for x in lines]


def parsed(spark, *lines: dict | str):
    rows = [(t, "file", i) for i, t in enumerate(texts(*lines))]
    return logs.events(logs.parsed(spark.createDataFrame(rows, "value string, file string, line long")), F.col("line"))


def values(df, *keys: str) -> dict:
    return {tuple(r[k] for k in keys): r["value"] for r in df.collect()}
