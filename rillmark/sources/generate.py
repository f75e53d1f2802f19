"""Synthetic edge logs of any size, from ``spark.range`` and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pools with their weights in a hundred, chosen so that each kind of device occurs.
AGENTS = (
    ("Mozilla/5.0 (Linux; Android 14; SM-S921B) Chrome/124.0 Mobile", 24),
    ("Mozilla/5.0 (Macintosh; Intel Mac OS X 14_4) Safari/617.1", 22),
    ("AppleCoreMedia/1.0.0 (iPad; U; CPU OS 17_4 like Mac OS X; de_de)", 18),
    ("Roku/DVP-12.5 (12.5.0.4178)", 14),
    ("AppleTV14,1/17.4", 9),
    ("Dalvik/2.1.0 (Linux; U; Android 11; AFTKA Build/RS8121)", 8),
    ("Lavf/60.16.100", 5),
)
CACHE = (("HIT", 64), ("MISS", 24), ("EXPIRED", 12))
STATUS = (("200", 70), ("206", 20), ("304", 4), ("404", 4), ("500", 2))
COUNTRIES = ("NL", "SE", "PL", "ES", "IT", "KR", "ZA", "AR")
BASE_MICROS = 1_773_576_000_000_000
#: Events, streams, addresses and locations of each tier of the harness.
TIERS = {"small": (10_000, 5, 1_000, 5), "medium": (100_000, 10, 10_000, 10), "large": (1_000_000, 20, 50_000, 15), "xl": (10_000_000, 50, 500_000, 20)}


def _draw(seed: int, salt: str, below: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(below))


def _weighted(pool: tuple[tuple[str, int], ...], draw: Column) -> Column:
    out, upto = F.lit(pool[-1][0]), 100
    for value, weight in reversed(pool):
        upto -= weight
        out = F.when(draw >= upto, F.lit(value)).otherwise(out) if upto else F.coalesce(F.when(draw < pool[0][1], F.lit(value)), out)
    return out


def log_lines(spark: SparkSession, n: int, streams: int, addresses: int, locations: int, seed: int = 42, spread_seconds: int = 120) -> DataFrame:
    """``n`` NDJSON lines (column ``value``) within two minutes; the same for the same arguments."""
    who = _draw(seed, "ip", addresses)
    stamp = F.timestamp_micros(F.lit(BASE_MICROS) + _draw(seed, "t", spread_seconds * 1_000_000))
    record = F.struct(
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.concat(F.lit("/"), F.md5(F.concat(F.lit("stream-"), _draw(seed, "stream", streams).cast("string"))), F.lit("/tracks-v3/seg.m3u8")).alias("clientRequestPath"),
        (F.lit(1693215245) + _draw(seed, "cdn", 2)).alias("resourceID"),
        _weighted(CACHE, _draw(seed, "cache", 100)).alias("cacheStatus"),
        (_draw(seed, "bytes", 2_000_000) + 500).alias("responseBytes"),
        (_draw(seed, "ttfb", 500) + 1).alias("timeToFirstByteMs"),
        (_draw(seed, "rtt", 90_000) + 1_000).alias("tcpRTTus"),
        (_draw(seed, "time", 1_000) + 1).alias("requestTimeMs"),
        _weighted(STATUS, _draw(seed, "status", 100)).cast("int").alias("responseStatus"),
        F.element_at(F.array(*map(F.lit, COUNTRIES)), (F.pmod(who, F.lit(len(COUNTRIES))) + 1).cast("int")).alias("clientCountry"),
        F.concat(F.lit("location-"), _draw(seed, "pop", locations).cast("string")).alias("locationID"),
        F.concat_ws(".", F.lit("10"), *[F.expr("0") + F.pmod(F.shiftright(who, s), F.lit(256)) for s in (16, 8, 0)]).alias("clientIP"),
        _weighted(AGENTS, _draw(seed, "agent", 100)).alias("clientRequestUserAgent"),
    )
    return spark.range(n).select(F.to_json(record).alias("value"), F.col("id").alias("line"))
