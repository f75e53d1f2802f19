"""The driver's ``events`` table seen as edge logs; SQL oracles repeat the same mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.functions import device, text, times

#: The agents that the mapping deals out.
AGENTS = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) Chrome/120.0.0.0",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Safari/605.1",
    "Roku/DVP-11.0 (11.0.0.4193)",
    "AppleTV11,1/11.1",
    "Dalvik/2.1.0 (Linux; U; Android 9; AFTMM Build/PS7633)",
    "Dalvik/2.1.0 (Linux; U; Android 13; Pixel 7)",
    "Lavf/61.7.100",
    "ExampleCrawler/1.0",
    "Virtual%20Railfan/2.1 (iOS 17)",
    "Baron Android App/3",
    "Matt IOS/7.0.9 CFNetwork/3860.400.51 Darwin/25.3.0",
    "Player+App Darwin/22",
    "UnknownDevice/1.0",
    "",
)
COUNTRIES = ("US", "CA", "GB", "DE", "FR", "JP", "AU", "BR", "IN", "MX", "")
PLACES = ("losangelesUSCA", "frankfurtDEHE", "tokyoJPTY", "londonGBEN")
TRACKS = ("v1", "v2", "V3", "a1")
REGIONS = ("California", "Texas", "Victoria", "Unknown")


def _pick(values: tuple[str, ...], index: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), F.expr(f"cast({index} as int)") + 1)


def edge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the whole table, with the columns of ``sources.logs.events``."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    path = F.when(F.expr("event_id % 50 = 0"), F.lit("/invalid/path.m3u8")).otherwise(
        F.concat(F.lit("/"), F.md5(F.concat(F.lit("stream-"), F.expr("cast(user_id % 5 as string)"))), F.lit("/tracks-"), _pick(TRACKS, "event_id % 4"), F.lit("/seg.m3u8"))
    )
    mapped = raw.withColumn("k", k).withColumn("request_path", path).withColumn("agent", _pick(AGENTS, "(user_id + event_id % 2) % 14"))
    kept = device.with_device(mapped.where(text.stream_id(F.col("request_path")) != ""), F.col("agent"))
    shaped = kept.select(
        F.expr("timestamp_micros(1773576000000000 + ((unix_micros(cast(ts as timestamp)) - 1704067200000000) div 720))").alias("timestamp"),
        "request_path",
        text.stream_id(F.col("request_path")).alias("stream_id"),
        F.expr("cast(1693215245 + user_id % 2 as bigint)").alias("resource_id"),
        F.when(F.expr("k % 10 < 7"), "HIT").when(F.expr("k % 10 < 9"), "MISS").otherwise("EXPIRED").alias("cache_status"),
        F.expr("cast(round(value * 100) as bigint)").alias("response_bytes"),
        F.expr("cast(if(k % 4 = 0, 0, 50 + event_id % 250) as bigint)").alias("time_to_first_byte_ms"),
        F.lit(0).cast("long").alias("tcp_rtt_us"),
        F.lit(0).cast("long").alias("request_time_ms"),
        F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 206).otherwise(200).alias("response_status"),
        _pick(COUNTRIES, "user_id % 11").alias("client_country"),
        _pick(PLACES, "k % 4").alias("location_id"),
        F.expr("concat('10.0.', user_id div 256, '.', user_id % 256)").alias("client_ip"),
        "device_type",
        "ua_unmatched",
        text.track(F.col("request_path")).alias("track"),
        F.col("event_id").alias("ingest_seq"),
    )
    return shaped.withColumn("minute", times.minute(F.col("timestamp"))).withColumn("minute_key", times.minute_key(F.col("timestamp")))


def geo_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each address: country by the tenth rule of the mapping, region by user."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    return users.select(
        F.expr("concat('10.0.', user_id div 256, '.', user_id % 256)").alias("client_ip"),
        _pick(COUNTRIES[:4], "user_id % 4").alias("country"),
        _pick(REGIONS, "user_id % 4").alias("region"),
    )
