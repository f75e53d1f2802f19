"""Schemas of raw log lines, events and session state."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

#: Keys of a log line that are read; all others are ignored.
RAW = StructType(
    [
        StructField("timestamp", StringType()),
        StructField("clientRequestPath", StringType()),
        StructField("resourceID", LongType()),
        StructField("cacheStatus", StringType()),
        StructField("responseBytes", LongType()),
        StructField("timeToFirstByteMs", LongType()),
        StructField("tcpRTTus", LongType()),
        StructField("requestTimeMs", LongType()),
        StructField("responseStatus", IntegerType()),
        StructField("clientCountry", StringType()),
        StructField("locationID", StringType()),
        StructField("clientIP", StringType()),
        StructField("clientRequestUserAgent", StringType()),
    ]
)

EVENT = StructType(
    [
        StructField("timestamp", TimestampType()),
        StructField("request_path", StringType()),
        StructField("stream_id", StringType()),
        StructField("resource_id", LongType()),
        StructField("cache_status", StringType()),
        StructField("response_bytes", LongType()),
        StructField("time_to_first_byte_ms", LongType()),
        StructField("tcp_rtt_us", LongType()),
        StructField("request_time_ms", LongType()),
        StructField("response_status", IntegerType()),
        StructField("client_country", StringType()),
        StructField("location_id", StringType()),
        StructField("client_ip", StringType()),
        StructField("device_type", StringType()),
        StructField("ua_unmatched", StringType()),
        StructField("track", StringType()),
        StructField("minute", TimestampType()),
        StructField("minute_key", StringType()),
        StructField("ingest_seq", LongType()),
    ]
)

SESSION = StructType(
    [
        StructField("stream_id", StringType()),
        StructField("client_ip", StringType()),
        StructField("first_seen", TimestampType()),
        StructField("last_seen", TimestampType()),
        StructField("device_type", StringType()),
        StructField("country", StringType()),
        StructField("region", StringType()),
        StructField("closed", BooleanType()),
    ]
)
