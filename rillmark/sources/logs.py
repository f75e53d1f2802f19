"""Edge logs: compressed NDJSON to events, in batch or as a stream."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark import schema
from rillmark.functions import device, text, times


def hour_prefixes(prefix: str, hours: int, now: datetime | None = None) -> list[str]:
    """``{prefix}/YYYYMMDD/HH`` of the last hours in UTC, oldest first; the current hour is the last."""
    now = (now or datetime.now(timezone.utc)).astimezone(timezone.utc)
    stamps = [now - timedelta(hours=h) for h in range(max(hours, 1) - 1, -1, -1)]
    return [f"{prefix.rstrip('/')}/{t:%Y%m%d}/{t:%H}" for t in stamps]


def line_place(block: str | Column = "_metadata.file_block_start") -> Column:
    """Where a line stands in its file, to order by: the start of its split, then its row in the task.

    Spark splits a large plain file and hands its splits to tasks in any order; a compressed
    file is one split.
    """
    block = F.col(block) if isinstance(block, str) else block
    return F.struct(block.alias("split"), F.monotonically_increasing_id().alias("row"))


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Non-blank lines with their file and their place in it, ``line``."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.option("recursiveFileLookup", "true").text(paths)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), line_place().alias("line")).where(
        F.rlike("value", F.lit(r"\S"))
    )


def hour_glob(prefix: str, hours: int, now: datetime | None = None) -> str:
    """One path pattern for the folders of ``hour_prefixes``, so that a poll lists no others."""
    root = prefix.rstrip("/")
    return f"{root}/{{{','.join(p[len(root) + 1 :] for p in hour_prefixes(root, hours, now))}}}"


def stream_lines(spark: SparkSession, path: str, files_per_batch: int | None = None, clean: str | None = None, archive: str | None = None, lookback_hours: int = 0) -> DataFrame:
    """A stream of the lines of new files with the split they stand in; rows are numbered by the batch. ``path`` may be a pattern.

    ``clean`` may be ``delete`` or ``archive`` once a file was processed. With ``lookback_hours``
    files that are older than so long before the newest one are left.
    """
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if lookback_hours:
        reader = reader.option("maxFileAge", f"{lookback_hours}h")
    if clean:
        reader = reader.option("cleanSource", clean)
        reader = reader.option("sourceArchiveDir", archive) if archive else reader
    return reader.load(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def parsed(lines: DataFrame) -> DataFrame:
    """Log records of ``lines``; a broken line has only nulls. File and line stay."""
    record = F.from_json("value", schema.RAW, {"mode": "PERMISSIVE"})
    return lines.select(record.alias("r"), "file", "line").select("r.*", "file", "line")


def read_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Records by Spark's own JSON reader with the fixed schema, for logs whose order doesn't matter."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.schema(schema.RAW).option("mode", "PERMISSIVE").json(paths)


def events(records: DataFrame, seq: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Events of log records: defaults, filters, stream, track and device.

    Dropped are records without a stamp that parses, without a path, or whose path doesn't begin
    with a hexadecimal stream id. ``seq`` is the order of arrival; columns in ``keep`` stay.
    """
    t, path = times.parsed_stamp(F.col("timestamp")), F.col("clientRequestPath")
    agent = F.coalesce("clientRequestUserAgent", F.lit(""))
    kept = records.where((F.length("timestamp") > 0) & (F.length(path) > 0)).where(text.stream_id(path) != "")
    shaped = device.with_device(kept, agent).select(
        t.alias("timestamp"),
        path.alias("request_path"),
        text.stream_id(path).alias("stream_id"),
        F.coalesce("resourceID", F.lit(0)).cast("long").alias("resource_id"),
        F.coalesce("cacheStatus", F.lit("UNKNOWN")).alias("cache_status"),
        F.coalesce("responseBytes", F.lit(0)).cast("long").alias("response_bytes"),
        F.coalesce("timeToFirstByteMs", F.lit(0)).cast("long").alias("time_to_first_byte_ms"),
        F.coalesce("tcpRTTus", F.lit(0)).cast("long").alias("tcp_rtt_us"),
        F.coalesce("requestTimeMs", F.lit(0)).cast("long").alias("request_time_ms"),
        F.coalesce("responseStatus", F.lit(0)).cast("int").alias("response_status"),
        F.coalesce("clientCountry", F.lit("XX")).alias("client_country"),
        F.coalesce("locationID", F.lit("unknown")).alias("location_id"),
        F.coalesce("clientIP", F.lit("0.0.0.0")).alias("client_ip"),
        "device_type",
        "ua_unmatched",
        text.track(path).alias("track"),
        (F.lit(0) if seq is None else seq).cast("long").alias("ingest_seq"),
        *keep,
    ).where("timestamp is not null")
    return shaped.withColumn("minute", times.minute(F.col("timestamp"))).withColumn("minute_key", times.minute_key(F.col("timestamp")))


def read_events(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Events of compressed or plain NDJSON files, with ``file`` and ``line``.

    ``ingest_seq`` is an id that rises within a split of a file. Where arrival order matters, as
    for sessions, ``sessions.in_arrival_order`` numbers each pair's events by file, then line.
    """
    return events(parsed(read_lines(spark, paths)), F.col("line.row"), keep=("file", "line"))


def from_objects(spark: SparkSession, rows: Iterable[Mapping | object]) -> DataFrame:
    """Events that a program made itself, as mappings or objects with the fields of ``schema.EVENT``.

    Missing fields are null, but for the minute and its key, which follow from the stamp.
    """
    field = lambda row, name: row.get(name) if isinstance(row, Mapping) else getattr(row, name, None)
    given = spark.createDataFrame([tuple(field(r, f.name) for f in schema.EVENT) for r in rows], schema.EVENT)
    t = F.col("timestamp")
    return given.withColumn("minute", F.coalesce("minute", times.minute(t))).withColumn("minute_key", F.coalesce("minute_key", times.minute_key(t)))


def file_report(lines: DataFrame) -> DataFrame:
    """Lines and events of each file."""
    ok = parsed(lines)
    t, path = times.parsed_stamp(F.col("timestamp")), F.col("clientRequestPath")
    good = F.coalesce((F.length(path) > 0) & (text.stream_id(path) != "") & t.isNotNull(), F.lit(False))
    return ok.groupBy("file").agg(F.count("*").alias("lines"), F.count(F.when(good, 1)).alias("events"))
