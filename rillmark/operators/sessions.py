"""Watch sessions of (stream, address) pairs as a fold over batches.

``advance`` takes the state, a batch of events and a reference time to the next state and the
sessions that closed. It is made of windows over each pair's own rows, so state of any size
is one shuffle, and its result is the same as handling the batch's events one at a time in
the order of their arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark import schema
from rillmark.functions.times import seconds_between
from rillmark.operators.viewers import distinct_by_dimension
from rillmark.sources.geo import NO_COUNTRY, with_region

KEY = ["stream_id", "client_ip"]
#: Gauges over session state.
UNIQUE_GAUGES = {"": (), "_by_device": ("device_type",), "_by_country": ("country",), "_by_region": ("country", "region")}


def session_events(events: DataFrame, geo: DataFrame | None = None) -> DataFrame:
    """What the fold reads of events. An empty country is the address's own, else ``XX``."""
    rows = with_region(events, geo)
    own = F.when(F.coalesce("client_country", F.lit("")) != "", F.col("client_country"))
    return rows.select(*KEY, F.col("timestamp").alias("t"), F.col("ingest_seq").alias("seq"), "device_type", F.coalesce(own, "geo_country", F.lit(NO_COUNTRY)).alias("country"), "region")


def session_batch_schema() -> str:
    """What ``advance`` expects of a batch."""
    return "stream_id string, client_ip string, t timestamp, seq long, device_type string, country string, region string"


def in_arrival_order(events: DataFrame) -> DataFrame:
    """Sets ``ingest_seq`` from file and line, numbered for each pair, so no global order is needed."""
    return events.withColumn("ingest_seq", F.row_number().over(Window.partitionBy(*KEY).orderBy("file", "line")).cast("long"))


def empty_state(spark) -> DataFrame:
    return spark.createDataFrame([], schema.SESSION)


def _accepted(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State rows as first events of their pairs, and the batch's events that are later than all before them."""
    before = state.select(
        *KEY, F.col("last_seen").alias("t"), F.lit(-1).cast("long").alias("seq"), "device_type", "country", "region", "first_seen", "closed"
    )
    now = batch.select(
        *KEY, "t", F.col("seq").cast("long").alias("seq"), "device_type", "country", "region",
        F.lit(None).cast("timestamp").alias("first_seen"), F.lit(False).alias("closed"),
    )
    earlier = Window.partitionBy(*KEY).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max("t").over(earlier)
    return before.unionByName(now).withColumn("latest", latest).where(F.col("latest").isNull() | (F.col("t") > F.col("latest"))).drop("latest")


def sessions_of(state: DataFrame, batch: DataFrame, gap_seconds: int) -> DataFrame:
    """All sessions that the state and the batch make, with ``is_last`` for the latest of a pair."""
    arrival = Window.partitionBy(*KEY).orderBy("seq")
    last_t, last_closed = F.lag("t").over(arrival), F.lag("closed").over(arrival)
    begins = last_t.isNull() | (seconds_between(last_t, F.col("t")) > gap_seconds) | last_closed
    numbered = (
        _accepted(state, batch)
        .withColumn("begins", begins.cast("int"))
        .withColumn("number", F.sum("begins").over(arrival.rowsBetween(Window.unboundedPreceding, 0)))
    )
    # a group of the pair's rows: still partitioned by the pair, so there's no other exchange
    latest = lambda c: F.max_by(c, "seq").alias(c)
    grouped = numbered.groupBy(*KEY, "number").agg(
        F.min(F.coalesce("first_seen", "t")).alias("first_seen"), F.max("t").alias("last_seen"),
        latest("device_type"), latest("country"), latest("region"), F.bool_or("closed").alias("was_closed"),
    )
    return grouped.withColumn("is_last", F.col("number") == F.max("number").over(Window.partitionBy(*KEY)))


def advance(state: DataFrame, batch: DataFrame, ref: Column, gap_seconds: int = 120, window_seconds: int = 7200) -> tuple[DataFrame, DataFrame]:
    """Next state, and ``stream_id, client_ip, first_seen, last_seen, seconds`` of the sessions that closed.

    A session closes if a later one began, if it was idle for more than the gap at ``ref``, or
    if it falls out of the window. What fell out of the window leaves the state.
    """
    gap_seconds = max(1, gap_seconds)
    all_sessions = sessions_of(state, batch, gap_seconds)
    idle = F.col("last_seen") < ref - F.make_dt_interval(secs=F.lit(float(gap_seconds)))
    gone = F.col("last_seen") < ref - F.make_dt_interval(secs=F.lit(float(window_seconds)))
    closed = all_sessions.where(~F.col("was_closed") & (~F.col("is_last") | idle | gone)).select(
        *KEY, "first_seen", "last_seen", F.greatest(F.lit(0.0), seconds_between(F.col("first_seen"), F.col("last_seen"))).alias("seconds")
    )
    kept = all_sessions.where(F.col("is_last") & ~gone).select(
        *KEY, "first_seen", "last_seen", "device_type", "country", "region", (F.col("was_closed") | idle).alias("closed")
    )
    return kept, closed


def batch_sessions(events: DataFrame, gap_seconds: int = 120, time: str = "timestamp") -> DataFrame:
    """Sessions of a closed set of events in order of time: ``session_window`` merges gaps up to the gap itself."""
    window = F.session_window(time, f"{gap_seconds} seconds")
    return (
        events.groupBy(*KEY, window)
        .agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count("*").alias("events"))
        .select(*KEY, "first_seen", "last_seen", "events", seconds_between(F.col("first_seen"), F.col("last_seen")).alias("seconds"))
    )


def _gauges(state: DataFrame, name: str) -> DataFrame:
    rows = state.withColumnRenamed("stream_id", "stream")
    return distinct_by_dimension(rows, ["stream"], name, UNIQUE_GAUGES)


def session_gauges(state: DataFrame, prefix: str = "") -> DataFrame:
    """Viewers in the session state, by stream, device, country and region."""
    return _gauges(state, prefix + "viewers")


def unique_gauges(state: DataFrame, ref: Column, window_seconds: int = 3600, prefix: str = "") -> DataFrame:
    """The same for sessions seen within the window before the minute of ``ref``."""
    cutoff = F.date_trunc("MINUTE", ref) - F.make_dt_interval(secs=F.lit(float(window_seconds)))
    return _gauges(state.where(F.col("last_seen") >= cutoff), prefix + "viewers_unique")
