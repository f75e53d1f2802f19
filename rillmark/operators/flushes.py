"""Offsets of repeated flushes, the half-minute split and unmatched agents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.times import WINDOW_SECONDS, window_start

#: Fixed value: milliseconds between two flushes of the same minute.
STEP_MS = 100
FORGET_SECONDS = 3600


def batch_offsets(flushes: DataFrame, startup_ms: int = 0) -> DataFrame:
    """``flush, minute, n, offset_ms`` for distinct ``(flush, minute)``: the n-th flush of a minute, counted from 0."""
    nth = F.row_number().over(Window.partitionBy("minute").orderBy("flush")) - 1
    return flushes.select("flush", "minute").distinct().withColumn("n", nth.cast("long")).withColumn("offset_ms", (F.col("n") * STEP_MS + startup_ms).cast("long"))


def next_offsets(state: DataFrame, minutes: DataFrame, now: Column, startup_ms: int = 0) -> tuple[DataFrame, DataFrame]:
    """Flush state ``(minute, n, first_flush)`` after one more flush of ``minutes``, and their offsets.

    A minute whose first flush is more than an hour ago starts anew.
    """
    kept = state.where(F.col("first_flush") >= now - F.make_dt_interval(secs=F.lit(float(FORGET_SECONDS))))
    flushed = minutes.select("minute").distinct().withColumn("now", F.lit(True))
    both = kept.join(flushed, "minute", "full")
    after = both.select(
        "minute", (F.coalesce(F.col("n") + F.col("now").cast("int"), "n", F.lit(0))).cast("long").alias("n"),
        F.coalesce("first_flush", now).alias("first_flush"), F.coalesce("now", F.lit(False)).alias("flushed"),
    )
    offsets = after.where("flushed").select("minute", (F.col("n") * STEP_MS + startup_ms).cast("long").alias("offset_ms"))
    return after.drop("flushed"), offsets


def split_first_window(events: DataFrame, time: str = "timestamp") -> DataFrame:
    """Adds ``flush``: whether an event lies in the 29 seconds from the half minute of the earliest one."""
    first = events.agg(F.unix_seconds(window_start(F.min(time)))).first()[0]
    start = F.timestamp_seconds(F.lit(first))
    end = F.timestamp_seconds(F.lit(None if first is None else first + WINDOW_SECONDS))
    return events.withColumn("flush", (F.col(time) >= start) & (F.col(time) < end))


def unmatched_agents(events: DataFrame, most: int = 5000) -> DataFrame:
    """``agent, requests`` of agents that no device rule fits, the most frequent ``most`` of them."""
    return events.where("ua_unmatched is not null").groupBy(F.col("ua_unmatched").alias("agent")).agg(F.count("*").alias("requests")).orderBy(F.desc("requests"), "agent").limit(most)


def unmatched_summary(events: DataFrame, most: int = 5000) -> DataFrame:
    """``total, agents, overflow``: all unmatched requests, agents listed and requests of those beyond the list."""
    counts = events.where("ua_unmatched is not null").groupBy("ua_unmatched").agg(F.count("*").alias("n"))
    listed = counts.orderBy(F.desc("n"), "ua_unmatched").limit(most)
    every = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).select("total", F.lit(0).alias("agents"), F.col("total").alias("overflow"))
    own = listed.agg(F.count("*").alias("agents"), F.coalesce(F.sum("n"), F.lit(0)).alias("listed")).select(F.lit(0), "agents", -F.col("listed"))
    return every.union(own).agg(*[F.sum(c).alias(c) for c in ("total", "agents", "overflow")])
