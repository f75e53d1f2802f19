"""Distinct viewers of a minute, by stream and one further dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.functions.text import is_video
from rillmark.sources.geo import NO_COUNTRY, NO_REGION, with_region

#: Suffix of each gauge and the dimensions it has besides the stream.
GAUGES = {
    "": (),
    "_by_device": ("device_type",),
    "_by_country": ("country",),
    "_by_resolution": ("track",),
    "_by_region": ("country", "region"),
}
_DIMENSIONS = ("device_type", "country", "track", "region")


def distinct_by_dimension(rows: DataFrame, keys: list[str], name: str, gauges: dict[str, tuple[str, ...]], who: str = "client_ip") -> DataFrame:
    """``metric_name``, the keys, the dimensions and ``value``: distinct ``who`` of every gauge's groups.

    One Expand over the grouping sets and two exchanges, however many gauges there are. Audio
    tracks and unknown regions give no series.
    """
    dims = [d for d in _DIMENSIONS if any(d in g for g in gauges.values())]
    cols = [*keys, *dims]
    sets = [[*map(F.col, keys), *[F.col(d) for d in dims if d in g]] for g in gauges.values()]
    grouped = rows.groupingSets(sets, *map(F.col, cols)).agg(F.grouping_id().alias("gid"), F.count_distinct(who).cast("double").alias("value"))
    label = None
    for suffix, own in gauges.items():
        gid = sum(1 << (len(cols) - 1 - cols.index(d)) for d in dims if d not in own)
        hit = F.col("gid") == gid
        label = F.when(hit, F.lit(name + suffix)) if label is None else label.when(hit, F.lit(name + suffix))
    out = grouped.withColumn("metric_name", label)
    if "track" in dims:
        out = out.where((F.col("metric_name") != name + "_by_resolution") | is_video(F.col("track")))
    if "region" in dims:
        out = out.where((F.col("metric_name") != name + "_by_region") | ~F.col("region").isin("", NO_REGION))
    return out.select("metric_name", *keys, *dims, "value")


def minute_viewers(events: DataFrame, geo: DataFrame | None = None, prefix: str = "") -> DataFrame:
    """The five viewer gauges of each minute. Country is the event's own, region comes from ``geo``."""
    country = F.when(F.coalesce("client_country", F.lit("")) == "", F.lit(NO_COUNTRY)).otherwise(F.col("client_country"))
    needed = events.select("minute", F.col("stream_id").alias("stream"), "device_type", country.alias("country"), "track", "client_ip")
    rows = with_region(needed, geo)
    return distinct_by_dimension(rows, ["minute", "stream"], prefix + "viewers", GAUGES)
