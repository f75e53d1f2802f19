"""Device classification of user agents, as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fragments by device, in the order in which they are tried.
APPLE_TV = ("appletv", "apple tv", "tvos")
ROKU = ("roku",)
FIRESTICK = "aft"
FIRESTICK_BOTH = ("amazon", "fire")
BOTS = ("bot", "crawler", "spider", "scraper", "headless", "frame capture", "yallbot")
OWN_APPS = ("baron", "virtualrailfan", "virtual railfan")
OWN_IOS = ("ios", "iphone", "ipad")
IOS = ("iphone", "ipad", "cpu os", "applecoremedia")
ANDROID = ("android", "androidxmedia3", "exoplayer", "dalvik")
INGEST_PREFIX = "lavf/"
INGEST = ("gstreamer", "gst-launch", "libgst")
LIBRARY = "cfnetwork/"
PLAYER = "darwin/"
BROWSERS = ("chrome", "firefox", "safari", "edge", "opera")
EMPTY_AGENT = "<empty>"
TRACKED_LENGTH = 300

_EDGES = r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$"


def decoded_agent(agent: Column) -> Column:
    """Percent-decoded and stripped; ``+`` and stray ``%`` stay as they are."""
    escaped = F.replace(F.regexp_replace(agent, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.regexp_replace(F.coalesce(F.try_url_decode(escaped), agent), _EDGES, "")


def _any(text: Column, fragments: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(f)) for f in fragments])


def _cascade(agent: Column) -> Column:
    """The device of the first rule that fits, else null. ``agent`` is decoded and lower-cased."""
    own = _any(agent, OWN_APPS)
    return (
        F.when(_any(agent, APPLE_TV), "apple_tv")
        .when(_any(agent, ROKU), "roku")
        .when(F.contains(agent, F.lit(FIRESTICK)) | (F.contains(agent, F.lit(FIRESTICK_BOTH[0])) & F.contains(agent, F.lit(FIRESTICK_BOTH[1]))), "firestick")
        .when(_any(agent, BOTS), "bots")
        .when(own & F.contains(agent, F.lit("android")), "android")
        .when(own & _any(agent, OWN_IOS), "ios")
        .when(_any(agent, IOS), "ios")
        .when(_any(agent, ANDROID), "android")
        .when(F.startswith(agent, F.lit(INGEST_PREFIX)) | _any(agent, INGEST), "streamology")
        .when(F.contains(agent, F.lit(LIBRARY)), "other")
        .when(F.contains(agent, F.lit(PLAYER)), "web")
        .when(_any(agent, BROWSERS), "web")
    )


def device_type(agent: Column) -> Column:
    """Device of a raw user agent; null, empty and unknown agents are ``other``."""
    return F.coalesce(_cascade(F.lower(decoded_agent(agent))), F.lit("other"))


def unmatched_agent(agent: Column) -> Column:
    """What an agent that no rule fits is tracked under, else null."""
    plain = decoded_agent(agent)
    key = F.when(F.coalesce(plain, F.lit("")) == "", F.lit(EMPTY_AGENT)).otherwise(F.substring(plain, 1, TRACKED_LENGTH))
    return F.when(_cascade(F.lower(plain)).isNull(), key)


def with_device(rows: DataFrame, agent: Column) -> DataFrame:
    """Adds ``device_type`` and ``ua_unmatched``.

    The decoded agent and the cascade's answer are columns of steps of their own: they are used
    many times, so the optimizer keeps the steps apart and each is computed once a row.
    """
    steps = rows.withColumn("_agent", decoded_agent(agent)).withColumn("_lower", F.lower("_agent")).withColumn("_device", _cascade(F.col("_lower")))
    key = F.when(F.coalesce("_agent", F.lit("")) == "", F.lit(EMPTY_AGENT)).otherwise(F.substring("_agent", 1, TRACKED_LENGTH))
    return (
        steps.withColumn("device_type", F.coalesce("_device", F.lit("other")))
        .withColumn("ua_unmatched", F.when(F.col("_device").isNull(), key))
        .drop("_agent", "_lower", "_device")
    )
