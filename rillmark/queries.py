"""The engine's operators as registered queries over the driver's tables."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.functions import text, times
from rillmark.operators import compare, flushes, sessions, viewers, watch
from rillmark.operators.metrics import STANDARD, Agg, MetricSpec, label_names, minute_metrics
from rillmark.plans import promql
from rillmark.plans.samples import recent, samples
from rillmark.sources import fixture, geo, logs, remote_write, snapshot
from rillmark.workdir import work_path

Query = Callable[[SparkSession, str], DataFrame]
GAP, WINDOW, UNIQUE = 120, 7200, 3600
#: Events of one simulated file, and of the first of two simulated polls.
FLUSH_EVENTS = 2_500


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return fixture.edge_events(spark, sf_dir)


def _ms(column: str) -> Column:
    return F.unix_millis(column)


def _ref(events: DataFrame) -> Column:
    """The reference clock: the latest event time, one value."""
    micros = events.agg(F.max(F.unix_micros("timestamp"))).first()[0]
    return F.timestamp_micros(F.lit(0 if micros is None else micros))


def _plain(events: DataFrame) -> DataFrame:
    return events.select(
        "ingest_seq", _ms("timestamp").alias("ts_ms"), "stream_id", "resource_id", "cache_status", "response_bytes", "time_to_first_byte_ms",
        "response_status", "client_country", "location_id", "client_ip", "device_type", "ua_unmatched", "track", "minute_key",
    )


def parse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_events(spark, sf_dir))


def _json_lines(source: DataFrame) -> DataFrame:
    record = F.struct(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.col("request_path").alias("clientRequestPath"),
        F.col("resource_id").alias("resourceID"), F.col("cache_status").alias("cacheStatus"), F.col("response_bytes").alias("responseBytes"),
        F.col("time_to_first_byte_ms").alias("timeToFirstByteMs"), F.col("response_status").alias("responseStatus"),
        F.col("client_country").alias("clientCountry"), F.col("location_id").alias("locationID"), F.col("client_ip").alias("clientIP"),
    )
    return source.select(F.to_json(record).alias("value"), F.lit("memory").alias("file"), F.col("ingest_seq").alias("line"))


def parse_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through log lines: events written as JSON text, parsed again."""
    lines = _json_lines(_events(spark, sf_dir))
    return _plain(logs.events(logs.parsed(lines), F.col("line"))).drop("device_type", "ua_unmatched")


def gzip_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through compressed files of lines, listed and read again."""
    path = work_path(spark, "logs")
    _json_lines(_events(spark, sf_dir)).select("value").write.option("compression", "gzip").text(path)
    return _plain(logs.read_events(spark, path)).drop("ingest_seq", "device_type", "ua_unmatched")


def device_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("device_type").agg(F.count("*").alias("requests"))


def track_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("track", text.is_video(F.col("track")).alias("is_video")).agg(F.count("*").alias("requests"))


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute floor, minute milliseconds, key round trip, half-minute floor and watch band of every event."""
    t = F.col("timestamp")
    return _events(spark, sf_dir).select(
        "ingest_seq", F.unix_millis(times.minute(t)).alias("minute_floor_ms"), times.minute_ms(t, 100).alias("offset_minute_ms"),
        F.unix_millis(times.from_minute_key(times.minute_key(t))).alias("key_ms"), F.unix_millis(times.window_start(t)).alias("window_ms"),
        times.watch_band(F.col("response_bytes") / 10.0).alias("band"), text.escaped(F.concat(F.lit('a"\\'), "track")).alias("escaped"),
    )


def _metric_query(specs: tuple[MetricSpec, ...]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = minute_metrics(_events(spark, sf_dir), specs, prefix="cdn_")
        return out.select("metric_name", _ms("minute").alias("minute_ms"), *label_names(specs), "value")

    return run


CUSTOM = (
    MetricSpec("bytes_max", Agg.MAX, "response_bytes", {"stream": "stream_id", "device": "device_type"}),
    MetricSpec("bytes_min", Agg.MIN, "response_bytes", {"stream": "stream_id"}),
    MetricSpec("errors", Agg.COUNT, "response_status", {"stream": "stream_id"}, "response_status >= 500"),
    MetricSpec("bytes_mean", Agg.AVG, "response_bytes", {"pop": "location_id"}),
)


def _geo_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.with_region(_events(spark, sf_dir), fixture.geo_dimension(spark, sf_dir))


def minute_viewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = viewers.minute_viewers(_events(spark, sf_dir), fixture.geo_dimension(spark, sf_dir), "cdn_")
    return out.select("metric_name", _ms("minute").alias("minute_ms"), "stream", "device_type", "country", "track", "region", "value")


def geo_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _geo_events(spark, sf_dir).groupBy("geo_country", "region").agg(F.count("*").alias("requests"), F.count_distinct("client_ip").alias("addresses"))


def geo_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of 256 addresses, every fifth of which is missing from the dimension."""
    events = _events(spark, sf_dir)
    block = F.floor(geo.ip_number(F.col("client_ip")) / 256)
    ranges = events.select(block.alias("b")).distinct().where("b % 5 <> 4").select(
        (F.col("b") * 256).alias("ip_from"), (F.col("b") * 256 + 255).alias("ip_to"), F.concat(F.lit("C"), (F.col("b") % 3).cast("string")).alias("country"),
        F.concat(F.lit("R"), (F.col("b") % 7).cast("string")).alias("region"),
    )
    return geo.with_region_by_range(events, ranges).groupBy("geo_country", "region").agg(F.count("*").alias("requests"))


def geo_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of both families by their longest network: each /24 (or /120) but every fifth, and one large network around all.

    The table's third parts go beyond 255 where it has more than 65,536 users, and then are no parts of an address:
    here the users are counted on from 10.0.0.0 and 2001:db8::a00:0, to 4 thousand million of them.
    """
    events = _events(spark, sf_dir).select("client_ip")
    part = lambda i: F.get(F.split("client_ip", r"\."), i).cast("long")
    users = events.select((part(2) * 256 + part(3)).alias("user"))
    digits = lambda n, step: F.floor(n / step).cast("long")
    four = lambda n: F.concat_ws(".", *[(digits(n, step) % 256 + (10 if step == 1 << 24 else 0)).cast("string") for step in (1 << 24, 1 << 16, 1 << 8, 1)])
    six = lambda n, prefix: F.concat(F.lit(prefix), F.hex(digits(n, 1 << 16) + 0xA00), F.lit(":"), F.hex(n % 65536))
    user = F.col("user")
    low = users.select(digits(user, 256).alias("third")).distinct().withColumn("b", F.col("third") + 655360).where("b % 5 <> 4")
    place = [F.concat(F.lit("C"), (F.col("b") % 3).cast("string")).alias("country"), F.concat(F.lit("R"), (F.col("b") % 7).cast("string")).alias("region")]
    own = lambda network: low.select(network.alias("network"), *place)
    first = F.col("third") * 256
    networks = own(F.concat(four(first), F.lit("/24"))).union(own(F.concat(six(first, "2001:db8::"), F.lit("/120"))))
    networks = networks.union(spark.createDataFrame([("10.0.0.0/8", "C8", "R8"), ("0.0.0.0/0", "C8", "R8"), ("2001:db8::/33", "C9", "R9"), ("2001:db8:8000::/33", "C0", "R0"), ("none", "X", "X")], networks.schema))
    networks = networks.distinct()  # so that the lookup reads each network as a column, not as the expression above many times
    addresses = users.select(F.when(user.isNotNull(), four(user)).alias("client_ip")).union(users.select(six(user, "2001:DB8::")))
    found = geo.with_region_by_network(addresses, networks)
    family = F.when(F.contains("client_ip", F.lit(":")), 6).otherwise(4)
    return found.groupBy(family.alias("family"), "geo_country", "region").agg(F.count("*").alias("requests"))


def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session state written as a snapshot, in whole seconds, and read again."""
    state, closed, _ = _one_poll(spark, sf_dir)
    folder = tempfile.mkdtemp(prefix="rillmark-")
    snapshot.save(state, watch.watch_totals(closed), f"{folder}/state.json.gz", WINDOW, GAP)
    return _flat_state(snapshot.load(spark, f"file://{folder}/state.json.gz")[0])


def sample_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered samples written as lines of JSON and read again."""
    path = work_path(spark, "samples")
    remote_write.write_json(sample_render(spark, sf_dir), path)
    return spark.read.schema("series string, timestamp_ms long, value double").json(path)


def _session_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = _events(spark, sf_dir)
    return events, sessions.session_events(events, fixture.geo_dimension(spark, sf_dir))


def _one_poll(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Column]:
    events, batch = _session_batch(spark, sf_dir)
    ref = _ref(events)
    return (*sessions.advance(sessions.empty_state(spark), batch, ref, GAP, WINDOW), ref)


def _flat_state(state: DataFrame) -> DataFrame:
    return state.select("stream_id", "client_ip", _ms("first_seen").alias("first_ms"), _ms("last_seen").alias("last_ms"), "device_type", "country", "region", "closed")


def _flat_closed(closed: DataFrame) -> DataFrame:
    return closed.select("stream_id", "client_ip", _ms("first_seen").alias("first_ms"), _ms("last_seen").alias("last_ms"), "seconds")


def sessions_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sessions.batch_sessions(_events(spark, sf_dir), GAP)
    return out.select("stream_id", "client_ip", _ms("first_seen").alias("first_ms"), _ms("last_seen").alias("last_ms"), "events")


def session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_state(_one_poll(spark, sf_dir)[0])


def session_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_closed(_one_poll(spark, sf_dir)[1])


def _two_polls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Even files, then odd files: the second poll is late for many addresses."""
    events, batch = _session_batch(spark, sf_dir)
    late = F.expr(f"ingest_seq div {FLUSH_EVENTS} % 2 = 1")
    first, second = batch.where(~F.expr(f"seq div {FLUSH_EVENTS} % 2 = 1")), batch.where(F.expr(f"seq div {FLUSH_EVENTS} % 2 = 1"))
    state, closed = sessions.advance(sessions.empty_state(spark), first, _ref(events.where(~late)), GAP, WINDOW)
    after, more = sessions.advance(state, second, _ref(events), GAP, WINDOW)
    return after, closed.unionByName(more)


def session_two_polls_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_state(_two_polls(spark, sf_dir)[0])


def session_two_polls_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_closed(_two_polls(spark, sf_dir)[1])


def session_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_gauges(_one_poll(spark, sf_dir)[0], "cdn_")


def unique_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, _, ref = _one_poll(spark, sf_dir)
    return sessions.unique_gauges(state, ref, 600, "cdn_").withColumn("window", F.lit("10m"))


def _watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.watch_metrics(watch.watch_totals(_two_polls(spark, sf_dir)[1]), "cdn_")


def watch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _watch(spark, sf_dir).withColumn("value", F.round("value", 3))


def watch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of two disjoint sets of sessions, added."""
    closed = _two_polls(spark, sf_dir)[1]
    a, b = (watch.watch_totals(closed.where(c)) for c in ("hash(client_ip) % 2 = 0", "hash(client_ip) % 2 <> 0"))
    return watch.watch_metrics(watch.add_totals(a, b), "cdn_").withColumn("value", F.round("value", 3))


def _flushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.expr(f"ingest_seq div {FLUSH_EVENTS}").alias("flush"), "minute").distinct()


def batch_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = flushes.batch_offsets(_flushes(spark, sf_dir), 7)
    return out.select("flush", _ms("minute").alias("minute_ms"), "n", "offset_ms")


def batch_offsets_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of a third flush of all minutes: even files came first, odd ones an hour and a half later."""
    every = _flushes(spark, sf_dir)
    at = lambda m: F.timestamp_micros(F.lit(1_773_576_000_000_000 + m * 60_000_000))
    state = spark.createDataFrame([], "minute timestamp, n long, first_flush timestamp")
    state, _ = flushes.next_offsets(state, every.where("flush % 2 = 0"), at(0))
    state, _ = flushes.next_offsets(state, every.where("flush % 2 = 1"), at(90))
    _, offsets = flushes.next_offsets(state, every, at(91), 5)
    return offsets.select(_ms("minute").alias("minute_ms"), "offset_ms")


def window_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flushes.split_first_window(_events(spark, sf_dir)).select("ingest_seq", "flush")


def unmatched_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flushes.unmatched_agents(_events(spark, sf_dir), 10)


def unmatched_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flushes.unmatched_summary(_events(spark, sf_dir), 1)


def _traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minute_metrics(_events(spark, sf_dir), STANDARD[:1]).withColumn("timestamp_ms", _ms("minute")).drop("minute")


def sample_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = samples(_traffic(spark, sf_dir), label_names(STANDARD[:1]), offset_ms=100, prefix="cdn_")
    return out.select("series", "value", "timestamp_ms")


def sample_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples kept when the clock stands seven days after the hour's middle."""
    now = 1_773_576_000_000 + 30 * 60_000 + 7 * 86_400_000
    return recent(_traffic(spark, sf_dir), now).select("stream", "cdn_id", "cache_status", "pop", "timestamp_ms", "value")


def rate_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_stream = promql.sum_by(_traffic(spark, sf_dir), ["stream"])
    return promql.rate(per_stream, ["stream"], 300).select("stream", "timestamp_ms", F.round("rate", 6).alias("rate"), F.round(F.col("rate") * 8, 6).alias("bits"))


def over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = promql.over_time(promql.sum_by(_traffic(spark, sf_dir), ["stream"]), ["stream"], 600)
    return out.select("stream", "timestamp_ms", "max_over_time", F.round("avg_over_time", 6).alias("avg_over_time"), "sum_over_time")


def sum_by_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promql.sum_by(_traffic(spark, sf_dir), ["pop"]).select("pop", "timestamp_ms", "value")


def avg_ttfb_by_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    ttfb = minute_metrics(_events(spark, sf_dir), STANDARD[1:2]).withColumn("timestamp_ms", _ms("minute"))
    return promql.avg_by(ttfb, ["pop"]).select("pop", "timestamp_ms", F.round("value", 6).alias("value"))


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minute_metrics(_events(spark, sf_dir), STANDARD[3:4]).withColumn("timestamp_ms", _ms("minute"))


def label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _statuses(spark, sf_dir).where(promql.matches("response_status", "5..|206"))
    return promql.sum_by(found, ["response_status"]).select("response_status", "timestamp_ms", "value")


def error_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _statuses(spark, sf_dir)
    keys = ["stream", "timestamp_ms"]
    out = promql.ratio(promql.sum_by(every.where(promql.matches("response_status", "5..")), ["stream"]), promql.sum_by(every, ["stream"]), keys)
    return out.select(*keys, F.round("ratio", 9).alias("ratio"))


def topk_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = minute_metrics(_events(spark, sf_dir), STANDARD[6:7]).withColumn("timestamp_ms", _ms("minute"))
    top = promql.topk(users, 3, ["stream", "country"])
    return top.select("timestamp_ms", "stream", "country", "value", F.col("rank").cast("long").alias("rank"))


def _counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cumulative counter of sessions by minute, which restarts at the half hour."""
    closed = _two_polls(spark, sf_dir)[1].select(F.col("stream_id").alias("stream"), _ms(F.date_trunc("MINUTE", "last_seen")).alias("timestamp_ms"))
    per = closed.groupBy("stream", "timestamp_ms").agg(F.count("*").alias("n"))
    half = F.expr("timestamp_ms >= 1773577800000")
    from pyspark.sql import Window

    running = F.sum("n").over(Window.partitionBy("stream", half).orderBy("timestamp_ms"))
    return per.withColumn("value", running.cast("double")).drop("n")


def counter_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promql.counter_increase(_counter(spark, sf_dir), ["stream"], 600).select("stream", "timestamp_ms", "value", "increase")


def histogram_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = _watch(spark, sf_dir).where("le is not null")
    out = promql.histogram_quantile(0.9, buckets, ["stream"])
    return out.select("stream", F.round("quantile", 6).alias("quantile"))


def diff_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by all events against those without tablets of one location and without one cache state."""
    keys = label_names(STANDARD[2:3])
    events = _events(spark, sf_dir)
    a = minute_metrics(events, STANDARD[2:3]).groupBy(*keys).agg(F.sum("value").alias("value"))
    b = minute_metrics(events.where("cache_status <> 'EXPIRED' and not (location_id = 'tokyoJPTY' and client_country = 'US')"), STANDARD[2:3]).groupBy(*keys).agg(F.sum("value").alias("value"))
    return compare.compare_series(a, b, keys)


def event_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("stream_id").agg(F.min(_ms("timestamp")).alias("first_ms"), F.max(_ms("timestamp")).alias("last_ms"), F.count("*").alias("events"))


QUERIES: dict[str, Query] = {
    "parse_events": parse_events,
    "parse_ndjson": parse_ndjson,
    "device_classify": device_classify,
    "track_extract": track_extract,
    "scalar_functions": scalar_functions,
    **{f"metric_{s.name}": _metric_query((s,)) for s in STANDARD},
    "minute_metrics": _metric_query(STANDARD),
    "custom_metrics": _metric_query(CUSTOM),
    "minute_viewers": minute_viewers,
    "geo_join": geo_join,
    "geo_range_join": geo_range_join,
    "geo_networks": geo_networks,
    "gzip_logs": gzip_logs,
    "snapshot_round_trip": snapshot_round_trip,
    "sample_sink": sample_sink,
    "event_time_range": event_time_range,
    "sessions_batch": sessions_batch,
    "session_state": session_state,
    "session_closed": session_closed,
    "session_two_polls_state": session_two_polls_state,
    "session_two_polls_closed": session_two_polls_closed,
    "session_gauges": session_gauges,
    "unique_gauges": unique_gauges,
    "watch_metrics": watch_metrics,
    "watch_merge": watch_merge,
    "batch_offsets": batch_offsets,
    "batch_offsets_fold": batch_offsets_fold,
    "window_split": window_split,
    "unmatched_topk": unmatched_topk,
    "unmatched_summary": unmatched_summary,
    "sample_render": sample_render,
    "sample_retention": sample_retention,
    "rate_5m": rate_5m,
    "over_time": over_time,
    "sum_by_pop": sum_by_pop,
    "avg_ttfb_by_pop": avg_ttfb_by_pop,
    "label_match": label_match,
    "error_ratio": error_ratio,
    "topk_country": topk_country,
    "counter_increase": counter_increase,
    "histogram_quantile": histogram_quantile,
    "diff_compare": diff_compare,
}
