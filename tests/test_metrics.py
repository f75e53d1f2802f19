from __future__ import annotations

from helpers import T0, line, parsed, values
from pyspark.sql import functions as F

from rillmark.operators.compare import compare_series
from rillmark.operators.flushes import batch_offsets, next_offsets, split_first_window, unmatched_agents, unmatched_summary
from rillmark.operators.metrics import STANDARD, Agg, MetricSpec, minute_metrics
from rillmark.operators.viewers import minute_viewers
from rillmark.sources import geo, logs

GEO = "client_ip string, country string, region string"


def metric(spark, name, lines, *keys):
    return values(minute_metrics(parsed(spark, *lines), STANDARD).where(F.col("metric_name") == name), *keys)


def test_sums_counts_and_distinct_viewers(spark):
    lines = [line(i, clientIP=f"10.0.0.{i % 5}") for i in range(20)]
    assert metric(spark, "transfer_bytes_total", lines, "stream") == {("9964aabb",): 20_000}
    assert metric(spark, "requests_total", lines, "stream") == {("9964aabb",): 20}
    assert metric(spark, "users_total", lines, "stream") == {("9964aabb",): 5}


def test_statuses_and_first_byte(spark):
    lines = [line(0, responseStatus=s) for s, n in ((200, 10), (206, 5), (404, 3), (500, 2)) for _ in range(n)]
    assert metric(spark, "responses_total", lines, "response_status") == {("200",): 10, ("206",): 5, ("404",): 3, ("500",): 2}
    lines = [line(0, timeToFirstByteMs=t) for t in (100, 200, 300, 400, 500, 0)]
    assert metric(spark, "time_to_first_byte_ms", lines, "stream") == {("9964aabb",): 300}
    assert metric(spark, "time_to_first_byte_ms", [line(0, timeToFirstByteMs=0)], "stream") == {}


def test_tracks_minutes_and_countries(spark):
    assert metric(spark, "users_by_resolution_total", [line(track="v3"), line(track="a1", clientIP="10.0.0.9")], "track") == {("v3",): 1}
    lines = [line(60 * m, clientIP=f"10.0.0.{i}") for m in range(3) for i in range(5)]
    assert sorted(metric(spark, "users_total", lines, "minute").values()) == [5, 5, 5]
    lines = [line(clientIP=f"10.0.0.{i}", clientCountry=c) for i, c in enumerate(["US", "US", "CA", "CA", ""])]
    assert metric(spark, "users_by_country_total", lines, "country") == {("US",): 2, ("CA",): 2, ("",): 1}


def test_own_metrics(spark):
    specs = (
        MetricSpec("max", Agg.MAX, "response_bytes", {"stream": "stream_id"}), MetricSpec("min", Agg.MIN, "response_bytes", {"stream": "stream_id"}),
        MetricSpec("n", Agg.COUNT, "client_ip", {"pop": "location_id"}, "response_status = 200"), MetricSpec("all", Agg.SUM, F.lit(1), {}),
        MetricSpec("none", Agg.COUNT, "client_ip", {"pop": "location_id"}, "false"),
    )
    events = parsed(spark, line(responseBytes=5), line(responseBytes=9, responseStatus=404))
    assert values(minute_metrics(events, specs), "metric_name") == {("max",): 9, ("min",): 5, ("n",): 1, ("all",): 2}


def test_distinct_metrics_take_two_exchanges(spark):
    plan = minute_metrics(parsed(spark, line()), STANDARD[4:])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Expand") == 2


def test_viewers(spark):
    events = parsed(
        spark, line(clientIP="10.0.0.1"), line(1, clientIP="10.0.0.1"), line(2, clientIP="10.0.0.2", clientRequestUserAgent="Chrome"),
        line(3, clientIP="10.0.0.99", clientRequestUserAgent="Chrome", track="a1", clientCountry=""),
    )
    where = spark.createDataFrame([("10.0.0.1", "US", "California"), ("10.0.0.2", "US", "Texas"), ("10.0.0.99", "MX", "Unknown")], GEO)
    got = values(minute_viewers(events, where), "metric_name", "device_type", "country", "track", "region")
    assert got == {
        ("viewers", None, None, None, None): 3, ("viewers_by_device", "roku", None, None, None): 1, ("viewers_by_device", "web", None, None, None): 2,
        ("viewers_by_country", None, "US", None, None): 2, ("viewers_by_country", None, "XX", None, None): 1,
        ("viewers_by_resolution", None, None, "v3", None): 2, ("viewers_by_region", None, "US", None, "California"): 1, ("viewers_by_region", None, "US", None, "Texas"): 1,
    }
    assert not [k for k in values(minute_viewers(events), "metric_name") if "region" in k[0]]


def test_geo_ranges(spark):
    events = parsed(spark, *[line(clientIP=ip) for ip in ("10.0.0.5", "10.1.255.255", "10.2.0.0", "192.168.0.1", "no address")])
    first = 10 << 24
    ranges = spark.createDataFrame([(first, first + (1 << 16) * 2 - 1, "AA", "North"), (first + (2 << 16), first + (2 << 16), "BB", "")], "ip_from long, ip_to long, country string, region string")
    got = {r.client_ip: (r.geo_country, r.region) for r in geo.with_region_by_range(events, ranges).collect()}
    assert got == {"10.0.0.5": ("AA", "North"), "10.1.255.255": ("AA", "North"), "10.2.0.0": ("BB", "Unknown"), "192.168.0.1": ("XX", "Unknown"), "no address": ("XX", "Unknown")}


def test_networks_of_both_families(spark, tmp_path):
    (tmp_path / "nets.csv").write_text("net,code,area\n10.0.0.0/8,AA,North\n10.1.0.0/17,BB,\n10.1.2.3,CC,One\n2001:db8::/32,DD,Six\n2001:DB8:0:8::/61,EE,Seven\nbad/8,X,X\n10.0.0.0/99,X,X\n::/0,ZZ,All\n")
    networks = geo.read_networks(spark, f"file://{tmp_path}/nets.csv", "net", "code", "area")
    want = {
        "10.0.0.5": ("AA", "North"), "10.1.127.255": ("BB", "Unknown"), "10.1.128.0": ("AA", "North"), "10.1.2.3": ("CC", "One"), "11.0.0.1": ("XX", "Unknown"),
        "::ffff:10.1.2.3": ("CC", "One"), "2001:db8::1": ("DD", "Six"), "2001:db8:0:f:1:2:3:4": ("EE", "Seven"), "2001:db8:0:10::": ("DD", "Six"), "fe80::1": ("ZZ", "All"),
        "::": ("ZZ", "All"), "1:2:3:4:5:6:7:8:9": ("XX", "Unknown"), "12345::": ("XX", "Unknown"), "300.1.1.1": ("XX", "Unknown"), "": ("XX", "Unknown"),
    }
    events = spark.createDataFrame([(ip,) for ip in want] + [(None,)], "client_ip string")
    got = {r.client_ip: (r.geo_country, r.region) for r in geo.with_region_by_network(events, networks).collect()}
    assert got == want | {None: ("XX", "Unknown")}
    assert {r.region for r in geo.with_region_by_network(events, networks.where("false")).collect()} == {"Unknown"}


def test_events_from_objects(spark):
    from dataclasses import dataclass

    @dataclass
    class Row:
        timestamp: object
        stream_id: str
        response_bytes: int

    got = logs.from_objects(spark, [Row(T0, "ab", 5), {"timestamp": T0, "stream_id": "cd", "minute_key": "own"}]).collect()
    assert [(r.stream_id, r.response_bytes, r.minute_key) for r in got][0][:2] == ("ab", 5) and got[0].minute_key and got[1].minute_key == "own"
    assert got[0].minute == got[1].minute and logs.from_objects(spark, []).count() == 0


def test_offsets_by_flush(spark):
    rows = spark.createDataFrame([(1, "2026-02-03 12:00:00"), (2, "2026-02-03 12:00:00"), (2, "2026-02-03 12:01:00"), (5, "2026-02-03 12:00:00")], "flush int, minute string").withColumn("minute", F.to_timestamp("minute"))
    got = {(r.flush, r.minute.minute): r.offset_ms for r in batch_offsets(rows, 7).collect()}
    assert got == {(1, 0): 7, (2, 0): 107, (2, 1): 7, (5, 0): 207}


def test_offsets_are_forgotten_after_an_hour(spark):
    minute = spark.sql("select timestamp'2026-02-03 12:00:00' minute")
    state = spark.createDataFrame([], "minute timestamp, n long, first_flush timestamp")
    at = lambda text: F.to_timestamp(F.lit(text))
    got = []
    for now in ("2026-02-03 12:00:00", "2026-02-03 12:30:00", "2026-02-03 13:00:00", "2026-02-03 13:00:01"):
        state, offsets = next_offsets(state, minute, at(now))
        got.append(offsets.first().offset_ms)
    assert got == [0, 100, 200, 0]


def test_window_split(spark):
    got = [r.flush for r in split_first_window(parsed(spark, line(31), line(30), line(58.9), line(59), line(95))).orderBy("ingest_seq").collect()]
    assert got == [True, True, True, False, False]


def test_unmatched(spark):
    events = parsed(spark, *[line(clientRequestUserAgent=a) for a in ("X/1", "X/1", "Y/1", "", "Roku")])
    assert [tuple(r) for r in unmatched_agents(events).collect()] == [("X/1", 2), ("<empty>", 1), ("Y/1", 1)]
    assert tuple(unmatched_summary(events, 1).first()) == (4, 1, 2)
    assert tuple(unmatched_summary(events.where("false")).first()) == (0, 0, 0)


def test_compare(spark):
    a = spark.createDataFrame([("x", None, 1.0), ("y", "1", 2.0), ("z", "1", 3.0)], "k string, l string, value double")
    b = spark.createDataFrame([("x", None, 1.005), ("y", "1", 2.5), ("w", "1", 3.0)], "k string, l string, value double")
    assert {r.k: r.status for r in compare_series(a, b, ["k", "l"]).collect()} == {"x": "same", "y": "differs", "z": "missing", "w": "extra"}
