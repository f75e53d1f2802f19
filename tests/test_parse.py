from __future__ import annotations

import gzip

import pytest
from helpers import STREAM, line, parsed, texts
from pyspark.sql import functions as F

from rillmark.config import Settings, duration_label
from rillmark.functions import device, text, times
from rillmark.operators import sessions
from rillmark.sources import generate, logs

DEVICES = [
    ("AppleTV11,1/11.1", "apple_tv"), ("tvOS/17.0 AppleTV", "apple_tv"), ("Roku/DVP-11.0 (11.0.0.4193)", "roku"), ("RokuOS/12.0", "roku"),
    ("Dalvik/2.1.0 (Linux; U; Android 9; AFTMM Build/PS7633)", "firestick"), ("Amazon Fire TV Stick", "firestick"), ("AndroidTV/10.0", "android"),
    ("Dalvik/2.1.0 (Linux; U; Android 13; Pixel 7)", "android"), ("Mozilla/5.0 Chrome/120.0.0.0", "web"), ("Mozilla/5.0 Firefox/121.0", "web"),
    ("Mozilla/5.0 Safari/605.1", "web"), ("Mozilla/5.0 (Yallbot Camera Frame Capture)", "bots"), ("ExampleCrawler/1.0", "bots"),
    ("Lavf/61.7.100", "streamology"), ("GStreamer/1.22.9", "streamology"), ("gst-launch-1.0/1.20", "streamology"), ("Baron iOS App/1.0", "ios"),
    ("AppleCoreMedia/1.0.0 (iPhone; U; CPU OS 18_5 like Mac OS X; en_us)", "ios"), ("", "other"), (None, "other"), ("UnknownDevice/1.0", "other"),
    ("Matt Laubhan IOS/7.0.9 CFNetwork/3860.400.51 Darwin/25.3.0", "other"), ("Virtual%20Railfan/2.1 (iOS 17)", "ios"), ("Baron Desktop", "other"),
    ("Player+App Darwin/22", "web"), ("100% Chrome", "web"), ("%ff%fe Roku", "roku"), ("  \tRoku\n", "roku"),
]


def test_devices(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(DEVICES)], "i int, agent string")
    got = {r.i: r.d for r in rows.select("i", device.device_type(F.col("agent")).alias("d")).collect()}
    assert {i: d for i, (_, d) in enumerate(DEVICES)} == got


def test_decoded_agent_keeps_plus_and_stray_percent(spark):
    rows = spark.createDataFrame([("a+b%20c",), ("50%zz",), ("x%",)], "agent string")
    assert [r[0] for r in rows.select(device.decoded_agent(F.col("agent"))).collect()] == ["a+b c", "50%zz", "x%"]


def test_unmatched_agents_are_empty_or_fit_no_rule(spark):
    rows = spark.createDataFrame([("",), (" ",), ("UnknownDevice/1.0",), ("x" * 400,), ("A CFNetwork/1",), ("Roku",)], "agent string")
    got = [r[0] for r in rows.select(device.unmatched_agent(F.col("agent"))).collect()]
    assert got == ["<empty>", "<empty>", "UnknownDevice/1.0", "x" * 300, None, None]


@pytest.mark.parametrize(("path", "track"), [("/9964ab/tracks-v3/rewind.m3u8", "v3"), ("/9964ab/tracks-V2/x", "v2"), ("/9964ab/other/x", "unknown"), ("/9964ab/tracks- /x", "unknown"), (None, "unknown")])
def test_tracks(spark, path, track):
    assert spark.createDataFrame([(path,)], "p string").select(text.track(F.col("p"))).first()[0] == track


def test_lines_that_are_kept_and_dropped(spark):
    good = line()
    events = parsed(
        spark, good, "not json", line() | {"clientRequestPath": None}, line() | {"clientRequestPath": ""}, line() | {"clientRequestPath": "/invalid/path/format.m3u8"},
        line() | {"timestamp": ""}, line() | {"timestamp": "yesterday"}, line() | {"timestamp": "2026"}, line() | {"unknown": {"nested": 1}},
    ).collect()
    assert len(events) == 2
    assert events[0].stream_id == STREAM and events[0].minute_key == "03/Feb/2026 12:00" and events[0].track == "v3" and events[0].device_type == "roku"


def test_defaults_and_types(spark):
    bare = parsed(spark, {"timestamp": "2026-02-03T12:00:30Z", "clientRequestPath": "/ab/x"}, line(clientCountry="", responseBytes="7")).collect()
    a, b = bare
    assert (a.cache_status, a.client_country, a.location_id, a.client_ip, a.resource_id, a.response_status, a.device_type) == ("UNKNOWN", "XX", "unknown", "0.0.0.0", 0, 0, "other")
    assert b.client_country == "" and b.response_bytes == 0


def test_gzip_files_read_in_order(spark, tmp_path):
    with gzip.open(tmp_path / "rtl.a+0+1.ndjson.gz", "wt") as f:
        f.write("\n".join(texts(*[line(i) for i in range(5)])) + "\n\n  \nbroken\n")
    events = logs.read_events(spark, str(tmp_path)).orderBy("ingest_seq").collect()
    assert [e.timestamp.second for e in events] == [0, 1, 2, 3, 4]
    report = logs.file_report(logs.read_lines(spark, str(tmp_path))).first()
    assert (report.lines, report.events) == (6, 5)
    assert logs.events(logs.read_records(spark, str(tmp_path))).count() == 5


def test_hour_prefixes_oldest_first():
    from helpers import T0

    assert logs.hour_prefixes("logs/", 2, T0) == ["logs/20260203/11", "logs/20260203/12"]


def test_times(spark):
    row = spark.sql("select timestamp'2026-02-03 12:00:45.5' t").select(
        times.minute_ms(F.col("t"), 200).alias("ms"), times.minute_key(F.col("t")).alias("key"), F.unix_seconds(times.window_start(F.col("t"))).alias("w"),
        times.from_minute_key(F.lit("03/Feb/2026 12:00")).cast("string").alias("back"),
    ).first()
    assert row.ms % 60_000 == 200 and row.key == "03/Feb/2026 12:00" and row.w % 60 == 30 and row.back == "2026-02-03 12:00:00"
    bands = spark.createDataFrame([(60.0,), (60.5,), (300.0,), (1200.0,), (3600.0,), (3601.0,)], "s double").select(times.watch_band(F.col("s")))
    assert [r[0] for r in bands.collect()] == ["0_1m", "1_5m", "1_5m", "5_20m", "20_60m", "60m_plus"]


def test_settings():
    assert [duration_label(s) for s in (-1, 0, 45, 300, 3600, 5400)] == ["0s", "0s", "45s", "5m", "1h", "90m"]
    s = Settings.from_env({"METRIC_PREFIX": "x_", "SESSION_GAP_SECONDS": "0", "UNIQUE_VIEWERS_WINDOW_SECONDS": "-5", "SESSION_WINDOW_SECONDS": "60", "EMIT_LEGACY_STREAM_NAME_LABEL": "Off", "STARTUP_OFFSET_MS": "abc"})
    assert (s.metric("a"), s.session_gap_seconds, s.unique_window_seconds, s.session_window_seconds, s.legacy_stream_name, s.startup_offset_ms, s.window_label) == ("x_a", 1, 3600, 3600, False, 0, "1h")


def test_generator_is_parsed_whole(spark):
    lines = generate.log_lines(spark, 2_000, 5, 100, 5).withColumn("file", F.lit("f"))
    events = logs.events(logs.parsed(lines), F.col("line"))
    assert events.count() == 2_000
    assert events.select("stream_id").distinct().count() == 5
    assert events.where("device_type = 'other' or client_ip not like '10.%'").count() == 0


def test_lines_of_a_split_plain_file_keep_their_order(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text("\n".join(texts(*[line(i / 10) for i in range(3000)])) + "\n")
    (tmp_path / "b.ndjson").write_text("\n".join(texts(*[line(300 + i) for i in range(5)])) + "\n")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionNum")
    try:
        for name, setting in zip(names, ("30000", "0", "3"), strict=True):
            spark.conf.set(name, setting)
        events = logs.read_events(spark, str(tmp_path))
        assert events.select("line.split").distinct().count() > 20 and events.rdd.getNumPartitions() < 20
        ordered = [r.timestamp for r in events.orderBy("file", "line").select("timestamp").collect()]
        assert ordered == sorted(ordered) and len(ordered) == 3005
        seq = [r.t for r in sessions.in_arrival_order(events).orderBy("ingest_seq").select(F.col("timestamp").alias("t")).collect()]
        assert seq == ordered
    finally:
        for name in names:
            spark.conf.unset(name)
