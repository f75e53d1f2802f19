from __future__ import annotations

import gzip
import os

from helpers import T0, line, texts

from rillmark.config import Settings
from rillmark.streaming.stream import EdgeLogStream


def put(folder, name, *lines):
    with gzip.open(folder / name, "wt") as f:
        f.write("\n".join(texts(*lines)) + "\n")


def run(spark, base, got, files=1):
    def sink(df, batch):
        for r in df.collect():
            got.setdefault(batch, {})[r.series, r.timestamp_ms] = r.value

    stream = EdgeLogStream(spark, f"file://{base}/state", sink, Settings())
    query = stream.start(str(base / "in"), f"file://{base}/checkpoint", files_per_batch=files)
    query.awaitTermination()
    assert query.exception() is None
    return stream


def value(rows, start, **labels):
    found = [v for (s, _), v in rows.items() if s.startswith(start + "{") and all(f'{k}="{x}"' in s for k, x in labels.items())]
    assert len(found) == 1, (start, labels, found)
    return found[0]


def test_polls_offsets_sessions_and_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "rtl.a+0+1.ndjson.gz", line(0), line(30), line(31, clientIP="10.0.0.2"), "broken")
    got: dict = {}
    run(spark, tmp_path, got)
    first = got[0]
    assert value(first, "cdn_requests_total") == 3 and value(first, "cdn_viewers") == 2 and value(first, "cdn_viewers_unique", window="1h") == 2
    assert value(first, "cdn_file_lines_processed_total", result="success") == 4
    minute = int(T0.timestamp() * 1000)
    assert {t for (s, t) in first if s.startswith("cdn_requests_total")} == {minute}

    # another run goes on from the checkpoint and the state tables
    put(tmp_path / "in", "rtl.a+0+2.ndjson.gz", line(45), line(600, clientRequestUserAgent="Unknown/1"))
    os.utime(tmp_path / "in" / "rtl.a+0+2.ndjson.gz")
    stream = run(spark, tmp_path, got)
    second = got[1]
    assert set(got) == {0, 1}
    assert {t for (s, t) in second if s.startswith("cdn_requests_total")} == {minute + 100, minute + 600_000}
    assert value(second, "cdn_watch_sessions_total") == 2 and value(second, "cdn_watch_time_seconds_total") == 45
    assert value(second, "cdn_viewer_undefined_devices_total") == 1
    state = {r.client_ip: r.closed for r in stream.state("sessions", 1).collect()}
    assert state == {"10.0.0.1": False, "10.0.0.2": True}


def test_a_repeated_batch_gives_the_same(spark, tmp_path):
    got: dict = {}
    stream = EdgeLogStream(spark, f"file://{tmp_path}/state", lambda df, b: got.setdefault(b, []).append(sorted((r.series, r.timestamp_ms, r.value) for r in df.collect() if "process_time" not in r.series)))
    rows = lambda *x: spark.createDataFrame([(t, "f", i) for i, t in enumerate(texts(*x))], "value string, file string, line long")
    stream.process(rows(line(0), line(10)), 0)
    for _ in range(2):
        stream.process(rows(line(20), line(500)), 1)
    assert got[1][0] == got[1][1]
    stream.process(rows(), 2)
    stream.process(rows(line(501)), 3)
    assert any(s.startswith("cdn_watch_sessions_total") and v == 1 for s, _, v in got[3][0])


def test_without_an_event_only_the_files_are_reported(spark, tmp_path):
    got: dict = {}

    def sink(df, batch):
        got[batch] = {(r.series, r.timestamp_ms): r.value for r in df.collect()}

    stream = EdgeLogStream(spark, f"file://{tmp_path}/state", sink, clock=lambda: 90_000)
    rows = lambda *x: spark.createDataFrame([(t, "f", i) for i, t in enumerate(x)], "value string, file string, line long")
    stream.process(rows("broken", " "), 0)
    assert value(got[0], "cdn_file_lines_processed_total", result="failure", file="f") == 1
    assert value(got[0], "cdn_file_process_time_seconds", result="failure") > 0
    assert len(got[0]) == 2 and {t for _, t in got[0]} == {60_000}
    # nothing was kept, and a batch without lines is no failure
    assert not (tmp_path / "state").exists()
    stream.process(rows(), 1)
    assert len(got[1]) == 1 and value(got[1], "cdn_file_process_time_seconds", result="success") > 0


def test_command_line(spark, tmp_path):
    from rillmark.__main__ import main

    (tmp_path / "in" / "20260203" / "12").mkdir(parents=True)
    put(tmp_path / "in" / "20260203" / "12", "rtl.b+0+1.ndjson.gz", line(0), line(5, clientIP="10.0.0.7"))
    args = ["--input", str(tmp_path / "in"), "--state", f"file://{tmp_path}/state", "--checkpoint", f"file://{tmp_path}/cp", "--output", f"file://{tmp_path}/out", "--once", "--lookback-hours", "2"]
    main(args, spark)
    rows = {r.series: r.value for r in spark.read.json(f"{tmp_path}/out/batch=0").collect()}
    assert value({(s, 0): v for s, v in rows.items()}, "cdn_viewers") == 2


def test_a_stream_starts_from_a_snapshot_and_saves_one(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(t, "f", i) for i, t in enumerate(texts(*x))], "value string, file string, line long")
    settings = Settings(session_state_path=str(tmp_path / "snap" / "state.json.gz"))
    one = EdgeLogStream(spark, f"file://{tmp_path}/one", lambda df, b: None, settings)
    for batch in range(4):
        one.process(rows(line(10 * batch), line(10 * batch, clientIP="10.0.0.2")), batch)
    assert sorted(p.name for p in (tmp_path / "one" / "sessions").iterdir() if p.name.startswith("batch")) == ["batch=2", "batch=3"]
    # the interval isn't over, so the snapshot is that of the first batch
    two = EdgeLogStream(spark, f"file://{tmp_path}/two", lambda df, b: None, settings)
    two.process(rows(line(60)), 0)
    assert {(r.client_ip, r.first_seen.timestamp() - T0.timestamp()) for r in two.state("sessions", 0).collect()} == {("10.0.0.1", 0), ("10.0.0.2", 0)}


def test_hours_and_standard_input(spark, tmp_path, monkeypatch):
    import io
    import sys
    from datetime import datetime, timedelta, timezone

    from rillmark import __main__ as cli

    now = datetime.now(timezone.utc)
    for hours in (0, 30):
        folder = tmp_path / "in" / f"{now - timedelta(hours=hours):%Y%m%d/%H}"
        folder.mkdir(parents=True)
        put(folder, "rtl.c+0+1.ndjson.gz", line(0, clientIP=f"10.0.0.{hours}"))
    common = ["--output", f"file://{tmp_path}/out", "--once"]
    cli.main(["--input", str(tmp_path / "in"), "--hours", "2", "--state", f"file://{tmp_path}/s", "--checkpoint", f"file://{tmp_path}/cp", *common], spark)
    rows = {(r.series, 0): r.value for r in spark.read.json(f"{tmp_path}/out/batch=0").collect()}
    assert value(rows, "cdn_viewers") == 1
    monkeypatch.setattr(cli, "STDIN_LINES", 2)
    monkeypatch.setattr(sys, "stdin", io.StringIO("\n".join(texts(line(0), line(1), line(500))) + "\n"))
    cli.main(["--input", "-", "--state", f"file://{tmp_path}/s2", "--checkpoint", f"file://{tmp_path}/cp2", "--output", f"file://{tmp_path}/out2", "--once"], spark)
    rows = {(r.series, 0): r.value for r in spark.read.json(f"{tmp_path}/out2/batch=1").collect()}
    assert value(rows, "cdn_watch_sessions_total") == 1
