from __future__ import annotations

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pyarrow as pa
import pytest
from helpers import line, parsed
from pyspark.sql import functions as F

from rillmark.functions.text import parse_series
from rillmark.operators.metrics import STANDARD, label_names, minute_metrics
from rillmark.plans import promql
from rillmark.plans.samples import samples
from rillmark.sources import remote_write as rw


def test_series_text_and_labels(spark):
    metrics = minute_metrics(parsed(spark, line(locationID='a"b\\c\nd')), STANDARD[:1])
    row = samples(metrics, label_names(STANDARD[:1]), offset_ms=100, prefix="cdn_").first()
    assert row.series == 'cdn_transfer_bytes_total{cache_status="HIT",cdn_id="1",pop="a\\"b\\\\c\\nd",stream="9964aabb",stream_name="9964aabb"}'
    assert row.timestamp_ms % 60_000 == 100
    assert parse_series(row.series)[1] == [(p.name, p.value) for p in row.labels]
    bare = samples(metrics, label_names(STANDARD[:1]), legacy=False).first()
    assert "stream_name" not in bare.series


def test_old_samples_are_dropped(spark):
    metrics = minute_metrics(parsed(spark, line(0)), STANDARD[:1])
    stamp = samples(metrics, ["stream"]).first().timestamp_ms
    week = 7 * 86_400_000
    assert samples(metrics, ["stream"], now_ms=stamp + week).count() == 1
    assert samples(metrics, ["stream"], now_ms=stamp + week + 1).count() == 0


@pytest.mark.parametrize("text", ["", "{a=\"b\"}", "m{a=\"b\"", "m{a=b}", "m{a=\"b\" c=\"d\"}", "m{a=\"b\",}"])
def test_malformed_series(text):
    with pytest.raises(ValueError):
        parse_series(text)


def test_series_are_parsed():
    assert parse_series("m") == ("m", [])
    assert parse_series("m{}") == ("m", [])
    assert parse_series('m{a="x,y", b="q\\"\\n\\\\"}') == ("m", [("a", "x,y"), ("b", 'q"\n\\')])


def test_wire_round_trip():
    sent = [([("__name__", "m"), ("track", "1080p,h264"), ("é", "ü\n")], 1.5, 1_700_000_000_123), ([("__name__", "n")], -0.0, -5), ([], float("inf"), 0)]
    body = rw.compress(rw.encode(sent))
    assert rw.decode(pa.decompress(body, decompressed_size=len(rw.encode(sent)), codec="snappy", asbytes=True)) == sent


def test_duplicates_are_shifted_and_failures_retried():
    stamps, answers = [], [(400, "duplicate sample for timestamp"), (200, "")]

    def post(_, body):
        n = len(rw.encode([([("__name__", "m")], 1.0, 100_000)]))
        stamps.append(rw.decode(pa.decompress(body, decompressed_size=n, codec="snappy", asbytes=True))[0][2])
        return answers.pop(0)

    assert rw.push(rw.Endpoint("x"), [([("__name__", "m")], 1.0, 100_000)], post) and stamps == [100_000, 102_000]
    calls, slept = [], []
    again = lambda ok: lambda *_: (calls.append(1), (200, "") if len(calls) >= ok else (500, "no"))[1]
    assert rw.push_with_retries(rw.Endpoint("x"), [([], 1.0, 1)], again(2), slept.append) and len(calls) == 2 and slept == [1.0]
    calls.clear(), slept.clear()
    assert not rw.push_with_retries(rw.Endpoint("x", retries=2), [([], 1.0, 1)], again(99), slept.append) and len(calls) == 3 and slept == [1.0, 2.0]
    calls.clear()
    assert not rw.push(rw.Endpoint("x"), [([], 1.0, 1)], lambda *_: (calls.append(1), (400, "duplicate sample"))[1]) and len(calls) == 6
    assert rw.Endpoint("x").delay(9) == 30.0


def test_samples_are_sent_from_the_executors(spark):
    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            got.append((self.headers["Content-Encoding"], self.headers["Authorization"], self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(204)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    out = samples(minute_metrics(parsed(spark, line(0)), STANDARD[:1]), ["stream"])
    rw.write_samples(out, rw.Endpoint(f"http://127.0.0.1:{server.server_port}/w", "u", "p"))
    server.shutdown()
    assert len(got) == 1 and got[0][0] == "snappy" and got[0][1] == "Basic dTpw"


def series(spark, points):
    return spark.createDataFrame([(k, t * 1000, float(v)) for k, t, v in points], "k string, timestamp_ms long, value double")


def test_increase_leaves_out_the_far_end_of_the_window(spark):
    rows = promql.increase(series(spark, [("a", 0, 1), ("a", 60, 2), ("a", 300, 4)]), ["k"], 300).orderBy("timestamp_ms").collect()
    assert [r.increase for r in rows] == [1, 3, 6]
    assert promql.rate(series(spark, [("a", 0, 600)]), ["k"], 300).first().rate == 2


def test_counter_resets(spark):
    rows = promql.counter_increase(series(spark, [("a", 0, 5), ("a", 60, 8), ("a", 120, 2), ("a", 180, 3)]), ["k"], 600).orderBy("timestamp_ms").collect()
    assert [r.increase for r in rows] == [0, 3, 5, 6]


def test_quantile(spark):
    rows = [("a", "60", 0.0), ("a", "180", 5.0), ("a", "300", 10.0), ("a", "+Inf", 10.0), ("b", "60", 0.0), ("b", "+Inf", 4.0), ("c", "60", 0.0), ("c", "+Inf", 0.0), ("d", "60", 4.0), ("d", "+Inf", 4.0)]
    buckets = spark.createDataFrame(rows, "k string, le string, value double")
    assert {r.k: r.quantile for r in promql.histogram_quantile(0.9, buckets, ["k"]).collect()} == {"a": 276.0, "b": 60.0, "d": 54.0}


def test_topk_ratio_and_match(spark):
    rows = series(spark, [("a", 0, 3), ("b", 0, 3), ("c", 0, 5)])
    assert [r.k for r in promql.topk(rows, 2, ["k"]).orderBy("rank").collect()] == ["c", "a"]
    assert promql.ratio(rows, rows, ["k", "timestamp_ms"]).where("ratio = 1").count() == 3
    status = spark.createDataFrame([("404",), ("4040",), ("14",)], "s string")
    assert [r.s for r in status.where(promql.matches("s", "4..")).collect()] == ["404"]
    assert F is not None
