from __future__ import annotations

import gzip
import json
import random
from datetime import timedelta

import pytest
from helpers import T0, line, parsed, values
from pyspark.sql import functions as F

from rillmark.operators import sessions, watch
from rillmark.sources import snapshot

BATCH = "stream_id string, client_ip string, t timestamp, seq long, device_type string, country string, region string"


def micros(seconds: float):
    return F.timestamp_micros(F.lit(int((T0.timestamp() + seconds) * 1_000_000)))


def fold(spark, polls, gap=120, window=7200):
    """polls: (lines, reference second); returns the state and all closed sessions as rows."""
    state, closed = sessions.empty_state(spark), []
    for lines, ref in polls:
        batch = sessions.session_events(parsed(spark, *lines)) if lines else spark.createDataFrame([], BATCH)
        state, done = sessions.advance(state, batch, micros(ref), gap, window)
        closed += done.collect()
        state = spark.createDataFrame(state.collect(), state.schema)
    return state, closed


def totals(spark, closed):
    return watch.watch_totals(spark.createDataFrame(closed, "stream_id string, client_ip string, first_seen timestamp, last_seen timestamp, seconds double"))


def test_one_session_an_address(spark):
    state, closed = fold(spark, [([line(10 * i, clientIP=f"10.0.0.{i}") for i in range(5)], 40)], window=300)
    assert state.count() == 5 and not closed


def test_stale_sessions_leave(spark):
    state, closed = fold(spark, [([line(0)], 0), ([], 120)], window=60)
    assert state.count() == 0 and [c.seconds for c in closed] == [0.0]


def test_late_events_are_ignored_unless_the_address_is_new(spark):
    state, _ = fold(spark, [([line(0, clientIP="10.0.0.1")], 0), ([line(-600, clientIP="10.0.0.2"), line(-300, clientIP="10.0.0.1")], 0)])
    seen = {r.client_ip: (r.last_seen - timedelta(0)).timestamp() for r in state.collect()}
    assert len(seen) == 2


def test_expired_watch_time(spark):
    _, closed = fold(spark, [([line(0), line(1200)], 1200), ([], 7200)], gap=1800, window=3600)
    got = values(watch.watch_metrics(totals(spark, closed)), "metric_name", "le", "band")
    assert got["watch_sessions_total", None, None] == 1 and got["watch_time_seconds_total", None, None] == 1200
    bucket = {k[1]: v for k, v in got.items() if k[1]}
    assert bucket == {"60": 0, "180": 0, "300": 0, "600": 0, "1200": 1, "1800": 1, "3600": 1, "7200": 1, "+Inf": 1}
    assert {k[2]: v for k, v in got.items() if k[2]} == {"0_1m": 0, "1_5m": 0, "5_20m": 1, "20_60m": 0, "60m_plus": 0}


def test_gap_splits_and_idle_closes(spark):
    _, closed = fold(spark, [([line(0), line(30), line(600)], 600)])
    assert [c.seconds for c in closed] == [30.0]
    state, closed = fold(spark, [([line(0), line(45)], 225)])
    assert [c.seconds for c in closed] == [45.0] and state.first().closed


@pytest.mark.parametrize(("gap", "sessions_"), [(120.0, 1), (120.5, 2)])
def test_a_gap_of_exactly_the_bound_goes_on(spark, gap, sessions_):
    state, closed = fold(spark, [([line(0), line(gap)], gap)])
    assert len(closed) + state.count() == sessions_
    events = parsed(spark, line(0), line(gap))
    assert sessions.batch_sessions(events, 120).count() == sessions_


def test_equal_stamps_keep_the_first_arrival(spark):
    state, _ = fold(spark, [([line(0, clientRequestUserAgent="Roku"), line(0, clientRequestUserAgent="Chrome")], 0)])
    assert state.first().device_type == "roku"


def test_reopened_sessions_count_the_old_one_once(spark):
    state, closed = fold(spark, [([line(0)], 0), ([], 130), ([line(119)], 130)])
    assert len(closed) == 1 and not state.first().closed and state.first().first_seen == state.first().last_seen


def test_open_session_that_falls_out_of_a_short_window_is_recorded(spark):
    state, closed = fold(spark, [([line(0), line(50)], 50), ([], 200)], gap=300, window=100)
    assert state.count() == 0 and [c.seconds for c in closed] == [50.0]


def test_unique_window(spark):
    state, _ = fold(spark, [([line(-5400, clientIP="10.0.0.2"), line(-1200, clientIP="10.0.0.1")], 0)])
    assert values(sessions.unique_gauges(state, micros(0), 3600), "metric_name")[("viewers_unique",)] == 1
    assert values(sessions.session_gauges(state), "metric_name")[("viewers",)] == 2


def test_regions_add_up_to_countries(spark):
    rows = [("10.0.0.1", "US", "California"), ("10.0.0.2", "US", "Texas"), ("10.0.0.3", "AU", "Victoria"), ("10.0.0.4", "AU", "Queensland")]
    geo = spark.createDataFrame(rows, "client_ip string, country string, region string")
    events = parsed(spark, *[line(0, clientIP=ip, clientCountry="") for ip, _, _ in rows])
    state, _ = sessions.advance(sessions.empty_state(spark), sessions.session_events(events, geo), micros(0), 120, 300)
    got = [r.asDict() for r in sessions.session_gauges(state).collect()]
    by_country = {r["country"]: r["value"] for r in got if r["metric_name"] == "viewers_by_country"}
    assert by_country == {"US": 2, "AU": 2}
    for country, n in by_country.items():
        assert sum(r["value"] for r in got if r["metric_name"] == "viewers_by_region" and r["country"] == country) == n


class Simple:
    """One event at a time, with a dictionary."""

    def __init__(self, gap, window):
        self.gap, self.window, self.open, self.closed = gap, window, {}, []

    def poll(self, events, ref):
        for key, t, device in events:
            s = self.open.get(key)
            if s is None:
                self.open[key] = [t, t, device, False]
            elif t <= s[1]:
                continue
            elif t - s[1] > self.gap or s[3]:
                if not s[3]:
                    self.closed.append((key, s[0], s[1]))
                self.open[key] = [t, t, device, False]
            else:
                s[1], s[2] = t, device
        for key, s in list(self.open.items()):
            if not s[3] and s[1] < ref - self.gap:
                s[3] = True
                self.closed.append((key, s[0], s[1]))
            if s[1] < ref - self.window:
                if not s[3]:
                    self.closed.append((key, s[0], s[1]))
                del self.open[key]


@pytest.mark.parametrize(("seed", "gap", "window"), [(1, 120, 600), (2, 120, 600), (3, 300, 100), (4, 60, 1200)])
def test_fold_equals_one_event_at_a_time(spark, seed, gap, window):
    rng = random.Random(seed)
    simple, polls = Simple(gap, window), []
    latest = 0
    for poll in range(5):
        events = [((f"ab{rng.randrange(3)}", f"10.0.0.{rng.randrange(6)}"), max(0, poll * 200 + rng.randrange(-200, 260)), rng.choice(["Roku", "Chrome"])) for _ in range(rng.randrange(0, 60))]
        latest = max([latest, *(t for _, t, _ in events)])
        simple.poll([(k, t, {"Roku": "roku", "Chrome": "web"}[d]) for k, t, d in events], latest)
        polls.append(([line(t, stream=k[0], clientIP=k[1], clientRequestUserAgent=d) for k, t, d in events], latest))
    state, closed = fold(spark, polls, gap, window)
    second = lambda t: round(t.timestamp() - T0.timestamp()) if t.tzinfo else round((t - T0.replace(tzinfo=None)).total_seconds())
    assert {((r.stream_id, r.client_ip), second(r.first_seen), second(r.last_seen), r.device_type, r.closed) for r in state.collect()} == {(k, *v) for k, v in simple.open.items()}
    assert sorted(((c.stream_id, c.client_ip), second(c.first_seen), second(c.last_seen)) for c in closed) == sorted(simple.closed)


def test_snapshot_round_trip(spark, tmp_path):
    state, closed = fold(spark, [([line(0), line(90), line(600), line(600, clientIP="10.0.0.2")], 600)])
    path = str(tmp_path / "deep" / "state.json.gz")
    assert snapshot.save(state, totals(spark, closed), path, 7200, 120) == 2
    back, sums = snapshot.load(spark, path)
    key = lambda r: (r.stream_id, r.client_ip)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, state.select(back.columns).collect()))
    got = values(watch.watch_metrics(sums), "metric_name", "band")
    assert got["watch_sessions_total", None] == 1 and got["watch_session_duration_band_total", "1_5m"] == 1
    assert {key(r) for r in snapshot.restore(spark, path, T0 + timedelta(seconds=700), 120, 7200)[0].collect()} == {key(r) for r in state.collect()}
    assert snapshot.restore(spark, path, T0 + timedelta(hours=9), 120, 7200)[0].count() == 0


def test_snapshots_with_older_rows(spark, tmp_path):
    at = int(T0.timestamp())
    rows = [["a", "1", at, at + 5, "roku", "US", "Texas", True], ["a", "2", at, at + 6, "web", "US", "Texas"], ["a", "3", at + 7, "ios", "CA", "Unknown"], ["bad"]]
    path = tmp_path / "old.json.gz"
    with gzip.open(path, "wt") as f:
        json.dump({"version": 1, "rows": rows}, f)
    got = {r.client_ip: ((r.last_seen - r.first_seen).total_seconds(), r.device_type, r.country, r.region, r.closed) for r in snapshot.load(spark, str(path))[0].collect()}
    assert got == {"1": (5, "roku", "US", "Texas", True), "2": (6, "web", "US", "Texas", False), "3": (0, "ios", "CA", "Unknown", False)}
