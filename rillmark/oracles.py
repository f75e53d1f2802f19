"""DuckDB SQL that says what each registered query must return, written apart from the operators."""

from __future__ import annotations

from rillmark.functions.device import APPLE_TV, ANDROID, BOTS, BROWSERS, INGEST, IOS, OWN_APPS, OWN_IOS
from rillmark.functions.times import BANDS, BUCKETS
from rillmark.queries import FLUSH_EVENTS, GAP, WINDOW
from rillmark.sources.fixture import AGENTS, COUNTRIES, PLACES, REGIONS, TRACKS


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _any(column: str, fragments: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{f}')" for f in fragments) + ")"


_OWN = _any("ua", OWN_APPS)
_DEVICE = f"""CASE WHEN {_any('ua', APPLE_TV)} THEN 'apple_tv' WHEN contains(ua, 'roku') THEN 'roku'
    WHEN contains(ua, 'aft') OR (contains(ua, 'amazon') AND contains(ua, 'fire')) THEN 'firestick'
    WHEN {_any('ua', BOTS)} THEN 'bots' WHEN {_OWN} AND contains(ua, 'android') THEN 'android'
    WHEN {_OWN} AND {_any('ua', OWN_IOS)} THEN 'ios' WHEN {_any('ua', IOS)} THEN 'ios' WHEN {_any('ua', ANDROID)} THEN 'android'
    WHEN starts_with(ua, 'lavf/') OR {_any('ua', INGEST)} THEN 'streamology' WHEN contains(ua, 'cfnetwork/') THEN 'other'
    WHEN contains(ua, 'darwin/') THEN 'web' WHEN {_any('ua', BROWSERS)} THEN 'web' END"""

EV = f"""
WITH raw AS (
  SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k,
    make_timestamp(1773576000000000 + ((epoch_us(ts) - 1704067200000000) // 720)) AS t,
    CASE WHEN event_id % 50 = 0 THEN '/invalid/path.m3u8'
      ELSE '/' || md5('stream-' || CAST(user_id % 5 AS VARCHAR)) || '/tracks-' || {_list(TRACKS)}[event_id % 4 + 1] || '/seg.m3u8' END AS path,
    {_list(AGENTS)}[(user_id + event_id % 2) % 14 + 1] AS agent
  FROM events),
seen AS (SELECT *, lower(trim(url_decode(agent))) AS ua FROM raw),
ev AS (
  SELECT event_id AS ingest_seq, user_id, t, date_trunc('minute', t) AS minute, epoch_ms(date_trunc('minute', t)) AS minute_ms,
    regexp_extract(path, '^/([a-f0-9]+)/', 1) AS stream_id, CAST(1693215245 + user_id % 2 AS BIGINT) AS resource_id,
    CASE WHEN k % 10 < 7 THEN 'HIT' WHEN k % 10 < 9 THEN 'MISS' ELSE 'EXPIRED' END AS cache_status,
    CAST(round(value * 100) AS BIGINT) AS response_bytes, CAST(CASE WHEN k % 4 = 0 THEN 0 ELSE 50 + event_id % 250 END AS BIGINT) AS ttfb,
    CAST(CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 206 ELSE 200 END AS INT) AS response_status,
    {_list(COUNTRIES)}[user_id % 11 + 1] AS client_country, {_list(PLACES)}[k % 4 + 1] AS location_id,
    '10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS client_ip,
    coalesce({_DEVICE}, 'other') AS device_type,
    CASE WHEN ({_DEVICE}) IS NULL THEN CASE WHEN ua = '' THEN '<empty>' ELSE substr(trim(url_decode(agent)), 1, 300) END END AS ua_unmatched,
    lower(regexp_extract(path, '^/[a-f0-9]+/tracks-([^/]+)/', 1)) AS track,
    strftime(t, '%d/%b/%Y %H:%M') AS minute_key,
    {_list(COUNTRIES[:4])}[user_id % 4 + 1] AS geo_country, {_list(REGIONS)}[user_id % 4 + 1] AS region
  FROM seen WHERE regexp_extract(path, '^/([a-f0-9]+)/', 1) <> '')
"""

_PLAIN = """SELECT ingest_seq, epoch_us(t) // 1000 AS ts_ms, stream_id, resource_id, cache_status, response_bytes, ttfb AS time_to_first_byte_ms,
  response_status, client_country, location_id, client_ip, {more} track, minute_key FROM ev"""

#: Label, source pairs of each standard metric, with its aggregate and filter.
_TRAFFIC = (("stream", "stream_id"), ("cdn_id", "resource_id"), ("cache_status", "cache_status"), ("pop", "location_id"))
_METRICS = {
    "transfer_bytes_total": (_TRAFFIC, "sum(response_bytes)", "true"),
    "time_to_first_byte_ms": (_TRAFFIC, "avg(ttfb)", "ttfb > 0"),
    "requests_total": (_TRAFFIC, "count(*)", "true"),
    "responses_total": ((*_TRAFFIC, ("response_status", "response_status")), "count(*)", "true"),
    "users_total": ((("stream", "stream_id"),), "count(DISTINCT client_ip)", "true"),
    "users_by_device_total": ((("stream", "stream_id"), ("device_type", "device_type")), "count(DISTINCT client_ip)", "true"),
    "users_by_country_total": ((("stream", "stream_id"), ("country", "client_country")), "count(DISTINCT client_ip)", "true"),
    "users_by_resolution_total": ((("stream", "stream_id"), ("track", "track")), "count(DISTINCT client_ip)", "starts_with(track, 'v')"),
}
_CUSTOM = {
    "bytes_max": ((("stream", "stream_id"), ("device", "device_type")), "max(response_bytes)", "true"),
    "bytes_min": ((("stream", "stream_id"),), "min(response_bytes)", "true"),
    "errors": ((("stream", "stream_id"),), "count(*)", "response_status >= 500"),
    "bytes_mean": ((("pop", "location_id"),), "avg(response_bytes)", "true"),
}


def _metrics(specs: dict) -> str:
    names = list(dict.fromkeys(label for labels, _, _ in specs.values() for label, _ in labels))
    parts = []
    for metric, (labels, agg, where) in specs.items():
        own = dict(labels)
        cols = ", ".join(f"CAST({own[n]} AS VARCHAR) AS {n}" if n in own else f"CAST(NULL AS VARCHAR) AS {n}" for n in names)
        keys = ", ".join(["minute_ms", *own.values()])
        parts.append(f"SELECT 'cdn_{metric}' AS metric_name, minute_ms, {cols}, CAST({agg} AS DOUBLE) AS value FROM ev WHERE {where} GROUP BY {keys}")
    return EV + "\n" + "\nUNION ALL ".join(parts)


def _gauges(source: str, name: str, keys: str, with_track: bool) -> str:
    dims = ("device_type", "country", *(("track",) if with_track else ()), "region")
    sets = {"": ((), "true"), "_by_device": (("device_type",), "true"), "_by_country": (("country",), "true")}
    if with_track:
        sets["_by_resolution"] = (("track",), "starts_with(track, 'v')")
    sets["_by_region"] = (("country", "region"), "region NOT IN ('', 'Unknown')")
    parts = []
    for suffix, (own, where) in sets.items():
        cols = ", ".join(d if d in own else f"CAST(NULL AS VARCHAR) AS {d}" for d in dims)
        parts.append(
            f"SELECT 'cdn_{name}{suffix}' AS metric_name, {keys}, {cols}, CAST(count(DISTINCT client_ip) AS DOUBLE) AS value FROM {source} WHERE {where} GROUP BY {', '.join([keys, *own])}"
        )
    return "\nUNION ALL ".join(parts)


_VIEW = ", view AS (SELECT minute_ms, stream_id AS stream, device_type, CASE WHEN client_country = '' THEN 'XX' ELSE client_country END AS country, track, region, client_ip FROM ev)"


def _fold(i: int, batch: str, ref: str) -> str:
    """CTEs of poll i: state{i} and closed{i} from state{i-1}."""
    key = "PARTITION BY stream_id, client_ip ORDER BY seq"
    idle = f"last_seen < ref - INTERVAL {GAP} SECOND"
    gone = f"last_seen < ref - INTERVAL {WINDOW} SECOND"
    return f""",
u{i} AS (
  SELECT stream_id, client_ip, last_seen AS t, -1 AS seq, device_type, country, region, first_seen, closed FROM state{i - 1}
  UNION ALL SELECT stream_id, client_ip, t, ingest_seq, device_type, CASE WHEN client_country <> '' THEN client_country ELSE geo_country END, region, NULL, false
  FROM ev WHERE {batch}),
acc{i} AS (SELECT * FROM (SELECT *, max(t) OVER ({key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM u{i}) WHERE latest IS NULL OR t > latest),
beg{i} AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR epoch_us(t) - epoch_us(lag(t) OVER w) > {GAP} * 1000000 OR lag(closed) OVER w THEN 1 ELSE 0 END AS b FROM acc{i} WINDOW w AS ({key})),
num{i} AS (SELECT *, sum(b) OVER ({key} ROWS UNBOUNDED PRECEDING) AS number FROM beg{i}),
ses{i} AS (
  SELECT stream_id, client_ip, number, min(coalesce(first_seen, t)) AS first_seen, max(t) AS last_seen, arg_max(device_type, seq) AS device_type,
    arg_max(country, seq) AS country, arg_max(region, seq) AS region, bool_or(closed) AS was_closed FROM num{i} GROUP BY ALL),
fin{i} AS (SELECT *, number = max(number) OVER (PARTITION BY stream_id, client_ip) AS is_last FROM ses{i}, (SELECT max(t) AS ref FROM ev WHERE {ref})),
closed{i} AS (SELECT stream_id, client_ip, first_seen, last_seen, (epoch_us(last_seen) - epoch_us(first_seen)) / 1000000.0 AS seconds
  FROM fin{i} WHERE NOT was_closed AND (NOT is_last OR {idle} OR {gone})),
state{i} AS (SELECT stream_id, client_ip, first_seen, last_seen, device_type, country, region, was_closed OR {idle} AS closed FROM fin{i} WHERE is_last AND NOT ({gone}))"""


_STATE0 = """,
state0 AS (SELECT '' AS stream_id, '' AS client_ip, TIMESTAMP '2000-01-01' AS first_seen, TIMESTAMP '2000-01-01' AS last_seen,
  '' AS device_type, '' AS country, '' AS region, false AS closed WHERE false)"""
_LATE = f"ingest_seq // {FLUSH_EVENTS} % 2 = 1"
ONE = EV + _STATE0 + _fold(1, "true", "true")
TWO = EV + _STATE0 + _fold(1, f"NOT ({_LATE})", f"NOT ({_LATE})") + _fold(2, _LATE, "true") + ", closed AS (SELECT * FROM closed1 UNION ALL SELECT * FROM closed2)"
_FLAT_STATE = "SELECT stream_id, client_ip, epoch_us(first_seen) // 1000 AS first_ms, epoch_us(last_seen) // 1000 AS last_ms, device_type, country, region, closed FROM "
_FLAT_CLOSED = "SELECT stream_id, client_ip, epoch_us(first_seen) // 1000 AS first_ms, epoch_us(last_seen) // 1000 AS last_ms, seconds FROM "


def _band(seconds: str) -> str:
    return "CASE " + " ".join(f"WHEN {seconds} <= {b} THEN '{label}'" for b, label in BANDS[:-1]) + f" ELSE '{BANDS[-1][1]}' END"


def _watch() -> str:
    null = "CAST(NULL AS VARCHAR)"
    parts = [
        f"SELECT 'cdn_{n}' AS metric_name, stream_id AS stream, {null} AS le, {null} AS band, CAST({v} AS DOUBLE) AS value FROM closed GROUP BY stream_id"
        for n, v in (
            ("watch_sessions_total", "count(*)"), ("watch_time_seconds_total", "sum(seconds)"),
            ("watch_session_duration_seconds_sum", "sum(seconds)"), ("watch_session_duration_seconds_count", "count(*)"),
        )
    ]
    for _, label in BANDS:
        parts.append(f"SELECT 'cdn_watch_session_duration_band_total', stream_id, {null}, '{label}', CAST(count(*) FILTER ({_band('seconds')} = '{label}') AS DOUBLE) FROM closed GROUP BY stream_id")
    for b in (*BUCKETS, None):
        where = f"seconds <= {b}" if b else "true"
        parts.append(f"SELECT 'cdn_watch_session_duration_seconds_bucket', stream_id, '{b or '+Inf'}', {null}, CAST(count(*) FILTER ({where}) AS DOUBLE) FROM closed GROUP BY stream_id")
    return "\nUNION ALL ".join(parts)


_ROUNDED = f"{TWO}, m AS ({_watch()}) SELECT metric_name, stream, le, band, round(value, 3) AS value FROM m"
_TRAFFIC_CTE = """, traffic AS (
  SELECT stream_id AS stream, CAST(resource_id AS VARCHAR) AS cdn_id, cache_status, location_id AS pop, minute_ms AS timestamp_ms, CAST(sum(response_bytes) AS DOUBLE) AS value
  FROM ev GROUP BY ALL), per_stream AS (SELECT stream, timestamp_ms, sum(value) AS value FROM traffic GROUP BY ALL)"""
_STATUS_CTE = """, statuses AS (
  SELECT stream_id AS stream, CAST(response_status AS VARCHAR) AS response_status, minute_ms AS timestamp_ms, CAST(count(*) AS DOUBLE) AS value FROM ev GROUP BY ALL)"""
_FLUSH_CTE = f", fl AS (SELECT DISTINCT ingest_seq // {FLUSH_EVENTS} AS flush, minute_ms FROM ev)"


def _trailing(seconds: int) -> str:
    return f"OVER (PARTITION BY stream ORDER BY timestamp_ms RANGE BETWEEN {seconds * 1000 - 1} PRECEDING AND CURRENT ROW)"


_COUNTER = f"""{TWO}, per AS (SELECT stream_id AS stream, epoch_ms(date_trunc('minute', last_seen)) AS timestamp_ms, count(*) AS n FROM closed GROUP BY ALL),
run AS (SELECT stream, timestamp_ms, CAST(sum(n) OVER (PARTITION BY stream, timestamp_ms >= 1773577800000 ORDER BY timestamp_ms) AS DOUBLE) AS value FROM per),
steps AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL THEN 0 WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS step
  FROM run WINDOW w AS (PARTITION BY stream ORDER BY timestamp_ms))
SELECT stream, timestamp_ms, value, CAST(sum(step) {_trailing(600)} AS DOUBLE) AS increase FROM steps"""

_QUANTILE = f"""{TWO}, b AS (SELECT stream, CASE WHEN le = '+Inf' THEN CAST('inf' AS DOUBLE) ELSE CAST(le AS DOUBLE) END AS bound, value FROM ({_watch()}) WHERE le IS NOT NULL),
r AS (SELECT *, coalesce(lag(value) OVER w, 0) AS below, coalesce(lag(bound) OVER w, 0) AS lower, 0.9 * max(value) OVER (PARTITION BY stream) AS rank
  FROM b WINDOW w AS (PARTITION BY stream ORDER BY bound)),
f AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY bound) AS nth FROM r WHERE value >= rank AND rank > 0)
SELECT stream, round(CASE WHEN bound = CAST('inf' AS DOUBLE) THEN lower ELSE lower + (bound - lower) * (rank - below) / (value - below) END, 6) AS quantile FROM f WHERE nth = 1"""

_REQUESTS = "SELECT stream_id AS stream, CAST(resource_id AS VARCHAR) AS cdn_id, cache_status, location_id AS pop, CAST(count(*) AS DOUBLE) AS value FROM ev WHERE {} GROUP BY ALL"

ORACLES: dict[str, str] = {
    "parse_events": EV + _PLAIN.format(more="device_type, ua_unmatched,"),
    "parse_ndjson": EV + _PLAIN.format(more=""),
    "device_classify": EV + "SELECT device_type, count(*) AS requests FROM ev GROUP BY ALL",
    "track_extract": EV + "SELECT track, starts_with(track, 'v') AS is_video, count(*) AS requests FROM ev GROUP BY ALL",
    "scalar_functions": EV + f"""SELECT ingest_seq, minute_ms AS minute_floor_ms, minute_ms + 100 AS offset_minute_ms,
      epoch_ms(strptime(minute_key, '%d/%b/%Y %H:%M')) AS key_ms, epoch_us(t) // 1000 // 30000 * 30000 AS window_ms,
      {_band('response_bytes / 10.0')} AS band, 'a\\"\\\\' || track AS escaped FROM ev""",
    **{f"metric_{name}": _metrics({name: spec}) for name, spec in _METRICS.items()},
    "minute_metrics": _metrics(_METRICS),
    "custom_metrics": _metrics(_CUSTOM),
    "minute_viewers": EV + _VIEW + _gauges("view", "viewers", "minute_ms, stream", True),
    "geo_join": EV + "SELECT geo_country, region, count(*) AS requests, count(DISTINCT client_ip) AS addresses FROM ev GROUP BY ALL",
    "geo_range_join": EV + """, n AS (SELECT 655360 + user_id // 256 AS b FROM ev)
      SELECT CASE WHEN b % 5 = 4 THEN 'XX' ELSE 'C' || CAST(b % 3 AS VARCHAR) END AS geo_country,
        CASE WHEN b % 5 = 4 THEN 'Unknown' ELSE 'R' || CAST(b % 7 AS VARCHAR) END AS region, count(*) AS requests FROM n GROUP BY ALL""",
    "geo_networks": EV + """, n AS (SELECT 655360 + user_id // 256 AS b FROM ev)
      SELECT family, CASE WHEN b % 5 = 4 THEN CASE family WHEN 4 THEN 'C8' ELSE 'C9' END ELSE 'C' || CAST(b % 3 AS VARCHAR) END AS geo_country,
        CASE WHEN b % 5 = 4 THEN CASE family WHEN 4 THEN 'R8' ELSE 'R9' END ELSE 'R' || CAST(b % 7 AS VARCHAR) END AS region, count(*) AS requests
      FROM n, (SELECT unnest([4, 6]) AS family) GROUP BY ALL""",
    "event_time_range": EV + "SELECT stream_id, epoch_us(min(t)) // 1000 AS first_ms, epoch_us(max(t)) // 1000 AS last_ms, count(*) AS events FROM ev GROUP BY ALL",
    "sessions_batch": EV + f""", b AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > INTERVAL {GAP} SECOND THEN 1 ELSE 0 END AS b
        FROM ev WINDOW w AS (PARTITION BY stream_id, client_ip ORDER BY t)),
      s AS (SELECT *, sum(b) OVER (PARTITION BY stream_id, client_ip ORDER BY t ROWS UNBOUNDED PRECEDING) AS number FROM b)
      SELECT stream_id, client_ip, epoch_us(min(t)) // 1000 AS first_ms, epoch_us(max(t)) // 1000 AS last_ms, count(*) AS events FROM s GROUP BY stream_id, client_ip, number""",
    "session_state": ONE + _FLAT_STATE + "state1",
    "session_closed": ONE + _FLAT_CLOSED + "closed1",
    "session_two_polls_state": TWO + _FLAT_STATE + "state2",
    "session_two_polls_closed": TWO + _FLAT_CLOSED + "closed",
    "session_gauges": ONE + ", g AS (SELECT stream_id AS stream, * FROM state1)" + _gauges("g", "viewers", "stream", False),
    "unique_gauges": ONE + ", g AS (SELECT stream_id AS stream, s.* FROM state1 s, (SELECT date_trunc('minute', max(t)) AS ref FROM ev) WHERE last_seen >= ref - INTERVAL 600 SECOND), u AS ("
    + _gauges("g", "viewers_unique", "stream", False) + ") SELECT *, '10m' AS \"window\" FROM u",
    "watch_metrics": _ROUNDED,
    "watch_merge": _ROUNDED,
    "batch_offsets": EV + _FLUSH_CTE + "SELECT flush, minute_ms, n, n * 100 + 7 AS offset_ms FROM (SELECT *, row_number() OVER (PARTITION BY minute_ms ORDER BY flush) - 1 AS n FROM fl)",
    "batch_offsets_fold": EV + _FLUSH_CTE + """SELECT DISTINCT minute_ms, CAST(CASE WHEN minute_ms IN (SELECT minute_ms FROM fl WHERE flush % 2 = 1) THEN 100 ELSE 0 END + 5 AS BIGINT) AS offset_ms
      FROM fl""",
    "window_split": EV + """SELECT ingest_seq, epoch_us(t) // 1000 >= s AND epoch_us(t) < (s + 29000) * 1000 AS flush FROM ev, (SELECT epoch_us(min(t)) // 1000 // 30000 * 30000 AS s FROM ev)""",
    "unmatched_topk": EV + "SELECT ua_unmatched AS agent, count(*) AS requests FROM ev WHERE ua_unmatched IS NOT NULL GROUP BY ALL ORDER BY requests DESC, agent LIMIT 10",
    "unmatched_summary": EV + """, c AS (SELECT ua_unmatched AS agent, count(*) AS n FROM ev WHERE ua_unmatched IS NOT NULL GROUP BY ALL),
      l AS (SELECT * FROM c ORDER BY n DESC, agent LIMIT 1)
      SELECT CAST((SELECT sum(n) FROM c) AS BIGINT) AS total, (SELECT count(*) FROM l) AS agents, CAST((SELECT sum(n) FROM c) - (SELECT sum(n) FROM l) AS BIGINT) AS overflow""",
    "sample_render": EV + _TRAFFIC_CTE + """SELECT 'cdn_transfer_bytes_total{cache_status="' || cache_status || '",cdn_id="' || cdn_id || '",pop="' || pop || '",stream="' || stream || '",stream_name="' || stream || '"}' AS series,
      value, timestamp_ms + 100 AS timestamp_ms FROM traffic""",
    "sample_retention": EV + _TRAFFIC_CTE + "SELECT stream, cdn_id, cache_status, pop, timestamp_ms, value FROM traffic WHERE timestamp_ms >= 1773576000000 + 30 * 60000",
    "rate_5m": EV + _TRAFFIC_CTE + f"SELECT stream, timestamp_ms, round(r, 6) AS rate, round(r * 8, 6) AS bits FROM (SELECT *, sum(value) {_trailing(300)} / 300.0 AS r FROM per_stream)",
    "over_time": EV + _TRAFFIC_CTE + f"""SELECT stream, timestamp_ms, max(value) {_trailing(600)} AS max_over_time, round(avg(value) {_trailing(600)}, 6) AS avg_over_time,
      sum(value) {_trailing(600)} AS sum_over_time FROM per_stream""",
    "sum_by_pop": EV + _TRAFFIC_CTE + "SELECT pop, timestamp_ms, sum(value) AS value FROM traffic GROUP BY ALL",
    "avg_ttfb_by_pop": EV + """, series AS (SELECT location_id AS pop, minute_ms AS timestamp_ms, avg(ttfb) AS value FROM ev WHERE ttfb > 0
        GROUP BY stream_id, resource_id, cache_status, location_id, minute_ms)
      SELECT pop, timestamp_ms, round(avg(value), 6) AS value FROM series GROUP BY ALL""",
    "label_match": EV + _STATUS_CTE + "SELECT response_status, timestamp_ms, sum(value) AS value FROM statuses WHERE regexp_full_match(response_status, '5..|206') GROUP BY ALL",
    "error_ratio": EV + _STATUS_CTE + """SELECT stream, timestamp_ms, round(sum(value) FILTER (response_status LIKE '5__') / sum(value), 9) AS ratio FROM statuses
      GROUP BY ALL HAVING count(*) FILTER (response_status LIKE '5__') > 0""",
    "topk_country": EV + """, u AS (SELECT minute_ms AS timestamp_ms, stream_id AS stream, client_country AS country, CAST(count(DISTINCT client_ip) AS DOUBLE) AS value FROM ev GROUP BY ALL)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY timestamp_ms ORDER BY value DESC, stream, country) AS rank FROM u) WHERE rank <= 3""",
    "counter_increase": _COUNTER,
    "histogram_quantile": _QUANTILE,
    "diff_compare": EV + f""", a AS ({_REQUESTS.format('true')}), b AS ({_REQUESTS.format("cache_status <> 'EXPIRED' AND NOT (location_id = 'tokyoJPTY' AND client_country = 'US')")})
      SELECT coalesce(a.stream, b.stream) AS stream, coalesce(a.cdn_id, b.cdn_id) AS cdn_id, coalesce(a.cache_status, b.cache_status) AS cache_status, coalesce(a.pop, b.pop) AS pop,
        a.value AS left_value, b.value AS right_value,
        CASE WHEN b.value IS NULL THEN 'missing' WHEN a.value IS NULL THEN 'extra' WHEN abs(a.value - b.value) > 0.01 THEN 'differs' ELSE 'same' END AS status
      FROM a FULL JOIN b ON a.stream = b.stream AND a.cdn_id = b.cdn_id AND a.cache_status = b.cache_status AND a.pop = b.pop""",
}
ORACLES |= {
    "gzip_logs": f"SELECT * EXCLUDE (ingest_seq) FROM ({ORACLES['parse_ndjson']})",
    "snapshot_round_trip": f"SELECT * REPLACE (first_ms // 1000 * 1000 AS first_ms, last_ms // 1000 * 1000 AS last_ms) FROM ({ORACLES['session_state']})",
    "sample_sink": ORACLES["sample_render"],
}
