"""Declarative per-minute metrics, compiled to two passes of grouping sets.

A metric is data: a name, an aggregation, a value expression, label expressions and a filter.
All additive metrics are computed from one grouped pass over the events, whose partial
states are then rolled up to each metric's own labels. All distinct counts share another.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Agg(Enum):
    SUM = "sum"
    AVG = "avg"
    MAX = "max"
    MIN = "min"
    COUNT = "count"
    UNIQUE_COUNT = "unique_count"


@dataclass(frozen=True)
class MetricSpec:
    """``value`` and label expressions are SQL text or Columns; rows where ``where`` fails or ``value`` is null don't count."""

    name: str
    agg: Agg
    value: str | Column
    labels: Mapping[str, str | Column] = field(default_factory=dict)
    where: str | Column | None = None


#: Names, labels and label sources of the eight standard metrics.
_TRAFFIC = {"stream": "stream_id", "cdn_id": "resource_id", "cache_status": "cache_status", "pop": "location_id"}
STANDARD = (
    MetricSpec("transfer_bytes_total", Agg.SUM, "response_bytes", _TRAFFIC),
    MetricSpec("time_to_first_byte_ms", Agg.AVG, "time_to_first_byte_ms", _TRAFFIC, "time_to_first_byte_ms > 0"),
    MetricSpec("requests_total", Agg.SUM, "1.0D", _TRAFFIC),
    MetricSpec("responses_total", Agg.SUM, "1.0D", _TRAFFIC | {"response_status": "response_status"}),
    MetricSpec("users_total", Agg.UNIQUE_COUNT, "client_ip", {"stream": "stream_id"}),
    MetricSpec("users_by_device_total", Agg.UNIQUE_COUNT, "client_ip", {"stream": "stream_id", "device_type": "device_type"}),
    MetricSpec("users_by_country_total", Agg.UNIQUE_COUNT, "client_ip", {"stream": "stream_id", "country": "client_country"}),
    MetricSpec("users_by_resolution_total", Agg.UNIQUE_COUNT, "client_ip", {"stream": "stream_id", "track": "track"}, "startswith(track, 'v')"),
)


def _column(x: str | Column) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def _label(x: str | Column) -> Column:
    return F.coalesce(_column(x).cast("string"), F.lit("unknown"))


def label_names(specs: Sequence[MetricSpec]) -> list[str]:
    return list(dict.fromkeys(k for s in specs for k in s.labels))


def minute_metrics(events: DataFrame, specs: Sequence[MetricSpec] = STANDARD, prefix: str = "", time: str = "minute") -> DataFrame:
    """``metric_name, minute, <labels>, value``; labels that a metric doesn't have are null.

    A group in which no row counts gives no series.
    """
    names = label_names(specs)
    additive = [s for s in specs if s.agg is not Agg.UNIQUE_COUNT]
    distinct = [s for s in specs if s.agg is Agg.UNIQUE_COUNT]
    parts = [f(events, own, prefix, time) for f, own in ((_additive, additive), (_distinct, distinct)) if own]
    out = None
    for part in parts:
        part = part.select("metric_name", F.col(time).alias("minute"), *[F.col(n) if n in part.columns else F.lit(None).cast("string").alias(n) for n in names], "value")
        out = part if out is None else out.unionByName(part)
    return out


def _value(spec: MetricSpec) -> Column:
    value = _column(spec.value)
    return value if spec.where is None else F.when(_column(spec.where), value)


def _label_columns(specs: Sequence[MetricSpec]) -> dict[str, Column]:
    """One column for each different label expression."""
    out: dict[str, Column] = {}
    for s in specs:
        for name, source in s.labels.items():
            out.setdefault(name, _label(source))
    return out


def _sets(specs: Sequence[MetricSpec], names: list[str]) -> list[tuple[str, ...]]:
    return list(dict.fromkeys(tuple(n for n in names if n in s.labels) for s in specs))


def _grouping_id(names: list[str], own: Sequence[str]) -> int:
    """What ``grouping_id()`` is for a set: a bit for each column that isn't in it, the time first."""
    return sum(1 << (len(names) - 1 - i) for i, n in enumerate(names) if n not in own)


def _series(grouped: DataFrame, specs: Sequence[MetricSpec], names: list[str], finals: list[Column], prefix: str, time: str) -> DataFrame:
    """A row for each metric whose labels are those of the row's grouping set."""
    cases = None
    for own in _sets(specs, names):
        rows = F.array(*[
            F.struct(F.lit(prefix + s.name).alias("metric_name"), v.cast("double").alias("value"))
            for s, v in zip(specs, finals, strict=True) if tuple(n for n in names if n in s.labels) == own
        ])
        hit = F.col("gid") == _grouping_id(names, own)
        cases = F.when(hit, rows) if cases is None else cases.when(hit, rows)
    return grouped.select(time, *names, F.explode(cases).alias("m")).select("m.metric_name", time, *names, "m.value").where("value is not null")


def _additive(events: DataFrame, specs: Sequence[MetricSpec], prefix: str, time: str) -> DataFrame:
    labels = _label_columns(specs)
    names = list(labels)
    aggs, merges, finals = [], [], []
    for i, s in enumerate(specs):
        v, n = _value(s), f"n{i}"
        if s.agg is Agg.COUNT:
            aggs.append(F.count(v).alias(n))
            merges.append(F.sum(n).alias(n))
            finals.append(F.when(F.col(n) > 0, F.col(n)))
        elif s.agg is Agg.AVG:
            aggs += [F.sum(v.cast("double")).alias(f"s{i}"), F.count(v).alias(n)]
            merges += [F.sum(f"s{i}").alias(f"s{i}"), F.sum(n).alias(n)]
            finals.append(F.when(F.col(n) > 0, F.col(f"s{i}") / F.col(n)))
        else:
            f = {Agg.SUM: F.sum, Agg.MAX: F.max, Agg.MIN: F.min}[s.agg]
            aggs.append(f(v.cast("double")).alias(n))
            merges.append(f(n).alias(n))
            finals.append(F.col(n))
    base = events.withColumns({f"l_{n}": c for n, c in labels.items()}).groupBy(time, *[f"l_{n}" for n in names]).agg(*aggs)
    base = base.select(time, *[F.col(f"l_{n}").alias(n) for n in names], *[c for c in base.columns if c != time and not c.startswith("l_")])
    sets = _sets(specs, names)
    if len(sets) == 1 and set(sets[0]) == set(names):
        return _series(base.withColumn("gid", F.lit(0)), specs, names, finals, prefix, time)
    rolled = base.groupingSets([[F.col(time), *map(F.col, own)] for own in sets], F.col(time), *map(F.col, names)).agg(F.grouping_id().alias("gid"), *merges)
    return _series(rolled, specs, names, finals, prefix, time)


def _distinct(events: DataFrame, specs: Sequence[MetricSpec], prefix: str, time: str) -> DataFrame:
    labels = _label_columns(specs)
    names = list(labels)
    values = {f"v{i}": _value(s) for i, s in enumerate(specs)}
    # metrics over the same value share a column, so the planner expands once
    shared: dict[str, str] = {}
    for i, s in enumerate(specs):
        shared.setdefault(str(values[f"v{i}"]), f"v{i}")
    flat = events.select(time, *[c.alias(n) for n, c in labels.items()], *[values[v].alias(v) for v in dict.fromkeys(shared.values())])
    counts = [F.count_distinct(v).alias(v) for v in dict.fromkeys(shared.values())]
    sets = _sets(specs, names)
    grouped = flat.groupingSets([[F.col(time), *map(F.col, own)] for own in sets], F.col(time), *map(F.col, names)).agg(F.grouping_id().alias("gid"), *counts)
    finals = [F.when(F.col(shared[str(values[f"v{i}"])]) > 0, F.col(shared[str(values[f"v{i}"])])) for i in range(len(specs))]
    return _series(grouped, specs, names, finals, prefix, time)
