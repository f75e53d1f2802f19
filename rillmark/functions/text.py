"""Paths, labels and the text form of series."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where stream and track stand in a path.
STREAM = r"^/([a-f0-9]+)/"
TRACK = r"^/[a-f0-9]+/tracks-([^/]+)/"
NO_TRACK = "unknown"


def stream_id(path: Column) -> Column:
    """The path's first segment if it is hexadecimal, else an empty string."""
    return F.regexp_extract(path, STREAM, 1)


def track(path: Column) -> Column:
    """The track in lower case; ``unknown`` if the path has none."""
    found = F.lower(F.trim(F.regexp_extract(path, TRACK, 1)))
    return F.when(found == "", F.lit(NO_TRACK)).otherwise(F.coalesce(found, F.lit(NO_TRACK)))


def is_video(track_column: Column) -> Column:
    return F.startswith(track_column, F.lit("v"))


def escaped(value: Column) -> Column:
    """A label value with backslashes, line feeds and quotes escaped."""
    value = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    value = F.replace(value, F.lit("\n"), F.lit("\\n"))
    return F.replace(value, F.lit('"'), F.lit('\\"'))


def series_text(name: Column, labels: dict[str, Column]) -> Column:
    """``name{a="x",b="y"}`` with sorted keys; labels that are null are left out."""
    parts = [F.concat(F.lit(f'{k}="'), escaped(labels[k].cast("string")), F.lit('"')) for k in sorted(labels)]
    return F.concat(name, F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


_LABEL = re.compile(r'\s*([^=,{}"\s]+)\s*=\s*"((?:[^"\\]|\\.)*)"\s*(,|$)', re.S)
_UNESCAPED = {"\\": "\\", '"': '"', "n": "\n"}


def parse_series(text: str) -> tuple[str, list[tuple[str, str]]]:
    """Name and labels of a series in text form; raises ValueError if it is malformed."""
    name, brace, rest = text.partition("{")
    name = name.strip()
    if not name:
        raise ValueError(f"no name in {text!r}")
    if not brace:
        return name, []
    rest = rest.rstrip()
    if not rest.endswith("}"):
        raise ValueError(f"no closing brace in {text!r}")
    body, at, labels = rest[:-1], 0, []
    while body[at:].strip():
        m = _LABEL.match(body, at)
        if not m:
            raise ValueError(f"bad label at {at} in {text!r}")
        labels.append((m[1], re.sub(r"\\(.)", lambda x: _UNESCAPED.get(x[1], "\\" + x[1]), m[2], flags=re.S)))
        at = m.end()
        if m[3] == "," and not body[at:].strip():
            raise ValueError(f"nothing after the last comma in {text!r}")
    return name, labels
