"""Remote write of samples: protobuf, snappy block, HTTP with retries."""

from __future__ import annotations

import base64
import struct
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Header names and values, and what a duplicate is answered with.
HEADERS = {
    "Content-Encoding": "snappy",
    "Content-Type": "application/x-protobuf",
    "X-Prometheus-Remote-Write-Version": "0.1.0",
}
DUPLICATE = "duplicate sample"
DUPLICATE_STEP_MS, DUPLICATE_TRIES = 2000, 5

#: Labels as pairs, value, timestamp in milliseconds.
Sample = tuple[Sequence[tuple[str, str]], float, int]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def encode(samples: Iterable[Sample]) -> bytes:
    """A WriteRequest: field 1 a series, in it 1 labels (1 name, 2 value) and 2 samples (1 double, 2 int64)."""
    out = []
    for labels, value, stamp in samples:
        series = b"".join(_field(1, _field(1, k.encode()) + _field(2, v.encode())) for k, v in labels)
        series += _field(2, b"\x09" + struct.pack("<d", value) + b"\x10" + _varint(stamp))
        out.append(_field(1, series))
    return b"".join(out)


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int | float]]:
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            n = varint()
            yield tag >> 3, n - (1 << 64) if n >> 63 else n
        elif kind == 1:
            yield tag >> 3, struct.unpack_from("<d", data, at)[0]
            at += 8
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            raise ValueError(f"wire type {kind}")


def decode(data: bytes) -> list[Sample]:
    """What ``encode`` was given."""
    out = []
    for _, series in _fields(data):
        labels, value, stamp = [], 0.0, 0
        for number, part in _fields(series):
            own = dict(_fields(part))
            if number == 1:
                labels.append((own.get(1, b"").decode(), own.get(2, b"").decode()))
            else:
                value, stamp = own.get(1, 0.0), own.get(2, 0)
        out.append((labels, value, stamp))
    return out


def compress(data: bytes) -> bytes:
    return pa.compress(data, codec="snappy", asbytes=True)


@dataclass(frozen=True)
class Endpoint:
    url: str
    user: str | None = None
    password: str | None = None
    retries: int = 5
    base_seconds: float = 1.0
    max_seconds: float = 30.0
    batch: int = 2_000
    timeout: float = 30.0

    def delay(self, attempt: int) -> float:
        return min(self.base_seconds * 2**attempt, self.max_seconds)


def _post(endpoint: Endpoint, body: bytes) -> tuple[int, str]:
    request = urllib.request.Request(endpoint.url, body, HEADERS, method="POST")
    if endpoint.user is not None:
        token = base64.b64encode(f"{endpoint.user}:{endpoint.password or ''}".encode()).decode()
        request.add_header("Authorization", f"Basic {token}")
    try:
        with urllib.request.urlopen(request, timeout=endpoint.timeout) as answer:
            return answer.status, ""
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")
    except OSError as e:
        return 0, str(e)


def push(endpoint: Endpoint, samples: list[Sample], post: Callable[[Endpoint, bytes], tuple[int, str]] = _post) -> bool:
    """One request; if it is refused as a duplicate, again with all stamps two seconds later, five times at most."""
    if not samples:
        return False
    for shift in range(DUPLICATE_TRIES + 1):
        moved = [(labels, v, t + shift * DUPLICATE_STEP_MS) for labels, v, t in samples]
        status, body = post(endpoint, compress(encode(moved)))
        if 200 <= status < 300:
            return True
        if not (status == 400 and DUPLICATE in body):
            return False
    return False


def push_with_retries(endpoint: Endpoint, samples: list[Sample], post: Callable[[Endpoint, bytes], tuple[int, str]] = _post, sleep: Callable[[float], None] = time.sleep) -> bool:
    """Up to ``retries`` more attempts, with delays that double up to a bound."""
    for attempt in range(endpoint.retries + 1):
        if push(endpoint, samples, post):
            return True
        if attempt < endpoint.retries:
            sleep(endpoint.delay(attempt))
    return False


def write_samples(samples: DataFrame, endpoint: Endpoint) -> None:
    """Send ``metric_name, labels, value, timestamp_ms`` from the executors; a batch that can't be sent fails its task.

    A task that runs again sends its samples again; they are the same series and stamps, which
    the receiver knows as duplicates of its own or shifts.
    """

    def send(rows: Iterator) -> None:
        held: list[Sample] = []

        def flush() -> None:
            if held and not push_with_retries(endpoint, held):
                raise RuntimeError(f"{endpoint.url} refused {len(held)} samples")
            held.clear()

        for row in rows:
            held.append(([("__name__", row["metric_name"]), *((p["name"], p["value"]) for p in row["labels"])], row["value"], row["timestamp_ms"]))
            if len(held) >= endpoint.batch:
                flush()
        flush()

    samples.select("metric_name", F.col("labels"), "value", "timestamp_ms").foreachPartition(send)


def write_json(samples: DataFrame, path: str) -> None:
    """The samples as JSON lines."""
    samples.write.mode("overwrite").json(path)
