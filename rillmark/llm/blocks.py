"""Vectorised text work on blocks of whole documents.

``mapInArrow`` hands over Arrow batches whose string column already is one byte buffer with
offsets. A block is a slice of such a batch of about a MB (one document at least), so the
memory of a task doesn't grow with its input. All hashes are 64 bits.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1_000_000
U64 = np.uint64

#: The bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_SPREAD = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[int, np.ndarray] = {}


class Block(NamedTuple):
    rows: pa.RecordBatch
    data: np.ndarray  # the bytes of all its texts
    off: np.ndarray  # where each text begins, and the end
    valid: np.ndarray  # false where the text is null


def release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks of different operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut batches into blocks of at most ``most`` bytes (or one text) of text; a null text counts as empty."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        valid = np.ones(n, bool) if not col.null_count else np.asarray(col.is_valid())
        wide = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
        _, offsets, data = col.buffers()
        off = np.frombuffer(offsets, wide, n + 1, col.offset * np.dtype(wide).itemsize).astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            own = off[at : to + 1]
            yield Block(batch.slice(at, to - at), raw[own[0] : own[-1]], own - own[0], valid[at:to])
            at = to
    release()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2 ** 64, kept for the next block."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, U64)
        step = base
        while len(have) < n:
            have = np.concatenate([have, have * U64(step)])
            step = step * step % (1 << 64)
        _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums ``q`` such that the bytes from l to r hash to ``(q[r] - q[l]) * unpower[l]``."""
    q = np.zeros(len(data) + 1, U64)
    np.cumsum(_SPREAD[data] * powers(_BASE, len(data)), out=q[1:])
    return q


def span_hash(q: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Polynomial hash of the bytes from ``left`` to ``right``, wherever they stand; lengths enter too."""
    h = (q[right] - q[left]) * powers(_UNBASE, len(q))[left]
    return mix(h + (right - left).astype(U64) * U64(0xD6E8FEB86659FD93))


def window_hash(q: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` bytes from each position on."""
    h = q[n:] - q[:-n]
    h *= powers(_UNBASE, len(q))[: len(h)]
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    return h


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and document of each maximal run of non-separators."""
    inside = ~SEPARATOR[data]
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    first = off[:-1][off[:-1] < off[-1]]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[first] = inside[first]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = off[1:][off[1:] > 0] - 1
    end[last] = inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def grams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each window of ``n`` words that lies within one document."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    h = np.zeros(count, U64)
    for j in range(n):
        h = h * U64(0x9FB21C651E98DF25) + hashes[j : j + count]
    at = np.flatnonzero(doc[:count] == doc[n - 1 :])
    return mix(h[at]), at


def per_document(doc: np.ndarray, n: int) -> np.ndarray:
    """Where each document's entries begin in ``doc``, which is sorted; n + 1 bounds."""
    return np.searchsorted(doc, np.arange(n + 1))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays to bytes; ``unpack`` reads them with the same types."""
    return b"".join(len(a).to_bytes(8, "little") + np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes, *types: type) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(np.frombuffer(blob, t, n, at + 8))
        at += 8 + n * np.dtype(t).itemsize
    return out


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
