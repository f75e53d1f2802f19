"""Benchmark decontamination by q-gram lemma filtering.

A benchmark text is cut into overlapping windows of ``WINDOW`` characters (a shorter text is one
window), so a part of it of ``WINDOW + STRIDE`` characters is found as well as the whole. A window of m characters and a piece
of a document within k edits of it share at least ``m + 1 - q * (k + 1)`` q-grams, whose places
differ by diagonals within a band of k + 1. So q-gram matches are counted in overlapping bands
of two times k + 1 diagonals, bands that reach the bound are kept, and a banded alignment
verifies them.

Texts are compared with A-Z lower-cased and each run of separators as one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.blocks import LOWER, SEPARATOR, U64, blocks, column, prefix_hash, window_hash
from rillmark.llm.scratch import stage_table

Q = 10
WINDOW = 80
STRIDE = 20
#: Edits for each hundred characters of a window.
EDIT_PERCENT = 5
#: Benchmark characters that one index may hold; a larger benchmark is searched index by index.
INDEX_CHARS = 4_000_000
#: Pairs of a hit and a window that are expanded at once.
SLICE = 2_000_000
#: Bits of the table that rules out most q-grams of a document at once.
TABLE_BITS = 22


class Index(NamedTuple):
    items: list[int]  # benchmark id of each window
    texts: list[bytes]
    begin: np.ndarray  # place of each window in its item
    grams: np.ndarray  # sorted hashes
    window: np.ndarray  # their windows
    place: np.ndarray  # and places in them
    table: np.ndarray


def normalise(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with case and separators folded, their offsets, and where each byte stood."""
    gap = SEPARATOR[data]
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    if len(data):
        keep[0] = True
    first = off[:-1][off[:-1] < len(data)]
    keep[first] = True
    at = np.flatnonzero(keep)
    out = LOWER[data[at]]
    out[gap[at]] = 32
    return out, np.searchsorted(at, off), at


def budget(length: int) -> int:
    return length * EDIT_PERCENT // 100


def make_index(items: list[tuple[int, str]]) -> Index | None:
    """Windows of the given texts and the index of their q-grams; texts under ``Q`` bytes have none."""
    ids, texts, begins = [], [], []
    for item, text in items:
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        data = bytes(normalise(raw, np.array([0, len(raw)]))[0]).strip(b" ")
        starts = range(0, max(1, len(data) - WINDOW + STRIDE), STRIDE) if len(data) > WINDOW else (0,)
        for b in starts:
            b = max(0, min(b, len(data) - WINDOW))
            piece = data[b : b + WINDOW]
            if len(piece) >= Q and _least(len(piece)) > 0:
                ids.append(item), texts.append(piece), begins.append(b)
    if not ids:
        return None
    h, w, p = [], [], []
    for i, piece in enumerate(texts):
        own = window_hash(prefix_hash(np.frombuffer(piece, np.uint8)), Q)
        h.append(own), w.append(np.full(len(own), i)), p.append(np.arange(len(own)))
    grams, window, place = np.concatenate(h), np.concatenate(w), np.concatenate(p)
    order = np.argsort(grams, kind="stable")
    grams, window, place = grams[order], window[order], place[order]
    table = np.zeros(1 << TABLE_BITS, bool)
    table[(grams >> U64(64 - TABLE_BITS)).astype(np.int64)] = True
    return Index(ids, texts, np.array(begins), grams, window.astype(np.int32), place.astype(np.int32), table)


def _least(length: int) -> int:
    """q-grams that a window must share with a piece within its edit budget."""
    return length + 1 - Q * (budget(length) + 1)


def banded_distance(pattern: bytes, text: bytes, k: int) -> tuple[int, int] | None:
    """Least edits between ``pattern`` and a piece of ``text`` and where the piece ends, if within ``k``.

    The piece may begin at any of the first 2k + 1 characters and end anywhere: only cells of
    the band of these diagonals, widened by k on either side, are filled in.
    """
    if pattern in text:
        return 0, text.index(pattern) + len(pattern)
    width = 4 * k + 3
    far = k + 1
    # row i holds columns i - k - 1 + j
    row = [0 if 0 <= j - k - 1 else far for j in range(width)]
    for i, c in enumerate(pattern, 1):
        new = [far] * width
        for j in range(width):
            at = i - k - 1 + j
            if at < 0 or at > len(text):
                continue
            best = row[j + 1] + 1 if j + 1 < width else far
            if at > 0:
                diagonal = row[j] + (text[at - 1] != c)
                if diagonal < best:
                    best = diagonal
                if j and new[j - 1] + 1 < best:
                    best = new[j - 1] + 1
            elif i < best:
                best = i
            new[j] = best if best < far else far
        row = new
        if min(row) >= far:
            return None
    best = min(row)
    return (best, len(pattern) - k - 1 + row.index(best)) if best <= k else None


def _bands(hit: np.ndarray, low: np.ndarray, many: np.ndarray, doc: np.ndarray, at: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, int]]:
    """Document row, window, half band and its width, of the bands that reach their bound.

    Hits, in the order of their places, are expanded by the windows that hold them in slices of
    about ``SLICE`` pairs. Between slices only counts of the bands that later hits may still
    fall into are kept, so a phrase that stands everywhere doesn't fill the memory.
    """
    lengths = np.array([len(t) for t in index.texts])
    widths, bounds = lengths * EDIT_PERCENT // 100 + 1, lengths + 1 - Q * (lengths * EDIT_PERCENT // 100 + 1)
    before = np.r_[0, np.cumsum(many)]
    held = [np.empty(0, np.int64)] * 4
    start = 0
    while start < len(hit):
        stop = max(start + 1, int(np.searchsorted(before, before[start] + SLICE, "right")) - 1)
        own = slice(start, stop)
        each = np.repeat(np.arange(start, stop), many[own])
        entry = np.repeat(low[own] - (before[own] - before[start]), many[own]) + np.arange(len(each))
        window = index.window[entry].astype(np.int64)
        # diagonals can lie before the document: shift them to be positive
        half = (hit[each] - index.place[entry] - at[doc[each]] + WINDOW) // widths[window]
        d, w, h, n = (np.concatenate(x) for x in zip(held, (doc[each], window, half, np.ones(len(each), np.int64)), strict=True))
        order = np.lexsort((h, w, d))
        d, w, h, n = d[order], w[order], h[order], n[order]
        first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (w[1:] != w[:-1]) | (h[1:] != h[:-1])])
        d, w, h, n = d[first], w[first], h[first], np.add.reduceat(n, first)
        # a band is a half and the one after it; a band may also begin with the half before
        follows = np.r_[(d[1:] == d[:-1]) & (w[1:] == w[:-1]) & (h[1:] == h[:-1] + 1), False]
        band = n + np.where(follows, np.r_[n[1:], 0], 0)
        closed = np.ones(len(d), bool) if stop == len(hit) else (h + 2) * widths[w] + at[d] <= hit[stop]
        for i in np.flatnonzero(closed & (band >= bounds[w])):
            yield int(d[i]), int(w[i]), int(h[i]), int(widths[w[i]])
        held = [x[~closed] for x in (d, w, h, n)]
        start = stop


def find_leaks(data: np.ndarray, off: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int, int]]:
    """Document row, window, begin and end in its bytes, edits: one for each verified window."""
    text, at, back = normalise(data, off)
    if len(text) < Q:
        return []
    h = window_hash(prefix_hash(text), Q)
    hit = np.flatnonzero(index.table[(h >> U64(64 - TABLE_BITS)).astype(np.int64)])
    low = np.searchsorted(index.grams, h[hit])
    real = index.grams[np.minimum(low, len(index.grams) - 1)] == h[hit]
    hit, low = hit[real], low[real]
    many = np.searchsorted(index.grams, h[hit], "right") - low
    doc = np.searchsorted(at, hit, "right") - 1
    inside = hit + Q <= at[doc + 1]
    hit, low, many, doc = hit[inside], low[inside], many[inside], doc[inside]
    if not len(hit):
        return []
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for d, w, half, wide in _bands(hit, low, many, doc, at, index):
        k = wide - 1
        begin = half * wide - WINDOW + int(at[d])
        # pieces start within the band's diagonals, at most k edits off
        lo = max(int(at[d]), begin - k)
        hi = min(int(at[d + 1]), begin + 2 * (k + 1) + len(index.texts[w]) + 2 * k)
        piece = text[lo:hi].tobytes()
        got = None
        for shift in range(0, max(1, begin + 2 * (k + 1) - lo + k), 2 * k + 1):
            near = banded_distance(index.texts[w], piece[shift : shift + len(index.texts[w]) + 4 * k + 2], k)
            if near and (got is None or near[0] < got[0]):
                got = (near[0], shift + near[1])
            if got and not got[0]:
                break
        if got and ((d, w) not in found or got[0] < found[d, w][2]):
            end = lo + got[1]
            start = max(int(at[d]), end - len(index.texts[w]))
            found[d, w] = (int(back[start] - off[d]), int(back[end - 1] + 1 - off[d]), got[0])
    return [(d, w, *span) for (d, w), span in found.items()]


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for block in blocks(batches):
            ids = column(block.rows, "doc_id").to_pylist()
            out = [
                (ids[d], index.items[w], int(index.begin[w]), len(index.texts[w]), a, b, e)
                for d, w, a, b, e in sorted(find_leaks(block.data, block.off, index))
                if ids[d] is not None
            ]
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            names = ["doc_id", "item_id", "item_begin", "item_length", "begin", "end", "edits"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return run


def leaked_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Passages of ``benchmark(item_id, text)`` in documents, one row for each item and document.

    Returns ``doc_id, item_id, windows, begin, end, edits``: how many windows of the item were
    found, the bytes of the text from the first of them to the last, and the least edits of
    a window. Only documents with a leak have rows. Null ids, and null texts, empty ones and
    those under ``Q`` bytes match nothing. Repeated rows give one row. Texts are read whole. Further columns
    aren't read.

    The benchmark is broadcast in indexes of ``INDEX_CHARS`` characters at most, one after the
    other: each is searched for in all documents, what it found is written, and it is
    given back before the next is made.
    """
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    return _passages(docs, [stage_table(docs.mapInArrow(_search(index), _FOUND), "found") for index in _indexes(benchmark)])


_FOUND = "doc_id long, item_id long, item_begin long, item_length long, begin long, end long, edits long"


def _indexes(benchmark: DataFrame) -> Iterator[Broadcast]:
    """Indexes of the benchmark, of which only the last given one is held."""
    items = benchmark.where("item_id is not null and length(text) > 0").select("item_id", "text").distinct()
    for index in map(make_index, _parts(items)):
        if index is not None:
            shared = benchmark.sparkSession.sparkContext.broadcast(index)
            yield shared
            shared.destroy()


def _passages(docs: DataFrame, tables: list[DataFrame]) -> DataFrame:
    found = reduce(DataFrame.union, tables, docs.sparkSession.createDataFrame([], _FOUND))
    return found.groupBy("doc_id", "item_id").agg(
        F.count_distinct("item_begin").alias("windows"), F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("edits").alias("edits")
    )


def _parts(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's texts in order, in parts that an index may hold; rows come one partition at a time."""
    part, held = [], 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        if part and held + len(row["text"]) > INDEX_CHARS:
            yield part
            part, held = [], 0
        part.append((row["item_id"], row["text"]))
        held += len(row["text"])
    if part:
        yield part


def _clean(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            clean = np.ones(len(block.valid), bool)
            clean[[found[0] for found in find_leaks(block.data, block.off, shared.value)]] = False
            yield block.rows.filter(pa.array(clean))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, null_ids: bool = False) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage; all columns are kept.

    Rows with a null text are kept. The ids of leaking documents are joined, not collected. Rows
    with a null id are kept too, or with ``null_ids`` each is searched and decided by its own text.
    """
    named = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    nameless = docs.where("doc_id is null")
    null_ids = null_ids and not nameless.isEmpty()
    tables = []
    for index in _indexes(benchmark):
        tables.append(stage_table(named.mapInArrow(_search(index), _FOUND), "found"))
        if null_ids:
            nameless = stage_table(nameless.mapInArrow(_clean(index), docs.schema), "nameless")
    leaking = _passages(docs, tables).select("doc_id").distinct()
    kept = (docs.where("doc_id is not null") if null_ids else docs).join(leaking, "doc_id", "left_anti").select(*docs.columns)
    return kept.union(nameless) if null_ids else kept
