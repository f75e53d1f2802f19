"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a
smaller id. Three steps find these strings:

1. Every window of ``length`` bytes is named by the smallest hash among its q-grams (its
   anchor). Equal windows have equal anchors, so only anchors are shuffled, 5 bytes for
   each run of windows with the same one, and only anchors met in two texts go on.
2. The texts are read again; each run of windows under such an anchor is sent, as one
   string, to the bucket of the anchor.
3. In a bucket the suffixes under each anchor are put in order by mergesort, but for those whose
   first ``length`` bytes have a hash that no other has: nothing is equal to them. Two suffixes
   are compared by a binary search for their common extension on prefix polynomial hashes,
   so a comparison takes a logarithmic number of steps. Neighbours that agree on ``length``
   bytes, verified byte by byte, hold equal windows; all but those of the smallest document
   are removed.

Each task first settles what its own documents settle among themselves, so a passage that
a third of all documents share is sent on once for each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.blocks import U64, blocks, column, mix, pack, powers, prefix_hash, span_hash, unpack, window_hash, _UNBASE
from rillmark.llm.copies import owners, split_hot_copies
from rillmark.llm.scratch import stage_table

GRAM = 20
#: What a task gathers before it sends on, and bytes of strings that it works on at once.
FLUSH_ANCHORS = 1_500_000
FLUSH_BYTES = 16_000_000
WORK_BYTES = 3_000_000
BUCKET_BYTES = 12_000_000
TEXT_BYTES = 24_000_000


def window_anchors(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, number of windows, anchor and document.

    Only windows that lie within one document count.
    """
    none = np.empty(0, np.int64)
    size = np.diff(off)
    if len(data) < length or not (size >= length).any():
        return none, none, np.empty(0, U64), none
    low = window_hash(prefix_hash(data), GRAM)
    width, reach = length - GRAM + 1, 1
    while reach < width:
        step = min(reach, width - reach)
        low = np.minimum(low[: len(low) - step], low[step:])
        reach += step
    # windows by document; those across two documents fall out here
    count = np.maximum(size - length + 1, 0)
    keep = np.flatnonzero(count)
    doc = np.repeat(keep, count[keep])
    first = np.repeat(off[:-1][keep] - np.r_[0, np.cumsum(count[keep])[:-1]], count[keep])
    start = first + np.arange(len(doc))
    anchor = low[start]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    return start[new], np.diff(np.r_[new, len(doc)]), anchor[new], doc[new]


def _batch(buckets: list, homes: list, blobs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int32()), pa.array(homes, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "home", "blob"]
    )


#: A row with a home is a result for the texts of that home, else it is work for its bucket.
_SCHEMA = "bucket int, home int, blob binary"
_HOME = U64(0xC2B2AE3D27D4EB4F)


def _short(anchor: np.ndarray) -> np.ndarray:
    """40 bits of an anchor. A bucket holds a bounded number of anchors, so at any corpus size about one pair of
    them in it agrees by chance; such a pair is looked at for nothing, no more."""
    return mix(anchor) & U64((1 << 40) - 1)


def _five_bytes(short: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(short.view(np.uint8).reshape(-1, 8)[:, :5]).reshape(-1)


def _from_five_bytes(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = raw.reshape(-1, 5)
    return wide.reshape(-1).view(U64)


def _home(anchor: np.ndarray, buckets: int) -> np.ndarray:
    # anchors are minima, so their high bits are poor: scatter them
    return (mix(anchor * _HOME) % U64(buckets)).astype(np.int64)


def _text_home(k1: np.ndarray, homes: int) -> np.ndarray:
    return (mix(np.ascontiguousarray(k1).view(U64)) % U64(homes)).astype(np.int64)


_NO_IDS = np.empty(0, np.int64)


def _to_homes(k1: np.ndarray, k2: np.ndarray, text: np.ndarray, values: np.ndarray, homes: int, rank: np.ndarray | None = None) -> list[tuple[int, int, bytes]]:
    """Values of texts, a row of bytes each, packed by the home of their text, so that rows don't multiply by buckets."""
    if not len(text):
        return []
    home = _text_home(k1[text], homes)
    order = np.lexsort((text, home))
    text, values, home = text[order], values[order], home[order]
    cut = np.searchsorted(home, np.arange(homes + 1))
    rows = []
    for i in np.flatnonzero(np.diff(cut)):
        t, v = text[cut[i] : cut[i + 1]], values[cut[i] : cut[i + 1]]
        turn = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        runs = np.diff(np.r_[turn, len(t)])
        ranks = _NO_IDS if rank is None else rank[t[turn]]
        rows.append((int(i), int(i), pack(k1[t[turn]], k2[t[turn]], ranks, runs, v.reshape(-1))))
    return rows


def _ids_to_homes(least: dict[tuple[int, int], int], homes: int) -> list[tuple[int, int, bytes]]:
    """The smallest id that a task met of each text, without values."""
    if not least:
        return []
    table = np.array([(*key, doc) for key, doc in least.items()], np.int64)
    home = _text_home(table[:, 0], homes)
    table = table[np.argsort(home, kind="stable")]
    cut = np.r_[0, np.cumsum(np.bincount(home, minlength=homes))]
    return [(int(i), int(i), pack(*table[cut[i] : cut[i + 1]].T, _NO_IDS, np.empty(0, np.uint8))) for i in np.flatnonzero(np.diff(cut))]


def _gather(distinct_anchors: bool):
    """One row for each text of a home that has values, with all of them and the smallest id met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for home, blob in zip(column(batch, "home").to_pylist(), column(batch, "blob").to_pylist(), strict=True):
                held.setdefault(home, []).append(blob)
        for home in list(held):
            found: dict[tuple[int, int], list[np.ndarray]] = {}
            least: dict[tuple[int, int], int] = {}
            for blob in held.pop(home):
                k1, k2, ranks, runs, values = unpack(blob, np.int64, np.int64, np.int64, np.int64, np.uint8)
                keys = list(zip(k1.tolist(), k2.tolist(), strict=True))
                if len(ranks):
                    for key, doc in zip(keys, ranks.tolist(), strict=True):
                        if doc < least.get(key, doc + 1):
                            least[key] = doc
                if len(runs):
                    width = len(values) // int(runs.sum())
                    stop = np.cumsum(runs) * width
                    for key, a, b in zip(keys, stop - runs * width, stop, strict=True):
                        found.setdefault(key, []).append(values[a:b])
            keys = list(found)
            whole = [np.concatenate(found[k]) for k in keys]
            if distinct_anchors:
                whole = [_five_bytes(np.unique(_from_five_bytes(x))) for x in whole]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                    pa.array([least[k] for k in keys], pa.int64()), pa.array([x.tobytes() for x in whole], pa.binary()),
                ],
                ["k1", "k2", "doc_id", "found"],
            )

    return run


def _sort_rows(batches: Iterator[pa.RecordBatch], held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
    """Hold the work of buckets and pass results on."""
    for batch in batches:
        done = []
        for row in zip(*(column(batch, c).to_pylist() for c in ("bucket", "home", "blob")), strict=True):
            if row[1] is None:
                held.setdefault(row[0], []).append(row[2])
            else:
                done.append(row)
        if done:
            yield _batch(*zip(*done, strict=True))


def _anchor_blobs(length: int, buckets: int):
    """Step 1 in a task: anchors that two of its texts share are known; one of each is sent on.

    The home of a text learns its smallest id, once from each task unless a smaller one comes later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k1s: list[np.ndarray] = []
        k2s: list[np.ndarray] = []
        anchors: list[np.ndarray] = []
        texts: list[np.ndarray] = []
        seen: dict[tuple[int, int], int] = {}
        news: dict[tuple[int, int], int] = {}
        held = n_texts = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n_texts, held
            rows = _ids_to_homes(news, buckets)
            if anchors:
                k1, k2 = np.concatenate(k1s), np.concatenate(k2s)
                anchor, text = np.concatenate(anchors), np.concatenate(texts)
            if anchors and len(anchor):
                order = np.argsort(anchor, kind="stable")
                anchor, text = anchor[order], text[order]
                new = np.r_[True, anchor[1:] != anchor[:-1]]
                first = np.flatnonzero(new)
                group = np.cumsum(new) - 1
                several = np.zeros(len(first), bool)
                several[group[text != text[first][group]]] = True
                known = np.flatnonzero(several[group])
                rows += _to_homes(k1, k2, text[known], _five_bytes(_short(anchor[known])).reshape(-1, 5), buckets)
                anchor, text = anchor[first], text[first]
                home = _home(anchor, buckets)
                order = np.lexsort((text, home))
                anchor, text, home = anchor[order], text[order], home[order]
                cut = np.searchsorted(home, np.arange(buckets + 1))
                for i in range(buckets):
                    t = text[cut[i] : cut[i + 1]]
                    if len(t):
                        turn = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                        runs = np.diff(np.r_[turn, len(t)]).astype(np.int32)
                        rows.append((i, None, pack(k1[t[turn]], k2[t[turn]], runs, _five_bytes(_short(anchor[cut[i] : cut[i + 1]])))))
            if rows:
                yield _batch(*zip(*rows, strict=True))
            k1s.clear(), k2s.clear(), anchors.clear(), texts.clear(), news.clear()
            held = n_texts = 0

        for block in blocks(batches):
            k1, k2 = (np.asarray(column(block.rows, c)) for c in ("k1", "k2"))
            fresh = np.zeros(len(k1), bool)
            for i, (*pair, doc) in enumerate(zip(k1.tolist(), k2.tolist(), column(block.rows, "doc_id").to_pylist(), strict=True)):
                key = (pair[0], pair[1])
                fresh[i] = key not in seen
                if fresh[i] or doc < seen[key]:
                    seen[key] = news[key] = doc
            _, _, anchor, doc = window_anchors(block.data, block.off, length)
            mine = fresh[doc]
            k1s.append(k1), k2s.append(k2), anchors.append(anchor[mine]), texts.append(doc[mine] + n_texts)
            n_texts += len(k1)
            held += len(anchors[-1])
            if held >= FLUSH_ANCHORS:
                yield from flush()
        yield from flush()

    return run


def _shared_anchors(buckets: int):
    """Step 1 in a bucket: the anchors that two texts share, for each of these texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        yield from _sort_rows(batches, held)
        for b in list(held):
            parts = [unpack(x, np.int64, np.int64, np.int32, np.uint8) for x in held.pop(b)]
            key = np.stack([np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])])
            keys, which = np.unique(key, axis=1, return_inverse=True)
            text = np.repeat(which.reshape(-1), np.concatenate([p[2] for p in parts]))
            anchor = _from_five_bytes(np.concatenate([p[3] for p in parts]))
            parts.clear()
            order = np.argsort(anchor, kind="stable")
            anchor, text = anchor[order], text[order]
            new = np.r_[True, anchor[1:] != anchor[:-1]]
            first, group = np.flatnonzero(new), np.cumsum(new) - 1
            several = np.zeros(len(first), bool)
            several[group[text != text[first][group]]] = True
            hit = np.flatnonzero(several[group])
            rows = _to_homes(np.ascontiguousarray(keys[0]), np.ascontiguousarray(keys[1]), text[hit], _five_bytes(anchor[hit]).reshape(-1, 5), buckets)
            if rows:
                yield _batch(*zip(*rows, strict=True))

    return run


class Strings:
    """Strings under anchors: owner (row of a table of texts), place in it, and bytes."""

    def __init__(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, anchor: np.ndarray, data: np.ndarray, at: np.ndarray) -> None:
        self.text, self.start, self.size, self.anchor, self.data, self.at = text, start, size, anchor, data, at

    def take(self, which: np.ndarray) -> "Strings":
        return Strings(self.text[which], self.start[which], self.size[which], self.anchor[which], self.data, self.at[which])

    def gather(self) -> np.ndarray:
        """Their bytes, one after another."""
        return self.data[np.repeat(self.at - np.r_[0, np.cumsum(self.size)[:-1]], self.size) + np.arange(int(self.size.sum()))]


def _joined(parts: list[Strings]) -> Strings:
    """One table of strings from several, each of which holds its bytes in order."""
    size = np.concatenate([p.size for p in parts])
    return Strings(
        np.concatenate([p.text for p in parts]), np.concatenate([p.start for p in parts]), size,
        np.concatenate([p.anchor for p in parts]), np.concatenate([p.data for p in parts]), np.r_[0, np.cumsum(size)[:-1]],
    )


def by_anchor(s: Strings) -> Iterator[Strings]:
    """The strings in parts of about ``WORK_BYTES`` that hold all strings of their anchors."""
    order = np.argsort(s.anchor, kind="stable")
    anchor = s.anchor[order]
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(order) else np.empty(0, np.int64)
    before = np.r_[0, np.cumsum(s.size[order])]
    at = 0
    while at < len(order):
        i = int(np.searchsorted(before[first], before[at] + WORK_BYTES))
        i += i < len(first) and first[i] <= at
        to = int(first[i]) if i < len(first) else len(order)
        part = s.take(order[at:to])
        part.data = part.gather()
        part.at = np.r_[0, np.cumsum(part.size)[:-1]]
        yield part
        at = to


def _equal_strings(s: Strings, rank: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each string with the same anchor and bytes, and each class's smallest rank.

    Hashes sort the strings; each is then compared with the first of its class byte by byte,
    and one that differs gets a class of its own.
    """
    h = span_hash(q, s.at, s.at + s.size)
    order = np.lexsort((rank[s.text], s.size, h, s.anchor))
    o = s.take(order)
    ho = h[order]
    new = np.r_[True, (o.anchor[1:] != o.anchor[:-1]) | (ho[1:] != ho[:-1]) | (o.size[1:] != o.size[:-1])]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    odd = np.zeros(len(order), bool)
    for a in range(0, len(order), 100_000):
        x = o.take(np.arange(a, min(a + 100_000, len(order))))
        y = Strings(x.text, x.start, x.size, x.anchor, o.data, o.at[head[a : a + 100_000]])
        if len(x.size):
            differs = x.gather() != y.gather()
            odd[a : a + 100_000] = np.logical_or.reduceat(differs, np.r_[0, np.cumsum(x.size)[:-1]])
    new |= odd
    head = np.where(odd, np.arange(len(order)), head)
    cls = np.empty(len(order), np.int64)
    number = np.cumsum(new) - 1
    cls[order] = number[head]
    least = rank[o.text[np.flatnonzero(new)]]
    return cls, least


def common_extension(q: np.ndarray, a: np.ndarray, b: np.ndarray, length: int, known: int = 0) -> np.ndarray:
    """How many bytes from a and b on agree, up to ``length``: a binary search on prefix hashes.

    ``known`` bytes are equal already. The first probe is the whole length, as most suffixes
    that meet are equal or part soon.
    """
    un = powers(_UNBASE, len(q))
    out = np.full(len(a), length, np.int64)
    left = np.flatnonzero((q[a + length] - q[a]) * un[a] != (q[b + length] - q[b]) * un[b])
    a, b = a[left], b[left]
    ua, ub, qa, qb = un[a], un[b], q[a], q[b]
    low, high = np.full(len(a), known, np.int64), np.full(len(a), length - 1, np.int64)
    for _ in range(int(length - known).bit_length()):
        mid = (low + high + 1) >> 1
        same = (q[a + mid] - qa) * ua == (q[b + mid] - qb) * ub
        low = np.where(same, mid, low)
        high = np.where(same, high, np.maximum(mid - 1, low))
    out[left] = low
    return out


def suffix_sort(data: np.ndarray, q: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Order of suffixes by group (which rises) and their first ``length`` (8 or more) bytes: a mergesort.

    The first 8 bytes, as a number, part a group at once; suffixes that agree in them are merged.
    Runs double at each level. Every suffix finds its rank in the run that its own is merged
    with by binary search, all suffixes of a level at once. A comparison looks at the
    ``common_extension``.
    """
    n = len(at)
    if not n:
        return np.arange(n)
    key = np.zeros(n, U64)
    for j in range(8):
        key = (key << U64(8)) | data[at + j]
    parted = np.lexsort((key, group))
    at, key, group = at[parted], key[parted], group[parted]
    order = np.arange(n)
    begins = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
    size_of = np.diff(np.r_[begins, n])
    base, size = np.repeat(begins, size_of), np.repeat(size_of, size_of)
    within = np.arange(n) - base
    run = 1
    while run < size_of.max():
        number = within // run
        act = np.flatnonzero((number ^ 1) * run < size)
        is_left = (number[act] & 1) == 0
        begin = base[act] + (number[act] ^ 1) * run
        low, high = begin.copy(), np.minimum(begin + run, base[act] + size[act])
        place = at[order]
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            mine, other = place[act[open_]], place[mid]
            ext = common_extension(q, mine, other, length, 8)
            step = np.minimum(ext, length - 1)
            # among equals the left run's suffixes come first
            below = np.where(ext == length, ~is_left[open_], data[other + step] < data[mine + step])
            low[open_] = np.where(below, mid + 1, low[open_])
            high[open_] = np.where(below, high[open_], mid)
            open_ = open_[low[open_] < high[open_]]
        to = np.arange(n)
        to[act] = base[act] + (number[act] & ~1) * run + (within[act] - number[act] * run) + (low - begin)
        moved = np.empty_like(order)
        moved[to] = order
        order = moved
        run *= 2
    return parted[order]


def _met_again(q: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows at ``at``, in order, have a hash that another one of their group has too.

    Equal windows have equal hashes, so the others have no equal one and needn't be sorted.
    """
    h = mix((q[at + length] - q[at]) * powers(_UNBASE, len(q))[at]) + mix(group.astype(U64))
    order = np.argsort(h)
    h = h[order]
    same = h[1:] == h[:-1]
    return np.sort(order[np.r_[False, same] | np.r_[same, False]])


def repeated_windows(s: Strings, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, begin and end of the bytes to remove, among strings grouped by anchor.

    ``rank`` is the document id of each text.
    """
    none = np.empty(0, np.int64)
    if not len(s.size):
        return none, none, none
    q = prefix_hash(s.data)
    cls, least = _equal_strings(s, rank, q)
    later = rank[s.text] > least[cls]
    text, begin, end = [s.text[later]], [s.start[later]], [(s.start + s.size)[later]]
    # one string for each class, and only anchors with several of them
    _, lead = np.unique(cls, return_index=True)
    lead = lead[np.argsort(s.anchor[lead], kind="stable")]
    anchor = s.anchor[lead]
    new = np.r_[True, anchor[1:] != anchor[:-1]]
    group = np.cumsum(new) - 1
    several = np.bincount(group) > 1
    lead, group = lead[several[group]], group[several[group]]
    if len(lead):
        windows = s.size[lead] - length + 1
        owner = np.repeat(np.arange(len(lead)), windows)
        shift = np.arange(int(windows.sum())) - np.repeat(np.r_[0, np.cumsum(windows)[:-1]], windows)
        at = s.at[lead][owner] + shift
        again = _met_again(q, at, group[owner], length)
        at, owner, shift = at[again], owner[again], shift[again]
        order = suffix_sort(s.data, q, at, group[owner], length)
        at, owner, shift = at[order], owner[order], shift[order]
        same = np.zeros(len(at), bool)
        maybe = np.flatnonzero((common_extension(q, at[1:], at[:-1], length) == length) & (group[owner[1:]] == group[owner[:-1]])) + 1
        for a in range(0, len(maybe), 50_000):
            i = maybe[a : a + 50_000]
            reach = np.arange(length)
            same[i] = (s.data[at[i, None] + reach] == s.data[at[i - 1, None] + reach]).all(axis=1)
        number = np.cumsum(~same) - 1
        mine = least[cls[lead]][owner]
        first = np.minimum.reduceat(mine, np.flatnonzero(~same)) if len(at) else mine
        gone = mine > first[number]
        # these windows go from all texts that hold the string and are no later copies
        drop_of, drop_shift = owner[gone], shift[gone]
        if len(drop_of):
            back = np.full(len(least), -1)
            back[cls[lead]] = np.arange(len(lead))
            keepers = np.flatnonzero(~later & (back[cls] >= 0))
            keepers = keepers[np.argsort(back[cls[keepers]], kind="stable")]
            owner_of = back[cls[keepers]]
            by = np.argsort(drop_of, kind="stable")
            drop_of, drop_shift = drop_of[by], drop_shift[by]
            a, b = np.searchsorted(drop_of, owner_of), np.searchsorted(drop_of, owner_of, "right")
            many = b - a
            which = np.repeat(keepers, many)
            pick = np.repeat(a - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(int(many.sum()))
            p = s.start[which] + drop_shift[pick]
            text.append(s.text[which]), begin.append(p), end.append(p + length)
    return _merged(np.concatenate(text), np.concatenate(begin), np.concatenate(end))


def _pairs(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return np.stack([begin, end], axis=1).astype(np.int64).view(np.uint8)


def _merged(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of each text, in order."""
    if not len(text):
        return text, begin, end
    order = np.lexsort((begin, text))
    text, begin, end = text[order], begin[order], end[order]
    # ends run on within a text; a shift by text keeps texts apart
    far = int(end.max()) + 1
    number = np.cumsum(np.r_[0, text[1:] != text[:-1]])
    reach = np.maximum.accumulate(end + number * far)
    new = np.r_[True, (begin[1:] + number[1:] * far) > reach[:-1]]
    at = np.flatnonzero(new)
    stop = np.r_[at[1:], len(text)] - 1
    return text[at], begin[at], (reach - number * far)[stop]


def _send_strings(length: int, buckets: int):
    """Step 2: strings of windows under shared anchors, after the task has settled its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k1s: list[int] = []
        k2s: list[int] = []
        ranks: list[int] = []
        parts: list[Strings] = []
        held = texts = 0
        squeeze = zstandard.ZstdCompressor(level=1)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, texts
            if parts:
                k1, k2, rank = np.array(k1s, np.int64), np.array(k2s, np.int64), np.array(ranks, np.int64)
                s = _joined(parts)
                parts.clear()
                gone, own = [], []
                for x in by_anchor(s):
                    cls, least = _equal_strings(x, rank, prefix_hash(x.data))
                    later = rank[x.text] > least[cls]
                    gone.append((x.text[later], x.start[later], (x.start + x.size)[later]))
                    own.append(x.take(np.flatnonzero(~later)))
                    own[-1].data = own[-1].gather()
                text, begin, end = _merged(*(np.concatenate(z) for z in zip(*gone, strict=True)))
                rows = _to_homes(k1, k2, text, _pairs(begin, end), buckets, rank)
                s = _joined(own)
                own.clear()
                home = _home(s.anchor, buckets)
                order = np.argsort(home, kind="stable")
                s, home = s.take(order), home[order]
                cut = np.searchsorted(home, np.arange(buckets + 1))
                for i in range(buckets):
                    if cut[i] < cut[i + 1]:
                        x = s.take(np.arange(cut[i], cut[i + 1]))
                        t, local = np.unique(x.text, return_inverse=True)
                        raw = pack(k1[t], k2[t], rank[t], local.astype(np.int32), x.start.astype(np.int64), x.size.astype(np.int32), x.anchor, x.gather())
                        rows.append((i, None, squeeze.compress(raw)))
                if rows:
                    yield _batch(*zip(*rows, strict=True))
            k1s.clear(), k2s.clear(), ranks.clear(), parts.clear()
            held = texts = 0

        for block in blocks(batches):
            start, count, anchor, doc = window_anchors(block.data, block.off, length)
            shared = column(block.rows, "anchors").to_pylist()
            docs = len(shared)
            known = [_from_five_bytes(np.frombuffer(own, np.uint8)) for own in shared]
            pair = np.concatenate(known) if known else np.empty(0, U64)
            whose = np.repeat(np.arange(docs), [len(x) for x in known])
            # a text's anchors against those shared: compare within the text
            tag = lambda h, d: mix(h + d.astype(U64) * U64(0xD1B54A32D192ED03))
            hit = np.isin(tag(_short(anchor), doc), tag(pair, whose))
            start, count, anchor, doc = start[hit], count[hit], anchor[hit], doc[hit]
            if len(start):
                size = count + length - 1
                x = Strings(doc + texts, start - block.off[doc], size, anchor, block.data, start)
                x.data = x.gather()
                parts.append(x)
                held += len(x.data)
            k1s += column(block.rows, "k1").to_pylist()
            k2s += column(block.rows, "k2").to_pylist()
            ranks += column(block.rows, "doc_id").to_pylist()
            texts += docs
            if held >= FLUSH_BYTES:
                yield from flush()
        yield from flush()

    return run


def _resolve(length: int, buckets: int):
    """Step 3 in a bucket: spans to remove, for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        yield from _sort_rows(batches, held)
        grow = zstandard.ZstdDecompressor()
        for b in list(held):
            parts = [unpack(grow.decompress(x), np.int64, np.int64, np.int64, np.int32, np.int64, np.int32, U64, np.uint8) for x in held.pop(b)]
            k1, k2, rank = (np.concatenate([p[i] for p in parts]) for i in range(3))
            shift = np.r_[0, np.cumsum([len(p[0]) for p in parts])[:-1]]
            text = np.concatenate([p[3] + n for p, n in zip(parts, shift, strict=True)]).astype(np.int64)
            start, size, anchor, data = (np.concatenate([p[i] for p in parts]) for i in range(4, 8))
            parts.clear()
            size = size.astype(np.int64)
            s = Strings(text, start, size, anchor, data, np.r_[0, np.cumsum(size)[:-1]])
            found = [repeated_windows(x, rank, length) for x in by_anchor(s)]
            text, begin, end = _merged(*(np.concatenate(z) for z in zip(*found, strict=True)))
            rows = _to_homes(k1, k2, text, _pairs(begin, end), buckets, rank)
            if rows:
                yield _batch(*zip(*rows, strict=True))

    return run


def cut_spans(text: bytes, spans: bytes | None) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal runs of the packed spans and the text without them."""
    if not spans:
        return [], text
    pair = np.frombuffer(spans, np.int64).reshape(-1, 2)
    _, begin, end = _merged(np.zeros(len(pair), np.int64), pair[:, 0], pair[:, 1])
    kept, at = [], 0
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return list(zip(begin.tolist(), end.tolist(), strict=True)), b"".join(kept)


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _cut(texts: bool):
    """What is left of each text without its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            raw = memoryview(block.data)
            out = []
            for i, spans in enumerate(column(block.rows, "spans").to_pylist()):
                gone, kept = cut_spans(bytes(raw[block.off[i] : block.off[i + 1]]), spans)
                out.append(([{"begin": a, "end": b} for a, b in gone], sum(b - a for a, b in gone), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True))
            arrays = [column(block.rows, "k1"), column(block.rows, "k2"), pa.array(cols[0], _SPANS), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())]
            names = ["k1", "k2", "spans", "n_removed", "kept_sha256"]
            if texts:
                arrays.append(pa.array(cols[3], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def remove_repeats(docs: DataFrame, length: int = 50, texts: bool = False) -> DataFrame:
    """Per row ``doc_id, n_bytes, n_removed, spans, kept_sha256`` and, if asked for, ``kept`` bytes.

    ``spans`` are the maximal removed byte runs. Texts are their UTF-8 bytes; null counts as
    empty, and texts under ``length`` bytes lose nothing. Equal texts keep all bytes in the
    row with the smallest ``doc_id`` (in each such row, if it repeats). Rows that share a
    ``doc_id`` don't remove from one another. A row with a null ``doc_id`` keeps its text and
    takes none from others. Strings are judged on the input. Only ``doc_id`` and ``text`` are
    read.

    Texts of ``length`` bytes or more are exchanged once, by text and id, so copies of one text
    don't meet in a task; short ones aren't. A copy loses all of its text, which takes its key only.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).cast("binary")
    keyed = docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    whole = [F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole_sha256")]
    rows = stage_table(keyed.select("doc_id", "k1", "k2", *whole, *([F.col("text").alias("whole")] if texts else [])), "rows")
    sums = rows.agg(F.sum("n_bytes").alias("size"), F.count("*").alias("n")).first()
    size = sums["size"] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # an anchor of 5 bytes for about 15 bytes of text
    buckets = max(least, -(-size // (2 * BUCKET_BYTES)))
    parts = max(least, -(-size // TEXT_BYTES))
    named = keyed.where((F.octet_length("text") >= length) & F.col("doc_id").isNotNull())
    # the homes know the owner of each text, so what they gather joins without another exchange
    named_values = "k1 long, k2 long, doc_id long, found binary"
    own_type = F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")
    found = (
        named.select("doc_id", "k1", "k2", "text").mapInArrow(_anchor_blobs(length, buckets), _SCHEMA)
        .repartitionById(buckets, F.col("bucket"))
        .mapInArrow(_shared_anchors(buckets), _SCHEMA)
        .repartitionById(buckets, F.col("home"))
        .mapInArrow(_gather(True), named_values)
        .select("k1", "k2", own_type, F.col("found").alias("anchors"))
    )
    # the exchanges of all anchors are gone before the texts are exchanged
    found = stage_table(found, "anchors")
    key = ["k1", "k2"]
    groups = owners(rows.where(F.col("n_bytes") >= length), key)
    # both joins read the texts from this one exchange
    moved = named.repartition(parts, "k1", "k2", "doc_id")
    spans = (
        moved.join(found.hint("shuffle_hash"), [*key, "doc_id"])
        .select("doc_id", "k1", "k2", "text", "anchors")
        .mapInArrow(_send_strings(length, buckets), _SCHEMA)
        .repartitionById(buckets, F.col("bucket"))
        .mapInArrow(_resolve(length, buckets), _SCHEMA)
        .repartitionById(buckets, F.col("home"))
        .mapInArrow(_gather(False), named_values)
        .select("k1", "k2", own_type, F.col("found").alias("spans"))
    )
    schema = "k1 long, k2 long, spans array<struct<begin:long,end:long>>, n_removed long, kept_sha256 string"
    cut = (
        moved.join(spans.hint("shuffle_hash"), [*key, "doc_id"])
        .select(*key, "text", "spans")
        .mapInArrow(_cut(texts), schema + (", kept binary" if texts else ""))
        .dropDuplicates(key)
    )
    copies, others = split_hot_copies(rows, groups.where("n > 1"), key, sums["n"])
    verdicts = groups.join(cut, key, "left").where("n > 1 or n_removed is not null")
    judged = others.join(verdicts, key, "left").unionByName(copies, allowMissingColumns=True)
    own = F.col("doc_id") == F.col("owner")
    copy = F.coalesce(F.col("doc_id") > F.col("owner"), F.lit(False))
    mine = own & F.col("n_removed").isNotNull()
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end")))
    choose = lambda if_copy, if_cut, else_: F.when(copy, if_copy).when(mine, if_cut).otherwise(else_)
    result = [
        "doc_id", "n_bytes",
        choose(F.col("n_bytes"), F.col("n_removed"), F.lit(0).cast("long")).alias("n_removed"),
        choose(all_of_it, F.col("spans"), F.array().cast("array<struct<begin:long,end:long>>")).alias("spans"),
        choose(F.lit(hashlib.sha256(b"").hexdigest()), F.col("kept_sha256"), F.col("whole_sha256")).alias("kept_sha256"),
    ]
    if texts:
        result.append(choose(F.lit(b""), F.col("kept"), F.col("whole")).alias("kept"))
    return judged.select(*result)
