"""Quality rules by distribution divergence.

References are made from the corpus itself, for each language that it names: the histogram of
character classes, and that of common words, where a word is common in a language if it is
at least ``COMMON_SHARE`` of all its words (so there are at most ``1 / COMMON_SHARE``; all other
words share one bin). A document is compared with every reference by Jensen-Shannon
distance, and kept if some language is near in both histograms. Short documents scatter, so
the bound on the word distance widens with the square root of the length, and documents under
a least number of words are not judged by distance at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.blocks import SEPARATOR, U64, blocks, column, grams, mix, pack, per_document, prefix_hash, span_hash, unpack, words
from rillmark.llm.scratch import stage_table

COMMON_SHARE = 0.002
#: Documents under this many words are kept without a comparison.
GUARD_WORDS = 40
CLASS_BOUND = 0.25
WORD_BOUND = 0.15
#: Added to the bound on the word distance, divided by the root of the number of words.
SHORT_ALLOWANCE = 2.4
#: Bytes of text whose words one bucket counts, and words that it holds unmerged at least.
BUCKET_BYTES = 48_000_000
MERGE_WORDS = 1_000_000
REPEAT_WINDOW = 5
LEAST_WORDS = 10
REPEAT_PERCENT = 20

SYMBOLS = b"#*$%&|<>"
#: Classes of code points: other, separator, lower case, upper case, digit, symbol, punctuation, beyond ASCII.
N_CLASSES = 8
CLASS = np.zeros(256, np.uint8)
CLASS[SEPARATOR] = 1
CLASS[ord("a") : ord("z") + 1] = 2
CLASS[ord("A") : ord("Z") + 1] = 3
CLASS[ord("0") : ord("9") + 1] = 4
for _b in b"!\"'(),-./:;?@[\\]^_`{}~+=":
    CLASS[_b] = 6
for _b in SYMBOLS:
    CLASS[_b] = 5
CLASS[0xC0:] = 7
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True
_IS_SYMBOL = CLASS == 5


class References(NamedTuple):
    langs: list[str]
    classes: np.ndarray  # a row a language, sums to 1
    common: list[np.ndarray]  # sorted hashes of each language's common words
    shares: list[np.ndarray]  # their shares of all words, and that of the others last


def class_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Code points of each class, by document."""
    docs = len(off) - 1
    doc = np.repeat(np.arange(docs), np.diff(off))
    real = ~_CONTINUES[data]
    return np.bincount(doc[real] * N_CLASSES + CLASS[data[real]], minlength=docs * N_CLASSES).reshape(docs, N_CLASSES)


def _merge(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    return h[at], np.add.reduceat(n, at) if len(at) else n[:0]


def _count(buckets: int):
    """Words (as hashes) and character classes of each language in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        classes: dict[str, np.ndarray] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in list(kept):
                h, n = _merge(*(np.concatenate(x) for x in zip(*kept.pop(lang), strict=True)))
                home = (h >> U64(13)) % U64(buckets)
                order = np.argsort(home, kind="stable")
                cut = np.searchsorted(home[order], np.arange(buckets + 1, dtype=U64))
                full = np.flatnonzero(np.diff(cut))
                blobs = [pack(h[order[cut[i] : cut[i + 1]]], n[order[cut[i] : cut[i + 1]]]) for i in full]
                first = pa.array([classes.pop(lang).tolist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*(full[:1].tolist() or [0]), *full.tolist()], pa.int32()), pa.array([lang] * (1 + len(full)), pa.string()),
                        pa.array([None, *blobs], pa.binary()), pa.concat_arrays([first, pa.nulls(len(full), first.type)]),
                    ],
                    ["bucket", "lang", "counts", "classes"],
                )

        for block in blocks(batches):
            begin, end, doc = words(block.data, block.off)
            h = span_hash(prefix_hash(block.data), begin, end)
            per_class = class_counts(block.data, block.off)
            langs = np.array(column(block.rows, "lang").to_pylist(), object)
            for lang in set(langs.tolist()):
                mine = langs == lang
                classes[lang] = classes.get(lang, 0) + per_class[mine].sum(axis=0)
                one = _merge(h[mine[doc]], np.ones(int(mine[doc].sum()), np.int64))
                kept.setdefault(lang, []).append(one)
                held += len(one[0])
            if held > 3_000_000:
                yield from flush()
                held = 0
        yield from flush()

    return run


def _sum_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by language in a bucket. Words below the common share of the bucket alone can't be common.

    Parts are merged whenever they outgrow what is merged already, so a task holds about twice
    the distinct words of its bucket.
    """
    held: dict[tuple[int, str], list] = {}
    loose: dict[tuple[int, str], int] = {}
    classes: dict[str, np.ndarray] = {}
    for batch in batches:
        for b, lang, blob, cls in zip(*(column(batch, c).to_pylist() for c in ("bucket", "lang", "counts", "classes")), strict=True):
            if blob is not None:
                parts = held.setdefault((b, lang), [])
                parts.append(unpack(blob, U64, np.int64))
                loose[b, lang] = loose.get((b, lang), 0) + len(parts[-1][0])
                if loose[b, lang] > max(MERGE_WORDS, len(parts[0][0])):
                    parts[:] = [list(_merge(*(np.concatenate([p[i] for p in parts]) for i in (0, 1))))]
                    loose[b, lang] = 0
            if cls is not None:
                classes[lang] = classes.get(lang, 0) + np.array(cls)
    out = [(lang, None, 0, c.tolist()) for lang, c in classes.items()]
    for (_, lang), parts in held.items():
        h, n = _merge(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))
        total = int(n.sum())
        out.append((lang, None, total, None))
        big = n >= COMMON_SHARE * total
        out += [(lang, x, k, None) for x, k in zip(h[big].view(np.int64).tolist(), n[big].tolist(), strict=True)]
    cols = list(zip(*out, strict=True)) if out else [[]] * 4
    types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["lang", "word", "count", "classes"])


def references(docs: DataFrame) -> References:
    """Histograms of all rows with a text and a non-null ``lang``, counted over the whole corpus.

    What reaches the driver is the common words, at most ``1 / COMMON_SHARE`` a language, and
    a row of class counts a language.
    """
    docs = docs.where("lang is not null and text is not null").select("lang", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    counted = stage_table(
        docs.mapInArrow(_count(buckets), "bucket int, lang string, counts binary, classes array<long>")
        .repartitionById(buckets, F.col("bucket"))
        .mapInArrow(_sum_words, "lang string, word long, count long, classes array<long>"),
        "reference-counts",
    )
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(N_CLASSES)]
    per_lang = counted.groupBy("lang").agg(F.sum(F.when(F.col("word").isNull(), F.col("count"))).alias("total"), *sums)
    total = per_lang.select("lang", "total")
    common = (
        counted.where("word is not null").join(total, "lang").where(F.col("count") >= COMMON_SHARE * F.col("total"))
        .select("lang", "word", (F.col("count") / F.col("total")).alias("share")).collect()
    )
    rows = sorted((r for r in per_lang.collect() if r["total"]), key=lambda r: r["lang"].encode())
    hashes, shares = [], []
    for r in rows:
        own = sorted((np.int64(c["word"]).view(U64), c["share"]) for c in common if c["lang"] == r["lang"])
        hashes.append(np.array([h for h, _ in own], U64))
        p = np.array([s for _, s in own])
        shares.append(np.append(p, max(0.0, 1.0 - p.sum())))
    classes = np.array([[r[f"c{i}"] for i in range(N_CLASSES)] for r in rows], float).reshape(-1, N_CLASSES)
    return References([r["lang"] for r in rows], classes / np.maximum(classes.sum(axis=1, keepdims=True), 1), hashes, shares)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of ``p`` to the distribution ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=1)
    return np.sqrt(np.maximum((a + b) / 2, 0.0))


def _repeated_words(h: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Words within windows that occur twice or more in their document."""
    g, at = grams(h, doc, REPEAT_WINDOW)
    if not len(g):
        return np.zeros(docs, np.int64)
    own = doc[at]
    order = np.lexsort((g, own))
    gs, ds = g[order], own[order]
    like = (gs[1:] == gs[:-1]) & (ds[1:] == ds[:-1])
    twice = np.r_[False, like] | np.r_[like, False]
    begin = at[order[twice]]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + REPEAT_WINDOW, -1)
    inside = np.cumsum(cover[:-1]) > 0
    return np.bincount(doc[inside], minlength=docs)


def _repeated_lines(data: np.ndarray, off: np.ndarray, q: np.ndarray, word_at: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document."""
    docs = len(off) - 1
    cuts = np.flatnonzero(data == 10)
    own = np.searchsorted(off, cuts, "right") - 1
    begin = np.concatenate([off[:-1], cuts + 1])
    end = np.concatenate([off[1:], cuts])
    doc = np.concatenate([np.arange(docs), own])
    order = np.lexsort((begin, doc))
    begin, doc = begin[order], doc[order]
    # a line ends where the next begins, less the line feed, or where its document does
    last = np.r_[doc[1:] != doc[:-1], True]
    end = np.where(last, off[doc + 1], np.r_[begin[1:] - 1, 0])
    full = np.searchsorted(word_at, end) > np.searchsorted(word_at, begin)
    begin, end, doc = begin[full], end[full], doc[full]
    h = span_hash(q, begin, end)
    order = np.lexsort((h, doc))
    like = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][1:][like], minlength=docs)


def judge(docs: DataFrame, refs: References) -> DataFrame:
    """Base counts, distances and verdict of every row.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, nearest, class_distance, word_distance``. ``nearest`` is the language with the least
    sum of both distances; it and the distances are null where nothing was compared: under
    ``GUARD_WORDS`` words, or without references. A null or empty text has no words and fails
    the base rules. Repeated rows are judged alike. Texts are read whole. Only ``doc_id`` and
    ``text`` are read. Within a document, words, windows and lines are equal if their 64-bit
    hashes and lengths are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(refs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = shared.value
        for block in blocks(batches):
            data, off = block.data, block.off
            docs = len(off) - 1
            q = prefix_hash(data)
            begin, end, doc = words(data, off)
            h = span_hash(q, begin, end)
            n_words = np.bincount(doc, minlength=docs)
            doc_of = np.repeat(np.arange(docs), np.diff(off))
            in_word = ~SEPARATOR[data] & ~_CONTINUES[data]
            word_chars = np.bincount(doc_of[in_word], minlength=docs)
            n_symbols = np.bincount(doc_of[_IS_SYMBOL[data]], minlength=docs)
            n_dup = _repeated_lines(data, off, q, begin)
            n_repeat = _repeated_words(h, doc, docs)
            failed = (n_words < LEAST_WORDS) | (100 * n_repeat > REPEAT_PERCENT * n_words)
            classes = class_counts(data, off)
            classes = classes / np.maximum(classes.sum(axis=1, keepdims=True), 1)
            near, c_far, w_far = np.full(docs, -1), np.full(docs, np.inf), np.full(docs, np.inf)
            fits = np.zeros(docs, bool)
            bound = WORD_BOUND + SHORT_ALLOWANCE / np.sqrt(np.maximum(n_words, 1))
            for i, (common, share) in enumerate(zip(refs.common, refs.shares, strict=True)):
                k = len(common)
                at = np.searchsorted(common, h)
                at[(at == k) | (common[np.minimum(at, k - 1)] != h if k else True)] = k
                hist = np.bincount(doc * (k + 1) + at, minlength=docs * (k + 1)).reshape(docs, k + 1)
                w = js_distance(hist / np.maximum(n_words, 1)[:, None], share)
                c = js_distance(classes, refs.classes[i])
                fits |= (c <= CLASS_BOUND) & (w <= bound)
                nearer = c + w < c_far + w_far
                near[nearer], c_far[nearer], w_far[nearer] = i, c[nearer], w[nearer]
            judged = (n_words >= GUARD_WORDS) & bool(refs.langs)
            kept = ~failed & (fits | ~judged)
            yield pa.RecordBatch.from_arrays(
                [
                    column(block.rows, "doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, word_chars, n_symbols, n_dup, n_repeat)),
                    pa.array(failed), pa.array(kept),
                    pa.array([refs.langs[i] if j else None for i, j in zip(near, judged, strict=True)], pa.string()),
                    pa.array(c_far, pa.float64(), mask=~judged), pa.array(w_far, pa.float64(), mask=~judged),
                ],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "nearest", "class_distance", "word_distance"],
            )

    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, nearest string, class_distance double, word_distance double"
    )
    return docs.select("doc_id", "text").mapInArrow(run, schema)
