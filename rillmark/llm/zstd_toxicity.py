"""Toxicity by compression distance.

Zstandard dictionaries are trained apart on toxic and on ordinary text, from overlapping windows
of ``SAMPLE_WORDS`` words. A window to be judged, a word between its blanks, is compressed with
a toxic and with an ordinary dictionary; the ordinary length less the toxic one tells which of
them explains it better. What a single dictionary happens to hold blurs lengths in whole
bytes, so ``PAIRS`` pairs of dictionaries, each trained without one part of the sample, are
asked and their differences summed.

Differences become evidence by their frequency in toxic and in ordinary documents that the
dictionaries were not trained on. The evidence of a document is the sum over its windows, less
what as many windows of ordinary text have on average, so chance doesn't add up in a
long text; it is held against a threshold calibrated on the same documents.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from rillmark.llm.blocks import blocks, column

WORD = re.compile(r"\w+")
LEVEL = 3
PAIRS = 5
#: Bounds of the fit: labelled documents of each class, for the dictionaries and for calibration, and bytes of their texts.
FIT_DOCS = {1: 1_500, 0: 2_000}
CALIBRATION_DOCS = {1: 750, 0: 3_000}
FIT_BYTES = 64_000_000
ORDINARY_BYTES = 112_640
TOXIC_BYTES = 32_000
SAMPLE_WORDS = 8
#: A clean document that is flagged counts as much as this many toxic ones that are missed.
CLEAN_WEIGHT = 4.0
MOST_EVIDENCE = 4.0
#: Differences that are less than this many times likelier in toxic documents are no evidence.
LEAST_RATIO = 3.0
#: Stands at the end of every dictionary and of every window: zstandard stores what it can't shorten as it
#: is and looks for no match near the end, so without this a short word would have one length under all of them.
CARRIER = b"0123456789abcdef0123456789ABCDEF"
#: Words a task remembers.
MEMO = 300_000


class Model(NamedTuple):
    pairs: list[tuple[bytes, bytes]]  # ordinary and toxic dictionaries
    evidence: np.ndarray  # by difference in bytes, from -reach to reach
    threshold: float


def window(words: str) -> bytes:
    return f" {words} ".encode("utf-8", "surrogatepass")


def squeezers(pair: tuple[bytes, bytes]) -> list[zstandard.ZstdCompressor]:
    out = []
    for raw in pair:
        made = zstandard.ZstdCompressionDict(raw)
        made.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


class Differences(dict):
    """Ordinary less toxic compressed length of each word's window, summed over the pairs of dictionaries."""

    def __init__(self, pairs: list[tuple[bytes, bytes]]) -> None:
        super().__init__()
        self.pairs = [squeezers(p) for p in pairs]

    def learn(self, words: list[str]) -> None:
        """Compress the windows of words not met before."""
        total = np.zeros(len(words), np.int64)
        windows = [window(w) + CARRIER for w in words]
        for ordinary, toxic in self.pairs:
            total += _lengths(ordinary, windows) - _lengths(toxic, windows)
        self.update(zip(words, total.tolist(), strict=True))

    def of(self, texts: list[str | None]) -> list[Counter]:
        """How often each difference stands in each text."""
        if len(self) > MEMO:
            self.clear()
        found = [WORD.findall(t.lower()) if t else [] for t in texts]
        new = list({w for own in found for w in own if w not in self})
        if new:
            self.learn(new)
        return [Counter(map(self.__getitem__, own)) for own in found]


def _lengths(squeeze: zstandard.ZstdCompressor, windows: list[bytes]) -> np.ndarray:
    return np.fromiter((len(x) for x in squeeze.multi_compress_to_buffer(windows)), np.int64, len(windows))


def _evidence(seen: Counter, weights: np.ndarray) -> float:
    reach = len(weights) // 2
    return math.fsum(weights[min(max(d, -reach), reach) + reach] * n for d, n in seen.items())


def learn(docs: DataFrame, labels: DataFrame, seed: int = 1) -> Model | None:
    """Fit on rows of ``docs`` whose id ``labels`` (doc_id, toxic) marks; hand over the training fold only.

    A bounded sample of labelled rows, chosen by a hash of the id, is fitted on the driver:
    ``FIT_DOCS`` and ``CALIBRATION_DOCS`` of each class at most, whole texts, of ``FIT_BYTES`` bytes
    together (the first that are too much end it). An id with several labels is toxic if one
    says so; of rows that share an id the text least in byte order counts; null labels and texts are left out. Without documents of
    both classes there is no model.
    """
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    most = {c: FIT_DOCS[c] + CALIBRATION_DOCS[c] for c in (0, 1)}
    named = docs.where("text is not null and doc_id is not null").select("doc_id", "text")
    ids = named.select("doc_id", F.octet_length("text").alias("bytes")).join(marked, "doc_id")
    ids = ids.groupBy("doc_id", "toxic").agg(F.max("bytes").alias("bytes"))
    draw = F.xxhash64(F.lit(seed), "doc_id")
    chosen = {}
    for c in (1, 0):
        first = ids.where(F.col("toxic") == c).select("doc_id", "bytes", draw.alias("draw")).orderBy("draw", "doc_id").limit(most[c])
        upto = F.sum("bytes").over(Window.orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
        # one partition by intent: at most most[c] ids
        chosen[c] = first.withColumn("upto", upto).where(F.col("upto") <= FIT_BYTES // 2).orderBy("draw", "doc_id").collect()
    if not (chosen[0] and chosen[1]):
        return None
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(r["doc_id"], c, i) for c in (1, 0) for i, r in enumerate(chosen[c])], "doc_id long, toxic int, rank int")
    # the bounded sample is broadcast, so no text is shuffled to find it
    rows = named.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "toxic", "rank").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["toxic"], r["rank"]))
    own = {c: [r["text"] for r in rows if r["toxic"] == c] for c in (0, 1)}
    split = {c: max(1, len(own[c]) * FIT_DOCS[c] // most[c]) for c in (0, 1)}
    fit = {c: own[c][: split[c]] for c in (0, 1)}
    # where a class is so small that nothing is left over, calibration uses what was fitted
    rest = {c: own[c][split[c] :] or fit[c] for c in (0, 1)}
    return _fit(fit, rest, seed)


def samples(text: str) -> list[bytes]:
    """Overlapping windows of ``SAMPLE_WORDS`` words."""
    found = WORD.findall(text.lower())
    half = SAMPLE_WORDS // 2
    return [window(" ".join(found[i : i + SAMPLE_WORDS])) for i in range(0, max(1, len(found) - half), half)] if found else []


def _dictionary(texts: list[str], size: int, seed: int) -> bytes:
    pieces = [x for t in texts for x in samples(t)]
    random.Random(seed).shuffle(pieces)
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes() + CARRIER
    except zstandard.ZstdError:  # too little text to choose from: take all of it
        return b"".join(pieces)[:size] + CARRIER


def _fit(fit: dict[int, list[str]], rest: dict[int, list[str]], seed: int) -> Model:
    without = lambda texts, k: [t for i, t in enumerate(texts) if i % PAIRS != k] or texts
    pairs = [(_dictionary(without(fit[0], k), ORDINARY_BYTES, seed + k), _dictionary(without(fit[1], k), TOXIC_BYTES, seed + k)) for k in range(PAIRS)]
    differences = Differences(pairs)
    seen = {c: differences.of(rest[c]) for c in (0, 1)}
    weights = _weights(*(sum(seen[c], Counter()) for c in (0, 1)))
    found = {c: np.array([_evidence(x, weights) for x in seen[c]]) for c in (0, 1)}
    return Model(pairs, weights, _threshold(found[0], found[1]))


def _weights(ordinary: Counter, toxic: Counter) -> np.ndarray:
    """Log ratio of the frequencies of each difference; neighbouring differences lend weight to each other."""
    reach = 12 * PAIRS
    shares = []
    for seen in (ordinary, toxic):
        n = np.zeros(2 * reach + 1)
        for d, k in seen.items():
            n[min(max(d, -reach), reach) + reach] += k
        n = np.convolve(n, [0.25, 0.5, 0.25], "same")
        shares.append((n, max(n.sum(), 1.0)))
    (a, n_a), (b, n_b) = shares
    # half a window more in the toxic ones, and as large a share in the ordinary ones
    found = np.minimum(np.log((b + 0.5) / n_b / ((a + 0.5 * n_a / n_b) / n_a)), MOST_EVIDENCE)
    found[found < math.log(LEAST_RATIO)] = 0.0
    return found - float(found @ a) / n_a


def _threshold(ordinary: np.ndarray, toxic: np.ndarray) -> float:
    """Midway between the two values that part the classes with the largest weighted sum of both rates."""
    values = np.unique(np.r_[0.0, ordinary, toxic])
    if len(values) < 2:
        return 1.0
    cuts = (values[1:] + values[:-1]) / 2
    below, above = np.searchsorted(np.sort(ordinary), cuts), len(toxic) - np.searchsorted(np.sort(toxic), cuts)
    right = CLEAN_WEIGHT * below / len(ordinary) + above / len(toxic)
    return float(cuts[int(right.argmax())])


def score_of(evidence: float, threshold: float) -> float:
    """0 to 1, rising with the evidence, 0.5 at the threshold."""
    far = evidence - threshold
    return 0.5 + 0.5 * far / (1.0 + abs(far))


def score_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with a ``score`` from 0 to 1 added, 0.5 at the calibrated threshold.

    Only ``text`` is an input of the score. Null and empty texts, those without a word, and all
    texts if there is no model, score 0. Repeated rows score alike. Texts are read whole. A
    column of ``docs`` that is named ``score`` is replaced; all others are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        differences = Differences(model.pairs) if model else None
        for block in blocks(batches):
            texts = column(block.rows, "text").to_pylist()
            seen = differences.of(texts) if model else [Counter()] * len(texts)
            scores = [score_of(_evidence(x, model.evidence), model.threshold) if x else 0.0 for x in seen]
            yield pa.RecordBatch.from_arrays([*block.rows.columns, pa.array(scores, pa.float64())], [*names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("score", DoubleType()))
