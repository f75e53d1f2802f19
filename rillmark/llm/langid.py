"""Language identification by word-first backoff.

A word that the model knows scores its log frequency in each language. An unseen word scores
the mean log frequency of its character n-grams of the longest order of which the model knows
any, from five letters down to one. The language with the largest sum wins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.llm.blocks import blocks, column
from rillmark.llm.scratch import stage_table

LETTERS = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
#: Bounds of the model: documents a language is learnt from, words and n-grams of an order kept for it, and
#: log frequencies in all, which keep fewer units of a language where there are more than 30.
DOCS_PER_LANG = 3_000
WORDS_PER_LANG = 20_000
GRAMS_PER_LANG = 10_000
MODEL_CELLS = 64_000_000
#: Floats of remembered scores in a task, and words that the confidence saturates at.
MEMO = 800_000
SURE_WORDS = 20
UNKNOWN = "und"


class Model(NamedTuple):
    """Languages, and log frequencies by word and by n-gram, a row each."""

    langs: list[str]
    words: list[str]
    word_logs: np.ndarray
    grams: dict[int, list[str]]
    gram_logs: dict[int, np.ndarray]


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that nothing is learnt from; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _counted(rows: Counter, names: tuple[str, ...]) -> pa.RecordBatch:
    keys = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int32()), pa.array(keys[2], pa.string()), pa.array(list(rows.values()), pa.int64())],
        list(names),
    )


_COUNTS = ("lang", "n", "unit", "count")
_COUNTS_SCHEMA = "lang string, n int, unit string, count long"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks([batch]):
            seen: Counter = Counter()
            for lang, text in zip(column(block.rows, "lang").to_pylist(), column(block.rows, "text").to_pylist(), strict=True):
                for word, n in Counter(LETTERS.findall(text.lower())).items():
                    seen[lang, 0, word] += n
            yield _counted(seen, _COUNTS)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter = Counter()
        for lang, word, n in zip(*(column(batch, c).to_pylist() for c in ("lang", "unit", "count")), strict=True):
            marked = f"_{word}_"
            for order in ORDERS:
                for i in range(len(marked) - order + 1):
                    seen[lang, order, marked[i : i + order]] += n
        yield _counted(seen, _COUNTS)


def units_kept(langs: int) -> tuple[int, int]:
    """Words, and n-grams of an order, that each of so many languages keeps: one at least."""
    share = min(1.0, MODEL_CELLS / (langs * langs * (WORDS_PER_LANG + len(ORDERS) * GRAMS_PER_LANG)))
    return max(1, int(WORDS_PER_LANG * share)), max(1, int(GRAMS_PER_LANG * share))


def learn(docs: DataFrame) -> Model:
    """Fit a model on rows with a text and a non-null ``lang``; hand over the training fold only.

    Fitted on about ``DOCS_PER_LANG`` documents at most of every labelled language, chosen by a
    hash of the id: a bounded sample of labelled rows. Its counts are made by distributed
    grouped sums, and the model has at most ``WORDS_PER_LANG`` words and ``GRAMS_PER_LANG``
    n-grams of each order a language, fewer if all would be over ``MODEL_CELLS`` numbers
    (``units_kept``). Ties in frequency break by code point. Without labelled rows the model has
    no language.
    """
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    sizes = labelled.groupBy("lang").count().collect()
    if not sizes:
        return Model([], [], np.empty((0, 0)), {}, {})
    n_words, n_grams = units_kept(len(sizes))
    # a row for each language, however many documents there are
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, DOCS_PER_LANG / r["count"])) for r in sizes], "lang string, share double")
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("lang", "text")
    add = lambda df: df.groupBy("lang", "n", "unit").agg(F.sum("count").alias("count"))
    words = stage_table(add(sample.mapInArrow(_count_words, _COUNTS_SCHEMA)), "words")
    grams = stage_table(add(words.mapInArrow(_count_grams, _COUNTS_SCHEMA)), "grams")
    both = words.union(grams)
    rank = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("count"), "unit"))
    keep = F.when(F.col("n") == 0, n_words).otherwise(n_grams)
    units = stage_table(both.withColumn("rank", rank).where(F.col("rank") <= keep).select("n", "unit").distinct(), "units")
    kept = both.join(units, ["n", "unit"]).orderBy("n", "unit", "lang").select("lang", "n", "unit", "count").toArrow()
    totals = {(r["lang"], r["n"]): (r["total"], r["kinds"]) for r in both.groupBy("lang", "n").agg(F.sum("count").alias("total"), F.count("*").alias("kinds")).collect()}
    langs = sorted({lang for lang, _ in totals}, key=lambda x: x.encode())
    return _assemble(langs, kept, totals)


def _assemble(langs: list[str], kept: pa.Table, totals: dict) -> Model:
    names: dict[int, list[str]] = {n: [] for n in (0, *ORDERS)}
    logs: dict[int, list[np.ndarray]] = {n: [] for n in (0, *ORDERS)}
    at = {lang: i for i, lang in enumerate(langs)}
    for lang, n, unit, count in zip(*(c.to_pylist() for c in kept.columns), strict=True):
        if not names[n] or names[n][-1] != unit:
            names[n].append(unit)
            logs[n].append(np.full(len(langs), 0.5))
        logs[n][-1][at[lang]] += count
    out = {}
    for n in (0, *ORDERS):
        floor = np.array([sum(totals.get((lang, n), (0, 0))) + 1.0 for lang in langs])
        out[n] = np.log(np.array(logs[n]).reshape(-1, len(langs)) / floor).astype(np.float32)
    return Model(langs, names[0], out[0], {n: names[n] for n in ORDERS}, {n: out[n] for n in ORDERS})


class Scores(dict):
    """Row of the score matrix of each word; unseen words are scored once by backoff and remembered."""

    def __init__(self, model: Model) -> None:
        super().__init__(zip(model.words, range(len(model.words)), strict=True))
        self.model, self.known = model, len(model.words)
        self.room = max(1_000, MEMO // max(1, len(model.langs)))
        self.rows = np.zeros((self.known + self.room, len(model.langs)), np.float32)
        self.rows[: self.known] = model.word_logs
        self.used = self.known
        self.new: list[str] = []
        self.grams = {n: dict(zip(model.grams[n], range(len(model.grams[n])), strict=True)) for n in ORDERS if n in model.grams}

    def __missing__(self, word: str) -> int:
        if self.used == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows[: self.room])])
        at = self.used
        self.rows[at] = self.backoff(word)
        self[word] = at
        self.new.append(word)
        self.used += 1
        return at

    def forget(self) -> None:
        """Drop remembered words beyond the memory that a task may use; call between documents."""
        if self.used - self.known >= self.room:
            for word in self.new:
                del self[word]
            self.new.clear()
            self.rows = self.rows[: self.known + self.room]
            self.used = self.known

    def backoff(self, word: str) -> np.ndarray:
        marked = f"_{word}_"
        for n in ORDERS:
            table = self.grams.get(n, {})
            hits = [j for i in range(len(marked) - n + 1) if (j := table.get(marked[i : i + n])) is not None]
            if hits:
                return self.model.gram_logs[n][hits].mean(axis=0)
        return np.zeros(len(self.model.langs), np.float32)

    def identify(self, text: str | None) -> tuple[str, float]:
        found = LETTERS.findall(text.lower()) if text else []
        if not found or not self.model.langs:
            return UNKNOWN, 0.0
        total = self.rows_of(found).sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        gap = (total - total[best]) * (min(len(found), SURE_WORDS) / len(found))
        return self.model.langs[best], float(1.0 / np.exp(gap).sum())

    def rows_of(self, found: list[str]) -> np.ndarray:
        ids = list(map(self.__getitem__, found))
        return self.rows[ids]


def identify_languages(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) added; all its columns are kept.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if the
    model has no language. Ties go to the first language by code point. Texts are read whole.
    Columns of ``docs`` with these two names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(shared.value)
        for block in blocks(batches):
            found = []
            for text in column(block.rows, "text").to_pylist():
                found.append(scores.identify(text))
                scores.forget()
            yield pa.RecordBatch.from_arrays(
                [*block.rows.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                [*names, "lang_pred", "score"],
            )

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.mapInArrow(run, schema)
