"""Line deduplication by content-defined chunks, or by all runs of lines.

A text's lines are cut into chunks where a rolling hash over the hashes of the last ``ROLL``
lines meets a condition, so an inserted or deleted line moves boundaries only near it. A
chunk of ``LEAST_LINES`` or more lines that also stands earlier in the corpus (in a document
with a smaller id, or further up in its own) is removed, after its bytes were compared with
those of its first occurrence.

Chunks miss most runs that are shorter than the way from one boundary to the next. With
``runs`` the condition is left out: every window of ``LEAST_LINES`` lines is a seed. A run of
lines stands earlier if its windows do, so overlapping windows add up to all of it, from its
first line to its last, wherever chunks end.

Fingerprints are small rows, counted by grouped minima with partial sums. Only bytes of
repeated lines are shuffled, each line of a text once. Texts are exchanged once, for both joins
that read them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.blocks import U64, blocks, column, mix, prefix_hash, span_hash
from rillmark.llm.copies import owners, split_hot_copies
from rillmark.llm.scratch import stage_table

#: Lines that the rolling hash sees, and the lines between boundaries on average.
ROLL = 2
MEAN_LINES = 4
LEAST_LINES = 2
TEXT_BYTES = 24_000_000


class Lines(NamedTuple):
    """The lines of a block's texts, in order; an empty text has one empty line."""

    doc: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    last: np.ndarray  # whether a line is its text's last
    q: np.ndarray  # prefix hash of the block
    h: np.ndarray  # hash of each line


Spans = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _lines(data: np.ndarray, off: np.ndarray) -> Lines:
    docs = len(off) - 1
    cuts = np.flatnonzero(data == 10)
    begin = np.concatenate([off[:-1], cuts + 1])
    doc = np.concatenate([np.arange(docs), np.searchsorted(off, cuts, "right") - 1])
    order = np.lexsort((np.concatenate([np.zeros(docs, np.int64), np.ones(len(cuts), np.int64)]), begin, doc))
    begin, doc = begin[order], doc[order]
    last = np.r_[doc[1:] != doc[:-1], True] if len(doc) else np.empty(0, bool)
    end = np.where(last, off[doc + 1], np.r_[begin[1:] - 1, 0])
    q = prefix_hash(data)
    return Lines(doc, begin, end, last, q, span_hash(q, begin, end))


def _spans(lines: Lines, docs: int, at: np.ndarray, to: np.ndarray) -> Spans:
    """Document, first line in it, number of lines, and two hashes of the bytes of the lines from ``at`` to ``to``."""
    first_line = np.searchsorted(lines.doc, np.arange(docs))
    h1 = span_hash(lines.q, lines.begin[at], lines.end[to])
    sums = np.r_[U64(0), np.cumsum(mix(lines.h ^ U64(0xA24BAED4963EE407)))]
    h2 = mix(sums[to + 1] - sums[at] + (to - at).astype(U64))
    return lines.doc[at], at - first_line[lines.doc[at]], to - at + 1, h1, h2


def line_chunks(data: np.ndarray, off: np.ndarray) -> Spans:
    """Chunks of each text: document, first line in it, number of lines, and two hashes of the bytes.

    An empty text has one empty line. The end of a text always is a boundary.
    """
    lines = _lines(data, off)
    doc, h = lines.doc, lines.h
    rolling = np.zeros(len(h), U64)
    for j in range(ROLL):
        back = np.r_[np.zeros(j, U64), h[: len(h) - j]]
        # a line before the text's first counts as none
        own = np.r_[np.zeros(j, bool), doc[j:] == doc[: len(doc) - j]] if j else np.ones(len(doc), bool)
        rolling = rolling * U64(0x9FB21C651E98DF25) + np.where(own, back, U64(0))
    stop = lines.last | (mix(rolling) % U64(MEAN_LINES) == 0)
    at = np.flatnonzero(np.r_[True, stop[:-1]]) if len(stop) else np.empty(0, np.int64)
    return _spans(lines, len(off) - 1, at, np.flatnonzero(stop))


def line_windows(data: np.ndarray, off: np.ndarray) -> Spans:
    """Like ``line_chunks``, every window of ``LEAST_LINES`` lines of one text."""
    lines = _lines(data, off)
    count = max(0, len(lines.doc) - LEAST_LINES + 1)
    at = np.flatnonzero(lines.doc[:count] == lines.doc[len(lines.doc) - count :])
    return _spans(lines, len(off) - 1, at, at + LEAST_LINES - 1)


_KEY = pa.binary()


def _measure(texts: bool):
    """Per row what it has if no line goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            docs = len(block.valid)
            doc, _, n, _, _ = line_chunks(block.data, block.off)
            raw = memoryview(block.data)
            digests = [hashlib.sha256(raw[block.off[i] : block.off[i + 1]]).hexdigest() for i in range(docs)]
            lines = np.bincount(doc, n, docs).astype(np.int64)
            arrays = [column(block.rows, "doc_id"), column(block.rows, "k")]
            arrays += [pa.array(x, pa.int64()) for x in (lines, np.bincount(doc, minlength=docs), np.diff(block.off))]
            names = ["doc_id", "k", "n_lines", "n_chunks", "n_bytes", "whole_sha256"]
            arrays.append(pa.array(digests, pa.string()))
            if texts:
                arrays.append(column(block.rows, "text"))
                names.append("whole")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _seed_rows(runs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            doc, line, n, h1, h2 = (line_windows if runs else line_chunks)(block.data, block.off)
            m = n >= LEAST_LINES
            mine = pa.array(doc[m])
            cols = [pa.array(x[m], pa.int64()) for x in (line, n, h1.view(np.int64), h2.view(np.int64))]
            yield pa.RecordBatch.from_arrays([column(block.rows, "doc_id").take(mine), column(block.rows, "k").take(mine), *cols], ["doc_id", "k", "line", "n", "h1", "h2"])

    return run


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the listed lines of each text."""
    for block in blocks(batches):
        raw = memoryview(block.data)
        out = []
        ks, lists = (column(block.rows, c).to_pylist() for c in ("k", "listed"))
        for i, (k, listed) in enumerate(zip(ks, lists, strict=True)):
            lines = bytes(raw[block.off[i] : block.off[i + 1]]).split(b"\n")
            out += [(k, j, lines[j]) for j in listed]
        cols = list(zip(*out, strict=True)) if out else [[]] * 3
        types = [_KEY, pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["k", "line", "bytes"])


def _gone(k: bytes, owner: int | None, lines: list[bytes], marks: list[dict]) -> set[int]:
    """Lines of repeated seeds of a text in the document that owns it; for a copy, ``owner`` is None.

    The first occurrence stays, and what overlaps it in its own text.
    """
    gone: set[int] = set()
    differ = {(m["line"], m["first_k"], m["first_line"]) for m in marks if m["n"] is None}
    for m in marks:
        if m["n"] is None or ((owner, k) == (m["first_doc"], m["first_k"]) and m["line"] < m["first_line"] + LEAST_LINES):
            continue
        pairs = [(m["line"] + j, m["first_line"] + j) for j in range(m["n"])]
        # lines of one text are compared here, those of two were by the join
        if all(lines[a] == lines[b] if m["first_k"] == k else (a, m["first_k"], b) not in differ for a, b in pairs):
            gone.update(a for a, _ in pairs)
    return gone


def _cut(texts: bool):
    """What is left of each marked text: in the document that owns it, and in copies if there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            raw = memoryview(block.data)
            chunk_doc, chunk_line, chunk_n, _, _ = line_chunks(block.data, block.off)
            bounds = np.searchsorted(chunk_doc, np.arange(len(block.off)))
            out = []
            columns = (column(block.rows, c).to_pylist() for c in ("doc_id", "k", "n", "marks"))
            for i, (doc, k, rows, marks) in enumerate(zip(*columns, strict=True)):
                text = bytes(raw[block.off[i] : block.off[i + 1]])
                lines = text.split(b"\n")
                own = slice(bounds[i], bounds[i + 1])
                for copy in (False, True)[: 1 + (rows > 1)]:
                    drop = _gone(k, None if copy else doc, lines, marks)
                    kept = b"\n".join(x for j, x in enumerate(lines) if j not in drop) if drop else text
                    n_gone = sum(drop.issuperset(range(a, a + n)) for a, n in zip(chunk_line[own].tolist(), chunk_n[own].tolist(), strict=True)) if drop else 0
                    out.append((k, copy, len(lines) - len(drop), n_gone, len(kept), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            types = [_KEY, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["k", "copy", "n_kept_lines", "n_removed_chunks", "n_kept_bytes", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)][: 7 if texts else 6], names[: 7 if texts else 6])

    return run


def remove_repeated_chunks(docs: DataFrame, texts: bool = False, runs: bool = False) -> DataFrame:
    """Per row ``doc_id, n_lines, n_chunks, n_kept_lines, n_removed_chunks, n_bytes, n_kept_bytes, kept_sha256``.

    With ``texts`` also ``kept``, the bytes of the kept lines joined by line feeds. Texts are UTF-8
    bytes; null counts as empty, which is one empty line. A row with a null ``doc_id`` keeps
    its text and takes nothing from others. Rows that repeat both id and text are one document
    and get the same result; rows with one id and different texts are ordered by a digest of the
    text. Texts are read whole. Only ``doc_id`` and ``text`` are read.

    With ``runs`` all runs of ``LEAST_LINES`` or more lines that stand earlier are removed, not
    only whole chunks; each distinct line stays somewhere. ``n_removed_chunks`` counts the
    chunks of which no line is left.

    Texts of several lines are exchanged once, by text and id, so copies of one text don't meet
    in a task; a text is cut once for its owner and once for all its copies.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).cast("binary")
    keyed = docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.unhex(F.md5("text")).alias("k"))
    schema = "doc_id long, k binary, n_lines long, n_chunks long, n_bytes long, whole_sha256 string"
    rows = stage_table(keyed.mapInArrow(_measure(texts), schema + (", whole binary" if texts else "")), "rows")
    sums = rows.agg(F.sum("n_bytes").alias("size"), F.count("*").alias("n")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(sums["size"] or 0) // TEXT_BYTES))
    # a text of one line has no seed
    named = keyed.where(F.col("doc_id").isNotNull() & F.contains("text", F.lit(b"\n")))
    seeds = stage_table(named.mapInArrow(_seed_rows(runs), "doc_id long, k binary, line long, n long, h1 long, h2 long"), "seeds")
    place = F.struct("doc_id", "k", "line")
    same = ["h1", "h2"]
    repeated = (
        seeds.groupBy(*same).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
        .select(*same, F.col("first.doc_id").alias("first_doc"), F.col("first.k").alias("first_k"), F.col("first.line").alias("first_line"))
    )
    # equal texts have equal seeds, so from here on a text stands once, however many rows have it
    by_text = stage_table(seeds.select("k", "line", "n", *same).distinct().join(repeated, same).drop(*same), "repeated")
    # seeds overlap and so may share lines: each pair of lines is compared once
    pairs = (
        by_text.where("k <> first_k").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
        .select("k", (F.col("line") + F.col("j")).alias("line"), "first_k", (F.col("first_line") + F.col("j")).alias("first_line")).distinct()
    )
    pairs = stage_table(pairs, "pairs")
    groups = stage_table(owners(rows.where("n_lines > 1"), ["k"]), "owners")
    owned = groups.select("k", F.col("owner").alias("doc_id"), "n")
    needed = pairs.select("k", "line").union(pairs.select("first_k", "first_line")).distinct()
    wanted = needed.groupBy("k").agg(F.collect_list("line").alias("listed")).join(owned, "k").drop("n").hint("shuffle_hash")
    # both joins below share this exchange
    moved = named.repartition(parts, "k", "doc_id")
    pieces = moved.join(wanted, ["k", "doc_id"]).select("k", "text", "listed").mapInArrow(_extract, "k binary, line long, bytes binary")
    pieces = stage_table(pieces.dropDuplicates(["k", "line"]), "pieces")
    firsts = pieces.select(F.col("k").alias("first_k"), F.col("line").alias("first_line"), F.col("bytes").alias("first_bytes"))
    # byte comparison with the first occurrence; a seed that only shares the hashes stays
    differ = (
        pairs.join(pieces, ["k", "line"], "left").join(firsts, ["first_k", "first_line"], "left").where("not coalesce(bytes = first_bytes, false)")
        .select("k", "line", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("first_doc"), "first_k", "first_line")
    )
    marks = by_text.select(*differ.columns).union(differ)
    marks = marks.groupBy("k").agg(F.collect_list(F.struct("line", "n", "first_doc", "first_k", "first_line")).alias("marks")).join(owned, "k").hint("shuffle_hash")
    schema = "k binary, copy boolean, n_kept_lines long, n_removed_chunks long, n_kept_bytes long, kept_sha256 string"
    cut = (
        moved.join(marks, ["k", "doc_id"]).select("doc_id", "k", "n", "text", "marks")
        .mapInArrow(_cut(texts), schema + (", kept binary" if texts else ""))
        .dropDuplicates(["k", "copy"])
    )
    # without texts the verdicts are narrow, so those on copies in hot groups can be broadcast
    cut = cut if texts else stage_table(cut, "cut")
    verdicts = cut.join(groups, "k")
    of_copies = verdicts.where("copy").drop("copy")
    copies, others = split_hot_copies(rows, of_copies.limit(0) if texts else of_copies, ["k"], sums["n"])
    owner = groups.select("k", "owner")
    is_copy = F.coalesce(F.col("doc_id") > F.col("owner"), F.lit(False))
    tagged = others.join(cut.select("k").distinct().join(owner, "k"), "k", "left").withColumn("copy", is_copy)
    judged = tagged.join(cut, ["k", "copy"], "left").drop("owner", "copy").unionByName(copies.drop("owner", "n"))
    # a row without an id keeps all of its text, as does one without a mark
    marked = F.col("doc_id").isNotNull() & F.col("n_kept_lines").isNotNull()
    choose = lambda if_cut, else_: F.when(marked, F.col(if_cut)).otherwise(else_)
    result = [
        "doc_id", "n_lines", "n_chunks", choose("n_kept_lines", F.col("n_lines")).alias("n_kept_lines"),
        choose("n_removed_chunks", F.lit(0).cast("long")).alias("n_removed_chunks"), "n_bytes",
        choose("n_kept_bytes", F.col("n_bytes")).alias("n_kept_bytes"), choose("kept_sha256", F.col("whole_sha256")).alias("kept_sha256"),
    ]
    return judged.select(*result, *([choose("kept", F.col("whole")).alias("kept")] if texts else []))
