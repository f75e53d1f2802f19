from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmark.llm import blocks, copies, partenum, suffix_dedup
from rillmark.llm.components import connected_components
from rillmark.llm.line_chunks import line_chunks, remove_repeated_chunks
from rillmark.llm.partenum import Signer, jaccard_components, linked_pairs
from rillmark.llm.suffix_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize(("percent", "n"), [(85, 4), (80, 5), (50, 2)])
def test_jaccard_join_equals_all_pairs(wide, rows, percent, n):
    sets = [(r[0], shingles(r[1], n)) for r in rows if r[0] is not None]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    want = components({d for d, _ in sets}, links)
    got = jaccard_components(wide, percent, n).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter([(d, len(s), want[d]) for d, s in sets] + [(None, 0, None)] * 2)


def test_one_id_with_several_texts_keeps_the_links_of_each(spark):
    rng = random.Random(5)
    one, two = ([f"{s}{rng.randrange(10**6)}" for _ in range(80)] for s in "ab")
    texts = [(7, one), (7, two), (3, two), (9, [*one[:-1], "end"]), (11, [f"c{i}" for i in range(80)])]
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in texts], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard_components(df).collect()} == {(3, 3), (7, 3), (9, 3), (11, 11)}


def test_repeated_ids_with_near_copies_equal_all_pairs(spark):
    """Few ids, each on rows with different texts, copies and near copies among them."""
    rng = random.Random(21)
    bases = [[f"{s}{rng.randrange(10**6)}" for _ in range(60)] for s in "abcdefghijklmnop"]
    rows = [(3, bases[0]), (7, bases[0]), (7, bases[1]), (9, [*bases[1], "end"])]
    for _ in range(40):
        own = list(rng.choice(bases[2:]))
        for _ in range(rng.randrange(3)):
            own[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        rows.append((rng.randrange(20, 40), own))
    sets = [(d, shingles(" ".join(t), 4)) for d, t in rows]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if 100 * len(x & y) >= 85 * len(x | y)]
    want = components({d for d, _ in sets}, links)
    assert want[9] == 3
    got = jaccard_components(spark.createDataFrame([(d, " ".join(t)) for d, t in rows], "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((d, want[d]) for d, _ in sets)


def test_groups_larger_than_a_block(docs, rows, monkeypatch):
    """Comparison in pairs of blocks gives the same components."""
    want = Counter(jaccard_components(docs).collect())
    monkeypatch.setattr(partenum, "BLOCK_FEATURES", 300)
    assert Counter(jaccard_components(docs).collect()) == want


def test_one_id_with_several_texts(spark):
    a, b = "a b c d e f g h", "q r s t u v w x"
    df = spark.createDataFrame([(5, a), (5, b), (7, a), (9, b), (11, "z")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard_components(df).collect()) == [(5, 5), (5, 5), (7, 5), (9, 5), (11, 11)]


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    signer = Signer(percent)
    checked = 0
    for _ in range(400):
        n = int(rng.integers(2, 120))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = a.copy()
        for i in rng.choice(n, int(rng.integers(0, max(1, n // 6) + 1)), replace=False):
            b[i] = rng.integers(0, 1 << 63)
        b = b[int(rng.integers(0, max(1, n // 10) + 1)) :]
        a, b = np.unique(a), np.unique(b)
        inter = len(np.intersect1d(a, b))
        if len(b) and inter < max(len(a), len(b)) and 100 * inter >= percent * (len(a) + len(b) - inter):
            checked += 1
            assert len(np.intersect1d(signer.sign(a), signer.sign(b)))
    assert checked > 10


def test_local_links_connect_what_is_linked():
    rng = random.Random(3)
    sets = [np.unique(np.array([rng.randrange(40) for _ in range(rng.randrange(1, 30))], np.uint64)) for _ in range(60)]
    pairs = [(i, j) for i in range(60) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))]
    got = linked_pairs(list(range(60)), sets, [0] * 60, 60)
    assert components(range(60), got) == components(range(60), pairs)
    side = [i % 2 for i in range(60)]
    across = [(i, j) for i, j in pairs if side[i] != side[j]]
    assert components(range(60), linked_pairs(list(range(60)), sets, side, 60)) == components(range(60), across)


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 120)] + [(7, 7), (200, 201), (201, 200), (300, 300), (None, 4)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{k: 100 for k in range(100, 120)}, 200: 200, 201: 200, 300: 300}


def removed(rows, length):
    """Per row the kept bytes and the number of removed runs, by comparing all windows."""
    first: dict[bytes, int] = {}
    for d, t in rows:
        raw = (t or "").encode()
        if d is not None:
            for i in range(len(raw) - length + 1):
                w = raw[i : i + length]
                first[w] = min(d, first.get(w, d))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        if d is not None:
            for i in range(len(raw) - length + 1):
                if first[raw[i : i + length]] < d:
                    gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((d, len(raw), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("length", [50, 24])
def test_repeats_equal_all_windows(wide, rows, length):
    got = remove_repeats(wide, length, texts=True).collect()
    mine = Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256, bytes(r.kept)) for r in got)
    assert mine == Counter(removed([(r[0], r[1]) for r in rows], length))


def test_repeats_in_small_pieces_of_work(docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "WORK_BYTES", 500)
    got = {(r.doc_id, r.kept_sha256) for r in remove_repeats(docs).collect()}
    assert got == {(d, sha) for d, _, _, _, sha, _ in removed([(r[0], r[1]) for r in rows], 50)}


def test_one_id_with_several_texts_removes_nothing_from_itself(spark):
    long = "the quick brown fox jumps over the lazy dog and runs away from it all"
    df = spark.createDataFrame([(5, long + "1"), (5, long + "2"), (9, "x" + long)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in remove_repeats(df).collect()) == [(5, 0), (5, 0), (9, len(long))]


@pytest.mark.parametrize("tasks", [1, 5])
def test_owners_that_come_after_their_copies(spark, tasks):
    rng = random.Random(tasks)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    shared = [" ".join(word() for _ in range(9)) for _ in range(4)]
    texts = [" ".join([word(), rng.choice(shared), word(), rng.choice(shared)]) for _ in range(8)]
    # ids fall along the rows, so the smallest id of a text is the last that a task meets
    rows = [(300 - 3 * i, rng.choice(texts)) for i in range(70)] + [(-7, texts[0]), (-9, texts[1][5:])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = Counter((r.doc_id, r.n_removed, len(r.spans), r.kept_sha256) for r in remove_repeats(df if tasks == 1 else df.repartition(tasks)).collect())
    assert got == Counter((d, gone, spans, sha) for d, _, gone, spans, sha, _ in removed(rows, 50))


def test_suffix_sort_is_an_order():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    at = rng.integers(0, 2900, 500)
    group = np.sort(rng.integers(0, 9, 500))
    q = blocks.prefix_hash(data)
    order = suffix_dedup.suffix_sort(data, q, at, group, 30)
    text = data.tobytes()
    keys = [(group[i], text[at[i] : at[i] + 30]) for i in order]
    assert keys == sorted(keys)
    ext = suffix_dedup.common_extension(q, at[:-1], at[1:], 30)
    for a, b, n in zip(at[:-1], at[1:], ext, strict=True):
        assert text[a : a + n] == text[b : b + n] and (n == 30 or text[a + n] != text[b + n])


def test_only_windows_that_are_met_again_are_sorted(monkeypatch):
    rng = random.Random(11)
    some = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    gram, passage = some(20), some(25)
    texts = [some(30) + gram + some(30) for _ in range(200)]
    texts += [edge * 5 + passage + gram + passage + edge * n for edge, n in ((b"1", 3), (b"2", 0), (b"3", 9))]
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.r_[0, np.cumsum(sizes)[:-1]]
    strings = suffix_dedup.Strings(np.arange(len(texts)), np.zeros(len(texts), np.int64), sizes, np.full(len(texts), 7, np.uint64), data, at)
    sorted_, sort = [], suffix_dedup.suffix_sort
    monkeypatch.setattr(suffix_dedup, "suffix_sort", lambda *a: sorted_.append(len(a[2])) or sort(*a))
    text, begin, end = suffix_dedup.repeated_windows(strings, np.arange(len(texts)), 50)
    assert list(zip(text.tolist(), begin.tolist(), end.tolist(), strict=True)) == [(201, 5, 75), (202, 5, 75)]
    assert sorted_ == [3 * 21]
    lone = strings.take(np.arange(200))
    assert not len(suffix_dedup.repeated_windows(lone, np.arange(len(texts)), 50)[0])


def test_line_chunks_move_only_near_a_change():
    rng = random.Random(11)
    lines = [f"line {rng.randrange(10**9)}" for _ in range(400)]
    cut = lambda text: {tuple(text.split("\n")[a : a + n]) for a, n in zip(*(x.tolist() for x in line_chunks(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[1:3]), strict=True)}
    before, after = cut("\n".join(lines)), cut("\n".join([*lines[:200], "new", *lines[200:]]))
    assert len(before - after) <= 2 and 50 < len(before) < 200


def test_line_chunks_equal_brute_force(wide, rows):
    order = lambda r: (r[0], r[1] is not None, r[1])
    seen: dict[tuple, tuple] = {}
    chunks_of = {}
    for _, t, *_ in rows:
        raw = (t or "").encode()
        _, line, n, _, _ = line_chunks(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert n.sum() == raw.count(b"\n") + 1
        chunks_of[t] = [(a, tuple(raw.split(b"\n")[a : a + k])) for a, k in zip(line.tolist(), n.tolist(), strict=True)]
    for d, t, *_ in sorted((r for r in rows if r[0] is not None), key=order):
        for a, c in chunks_of[t]:
            if len(c) > 1:
                seen.setdefault(c, (d, t, a))
    want = Counter()
    for d, t, *_ in rows:
        kept = [x for a, c in chunks_of[t] if d is None or len(c) < 2 or seen[c] == (d, t, a) for x in c]
        gone = sum(1 for a, c in chunks_of[t] if d is not None and len(c) > 1 and seen[c] != (d, t, a))
        want[d, gone, len(kept), b"\n".join(kept)] += 1
    got = remove_repeated_chunks(wide, texts=True).collect()
    assert Counter((r.doc_id, r.n_removed_chunks, r.n_kept_lines, bytes(r.kept)) for r in got) == want
    assert sum(r.n_removed_chunks for r in got) > 10


def kept_lines(rows):
    """Per row the kept lines, by all runs of two or more lines that stand earlier, and how many lines are in such runs."""
    order = sorted({(d, t or "") for d, t in rows if d is not None}, key=lambda r: (r[0], hash_of[r[1]]))
    first, kept, in_runs = {}, {}, 0
    for d, t in order:
        lines = t.split("\n")
        gone = set()
        for i in range(len(lines) - 1):
            e, u, j = first.setdefault((lines[i], lines[i + 1]), (d, t, i))
            if (e, u) != (d, t) or j + 2 <= i:
                gone |= {i, i + 1}
        in_runs += len(gone)
        kept[d, t] = [x for i, x in enumerate(lines) if i not in gone]
    return Counter((d, "\n".join(kept[d, t or ""] if d is not None else [t or ""])) for d, t in rows), in_runs


hash_of: dict[str, int] = {}


def test_all_repeated_runs_of_lines_go(spark, wide, rows):
    """Recall is held against runs of lines, not chunks: nothing that stands earlier may be left."""
    extra = [(900, "a\nb\nc\nd"), (901, "x1\na\nb\nx2"), (902, "y1\nb\nc\ny2\na\nb"), (903, "z\nz\nz"), (904, "q\nq\nq\nq\nq"), (905, "d\ne"), (905, "c\nd\nf")]
    own = [(r[0], r[1]) for r in rows] + extra
    df = wide.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    hash_of.update({r.t: r.k for r in df.select(F.coalesce("text", F.lit("")).alias("t")).distinct().withColumn("k", F.unhex(F.md5(F.col("t").cast("binary")))).collect()})
    want, in_runs = kept_lines(own)
    got = remove_repeated_chunks(df, texts=True, runs=True).collect()
    assert Counter((r.doc_id, bytes(r.kept).decode()) for r in got) == want
    by_id = {r.doc_id: bytes(r.kept).decode() for r in got}
    assert (by_id[901], by_id[902], by_id[903], by_id[904]) == ("x1\nx2", "y1\ny2", "z\nz\nz", "q\nq")
    assert sum(r.n_lines - r.n_kept_lines for r in remove_repeated_chunks(df).collect()) < in_runs
    before, after = ({x for d, t in table if d is not None for x in (t or "").split("\n")} for table in (own, [(r.doc_id, bytes(r.kept).decode()) for r in got]))
    assert before - after <= {""}


def test_lines_that_only_share_hashes_stay(spark, monkeypatch):
    from rillmark.llm import line_chunks as module

    rows = [(1, "a\nb"), (2, "a\nc"), (3, "b\nb\na\nb")]
    real = module.line_windows
    monkeypatch.setattr(module, "_seed_rows", lambda runs: _one_hash(real))
    got = remove_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string"), texts=True, runs=True).collect()
    assert {r.doc_id: bytes(r.kept) for r in got} == {1: b"a\nb", 2: b"a\nc", 3: b"b\nb"}


def _one_hash(windows):
    def run(batches):
        import pyarrow as pa

        for block in blocks.blocks(batches):
            doc, line, n, h1, _ = windows(block.data, block.off)
            ids, k = (blocks.column(block.rows, c).take(pa.array(doc)) for c in ("doc_id", "k"))
            yield pa.RecordBatch.from_arrays([ids, k, *(pa.array(c, pa.int64()) for c in (line, n, 0 * line, 0 * line))], ["doc_id", "k", "line", "n", "h1", "h2"])

    return run


@pytest.mark.parametrize("hot", [copies.HOT_ROWS, 0])
def test_ids_at_both_ends_and_copies_in_hot_groups(spark, docs, rows, monkeypatch, hot):
    monkeypatch.setattr(copies, "HOT_ROWS", hot)
    monkeypatch.setattr(copies, "HOT_GROUPS", 10_000 if hot else 1 << 40)
    text = "\n".join(f"the line number {i} of a text that has copies" for i in range(6))
    ends = [(-(2**63), text), (-5, text), (2**63 - 1, text), (2**63 - 1, "x\n" + text), (-5, None), (2**63 - 2, "")]
    own = [(r[0], r[1]) for r in rows] + ends
    df = docs.select("doc_id", "text").union(spark.createDataFrame(ends, "doc_id long, text string"))
    got = Counter((r.doc_id, r.n_removed, r.kept_sha256) for r in remove_repeats(df).collect())
    assert got == Counter((d, gone, sha) for d, _, gone, _, sha, _ in removed(own, 50))
    hash_of.update({r.t: r.k for r in df.select(F.coalesce("text", F.lit("")).alias("t")).distinct().withColumn("k", F.unhex(F.md5(F.col("t").cast("binary")))).collect()})
    want, _ = kept_lines(own)
    lines = Counter((r.doc_id, r.n_kept_bytes, r.kept_sha256) for r in remove_repeated_chunks(df, runs=True).collect())
    assert lines == Counter({(d, len(t.encode()), hashlib.sha256(t.encode()).hexdigest()): n for (d, t), n in want.items()})


def test_no_rows(empty):
    assert jaccard_components(empty).count() == 0
    assert remove_repeats(empty).count() == 0
    assert remove_repeated_chunks(empty).count() == 0


def test_only_nulls(docs):
    none = docs.where("text is null")
    assert {(r.n_shingles, r.component_id) for r in jaccard_components(none).collect()} == {(0, 0), (0, None)}
    assert {(r.n_bytes, r.n_removed) for r in remove_repeats(none).collect()} == {(0, 0)}
    assert {(r.n_lines, r.n_bytes) for r in remove_repeated_chunks(none).collect()} == {(1, 0)}


def test_blocks_cover_batches():
    import pyarrow as pa

    texts = ["abc", None, "", "é" * 50, "x"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]).slice(1)
    got = [bytes(b.data[b.off[i] : b.off[i + 1]]) for b in blocks.blocks(iter([batch]), most=10) for i in range(len(b.off) - 1)]
    assert got == [(t or "").encode() for t in texts[1:]]
    assert defaultdict is not None
