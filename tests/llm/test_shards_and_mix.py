from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillmark.llm.entropy_mix import mix_documents
from rillmark.llm.kk_shards import difference, shard_documents


@given(st.lists(st.integers(0, 1000), max_size=60), st.integers(1, 7))
@settings(max_examples=60, deadline=None)
def test_differencing_places_all_and_balances(sizes, k):
    placed = difference(sizes, k)
    assert len(placed) == len(sizes) and all(0 <= s < k for s in placed)
    sums = [0] * k
    for size, s in zip(sizes, placed, strict=True):
        sums[s] += size
    assert max(sums) - min(sums) <= max(sizes, default=0)


def test_differencing_by_hand():
    assert sorted(Counter(difference([8, 7, 6, 5, 4], 2)).values()) == [2, 3]
    sums = defaultdict(int)
    for size, s in zip([8, 7, 6, 5, 4], difference([8, 7, 6, 5, 4], 2), strict=True):
        sums[s] += size
    assert sorted(sums.values()) == [14, 16]


@pytest.mark.parametrize("carry", [(), ("text", "source")])
def test_shards(wide, rows, carry):
    got = [r.asDict() for r in shard_documents(wide, shards=4, carry=carry).collect()]
    key = lambda i, t: (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(key(r[0], r[1]) for r in rows)
    by_group, by_shard = defaultdict(set), defaultdict(list)
    for r in got:
        by_group[r["group_key"]].add(r["shard"])
        by_shard[r["shard"]].append(r)
    assert all(len(s) == 1 for s in by_group.values())
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in by_shard.values())
    sums = [sum(r["size"] for r in own) for own in by_shard.values()]
    # the one very long text is a shard of its own; the others agree
    assert max(sorted(sums)[:-1]) - min(sums) <= 0.02 * sum(sums)
    if carry:
        assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == Counter((r[0], r[1], r[3]) for r in rows)


def naive_differencing(sizes, k):
    """The two partitions of largest spread, found by looking at all; the earlier one among equals."""
    left = [(size, i, [(size, [i])] + [(0, [])] * (k - 1)) for i, size in enumerate(sizes)]
    born = len(left)
    while len(left) > 1:
        a, b = sorted(left, key=lambda p: (-p[0], p[1]))[:2]
        left.remove(a), left.remove(b)
        slots = sorted(((x + y, xs + ys) for (x, xs), (y, ys) in zip(a[2], b[2][::-1], strict=True)), key=lambda s: -s[0])
        left.append((slots[0][0] - slots[-1][0], born, slots))
        born += 1
    return {i: shard for _, _, slots in left for shard, (_, items) in enumerate(slots) for i in items}


@pytest.mark.parametrize(("shards", "cells"), [(4, 64), (3, 2)])
def test_shards_equal_naive_differencing(docs, shards, cells):
    got = shard_documents(docs, shards=shards, cells=cells)
    rows = got.selectExpr("group_key", "size", "shard", f"cast(pmod(xxhash64(group_key), {shards * cells}) as int) cell").collect()
    bytes_of = defaultdict(int)
    for r in rows:
        bytes_of[r.group_key] += r.size
    total = sum(bytes_of.values())
    large = sorted(g for g, n in bytes_of.items() if n * shards * cells > total)
    pooled = defaultdict(int)
    for g, cell in {(r.group_key, r.cell) for r in rows if r.group_key not in large}:
        pooled[cell] += bytes_of[g]
    placed = naive_differencing([bytes_of[g] for g in large] + [pooled[c] for c in sorted(pooled)], shards)
    at = {g: i for i, g in enumerate(large)} | {c: len(large) + i for i, c in enumerate(sorted(pooled))}
    assert all(r.shard == placed[at[r.group_key if r.group_key in at else r.cell]] for r in rows) and large and pooled


def test_null_and_empty_texts_are_two_groups(docs):
    got = {r.group_key for r in shard_documents(docs.where("text is null or text = ''"), shards=2).collect()}
    assert len(got) == 2


def test_no_rows(empty):
    assert shard_documents(empty).count() == 0
    assert mix_documents(empty).count() == 0


def targets(sizes: dict, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        budget = total - sum(most * sizes[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and budget * weight[s] / w > most * sizes[s]} if w else set()
        if not over:
            return {s: most * sizes[s] if s in capped else budget * weight[s] / w for s in order}
        capped |= over


def test_mix(wide, rows):
    import re

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = targets(sizes)
    got = mix_documents(wide).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r[0], r[3], size(r[1])) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3
        assert r.rate == pytest.approx(want[r.source] / sizes[r.source] if sizes[r.source] else 0, rel=1e-6)
        taken[r.source] += r.copies * r.size
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.03 * t, 60), (s, taken[s], t)
    again = mix_documents(wide.repartition(3)).collect()
    key = lambda rows_: Counter((r.doc_id, r.source, r.size, r.copies) for r in rows_)
    assert key(again) == key(got)


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 1}, {"a": 1, "b": 1000, None: 10}, {"a": 5}, {"a": 0, "b": 7}])
def test_targets_stop_at_three_times_a_source(spark, sizes):
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes.items())]
    got = {r.source: r.target for r in mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == pytest.approx(targets(sizes))
