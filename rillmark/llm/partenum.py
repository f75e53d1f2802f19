"""Exact n-gram Jaccard join through PartEnum signatures.

Sets of shingles are joined if their Jaccard similarity reaches a threshold. Set sizes are
cut into bands such that linked sets lie in one band or in neighbours; each pair of
neighbouring bands has a bound ``k`` on the symmetric difference of linked sets. There the
feature domain is cut into ``n1`` partitions of three parts each, with ``2 * n1 > k``, so
linked sets have a partition with one difference at most, and two of its three parts agree:
enumerating the three pairs of parts gives a signature that linked sets share. Nothing is
missed, and parts that hold few features are skipped only where the counts prove that a
richer shared signature exists.

The exact check: all documents that share signatures with a common smallest document meet,
in blocks of bounded size, and their sets are compared by an inverted index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.blocks import LOWER, U64, blocks, column, grams, mix, pack, per_document, prefix_hash, release, span_hash, unpack, words
from rillmark.llm.components import connected_components
from rillmark.llm.scratch import stage_table

#: Partitions above the least number that the bound needs; more of them leave richer signatures to rely on.
SLACK = 1.25
#: Bytes of text whose signatures one bucket should hold, and features that one block of an exact check may.
BUCKET_BYTES = 8_000_000
BLOCK_FEATURES = 1_000_000


def bands(most: int, percent: int) -> list[int]:
    """Sizes at which bands begin: linked sets lie in the same band or in neighbours."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(edges[-1] * 100 // percent + 1)
    return edges


def difference_bound(largest: int, percent: int) -> int:
    """Most elements by which linked sets of up to ``largest`` elements can differ."""
    return 2 * largest * (100 - percent) // (100 + percent)


class Signer:
    """Signatures of sets, which come as sorted arrays of 64-bit features."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.edges = bands(1, percent)
        self.cuts: dict[int, np.ndarray] = {}

    def _instance(self, i: int) -> tuple[int, int, np.ndarray]:
        """Bound, number of partitions and the cuts of the domain for bands i and i + 1."""
        while len(self.edges) < i + 3:
            self.edges.append(self.edges[-1] * 100 // self.percent + 1)
        k = difference_bound(self.edges[i + 2] - 1, self.percent)
        n1 = max(k // 2 + 1, int(SLACK * (k + 1) / 2))
        if i not in self.cuts:
            self.cuts[i] = np.array([(j << 64) // (3 * n1) for j in range(1, 3 * n1)], U64)
        return k, n1, self.cuts[i]

    def sign(self, features: np.ndarray) -> np.ndarray:
        n = len(features)
        band = 0
        while len(self.edges) <= band + 1 or self.edges[band + 1] <= n:
            self._instance(band)
            band += 1
        sums = np.zeros(n + 1, U64)
        np.cumsum(mix(features), out=sums[1:])
        found = []
        for i in (band - 1, band):
            if i < 0:
                continue
            k, n1, cuts = self._instance(i)
            if not k:
                continue  # linked sets are equal here, and equal sets are one class already
            at = np.empty(3 * n1 + 1, np.int64)
            at[0], at[-1] = 0, n
            at[1:-1] = np.searchsorted(features, cuts)
            part = (sums[at[1:]] - sums[at[:-1]]).reshape(n1, 3)
            count = np.diff(at).reshape(n1, 3)
            pairs = count[:, [0, 0, 1]] + count[:, [1, 2, 2]]
            # of n1 partitions, n1 - k // 2 have one difference at most; so many can't all be among the poorest
            sure = n1 - k // 2
            least = np.partition(pairs.min(axis=1), sure - 1)[sure - 1]
            which = np.arange(3 * n1, dtype=U64).reshape(n1, 3) + U64(i << 40)
            h = mix(part[:, [0, 0, 1]] * U64(0xA24BAED4963EE407) + mix(part[:, [1, 2, 2]] + which * U64(0x9FB21C651E98DF25)))
            found.append(h[pairs >= least])
        return np.concatenate(found) if found else np.empty(0, U64)


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; the whole sequence where it has fewer words."""
    data = LOWER[data]
    q = prefix_hash(data)
    begin, end, doc = words(data, off)
    h = span_hash(q, begin, end)
    g, at = grams(h, doc, n)
    docs = len(off) - 1
    of_word, of_gram = per_document(doc, docs), per_document(doc[at], docs)
    out = []
    for d in range(docs):
        a, b = of_gram[d], of_gram[d + 1]
        if a < b:
            out.append(np.unique(g[a:b]))
        elif of_word[d] < of_word[d + 1]:
            few = h[of_word[d] : of_word[d + 1]]
            whole = U64(len(few))
            for x in few:
                whole = (mix(np.array([whole ^ x])) * U64(0xD6E8FEB86659FD93))[0]
            out.append(np.array([whole], U64))
        else:
            out.append(np.empty(0, U64))
    return out


def _fingerprint(features: np.ndarray) -> tuple[int, int]:
    one = mix(features).sum(dtype=U64)
    two = mix(features ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)
    return int(one), int(two)


def _signature_blobs(percent: int, shingle: int, buckets: int):
    """Per task: sets of its documents by bucket, and signatures of its distinct sets by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(percent)
        seen: set[tuple[int, int]] = set()
        sets: list[tuple[int, int, int, int]] = []
        owners: list[int] = []
        signatures: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows: dict[int, list[bytes]] = {}
            if sets:
                doc, n, one, two = (np.array(x, t) for x, t in zip(zip(*sets, strict=True), (np.int64, np.int64, U64, U64), strict=True))
                home = (one % U64(buckets)).astype(np.int64)
                for b in np.unique(home):
                    m = home == b
                    rows.setdefault(int(b), [b"", b""])[0] = pack(doc[m], n[m], one[m], two[m])
            if signatures:
                every = np.concatenate(signatures)
                owner = np.repeat(np.array(owners, np.int64), [len(s) for s in signatures])
                home = (every >> U64(20)) % U64(buckets)
                order = np.argsort(home, kind="stable")
                cut = np.searchsorted(home[order], np.arange(buckets + 1, dtype=U64))
                for b in range(buckets):
                    m = order[cut[b] : cut[b + 1]]
                    if len(m):
                        own = owner[m]
                        turn = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                        run_length = np.diff(np.r_[turn, len(own)]).astype(np.int32)
                        rows.setdefault(b, [b"", b""])[1] = pack(own[turn], run_length, every[m])
            sets.clear(), owners.clear(), signatures.clear()
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int32()), pa.array([r[0] for r in rows.values()], pa.binary()), pa.array([r[1] for r in rows.values()], pa.binary())],
                    ["bucket", "sets", "signatures"],
                )

        for block in blocks(batches):
            ids = column(block.rows, "doc_id").to_pylist()
            for doc, features in zip(ids, shingle_sets(block.data, block.off, shingle), strict=True):
                if doc is None:
                    continue
                print_ = _fingerprint(features)
                sets.append((doc, len(features), *print_))
                if len(features) and print_ not in seen:
                    seen.add(print_)
                    owners.append(doc)
                    signatures.append(signer.sign(features))
                    held += len(signatures[-1])
            if held > 1_500_000:
                yield from flush()
                held = 0
        yield from flush()

    return run


def _meet(buckets: int):
    """Of each bucket: classes of equal sets, and who shares a signature with which smallest document.

    The latter pairs arise again in many buckets, so they leave packed, by home of the smallest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[bytes], list[bytes]]] = {}
        for batch in batches:
            for b, s, g in zip(*(column(batch, c).to_pylist() for c in ("bucket", "sets", "signatures")), strict=True):
                own = held.setdefault(b, ([], []))
                if s:
                    own[0].append(s)
                if g:
                    own[1].append(g)
        for b in list(held):
            sets, sigs = held.pop(b)
            release()
            if sets:
                doc, n, one, two = (np.concatenate(x) for x in zip(*(unpack(s, np.int64, np.int64, U64, U64) for s in sets), strict=True))
                order = np.lexsort((doc, two, one))
                doc, n, one, two = doc[order], n[order], one[order], two[order]
                new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
                smallest = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
                yield _rows(doc, n, np.where(n > 0, smallest, doc), [], [])
            if sigs:
                parts = [unpack(g, np.int64, np.int32, U64) for g in sigs]
                sigs.clear()
                owner = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
                sig = np.concatenate([p[2] for p in parts])
                parts.clear()
                order = np.lexsort((owner, sig))
                owner, sig = owner[order], sig[order]
                new = np.r_[True, sig[1:] != sig[:-1]]
                hub = owner[np.flatnonzero(new)][np.cumsum(new) - 1]
                met = np.flatnonzero(hub != owner)
                if len(met):
                    hub, owner = _unique_pairs(hub[met], owner[met])
                    home = (mix(hub.view(U64)) % U64(buckets)).astype(np.int64)
                    order = np.argsort(home, kind="stable")
                    hub, owner, home = hub[order], owner[order], home[order]
                    cut = np.searchsorted(home, np.arange(buckets + 1))
                    full = np.flatnonzero(np.diff(cut))
                    none = np.empty(0, np.int64)
                    yield _rows(none, none, none, full.tolist(), [pack(hub[cut[i] : cut[i + 1]], owner[cut[i] : cut[i + 1]]) for i in full])

    return run


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    once = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    return a[once], b[once]


def _rows(doc: np.ndarray, n: np.ndarray, smallest: np.ndarray, home: list[int], pairs: list[bytes]) -> pa.RecordBatch:
    a, b = len(doc), len(home)
    cols = [pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(b, pa.int64())]) for x in (doc, n, smallest)]
    cols.append(pa.concat_arrays([pa.nulls(a, pa.int32()), pa.array(home, pa.int32())]))
    cols.append(pa.concat_arrays([pa.nulls(a, pa.binary()), pa.array(pairs, pa.binary())]))
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "class_id", "home", "pairs"])


def _distinct_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of a home, each once."""
    held: dict[int, list[list[np.ndarray]]] = {}
    for batch in batches:
        for home, blob in zip(column(batch, "home").to_pylist(), column(batch, "pairs").to_pylist(), strict=True):
            held.setdefault(home, []).append(unpack(blob, np.int64, np.int64))
    for parts in held.values():
        hub, member = _unique_pairs(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(hub), pa.array(member)], ["hub", "member"])


def _send_sets(shingle: int):
    """The set of each document, once for each place in which it is compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            ids, places = column(block.rows, "doc_id").to_pylist(), column(block.rows, "places").to_pylist()
            out: list[tuple[int, int, int, int, int, bytes]] = []
            for doc, where, features in zip(ids, places, shingle_sets(block.data, block.off, shingle), strict=True):
                blob = features.tobytes()
                out += [(p["hub"], p["left"], p["right"], p["own"], doc, blob) for p in where]
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["hub", "left", "right", "own", "doc_id", "features"])

    return run


def linked_pairs(docs: list[int], sets: list[np.ndarray], side: list[int], percent: int) -> list[tuple[int, int]]:
    """Links among the sets, enough of them to connect all that are linked.

    ``side`` is the block of each set; where there are two blocks only links across them are
    looked for. An inverted index counts each set's intersections with all later ones.
    """
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size, sets, docs, side = size[order], [sets[i] for i in order], [docs[i] for i in order], np.array(side)[order]
    features, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    by = np.argsort(features, kind="stable")
    post, sorted_f = owner[by].astype(np.int32), features[by]
    first = np.flatnonzero(np.r_[True, sorted_f[1:] != sorted_f[:-1]])
    stop = np.r_[first[1:], len(sorted_f)]
    rank = np.empty(len(features), np.int64)
    rank[by] = np.arange(len(features))
    run_of = np.searchsorted(first, rank, "right") - 1
    across = len(np.unique(side)) > 1
    root = np.arange(len(sets))
    links, at = [], 0
    for x, n in enumerate(size):
        own, mine = run_of[at : at + n], rank[at : at + n] + 1
        at += n
        left = stop[own] - mine  # postings stand in the order of sets, so these are all later ones
        total = int(left.sum())
        if not total:
            continue
        start = np.repeat(mine - np.r_[0, np.cumsum(left)[:-1]], left)
        counts = np.bincount(post[start + np.arange(total)], minlength=len(sets))
        later = np.flatnonzero(counts)
        inter = counts[later]
        ok = (100 * inter >= percent * (n + size[later] - inter)) & (root[later] != root[x])
        if across:
            ok &= side[later] != side[x]
        for y in later[ok]:
            if root[y] != root[x]:
                root[root == root[y]] = root[x]
                links.append((docs[x], docs[y]))
    return links


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, docs, sets, side = None, [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(docs) > 1 and (place[1] == place[2] or len(set(side)) > 1):
                found = linked_pairs(docs, sets, side, percent)
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            docs.clear(), sets.clear(), side.clear()

        for batch in batches:
            for hub, left, right, own, doc, blob in zip(*(column(batch, c).to_pylist() for c in ("hub", "left", "right", "own", "doc_id", "features")), strict=True):
                if (hub, left, right) != place:
                    yield from flush()
                    place = (hub, left, right)
                docs.append(doc), sets.append(np.frombuffer(blob, U64)), side.append(own)
        yield from flush()

    return run


def jaccard_components(docs: DataFrame, percent: int = 85, shingle: int = 4) -> DataFrame:
    """Shingle set size and component of every row: ``doc_id, n_shingles, component_id``.

    Links join documents with ``100 * |A and B| >= percent * |A or B|`` over distinct word
    shingles of the lower-cased (A-Z) text. Null and wordless texts have empty sets and are
    linked with nothing; a text of fewer words than a shingle is one shingle. Rows that share
    a ``doc_id`` are one node with the links of all of them, and each keeps its own set size.
    A row with a null ``doc_id`` is linked with nothing: set size 0, component null. Only ``doc_id`` and ``text`` are read.
    Features are 64-bit hashes of the shingles; sets are compared by all their features.

    One pass makes signatures (packed, 8 bytes each) and set fingerprints; they are shuffled
    once. Only documents that share a signature send their sets on, to one place for each
    group, or to pairs of blocks where a group has more than ``BLOCK_FEATURES`` features, so a
    group of any size is spread over tasks.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a word of about six bytes gives about 0.7 signatures of 8 bytes
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    met = (
        docs.mapInArrow(_signature_blobs(percent, shingle, buckets), "bucket int, sets binary, signatures binary")
        .repartitionById(buckets, F.col("bucket"))
        .mapInArrow(_meet(buckets), "doc_id long, n_shingles long, class_id long, home int, pairs binary")
    )
    met = stage_table(met, "met")
    nodes = met.where("doc_id is not null").select("doc_id", "n_shingles", "class_id")
    shared = (
        met.where("home is not null").select("home", "pairs").repartitionById(buckets, F.col("home")).mapInArrow(_distinct_pairs, "hub long, member long")
    )
    members = _place_members(shared, nodes)
    members = stage_table(members, "members")
    places = (
        members.groupBy("doc_id")
        .agg(F.collect_list(F.struct("hub", "left", "right", "own")).alias("places"))
        .hint("shuffle_hash")
    )
    # only these texts are needed once more; the exchange that found them is gone before their sets, about as large, are exchanged
    placed = stage_table(docs.join(places, "doc_id"), "placed")
    sent = placed.mapInArrow(_send_sets(shingle), "hub long, left int, right int, own int, doc_id long, features binary")
    links = (
        sent.repartition(max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), "hub", "left", "right")
        .sortWithinPartitions("hub", "left", "right", "doc_id")
        .mapInArrow(_compare(percent), "a long, b long")
    )
    same = nodes.where("doc_id <> class_id").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    whole = connected_components(stage_table(links.union(same), "links"))
    lone = docs.where("doc_id is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return (
        nodes.join(whole, nodes["doc_id"] == whole["node"], "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .union(lone)
    )


def _place_members(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """Where each set is compared: a group's only block, or all pairs of blocks with its own.

    A group is named by its smallest document. Names are drawn together by replacing each by
    the smallest name that its document itself has, so few groups repeat the same members.
    A member is the smallest document of its class and sends the sets of all its rows, so where
    a doc_id stands on rows with different texts, the one that owned the signature is among them.
    """
    lower = shared.groupBy("member").agg(F.min("hub").alias("low"))
    named = (
        shared.join(lower.withColumnRenamed("member", "hub_"), F.col("hub") == F.col("hub_"), "left")
        .select(F.coalesce("low", "hub").alias("name"), "hub", "member")
    )
    group = named.select("name", "member").union(named.select("name", F.col("hub").alias("member"))).distinct()
    size = nodes.groupBy(F.col("doc_id").alias("member")).agg(F.sum("n_shingles").alias("n"))
    group = group.join(size, "member")
    total = group.groupBy("name").agg(F.sum("n").alias("features"), F.count("*").alias("members")).where("members > 1")
    blocked = group.join(total, "name").select(
        "name", "member", F.ceil(F.col("features") / BLOCK_FEATURES).cast("int").alias("blocks")
    )
    own = F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return blocked.withColumn("own", own).withColumn("other", other).select(
        F.col("member").alias("doc_id"), F.col("name").alias("hub"),
        F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "own",
    )
