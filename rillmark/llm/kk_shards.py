"""Sharding by Karmarkar-Karp differencing.

Rows that hold equal texts form one indivisible group. Groups above ``1 / (shards * cells)``
of all bytes stay single items; all others are hashed into ``shards * cells`` cells, so the
differencing sees at most ``2 * shards * cells`` items at any corpus size. The largest
differencing method then combines the two partial partitions of largest spread, the heavy
slots of one with the light slots of the other, until one partition is left.

Everything that touches rows is DataFrame code; only the bounded item list meets the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.llm.scratch import stage_table

CELLS = 64
ROWS_PER_SLOT_RUN = 10_000


def difference(sizes: Sequence[int], k: int) -> list[int]:
    """Shard of each item by the k-way largest differencing method.

    A partial partition is a tuple of ``k`` sums in falling order, each with the items that
    it holds. Ties are broken by the order in which the partitions arose, so reruns agree.
    """
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = []
    for i, size in enumerate(sizes):
        slots = [(size, [i])] + [(0, []) for _ in range(k - 1)]
        heap.append((-size, i, slots))
    heapq.heapify(heap)
    born = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # the heaviest slot of a meets the lightest of b; the longer item list absorbs the other
        merged = []
        for (x, xs), (y, ys) in zip(a, reversed(b), strict=True):
            if len(xs) < len(ys):
                xs, ys = ys, xs
            xs.extend(ys)
            merged.append((x + y, xs))
        merged.sort(key=lambda slot: -slot[0])
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], born, merged))
        born += 1
    out = [0] * len(sizes)
    if heap:
        for shard, (_, items) in enumerate(heap[0][2]):
            for i in items:
                out[i] = shard
    return out


def _group_key(text: Column) -> Column:
    """128 bits of the text; a null text has a key that no text has."""
    return F.when(text.isNull(), F.lit("null")).otherwise(F.md5(text.cast("binary")))


def shard_documents(docs: DataFrame, shards: int = 40, cells: int = CELLS, carry: Sequence[str] = ()) -> DataFrame:
    """Give every row a shard of near-equal bytes and a gapless slot in it.

    Returns ``doc_id, size, text_crc32, group_key, shard, slot`` and the columns of ``docs`` named
    in ``carry`` (which may name the text). Size is the UTF-8 bytes of the text plus 16. Null
    texts form one group of size 16 a row, apart from empty texts. Repeated rows each get a
    slot of their own; rows with a null ``doc_id`` are sharded like any other. An empty table
    gives an empty result. Columns that aren't named are not read, so they can't clash. A
    group is never split, so a group of more than ``1 / shards`` of all bytes makes its shard
    larger than the others by that excess.
    """
    spark = docs.sparkSession
    text = F.col("text")
    keyed = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        _group_key(text).alias("group_key"),
        *[F.col(c).alias(f"carried_{c}") for c in carry],
    )
    base = stage_table(keyed.select("doc_id", "size", "text_crc32", "group_key"), "sizes")
    items = shards * cells
    total = F.lit(base.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    groups = base.groupBy("group_key").agg(F.sum("size").alias("bytes"))
    cell = F.pmod(F.xxhash64("group_key"), F.lit(items)).cast("int")
    large = F.col("bytes") * F.lit(items) > total
    # a large group is an item of its own, and there are fewer than shards * cells of them
    single = groups.where(large).select("group_key", "bytes").orderBy("group_key").collect()
    pooled = groups.where(~large).groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes")).orderBy("cell").collect()
    placed = difference([r["bytes"] for r in single] + [r["bytes"] for r in pooled], shards)
    of_group = spark.createDataFrame(
        [(r["group_key"], s) for r, s in zip(single, placed, strict=False)], "group_key string, own int"
    )
    of_cell = spark.createDataFrame(
        [(r["cell"], s) for r, s in zip(pooled, placed[len(single):], strict=True)], "cell int, shared int"
    )

    def place(rows: DataFrame) -> DataFrame:
        return (
            rows.withColumn("cell", cell)
            .join(F.broadcast(of_group), "group_key", "left")
            .join(F.broadcast(of_cell), "cell", "left")
            .withColumn("shard", F.coalesce("own", "shared"))
            .drop("own", "shared", "cell")
        )

    out = _with_slots(place(keyed) if carry else place(base), place(base))
    return out.withColumnsRenamed({f"carried_{c}": c for c in carry})


def _with_slots(rows: DataFrame, plain: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0 without sorting a whole shard in one task.

    A shard is cut into runs by a hash of the row; a run's first slot is the number of rows
    in the runs before it. Only the table of runs, one row for about ``ROWS_PER_SLOT_RUN``
    rows, is summed over a shard. ``plain`` has the same rows without carried columns.
    """
    runs = max(1, -(-plain.count() // ROWS_PER_SLOT_RUN))
    run = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(runs)).cast("int")
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        plain.groupBy("shard", run.alias("run"))
        .count()
        .withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    within = Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("run", run)
        .withColumn("at", F.row_number().over(within))
        .join(starts, ["shard", "run"])
        .withColumn("slot", (F.col("start") + F.col("at") - 1).cast("long"))
        .drop("at", "start", "run")
    )
