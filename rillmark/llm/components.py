"""Connected components of a table of links, with all state in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.scratch import stage_table


def connected_components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``links(a, b)``, as ``node, component``.

    Alternates large-star and small-star steps, which rewire each node's neighbours to their
    minimum and need a number of rounds logarithmic in the longest path. A round is two
    grouped minima with map-side partial aggregation; no node's neighbours are gathered.
    Self links and repeated links are harmless; nulls are ignored.
    """
    links = links.where("a is not null and b is not null")
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stage_table(edges, "links")
    nodes = stage_table(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    signature = None
    while True:
        # large star: every larger neighbour goes to the node's minimum neighbour
        both = edges.select(F.col("u"), F.col("v")).union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(low, "u")
        edges = (
            moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        edges = stage_table(edges, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == signature:
            break
        signature = now
    found = edges.groupBy("u").agg(F.min("v").alias("v"))
    return nodes.join(found, nodes["node"] == found["u"], "left").select("node", F.coalesce("v", "node").alias("component"))
