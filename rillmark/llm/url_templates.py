"""URL filter: rules first, then a tree of path templates for each host.

A path's segments that look variable (with a digit, or very long) become ``*``. Going down the
tree, a node with more than ``WIDEST`` literal children has them all generalised to ``*``, and
literal children whose share of blocked labels can't be told from that of all siblings
(too few labels, none, or no significant difference) are merged into one branch ``~``.
The labels are the verdicts of the rules, and any others that are given.

The purity of a node is its share of blocked labels, smoothed by ``PRIOR_WEIGHT`` labels at its
parent's purity; a host's root is smoothed towards ``PRIOR``. A branch that holds all labels of
its parent adds no evidence and keeps its purity; one without labels has the purity of its
nearest labelled ancestor. A template is rejected if its purity is above one half.

The tree is grown over the table of distinct shapes with their counts, level by level, so the
pages of a hot host are pre-aggregated before anything is shuffled. A node with one shape
left is a leaf, whatever its depth, so rounds are bounded by the depth at which paths part.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm.scratch import stage_table

LONG_SEGMENT = 32
WIDEST = 50
#: Labels a branch needs to be compared with its siblings, and the normal quantile for that.
LEAST_LABELS = 5
SIMILAR_Z = 1.96
PRIOR = 0.25
PRIOR_WEIGHT = 4.0
REJECT_ABOVE = 0.5
#: Rejected shapes that are broadcast, in rows and characters; more of them are joined by shuffle.
BROADCAST_ROWS = 50_000
BROADCAST_CHARS = 20_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls. Of equal names the first given counts."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name = F.when(fits, F.lit(r.host + r.path)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _shape(path: Column) -> Column:
    """Segments of a path as one string, variable ones as ``*``."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    general = F.transform(segments, lambda s: F.when(s.rlike("[0-9]") | (F.length(s) > LONG_SEGMENT), F.lit("*")).otherwise(s))
    return F.array_join(general, "/")


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, labels: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, shape`` for every row of ``pages``.

    ``labels(page_id, blocked)`` may add labels; a page that a rule decides is a label as it
    is. Null and malformed urls have an empty host and path, fall under the empty template of
    the empty host, and are judged like others. Repeated rows are judged alike and count as
    labels each. Null ``page_id`` keeps its row. Only ``page_id`` and ``url`` are read.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", name).withColumn("decided", verdict).withColumn("shape", _shape(F.col("path")))
    seen = parsed.withColumn("blocked", F.when(F.col("decided") == "block", 1).when(F.col("decided") == "allow", 0))
    if labels is not None:
        own = labels.where("page_id is not null and blocked is not null").groupBy("page_id").agg(F.max("blocked").cast("int").alias("marked"))
        seen = seen.join(own, "page_id", "left").withColumn("blocked", F.coalesce("blocked", "marked"))
    shapes = seen.groupBy("host", "shape").agg(F.count("blocked").alias("labelled"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked"))
    rejected = _rejected(stage_table(shapes, "shapes"))
    size = rejected.agg(F.count("*").alias("n"), F.sum(F.length("host") + F.length("shape")).alias("chars")).first()
    few = size["n"] <= BROADCAST_ROWS and (size["chars"] or 0) <= BROADCAST_CHARS
    # beyond the broadcast's bound, adaptive execution splits the partitions of hot hosts
    judged = parsed.join(F.broadcast(rejected) if few else rejected, ["host", "shape"], "left")
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("decided", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "shape",
    )


def _purity(bad: Column, n: Column, parent: Column) -> Column:
    return (bad.cast("double") + parent * PRIOR_WEIGHT) / (n.cast("double") + PRIOR_WEIGHT)


def _rejected(shapes: DataFrame) -> DataFrame:
    """``host, shape`` of the shapes whose template is rejected."""
    hosts = shapes.groupBy("host").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("bad"), F.count("*").alias("left"))
    # a host without blocked labels has no purity above PRIOR anywhere
    root = hosts.where("bad > 0").select("host", _purity(F.col("bad"), F.col("n"), F.lit(PRIOR)).alias("purity"), "left")
    open_ = shapes.join(root, "host").select("host", "shape", "labelled", "blocked", F.lit("").alias("template"), "purity", "left")
    done, depth = None, 0
    while True:
        level = stage_table(open_, f"level-{depth}")
        ended = level.where((F.col("left") == 1) | (F.size(F.split("shape", "/")) < depth)).select("host", "shape", "purity")
        done = ended if done is None else done.union(ended)
        open_ = level.where((F.col("left") > 1) & (F.size(F.split("shape", "/")) >= depth))
        if open_.isEmpty():
            break
        open_ = _grow(open_, depth)
        depth += 1
    return stage_table(done.where(F.col("purity") > REJECT_ABOVE).select("host", "shape", F.lit(True).alias("rejected")), "rejected")


def _grow(tree: DataFrame, depth: int) -> DataFrame:
    """The next level: each shape's template goes on with its branch at ``depth``, an ended one with an empty branch."""
    segment = F.coalesce(F.get(F.split("shape", "/"), depth), F.lit(""))
    tree = tree.withColumn("segment", segment)
    children = tree.groupBy("host", "template", "segment").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("bad"))
    literal = ~F.col("segment").isin("", "*")
    nodes = children.groupBy("host", "template").agg(
        F.count(F.when(literal, 1)).alias("literals"), F.sum("n").cast("double").alias("all_n"), F.sum("bad").cast("double").alias("all_bad")
    )
    # n * (p - pooled)^2 <= z^2 * pooled * (1 - pooled), in doubles, since products of counts overflow longs
    pooled = F.try_divide("all_bad", "all_n")
    n = F.col("n").cast("double")
    gap = F.try_divide(F.col("bad").cast("double"), n) - pooled
    similar = (F.col("n") < LEAST_LABELS) | (n * gap * gap <= SIMILAR_Z * SIMILAR_Z * pooled * (1.0 - pooled))
    branch = F.when(literal & (F.col("literals") > WIDEST), "*").when(literal & similar, "~").otherwise(F.col("segment"))
    branches = children.join(nodes, ["host", "template"]).select("host", "template", "segment", branch.alias("branch"), "n", "bad", "all_n")
    grown = tree.join(branches.drop("n", "bad", "all_n"), ["host", "template", "segment"])
    sums = branches.groupBy("host", "template", "branch").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.first("all_n").alias("all_n"))
    left = grown.groupBy("host", "template", "branch").agg(F.count("*").alias("left"))
    return grown.drop("left").join(sums.join(left, ["host", "template", "branch"]), ["host", "template", "branch"]).select(
        "host", "shape", "labelled", "blocked", F.concat("template", F.lit("/"), "branch").alias("template"),
        F.when(F.col("n") == F.col("all_n"), F.col("purity")).otherwise(_purity(F.col("bad"), F.col("n"), F.col("purity"))).alias("purity"), "left",
    )
