"""Mixing sources to target weights by entropy balancing.

Over the token mass ``m_d = size_d * rate_d`` the mix minimises its relative entropy to the
corpus, subject to one token constraint for each source. The dual is convex and smooth, and
the optimal rates are exponentially tilted, ``rate_d = exp(multiplier of the source of d)``.
As a document is in one source only, the Hessian of the dual is diagonal: a Newton step needs
only token sums by source, and converges to ``log(target / tokens)``. Rates are then rounded to
whole copies, from the largest documents to the smallest; what a size class took too much
or too little tilts the rates of the smaller ones anew.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.llm.scratch import stage_table

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEAT = 3
NEWTON_STEPS = 40
TOLERANCE = 1e-9
ROWS_PER_RUN = 20_000
CLASSES_PER_OCTAVE = 32


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: float = MAX_REPEAT) -> DataFrame:
    """Token targets from ``source, source_size``: weights repeat over the sources by code point, null last.

    A target stops at ``most`` times its source's size; what is above is shared anew by
    weight among the others, until none is above. Water filling gives that fixed point in
    one pass: sources close in the order of ``most * size / weight``, and one is capped if
    its own bound is below the level that the remaining budget gives to all sources from it
    on. The table has one row a source, not a document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by_bound = Window.orderBy("bound", F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    at = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    # one partition by intent: a row a source
    level = (
        sizes.withColumn("weight", at.cast("double"))
        .withColumn("bound", F.lit(most) * F.col("source_size") / F.col("weight"))
        .withColumn("spent", F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0.0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("all_w", F.sum("weight").over(Window.partitionBy()))
        .withColumn("budget", F.lit(share) * F.sum("source_size").over(Window.partitionBy()))
        .withColumn("level", (F.col("budget") - F.col("spent")) / (F.col("all_w") - F.col("gone")))
        .withColumn("open", F.col("bound") > F.col("level"))
    )
    # the first open source has the true level; those after it close sources that stay open, which lowers theirs
    final = F.coalesce(F.max(F.when(F.col("open"), F.col("level"))).over(Window.partitionBy()), F.lit(float("inf")))
    return level.withColumn("target", F.least(F.lit(float(most)) * F.col("source_size"), F.col("weight") * final)).select(
        "source", "source_size", "weight", "target"
    )


def newton_multipliers(cells: DataFrame, family: str, targets: DataFrame, steps: int = NEWTON_STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """Dual multipliers for one family of token constraints, by distributed Newton steps.

    ``cells`` has the family's column and ``tokens``; ``targets`` has the column and
    ``target``. With one family the Hessian is diagonal, so a step is a join and a grouped
    sum over cells, and the number of cells isn't bounded by the driver. Steps are damped to
    one unit of the multiplier and end when the largest relative gradient is below
    ``tolerance``. A cell with target 0 gets a rate of 0.
    """
    state = targets.select(family, "target").withColumn("lam", F.when(F.col("target") > 0, F.lit(0.0)))
    for _ in range(steps):
        tilted = (
            cells.join(state, cells[family].eqNullSafe(state[family]))
            .groupBy(state[family])
            .agg(
                F.first("target").alias("target"),
                F.first("lam").alias("lam"),
                F.sum(F.col("tokens") * F.exp("lam")).alias("mass"),
            )
        )
        step = (F.col("target") - F.col("mass")) / F.col("mass")
        # the Hessian of the dual is the tilted mass itself
        state = stage_table(
            tilted.select(
                family,
                "target",
                (F.col("lam") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), step))).alias("lam"),
                F.coalesce(F.abs(F.col("target") - F.col("mass")) / F.col("target"), F.lit(0.0)).alias("gap"),
            ),
            "multipliers",
        )
        worst = state.agg(F.max("gap")).first()[0]
        state = state.drop("gap")
        if worst is None or worst <= tolerance:
            break
    return state.select(family, F.coalesce(F.exp("lam"), F.lit(0.0)).alias("rate"))


def text_size(text: str = "text") -> Column:
    """Words of a text; none if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0) -> DataFrame:
    """Copies of every row such that each source's words come near its target.

    Returns ``doc_id, source, size, source_size, target, rate, copies``. Size is the number of
    ``[^\\x20\\x09-\\x0D]+`` in the text; null and empty texts have size 0, take no part in the
    balance and get one copy of nothing. A null source is a source of its own, the last. Repeated rows are
    rounded on their own. A source without words has target 0. An empty table gives an empty
    result. Only ``doc_id, text, source`` are read, so further columns can't clash.

    Rounding goes from a source's largest documents to its smallest, by classes of a part of
    an octave; each class gets a whole number of copies and the rates of the smaller ones are
    tilted again for the words still due, so a source misses its target by a small part of
    a document where it has small ones. In a class the copies are spread evenly in the order
    of a hash. The order is cut into runs, so no source or class is sorted in one task.
    """
    base = stage_table(docs.select("doc_id", "source", text_size().alias("size")), "word-counts")
    cells = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    cells = stage_table(cells, "sources")
    targets = stage_table(source_targets(cells.drop("rows"), weights, share), "targets")
    rates = newton_multipliers(cells.select("source", F.col("source_size").alias("tokens")), "source", targets)
    per_source = (
        targets.alias("t")
        .join(rates.alias("r"), F.col("t.source").eqNullSafe(F.col("r.source")))
        .join(cells.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")))
        .select("t.source", "t.source_size", "t.target", "r.rate", F.greatest(F.lit(1), F.ceil(F.col("rows") / ROWS_PER_RUN)).alias("runs"))
    )
    rows = base.alias("d").join(per_source.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "source_size", "target", "rate", "runs")
    return _round_to_copies(rows)


def _copies_by_class(classes: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for each size class of one source, the largest documents first.

    ``rates`` and ``words`` are the class's sums of the tilted rates and of the words that they
    take. What the classes rounded so far took too much or too little is a change of the
    token constraint for the rest: their rates are tilted by one more common factor, so
    that they take the words still due. No document exceeds the largest repeat.
    """
    classes = classes.sort_values("class", ascending=False)
    due = float(classes["target"].iloc[0])
    left = float(classes["words"].sum())
    given = []
    for n, tokens, rates, words in zip(classes["n"], classes["tokens"], classes["rates"], classes["words"], strict=True):
        factor = max(due, 0.0) / left if left > 0 else 1.0
        given.append(min(int(factor * rates + 0.5), MAX_REPEAT * int(n)))
        due -= given[-1] * tokens / n
        left -= words
    return classes.assign(given=given)[["source", "class", "n", "given"]]


def size_class() -> Column:
    """Octave of ``size + 1`` and the part of it, in whole numbers."""
    octave = "length(bin(size + 1)) - 1"
    part = f"(size + 1 - shiftleft(1L, {octave})) * {CLASSES_PER_OCTAVE} div shiftleft(1L, {octave})"
    return F.expr(f"cast({CLASSES_PER_OCTAVE} * ({octave}) + {part} as int)")


def _round_to_copies(rows: DataFrame) -> DataFrame:
    """Deal each class's copies evenly over its documents, in runs of bounded length."""
    # a draw that other engines can repeat: the first 60 bits of a digest
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size")), 1, 15), 16, 10).cast("long")
    rows = rows.withColumn("class", size_class()).withColumn("draw", draw).withColumn("run", F.pmod("draw", F.col("runs")).cast("long"))
    per_run = rows.groupBy("source", "class", "run").agg(
        F.count("*").alias("n"), F.sum("size").alias("tokens"), F.sum("rate").alias("rates"), F.sum(F.col("rate") * F.col("size")).alias("words"), F.first("target").alias("target")
    )
    per_run = stage_table(per_run, "size-classes")
    of_class = ["source", "class"]
    dealt = (
        per_run.groupBy(*of_class)
        .agg(*[F.sum(c).alias(c) for c in ("n", "tokens", "rates", "words")], F.first("target").alias("target"))
        .groupBy("source")
        .applyInPandas(_copies_by_class, "source string, class int, n long, given long")
    )
    before = Window.partitionBy(*of_class).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_run.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select(*of_class, "run", "start")
    per_run = (
        starts.alias("s")
        .join(dealt.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")) & (F.col("s.class") == F.col("c.class")))
        .select("s.source", "s.class", "s.run", "s.start", "c.n", "c.given")
    )
    within = Window.partitionBy(*of_class, "run").orderBy("draw", "doc_id", "size")
    # in decimals: the product of two counts of a large class overflows a long
    upto = lambda place: F.expr(f"(2 * cast({place} as decimal(20, 0)) * cast(b.given as decimal(18, 0)) + b.n) div cast(2 * b.n as decimal(20, 0))")
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.class") == F.col("b.class")) & (F.col("a.run") == F.col("b.run"))
    return (
        rows.withColumn("at", F.row_number().over(within))
        .alias("a")
        .join(per_run.alias("b"), same)
        .select(
            "a.doc_id", "a.source", "a.size", "source_size", "target", "rate",
            F.when(F.col("a.size") == 0, F.lit(1)).otherwise(upto("b.start + a.at") - upto("b.start + a.at - 1")).cast("long").alias("copies"),
        )
    )
