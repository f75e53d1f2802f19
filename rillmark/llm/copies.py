"""Groups of rows with equal texts, some of which may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of more rows than this, and more than one in ``HOT_GROUPS`` of all rows, are hot: there are fewer than ``HOT_GROUPS``.
HOT_ROWS = 1_000
HOT_GROUPS = 50_000


def owners(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Smallest ``doc_id`` of each key as ``owner``, and how many rows have it as ``n``; rows without an id are left out."""
    return rows.where("doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("owner"), F.count("*").alias("n"))


def split_hot_copies(rows: DataFrame, groups: DataFrame, key: Sequence[str], total: int) -> tuple[DataFrame, DataFrame]:
    """Copies in hot groups with the columns of ``groups``, and all other rows.

    ``groups`` has ``owner``, ``n`` and columns of bounded width. Hot groups are fewer than
    ``HOT_GROUPS`` whatever the corpus, so they are broadcast and their copies (rows whose id is
    above the owner's) never meet in one task. Rows without an id are no copies.
    """
    hot = F.broadcast(groups.where(F.col("n") > max(HOT_ROWS, total // HOT_GROUPS)))
    tagged = rows.join(hot, list(key), "left")
    is_copy = F.coalesce(F.col("doc_id") > F.col("owner"), F.lit(False))
    return tagged.where(is_copy), tagged.where(~is_copy).select(*rows.columns)
