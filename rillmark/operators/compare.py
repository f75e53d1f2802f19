"""Differences between two tables of series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: values nearer than this agree.
TOLERANCE = 0.01


def compare_series(a: DataFrame, b: DataFrame, keys: Sequence[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Every key with ``left_value, right_value, status``: same, differs, missing (in b) or extra."""
    on = None
    for k in keys:
        same = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = same if on is None else on & same
    left = a.select(*keys, F.col("value").alias("left_value"), F.lit(True).alias("in_a")).alias("a")
    right = b.select(*keys, F.col("value").alias("right_value"), F.lit(True).alias("in_b")).alias("b")
    status = (
        F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra")
        .when(F.abs(F.col("left_value") - F.col("right_value")) > tolerance, "differs").otherwise("same")
    )
    return left.join(right, on, "full").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], "left_value", "right_value", status.alias("status"))
