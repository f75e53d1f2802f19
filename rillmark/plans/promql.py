"""Published queries over samples, as DataFrame plans.

Per-flush sums (traffic, requests) are amounts of their minute, so their rate is the sum over
the window divided by its length. Cumulative counters (watch metrics) have the rate of
a counter with resets. Distinct counts must not be summed over time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _trailing(keys: Sequence[str], seconds: int, time: str) -> Window:
    """Samples of a series in ``(t - seconds, t]``."""
    return Window.partitionBy(*keys).orderBy(time).rangeBetween(-(seconds * 1000 - 1), 0)


def matches(column: str, pattern: str) -> Column:
    """A regular label match, anchored at both ends."""
    return F.rlike(F.col(column), F.lit(f"^(?:{pattern})$"))


def increase(samples: DataFrame, keys: Sequence[str], seconds: int, time: str = "timestamp_ms") -> DataFrame:
    """Adds ``increase``: the sum of a series' amounts over the trailing window."""
    return samples.withColumn("increase", F.sum("value").over(_trailing(keys, seconds, time)))


def rate(samples: DataFrame, keys: Sequence[str], seconds: int, time: str = "timestamp_ms") -> DataFrame:
    """Adds ``rate``, the increase for each second."""
    return increase(samples, keys, seconds, time).withColumn("rate", F.col("increase") / float(seconds)).drop("increase")


def counter_increase(samples: DataFrame, keys: Sequence[str], seconds: int, time: str = "timestamp_ms") -> DataFrame:
    """Adds ``increase`` of a cumulative counter: its steps over the trailing window, where a fall is a reset."""
    before = F.lag("value").over(Window.partitionBy(*keys).orderBy(time))
    step = F.when(before.isNull(), F.lit(0.0)).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    return samples.withColumn("step", step).withColumn("increase", F.sum("step").over(_trailing(keys, seconds, time))).drop("step")


def over_time(samples: DataFrame, keys: Sequence[str], seconds: int, time: str = "timestamp_ms") -> DataFrame:
    """Adds ``max_over_time``, ``avg_over_time`` and ``sum_over_time`` of the trailing window."""
    w = _trailing(keys, seconds, time)
    return samples.withColumns({f"{f}_over_time": getattr(F, f)("value").over(w) for f in ("max", "avg", "sum")})


def sum_by(samples: DataFrame, by: Sequence[str], value: str = "value", time: str = "timestamp_ms") -> DataFrame:
    return samples.groupBy(time, *by).agg(F.sum(value).alias(value))


def avg_by(samples: DataFrame, by: Sequence[str], value: str = "value", time: str = "timestamp_ms") -> DataFrame:
    return samples.groupBy(time, *by).agg(F.avg(value).alias(value))


def topk(samples: DataFrame, k: int, ties: Sequence[str], value: str = "value", time: str = "timestamp_ms") -> DataFrame:
    """The ``k`` largest samples of each time; equal ones by the tie columns."""
    rank = F.row_number().over(Window.partitionBy(time).orderBy(F.desc(value), *ties))
    return samples.withColumn("rank", rank).where(F.col("rank") <= k)


def ratio(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """``ratio`` of two vectors on the keys that both have."""
    return (
        a.select(*keys, F.col(value).alias("numerator")).join(b.select(*keys, F.col(value).alias("denominator")), list(keys))
        .withColumn("ratio", F.when(F.col("denominator") != 0, F.col("numerator") / F.col("denominator")))
    )


def histogram_quantile(q: float, buckets: DataFrame, keys: Sequence[str], le: str = "le", value: str = "value") -> DataFrame:
    """``quantile`` of cumulative buckets, interpolated within its bucket.

    In the first bucket the lower bound is 0. In the last, open one the answer is the largest
    finite bound. A histogram without observations has none.
    """
    bound = F.when(F.col(le) == "+Inf", F.lit(float("inf"))).otherwise(F.col(le).try_cast("double"))
    w = Window.partitionBy(*keys).orderBy("bound")
    rows = (
        buckets.withColumn("bound", bound)
        .withColumn("below", F.coalesce(F.lag(value).over(w), F.lit(0.0)))
        .withColumn("lower", F.coalesce(F.lag("bound").over(w), F.lit(0.0)))
        .withColumn("total", F.max(value).over(Window.partitionBy(*keys)))
        .withColumn("rank", F.col("total") * q)
        .where((F.col("total") > 0) & (F.col(value) >= F.col("rank")))
    )
    inside = F.col("lower") + (F.col("bound") - F.col("lower")) * (F.col("rank") - F.col("below")) / (F.col(value) - F.col("below"))
    answer = F.when(F.col("bound") == float("inf"), F.col("lower")).when(F.col(value) == F.col("below"), F.col("bound")).otherwise(inside)
    return rows.groupBy(*keys).agg(F.min_by(answer, "bound").alias("quantile"))
