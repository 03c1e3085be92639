"""Key intervals, load histograms, skew and repartition plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_id(key: Column | str, low: float, high: float, intervals: int = 1024) -> Column:
    """Which of equal intervals of [low, high) a key is in; keys below are in the first, others outside in the last."""
    key = F.col(key) if isinstance(key, str) else key
    part = F.floor((key - F.lit(float(low))) / F.lit((high - low) / intervals))
    return F.least(F.greatest(part, F.lit(0)), F.lit(intervals - 1)).cast("int")


def interval_of(key: float, low: float, high: float, intervals: int = 1024) -> int:
    """The twin of ``interval_id``: the same operations in the same order."""
    return int(min(max((key - low) / ((high - low) / intervals), 0.0), intervals - 1.0))


def equal_plan(partitions: int, intervals: int = 1024) -> list[int]:
    """The partition of each interval, of equal width."""
    return [k * partitions // intervals for k in range(intervals)]


def partition_id(interval: Column | str, plan: Sequence[int]) -> Column:
    """The partition of an interval id, by a plan."""
    interval = F.col(interval) if isinstance(interval, str) else interval
    return F.get(F.array(*map(F.lit, plan)), interval)


def histogram(df: DataFrame, key: Column | str, low: float, high: float, intervals: int = 1024) -> DataFrame:
    """``interval, n`` of all intervals, empty ones included."""
    found = df.groupBy(interval_id(key, low, high, intervals).cast("long").alias("interval")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(intervals).withColumnRenamed("id", "interval").join(found, "interval", "left").select("interval", F.coalesce("n", F.lit(0)).alias("n"))


def merge_histograms(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("interval").agg(F.sum("n").alias("n"))


def weights(hist: DataFrame, intervals: int = 1024) -> list[int]:
    """A histogram as a list, its size bounded by the number of intervals."""
    found = {r.interval: r.n for r in hist.where(F.col("interval") < intervals).collect()}
    return [found.get(k, 0) for k in range(intervals)]


def loads(hist: DataFrame, plan: Sequence[int]) -> DataFrame:
    """``partition, load`` under a plan."""
    return hist.groupBy(partition_id("interval", plan).cast("long").alias("partition")).agg(F.sum("n").alias("load"))


def skew_factor(own: Sequence[float]) -> float:
    """How far the largest load exceeds the mean, as a share of the mean."""
    mean = sum(own) / len(own) if own else 0
    return max(own) / mean - 1 if mean else 0.0


def skew_column(load: str = "load") -> Column:
    return F.max(load) / F.avg(load) - 1


def repartition_plan(own: Sequence[float], partitions: int) -> list[int]:
    """The partition of each interval, filled from the left up to the mean weight of a partition."""
    goal, plan, at, fill = sum(own) / partitions, [], 0, 0.0
    for w in own:
        plan.append(at)
        fill += w
        if at < partitions - 1 and fill >= goal:
            at, fill = at + 1, 0.0
    return plan


def rebalanced(own: Sequence[float], plan: Sequence[int], partitions: int, threshold: float = 0.2) -> list[int] | None:
    """A new plan if the loads under the present one are skewed beyond the threshold, else None."""
    load = [0.0] * partitions
    for w, p in zip(own, plan):
        load[p] += w
    return repartition_plan(own, partitions) if skew_factor(load) > threshold else None
