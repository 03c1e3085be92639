"""Seeded keys and trajectories as frames; the same arguments give the same rows."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import Grid


MOST_KEYS = 4_000_000


def _unit(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the parts and the seed alone, however rows are dealt to tasks."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def uniform_keys(spark: SparkSession, n: int, keys: int, seed: int = 1000) -> DataFrame:
    return spark.range(n).select("id", F.floor(_unit(seed, "id") * keys).cast("long").alias("key"))


def round_robin_keys(spark: SparkSession, n: int, keys: int) -> DataFrame:
    return spark.range(n).select("id", (F.col("id") % keys).alias("key"))


def zipf_keys(spark: SparkSession, n: int, keys: int, skew: float = 1.0, seed: int = 1000, shuffled: bool = True) -> DataFrame:
    """Keys whose k-th most frequent has weight ``k ** -skew``, by the inverse of the sums over all keys.

    ``shuffled`` scatters the frequent keys over the range by a seeded permutation.  Both tables have a number for each key,
    so ``keys`` is limited to ``MOST_KEYS``.
    """
    if keys > MOST_KEYS:
        raise ValueError(f"at most {MOST_KEYS} keys")
    sums = list(itertools.accumulate(k ** -float(skew) for k in range(1, keys + 1)))
    edges = spark.sparkContext.broadcast([s / sums[-1] for s in sums])

    @F.pandas_udf(T.LongType())
    def rank(u):
        import numpy as np
        import pandas as pd

        return pd.Series(np.minimum(np.searchsorted(edges.value, u.to_numpy(), "right"), keys - 1))

    df = spark.range(n).select("id", rank(_unit(seed, "id")).alias("key"))
    if not shuffled:
        return df
    order = spark.sparkContext.broadcast(_permutation(keys, seed))

    @F.pandas_udf(T.LongType())
    def scatter(k):
        import numpy as np
        import pandas as pd

        return pd.Series(np.asarray(order.value)[k.to_numpy()])

    return df.withColumn("key", scatter("key"))


def _permutation(n: int, seed: int) -> list[int]:
    out = list(range(n))
    random.Random(seed).shuffle(out)
    return out


def normal_keys(spark: SparkSession, n: int, mean: float = 500_000, deviation: float = 5_000, drift: float = 10_000, rows_per_drift: int = 100_000, seed: int = 1000) -> DataFrame:
    """Normal keys within three deviations of a mean that steps up or down after every ``rows_per_drift`` rows."""
    u, v = F.greatest(_unit(seed, "id"), F.lit(1e-12)), _unit(seed + 1, "id")
    z = F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)
    step = F.floor(F.col("id") / rows_per_drift)
    centre = F.lit(float(mean)) + F.when(step % 2 == 1, F.lit(float(drift))).otherwise(F.lit(0.0))
    return spark.range(n).select("id", z.alias("z"), centre.alias("c")).where("abs(z) <= 3").select("id", (F.col("c") + F.col("z") * deviation).alias("key"))


def uniform_points(spark: SparkSession, n: int, grid: Grid, seed: int = 1000) -> DataFrame:
    x = F.lit(grid.x1) + _unit(seed, "id") * (grid.x2 - grid.x1)
    y = F.lit(grid.y1) + _unit(seed + 1, "id") * (grid.y2 - grid.y1)
    return spark.range(n).select("id", x.alias("longitude"), y.alias("latitude")).withColumn("zcode", grid.zcode("longitude", "latitude"))


def moving_cars(spark: SparkSession, cars: int, steps: int, grid: Grid, speed: float = 0.001, turn_every: int = 20, start_millis: int = 0, step_millis: int = 1000, seed: int = 1000) -> DataFrame:
    """Cars that drive straight for ``turn_every`` steps, then turn, and come back from the box's edges: ``id, longitude, latitude, zcode, timestamp``.

    Each step is a vector in the direction of its leg; positions are running sums of one car, reflected into the box.
    """
    from pyspark.sql import Window

    rows = spark.range(cars * steps).select((F.col("id") / steps).cast("long").alias("car"), (F.col("id") % steps).alias("step"))
    angle = _unit(seed, "car", F.floor(F.col("step") / turn_every)) * 6.283185307179586
    w = Window.partitionBy("car").orderBy("step")

    def reflected(start: Column, moved: Column, low: float, high: float) -> Column:
        size = high - low
        at = F.pmod(start * size + moved, F.lit(2 * size))
        return F.lit(low) + F.least(at, F.lit(2 * size) - at)

    moved = rows.select("car", "step", F.sum(F.cos(angle) * speed).over(w).alias("dx"), F.sum(F.sin(angle) * speed).over(w).alias("dy"))
    x = reflected(_unit(seed + 1, "car"), F.col("dx"), grid.x1, grid.x2)
    y = reflected(_unit(seed + 2, "car"), F.col("dy"), grid.y1, grid.y2)
    out = moved.select(F.col("car").alias("id"), x.alias("longitude"), y.alias("latitude"), (F.lit(start_millis) + F.col("step") * step_millis).cast("long").alias("timestamp"))
    return out.withColumn("zcode", grid.zcode("longitude", "latitude"))
