"""Monte-Carlo estimate of pi over a split range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def draw(number: Column, axis: str, seed: int) -> Column:
    """52 bits of an md5 as a number in [0, 1): independent of the split, and the same in every run and engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{axis}:"), number.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def pi_estimate(spark: SparkSession, samples: int = 10_000, parallelism: int = 10, seed: int = 0) -> DataFrame:
    """pi. ``samples`` points in each of ``parallelism`` splits."""
    points = spark.range(0, samples * parallelism, 1, parallelism).select(draw(F.col("id"), "x", seed).alias("x"), draw(F.col("id"), "y", seed).alias("y"))
    inside = F.sum(F.when(F.col("x") * F.col("x") + F.col("y") * F.col("y") <= 1, 1).otherwise(0))
    return points.agg((4 * inside / F.count("*")).alias("pi"))
