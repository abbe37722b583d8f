"""Deterministic synthetic clouds for tests and timing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def three_planes(spark: SparkSession, side: int = 20, step: float = 0.2, noise: float = 0.02, seed: int = 7) -> DataFrame:
    """(point_id, x, y, z, plane): ground, wall and ceiling with side x side points each, far enough apart that their
    neighbourhoods do not mix."""
    n = side * side
    row = spark.range(3 * n).select(F.col("id").alias("point_id"), F.floor(F.col("id") / n).cast("int").alias("plane"), F.pmod("id", F.lit(n)).alias("_i"))
    u, v = F.pmod(F.col("_i"), F.lit(side)) * step, F.floor(F.col("_i") / side) * step
    jitter = F.randn(seed) * noise if noise else F.lit(0.0)
    reach = side * step
    x = F.when(F.col("plane") == 1, F.lit(-2.0) + jitter).otherwise(u)
    z = F.when(F.col("plane") == 0, jitter).when(F.col("plane") == 1, u + 1.0).otherwise(F.lit(reach + 4.0) + jitter)
    return row.select("point_id", x.alias("x"), v.alias("y"), z.alias("z"), "plane")


def scaling_cloud(spark: SparkSession, points: int, seed: int = 7) -> DataFrame:
    """(point_id, x, y, z): a noisy square surface of about unit spacing 0.2, for timing by size."""
    side = max(1, math.isqrt(points))
    at = spark.range(points).select(F.col("id").alias("point_id"), (F.pmod("id", F.lit(side)) * 0.2 + F.randn(seed) * 0.02).alias("x"), (F.floor(F.col("id") / side) * 0.2).cast("double").alias("y"))
    return at.withColumn("z", F.randn(seed + 1) * 0.02)
