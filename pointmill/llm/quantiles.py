"""Percentiles with bounded relative error from mergeable logarithmic buckets.

A value v falls into bucket sign(v) * ceil(ln|v| / ln g) with g = (1 + a) / (1 - a); the bucket's
midpoint 2 g^i / (g + 1) is within a * |v| of every value in it, so any order statistic read from the
counts has relative error at most ``a``.  Zeros have a bucket of their own.  A sketch is an ordinary table
(keys, sign, bucket, n): sketches of days, files or partitions combine by adding n, and Spark's partial
aggregation does so before every shuffle, so one key with a third of all rows sends only its buckets.
"""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.01


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def sketch(df: DataFrame, keys: list[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """Bucket counts per key; null, NaN and infinite values do not count."""
    v = F.col(value).cast("double")
    width = math.log((1 + alpha) / (1 - alpha))
    bucket = F.when(v == 0, F.lit(0)).otherwise(F.ceil(F.log(F.abs(v)) / F.lit(width))).cast("bigint")
    rows = df.where(finite(v)).select(*keys, F.signum(v).cast("int").alias("sign"), bucket.alias("bucket"))
    return rows.groupBy(*keys, "sign", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Add up sketches; ``keys`` may be fewer than the sketches were built with."""
    return sketches.groupBy(*keys, "sign", "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, keys: list[str], qs: list[int], alpha: float = ALPHA) -> DataFrame:
    """One row per key: n and p<q> for each percent q, at rank min(floor(n q / 100), n - 1) from 0.

    The window holds one row per occupied bucket of a key, a number bounded by the range of doubles
    and ``alpha``, whatever the number of values.
    """
    g = (1 + alpha) / (1 - alpha)
    # From the bucket's lower end, so that the last bucket below the largest double does not overflow.
    size = F.least(F.pow(F.lit(g), F.col("bucket").cast("double") - 1) * F.lit(2 * g / (g + 1)), F.lit(sys.float_info.max))
    at = sketches.withColumn("_v", F.col("sign") * F.when(F.col("sign") == 0, 0.0).otherwise(size))
    w = Window.partitionBy(*keys).orderBy("sign", F.col("sign") * F.col("bucket"))
    at = at.withColumn("_upto", F.sum("n").over(w)).withColumn("_all", F.sum("n").over(Window.partitionBy(*keys)))

    def pick(q: int) -> Column:
        rank = F.least(F.expr(f"_all * {q} div 100"), F.col("_all") - 1)
        return F.min(F.when(F.col("_upto") > rank, F.col("_v"))).alias(f"p{q}")

    return at.groupBy(*keys).agg(F.max("_all").alias("n"), *[pick(q) for q in qs])


def daily_curvature_sketch(features: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Sketch of features.curvature per scene and day of scanned_at; renewed rows of a point count once."""
    rows = features.where(finite(F.col("curvature"))).select("point_id", "scene", F.to_date("scanned_at").alias("day"), "curvature")
    once = rows.groupBy("point_id").agg(F.min(F.struct("scene", "day", "curvature")).alias("r")).select("r.*")
    return sketch(once, ["scene", "day"], "curvature", alpha)
