"""Bounding box, point spacing and voxel thinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointmill.functions.ranks import number_rows


def bounds(points: DataFrame) -> DataFrame:
    """One row: n and min/max per axis; zeros for an empty cloud."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("n")]
    for c in "xyz":
        aggs += [F.coalesce(F.min(c), F.lit(0.0)).alias(f"min_{c}"), F.coalesce(F.max(c), F.lit(0.0)).alias(f"max_{c}")]
    return points.agg(*aggs)


def spacing(points: DataFrame) -> DataFrame:
    """One row: cube root of volume per point, axes of no extent left out; 0 for fewer than two points."""
    spans = [F.when(F.col(f"max_{c}") > F.col(f"min_{c}"), F.col(f"max_{c}") - F.col(f"min_{c}")).otherwise(1.0) for c in "xyz"]
    value = F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.cbrt(spans[0] * spans[1] * spans[2] / F.nullif(F.col("n"), F.lit(0))))
    return bounds(points).select("n", value.alias("spacing"))


def voxel_cells(points: DataFrame, size: float) -> DataFrame:
    """Points with their voxel vx, vy, vz; the grid starts half a voxel below the cloud's minimum."""
    low = points.agg(*[F.min(c).alias(f"lo_{c}") for c in "xyz"])
    at = points.crossJoin(F.broadcast(low))  # one row
    return at.withColumns({f"v{c}": F.floor((F.col(c) - (F.col(f"lo_{c}") - F.lit(size / 2))) / F.lit(size)) for c in "xyz"}).drop("lo_x", "lo_y", "lo_z")


def voxel_means(points: DataFrame, size: float) -> DataFrame:
    """One averaged point per occupied voxel, with the number of its points."""
    return voxel_cells(points, size).groupBy("vx", "vy", "vz").agg(*[F.avg(c).alias(c) for c in "xyz"], F.count(F.lit(1)).alias("n"))


def voxel_downsample(points: DataFrame, size: float) -> DataFrame:
    """Averaged points numbered in the order of their voxels (point_id, x, y, z, size)."""
    return number_rows(voxel_means(points, size), ["vx", "vy", "vz"], "point_id").select("point_id", "x", "y", "z", F.col("n").alias("size"))
