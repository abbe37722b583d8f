"""Local surface features: normal and curvature from the covariance of each point's neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.functions.eigen import with_smallest_eigenpair
from pointmill.functions.ranks import index_percentiles
from pointmill.functions.vector import dot, usable_normal
from pointmill.operators.neighbors import near_pairs

MOMENTS = {"xx": ("x", "x"), "yy": ("y", "y"), "zz": ("z", "z"), "xy": ("x", "y"), "xz": ("x", "z"), "yz": ("y", "z")}


def covariances(points: DataFrame, radius: float, inclusive: bool = True) -> DataFrame:
    """(point_id, n_neighbors, x, y, z, xx..yz): population covariance of the offsets to all points within
    ``radius``, the point itself included.

    Offsets are taken from the query point, so sums stay small whatever the cloud's origin.  Each half pair
    serves both of its points; the point itself adds one to the count and nothing to the sums.  Sums are combined
    in the join's own tasks, so a point leaves them once for each block it lies in, not once for each neighbour.
    """
    p = points.select("point_id", *"xyz")
    off = [F.col(f"b.{c}") - F.col(f"a.{c}") for c in "xyz"]
    one = F.struct(F.col("a.point_id").alias("point_id"), *[o.alias(f"d{c}") for c, o in zip("xyz", off)])
    two = F.struct(F.col("b.point_id").alias("point_id"), *[(-o).alias(f"d{c}") for c, o in zip("xyz", off)])
    null = [F.lit(None).cast("double").alias(c) for c in "xyz"]
    both = near_pairs(p, radius, inclusive).select(F.inline(F.array(one, two))).select("*", *null)
    own = p.select("point_id", *[F.lit(0.0).alias(f"d{c}") for c in "xyz"], *"xyz")
    sums = [F.sum(f"d{c}").alias(f"s{c}") for c in "xyz"] + [F.sum(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"s{k}") for k, (i, j) in MOMENTS.items()]
    # The point's own row brings its position along, so no join back is needed.
    agg = both.unionByName(own).groupBy("point_id").agg(F.count(F.lit(1)).alias("n_neighbors"), *[F.max(c).alias(c) for c in "xyz"], *sums)
    n = F.col("n_neighbors")
    cov = [(F.col(f"s{k}") / n - F.col(f"s{i}") / n * F.col(f"s{j}") / n).alias(k) for k, (i, j) in MOMENTS.items()]
    return agg.select("point_id", "n_neighbors", *"xyz", *cov)


def surface_features(points: DataFrame, radius: float, inclusive: bool = True) -> DataFrame:
    """FEATURES rows.  Fewer than three points in reach give normal (0, 0, 1) and curvature 0; a normal points
    towards the origin of the coordinates."""
    raw = with_smallest_eigenpair(covariances(points, radius, inclusive))
    e = [F.col(c) for c in ("ex", "ey", "ez")]
    flip = F.when(dot(e, [F.col(c) for c in "xyz"]) > 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    few = F.col("n_neighbors") < 3
    hidden = {n: F.when(few, F.lit(None).cast("double")).otherwise(c * F.col("flip")) for n, c in zip(("ex", "ey", "ez"), e)}
    out = usable_normal(*e, F.col("variation"))
    return raw.withColumn("flip", flip).withColumns(hidden).select("point_id", "n_neighbors", *"xyz", *[c.alias(n) for c, n in zip(out, ("nx", "ny", "nz", "curvature"))])


def curvature_stats(features: DataFrame) -> DataFrame:
    """One row: n, min, mean, max and the 50/95/98/99 index percentiles of curvature; zeros for no points."""
    plain = features.agg(F.count("curvature").alias("n"), *[F.coalesce(f("curvature"), F.lit(0.0)).alias(a) for f, a in ((F.min, "min"), (F.avg, "mean"), (F.max, "max"))])
    ranks = index_percentiles(features, F.col("curvature"), [50, 95, 98, 99])
    wide = ranks.agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(f"p{q}") for q in (50, 95, 98, 99)])
    return plain.crossJoin(wide)  # one row each


def curvature_threshold(features: DataFrame, percentile: int = 98) -> float:
    """The curvature above which a point never merges."""
    return index_percentiles(features, F.col("curvature"), [percentile]).first()["value"]
