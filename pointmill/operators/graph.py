"""The region adjacency graph as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointmill.functions.ranks import number_rows
from pointmill.functions.vector import angle, edge_weight, triple
from pointmill.operators.neighbors import near_pairs
from pointmill.workspace import Workspace

ATTRIBUTES = ["x", "y", "z", "nx", "ny", "nz", "curvature"]


def vertices(features: DataFrame) -> DataFrame:
    """One region per point: (point_id, size, attributes); a ``size`` column (points per voxel) is kept."""
    size = F.col("size").cast("bigint") if "size" in features.columns else F.lit(1).cast("bigint")
    return features.select("point_id", size.alias("size"), *ATTRIBUTES)


def with_ends(edges: DataFrame, features: DataFrame) -> DataFrame:
    """Edges beside the attributes of their ends as structs a and b."""
    side = features.select("point_id", F.struct(*ATTRIBUTES).alias("s"))
    return edges.join(side.toDF("src", "a"), "src").join(side.toDF("dst", "b"), "dst")


def build_edges(features: DataFrame, radius: float, angle_weight: float = 0.5, curvature_weight: float = 1.0, inclusive: bool = True, weight: Column | None = None) -> DataFrame:
    """EDGES of all pairs within ``radius``, numbered by (src, dst), and the larger curvature of their ends; ``weight`` may be any expression over a and b.

    The ends' attributes travel through the radius join, so an edge is complete when it is found.
    """
    w = edge_weight("a", "b", angle_weight, curvature_weight) if weight is None else weight
    pairs = near_pairs(features.select("point_id", *ATTRIBUTES), radius, inclusive)
    found = pairs.select(F.col("a.point_id").alias("src"), F.col("b.point_id").alias("dst"), w.alias("weight"), F.greatest("a.curvature", "b.curvature").alias("curvature"))
    ws = Workspace(features.sparkSession, "edges")  # written before it is numbered: cutting the ranges reads it once more
    return number_rows(ws.keep(found)[0], ["src", "dst"], "edge_id").select("edge_id", "src", "dst", "weight", "curvature")


def mergeable_edges(edges: DataFrame, features: DataFrame, threshold: float) -> DataFrame:
    """Edges whose larger curvature is within the threshold.  Curvature never changes and every root is an
    original point, so dropping the others before the merge leaves all labels as they are."""
    names = ["edge_id", "src", "dst", "weight"]
    if "curvature" in edges.columns:
        return edges.where(F.col("curvature") <= threshold).select(*names)
    flat = features.where(F.col("curvature") <= threshold).select("point_id")
    return edges.join(flat.toDF("src"), "src", "left_semi").join(flat.toDF("dst"), "dst", "left_semi").select(*names)


def smooth_edges(edges: DataFrame, features: DataFrame, max_angle: float, threshold: float) -> DataFrame:
    """Edges whose original normals are within ``max_angle`` and curvatures within ``threshold``."""
    near = (angle(triple("a", ("nx", "ny", "nz")), triple("b", ("nx", "ny", "nz"))) <= max_angle) & (F.greatest("a.curvature", "b.curvature") <= threshold)
    return with_ends(edges, features).where(near).select("edge_id", "src", "dst", "weight")


def connects(a: Column, b: Column) -> Column:
    """Whether an edge joins the two given vertices, in either order."""
    return ((F.col("src") == a) & (F.col("dst") == b)) | ((F.col("src") == b) & (F.col("dst") == a))


def other_end(v: Column) -> Column:
    return F.when(F.col("src") == v, F.col("dst")).when(F.col("dst") == v, F.col("src"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(point_id, edge_ids ascending, degree) of vertices with edges."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("point_id"), "edge_id")
    return ends.groupBy("point_id").agg(F.array_sort(F.collect_list("edge_id")).alias("edge_ids"), F.count(F.lit(1)).alias("degree"))


def graph_stats(points: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: vertices, edges, average degree 2E/V (0 without vertices)."""
    v, e = points.agg(F.count(F.lit(1)).alias("vertices")), edges.agg(F.count(F.lit(1)).alias("edges"))
    avg = F.when(F.col("vertices") == 0, F.lit(0.0)).otherwise(2 * F.col("edges") / F.nullif(F.col("vertices"), F.lit(0)))
    return v.crossJoin(e).select("vertices", "edges", avg.alias("average_degree"))
