"""From roots to dense segment numbers and region tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.functions.ranks import number_rows


def dense_labels(roots: DataFrame) -> DataFrame:
    """LABELS from (point_id, root): segments are numbered from 0 by the smallest point id they hold.

    The numbering does not depend on which vertex became the root.
    """
    firsts = roots.groupBy("root").agg(F.min("point_id").alias("first"))
    ranked = number_rows(firsts, ["first"], "segment_id")
    return roots.join(ranked, "root").select("point_id", "segment_id")


def segment_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("segment_id").agg(F.count(F.lit(1)).alias("size"))


def count_segments(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count_distinct("segment_id").alias("segments"))


def first_active(roots: DataFrame) -> DataFrame:
    """One row: the active vertex with the lowest number, null if there is none."""
    return roots.agg(F.min(F.when(F.col("point_id") == F.col("root"), F.col("point_id"))).alias("vertex"))


def active_counts(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: vertices that are still roots, and edges whose ends are in different regions."""
    live = roots.agg(F.count_if(F.col("root") == F.col("point_id")).alias("active_vertices"))
    at = edges.join(roots.toDF("src", "ra"), "src").join(roots.toDF("dst", "rb"), "dst")
    return live.crossJoin(at.agg(F.count_if(F.col("ra") != F.col("rb")).alias("active_edges")))
