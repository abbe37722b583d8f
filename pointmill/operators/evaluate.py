"""Scoring of unsupervised segments against ground truth: two group-bys and small joins.

Inputs are TRUTH(point_id, class_id) and LABELS(point_id, segment_id); ``paired`` joins them.  Negative
segments are noise and map to class 0.  Rows where either side is null are left out by the join helper.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.functions.vector import safe_ratio


def paired(truth: DataFrame, labels: DataFrame) -> DataFrame:
    """(point_id, gt, cluster) of points present in both."""
    t = truth.where("class_id is not null").select("point_id", F.col("class_id").cast("bigint").alias("gt"))
    p = labels.where("segment_id is not null").select("point_id", F.col("segment_id").cast("bigint").alias("cluster"))
    return t.join(p, "point_id")


def histogram(pairs: DataFrame) -> DataFrame:
    """(cluster, gt, n) of the non-negative clusters."""
    return pairs.where("cluster >= 0").groupBy("cluster", "gt").agg(F.count(F.lit(1)).alias("n"))


def majority_classes(hist: DataFrame) -> DataFrame:
    """(cluster, class): most frequent class, the lowest of equals; class 0 may win."""
    return hist.groupBy("cluster").agg(F.max_by("gt", F.struct(F.col("n"), -F.col("gt"))).alias("class"))


def purity(hist: DataFrame) -> DataFrame:
    """(cluster, size, purity)."""
    by = hist.groupBy("cluster").agg(F.sum("n").alias("size"), F.max("n").alias("top"))
    return by.select("cluster", "size", (F.col("top") / F.col("size")).alias("purity"))


def purity_summary(pairs: DataFrame, mixed_below: float = 0.8) -> DataFrame:
    """One row: clusters, unweighted mean purity (0 without clusters), mixed clusters and their share (null
    without clusters), noise points and their share (null without points)."""
    clusters = purity(histogram(pairs)).agg(
        F.count(F.lit(1)).alias("clusters"), F.coalesce(F.avg("purity"), F.lit(0.0)).alias("avg_purity"), F.count_if(F.col("purity") < mixed_below).alias("mixed")
    )
    noise = pairs.agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("cluster") < 0).alias("noise"))
    both = clusters.crossJoin(noise)  # one row each
    return both.select(
        "clusters", "avg_purity", "mixed", (F.col("mixed") / F.nullif(F.col("clusters"), F.lit(0))).alias("mixed_share"), "noise", (F.col("noise") / F.nullif(F.col("points"), F.lit(0))).alias("noise_share")
    )


def mapped(pairs: DataFrame) -> DataFrame:
    """(point_id, gt, pred): clusters replaced by their majority class, noise by 0."""
    best = majority_classes(histogram(pairs))
    return pairs.join(best, "cluster", "left").select("point_id", "gt", F.coalesce("class", F.lit(0)).alias("pred"))


def distribution(pairs: DataFrame, side: str = "gt") -> DataFrame:
    """(class, n, share) of the classes present."""
    counts = pairs.groupBy(F.col(side).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(total).select("class", "n", (F.col("n") / F.col("t")).alias("share"))


def confusion(spark: SparkSession, pred: DataFrame, num_classes: int = 9) -> DataFrame:
    """CONFUSION in long form over all num_classes x num_classes cells; pairs outside 0..num_classes-1 are dropped."""
    axis = spark.range(num_classes)
    spine = axis.select(F.col("id").alias("gt")).crossJoin(axis.select(F.col("id").alias("pred")))
    counts = pred.where(F.col("gt").between(0, num_classes - 1) & F.col("pred").between(0, num_classes - 1)).groupBy("gt", "pred").agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, ["gt", "pred"], "left").select("gt", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_iou(matrix: DataFrame) -> DataFrame:
    """(class, tp, n_gt, n_pred, iou); 0 for a class that neither side has."""
    rows = matrix.groupBy(F.col("gt").alias("class")).agg(F.sum("n").alias("n_gt"), F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    cols = matrix.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("n_pred"))
    both = rows.join(cols, "class")
    return both.select("class", "tp", "n_gt", "n_pred", safe_ratio(F.col("tp"), F.col("n_gt") + F.col("n_pred") - F.col("tp")).alias("iou"))


def mean_iou(matrix: DataFrame) -> DataFrame:
    """One row: mean IoU over classes 1 and up (absent classes count as 0) and overall accuracy (0 without points)."""
    miou = class_iou(matrix).where("class >= 1").agg(F.coalesce(F.avg("iou"), F.lit(0.0)).alias("mean_iou"))
    acc = matrix.agg(safe_ratio(F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    return miou.crossJoin(acc)  # one row each
