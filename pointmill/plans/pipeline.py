"""Whole runs: segmentation of a cloud, and the downsample - segment - transfer - score experiment."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.config import SegmentationConfig
from pointmill.operators import bounds, evaluate, features, graph, labels, merge, neighbors
from pointmill.workspace import Workspace


class Timer:
    """Seconds since the last start."""

    def __init__(self) -> None:
        self.start()

    def start(self) -> None:
        self._at = time.perf_counter()

    def elapsed(self) -> float:
        return time.perf_counter() - self._at

    def elapsed_ms(self) -> float:
        return 1000 * self.elapsed()

    def restart(self) -> float:
        """Start anew and return the seconds so far."""
        got = self.elapsed()
        self.start()
        return got


@dataclass
class Segmentation:
    """Tables of a run; seconds by stage, each stage ending with the write of its table."""

    features: DataFrame
    edges: DataFrame
    threshold: float
    roots: DataFrame
    labels: DataFrame
    seconds: dict[str, float] = field(default_factory=dict)


def segment(spark: SparkSession, points: DataFrame, cfg: SegmentationConfig = SegmentationConfig()) -> Segmentation:
    """Features, graph, threshold, merge and dense labels of POINTS (optionally with a ``size`` column).

    Points are joined within the radius once for the features and once, with the features on board, for the edges:
    points travel in a few copies each, pairs never leave the task that finds them but as sums or finished edges.
    """
    ws, t, secs = Workspace(spark, "segment"), Timer(), {}
    kept, _ = ws.keep(points.select("point_id", "x", "y", "z", *[c for c in ("size",) if c in points.columns]))
    secs["points"] = t.restart()
    feats = features.surface_features(kept, cfg.normal_radius, cfg.inclusive)
    if "size" in kept.columns:
        feats = feats.join(kept.select("point_id", "size"), "point_id")
    feats, _ = ws.keep(feats)
    threshold = features.curvature_threshold(feats, cfg.curvature_percentile)
    secs["features"] = t.restart()
    edges = graph.build_edges(feats, cfg.search_radius, cfg.angle_weight, cfg.curvature_weight, cfg.inclusive)
    secs["graph"] = t.restart()
    verts = graph.vertices(feats)
    roots = merge.merge_components(spark, verts, edges, threshold, cfg)
    secs["merge"] = t.restart()
    lab, _ = ws.keep(labels.dense_labels(roots.select("point_id", "root")))
    secs["labels"] = t.restart()
    return Segmentation(feats, edges, threshold, roots, lab, secs)


def fidelity(points: DataFrame) -> DataFrame:
    """Coordinates as they are after a text file with six decimals and a single-precision reader."""
    return points.withColumns({c: F.round(c, 6).cast("float").cast("double") for c in "xyz"})


@dataclass
class Experiment:
    labels: DataFrame
    mapped: DataFrame
    scores: DataFrame
    class_scores: DataFrame
    purity: DataFrame
    distribution: DataFrame
    thinned: DataFrame | None = None
    thin_labels: DataFrame | None = None


def score(spark: SparkSession, truth: DataFrame, final: DataFrame, cfg: SegmentationConfig) -> Experiment:
    """Score LABELS against TRUTH; both must have the same number of points."""
    neighbors.require_same_length(truth, final, "ground truth and prediction")
    pairs = evaluate.paired(truth, final)
    best = evaluate.mapped(pairs)
    matrix = evaluate.confusion(spark, best, cfg.num_classes)
    return Experiment(final, best, evaluate.mean_iou(matrix), evaluate.class_iou(matrix), evaluate.purity_summary(pairs), evaluate.distribution(pairs))


def experiment(spark: SparkSession, raw: DataFrame, truth: DataFrame, cfg: SegmentationConfig = SegmentationConfig(), predicted: DataFrame | None = None, as_files: bool = False) -> Experiment:
    """Thin the raw cloud, segment it, carry the labels back to every raw point and score them.

    ``predicted`` (LABELS of the thinned cloud) skips the segmentation.  ``as_files`` gives coordinates the rounding
    they would have after a text file between the steps.
    """
    thin = bounds.voxel_downsample(raw, cfg.voxel_size).drop("size")
    thin = fidelity(thin) if as_files else thin
    ws = Workspace(spark, "experiment")
    thin, _ = ws.keep(thin)
    lab = segment(spark, thin, cfg).labels if predicted is None else predicted
    neighbors.require_same_length(thin, lab, "thinned cloud and labels")
    centers = thin.join(lab, "point_id")
    final = neighbors.nearest_label(spark, raw, centers, "segment_id", cfg.voxel_size * 3**0.5).withColumnRenamed("label", "segment_id")
    return replace(score(spark, truth, ws.keep(final)[0], cfg), thinned=thin, thin_labels=lab)
