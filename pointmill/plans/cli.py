"""Command line: segment, downsample, evaluate, experiment, visualize.

    python -m pointmill.plans.cli segment IN OUT [--normal_radius R] [--search_radius R] [--angle_threshold A] [--curvature_percentile Q]
    python -m pointmill.plans.cli downsample IN OUT [--voxel_size S]
    python -m pointmill.plans.cli evaluate TRUTH PREDICTED [--output_mapped_file F]
    python -m pointmill.plans.cli experiment [RAW TRUTH RESULTS] [--scene_name S] [--data_root D] [--eval_only] [--no-visualize]
    python -m pointmill.plans.cli visualize RAW TRUTH OUT

Label, cloud and visualisation files come out as single files.  Wrong usage, an input without points, a missing
prediction and files of different length end with exit code 1.
"""

from __future__ import annotations

import argparse
import math
import sys
from typing import NoReturn

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.config import CLASS_NAMES, SegmentationConfig
from pointmill.operators import bounds, features, graph, merge, neighbors
from pointmill.plans import pipeline
from pointmill.sources import points as io

SCENE = ["x", "y", "z", "intensity", "r", "g", "b"]


class Parser(argparse.ArgumentParser):
    def error(self, message: str) -> NoReturn:
        self.print_usage(sys.stderr)
        self.exit(1, f"{self.prog}: {message}\n")


def parser() -> argparse.ArgumentParser:
    top = Parser(prog="pointmill")
    sub = top.add_subparsers(dest="command", required=True)
    d = SegmentationConfig()
    s = sub.add_parser("segment", help="segment a text cloud and write one label per line")
    s.add_argument("input")
    s.add_argument("output")
    s.add_argument("--normal_radius", type=float, default=d.normal_radius)
    s.add_argument("--search_radius", type=float, default=d.search_radius)
    s.add_argument("--angle_threshold", type=float, default=d.angle_threshold)
    s.add_argument("--curvature_percentile", type=int, default=d.curvature_percentile)
    v = sub.add_parser("downsample", help="thin a cloud to one mean point per voxel")
    v.add_argument("input")
    v.add_argument("output")
    v.add_argument("--voxel_size", type=float, default=0.1)
    e = sub.add_parser("evaluate", help="score a label file against ground truth")
    e.add_argument("truth")
    e.add_argument("predicted")
    e.add_argument("--output_mapped_file")
    x = sub.add_parser("experiment", help="thin, segment, transfer and score a raw scene")
    x.add_argument("raw", nargs="?")
    x.add_argument("truth", nargs="?")
    x.add_argument("results", nargs="?")
    x.add_argument("--scene_name", default="marketsquarefeldkirch4-reduced", help="names the files below --data_root if no RAW is given")
    x.add_argument("--data_root", default="data")
    x.add_argument("--eval_only", action="store_true", help="skip thinning and segmentation, use the labels of an earlier run in RESULTS")
    x.add_argument("--no-visualize", action="store_true")
    z = sub.add_parser("visualize", help="write a raw scene with its ground truth")
    z.add_argument("raw")
    z.add_argument("truth")
    z.add_argument("output")
    return top


def report(result: pipeline.Experiment) -> None:
    s, p = result.scores.first(), result.purity.first()
    share = 0.0 if p.noise_share is None else p.noise_share
    mixed = "" if p.mixed_share is None else f" ({p.mixed_share:.1%})"
    print(f"clusters {p.clusters}, average purity {p.avg_purity:.2%}, mixed {p.mixed}/{p.clusters}{mixed}, noise {p.noise} ({share:.2%})")
    for r in sorted(result.distribution.collect(), key=lambda r: r["class"]):  # at most one row a class
        print(f"ground truth {CLASS_NAMES.get(r['class'], r['class'])}: {r.n} points ({r.share:.2%})")
    for r in sorted(result.class_scores.collect(), key=lambda r: r["class"]):
        print(f"{CLASS_NAMES.get(r['class'], r['class'])}: IoU {r.iou:.4f}")
    print(f"mean IoU {s.mean_iou:.4f}, accuracy {s.accuracy:.4f}")


def _segment(spark: SparkSession, args: argparse.Namespace) -> None:
    cloud, rejects = io.read_xyz(spark, args.input)
    if cloud.isEmpty():
        raise ValueError(f"no points in {args.input}")
    cfg = SegmentationConfig(args.normal_radius, args.search_radius, args.angle_threshold, args.curvature_percentile)
    run = pipeline.segment(spark, cloud, cfg)
    io.write_labels(run.labels, args.output, of=run.features, single=True)
    stats, graph_row = features.curvature_stats(run.features).first(), graph.graph_stats(run.features, run.edges).first()
    print(f"skipped lines {rejects.count()}, curvature {stats.asDict()}, threshold {run.threshold:.6g}, angle {math.degrees(cfg.angle_threshold):.1f} degrees")
    print(f"graph {graph_row.asDict()}, segments {run.labels.select('segment_id').distinct().count()}")
    print(f"merge {merge.merge_metrics(run.roots).first().asDict()}")
    print("seconds " + ", ".join(f"{k} {t:.2f} ({t / max(1e-9, sum(run.seconds.values())):.0%})" for k, t in run.seconds.items()))


def _experiment(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.raw and not (args.truth and args.results):
        raise ValueError("experiment needs RAW, TRUTH and RESULTS, or none of them")
    base = f"{args.data_root}/raw/semantic3d/{args.scene_name}"
    raw_path, truth_path, results = (args.raw, args.truth, args.results) if args.raw else (f"{base}.txt", f"{base}.labels", f"{args.data_root}/results")
    out = f"{results}/{args.raw.rstrip('/').split('/')[-1].rsplit('.', 1)[0] if args.raw else args.scene_name}"
    raw, truth = io.read_matrix(spark, raw_path, ["x", "y", "z"]), io.read_labels(spark, truth_path, "class_id")
    thin_path = f"{out}_downsampled_predicted.labels"
    if args.eval_only and not io.exists(spark, thin_path):
        raise ValueError(f"{thin_path} is missing: run without --eval_only first")
    result = pipeline.experiment(spark, raw, truth, predicted=io.read_labels(spark, thin_path, "segment_id") if args.eval_only else None, as_files=True)
    report(result)
    if not args.eval_only:
        io.write_xyz(result.thinned, f"{out}_downsampled.txt", single=True)
        io.write_labels(result.thin_labels, thin_path, of=result.thinned, single=True)
    io.write_labels(result.labels, f"{out}_final_predicted.labels", of=raw, single=True)
    io.write_labels(result.mapped, f"{out}_final_mapped.labels", "pred", of=raw, single=True)
    if not args.no_visualize:
        _lines(io.visualization_lines(result.thinned, result.thin_labels), f"{out}_raw_clusters_visualization.txt")
        _lines(io.visualization_lines(raw, result.mapped, "pred"), f"{out}_semantic_visualization.txt")


def _lines(df: DataFrame, path: str) -> None:
    io.write_lines(df, F.col("line"), path, single=True)


def run(args: argparse.Namespace) -> None:
    spark = SparkSession.builder.appName("pointmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "segment":
        _segment(spark, args)
    elif args.command == "downsample":
        cloud = io.read_matrix(spark, args.input, ["x", "y", "z"])
        io.write_xyz(bounds.voxel_downsample(cloud, args.voxel_size), args.output, single=True)
    elif args.command == "evaluate":
        truth, pred = io.read_labels(spark, args.truth, "class_id"), io.read_labels(spark, args.predicted, "segment_id")
        result = pipeline.score(spark, truth, pred, SegmentationConfig())
        report(result)
        if args.output_mapped_file:
            io.write_labels(result.mapped, args.output_mapped_file, "pred", of=truth, single=True)
    elif args.command == "experiment":
        _experiment(spark, args)
    else:
        raw, truth = io.read_matrix(spark, args.raw, SCENE), io.read_labels(spark, args.truth, "class_id")
        neighbors.require_same_length(raw, truth, "cloud and ground truth")
        _lines(io.truth_lines(raw, truth), args.output)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        run(args)
    except ValueError as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
