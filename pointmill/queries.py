"""Queries over the driver's tables, and the same in SQL for comparison.

Clouds: EMB (embeddings: vec_id and the first three components), LINE (lineitem: quantity, 100 discount, 100 tax)
and CLOUD (features: one row per point with a finite position).  Scoring uses all runs of predictions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.config import SegmentationConfig
from pointmill.functions.ranks import index_percentiles, number_rows
from pointmill.functions.vector import finite
from pointmill.operators import bounds, components, evaluate, features, graph, labels, merge, neighbors
from pointmill.operators.tree_aggregate import segment_majority
from pointmill.sources import points as sources
from pointmill.sources.raw_lines import failing_lines, parse_lines
from pointmill.workspace import Workspace

Query = Callable[[SparkSession, str], DataFrame]

R_EMB = 0.1
R_CLOUD = 0.5
VOXEL = 2.0
CFG = SegmentationConfig(normal_radius=R_EMB, search_radius=R_EMB)
CLOUD_CFG = SegmentationConfig()


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def emb(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("point_id"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])


def line(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"))


def cloud(spark: SparkSession, sf: str) -> DataFrame:
    """One row per point of features with a finite position; renewed deliveries of a point drop out."""
    f = read(spark, sf, "features").select("point_id", "x", "y", "z")
    ok = finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z"))
    return f.where(ok).groupBy("point_id").agg(F.min(F.struct("x", "y", "z")).alias("p")).select("point_id", "p.*")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _emb_features(spark: SparkSession, sf: str) -> DataFrame:
    return Workspace(spark, "emb").keep(features.surface_features(emb(spark, sf), R_EMB))[0]


def _cloud_features(spark: SparkSession, sf: str) -> DataFrame:
    return Workspace(spark, "cloud").keep(features.surface_features(cloud(spark, sf), R_CLOUD))[0]


def bounds_line(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bounds.bounds(line(spark, sf)))


def spacing_line(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bounds.spacing(line(spark, sf)))


def bounds_cloud(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bounds.bounds(cloud(spark, sf)))


def voxel_downsample_line(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bounds.voxel_downsample(line(spark, sf), 3.0))


def voxel_counts_line(spark: SparkSession, sf: str) -> DataFrame:
    return bounds.voxel_means(line(spark, sf), 3.0).select("vx", "vy", "vz", "n")


def voxel_downsample_cloud(spark: SparkSession, sf: str) -> DataFrame:
    # Means of six-digit numbers often end in a 5; the small shift keeps both engines' rounding apart from it.
    down = bounds.voxel_downsample(cloud(spark, sf), VOXEL)
    return rounded(down.withColumns({c: F.col(c) + F.lit(3.1e-7) for c in "xyz"}), 5)


def radius_pairs_emb(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(neighbors.radius_pairs(emb(spark, sf), R_EMB), 9)


def radius_pairs_cloud(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(neighbors.radius_pairs(cloud(spark, sf), R_CLOUD))


def radius_degree_emb(spark: SparkSession, sf: str) -> DataFrame:
    pts = emb(spark, sf)
    return neighbors.degrees(pts, neighbors.radius_pairs(pts, R_EMB))


def local_covariance_emb(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.covariances(emb(spark, sf), R_EMB).select("point_id", "n_neighbors", "xx", "yy", "zz", "xy", "xz", "yz"), 9)


def curvature_emb(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_emb_features(spark, sf).select("point_id", "n_neighbors", "curvature"))


def curvature_cloud(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_cloud_features(spark, sf).select("point_id", "n_neighbors", "curvature"))


def normals_emb(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_emb_features(spark, sf).select("point_id", "nx", "ny", "nz"), 4)


def curvature_stats_emb(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.curvature_stats(_emb_features(spark, sf)))


def curvature_threshold_emb(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(index_percentiles(_emb_features(spark, sf), F.col("curvature"), [98]).select(F.col("value").alias("threshold")))


def curvature_percentiles_features(spark: SparkSession, sf: str) -> DataFrame:
    """Index percentiles of the curvature column as delivered, finite values of each point once."""
    f = read(spark, sf, "features").where(finite(F.col("curvature"))).groupBy("point_id").agg(F.min("curvature").alias("c"))
    return rounded(index_percentiles(f, F.col("c"), [0, 50, 95, 98, 99, 100]), 9)


def edge_weights_emb(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.build_edges(_emb_features(spark, sf), R_EMB).select("edge_id", "src", "dst", "weight"), 4)


def edge_weights_legacy_emb(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.build_edges(_emb_features(spark, sf), R_EMB, curvature_weight=0.0).select("edge_id", "src", "dst", "weight"), 4)


def _flat_edges(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    f = _emb_features(spark, sf)
    return f, graph.build_edges(f, R_EMB)


def pruned_edges_emb(spark: SparkSession, sf: str) -> DataFrame:
    f, e = _flat_edges(spark, sf)
    return graph.mergeable_edges(e, f, features.curvature_threshold(f, 95)).select("src", "dst")


def angle_gated_edges_emb(spark: SparkSession, sf: str) -> DataFrame:
    f, e = _flat_edges(spark, sf)
    return graph.smooth_edges(e, f, CFG.angle_threshold, features.curvature_threshold(f)).select("src", "dst")


def components_emb(spark: SparkSession, sf: str) -> DataFrame:
    pts = emb(spark, sf)
    return components.connected_components(spark, pts, neighbors.radius_pairs(pts, R_EMB))


def components_cloud(spark: SparkSession, sf: str) -> DataFrame:
    pts = cloud(spark, sf)
    return components.connected_components(spark, pts, neighbors.radius_pairs(pts, R_CLOUD))


def smooth_components_emb(spark: SparkSession, sf: str) -> DataFrame:
    f, e = _flat_edges(spark, sf)
    return components.connected_components(spark, f, graph.smooth_edges(e, f, CFG.angle_threshold, features.curvature_threshold(f)))


def dense_relabel_emb(spark: SparkSession, sf: str) -> DataFrame:
    return labels.dense_labels(components_emb(spark, sf).toDF("point_id", "root"))


def segment_sizes_emb(spark: SparkSession, sf: str) -> DataFrame:
    return labels.segment_sizes(dense_relabel_emb(spark, sf))


def segment_count_emb(spark: SparkSession, sf: str) -> DataFrame:
    return labels.count_segments(dense_relabel_emb(spark, sf))


def average_degree_emb(spark: SparkSession, sf: str) -> DataFrame:
    pts = emb(spark, sf)
    return rounded(graph.graph_stats(pts, neighbors.radius_pairs(pts, R_EMB)))


def active_counts_emb(spark: SparkSession, sf: str) -> DataFrame:
    pts = emb(spark, sf)
    roots = components_emb(spark, sf).toDF("point_id", "root")
    return labels.active_counts(roots, neighbors.radius_pairs(pts, R_EMB))


def first_active_emb(spark: SparkSession, sf: str) -> DataFrame:
    return labels.first_active(components_emb(spark, sf).toDF("point_id", "root"))


def adjacency_emb(spark: SparkSession, sf: str) -> DataFrame:
    return graph.adjacency(edge_weights_emb(spark, sf)).select("point_id", "degree", F.array_join(F.transform("edge_ids", lambda e: e.cast("string")), ",").alias("edge_ids"))


def _merged(spark: SparkSession, f: DataFrame, cfg: SegmentationConfig) -> DataFrame:
    e = graph.build_edges(f, cfg.search_radius, cfg.angle_weight, cfg.curvature_weight)
    return merge.merge_components(spark, graph.vertices(f), e, features.curvature_threshold(f, cfg.curvature_percentile), cfg)


def greedy_merge_emb(spark: SparkSession, sf: str) -> DataFrame:
    return labels.dense_labels(_merged(spark, _emb_features(spark, sf), CFG).select("point_id", "root"))


SWEEP = (0.1, 0.2, 0.4, 0.8)
LEGACY = replace(CFG, gates=False, curvature_weight=0.0, stop_weight=0.3)


def greedy_merge_legacy_emb(spark: SparkSession, sf: str) -> DataFrame:
    return labels.dense_labels(_merged(spark, _emb_features(spark, sf), LEGACY).select("point_id", "root"))


def threshold_sweep_emb(spark: SparkSession, sf: str) -> DataFrame:
    f = _emb_features(spark, sf)
    runs = [merge.merge_metrics(_merged(spark, f, replace(LEGACY, stop_weight=t))).select(F.lit(t).alias("threshold"), "points", "segments", "merges") for t in SWEEP]
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


def merge_metrics_emb(spark: SparkSession, sf: str) -> DataFrame:
    return merge.merge_metrics(_merged(spark, _emb_features(spark, sf), CFG))


def region_table_emb(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(merge.region_table(_merged(spark, _emb_features(spark, sf), CFG)), 4)


def merge_levels_emb(spark: SparkSession, sf: str) -> DataFrame:
    """greedy_merge_emb as for a component that is too large for one task."""
    cfg = replace(CFG, max_component=420, bundle_edges=400, level_share=0.2)
    return labels.dense_labels(_merged(spark, _emb_features(spark, sf), cfg).select("point_id", "root"))


def segmentation_cloud(spark: SparkSession, sf: str) -> DataFrame:
    """Features, graph, threshold and merge of the whole cloud with the default parameters."""
    from pointmill.plans.pipeline import segment

    return segment(spark, cloud(spark, sf), CLOUD_CFG).labels


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """All predictions (run, point) beside their class; repeated deliveries once."""
    truth = read(spark, sf, "point_classes").where("class_id is not null").groupBy("point_id").agg(F.min("class_id").alias("class_id"))
    return evaluate.paired(truth, read(spark, sf, "predictions").select("run_id", "point_id", "segment_id").distinct())


def cluster_class_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.histogram(_scored(spark, sf))


def majority_class(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.majority_classes(evaluate.histogram(_scored(spark, sf)))


def cluster_purity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.purity(evaluate.histogram(_scored(spark, sf))))


def purity_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.purity_summary(_scored(spark, sf)))


def gt_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.distribution(_scored(spark, sf)))


def mapped_labels(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.mapped(_scored(spark, sf)).groupBy("point_id", "gt", "pred").agg(F.count(F.lit(1)).alias("runs"))


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion(spark, evaluate.mapped(_scored(spark, sf)))


def per_class_iou(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.class_iou(confusion_matrix(spark, sf)))


def mean_iou(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.mean_iou(confusion_matrix(spark, sf)).select("mean_iou"))


def overall_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.mean_iou(confusion_matrix(spark, sf)).select("accuracy"))


def nn_label_transfer_cloud(spark: SparkSession, sf: str) -> DataFrame:
    """Each point's nearest voxel mean."""
    pts = cloud(spark, sf)
    centers = bounds.voxel_downsample(pts, VOXEL).withColumn("label", F.col("point_id"))
    return neighbors.nearest_label(spark, pts, centers, "label", VOXEL * 3**0.5)


def nn_label_transfer_line(spark: SparkSession, sf: str) -> DataFrame:
    """Each lattice point of LINE, numbered in its order, beside its nearest voxel mean."""
    pts = number_rows(line(spark, sf).distinct(), ["x", "y", "z"], "point_id")
    centers = bounds.voxel_downsample(pts.select("x", "y", "z"), 3.0).withColumn("label", F.col("point_id"))
    return neighbors.nearest_label(spark, pts, centers, "label", 3.0 * 3**0.5)


def zip_visualization(spark: SparkSession, sf: str) -> DataFrame:
    lab = read(spark, sf, "point_classes").where("class_id is not null").groupBy("point_id").agg(F.min("class_id").alias("class_id"))
    return sources.visualization_lines(cloud(spark, sf), lab, "class_id")


def xyz_text_parse(spark: SparkSession, sf: str) -> DataFrame:
    """The whitespace reader's rule applied to every line of raw_lines."""
    rows = read(spark, sf, "raw_lines").where(F.col("line").isNotNull() & ~sources.skipped(F.col("line")))
    x, y, z = sources.parse_xyz(F.col("line"))
    return rows.select("line_id", x.alias("x"), y.alias("y"), z.alias("z"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return failing_lines(read(spark, sf, "raw_lines"))


def p2_points(spark: SparkSession, sf: str) -> DataFrame:
    """The valid lines as typed points."""
    return parse_lines(read(spark, sf, "raw_lines")).where("reason is null").drop("reason", "line")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return segment_majority(read(spark, sf, "predictions"), read(spark, sf, "point_classes"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        bounds_line, spacing_line, bounds_cloud, voxel_downsample_line, voxel_counts_line, voxel_downsample_cloud, radius_pairs_emb, radius_pairs_cloud, radius_degree_emb,
        local_covariance_emb, curvature_emb, curvature_cloud, normals_emb, curvature_stats_emb, curvature_threshold_emb, curvature_percentiles_features, edge_weights_emb,
        edge_weights_legacy_emb, pruned_edges_emb, angle_gated_edges_emb, components_emb, components_cloud, smooth_components_emb, dense_relabel_emb, segment_sizes_emb,
        segment_count_emb, average_degree_emb, active_counts_emb, first_active_emb, adjacency_emb, greedy_merge_emb, greedy_merge_legacy_emb, threshold_sweep_emb, merge_metrics_emb,
        region_table_emb, merge_levels_emb, segmentation_cloud, cluster_class_histogram, majority_class, cluster_purity, purity_summary, gt_distribution, mapped_labels,
        confusion_matrix, per_class_iou, mean_iou, overall_accuracy, nn_label_transfer_cloud, nn_label_transfer_line, zip_visualization, xyz_text_parse, p2_found, p2_points, p6_found,
    )
}

# ---------------------------------------------------------------------------------------------- SQL

_EMB = "emb AS (SELECT vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
_LINE = "line AS (SELECT l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z FROM lineitem)"
_CLOUD = """cloud AS (SELECT point_id, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z FROM features
  WHERE isfinite(x) AND isfinite(y) AND isfinite(z) GROUP BY point_id)"""


def _pairs(source: str, r: float) -> str:
    return f"""pairs AS MATERIALIZED (
  SELECT a.point_id AS src, b.point_id AS dst, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2
  FROM {source} a JOIN {source} b ON a.point_id < b.point_id
  WHERE (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= {r * r!r})"""


def _features(source: str) -> str:
    return f"""halves AS (SELECT src AS p, dst AS q FROM pairs UNION ALL SELECT dst, src FROM pairs UNION ALL SELECT point_id, point_id FROM {source}),
offs AS (SELECT p.point_id, q.x - p.x AS dx, q.y - p.y AS dy, q.z - p.z AS dz FROM halves h JOIN {source} p ON p.point_id = h.p JOIN {source} q ON q.point_id = h.q),
cov AS (SELECT point_id, count(*) AS n, covar_pop(dx, dx) AS a, covar_pop(dy, dy) AS b, covar_pop(dz, dz) AS c,
  covar_pop(dx, dy) AS d, covar_pop(dx, dz) AS e, covar_pop(dy, dz) AS f FROM offs GROUP BY point_id),
e1 AS (SELECT *, (a+b+c)/3 AS m, sqrt((pow(a-(a+b+c)/3,2) + pow(b-(a+b+c)/3,2) + pow(c-(a+b+c)/3,2) + 2*(d*d+e*e+f*f))/6) AS s FROM cov),
e2 AS (SELECT *, CASE WHEN s = 0 THEN m ELSE m + 2*s*cos(acos(greatest(-1, least(1,
  (((a-m)/s)*(((b-m)/s)*((c-m)/s) - (f/s)*(f/s)) - (d/s)*((d/s)*((c-m)/s) - (f/s)*(e/s)) + (e/s)*((d/s)*(f/s) - ((b-m)/s)*(e/s)))/2)))/3 + 2*pi()/3) END AS l FROM e1),
rws AS (SELECT *, [a-l, d, e] AS r1, [d, b-l, f] AS r2, [e, f, c-l] AS r3 FROM e2),
crs AS (SELECT *, list_cross_product(r1::DOUBLE[3], r2::DOUBLE[3]) AS p1, list_cross_product(r1::DOUBLE[3], r3::DOUBLE[3]) AS p2, list_cross_product(r2::DOUBLE[3], r3::DOUBLE[3]) AS p3 FROM rws),
pick AS (SELECT *, CASE WHEN list_inner_product(p1, p1) >= greatest(list_inner_product(p2, p2), list_inner_product(p3, p3)) THEN p1
  WHEN list_inner_product(p2, p2) >= list_inner_product(p3, p3) THEN p2 ELSE p3 END AS v FROM crs),
unit AS (SELECT k.*, g.x, g.y, g.z, v[1]/sqrt(list_inner_product(v, v)) AS ux, v[2]/sqrt(list_inner_product(v, v)) AS uy, v[3]/sqrt(list_inner_product(v, v)) AS uz
  FROM pick k JOIN {source} g USING (point_id)),
feat AS MATERIALIZED (SELECT point_id, n AS n_neighbors, x, y, z,
  CASE WHEN n < 3 OR isnan(ux) THEN 0 WHEN ux*x + uy*y + uz*z > 0 THEN -ux ELSE ux END AS nx,
  CASE WHEN n < 3 OR isnan(ux) THEN 0 WHEN ux*x + uy*y + uz*z > 0 THEN -uy ELSE uy END AS ny,
  CASE WHEN n < 3 OR isnan(ux) THEN 1 WHEN ux*x + uy*y + uz*z > 0 THEN -uz ELSE uz END AS nz,
  CASE WHEN n < 3 OR m = 0 THEN 0 ELSE abs(l/(3*m)) END AS curvature FROM unit)""".replace("list_cross_product", "array_cross_product").replace("list_inner_product", "array_inner_product")


_EDGES = """edges0 AS MATERIALIZED (SELECT p.src, p.dst, sqrt(p.d2) AS dist, acos(greatest(-1, least(1, a.nx*b.nx + a.ny*b.ny + a.nz*b.nz))) AS ang,
  greatest(a.curvature, b.curvature) AS curv FROM pairs p JOIN feat a ON a.point_id = p.src JOIN feat b ON b.point_id = p.dst)"""
_EF = f"WITH RECURSIVE {_EMB}, {_pairs('emb', R_EMB)}, {_features('emb')}"


def _threshold(q: int) -> str:
    return f"thr AS MATERIALIZED (SELECT list_sort(list(curvature))[least(count(*) * {q} // 100, count(*) - 1) + 1] AS t FROM feat)"


def _reach(links: str, source: str) -> str:
    """Components by recursion with one row per vertex."""
    return f"""ways AS (SELECT src AS u, dst AS v FROM {links} UNION ALL SELECT dst, src FROM {links}),
reach(point_id, component) USING KEY (point_id) AS (
  SELECT point_id, point_id FROM {source}
  UNION
  SELECT w.v, min(r.component) FROM reach r JOIN ways w ON w.u = r.point_id JOIN recurring.reach o ON o.point_id = w.v
  WHERE r.component < o.component GROUP BY w.v)"""


_NO = ", ".join(["NULL::DOUBLE"] * 8)


def _merge(curvature_weight: float = 1.0, stop: float | None = None, gates: bool = True, name: str = "st") -> str:
    """The sequential merge without the edges of too curved points, one pop per recursion step, over keyed rows: edges (kind 0: ends l and r, weight, in the queue, live),
    points (kind 1: l is the root, roots are live and have attributes) and counters (kind 2, in w: merges, skipped, rejects by angle and curvature)."""
    ang = "acos(greatest(-1, least(1, {p}.nx*{q}.nx + {p}.ny*{q}.ny + {p}.nz*{q}.nz)))"
    weight = f"sqrt((v.x-c.x)*(v.x-c.x) + (v.y-c.y)*(v.y-c.y) + (v.z-c.z)*(v.z-c.z)) + 0.5 * {ang.format(p='v', q='c')}" + (" + greatest(v.cur, c.cur)" if curvature_weight else "")
    turned, bent = (f"{ang.format(p='va', q='vb')} > {CFG.angle_threshold}", "greatest(va.cur, vb.cur) > t.t") if gates else ("FALSE", "FALSE")
    now, due = f"recurring.{name}", f"AND w <= {stop}" if stop else ""
    return f"""numbered_{name} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS id, src, dst, dist + 0.5 * ang{' + curv' if curvature_weight else ''} AS w, curv FROM edges0),
{name}(kind, id, l, r, w, q, live, size, x, y, z, nx, ny, nz, cur) USING KEY (kind, id) AS (
  SELECT 0, id, src, dst, w, TRUE, TRUE, {_NO} FROM numbered_{name} {'WHERE curv <= (SELECT t FROM thr)' if gates else ''}
  UNION ALL SELECT 1, point_id, point_id, NULL, NULL, FALSE, TRUE, 1.0, x, y, z, nx, ny, nz, curvature FROM feat
  UNION ALL SELECT 2, range, NULL, NULL, 0, FALSE, FALSE, {_NO} FROM range(4)
  UNION
  (WITH e AS (SELECT id, l, r, w, q FROM {now} WHERE kind = 0 AND q AND live {due} ORDER BY w, id LIMIT 1),
   g AS (SELECT e.id, e.l AS a, e.r AS b, e.w, {turned} AS turned, {bent} AS bent, va.size + vb.size AS n, va.size / (va.size + vb.size) AS f, vb.size / (va.size + vb.size) AS h, va, vb
     FROM e JOIN {now} va ON va.kind = 1 AND va.id = e.l JOIN {now} vb ON vb.kind = 1 AND vb.id = e.r, thr t),
   m AS (SELECT *, f*va.x + h*vb.x AS x, f*va.y + h*vb.y AS y, f*va.z + h*vb.z AS z, f*va.nx + h*vb.nx AS px, f*va.ny + h*vb.ny AS py, f*va.nz + h*vb.nz AS pz, va.cur AS cur FROM g WHERE NOT turned AND NOT bent),
   k AS (SELECT *, CASE WHEN sqrt(px*px + py*py + pz*pz) > 1e-10 THEN sqrt(px*px + py*py + pz*pz) ELSE 1 END AS len FROM m),
   v AS (SELECT id, a, b, n, x, y, z, px/len AS nx, py/len AS ny, pz/len AS nz, cur FROM k),
   moved AS (SELECT s.id, s.w, s.q, v.a, CASE WHEN s.l = v.b THEN s.r ELSE s.l END AS c, s.l = v.b AS at_left FROM v JOIN {now} s ON s.kind = 0 AND s.live AND s.id <> v.id AND (s.l = v.b OR s.r = v.b)),
   met AS (SELECT d.*, o.id AS rid, o.w AS rw, o.l AS rl, o.r AS rr, o.q AS rq FROM moved d LEFT JOIN {now} o ON o.kind = 0 AND o.live AND o.id <> d.id AND ((o.l = d.a AND o.r = d.c) OR (o.l = d.c AND o.r = d.a))),
   event AS (SELECT CASE WHEN turned THEN 2 WHEN bent THEN 3 ELSE 0 END AS id, 1 AS n FROM g
     UNION ALL SELECT 1, count(*) FILTER (CASE WHEN w < rw THEN rq {due.replace(' w ', ' rw ')} ELSE q {due} END) FROM met WHERE rid IS NOT NULL HAVING count(*) > 0)
   SELECT 0, id, a, b, w, FALSE, turned OR bent, {_NO} FROM g
   UNION ALL SELECT 1, s.id, v.a, NULL, NULL, FALSE, FALSE, s.size, s.x, s.y, s.z, s.nx, s.ny, s.nz, s.cur FROM v JOIN {now} s ON s.kind = 1 AND s.l = v.b
   UNION ALL SELECT 1, a, a, NULL, NULL, FALSE, TRUE, n, x, y, z, nx, ny, nz, cur FROM v
   UNION ALL SELECT 0, rid, rl, rr, rw, rq, FALSE, {_NO} FROM met WHERE w < rw
   UNION ALL SELECT 0, d.id, CASE WHEN at_left THEN d.a ELSE d.c END, CASE WHEN at_left THEN d.c ELSE d.a END, CASE WHEN d.w >= rw THEN d.w ELSE {weight} END, TRUE, rid IS NULL OR d.w < rw, {_NO}
     FROM met d JOIN v ON TRUE JOIN {now} c ON c.kind = 1 AND c.id = d.c
   UNION ALL SELECT 2, s.id, NULL, NULL, s.w + event.n, FALSE, FALSE, {_NO} FROM event JOIN {now} s ON s.kind = 2 AND s.id = event.id))"""


_DENSE = "SELECT id AS point_id, dense_rank() OVER (ORDER BY first) - 1 AS segment_id FROM (SELECT id, min(id) OVER (PARTITION BY l) AS first FROM st WHERE kind = 1)"


_SCORED = """truth AS (SELECT point_id, min(class_id)::BIGINT AS gt FROM point_classes WHERE class_id IS NOT NULL GROUP BY point_id),
scored AS (SELECT point_id, gt, segment_id AS cluster FROM (SELECT DISTINCT run_id, point_id, segment_id FROM predictions WHERE segment_id IS NOT NULL) JOIN truth USING (point_id)),
hist AS (SELECT cluster, gt, count(*) AS n FROM scored WHERE cluster >= 0 GROUP BY ALL),
best AS (SELECT cluster, gt AS class FROM hist QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, gt) = 1),
mapped AS (SELECT point_id, gt, coalesce(class, 0) AS pred FROM scored LEFT JOIN best USING (cluster)),
axis AS (SELECT range AS k FROM range(9)),
conf AS (SELECT g.k AS gt, p.k AS pred, count(m.gt) AS n FROM axis g CROSS JOIN axis p LEFT JOIN mapped m ON m.gt = g.k AND m.pred = p.k GROUP BY ALL),
iou AS (SELECT r.gt AS class, tp, n_gt, n_pred, CASE WHEN n_gt + n_pred - tp = 0 THEN 0.0 ELSE tp / (n_gt + n_pred - tp) END AS iou
  FROM (SELECT gt, sum(n)::BIGINT AS n_gt, (sum(n) FILTER (gt = pred))::BIGINT AS tp FROM conf GROUP BY gt) r
  JOIN (SELECT pred, sum(n)::BIGINT AS n_pred FROM conf GROUP BY pred) c ON r.gt = c.pred)"""
_NUM = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def _voxels(source: str, size: float) -> str:
    return f"""lo AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz FROM {source}),
vox AS (SELECT floor((x - (lx - {size / 2})) / {size})::BIGINT AS vx, floor((y - (ly - {size / 2})) / {size})::BIGINT AS vy, floor((z - (lz - {size / 2})) / {size})::BIGINT AS vz,
  avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n FROM {source}, lo GROUP BY 1, 2, 3),
down AS (SELECT row_number() OVER (ORDER BY vx, vy, vz) - 1 AS point_id, * FROM vox)"""


def _bounds(source: str) -> str:
    return "SELECT count(*) AS n, " + ", ".join(f"round({f}({c}), 6) + 0.0 AS {f}_{c}" for c in "xyz" for f in ("min", "max")) + f" FROM {source}"


_PERC = "min(v) FILTER (k = least(n * {q} // 100, n - 1))"

_FIELD = r'[ \t]*(?:"(?:[^"]|"")*"[ \t]*|[^",]*)'
_FIN = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_INT = r"[+-]?[0-9]+"


def _row(kinds: str, csv: bool) -> str:
    """SQL that is true where ``body`` has valid values of the kinds c, n, w, b, s (see sources/raw_lines.py)."""
    nums = [_INT if k in "wbs" else _FIN for k in kinds]
    comma, tail = ("," if csv else r"[ \t]+"), ("$" if csv or len(kinds) > 3 else r"(?:[ \t].*)?$")
    fields = [rf'[ \t]*(?:{n}|"{n}")[ \t]*' if csv else n for n in nums]
    plain = "^" + comma.join(rf"[ \t]*({n})[ \t]*" if csv else f"({n})" for n in nums) + tail
    tests = [f"regexp_matches(body, '^{comma.join(fields)}{tail}', 's')"]
    for i, k in enumerate(kinds):
        text = f"regexp_extract(replace(body, chr(34), ''), '{plain}', {i + 1}, 's')" if csv else f"regexp_extract(body, '{plain}', {i + 1}, 's')"
        low, high = {"n": ("-1", "1"), "b": ("0", "255"), "s": ("0", "1e300")}.get(k, ("-1.7976931348623157e308", "1.7976931348623157e308"))
        if k != "w":
            tests.append(f"coalesce(TRY_CAST({text} AS DOUBLE) BETWEEN {low} AND {high}, FALSE)")
    return " AND ".join(tests)


_P2 = rf"""WITH b AS (
  SELECT line_id, file_name, line_num, layout, rtrim(regexp_replace(trim(line, ' ' || chr(9)), '\r$', ''), ' ' || chr(9)) AS body
  FROM raw_lines WHERE line IS NOT NULL AND NOT starts_with(line, '#')),
c AS (SELECT *, layout IN ('csv6', 'csv7') AS csv FROM b WHERE body <> ''),
r AS (SELECT *, CASE
  WHEN csv AND NOT regexp_full_match(body, '{_FIELD}(?:,{_FIELD})*') THEN 'quoting'
  WHEN csv AND length(regexp_replace(regexp_replace(body, '"(?:[^"]|"")*"', '', 'g'), '[^,]', '', 'g')) + 1 <> CASE layout WHEN 'csv6' THEN 6 ELSE 7 END THEN 'columns'
  WHEN NOT csv AND (len(regexp_split_to_array(body, '[ \t]+')) < 3 OR (layout = 'scene7' AND len(regexp_split_to_array(body, '[ \t]+')) <> 7)) THEN 'columns'
  WHEN NOT CASE layout WHEN 'xyz' THEN {_row('ccc', False)} WHEN 'scene7' THEN {_row('cccwbbb', False)} WHEN 'csv6' THEN {_row('cccnnn', True)} ELSE {_row('cccnnns', True)} END THEN 'value'
  END AS reason FROM c)"""
_P2_POINTS = ", ".join(
    [f"TRY_CAST(f[{i}] AS DOUBLE) AS {c}" for i, c in enumerate("xyz", 1)]
    + [f"CASE WHEN csv THEN TRY_CAST(f[{i}] AS DOUBLE) END AS {c}" for i, c in enumerate(("nx", "ny", "nz"), 4)]
    + [f"CASE WHEN layout = 'scene7' THEN TRY_CAST(f[{i}] AS BIGINT) END AS {c}" for i, c in enumerate(("intensity", "r", "g", "b"), 4)]
    + ["CASE WHEN layout = 'csv7' THEN TRY_CAST(f[7] AS BIGINT) END AS segment_id"]
)

ORACLE: dict[str, str] = {
    "p2_found": f"{_P2} SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p2_points": rf"""{_P2},
f AS (SELECT line_id, file_name, line_num, layout, csv, CASE WHEN csv THEN list_transform(string_split(replace(body, chr(34), ''), ','), lambda t: trim(t, ' ' || chr(9))) ELSE regexp_split_to_array(body, '[ \t]+') END AS f FROM r WHERE reason IS NULL)
SELECT line_id, file_name, line_num, layout, {_P2_POINTS} FROM f""",
    "bounds_line": f"WITH {_LINE} {_bounds('line')}",
    "bounds_cloud": f"WITH {_CLOUD} {_bounds('cloud')}",
    "spacing_line": f"""WITH {_LINE}, s AS (SELECT count(*) AS n, max(x)-min(x) AS dx, max(y)-min(y) AS dy, max(z)-min(z) AS dz FROM line)
        SELECT n, round(cbrt(CASE WHEN dx > 0 THEN dx ELSE 1 END * CASE WHEN dy > 0 THEN dy ELSE 1 END * CASE WHEN dz > 0 THEN dz ELSE 1 END / n), 6) AS spacing FROM s""",
    "voxel_downsample_line": f"WITH {_LINE}, {_voxels('line', 3.0)} SELECT point_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, n AS size FROM down",
    "voxel_counts_line": f"WITH {_LINE}, {_voxels('line', 3.0)} SELECT vx, vy, vz, n FROM vox",
    "voxel_downsample_cloud": f"WITH {_CLOUD}, {_voxels('cloud', VOXEL)} SELECT point_id, round(x + 3.1e-7, 5) + 0.0 AS x, round(y + 3.1e-7, 5) + 0.0 AS y, round(z + 3.1e-7, 5) + 0.0 AS z, n AS size FROM down",
    "radius_pairs_emb": f"WITH {_EMB}, {_pairs('emb', R_EMB)} SELECT src, dst, round(d2, 9) + 0.0 AS d2 FROM pairs",
    "radius_pairs_cloud": f"WITH {_CLOUD}, {_pairs('cloud', R_CLOUD)} SELECT src, dst, round(d2, 6) + 0.0 AS d2 FROM pairs",
    "radius_degree_emb": f"""WITH {_EMB}, {_pairs('emb', R_EMB)}, ends AS (SELECT src AS point_id FROM pairs UNION ALL SELECT dst FROM pairs)
        SELECT emb.point_id, count(ends.point_id) AS degree FROM emb LEFT JOIN ends USING (point_id) GROUP BY 1""",
    "local_covariance_emb": f"{_EF} SELECT point_id, n AS n_neighbors, " + ", ".join(f"round({s}, 9) + 0.0 AS {t}" for s, t in zip("abcdef", ("xx", "yy", "zz", "xy", "xz", "yz"))) + " FROM cov",
    "curvature_emb": f"{_EF} SELECT point_id, n_neighbors, round(curvature, 6) + 0.0 AS curvature FROM feat",
    "curvature_cloud": f"WITH {_CLOUD}, {_pairs('cloud', R_CLOUD)}, {_features('cloud')} SELECT point_id, n_neighbors, round(curvature, 6) + 0.0 AS curvature FROM feat",
    "normals_emb": f"{_EF} SELECT point_id, round(nx, 4) + 0.0 AS nx, round(ny, 4) + 0.0 AS ny, round(nz, 4) + 0.0 AS nz FROM feat",
    "curvature_stats_emb": f"{_EF}, o AS (SELECT curvature AS v, row_number() OVER (ORDER BY curvature) - 1 AS k, count(*) OVER () AS n FROM feat) SELECT max(n) AS n, round(min(v), 6) AS min, round(avg(v), 6) AS mean, round(max(v), 6) AS max, "
    + ", ".join(f"round({_PERC.format(q=q)}, 6) AS p{q}" for q in (50, 95, 98, 99))
    + " FROM o",
    "curvature_threshold_emb": f"{_EF}, {_threshold(98)} SELECT round(t, 6) AS threshold FROM thr",
    "curvature_percentiles_features": """WITH f AS (SELECT point_id, min(curvature) AS v FROM features WHERE isfinite(curvature) GROUP BY 1),
        o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n FROM f), q AS (SELECT unnest([0, 50, 95, 98, 99, 100])::BIGINT AS q)
        SELECT q, n, round(v, 9) + 0.0 AS value FROM q JOIN o ON k = least(n * q // 100, n - 1)""",
    "edge_weights_emb": f"{_EF}, {_EDGES} SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge_id, src, dst, round(dist + 0.5 * ang + curv, 4) AS weight FROM edges0",
    "edge_weights_legacy_emb": f"{_EF}, {_EDGES} SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge_id, src, dst, round(dist + 0.5 * ang, 4) AS weight FROM edges0",
    "pruned_edges_emb": f"{_EF}, {_EDGES}, {_threshold(95)} SELECT src, dst FROM edges0 WHERE curv <= (SELECT t FROM thr)",
    "angle_gated_edges_emb": f"{_EF}, {_EDGES}, {_threshold(98)} SELECT src, dst FROM edges0 WHERE curv <= (SELECT t FROM thr) AND ang <= 0.52",
    "components_emb": f"WITH RECURSIVE {_EMB}, {_pairs('emb', R_EMB)}, {_reach('pairs', 'emb')} SELECT * FROM reach",
    "components_cloud": f"WITH RECURSIVE {_CLOUD}, {_pairs('cloud', R_CLOUD)}, {_reach('pairs', 'cloud')} SELECT * FROM reach",
    "smooth_components_emb": f"{_EF}, {_EDGES}, {_threshold(98)}, smooth AS (SELECT src, dst FROM edges0 WHERE curv <= (SELECT t FROM thr) AND ang <= 0.52), {_reach('smooth', 'emb')} SELECT * FROM reach",
    "dense_relabel_emb": f"WITH RECURSIVE {_EMB}, {_pairs('emb', R_EMB)}, {_reach('pairs', 'emb')} SELECT point_id, dense_rank() OVER (ORDER BY component) - 1 AS segment_id FROM reach",
    "segment_sizes_emb": f"WITH RECURSIVE {_EMB}, {_pairs('emb', R_EMB)}, {_reach('pairs', 'emb')} SELECT dense_rank() OVER (ORDER BY component) - 1 AS segment_id, count(*) AS size FROM reach GROUP BY component",
    "segment_count_emb": f"WITH RECURSIVE {_EMB}, {_pairs('emb', R_EMB)}, {_reach('pairs', 'emb')} SELECT count(DISTINCT component) AS segments FROM reach",
    "average_degree_emb": f"WITH {_EMB}, {_pairs('emb', R_EMB)} SELECT v AS vertices, e AS edges, round(2 * e / v, 6) AS average_degree FROM (SELECT count(*) AS v FROM emb), (SELECT count(*) AS e FROM pairs)",
    "active_counts_emb": f"""WITH RECURSIVE {_EMB}, {_pairs('emb', R_EMB)}, {_reach('pairs', 'emb')}
        SELECT count(*) FILTER (point_id = component) AS active_vertices, 0::BIGINT AS active_edges FROM reach""",
    "first_active_emb": f"WITH RECURSIVE {_EMB}, {_pairs('emb', R_EMB)}, {_reach('pairs', 'emb')} SELECT min(point_id) FILTER (point_id = component) AS vertex FROM reach",
    "adjacency_emb": f"""{_EF}, {_EDGES}, numbered AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge_id, src, dst FROM edges0),
        ends AS (SELECT src AS point_id, edge_id FROM numbered UNION ALL SELECT dst, edge_id FROM numbered)
        SELECT point_id, count(*) AS degree, string_agg(edge_id::VARCHAR, ',' ORDER BY edge_id) AS edge_ids FROM ends GROUP BY point_id""",
    "greedy_merge_emb": f"{_EF}, {_EDGES}, {_threshold(98)}, {_merge()} {_DENSE}",
    "merge_levels_emb": f"{_EF}, {_EDGES}, {_threshold(98)}, {_merge()} {_DENSE}",
    "greedy_merge_legacy_emb": f"{_EF}, {_EDGES}, {_threshold(98)}, {_merge(0.0, 0.3, False)} {_DENSE}",
    "threshold_sweep_emb": f"{_EF}, {_EDGES}, {_threshold(98)}, "
    + ", ".join(_merge(0.0, t, False, f"st{i}") for i, t in enumerate(SWEEP))
    + " UNION ALL ".join(f" SELECT {t}::DOUBLE AS threshold, count(*) FILTER (kind = 1) AS points, count(*) FILTER (kind = 1 AND live) AS segments, (max(w) FILTER (kind = 2 AND id = 0))::BIGINT AS merges FROM st{i}" for i, t in enumerate(SWEEP)),
    "merge_metrics_emb": f"""{_EF}, {_EDGES}, {_threshold(98)}, {_merge()} SELECT count(*) FILTER (kind = 1) AS points, count(*) FILTER (kind = 1 AND live) AS segments, """
    + ", ".join(f"(max(w) FILTER (kind = 2 AND id = {i}))::BIGINT AS {c}" for i, c in enumerate(merge.COUNTERS))
    + " FROM st",
    "region_table_emb": f"{_EF}, {_EDGES}, {_threshold(98)}, {_merge()} SELECT id AS root, size::BIGINT AS size, " + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in ("x", "y", "z", "nx", "ny", "nz")) + " FROM st WHERE kind = 1 AND live",
    "cluster_class_histogram": f"WITH {_SCORED} SELECT cluster, gt, n FROM hist",
    "majority_class": f"WITH {_SCORED} SELECT cluster, class FROM best",
    "cluster_purity": f"WITH {_SCORED} SELECT cluster, sum(n)::BIGINT AS size, round(max(n) / sum(n), 6) AS purity FROM hist GROUP BY cluster",
    "purity_summary": f"""WITH {_SCORED}, pur AS (SELECT max(n) / sum(n) AS p FROM hist GROUP BY cluster)
        SELECT a.*, b.* FROM (SELECT count(*) AS clusters, round(avg(p), 6) AS avg_purity, count(*) FILTER (p < 0.8) AS mixed, round(count(*) FILTER (p < 0.8) / count(*), 6) AS mixed_share FROM pur) a,
        (SELECT count(*) FILTER (cluster < 0) AS noise, round(count(*) FILTER (cluster < 0) / count(*), 6) AS noise_share FROM scored) b""",
    "gt_distribution": f"WITH {_SCORED} SELECT gt AS class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM scored GROUP BY gt",
    "mapped_labels": f"WITH {_SCORED} SELECT point_id, gt, pred, count(*) AS runs FROM mapped GROUP BY ALL",
    "confusion_matrix": f"WITH {_SCORED} SELECT gt, pred, n FROM conf",
    "per_class_iou": f"WITH {_SCORED} SELECT class, tp, n_gt, n_pred, round(iou, 6) AS iou FROM iou",
    "mean_iou": f"WITH {_SCORED} SELECT round(avg(iou), 6) AS mean_iou FROM iou WHERE class >= 1",
    "overall_accuracy": f"WITH {_SCORED} SELECT round(sum(n) FILTER (gt = pred) / sum(n), 6) AS accuracy FROM conf",
    "nn_label_transfer_cloud": f"""WITH {_CLOUD}, {_voxels('cloud', VOXEL)}
        SELECT c.point_id, min_by(d.point_id, {{'d2': (c.x-d.x)*(c.x-d.x) + (c.y-d.y)*(c.y-d.y) + (c.z-d.z)*(c.z-d.z), 'i': d.point_id}}) AS label FROM cloud c, down d GROUP BY c.point_id""",
    "nn_label_transfer_line": f"""WITH {_LINE}, pts AS MATERIALIZED (SELECT row_number() OVER (ORDER BY x, y, z) - 1 AS point_id, x, y, z FROM (SELECT DISTINCT x, y, z FROM line)), {_voxels('pts', 3.0)}
        SELECT c.point_id, min_by(d.point_id, {{'d2': (c.x-d.x)*(c.x-d.x) + (c.y-d.y)*(c.y-d.y) + (c.z-d.z)*(c.z-d.z), 'i': d.point_id}}) AS label FROM pts c, down d GROUP BY c.point_id""",
    "zip_visualization": f"""WITH {_CLOUD}, lab AS (SELECT point_id, min(class_id) AS class_id FROM point_classes WHERE class_id IS NOT NULL GROUP BY 1)
        SELECT point_id, printf('%.6f %.6f %.6f %d', x, y, z, class_id) AS line FROM cloud JOIN lab USING (point_id)""",
    "xyz_text_parse": rf"""WITH f AS (SELECT line_id, regexp_extract(line, '^\s*({_NUM})\s+({_NUM})\s+({_NUM})', ['a', 'b', 'c']) AS r FROM raw_lines
          WHERE line IS NOT NULL AND length(line) > 0 AND line <> chr(13) AND NOT starts_with(line, '#')),
        v AS (SELECT line_id, TRY_CAST(r.a AS FLOAT) AS a, TRY_CAST(r.b AS FLOAT) AS b, TRY_CAST(r.c AS FLOAT) AS c FROM f)
        SELECT line_id, CASE WHEN isfinite(a) AND isfinite(b) AND isfinite(c) THEN a::DOUBLE END AS x, CASE WHEN isfinite(a) AND isfinite(b) AND isfinite(c) THEN b::DOUBLE END AS y,
          CASE WHEN isfinite(a) AND isfinite(b) AND isfinite(c) THEN c::DOUBLE END AS z FROM v""",
    "p6_found": """
WITH kept AS (SELECT DISTINCT run_id, point_id, segment_id FROM predictions WHERE segment_id >= 0),
cls AS (SELECT point_id, min(class_id) AS class_id FROM point_classes WHERE class_id IS NOT NULL GROUP BY point_id),
cnt AS (SELECT segment_id, class_id, count(*) AS n FROM kept JOIN cls USING (point_id) GROUP BY ALL)
SELECT segment_id, class_id FROM cnt
QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY n DESC, class_id) = 1
""",
}
