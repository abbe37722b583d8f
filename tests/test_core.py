"""Fixtures F1-F11, empty and dirty inputs, brute force for the core operators."""

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from pointmill.config import SegmentationConfig
from pointmill.functions.ranks import index_percentiles, number_rows
from pointmill.operators import bounds, components, evaluate, features, graph, labels, merge, neighbors, tree_aggregate
from pointmill.operators.tree_aggregate import segment_majority, tree_count
from pointmill.plans.pipeline import Timer, experiment, segment
from pointmill.sources import points as src
from pointmill.sources import synthetic
from pointmill.workspace import Workspace

XYZ = "point_id bigint, x double, y double, z double"
SIX = [(0, 0.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0), (2, 0.0, 2.0, 0.0), (3, 1.0, 0.0, 0.0), (4, 1.0, 1.0, 0.0), (5, 1.0, 2.0, 0.0)]


def cloud(spark, rows):
    return spark.createDataFrame(rows, XYZ)


def by_id(df, value):
    return [r[1] for r in sorted(df.select("point_id", value).collect())]


def test_f1_points_out_of_reach_stay_apart(spark):
    assert by_id(segment(spark, cloud(spark, SIX)).labels, "segment_id") == [0, 1, 2, 3, 4, 5]
    assert segment(spark, cloud(spark, [])).labels.count() == 0


def test_f2_flat_lattice_merges_to_one(spark):
    run = segment(spark, cloud(spark, SIX), SegmentationConfig(search_radius=1.1))
    assert run.edges.count() == 7 and run.threshold == 0
    assert by_id(run.labels, "segment_id") == [0] * 6
    m = merge.merge_metrics(run.roots).first()
    assert (m.points, m.segments, m.merges) == (6, 1, 5)


def test_f5_far_clusters_never_join(spark):
    rows = [(i, float(i % 3) * 0.2, float(i // 3) * 0.2, 0.0) for i in range(9)]
    rows += [(9 + i, 100 + float(i % 3) * 0.2, float(i // 3) * 0.2, 0.0) for i in range(9)]
    got = by_id(segment(spark, cloud(spark, rows)).labels, "segment_id")
    assert got == [0] * 9 + [1] * 9


def test_f6_xyz_reader(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n# c\n1 2\na b c\n1,2,3\n1 2 3 9 9\n4 5 6\n")
    pts, rej = src.read_xyz(spark, str(tmp_path / "a.txt"))
    assert sorted(map(tuple, pts.collect())) == [(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0)]
    assert sorted(r.line_num for r in rej.collect()) == [3, 4, 5]


def test_readers_keep_line_order_over_many_splits(spark, tmp_path):
    n = 5000
    (tmp_path / "a.txt").write_text("".join(f"{i} {i % 7} 0.5\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        pts, _ = src.read_xyz(spark, str(tmp_path / "a.txt"), single=False)
        assert [(r.point_id, r.x) for r in sorted(pts.collect())] == [(i, float(i)) for i in range(n)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_labels_and_sinks_round_trip(spark, tmp_path):
    pts = spark.createDataFrame([(0, 1.5, -2.25, 1234567.0, 0.0, 0.0, 1.0), (1, 1e-7, 0.125, 3.0, 1.0, 0.0, 0.0)], XYZ + ", nx double, ny double, nz double")
    ids = spark.createDataFrame([(0, 7)], "point_id bigint, segment_id bigint")
    src.write_oriented_csv(pts, str(tmp_path / "c"), ids)
    text = [x for p in sorted((tmp_path / "c").glob("*.txt")) for x in p.read_text().splitlines()]
    assert text == ["# X,Y,Z,NX,NY,NZ,SegmentID", "1.5,-2.25,1.23457e+06,0,0,1,7", "1e-07,0.125,3,1,0,0"]
    back, rej = src.read_oriented_csv(spark, str(tmp_path / "c"))
    assert back.count() == 2 and rej.count() == 0
    lab = spark.createDataFrame([(2, 5), (0, 1), (1, -1)], "point_id bigint, segment_id bigint")
    src.write_labels(lab, str(tmp_path / "l"))
    assert by_id(src.read_labels(spark, str(tmp_path / "l")), "label") == [1, -1, 5]
    src.write_xyz(pts, str(tmp_path / "x"))
    assert src.read_matrix(spark, str(tmp_path / "x"), ["x", "y", "z"]).count() == 2
    (tmp_path / "bad.txt").write_text("1 2 3\n1 x 3\n")
    with pytest.raises(Exception, match="not a row of numbers"):
        src.read_matrix(spark, str(tmp_path / "bad.txt"), ["x", "y", "z"]).collect()


def test_f7_index_percentile(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("c"))
    assert {r.q: r.value for r in index_percentiles(df, F.col("c"), [50, 98, 100]).collect()} == {50: 50.0, 98: 98.0, 100: 99.0}
    assert index_percentiles(df.where("c < 50"), F.col("c"), [98]).first().value == 49.0
    assert index_percentiles(df.where("c < 0"), F.col("c"), [98]).first().value == 0.0
    same = spark.range(1000).select(F.when(F.col("id") < 700, 0.0).otherwise(F.col("id")).alias("c"))
    vals = sorted(r.c for r in same.collect())
    for rows in (1 << 20, 40, 1):
        got = {r.q: r.value for r in index_percentiles(same, F.col("c"), [1, 50, 71, 95], buckets=8, leaf_rows=rows).collect()}
        assert got == {q: vals[1000 * q // 100] for q in (1, 50, 71, 95)}
    far = spark.range(300).select(F.when(F.col("id") == 7, 1e300).otherwise(F.col("id").cast("double")).alias("c"))
    assert {r.q: r.value for r in index_percentiles(far, F.col("c"), [0, 50, 100], buckets=16, leaf_rows=20).collect()} == {0: 0.0, 50: 151.0, 100: 1e300}


def test_f8_scores(spark):
    gt, pr = [1, 1, 2, 2, 0, 3], [0, 0, 0, 0, 1, -1]
    t = spark.createDataFrame(list(enumerate(gt)), "point_id bigint, class_id int")
    p = spark.createDataFrame(list(enumerate(pr)), "point_id bigint, segment_id bigint")
    pairs = evaluate.paired(t, p)
    assert by_id(evaluate.mapped(pairs), "pred") == [1, 1, 1, 1, 0, 0]
    matrix = evaluate.confusion(spark, evaluate.mapped(pairs))
    assert matrix.count() == 81
    s = evaluate.mean_iou(matrix).first()
    assert (s.mean_iou, s.accuracy) == (0.0625, 0.5)
    q = evaluate.purity_summary(pairs).first()
    assert (q.clusters, q.avg_purity, q.mixed, q.mixed_share, q.noise) == (2, 0.75, 1, 0.5, 1)
    none = evaluate.purity_summary(pairs.where("cluster < 0")).first()
    assert none.avg_purity == 0 and none.mixed_share is None
    with pytest.raises(ValueError, match="differ in length"):
        neighbors.require_same_length(t, p.limit(2))


def test_f10_opposite_normals_never_merge(spark):
    f = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0), (1, 0.1, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0)], XYZ + ", nx double, ny double, nz double, curvature double")
    roots = merge.merge_components(spark, graph.vertices(f), graph.build_edges(f, 0.5), 1.0)
    m = merge.merge_metrics(roots).first()
    assert m.segments == 2 and m.angle_rejects == 1


def test_f11_bounds_and_spacing(spark):
    assert bounds.bounds(cloud(spark, [])).first().max_x == 0 and bounds.spacing(cloud(spark, [])).first().spacing == 0
    assert bounds.spacing(cloud(spark, SIX[:1])).first().spacing == 0
    assert bounds.spacing(cloud(spark, SIX)).first().spacing == pytest.approx((2 / 6) ** (1 / 3))


def test_radius_join_equals_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.uniform(-3, 3), rnd.uniform(-3, 3), rnd.uniform(-1, 1)) for i in range(400)] + [(1000 + i, 0.5 * i, 0.0, 0.0) for i in range(10)]
    pts = cloud(spark, rows)
    for r in (0.5, 0.31):
        fast = sorted((a, b) for a, b, _ in neighbors.radius_pairs(pts, r).collect())
        assert fast == sorted((a, b) for a, b, _ in neighbors.radius_pairs_brute(pts, r).collect())
    assert neighbors.radius_pairs(cloud(spark, [(0, None, 0.0, 0.0), (1, 0.0, 0.0, 0.0)]), 1.0).count() == 0


def test_nearest_label_with_ties_and_outliers(spark):
    rnd = random.Random(5)
    raw = [(i, rnd.uniform(0, 50), rnd.uniform(0, 2), 0.0) for i in range(200)] + [(900, 5000.0, 0.0, 0.0)]
    cen = [(i, float(i % 10), float(i // 10), 0.0, 100 + i) for i in range(20)] + [(50, 0.0, 0.0, 0.0, 7)]
    got = dict(map(tuple, neighbors.nearest_label(spark, cloud(spark, raw), spark.createDataFrame(cen, XYZ + ", label int"), "label", 1.0).collect()))
    for i, x, y, z in raw:
        assert got[i] == min(((x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2, k, lab) for k, a, b, c, lab in cen)[2]
    dirty = [(901, None, 0.0, 0.0), (902, math.nan, 0.0, 0.0), (903, 0.0, math.inf, 0.0), (904, 3.2, 0.1, 0.0)]
    got = neighbors.nearest_label(spark, cloud(spark, dirty), spark.createDataFrame([*cen, (51, None, 0.0, 0.0, 9), (52, math.nan, 0.0, 0.0, 9)], XYZ + ", label int"), "label", 1.0)
    assert {r.point_id: r.label for r in got.collect()} == {901: 0, 902: 0, 903: 0, 904: 103}
    none = neighbors.nearest_label(spark, cloud(spark, SIX), spark.createDataFrame([], XYZ + ", label int"), "label", 1.0)
    assert {r.label for r in none.collect()} == {0}


def test_features_of_planes(spark):
    rows = [(i, 10 + 0.1 * (i % 10), 10 + 0.1 * (i // 10), 5.0) for i in range(100)]
    out = features.surface_features(cloud(spark, rows), 0.25).collect()
    assert max(r.curvature for r in out) < 1e-12 and all(r.nz == pytest.approx(-1) for r in out)
    alone = features.surface_features(cloud(spark, [(0, 1.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0)]), 0.5).collect()
    assert all((r.nx, r.ny, r.nz, r.curvature) == (0, 0, 1, 0) for r in alone)


def test_components_and_dense_labels(spark):
    rnd = random.Random(6)
    n = 300
    edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(170)] + [(3, 3)]
    parent = list(range(n))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    pts = spark.range(n).withColumnRenamed("id", "point_id")
    got = components.connected_components(spark, pts, spark.createDataFrame(edges, "src bigint, dst bigint"))
    assert by_id(got, "component") == [find(v) for v in range(n)]
    dense = by_id(labels.dense_labels(got.toDF("point_id", "root")), "segment_id")
    seen = {}
    assert dense == [seen.setdefault(find(v), len(seen)) for v in range(n)]


def naive(regions, src_, dst, w, cfg, threshold):
    """Independent oracle: scan for the least queued edge, edges as dictionaries."""
    edges = {i: {"l": a, "r": b, "w": x, "q": True} for i, (a, b, x) in enumerate(zip(src_, dst, w))}
    order = {v: [i for i, e in edges.items() if v in (e["l"], e["r"])] for v in range(len(regions.size))}
    merges = 0
    while queued := [(e["w"], i) for i, e in edges.items() if e["q"]]:
        cost, i = min(queued)
        if cfg.stop_weight is not None and cost > cfg.stop_weight:
            break
        e = edges[i]
        a, b = e["l"], e["r"]
        if cfg.gates and (regions.angle(a, b) > cfg.angle_threshold or max(regions.cur[a], regions.cur[b]) > threshold):
            e["q"] = False
            continue
        regions.absorb(a, b)
        merges += 1
        del edges[i]
        for j in order[b]:
            if j not in edges:
                continue
            f = edges[j]
            c = f["r"] if f["l"] == b else f["l"]
            twin = next((k for k, g in edges.items() if k != j and {g["l"], g["r"]} == {a, c}), None)
            if twin is not None and not f["w"] < edges[twin]["w"]:
                del edges[j]
                continue
            if twin is not None:
                del edges[twin]
            f["l"], f["r"] = (a, c) if f["l"] == b else (c, a)
            order[a].append(j)
            f["again"] = True
        for f in edges.values():
            if f.pop("again", False):
                f["w"], f["q"] = regions.weight(f["l"], f["r"], cfg), True
    return merges


@pytest.mark.parametrize("seed", range(8))
def test_kernel_equals_naive_scan(seed):
    import math

    rnd = random.Random(seed)
    n = 40
    pos = [(rnd.uniform(0, 2), rnd.uniform(0, 2), rnd.gauss(0, 0.05)) for _ in range(n)]
    nor = []
    for _ in range(n):
        v = (rnd.gauss(0, 0.3), rnd.gauss(0, 0.3), 1.0)
        s = math.sqrt(sum(c * c for c in v))
        nor.append(tuple(c / s for c in v))
    cur = [rnd.uniform(0, 0.2) for _ in range(n)]
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if math.dist(pos[i], pos[j]) <= 0.6]
    for cfg in (SegmentationConfig(), SegmentationConfig(gates=False, curvature_weight=0.0, stop_weight=0.5)):
        one, two = (merge.Regions([1] * n, list(pos), list(nor), list(cur)) for _ in range(2))
        w = [one.weight(a, b, cfg) for a, b in pairs]
        g = merge.Graph([a for a, _ in pairs], [b for _, b in pairs], list(w), list(range(len(pairs))), [True] * len(pairs))
        got, _ = merge.greedy_merge(one, g, cfg, 0.15)
        assert naive(two, [a for a, _ in pairs], [b for _, b in pairs], w, cfg, 0.15) == got["merges"]
        assert [one.find(v) for v in range(n)] == [two.find(v) for v in range(n)]
        if cfg.gates:
            assert all(one.find(v) == v for v in range(n) if cur[v] > 0.15)


def test_planes_segment(spark):
    pts = synthetic.three_planes(spark, 6, noise=0.0)
    run = segment(spark, pts, SegmentationConfig(normal_radius=0.5, search_radius=0.5))
    m = merge.merge_metrics(run.roots).first()
    assert m.points - m.merges == m.segments and merge.region_table(run.roots).agg(F.sum("size")).first()[0] == m.points


@pytest.mark.parametrize("kind", ["rough", "lattice", "stop"])
def test_levels_equal_the_sequential_run(spark, kind):
    """One component, split over several tasks and levels, gives the same roots, attributes and counters."""
    rnd = random.Random(11)
    if kind == "lattice":  # equal weights everywhere
        rows = [(i, 0.25 * (i % 8), 0.25 * (i // 8), 0.0) for i in range(64)]
    else:
        rows = [(i, rnd.uniform(0, 3.5), rnd.uniform(0, 1.5), rnd.gauss(0, 0.06)) for i in range(110)]
    cfg = SegmentationConfig(normal_radius=0.6, search_radius=0.45)
    if kind == "stop":
        cfg = replace(cfg, gates=False, curvature_weight=0.0, stop_weight=0.5)
    f = features.surface_features(cloud(spark, rows), cfg.normal_radius)
    f, _ = Workspace(spark, "t").keep(f)
    e = graph.build_edges(f, cfg.search_radius, cfg.angle_weight, cfg.curvature_weight)
    t = features.curvature_threshold(f, 95)
    one = merge.merge_components(spark, graph.vertices(f), e, t, cfg)
    many = merge.merge_components(spark, graph.vertices(f), e, t, replace(cfg, max_component=45, bundle_edges=60, level_share=0.4))
    assert merge.merge_metrics(one).first() == merge.merge_metrics(many).first()
    cols = ["point_id", "root", "size", "x", "y", "z", "nx", "ny", "nz"]
    assert sorted(one.select(*cols).collect()) == sorted(many.select(*cols).collect())


def test_experiment_end_to_end(spark):
    pts = synthetic.three_planes(spark, 10, noise=0.0)
    truth = pts.select("point_id", (F.col("plane") + 1).alias("class_id"))
    out = experiment(spark, pts.drop("plane"), truth, SegmentationConfig(voxel_size=0.3, normal_radius=0.7, search_radius=0.7, curvature_percentile=100), as_files=True)
    assert out.labels.count() == pts.count() and out.scores.first().accuracy > 0.8


def test_tree_rounds(spark):
    assert [tree_aggregate.fan_ins(n) for n in (0, 1, 2, 8, 200, 257)] == [[], [], [2], [3, 3], [15, 14], [7, 7, 6]]
    assert all(math.prod(tree_aggregate.fan_ins(n, f)) >= n and max(tree_aggregate.fan_ins(n, f)) <= f for n in range(2, 300) for f in (2, 3, 16))
    rows = spark.range(4000, numPartitions=8).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"))
    states = tree_aggregate.chunk_states(rows, ["k"], 100)
    hot = states.where("k = 7").agg(F.count(F.lit(1)), F.max("n")).first()
    assert hot[0] >= 8 and hot[1] <= 20_000 and states.groupBy("k", "_part", "_chunk").count().where("count > 1").count() == 0
    for parts, rounds in ((8, 2), (200, 2)):
        out = tree_count(rows.repartition(parts), ["k"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sum("Exchange hashpartitioning(k" in line and "_at" in line for line in plan.splitlines()) == rounds, plan
        assert out.where("k = 7").first().n == rows.where("k = 7").count() and out.count() == rows.distinct().count()


def test_tree_count_and_majority(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([1, 1, 1, 1, 2, 3, None]), rnd.randrange(3)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k bigint, v int").repartition(9)
    want = {}
    for r in rows:
        want[r] = want.get(r, 0) + 1
    got = {(r.k, r.v): r.n for r in tree_count(df, ["k", "v"], fan_in=2, chunk_rows=100).collect()}
    assert got == want
    assert tree_count(df.limit(0), ["k", "v"]).count() == 0
    pred = spark.createDataFrame([(1, 1, 5), (1, 1, 5), (2, 1, 5), (1, 2, 5), (1, 3, -1), (1, 4, None), (1, 5, 6)], "run_id int, point_id bigint, segment_id bigint")
    cls = spark.createDataFrame([(1, 2), (1, 2), (2, 0), (5, None)], "point_id bigint, class_id int")
    assert sorted(map(tuple, segment_majority(pred, cls).collect())) == [(5, 2)]
    tie = spark.createDataFrame([(1, 1, 5), (1, 2, 5)], "run_id int, point_id bigint, segment_id bigint")
    assert segment_majority(tie, cls).first().class_id == 0


def test_number_rows_and_timer(spark):
    df = spark.createDataFrame([(k, i) for i, k in enumerate([5, 70_000, 5, 200_000, 1])], "k bigint, i int")
    assert [(r.k, r.no) for r in sorted(number_rows(df, ["k", "i"], "no").collect(), key=lambda r: r.no)] == [(1, 0), (5, 1), (5, 2), (70_000, 3), (200_000, 4)]
    t = Timer()
    assert t.restart() >= 0 and t.elapsed_ms() >= 0


def test_graph_helpers(spark):
    e = spark.createDataFrame([(0, 1, 2, 0.5), (1, 2, 3, 0.1)], "edge_id bigint, src bigint, dst bigint, weight double")
    assert e.where(graph.connects(F.lit(2), F.lit(1))).count() == 1
    assert [r[0] for r in e.select(graph.other_end(F.lit(2))).collect()] == [1, 3]
    assert {r.point_id: r.degree for r in graph.adjacency(e).collect()} == {1: 1, 2: 2, 3: 1}
    stats = graph.graph_stats(spark.range(4), e).first()
    assert stats.average_degree == 1.0 and graph.graph_stats(spark.range(0), e.limit(0)).first().average_degree == 0


def test_far_points_descend_the_pyramid(spark):
    rnd = random.Random(9)
    cen = [(i, rnd.uniform(0, 60), rnd.uniform(0, 60), rnd.uniform(0, 5), i) for i in range(400)] + [(900, 30.0, 30.0, 1e7, 900), (901, 30.0, 30.0, 1e7, 901)]
    raw = [(i, rnd.uniform(-4000, 4000), rnd.uniform(-50, 50), rnd.uniform(-9000, 50)) for i in range(60)] + [(70, 0.0, 0.0, 9e6), (71, 1e300, 0.0, 0.0), (72, 30.0, 30.0, 1e7)]
    got = dict(map(tuple, neighbors.nearest_label(spark, cloud(spark, raw), spark.createDataFrame(cen, XYZ + ", label int"), "label", 0.5).collect()))
    for i, x, y, z in raw[:60]:
        assert got[i] == min(((x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2, k, lab) for k, a, b, c, lab in cen)[2]
    assert got[72] == 900 and got[70] in (900, 901) and 71 in got


def test_number_rows_with_one_value_and_sparse_keys(spark):
    rows = spark.range(3000).select(F.lit(4).cast("bigint").alias("a"), F.pmod(F.xxhash64("id"), F.lit(1 << 60)).alias("b"))
    got = number_rows(rows, ["a", "b"], "no", start=5).orderBy("b").collect()
    assert [r.no for r in got] == list(range(5, 3005))
    assert number_rows(rows.limit(0), ["a", "b"], "no").count() == 0
    many = number_rows(rows.repartition(64), ["a", "b"], "no")
    assert many.select("no").distinct().count() == 3000


@pytest.mark.parametrize("chunk", [7, 50])
def test_stars_of_many_chunks(spark, chunk):
    """More than one chunk of edges: contraction and star steps alternate."""
    rnd = random.Random(chunk)
    edges = [(i, i + 1) for i in range(120)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(150)] + [(500, i) for i in range(501, 560)]
    e = spark.createDataFrame(edges, "src bigint, dst bigint").repartition(5)
    pts = spark.range(600).withColumnRenamed("id", "point_id")
    got = components.connected_components(spark, pts, e, chunk_edges=chunk)
    assert by_id(got, "component") == by_id(components.connected_components(spark, pts, e), "component")
    assert by_id(got, "component")[:121] == [0] * 121 and by_id(got, "component")[500:560] == [500] * 60
