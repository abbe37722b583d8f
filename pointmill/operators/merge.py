"""Greedy merging of the region adjacency graph.

The canonical order is (weight, edge number); a re-weighted edge supersedes its older entries.  Regions of different
connected components never meet, so after edges of points above the curvature threshold are dropped, components
are the unit of distribution: each bundle of components runs the sequential kernel on one worker, points
without edges never leave the JVM.

A component too large for one worker is merged in levels, with the same labels.  A level takes all queued edges up to a
limit of the order.  What the sequential run does until its queue is beyond the limit happens around those edges, so
their components, in bundles of neighbouring ones, run the kernel side by side, each with copies of the bordering
regions.  A bundle's run stands as if it had been interleaved with the others unless (1) it would merge with a
bordering region within the level or (2) it moved an edge to a bordering region that another bundle changed;
the components concerned are then put together and the level runs again.  As long as that happens two components
at least become one, and a level without it is a part of the sequential run.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.config import SegmentationConfig
from pointmill.operators.components import stars
from pointmill.operators.graph import ATTRIBUTES, mergeable_edges
from pointmill.workspace import Workspace

ROOTS = "point_id bigint, root bigint, size bigint, x double, y double, z double, nx double, ny double, nz double, merges bigint, skipped bigint, angle_rejects bigint, curvature_rejects bigint"
COUNTERS = ("merges", "skipped", "angle_rejects", "curvature_rejects")
Key = tuple[float, int]
#: Runs of a level after which it is begun again with half its edges.
PATIENCE = 6


@dataclass
class Regions:
    """Growing regions of one bundle: attributes by local index, union-find, counters."""

    size: list[int]
    pos: list[tuple[float, float, float]]
    nor: list[tuple[float, float, float]]
    cur: list[float]

    def __post_init__(self) -> None:
        self.parent = list(range(len(self.size)))

    def find(self, v: int) -> int:
        top = v
        while self.parent[top] != top:
            top = self.parent[top]
        while self.parent[v] != top:
            self.parent[v], v = top, self.parent[v]
        return top

    def angle(self, a: int, b: int) -> float:
        p, q = self.nor[a], self.nor[b]
        return math.acos(max(-1.0, min(1.0, p[0] * q[0] + p[1] * q[1] + p[2] * q[2])))

    def weight(self, a: int, b: int, cfg: SegmentationConfig) -> float:
        w = math.dist(self.pos[a], self.pos[b]) + cfg.angle_weight * self.angle(a, b)
        return w + cfg.curvature_weight * max(self.cur[a], self.cur[b]) if cfg.curvature_weight else w

    def absorb(self, keep: int, gone: int) -> None:
        """Size-weighted means; the mean normal is scaled to length 1 unless it nearly vanishes."""
        n = self.size[keep] + self.size[gone]
        f, g = self.size[keep] / n, self.size[gone] / n
        self.pos[keep] = tuple(f * a + g * b for a, b in zip(self.pos[keep], self.pos[gone]))
        nor = tuple(f * a + g * b for a, b in zip(self.nor[keep], self.nor[gone]))
        length = math.sqrt(sum(c * c for c in nor))
        self.nor[keep] = tuple(c / length for c in nor) if length > 1e-10 else nor
        self.size[keep] = n
        self.parent[gone] = keep


@dataclass
class Graph:
    """Edges of one bundle by local index: ends, weight, global number (for ties), whether alive and whether in the queue."""

    left: list[int]
    right: list[int]
    weight: list[float]
    number: list[int]
    queued: list[bool]

    def __post_init__(self) -> None:
        self.alive = [True] * len(self.left)
        self.moved = [False] * len(self.left)


def greedy_merge(regions: Regions, g: Graph, cfg: SegmentationConfig, threshold: float, limit: Key | None = None, own: list[bool] | None = None) -> tuple[dict[str, int], list[tuple[int, int]]]:
    """Merge in canonical order, in place, up to ``limit``; returns the counters and the escapes.

    With ``cfg.stop_weight`` merging ends at the first edge above it; with ``cfg.gates`` an edge whose regions differ too
    much in normal or curvature is put aside until one of its regions is absorbed.  An escape is a pair of a region and a
    bordering one (not ``own``) that is due within the limit; it is left alone.  An edge that dies in the queue counts as
    skipped if its turn would have come.
    """
    left, right, w, alive, queued = g.left, g.right, g.weight, g.alive, g.queued
    stamp = [0] * len(left)
    at: list[list[int]] = [[] for _ in regions.size]
    n = len(regions.size)
    between: dict[int, int] = {}  # the edge of a pair of regions
    for e, (a, b) in enumerate(zip(left, right)):
        at[a].append(e)
        at[b].append(e)
        between[a * n + b if a < b else b * n + a] = e
    top = limit or (math.inf, 0)
    if cfg.stop_weight is not None:
        top = min(top, (cfg.stop_weight, 1 << 62))
    queue = [(w[e], g.number[e], e, 0) for e in range(len(left)) if queued[e] and (w[e], g.number[e]) <= top]
    heapq.heapify(queue)
    counts = dict.fromkeys(COUNTERS, 0)
    escapes: list[tuple[int, int]] = []

    def bury(e: int) -> None:
        alive[e] = False
        counts["skipped"] += queued[e] and (cfg.stop_weight is None or w[e] <= cfg.stop_weight)

    while queue:
        _, _, e, version = heapq.heappop(queue)
        if version != stamp[e] or not alive[e]:
            continue
        queued[e] = False
        a, b = left[e], right[e]
        if cfg.gates:
            if regions.angle(a, b) > cfg.angle_threshold:
                counts["angle_rejects"] += 1
                continue
            if max(regions.cur[a], regions.cur[b]) > threshold:
                counts["curvature_rejects"] += 1
                continue
        if own is not None and not (own[a] and own[b]):
            escapes.append((a, b) if own[a] else (b, a))
            continue
        regions.absorb(a, b)
        counts["merges"] += 1
        alive[e] = False
        del between[a * n + b if a < b else b * n + a]
        again = []
        for m in at[b]:
            if not alive[m]:
                continue
            c = right[m] if left[m] == b else left[m]
            del between[b * n + c if b < c else c * n + b]
            if left[m] == b:
                left[m] = a
            else:
                right[m] = a
            pair = a * n + c if a < c else c * n + a
            rival = between.get(pair)
            if rival is not None:
                if w[m] < w[rival]:
                    bury(rival)
                else:
                    bury(m)
                    g.moved[m] = True
                    continue
            between[pair] = m
            at[a].append(m)
            again.append(m)
        at[b] = []
        for m in again:
            w[m] = regions.weight(left[m], right[m], cfg)
            stamp[m] += 1
            queued[m] = g.moved[m] = True
            if (w[m], g.number[m]) <= top:
                heapq.heappush(queue, (w[m], g.number[m], m, stamp[m]))
    return counts, escapes


def _load(points: pa.Table, edges: pa.Table) -> tuple[np.ndarray, Regions, Graph, dict[str, np.ndarray]]:
    """Ascending ids, regions and graph of two tables; the tables' columns as arrays in the same order."""
    points, edges = points.sort_by("point_id"), edges.sort_by("edge_id")
    ids = points.column("point_id").to_numpy()
    col = {c: points.column(c).to_numpy(zero_copy_only=False) for c in points.column_names}
    e = {c: edges.column(c).to_numpy(zero_copy_only=False) for c in edges.column_names}
    r = Regions(col["size"].tolist(), list(zip(*(col[c].tolist() for c in "xyz"))), list(zip(*(col[c].tolist() for c in ("nx", "ny", "nz")))), col["curvature"].tolist())
    queued = e["queued"].tolist() if "queued" in e else [True] * len(e["src"])
    return ids, r, Graph(np.searchsorted(ids, e["src"]).tolist(), np.searchsorted(ids, e["dst"]).tolist(), e["weight"].tolist(), e["edge_id"].tolist(), queued), col


def _kernel(cfg: SegmentationConfig, threshold: float):  # noqa: ANN202
    def run(points: pa.Table, edges: pa.Table) -> pa.Table:
        ids, r, g, _ = _load(points, edges)
        counts, _ = greedy_merge(r, g, cfg, threshold)
        root = np.array([r.find(v) for v in range(len(ids))], dtype=np.int64)
        once = np.zeros(len(ids), dtype=np.int64)
        once[:1] = 1  # counters stand in the bundle's first row
        pos, nor = np.array(r.pos, dtype=float).reshape(-1, 3)[root], np.array(r.nor, dtype=float).reshape(-1, 3)[root]
        arrays = [ids, ids[root], np.array(r.size, dtype=np.int64)[root], *pos.T, *nor.T, *[once * counts[c] for c in COUNTERS]]
        return pa.table([pa.array(np.ascontiguousarray(a)) for a in arrays], names=[x.split()[0] for x in ROOTS.split(", ")])

    return run


def merge_components(spark: SparkSession, vertices: DataFrame, edges: DataFrame, threshold: float, cfg: SegmentationConfig = SegmentationConfig()) -> DataFrame:
    """ROOTS for every vertex: its root, the root region's size and attributes, and counters (to be summed).

    ``vertices``: (point_id, size, x..z, nx..nz, curvature).  Small components are bundled so that a bundle has about
    ``cfg.bundle_edges`` edges; components with more than ``cfg.max_component`` points are merged in levels.
    """
    ws = Workspace(spark, "merge")
    # Without gates every edge may merge; with them, edges above the curvature threshold never do.
    usable = mergeable_edges(edges, vertices, threshold) if cfg.gates else edges.select("edge_id", "src", "dst", "weight")
    found = stars(spark, usable)
    sizes = found.groupBy(F.col("u").alias("component")).agg((F.count(F.lit(1)) + 1).alias("n"))
    sizes, seen = ws.keep(sizes, largest=F.coalesce(F.max("n"), F.lit(0)), components=F.count(F.lit(1)), points=F.coalesce(F.sum("n"), F.lit(0)))
    comp = found.select(F.col("v").alias("point_id"), F.col("u").alias("component")).unionByName(sizes.select(F.col("component").alias("point_id"), "component"))
    large = None
    if seen["largest"] > cfg.max_component:
        large = comp.join(F.broadcast(sizes.where(F.col("n") > cfg.max_component).select("component")), "component", "left_semi")
        comp = comp.join(F.broadcast(sizes.where(F.col("n") > cfg.max_component).select("component")), "component", "left_anti")
    bundles = max(1, -(-4 * seen["points"] // cfg.bundle_edges), spark.sparkContext.defaultParallelism if seen["points"] > 10_000 else 1)
    bundle = F.pmod(F.xxhash64("component"), F.lit(bundles)).cast("int")
    placed = comp.select("point_id", bundle.alias("bundle"))
    v = vertices.join(placed, "point_id", "left")
    e = usable.join(placed.toDF("src", "bundle"), "src")
    merged = v.where("bundle is not null").groupBy("bundle").cogroup(e.groupBy("bundle")).applyInArrow(_kernel(cfg, threshold), ROOTS)
    alone = v.where("bundle is null")
    if large is not None:
        alone = alone.join(large.select("point_id"), "point_id", "left_anti")
    zero = [F.lit(0).cast("bigint").alias(c) for c in COUNTERS]
    out = merged.unionByName(alone.select("point_id", F.col("point_id").alias("root"), "size", "x", "y", "z", "nx", "ny", "nz", *zero))
    if large is not None:
        big = vertices.join(large.select("point_id"), "point_id", "left_semi")
        out = out.unionByName(merge_levels(spark, big, usable.join(large.select(F.col("point_id").alias("src")), "src", "left_semi"), threshold, cfg))
    return ws.keep(out)[0]


CHANGES = "kind string, id bigint, a bigint, b bigint, weight double, queued boolean, size bigint, x double, y double, z double, nx double, ny double, nz double, curvature double"


def _level_kernel(cfg: SegmentationConfig, threshold: float, limit: Key | None):  # noqa: ANN202
    """Rows of CHANGES: gone (id, a = its root), grown (id and attributes), edge (id, ends, weight, queued), dead (id), escape
    and touch (id = region, a = bordering region), count (a = value, in the order of COUNTERS)."""

    def run(points: pa.Table, edges: pa.Table) -> pa.Table:
        ids, r, g, col = _load(points, edges)
        own = col["own"].tolist()
        was = list(g.queued)
        counts, escapes = greedy_merge(r, g, cfg, threshold, limit, own)
        rows: list[dict] = []
        for v in range(len(ids)):
            if r.parent[v] != v:
                rows.append({"kind": "gone", "id": ids[v], "a": ids[r.find(v)]})
            elif r.size[v] != col["size"][v]:
                rows.append({"kind": "grown", "id": ids[v], "size": r.size[v], **dict(zip("xyz", r.pos[v])), **dict(zip(("nx", "ny", "nz"), r.nor[v])), "curvature": r.cur[v]})
        for e in range(len(was)):
            a, b = g.left[e], g.right[e]
            if not g.alive[e]:
                rows.append({"kind": "dead", "id": g.number[e]})
            elif g.moved[e] or was[e] != g.queued[e]:
                rows.append({"kind": "edge", "id": g.number[e], "a": ids[a], "b": ids[b], "weight": g.weight[e], "queued": g.queued[e]})
            if g.moved[e] and not (own[a] and own[b]):
                rows.append({"kind": "touch", "id": ids[r.find(a if own[a] else b)], "a": ids[b if own[a] else a]})
        rows += [{"kind": "escape", "id": ids[a], "a": ids[b]} for a, b in escapes]
        rows += [{"kind": "count", "id": i, "a": counts[c]} for i, c in enumerate(COUNTERS)]
        cols = [(x.split()[0], {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[x.split()[1]]) for x in CHANGES.split(", ")]
        return pa.table([pa.array([None if (x := row.get(n)) is None else x.item() if hasattr(x, "item") else x for row in rows], t) for n, t in cols], names=[n for n, _ in cols])

    return run


def _limit(edges: DataFrame, wanted: int, queued: int) -> Key | None:
    """A key of the canonical order with about ``wanted`` queued edges up to it; None stands for all."""
    if wanted >= queued:
        return None
    waiting = edges.where("queued")
    weight = waiting.agg(F.percentile_approx("weight", F.lit(wanted / queued), F.lit(10_000))).first()[0]
    below, equal = waiting.agg(F.count_if(F.col("weight") < weight), F.count_if(F.col("weight") == weight)).first()
    if below >= wanted / 2:
        return weight, -1
    number = waiting.where(F.col("weight") == weight).agg(F.percentile_approx("edge_id", F.lit(min(1.0, (wanted - below) / equal)), F.lit(10_000))).first()[0]
    return weight, number


def merge_levels(spark: SparkSession, vertices: DataFrame, edges: DataFrame, threshold: float, cfg: SegmentationConfig = SegmentationConfig()) -> DataFrame:
    """ROOTS as by one sequential run, level by level over many tasks (see the module's text).

    A level takes few edges for the number of regions at first (``cfg.level_share``), so that few of its merges are neighbours across
    bundles; more where no components had to be put together, fewer where that went on or where a component got more than
    ``cfg.max_component`` regions.  Once no more regions than that are left, one task takes the rest.
    """
    ws = Workspace(spark, "levels")
    start = edges.select("edge_id", "src", "dst", "weight", F.lit(True).alias("queued"))
    if cfg.stop_weight is not None:
        start = start.withColumn("queued", F.col("weight") <= cfg.stop_weight)
    regions, seen_r = ws.keep(vertices.select("point_id", "size", *ATTRIBUTES), n=F.count(F.lit(1)))
    live, seen = ws.keep(start, queued=F.count_if("queued"))
    moves: list[DataFrame] = []
    total = dict.fromkeys(COUNTERS, 0)
    share, left = cfg.level_share, seen_r["n"]
    while seen["queued"]:
        wanted = max(2, int(share * left))
        limit = None if left <= cfg.max_component else _limit(live, wanted, seen["queued"])
        active = live.where("queued")
        if limit is not None:
            active = active.where((F.col("weight") < limit[0]) | ((F.col("weight") == limit[0]) & (F.col("edge_id") <= limit[1])))
        found = stars(spark, active)
        n_active = found.groupBy("u").agg((F.count(F.lit(1)) + 1).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
        if limit is not None and n_active["most"] > cfg.max_component and wanted > 2:
            share /= 2
            continue
        member = found.select(F.col("v").alias("point_id"), F.col("u").alias("component")).unionByName(found.select(F.col("u").alias("point_id"), F.col("u").alias("component")).distinct())
        member, _ = ws.keep(member)
        bundles = 1 if limit is None else max(1, -(-4 * n_active["all"] // cfg.bundle_edges))
        for rounds in count(1):
            out, got = _run_level(ws, regions, live, member, bundles, cfg, threshold, limit)
            clash = out.where("kind = 'escape'").select("id", "a")
            if got["touches"]:
                changed = out.where("kind in ('gone', 'grown')").select(F.col("id").alias("a")).distinct()
                clash = clash.unionByName(out.where("kind = 'touch'").select("id", "a").distinct().join(changed, "a", "left_semi"))
            both = clash.join(member.toDF("id", "c1"), "id").join(member.toDF("a", "c2"), "a", "left")
            links, hit = ws.keep(both.select(F.col("c1").alias("src"), F.coalesce("c2", "a").alias("dst"), F.when(F.col("c2").isNull(), F.col("a")).alias("new")), n=F.count(F.lit(1)))
            if not hit["n"] or (rounds == PATIENCE and wanted > 2):
                break
            joined = stars(spark, links).toDF("component", "into")
            more = links.where("new is not null").select(F.col("new").alias("point_id"), F.col("new").alias("component")).distinct()
            member, _ = ws.keep(member.unionByName(more).join(joined, "component", "left").select("point_id", F.coalesce("into", "component").alias("component")))
        if hit["n"]:
            share /= 2
            continue
        for r in out.where("kind = 'count'").groupBy("id").agg(F.sum("a").alias("n")).collect():  # one row a counter
            total[COUNTERS[r["id"]]] += r["n"]
        gone = out.where("kind = 'gone'").select(F.col("id").alias("gone"), F.col("a").alias("keep"))
        moves.append(gone)
        touched = out.where("kind in ('gone', 'grown')").select(F.col("id").alias("point_id"))
        grown = out.where("kind = 'grown'").select(F.col("id").alias("point_id"), "size", *ATTRIBUTES)
        regions, seen_r = ws.keep(regions.join(touched, "point_id", "left_anti").unionByName(grown), n=F.count(F.lit(1)))
        done = out.where("kind in ('edge', 'dead')").select(F.col("id").alias("edge_id"))
        new = out.where("kind = 'edge'").select(F.col("id").alias("edge_id"), F.col("a").alias("src"), F.col("b").alias("dst"), "weight", "queued")
        if cfg.stop_weight is not None:
            new = new.withColumn("queued", F.col("queued") & (F.col("weight") <= cfg.stop_weight))
        live, seen = ws.keep(live.join(done, "edge_id", "left_anti").unionByName(new), queued=F.count_if("queued"))
        share, left = share * (1.5 if rounds == 1 and n_active["most"] * 8 <= cfg.max_component else 0.7 if rounds > 3 else 1), seen_r["n"]
    # A level's survivors may be absorbed in a later one: compose from the last level back, as tables shrink.
    hop = None
    for m in reversed(moves):
        hop = m if hop is None else m.join(hop.toDF("keep", "k2"), "keep", "left").select("gone", F.coalesce("k2", "keep").alias("keep")).unionByName(hop)
        hop, _ = ws.keep(hop)
    roots = vertices.select("point_id", F.col("point_id").alias("root"))
    if hop is not None:
        roots = roots.join(hop.toDF("point_id", "keep"), "point_id", "left").select("point_id", F.coalesce("keep", "root").alias("root"))
    first = vertices.agg(F.min("point_id")).first()[0]
    counts = [F.when(F.col("point_id") == first, total[c]).otherwise(0).cast("bigint").alias(c) for c in COUNTERS]
    return roots.join(regions.withColumnRenamed("point_id", "root"), "root").select("point_id", "root", "size", "x", "y", "z", "nx", "ny", "nz", *counts)


def _run_level(ws: Workspace, regions: DataFrame, live: DataFrame, member: DataFrame, bundles: int, cfg: SegmentationConfig, threshold: float, limit: Key | None) -> tuple[DataFrame, dict]:
    """CHANGES of all bundles; neighbouring components share a bundle where possible: bundles are slices of x."""
    at = member.join(regions.select("point_id", "x"), "point_id")
    place = at.groupBy("component").agg(F.min(F.struct("point_id", "x")).alias("p")).select("component", F.col("p.x").alias("x"))
    place, _ = ws.keep(place)
    cuts = sorted(set(place.approxQuantile("x", [i / bundles for i in range(1, bundles)], 0.2 / bundles))) if bundles > 1 else []
    slices = F.aggregate(F.array(*[F.lit(c) for c in cuts]), F.lit(0), lambda n, c: n + F.when(F.col("x") >= c, 1).otherwise(0)) if cuts else F.lit(0)
    own = member.join(place.select("component", slices.alias("bundle")), "component").select("point_id", "bundle")
    own, _ = ws.keep(own)
    e = live.join(own.toDF("src", "b1"), "src", "left").join(own.toDF("dst", "b2"), "dst", "left").where("b1 is not null or b2 is not null")
    e = e.withColumn("bundle", F.explode(F.array_distinct(F.array_compact(F.array("b1", "b2"))))).select("bundle", "edge_id", "src", "dst", "weight", "queued", "b1", "b2")
    e, _ = ws.keep(e)
    border = e.select("bundle", F.explode(F.array(F.struct(F.col("src").alias("point_id"), F.col("b1").alias("b")), F.struct(F.col("dst").alias("point_id"), F.col("b2").alias("b")))).alias("p")).select("bundle", "p.*")
    border = border.where("b is null or b <> bundle").select("point_id", "bundle").distinct()
    v = own.withColumn("own", F.lit(True)).unionByName(border.withColumn("own", F.lit(False))).join(regions, "point_id")
    run = v.groupBy("bundle").cogroup(e.drop("b1", "b2").groupBy("bundle")).applyInArrow(_level_kernel(cfg, threshold, limit), CHANGES)
    return ws.keep(run, touches=F.count_if(F.col("kind") == "touch"))


def region_table(roots: DataFrame) -> DataFrame:
    """One row per region: root, size and attributes."""
    return roots.where("point_id = root").select("root", "size", "x", "y", "z", "nx", "ny", "nz")


def merge_metrics(roots: DataFrame) -> DataFrame:
    """One row: points, segments and the merge counters.  segments = points - merges."""
    return roots.agg(
        F.count(F.lit(1)).alias("points"), F.count_if(F.col("point_id") == F.col("root")).alias("segments"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("merges", "skipped", "angle_rejects", "curvature_rejects")]
    )
