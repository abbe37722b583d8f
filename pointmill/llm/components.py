"""Consolidating pairwise matches into groups: deterministic Boruvka hooking on DataFrames.

Every live component picks its smallest outgoing edge (edges are ordered by their smaller, then by their
larger end, so this is the edge to the smallest neighbour).  The chosen edges form trees with one
mutual pair each; ``f(c) = least(f(c), f(f(c)))`` doubles pointers until each tree is a star whose
centre is its smallest id.  Edges are relabelled, loops and repeats dropped, and the next round runs on
what is left.  The number of live components at least halves per round.

Nothing is gathered to the driver but two counters per written table.  A hub holding a third of all
edges is met by map-side ``min``; the relabelling joins have a unique build side and are left to AQE's
skew join on the probe side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.workspace import Workspace


def clean_links(df: DataFrame, left: str, right: str) -> DataFrame:
    """(u, v) with u < v of the usable links: null or negative ends and loops are no links."""
    a, b = F.col(left).cast("bigint"), F.col(right).cast("bigint")
    return df.where((a >= 0) & (b >= 0) & (a != b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))


def group_links(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(vertex_id, group_id) for every vertex that occurs in ``links`` (u, v; u < v, repeats allowed).

    group_id is the smallest vertex of the group.  An empty input gives an empty result.  The links are written once,
    without their repeats.
    """
    ws = Workspace(spark, "components")
    edges, stars, live = ws.keep(links.distinct())[0], [], None
    while True:
        ends = edges.select(F.col("u").alias("c"), F.col("v").alias("f")).union(edges.select("v", "u"))
        star, live = _stars(ws, ends.groupBy("c").agg(F.min("f").alias("f")))
        if not live:
            ws.drop(star)
            break
        stars.append(star)
        left, right = star.toDF("u", "fu"), star.toDF("v", "fv")
        moved = edges.join(left, "u").join(right, "v").where("fu <> fv")
        rest, seen = ws.keep(moved.select(F.least("fu", "fv").alias("u"), F.greatest("fu", "fv").alias("v")).distinct(), n=F.count(F.lit(1)))
        if len(stars) > 1:
            ws.drop(edges)
        edges = rest
        if not seen["n"]:
            break
    if not stars:
        return spark.createDataFrame([], "vertex_id bigint, group_id bigint")
    top = stars.pop()
    while stars:
        upper = top.toDF("f", "g")
        top = stars.pop().join(upper, "f", "left").select("c", F.coalesce("g", "f").alias("f"))
    return top.toDF("vertex_id", "group_id")


def _stars(ws: Workspace, chosen: DataFrame) -> tuple[DataFrame, int]:
    """Collapse the hooking forest (c, f) to (c, smallest id of its tree) by pointer doubling."""
    table = chosen
    kept = None
    while True:
        far = table.select(F.col("c").alias("f"), F.col("f").alias("ff"))
        step = table.join(far, "f", "left").select("c", F.least("f", "ff").alias("g"), "f")
        step = step.select("c", F.col("g").alias("f"), (F.col("g") != F.col("f")).alias("moved"))
        done, seen = ws.keep(step, n=F.count(F.lit(1)), moved=F.count_if("moved"))
        if kept is not None:
            ws.drop(kept)
        kept = done
        table = done.select("c", "f")
        table._kept_at = done._kept_at
        if not seen["moved"]:
            return table, seen["n"]


def link_membership(spark: SparkSession, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """p1_found: groups of at least two vertices over edges(src, dst) and vertices(vertex_id, parent)."""
    links = clean_links(edges, "src", "dst").union(clean_links(vertices, "vertex_id", "parent"))
    return group_links(spark, links)


def group_all(spark: SparkSession, records: DataFrame, links: DataFrame) -> DataFrame:
    """(vertex_id, group_id) for every non-null id of ``records.vertex_id``; unlinked records are their own group."""
    grouped = group_links(spark, links)
    everyone = records.select("vertex_id").where("vertex_id is not null").distinct()
    return everyone.join(grouped, "vertex_id", "full").select("vertex_id", F.coalesce("group_id", "vertex_id").alias("group_id"))
