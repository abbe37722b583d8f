"""Connected components: edges contracted where they lie, then alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.workspace import Workspace

CHUNK_EDGES = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex of its component) of the vertices that are not the smallest themselves."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(ids))
    while len(a):
        la, lb = low[a], low[b]
        m = np.minimum(la, lb)
        np.minimum.at(low, la, m)
        np.minimum.at(low, lb, m)
        while True:
            up = low[low]
            if np.array_equal(up, low):
                break
            low = up
        open_ = low[a] != low[b]
        a, b = a[open_], b[open_]
    rest = np.flatnonzero(low != np.arange(len(ids)))
    return ids[rest], ids[low[rest]]


def _contract(batches: Iterator[pa.RecordBatch], chunk_edges: int) -> Iterator[pa.RecordBatch]:
    """Edges (v, u) of a chunk of a partition replaced by a star for each of its components."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        v, u = forest(t.column("v").to_numpy(), t.column("u").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(v), pa.array(u)], names=["v", "u"])

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= chunk_edges:
            yield star(held)
            held, rows = [], 0
    if rows:
        yield star(held)


def stars(spark: SparkSession, edges: DataFrame, chunk_edges: int = CHUNK_EDGES) -> DataFrame:
    """(v, u): every vertex of ``edges`` but the smallest of its component, beside that smallest vertex.

    Loops, repeated edges and either order of the ends are allowed; ends that are null are no edges.  Every chunk of
    edges is contracted to stars where it lies, so what is shuffled is at most one edge per vertex and chunk.  While
    more than a chunk is left, a large-star and a small-star step (a minimum per vertex, combined before the shuffle)
    pull the stars of different chunks together; a rest of one chunk is contracted in one task.  Tables are cut to the
    shared folder after each round and convergence is read from counters of the write.
    """
    ws = Workspace(spark, "stars")
    seen_by = {"n": F.count(F.lit(1)), "h": F.coalesce(F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 40))), F.lit(0))}

    def contract(df: DataFrame) -> DataFrame:
        return df.mapInArrow(lambda batches: _contract(batches, chunk_edges), "v bigint, u bigint")

    pairs = edges.where("src <> dst").select(F.greatest("src", "dst").cast("bigint").alias("v"), F.least("src", "dst").cast("bigint").alias("u"))
    kept, seen = ws.keep(contract(pairs), **seen_by)
    last = None
    while seen["n"] > chunk_edges and seen != last:
        last = seen
        # Large star: link all larger neighbours of a vertex to the smallest of its neighbourhood.
        both = kept.select("v", "u").union(kept.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        # Small star: link a vertex and its smaller neighbours to the smallest of them.
        low2 = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low2, "v").select(F.explode(F.array("v", "u")).alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        nxt, seen = ws.keep(small, **seen_by)
        ws.drop(kept)
        kept = nxt
    if seen != last:
        kept, _ = ws.keep(contract(kept.coalesce(1)))
    return kept


def connected_components(spark: SparkSession, points: DataFrame, edges: DataFrame, vertex: str = "point_id", chunk_edges: int = CHUNK_EDGES) -> DataFrame:
    """(vertex, component): the smallest vertex of each vertex's component; vertices without edges are their own (see ``stars``)."""
    found = stars(spark, edges, chunk_edges)
    return points.select(F.col(vertex).alias("_p")).join(found, F.col("_p") == F.col("v"), "left").select(F.col("_p").alias(vertex), F.coalesce("u", "_p").alias("component"))
