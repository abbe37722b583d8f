"""Queries of the training-data operators, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.llm import clusters, components, neighbors, packing, pii, quantiles, tokens


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return components.link_membership(spark, _read(spark, sf, "vertices"), _read(spark, sf, "edges"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c[0] != "p"], *[F.round(c, 9).alias(c) for c in df.columns if c[0] == "p"])


def p3_curvature_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    daily = quantiles.daily_curvature_sketch(_read(spark, sf, "features"))
    return _rounded(quantiles.percentiles(daily, ["scene", "day"], [50, 95, 98, 99]))


def p3_scene_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """The daily sketches put together per scene."""
    daily = quantiles.daily_curvature_sketch(_read(spark, sf, "features"))
    return _rounded(quantiles.percentiles(quantiles.merge(daily, ["scene"]), ["scene"], [50, 95, 98, 99]))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    found = neighbors.nearest_neighbors(spark, _read(spark, sf, "features"), "point_id", ["x", "y", "z"], with_distance=False)
    return neighbors.neighbor_pairs(found)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.members(spark, _read(spark, sf, "features"))


def p5_clusters(spark: SparkSession, sf: str) -> DataFrame:
    found = clusters.describe(spark, _read(spark, sf, "features"))
    return found.withColumn("typical", F.array_join(F.transform("typical", lambda i: i.cast("string")), ","))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_corpus(_read(spark, sf, "documents"), "doc_id", "text")


CAPACITY = 2048


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents").select("doc_id", "source", F.xxhash64("text").alias("cluster"), "text")
    sized = tokens.count_tokens(docs, ["doc_id", "source", "cluster"], "text")
    items = sized.select(F.col("doc_id").alias("item"), F.col("n_tokens").alias("size"), "source", "cluster")
    packed = packing.pack(spark, items, CAPACITY)
    return packed.select("container_id", F.col("item").alias("doc_id"), "piece", F.col("start_at").alias("start_token"), F.col("size").alias("n_tokens"), "relaxed")


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """One row: containers used, the least that could hold all tokens, and the share of room in use."""
    boxes = p8_containers(spark, sf).groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    total = boxes.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"))
    return total.select("containers", F.expr(f"(tokens + {CAPACITY - 1}) div {CAPACITY}").alias("least"), F.round(F.col("tokens") / (F.col("containers") * CAPACITY), 6).alias("fill"))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find(spark, _read(spark, sf, "documents"), _read(spark, sf, "person_names"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).select("doc_id", "kind", "start_at")


def p9_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redact(_read(spark, sf, "documents"), _items(spark, sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p3_curvature_percentiles": p3_curvature_percentiles,
    "p3_scene_percentiles": p3_scene_percentiles,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_clusters": p5_clusters,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_redacted": p9_redacted,
}

_SKETCH = """
WITH once AS (
  SELECT min((scene, scanned_at::DATE, curvature)) AS r FROM features
  WHERE curvature IS NOT NULL AND isfinite(curvature) GROUP BY point_id),
rows AS (SELECT r[1] AS scene, r[2] AS day, r[3] AS v FROM once),
sketch AS (
  SELECT {keys}, sign(v)::INT AS sg,
         CASE WHEN v = 0 THEN 0 ELSE ceil(ln(abs(v)) / ln(1.01 / 0.99)) END AS bucket, count(*) AS n
  FROM rows GROUP BY ALL),
upto AS (
  SELECT *, sg * CASE WHEN sg = 0 THEN 0 ELSE pow(1.01 / 0.99, bucket) * 2 / (1.01 / 0.99 + 1) END AS val,
         sum(n) OVER (PARTITION BY {keys} ORDER BY sg, sg * bucket) AS cum,
         sum(n) OVER (PARTITION BY {keys}) AS total
  FROM sketch)
SELECT {keys}, max(total)::BIGINT AS n,
       round(min(val) FILTER (cum > least(total * 50 // 100, total - 1)), 9) AS p50,
       round(min(val) FILTER (cum > least(total * 95 // 100, total - 1)), 9) AS p95,
       round(min(val) FILTER (cum > least(total * 98 // 100, total - 1)), 9) AS p98,
       round(min(val) FILTER (cum > least(total * 99 // 100, total - 1)), 9) AS p99
FROM upto GROUP BY {keys}
"""

_REACH = """
WITH RECURSIVE pts AS (
  SELECT point_id, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z, any_value(nx) AS nx, any_value(ny) AS ny,
         any_value(nz) AS nz, any_value(curvature) AS c
  FROM features WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND isfinite(nx) AND isfinite(ny) AND isfinite(nz) AND isfinite(curvature)
  GROUP BY point_id),
near AS (
  SELECT *, floor(x / 0.5) + dx AS kx, floor(y / 0.5) + dy AS ky
  FROM pts, (VALUES (-1), (0), (1)) AS a(dx), (VALUES (-1), (0), (1)) AS b(dy)),
links AS (
  SELECT a.point_id AS u, b.point_id AS v
  FROM pts a JOIN near b ON floor(a.x / 0.5) = b.kx AND floor(a.y / 0.5) = b.ky AND a.point_id <> b.point_id
  WHERE sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) <= 0.5
    AND acos(greatest(-1, least(1, a.nx*b.nx + a.ny*b.ny + a.nz*b.nz))) <= 0.52 AND abs(a.c - b.c) <= 0.02),
reach(point_id, group_id) USING KEY (point_id) AS (
  SELECT u, min(least(u, v)) FROM links GROUP BY u
  UNION
  SELECT l.v, min(r.group_id) FROM reach r JOIN links l ON l.u = r.point_id
  JOIN recurring.reach o ON o.point_id = l.v WHERE r.group_id < o.group_id GROUP BY l.v)
"""
_LIKE = clusters.Likeness()
_CELL = ", ".join(f"floor({c} * {1 / w!r}) AS q{i}" for i, (c, w) in enumerate(zip(("x", "y", "z", "nx", "ny", "nz", "c"), _LIKE.widths()))) + (
    f", CASE WHEN abs(nx * nx + ny * ny + nz * nz - 1) < {_LIKE.unit()!r} AND "
    + " AND ".join(f"abs({c}) < {w * 1e9!r}" for c, w in zip(("x", "y", "z", "c"), (*_LIKE.widths()[:3], _LIKE.widths()[6])))
    + " THEN -1 ELSE point_id END AS q7"
)

ORACLE: dict[str, str] = {
    "p1_found": """
WITH RECURSIVE links AS (
  SELECT src AS u, dst AS v FROM edges WHERE src >= 0 AND dst >= 0 AND src <> dst
  UNION SELECT vertex_id, parent FROM vertices WHERE vertex_id >= 0 AND parent >= 0 AND vertex_id <> parent),
both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach(vertex_id, group_id) USING KEY (vertex_id) AS (
  SELECT u, min(least(u, v)) FROM both_ways GROUP BY u
  UNION
  SELECT b.v, min(r.group_id) FROM reach r JOIN both_ways b ON b.u = r.vertex_id
  JOIN recurring.reach o ON o.vertex_id = b.v WHERE r.group_id < o.group_id GROUP BY b.v)
SELECT vertex_id, group_id FROM reach
""",
    "p4_found": """
WITH pts AS (
  SELECT point_id, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z FROM features
  WHERE isfinite(x) AND isfinite(y) AND isfinite(z) GROUP BY point_id),
near AS (
  SELECT a.point_id AS a,
         unnest(list_transform(min({'d': (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), 'b': b.point_id}, 3), lambda t: t.b)) AS b
  FROM pts a JOIN pts b ON a.point_id <> b.point_id GROUP BY a.point_id)
SELECT DISTINCT least(a, b) AS point_a, greatest(a, b) AS point_b FROM near
""",
    "p5_found": f"{_REACH} SELECT point_id, group_id FROM reach QUALIFY count(*) OVER (PARTITION BY group_id) >= 5",
    "p5_clusters": f"""{_REACH},
placed AS (SELECT point_id, {_CELL} FROM pts),
named AS (SELECT point_id, min(point_id) OVER w AS cell, count(*) OVER w AS n FROM placed WINDOW w AS (PARTITION BY q0, q1, q2, q3, q4, q5, q6, q7)),
grouped AS (SELECT r.group_id, cell, max(n) AS n, string_agg(point_id::VARCHAR, ',' ORDER BY point_id) FILTER (k <= 3) AS typical
  FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY point_id) AS k FROM named) JOIN reach r USING (point_id) GROUP BY ALL)
SELECT group_id, sum(n)::BIGINT AS size, count(*) AS cells, max(n) AS densest, arg_min(typical, {{'n': -n, 'cell': cell}}) AS typical FROM grouped GROUP BY group_id HAVING sum(n) >= 5""",
    "p3_curvature_percentiles": _SKETCH.format(keys="scene, day"),
    "p3_scene_percentiles": _SKETCH.format(keys="scene"),
}
