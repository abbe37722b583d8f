"""Neighbour joins: radius self-join and nearest-neighbour label transfer, both as equi-joins on grid blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointmill.functions.vector import distance_squared, finite, triple
from pointmill.workspace import Workspace


def in_blocks(points: DataFrame, radius: float, side: float) -> DataFrame:
    """Rows with home block bx, by, bz, repeated for each block kx, ky, kz the point belongs to.

    A block reaches one radius below its edge on every axis: two points within a radius of one another share
    the block that is, axis by axis, home to the further of the two.  With a side of two radii a row occurs
    3.4 times on average instead of 27, and the copies are made before the shuffle.
    """
    at = points.withColumns({f"b{c}": F.floor(F.col(c) / F.lit(side)) for c in "xyz"})
    for c in "xyz":
        ahead = F.floor((F.col(c) + F.lit(radius * (1 + 1e-9))) / F.lit(side))
        at = at.withColumn(f"k{c}", F.explode(F.when(ahead != F.col(f"b{c}"), F.array(F.col(f"b{c}"), ahead)).otherwise(F.array(f"b{c}"))))
    return at


def same_block(a: str, b: str) -> Column:
    """Join condition under which each near pair meets exactly once."""
    keys = [F.col(f"{a}.k{c}") == F.col(f"{b}.k{c}") for c in "xyz"]
    once = [F.col(f"{a}.k{c}") == F.greatest(f"{a}.b{c}", f"{b}.b{c}") for c in "xyz"]
    return reduce(lambda p, q: p & q, keys + once)


def near_pairs(points: DataFrame, radius: float, inclusive: bool = True, side_factor: float = 2.0) -> DataFrame:
    """The rows of ``points`` as sides a and b (a.point_id < b.point_id), joined where they are within ``radius``.

    Whatever the caller reads of the two sides comes out of this join, so nothing has to be fetched back by id.
    Points with a null or non-finite coordinate have no pairs.  Both sides of the join are the same
    expression, so Spark shuffles it once and reads it twice; AQE splits blocks that hold too many points.
    """
    ok = reduce(lambda p, q: p & q, [finite(F.col(c)) for c in "xyz"])
    at = in_blocks(points.where(ok), radius, side_factor * radius)
    a, b = at.alias("a"), at.alias("b")
    d2 = distance_squared(triple("a"), triple("b"))
    near = (d2 <= radius * radius) if inclusive else (d2 < radius * radius)
    return a.join(b, same_block("a", "b") & (F.col("a.point_id") < F.col("b.point_id")) & near)


def radius_pairs(points: DataFrame, radius: float, inclusive: bool = True, side_factor: float = 2.0) -> DataFrame:
    """(src, dst, d2) with src < dst of all pairs of points within ``radius``."""
    pairs = near_pairs(points.select("point_id", "x", "y", "z"), radius, inclusive, side_factor)
    return pairs.select(F.col("a.point_id").alias("src"), F.col("b.point_id").alias("dst"), distance_squared(triple("a"), triple("b")).alias("d2"))


def radius_pairs_brute(points: DataFrame, radius: float) -> DataFrame:
    """The same pairs by comparing all points; for tests on small clouds only."""
    a, b = points.alias("a"), points.alias("b")
    d2 = distance_squared(triple("a"), triple("b"))
    return a.join(b, (F.col("a.point_id") < F.col("b.point_id")) & (d2 <= radius * radius)).select(F.col("a.point_id").alias("src"), F.col("b.point_id").alias("dst"), d2.alias("d2"))


def degrees(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """(point_id, degree) of every point, 0 without neighbours."""
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("point_id")).groupBy("point_id").agg(F.count(F.lit(1)).alias("degree"))
    return points.select("point_id").join(ends, "point_id", "left").select("point_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def nearest_label(spark: SparkSession, raw: DataFrame, centers: DataFrame, label: str, cell: float, growth: int = 4) -> DataFrame:
    """(point_id, label): label of the nearest row of ``centers`` for each row of ``raw``, ties to the smaller center id.

    Centers are listed in the 27 cells around them, raw points look into their own cell only; a nearest center
    within one cell's length is final.  The rest, sparse outliers, descends a pyramid of cells ``growth`` times as
    wide from level to level: at each level it keeps the cells whose box may still hold the nearest center.  Exact.

    The label is 0 for raw points with a null or non-finite coordinate, and for all if no center has a finite position.
    """
    ws = Workspace(spark, "nearest")
    ok = reduce(lambda p, q: p & q, [finite(F.col(c)) for c in "xyz"])
    kind = centers.schema[label].dataType
    none = F.lit(0).cast(kind).alias("label")
    lab = centers.where(ok).select(F.col("point_id").alias("center_id"), F.col(label).alias("label"), *[F.col(c).alias(f"t{c}") for c in "xyz"])
    lab, got = ws.keep(lab, n=F.count(F.lit(1)))
    todo = raw.select("point_id", "x", "y", "z")
    if not got["n"]:
        return todo.select("point_id", none)
    lost = todo.where(~F.coalesce(ok, F.lit(False))).select("point_id", none)
    todo = todo.where(ok)
    cells = {f"c{c}": F.floor(F.col(f"t{c}") / F.lit(cell)) for c in "xyz"}
    spread = lab.withColumns(cells)
    for c in "xyz":
        spread = spread.withColumn(f"c{c}", F.explode(F.array(*[F.col(f"c{c}") + F.lit(s) for s in (-1, 0, 1)])))
    d2 = distance_squared(triple(""), [F.col(f"t{c}") for c in "xyz"])
    home = {f"c{c}": F.floor(F.col(c) / F.lit(cell)) for c in "xyz"}
    met = todo.withColumns(home).join(spread, ["cx", "cy", "cz"], "left")
    rival = F.when(d2 <= cell * cell, F.struct(d2.alias("d2"), F.col("center_id").alias("center_id"), F.col("label").alias("label")))
    # A raw point's candidates share its cell, hence its partition: this aggregates fully before the shuffle.
    best = met.groupBy("point_id").agg(F.min(rival).alias("best"), *[F.first(c).alias(c) for c in "xyz"])
    seen, got = ws.keep(best, left=F.count_if(F.col("best").isNull()))
    done = seen.where("best is not null").select("point_id", "best.label").unionByName(lost)
    return done.unionByName(_descend(ws, seen.where("best is null").select("point_id", *"xyz"), lab, cell, growth)) if got["left"] else done


def _descend(ws: Workspace, todo: DataFrame, centers: DataFrame, cell: float, growth: int, top: int = 64) -> DataFrame:
    """(point_id, label) of the nearest center: candidate cells are narrowed from the pyramid's top, of at most ``top`` cells, to its ground."""
    names = ["cx", "cy", "cz"]
    boxes = [f(f"t{c}").alias(f"{o}{c}") for c in "xyz" for f, o in ((F.min, "lo"), (F.max, "hi"))]
    outer = [f(f"{o}{c}").alias(f"{o}{c}") for c in "xyz" for f, o in ((F.min, "lo"), (F.max, "hi"))]
    ground = centers.withColumns({n: F.floor(F.col(f"t{c}") / F.lit(cell)) for n, c in zip(names, "xyz")})
    level, got = ws.keep(ground.groupBy(*names).agg(*boxes), n=F.count(F.lit(1)))
    levels = [level]
    while got["n"] > top:
        up = level.withColumns({n: F.floor(F.col(n) / F.lit(growth)) for n in names}).groupBy(*names).agg(*outer)
        level, got = ws.keep(up, n=F.count(F.lit(1)))
        levels.append(level)
    nearest, farthest = F.lit(0.0), F.lit(0.0)
    for c in "xyz":
        p, lo, hi = F.col(c), F.col(f"lo{c}"), F.col(f"hi{c}")
        gap, far = F.greatest(F.lit(0.0), lo - p, p - hi), F.greatest(F.abs(p - lo), F.abs(p - hi))
        nearest, farthest = nearest + gap * gap, farthest + far * far
    held = todo.join(F.broadcast(levels.pop()), how="cross")  # at most ``top`` rows on the right
    while True:
        reach = Window.partitionBy("point_id")
        held = held.withColumns({"_near": nearest, "_far": F.min(farthest).over(reach)}).where(F.col("_near") <= F.col("_far") * (1 + 1e-9)).select("point_id", *"xyz", *names)
        held, _ = ws.keep(held)
        if not levels:
            break
        below = levels.pop()
        above = {f"_{n}": F.floor(F.col(n) / F.lit(growth)) for n in names}
        held = held.toDF("point_id", *"xyz", *[f"_{n}" for n in names]).join(below.withColumns(above), [f"_{n}" for n in names]).drop(*[f"_{n}" for n in names])
    d2 = distance_squared(triple(""), [F.col(f"t{c}") for c in "xyz"])
    met = held.join(ground, names).select("point_id", F.struct(d2.alias("d2"), "center_id", "label").alias("o"))
    return met.groupBy("point_id").agg(F.min("o").alias("o")).select("point_id", "o.label")


def zip_by_id(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two tables side by side by point_id; both must have the same ids (see ``require_same_length``)."""
    return left.join(right, "point_id")


def require_same_length(left: DataFrame, right: DataFrame, what: str = "tables") -> int:
    """Number of rows of both; ValueError if they differ."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{what} differ in length: {n} and {m}")
    return n
