"""Grouping points into clusters of alike points: grid density clustering in SQL.

1. Quantise position, normal and curvature so finely that all points of one cell are alike.
2. Count the cells; a cell is named by its smallest point id, whose features stand for it.  Cells of fewer than
   ``min_cell`` points are not dense and drop out.
3. Join dense cells that are near enough on the lattice to hold alike points: cells share a block of the lattice (with a margin
   of the two cells that a radius reaches); a crowded block is divided further by curvature, position and normal.  A pair
   whose named points are alike is a link.  If they are not and a cell holds more points, the pair is open.
4. Propagate minimum labels over the links to convergence (``operators.components.stars``; links are contracted in the task
   that finds them, so what leaves it is a star for each group it knows).  Open pairs that ended in
   different groups are settled on their points, by ever finer cells of the two, and their links are added.
5. Sum the cells' counts per cluster; the members of a cluster's densest cell are its most typical ones.

Two points are alike if their distance, the angle between their normals and the difference of their curvatures are
all within their limits.  With ``min_cell`` 1 the result is exact: quantisation only saves comparisons.  Points are
compared one by one only in open pairs between different groups, so a crowd costs what its cells cost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointmill.operators.components import CHUNK_EDGES, forest, stars
from pointmill.workspace import Workspace


@dataclass(frozen=True)
class Likeness:
    """Limits of likeness, the points a cell needs to count as dense, and the size of a cluster to be reported."""

    distance: float = 0.5
    angle: float = 0.52
    curvature: float = 0.02
    min_points: int = 5
    min_cell: int = 1

    def __post_init__(self) -> None:
        if min(self.distance, self.angle, self.curvature) <= 0:
            raise ValueError("the limits of likeness must be positive")

    def unit(self) -> float:
        """How far the squared length of an ordinary normal may be from 1."""
        return 1e-3 * min(1.0, self.angle**2)

    def chord(self) -> float:
        """Largest difference of two ordinary normals within the angle."""
        return math.sqrt((2 * math.sin(min(self.angle, math.pi) / 2)) ** 2 + 2 * self.unit())

    def widths(self) -> list[float]:
        """Widths of a cell along the seven features: two ordinary points of a cell are within every limit."""
        turn = 2 * math.sin(min(self.angle, math.pi) / 2) / math.sqrt(3) * 0.98
        return [self.distance / math.sqrt(3) * 0.998] * 3 + [turn] * 3 + [self.curvature * 0.998]


FEATURES = ["x", "y", "z", "nx", "ny", "nz", "curvature"]
#: Cells per side of a block, cells that the margin reaches, and how many cells of a block are compared pair by pair.
BLOCK, MARGIN, CROWD = 10, 2, 3000


def usable_points(features: DataFrame) -> DataFrame:
    """One row per point with all features finite; renewed rows and rows without an id drop out."""
    ok = F.col("point_id").isNotNull()
    for c in FEATURES:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf")))
    rows = features.where(ok).select(F.col("point_id").alias("id"), *[(F.col(c) + F.lit(0.0)).alias(c) for c in FEATURES])
    return rows.groupBy("id").agg(F.min(F.struct(*FEATURES)).alias("p")).select("id", "p.*")


def plain(like: Likeness, prefix: str = "") -> Column:
    """Whether the features are of the ordinary kind: normals of length 1 (nearly, the nearer the smaller the angle) and numbers
    that leave cells sharp.  Anything else is a cell of its own."""
    nx, ny, nz = (F.col(prefix + c) for c in FEATURES[3:6])
    sharp = [F.abs(F.col(prefix + c)) < w * 1e9 for c, w in zip(FEATURES, like.widths()) if c[0] != "n"]
    return (F.abs(nx * nx + ny * ny + nz * nz - 1) < like.unit()) & sharp[0] & sharp[1] & sharp[2] & sharp[3] & F.lit(min(like.widths()[3:]) > 1e-7)


def lattice(like: Likeness, scale: int = 1, prefix: str = "") -> list[Column]:
    """The seven cell numbers of a point."""
    return [F.floor(F.col(prefix + c) * F.lit(scale / w)) for c, w in zip(FEATURES, like.widths())]


def cell_keys(like: Likeness, name: str = "id") -> dict[str, Column]:
    """Columns that are equal exactly for points of one cell."""
    return {f"q{i}": q for i, q in enumerate(lattice(like))} | {"q7": F.when(plain(like), F.lit(-1)).otherwise(F.col(name))}


def _difference(a: str, b: str, c: str) -> Column:
    return F.col(f"{a}.{c}") - F.col(f"{b}.{c}")


def _squared(a: str, b: str) -> Column:
    x, y, z = (_difference(a, b, c) for c in "xyz")
    return x * x + y * y + z * z


def _dot(a: str, b: str) -> Column:
    x, y, z = (F.col(f"{a}.{c}") * F.col(f"{b}.{c}") for c in ("nx", "ny", "nz"))
    return x + (y + z)


def alike(a: str, b: str, like: Likeness) -> Column:
    """The exact test on two aliased sides."""
    dot = _dot(a, b)
    near = F.sqrt(_squared(a, b)) <= like.distance
    # The cosine is compared first, with room for rounding, to spare most pairs the arc.
    turned = (dot >= math.cos(min(like.angle, math.pi)) - 1e-9) & (F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) <= like.angle)
    return near & (F.abs(_difference(a, b, "curvature")) <= like.curvature) & turned


def may_be_alike(a: str, b: str, like: Likeness, scale: int) -> Column:
    """Whether the cells of two sides, ``scale`` times as fine, are near enough on the lattice to hold alike points (never false if they do)."""
    p, q = lattice(like, scale, f"{a}."), lattice(like, scale, f"{b}.")
    gaps = [F.greatest(F.lit(0.0), F.abs(i.cast("double") - j.cast("double")) - 1) for i, j in zip(p, q)]
    slack = 1 + 1e-6
    edge, turn, bend = (like.widths()[i] / scale for i in (0, 3, 6))
    near = gaps[6] <= like.curvature / bend * slack
    for (x, y, z), limit in ((gaps[:3], (like.distance / edge) ** 2), (gaps[3:6], (like.chord() / turn) ** 2)):
        near = near & (x * x + y * y + z * z <= limit * slack)
    return near | ~plain(like, f"{a}.") | ~plain(like, f"{b}.")


def _in_blocks(cells: DataFrame, numbers: dict[str, Column], side: int, margin: int) -> DataFrame:
    """Rows once for each block: columns k<name> for each lattice number; a cell also enters the next block its margin reaches."""
    out = cells
    for name, q in numbers.items():
        here, ahead = F.floor(q / F.lit(side)), F.floor((q.cast("double") + F.lit(margin)) / F.lit(side))
        out = out.withColumn(f"k{name}", F.explode(F.when(ahead != here, F.array(here, ahead)).otherwise(F.array(here))))
    return out


def _met_here(numbers: dict[str, tuple[Column, Column]], side: int) -> Column:
    """A pair that meets in several blocks counts in the one that is home to its further cell on every axis."""
    ok = F.lit(True)
    for name, (p, q) in numbers.items():
        ok = ok & (F.col(f"a.k{name}") == F.col(f"b.k{name}")) & (F.col(f"a.k{name}") == F.floor(F.greatest(p, q) / F.lit(side)))
    return ok


def near_cells(ws: Workspace, cells: DataFrame, like: Likeness) -> DataFrame:
    """(u, v, sure): pairs of cells, u < v, whose named points are alike (sure), or that may hold alike points and one has more than one."""
    plan = {"x": (0, BLOCK), "y": (1, BLOCK), "z": (2, BLOCK)}
    # Inside a crowded block: normals and curvature by four cells, positions by five of the block's ten.
    fine = {"i": (0, 5), "j": (1, 5), "k": (2, 5), "l": (3, 4), "m": (4, 4), "o": (5, 4), "c": (6, 4)}
    at = _in_blocks(cells, {n: lattice(like)[i] for n, (i, _) in plan.items()}, BLOCK, MARGIN)
    at = at.select("kx", "ky", "kz", *FEATURES, "cell", "n")
    crowds, seen = ws.keep(at.groupBy("kx", "ky", "kz").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > CROWD).select("kx", "ky", "kz"), n=F.count(F.lit(1)))

    def pairs(table: DataFrame, keys: list[tuple[dict, int]], odd_only: bool = False) -> DataFrame:
        by = [f"k{n}" for names, _ in keys for n in names]
        # Cells' numbers are computed behind the exchange.  No block is hot: those of many cells are divided.
        sides = table.repartition(*by).withColumns({f"_q{i}": q.cast("double") for i, q in enumerate(lattice(like))} | {"_odd": ~plain(like), "_one": F.col("n") == 1})
        numbers = [F.col(f"a._q{i}") for i in range(7)], [F.col(f"b._q{i}") for i in range(7)]
        here = F.lit(True)
        for names, width in keys:
            here = here & _met_here({n: (numbers[0][i], numbers[1][i]) for n, i in names.items()}, width)
        a, b = (sides.where("_odd") if odd_only else sides).alias("a"), sides.alias("b")
        once = F.col("a.cell") < F.col("b.cell")
        if odd_only:
            once = (F.col("a.cell") != F.col("b.cell")) & (once | ~F.col("b._odd"))
        # A rough bound that never leaves out a wanted pair; the JVM compiles no method above a certain size, so the rest waits.
        several = ~(F.col("a._one") & F.col("b._one"))
        bound = (_squared("a", "b") <= like.distance**2 * (1 + 1e-9)) & (F.abs(_difference("a", "b", "curvature")) <= like.curvature) & (_dot("a", "b") >= math.cos(min(like.angle, math.pi)) - 1e-9)
        close = several
        for p, q in zip(*numbers):
            close = close & (F.abs(p - q) <= MARGIN)
        met = a.join(b, once & (bound | close | (F.col("a._odd") & ~F.col("b._one")) | (F.col("b._odd") & ~F.col("a._one"))) & here)
        named = met.select(F.least("a.cell", "b.cell").alias("u"), F.greatest("a.cell", "b.cell").alias("v"), alike("a", "b", like).alias("sure"), several.alias("several"))
        return named.where("sure or several").select("u", "v", "sure")

    wide = ({n: i for n, (i, _) in plan.items()}, BLOCK)
    if not seen["n"]:
        return pairs(at, [wide])
    key = ["kx", "ky", "kz"]
    few, dense = at.join(crowds, key, "left_anti"), at.join(crowds, key, "left_semi")
    keys, divided = [wide], dense.where(plain(like))  # normals that are not of unit length may be alike across the divisions
    for side in sorted({s for _, s in fine.values()}):
        names = {n: i for n, (i, s) in fine.items() if s == side}
        divided = _in_blocks(divided, {n: lattice(like)[i] for n, i in names.items()}, side, MARGIN)
        keys.append((names, side))
    return pairs(few, [wide]).unionByName(pairs(divided, keys)).unionByName(pairs(dense, [wide], odd_only=True))


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sure pairs of a chunk replaced by stars, and the open pairs that these leave in different groups."""

    def reduced(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        u, v, sure = (t.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v", "sure"))
        leaf, top = forest(u[sure], v[sure])
        order = np.argsort(leaf)
        leaf, top = leaf[order], top[order]
        ends = []
        for e in (u[~sure], v[~sure]):
            i = np.minimum(np.searchsorted(leaf, e), max(0, len(leaf) - 1))
            ends.append(np.where(leaf[i] == e, top[i], e) if len(leaf) else e)
        apart = ends[0] != ends[1]
        left = [np.concatenate([top, u[~sure][apart]]), np.concatenate([leaf, v[~sure][apart]])]
        return pa.RecordBatch.from_arrays([pa.array(left[0]), pa.array(left[1]), pa.array(np.arange(len(left[0])) < len(top))], names=["u", "v", "sure"])

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= CHUNK_EDGES:
            yield reduced(held)
            held, rows = [], 0
    if rows:
        yield reduced(held)


def settle(ws: Workspace, open_pairs: DataFrame, points: DataFrame, cells: DataFrame, like: Likeness) -> DataFrame:
    """The (u, v) of ``open_pairs`` that hold two alike points.

    Both cells' points are put into finer cells round by round; a pair is settled once two named points are alike or no finer
    cells are near any more, at last by the points themselves.
    """
    involved = open_pairs.select(F.explode(F.array("u", "v")).alias("cell")).distinct()
    held = cells.join(involved, "cell", "left_semi").withColumns(cell_keys(like, "cell")).select("cell", *[f"q{i}" for i in range(8)])
    members, _ = ws.keep(points.withColumns(cell_keys(like)).join(held, [f"q{i}" for i in range(8)]).select("cell", *FEATURES).distinct())
    todo, found, scale = open_pairs.select("u", "v"), [], 1
    while True:
        scale *= 4
        last = scale > 4**8

        def side(end: str) -> DataFrame:
            other = cells.select(F.col("cell").alias("other"), *[F.col(c).alias(f"o_{c}") for c in FEATURES])
            rows = todo.join(members.withColumnRenamed("cell", end), end).join(other, F.col("other") == F.col("v" if end == "u" else "u"))
            rows = rows.select("u", "v", F.struct(*FEATURES).alias("p"), F.struct(*[F.col(f"o_{c}").alias(c) for c in FEATURES]).alias("o"))
            rows = rows.where(_reaches("p", "o", like))
            finer = [F.col("p")] if last else lattice(like, scale, "p.")
            by = rows.groupBy("u", "v", *[q.alias(f"f{i}") for i, q in enumerate(finer)]).agg(F.min("p").alias("s"), (F.min("p") != F.max("p")).alias("more"))
            return by.select("u", "v", "s", "more")

        a, b = side("u").select("u", "v", F.col("s").alias("a"), F.col("more").alias("am")), side("v").select("u", "v", F.col("s").alias("b"), F.col("more").alias("bm"))
        both = a.join(b, ["u", "v"])
        sure = alike("a", "b", like)
        left = (F.col("am") | F.col("bm")) & may_be_alike("a", "b", like, scale)
        judged, seen = ws.keep(both.groupBy("u", "v").agg(F.bool_or(sure).alias("sure"), F.bool_or(left).alias("left")), left=F.count_if(~F.col("sure") & F.col("left")))
        found.append(judged.where("sure").select("u", "v"))
        if not seen["left"]:
            break
        todo = judged.where("not sure and left").select("u", "v")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _reaches(p: str, o: str, like: Likeness) -> Column:
    """Whether a point may be alike to some point of the lattice cell of another."""
    far, turn = F.lit(0.0), F.lit(0.0)
    gaps = []
    for c, w, q in zip(FEATURES, like.widths(), lattice(like, 1, f"{o}.")):
        low = q.cast("double") * F.lit(w)
        gaps.append(F.greatest(F.lit(0.0), low - F.col(f"{p}.{c}"), F.col(f"{p}.{c}") - low - F.lit(w)))
    for g in gaps[:3]:
        far = far + g * g
    for g in gaps[3:6]:
        turn = turn + g * g
    near = (far <= like.distance**2 * (1 + 1e-6)) & (gaps[6] <= like.curvature * (1 + 1e-6)) & (turn <= like.chord() ** 2 * (1 + 1e-6))
    return near | ~plain(like, f"{o}.") | ~plain(like, f"{p}.")


def clustered_cells(spark: SparkSession, features: DataFrame, like: Likeness = Likeness()) -> tuple[DataFrame, DataFrame]:
    """(points, dense cells with the features of their named point, their count and group)."""
    ws = Workspace(spark, "clusters")
    points, _ = ws.keep(usable_points(features))
    keys = cell_keys(like)
    counted = points.withColumns(keys).groupBy(*keys).agg(F.min(F.struct("id", *FEATURES)).alias("p"), F.count(F.lit(1)).alias("n"))
    cells, _ = ws.keep(counted.where(F.col("n") >= like.min_cell).select(F.col("p.id").alias("cell"), *[f"p.{c}" for c in FEATURES], "n"))
    pairs, seen = ws.keep(near_cells(ws, cells, like).mapInArrow(_contracted, "u bigint, v bigint, sure boolean"), open=F.count_if(~F.col("sure")))
    groups = stars(spark, pairs.where("sure").select(F.col("u").alias("src"), F.col("v").alias("dst"))).toDF("cell", "grp")
    if seen["open"]:
        ends = pairs.where("not sure").join(groups.toDF("u", "gu"), "u", "left").join(groups.toDF("v", "gv"), "v", "left")
        ends = ends.select("u", "v", F.coalesce("gu", "u").alias("gu"), F.coalesce("gv", "v").alias("gv")).where("gu <> gv").distinct()
        ends, seen = ws.keep(ends, n=F.count(F.lit(1)))
        if seen["n"]:
            more = settle(ws, ends, points, cells, like).join(ends, ["u", "v"]).select(F.col("gu").alias("src"), F.col("gv").alias("dst"))
            merged = stars(spark, more).toDF("grp", "into")
            named = cells.join(groups, "cell", "left").select("cell", F.coalesce("grp", "cell").alias("grp"))
            groups = named.join(merged, "grp", "left").select("cell", F.coalesce("into", "grp").alias("grp"))
    return points, ws.keep(cells.join(groups, "cell", "left").select("cell", *FEATURES, "n", F.coalesce("grp", "cell").alias("group_id")))[0]


def members(spark: SparkSession, features: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """(point_id, group_id) of each point in a cluster of at least ``min_points`` (p5_found).

    Points with a null or non-finite feature are left out; an empty table gives an empty result.
    """
    points, cells = clustered_cells(spark, features, like)
    big = cells.groupBy("group_id").agg(F.sum("n").alias("size")).where(F.col("size") >= like.min_points).select("group_id")
    kept = cells.join(big, "group_id", "left_semi")
    # A cell of one point is that point; the others are found by their cell's numbers.
    alone = kept.where("n = 1").select(F.col("cell").alias("point_id"), "group_id")
    return alone.unionByName(_located(points, kept.where("n > 1"), like).select(F.col("id").alias("point_id"), "group_id"))


def _located(points: DataFrame, cells: DataFrame, like: Likeness) -> DataFrame:
    """(id, cell, group_id) of the points of the given cells."""
    keys = [f"q{i}" for i in range(8)]
    at = cells.withColumns(cell_keys(like, "cell")).select(*keys, "cell", "group_id")
    return points.withColumns(cell_keys(like)).select(*keys, "id").join(at, keys).select("id", "cell", "group_id")


def describe(spark: SparkSession, features: DataFrame, like: Likeness = Likeness(), typical: int = 3) -> DataFrame:
    """(group_id, size, cells, densest, typical): clusters with their size, number of cells, the count of the
    densest cell (the one with the smallest name of equals) and the smallest ``typical`` point ids in it."""
    points, cells = clustered_cells(spark, features, like)
    top = F.max_by(F.struct("cell", *FEATURES), F.struct(F.col("n"), -F.col("cell")))
    big = cells.groupBy("group_id").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("cells"), F.max("n").alias("densest"), top.alias("t"))
    big = big.where(F.col("size") >= like.min_points)
    first = Window.partitionBy("cell").orderBy("id")
    best = _located(points, big.select("t.*", "group_id"), like).withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= typical)
    best = best.groupBy("group_id").agg(F.array_sort(F.collect_list("id")).alias("typical"))
    return big.join(best, "group_id").select("group_id", "size", "cells", "densest", "typical")
