"""Vector arithmetic on triples of columns; everything stays inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Triple = Sequence[Column]


def triple(prefix: str, names: Sequence[str] = ("x", "y", "z")) -> list[Column]:
    """Columns such as a.x, a.y, a.z of an aliased side."""
    return [F.col(f"{prefix}.{n}" if prefix else n) for n in names]


def dot(a: Triple, b: Triple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def distance_squared(a: Triple, b: Triple) -> Column:
    d = [p - q for p, q in zip(a, b)]
    return dot(d, d)


def distance(a: Triple, b: Triple) -> Column:
    return F.sqrt(distance_squared(a, b))


def angle(a: Triple, b: Triple) -> Column:
    """Angle in 0..pi between unit vectors; signed normals, so opposite ones are pi apart."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def cross(a: Triple, b: Triple) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def finite(c: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where den is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / F.nullif(den, F.lit(0)))


def edge_weight(a: str, b: str, angle_weight: float = 0.5, curvature_weight: float = 1.0) -> Column:
    """distance + angle_weight * angle + curvature_weight * larger curvature; curvature_weight 0 is the two-term form."""
    w = distance(triple(a), triple(b)) + F.lit(angle_weight) * angle(triple(a, ("nx", "ny", "nz")), triple(b, ("nx", "ny", "nz")))
    if curvature_weight:
        w = w + F.lit(curvature_weight) * F.greatest(f"{a}.curvature", f"{b}.curvature")
    return w


def usable_normal(x: Column, y: Column, z: Column, curvature: Column) -> list[Column]:
    """Normal and curvature; (0, 0, 1) and 0 wherever a component of the normal is not finite."""
    ok = finite(x) & finite(y) & finite(z)
    up = (F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return [F.when(ok, c).otherwise(d) for c, d in zip((x, y, z), up)] + [F.when(ok, F.coalesce(curvature, F.lit(0.0))).otherwise(F.lit(0.0))]
