"""Closed-form smallest eigenpair of symmetric 3x3 matrices (Smith 1961), built in stages.

Each stage is a projection whose columns the next one uses several times, so the optimizer keeps them apart and
every expression is evaluated once; as one expression the generated method would outgrow the JVM's limit.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.functions.vector import cross, dot

COV = ("xx", "yy", "zz", "xy", "xz", "yz")


def with_smallest_eigenpair(df: DataFrame) -> DataFrame:
    """Adds low (smallest eigenvalue), variation (low over the trace, 0 if all points coincide) and its unit
    eigenvector ex, ey, ez to a table with the covariance columns xx, yy, zz, xy, xz, yz.

    The eigenvector is the longest cross product of two rows of M - low I.  If all of them vanish (a repeated
    eigenvalue) a unit vector orthogonal to the longest row is chosen, and (0, 0, 1) if there is no such row.
    """
    a, b, c, d, e, f = (F.col(k) for k in COV)
    m, s = F.col("_m"), F.col("_s")
    at = df.withColumn("_m", (a + b + c) / 3)
    at = at.withColumn("_s", F.sqrt(((a - m) * (a - m) + (b - m) * (b - m) + (c - m) * (c - m) + 2 * (d * d + e * e + f * f)) / 6))
    u = F.nullif(s, F.lit(0.0))
    at = at.withColumns({"_p": (a - m) / u, "_q": (b - m) / u, "_r": (c - m) / u, "_d": d / u, "_e": e / u, "_f": f / u})
    p, q, r, dd, ee, ff = (F.col(k) for k in ("_p", "_q", "_r", "_d", "_e", "_f"))
    at = at.withColumn("_h", (p * (q * r - ff * ff) - dd * (dd * r - ff * ee) + ee * (dd * ff - q * ee)) / 2)
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_h")))) / 3
    at = at.withColumn("low", F.when(s == 0, m).otherwise(m + 2 * s * F.cos(phi + F.lit(2 * math.pi / 3))))
    at = at.withColumns({"_1": a - F.col("low"), "_2": b - F.col("low"), "_3": c - F.col("low")})
    rows = [[F.col("_1"), d, e], [d, F.col("_2"), f], [e, f, F.col("_3")]]
    for i, (j, k) in enumerate(((0, 1), (0, 2), (1, 2))):
        at = at.withColumns({f"_c{i}{n}": v for n, v in enumerate(cross(rows[j], rows[k]))})
    prods = [[F.col(f"_c{i}{n}") for n in range(3)] for i in range(3)]
    at = at.withColumns({f"_n{i}": dot(x, x) for i, x in enumerate(prods)} | {f"_l{i}": dot(x, x) for i, x in enumerate(rows)})
    at = at.withColumns({"_best": F.greatest("_n0", "_n1", "_n2"), "_top": F.greatest("_l0", "_l1", "_l2"), "_size": F.greatest(F.abs(a), F.abs(b), F.abs(c))})
    at = at.withColumns(
        {f"_v{n}": F.when(F.col("_n0") == F.col("_best"), prods[0][n]).when(F.col("_n1") == F.col("_best"), prods[1][n]).otherwise(prods[2][n]) for n in range(3)}
        | {f"_w{n}": F.when(F.col("_l0") == F.col("_top"), rows[0][n]).when(F.col("_l1") == F.col("_top"), rows[1][n]).otherwise(rows[2][n]) for n in range(3)}
    )
    w = [F.col(f"_w{n}") for n in range(3)]
    flat, side = F.abs(w[2]) <= F.least(F.abs(w[0]), F.abs(w[1])), F.abs(w[1]) <= F.abs(w[0])
    zero = F.lit(0.0)
    other = [F.when(flat, w[1]).when(side, -w[2]).otherwise(zero), F.when(flat, -w[0]).when(side, zero).otherwise(w[2]), F.when(flat, zero).when(side, w[0]).otherwise(-w[1])]
    size = F.col("_size")
    usable = F.col("_best") > size * size * size * size * 1e-24
    at = at.withColumns({f"_e{n}": F.when(usable, F.col(f"_v{n}")).otherwise(other[n]) for n in range(3)})
    vec = [F.col(f"_e{n}") for n in range(3)]
    at = at.withColumn("_len", F.nullif(F.sqrt(dot(vec, vec)), F.lit(0.0)))
    at = at.withColumns({n: F.coalesce(v / F.col("_len"), F.lit(z)) for n, v, z in zip(("ex", "ey", "ez"), vec, (0.0, 0.0, 1.0))})
    at = at.withColumn("variation", F.when(m == 0, F.lit(0.0)).otherwise(F.abs(F.col("low") / F.nullif(3 * m, F.lit(0.0)))))
    return at.select(*df.columns, "low", "variation", "ex", "ey", "ez")
