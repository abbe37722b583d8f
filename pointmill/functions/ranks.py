"""Exact ranks without a global sort in one task."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointmill.workspace import Workspace

def number_rows(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Adds ``name``: the row's position by ``order`` from ``start``; the result is written once and can be read again.

    Rows are sorted in range partitions whose cuts come from the data, so neither a single value of the
    first column nor sparse keys gather rows in one task; only one count per partition is summed up in one.
    """
    ws = Workspace(df.sparkSession, "numbers")
    at = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The second column counts from 0 within its partition in its low 33 bits.
    at = at.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    rows, _ = ws.keep(at)
    counts = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_o"))
    return rows.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.col("_i") + F.lit(start)).drop("_p", "_i", "_o")


def index_percentiles(df: DataFrame, value: Column, percents: list[int], buckets: int = 4096, leaf_rows: int = 1 << 20) -> DataFrame:
    """(q bigint, n bigint, value double): the ascending value at 0-based index min(n q div 100, n - 1).

    No interpolation; null values do not count; an empty input gives value 0 and n 0 for every q.  Values are
    counted in equal-width buckets; a bucket that holds a wanted rank is divided again between its own ends until it has at
    most ``leaf_rows`` rows or one value.  So outliers cost a round, a value that fills a third of the table
    costs nothing, and no task ranks more than ``leaf_rows`` rows.  Only counts, at most ``buckets`` a round, reach the driver.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "ranks")
    vals, ends = ws.keep(df.select(value.cast("double").alias("v")).where("v is not null"), lo=F.min("v"), hi=F.max("v"), n=F.count("v"))
    n = ends["n"]
    if not n:
        return spark.createDataFrame([(q, 0, 0.0) for q in percents], "q bigint, n bigint, value double")
    todo = [(ends["lo"], ends["hi"], n, [(q, min(n * q // 100, n - 1)) for q in percents])]
    known: list[tuple[int, float]] = []
    leaves: list[DataFrame] = []
    while todo:
        lo, hi, rows, ranks = todo.pop()
        if lo == hi:
            known += [(q, lo) for q, _ in ranks]
            continue
        inside = vals.where(F.col("v").between(lo, hi))
        if rows <= leaf_rows:
            upto = inside.groupBy("v").agg(F.count(F.lit(1)).alias("m")).withColumn("cum", F.sum("m").over(Window.orderBy("v")))
            hit = spark.createDataFrame(ranks, "q bigint, rank bigint")
            leaves.append(upto.join(F.broadcast(hit), F.col("cum") > F.col("rank")).groupBy("q").agg(F.min("v").alias("value")))
            continue
        half = 0.5 if hi - lo == float("inf") else 1.0
        place = F.least(F.floor((F.col("v") * half - F.lit(lo * half)) / F.lit(hi * half - lo * half) * buckets), F.lit(buckets - 1))
        counts = sorted(inside.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
        upper = list(accumulate(r.c for r in counts))
        wanted: dict[int, list[tuple[int, int]]] = {}
        for q, rank in ranks:
            at = bisect_right(upper, rank)
            wanted.setdefault(at, []).append((q, rank - upper[at] + counts[at].c))
        todo += [(counts[at].lo, counts[at].hi, counts[at].c, held) for at, held in wanted.items()]
    found = spark.createDataFrame(known, "q bigint, value double")
    for leaf in leaves:
        found = found.unionByName(leaf)
    return found.select("q", F.lit(n).cast("bigint").alias("n"), "value")
