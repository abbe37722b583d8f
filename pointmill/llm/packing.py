"""Filling fixed-capacity containers: conflict-aware best fit in rounds.

An item longer than the capacity is cut into full containers and one remainder; nothing else is split.
Items are spread over groups of bounded size, and each group packs its items, largest first (those of common sources
and clusters before all others), into the tightest open container: containers are ordered by residual (a bitmap of occupied residuals gives the successor), and each
carries bitmaps of its sources and duplicate clusters.  The search goes on to the next residual until it finds
a container without a conflict; if there is none, a new one is opened, so no container holds two items of one source or
cluster.  Only with ``spare`` does that give way: once the items left would fit into the open containers with more than
this share of all room to spare, first the source, then the cluster is disregarded, and the placement is marked.

Containers left open by a group are emptied into the next round, of fewer groups, as long as that lowers their
number, down to one group.

Bounds: a group has about ``group_items`` items (hash of the item, so a hot source or cluster spreads over all
groups); each round's items are the contents of the last round's open containers only.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.workspace import Workspace

GROUP_ITEMS = 30_000
HOT = 128
PACKED = "container_id bigint, item bigint, piece int, start_at bigint, size bigint, relaxed boolean"


def best_fit(sizes: np.ndarray, sources: list, clusters: list, capacity: int, spare: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(container number, whether a conflict was disregarded) of each item; sizes are in 0..capacity, null sources and clusters never conflict."""
    out, relaxed = np.empty(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=bool)
    keys = [("s", s) for s in sources], [("c", c) for c in clusters]
    freq = Counter(k for ks in keys for k in ks if k[1] is not None)
    # Bits for what occurs more than once, the frequent ones first: their bits are the key of a shelf.
    bit = {k: 1 << i for i, (k, n) in enumerate(freq.most_common()) if n > 1}
    hot = sum(bit[k] for k in bit if freq[k] > HOT)
    shelves: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]  # residual -> hot bits -> containers
    occupied = 0
    carried: list[int] = []
    room: list[int] = []

    def successor(size: int, mask: int) -> tuple[int, int, int] | None:
        above = occupied >> size
        base = size
        while above:
            step = (above & -above).bit_length() - 1
            base += step
            for sig, held in shelves[base].items():
                if sig & mask:
                    continue
                for pos in range(len(held) - 1, -1, -1):
                    if not carried[held[pos]] & mask:
                        return base, sig, pos
            above >>= step + 1
            base += 1
        return None

    left, free = int(sizes.sum()), 0
    margin = math.inf if spare is None else spare * left
    # Items of sources and clusters that many containers will hold go first: late ones would find them everywhere.
    common = 0.01 * left / capacity
    many = np.array([max(freq.get(a, 0), freq.get(b, 0)) > common for a, b in zip(*keys)], dtype=bool)
    for i in np.lexsort((-sizes, ~many)).tolist():
        size = int(sizes[i])
        s, c = bit.get(keys[0][i], 0), bit.get(keys[1][i], 0)
        found = successor(size, s | c)
        if not found and left + margin <= free:
            for mask in dict.fromkeys((c, 0)):
                found = successor(size, mask)
                if found:
                    relaxed[i] = True
                    break
        if found:
            r, sig, pos = found
            shelf = shelves[r][sig]
            b = shelf[pos]
            shelf[pos] = shelf[-1]
            shelf.pop()
            if not shelf:
                del shelves[r][sig]
                if not shelves[r]:
                    occupied &= ~(1 << r)
        else:
            b, r = len(room), capacity
            room.append(capacity)
            carried.append(0)
            free += capacity
        room[b] = r = r - size
        left -= size
        free -= size
        carried[b] |= s | c
        out[i] = b
        shelves[r].setdefault(carried[b] & hot, []).append(b)
        occupied |= 1 << r
    return out, relaxed


def _packer(capacity: int, level: int, close_at: float, spare: float | None) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("item", "ascending"), ("piece", "ascending")])
        sizes = table.column("size").to_numpy()
        box, relaxed = best_fit(sizes, table.column("source").to_pylist(), table.column("cluster").to_pylist(), capacity, spare)
        fill = np.bincount(box, weights=sizes)
        lead = np.zeros(len(box), dtype=bool)
        lead[np.unique(box, return_index=True)[1]] = True
        ids = (level << 56) + (int(key[0].as_py()) << 28) + box
        kept = ["item", "piece", "start_at", "size", "source", "cluster"]
        cols = [pa.array(ids), *[table.column(c) for c in kept], pa.array(relaxed), pa.array(fill[box] < close_at * capacity), pa.array(lead)]
        return pa.table(cols, names=["container_id", *kept, "relaxed", "open", "lead"])

    return run


def pack(spark: SparkSession, items: DataFrame, capacity: int, group_items: int = GROUP_ITEMS, close_at: float = 0.995, spare: float | None = None) -> DataFrame:
    """Rows ``PACKED`` for items(item bigint, size bigint, source string, cluster bigint).

    An item of size 0 (or null size) takes no room, has no conflicts and still gets a container; repeated rows of an item are
    separate items; an empty table gives an empty result.  ``relaxed`` marks placements beside an item of the same
    source or cluster; there are none unless ``spare`` allows them.
    """
    ws = Workspace(spark, "packing")
    size = F.coalesce("size", F.lit(0)).cast("bigint")
    base, seen = ws.keep(items.select("item", size.alias("size"), "source", "cluster"), n=F.count(F.lit(1)))
    n = seen["n"]
    if not n:
        return spark.createDataFrame([], PACKED)
    full = F.expr(f"size div {capacity}")
    whole = base.where(F.col("size") >= capacity).select("item", F.explode(F.sequence(F.lit(0), (full - 1).cast("int"))).alias("piece"))
    whole = whole.select(
        (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("container_id"), "item", "piece", (F.col("piece") * F.lit(capacity)).cast("bigint").alias("start_at"), F.lit(capacity).cast("bigint").alias("size"), F.lit(False).alias("relaxed")
    )
    zero = F.col("size") == 0
    rest = base.where(zero | (F.col("size") % capacity > 0)).select(
        "item", full.cast("int").alias("piece"), (full * capacity).alias("start_at"), (F.col("size") % capacity).alias("size"), F.when(~zero, F.col("source")).alias("source"), F.when(~zero, F.col("cluster")).alias("cluster")
    )
    placed = ["container_id", "item", "piece", "start_at", "size", "relaxed"]
    closed, level, waiting = [whole], 0, None
    schema = "container_id bigint, item bigint, piece int, start_at bigint, size bigint, source string, cluster bigint, relaxed boolean, open boolean, lead boolean"
    while True:
        groups = max(1, -(-n // group_items))
        grouped = rest.withColumn("_g", F.pmod(F.xxhash64("item", "piece", F.lit(level)), F.lit(groups)).cast("int"))
        packed, seen = ws.keep(grouped.groupBy("_g").applyInArrow(_packer(capacity, level, close_at, spare), schema), open=F.count_if("open"), boxes=F.count_if("lead"), left=F.count_if(F.col("open") & F.col("lead")))
        if waiting is not None and seen["boxes"] >= waiting[1]:  # no fewer containers than before: these stay as they are
            closed.append(waiting[0].select(*placed))
            break
        if groups == 1 or not seen["open"]:
            closed.append(packed.select(*placed))
            break
        closed.append(packed.where(~F.col("open")).select(*placed))
        waiting = packed.where("open"), seen["left"]
        rest = waiting[0].select("item", "piece", "start_at", "size", "source", "cluster")
        n, level = seen["open"], level + 1
    out = closed[0]
    for c in closed[1:]:
        out = out.unionByName(c)
    return out
