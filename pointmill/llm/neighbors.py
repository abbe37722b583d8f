"""Most similar vectors for every vector: balanced posting lists with replicated boundary vectors.

Index.  A bounded random sample (``sample_rows``) is bisected at medians into balanced leaves; their means
are the centroids of the posting lists, linked to a k-nearest-neighbour graph that every task searches in
memory (entry by a coarse level, then greedy descent).  Every vector of the table goes to its home list,
and, as a replica, to each list of the graph's neighbourhood whose centroid is at most ``1 + ratio`` times
as far as the home centroid.

Search.  Each list answers its home vectors from its own rows and replicas.  The distance ratio also tells which other
lists are surely covered by replicas; lists that are not, and whose bounding box reaches into the
sphere of a vector's k-th neighbour, are searched in a second round (the exact check), so the result is the
exact k nearest neighbours with ties by the smaller id.  A vector whose list holds fewer than k others takes its
radius from the boxes: the nearest ones by their farthest corner that hold k vectors together.

Skew.  Vectors at one place are collapsed to their k + 1 smallest ids before they are indexed (the window
limit runs before the shuffle), the rest are answered from those; lists are balanced by construction, and a
list that outgrows ``block_rows`` is searched in bisected blocks of bounded size.
Only the sample, the centroids and the list boxes reach the driver; all three are bounded by parameters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointmill.workspace import Workspace


HOT_PLACES = 1000


@dataclass(frozen=True)
class Config:
    k: int = 3
    list_rows: int = 192
    max_lists: int = 16_384
    sample_rows: int = 262_144
    degree: int = 32
    ratio: float = 0.35
    block_rows: int = 1024


class Centroids:
    """Centroids in bisection order, their neighbour graph and a coarse entry level."""

    def __init__(self, sample: np.ndarray, lists: int, degree: int):
        self.at = bisect_means(sample, lists)
        n = len(self.at)
        self.degree = min(degree, n - 1)
        self.graph = np.empty((n, self.degree), dtype=np.int32)
        for lo in range(0, n, 1024):
            d = sq_dist(self.at[lo : lo + 1024], self.at)
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            near = np.argpartition(d, max(0, self.degree - 1), axis=1)[:, : self.degree] if self.degree < n - 1 else np.argsort(d, axis=1)[:, : self.degree]
            order = np.argsort(np.take_along_axis(d, near, 1), axis=1)
            self.graph[lo : lo + 1024] = np.take_along_axis(near, order, 1)
        self.span = 64 if n > 64 else n
        groups = [self.at[i : i + self.span] for i in range(0, n, self.span)]
        self.coarse = np.array([g.mean(0) for g in groups])

    def nearest(self, q: np.ndarray) -> np.ndarray:
        """Index of a nearest centroid for each row: coarse entry, then greedy descent on the graph."""
        n = len(self.at)
        top = np.argmin(sq_dist(q, self.coarse), axis=1)
        best = np.empty(len(q), dtype=np.int64)
        dist = np.empty(len(q))
        order = np.argsort(top, kind="stable")
        edges = np.searchsorted(top[order], np.arange(len(self.coarse) + 1))
        for g in np.unique(top):
            rows = order[edges[g] : edges[g + 1]]
            d = sq_dist(q[rows], self.at[g * self.span : (g + 1) * self.span])
            best[rows] = g * self.span + d.argmin(1)
            dist[rows] = d.min(1)
        moving = np.arange(len(q)) if n > 1 else np.empty(0, dtype=np.int64)
        while len(moving):
            cand = self.graph[best[moving], :16]
            d = ((self.at[cand] - q[moving, None, :]) ** 2).sum(2)
            j = d.argmin(1)
            dj = d[np.arange(len(moving)), j]
            better = dj < dist[moving]
            moving = moving[better]
            best[moving] = cand[better, j[better]]
            dist[moving] = dj[better]
        return best


def sq_dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed in column order so that they are the same in either direction."""
    d = np.subtract.outer(a[:, 0], b[:, 0])
    out = d * d
    for c in range(1, a.shape[1]):
        np.subtract.outer(a[:, c], b[:, c], out=d)
        np.multiply(d, d, out=d)
        out += d
    return out


def bisect_blocks(x: np.ndarray, blocks: int) -> list[np.ndarray]:
    """Row numbers of ``blocks`` balanced parts, halving at the median of the widest axis."""
    todo, done = [(np.arange(len(x)), blocks)], []
    while todo:
        rows, k = todo.pop()
        if k <= 1 or len(rows) <= 1:
            done.append(rows)
            continue
        part = x[rows]
        axis = int(np.argmax(part.max(0) - part.min(0)))
        cut = max(1, min(len(rows) - 1, len(rows) * (k // 2) // k))
        order = np.argpartition(part[:, axis], cut)
        todo += [(rows[order[cut:]], k - k // 2), (rows[order[:cut]], k // 2)]
    return done


def bisect_means(x: np.ndarray, blocks: int) -> np.ndarray:
    return np.array([x[rows].mean(0) for rows in bisect_blocks(x, min(blocks, len(x)))])


def top_k(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k nearest rows of x for each q by (distance, id), without q's own id; missing ones are -1 and inf.

    ``ids`` ascend, so the first of equal distances has the smallest id.
    """
    m = min(k, len(x))
    near = np.full((len(q), k), -1, dtype=np.int64)
    dist = np.full((len(q), k), np.inf)
    if not m or not len(q):
        return near, dist
    step = max(1, 1_000_000 // len(x))
    for lo in range(0, len(q), step):
        d = sq_dist(q[lo : lo + step], x)
        own = np.searchsorted(ids, q_ids[lo : lo + step])
        own_ok = (own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == q_ids[lo : lo + step])
        d[np.flatnonzero(own_ok), own[own_ok]] = np.inf
        rows = np.arange(len(d))
        for i in range(m):  # argmin returns the first, so ties go to the smaller id
            j = d.argmin(1)
            v = d[rows, j]
            ok = v < np.inf
            near[lo : lo + step, i] = np.where(ok, ids[j], -1)
            dist[lo : lo + step, i] = v
            d[rows, j] = np.inf
    return near, dist


def search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """top_k; long lists are cut into blocks and a block is searched only if its box can hold a neighbour."""
    if len(x) <= block_rows:
        return top_k(q, q_ids, x, ids, k)
    blocks = [np.sort(b) for b in bisect_blocks(x, -(-len(x) // (block_rows // 4)))]
    lo = np.array([x[b].min(0) for b in blocks])
    hi = np.array([x[b].max(0) for b in blocks])
    near = np.full((len(q), k), -1, dtype=np.int64)
    dist = np.full((len(q), k), np.inf)
    for rows in bisect_blocks(q, -(-len(q) // (block_rows // 4))):
        qlo, qhi = q[rows].min(0), q[rows].max(0)
        gap = (np.maximum(0, np.maximum(lo - qhi, qlo - hi)) ** 2).sum(1)
        order = np.argsort(gap, kind="stable")
        held, take = 0, 0
        while take < len(order) and held < k + 1:
            held += len(blocks[order[take]])
            take += 1
        use = np.sort(np.concatenate([blocks[b] for b in order[:take]]))
        _, d = top_k(q[rows], q_ids[rows], x[use], ids[use], k)
        reach = d[:, -1].max()
        use = np.sort(np.concatenate([blocks[b] for b in np.flatnonzero(gap <= reach)]))
        near[rows], dist[rows] = top_k(q[rows], q_ids[rows], x[use], ids[use], k)
    return near, dist


def _by_list(batches: Iterator[pa.RecordBatch], cols: list[str]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(list, columns) of each list of a partition that is sorted by list; a list may span batches."""
    held: list[pa.Table] = []
    at = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        lists = t.column("list").to_numpy()
        if held and lists[0] != at:
            yield from _groups(pa.concat_tables(held), cols)
            held = []
        if lists[0] != lists[-1]:  # all but the last list are complete
            cut = int(np.searchsorted(lists, lists[-1]))
            yield from _groups(pa.concat_tables([*held, t.slice(0, cut)]), cols)
            held, t = [], t.slice(cut)
        held.append(t)
        at = lists[-1]
    if held:
        yield from _groups(pa.concat_tables(held), cols)


def _groups(t: pa.Table, cols: list[str]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    data = {c: t.column(c).to_numpy() for c in ["list", *cols]}
    lists = data["list"]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(lists)) + 1, [len(lists)]])
    for a, b in zip(starts[:-1], starts[1:]):
        yield int(lists[a]), {c: v[a:b] for c, v in data.items()}


def nearest_neighbors(spark: SparkSession, vectors: DataFrame, id_col: str, dims: list[str], cfg: Config = Config(), with_distance: bool = True) -> DataFrame:
    """(id, neighbors array<bigint>, squared array<double>): the k nearest other vectors of each vector.

    Without ``with_distance`` the squared distances may be missing, which halves the written tables.

    Vectors with a null or non-finite component or a null id are left out; repeated rows of an id count
    once; other columns are not read.  Fewer than k neighbours come out where the table has fewer.  An empty
    table gives an empty result.
    """
    ws = Workspace(spark, "neighbors")
    dim = len(dims)
    comp = [f"v{i}" for i in range(dim)]
    usable = F.col(id_col).isNotNull()
    for c in dims:
        usable = usable & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf")))
    rows = vectors.where(usable).select(F.col(id_col).cast("bigint").alias("id"), *[(F.col(c).cast("double") + F.lit(0.0)).alias(v) for c, v in zip(dims, comp)])
    once = rows.groupBy("id").agg(F.min(F.struct(*comp)).alias("p")).select("id", "p.*")
    points, seen = ws.keep(once, n=F.count(F.lit(1)))
    n = seen["n"]
    out_schema = "id bigint, neighbors array<bigint>, squared array<double>"
    if not n:
        return spark.createDataFrame([], out_schema)

    place = Window.partitionBy(*comp).orderBy("id")
    indexed = points.withColumn("_rn", F.row_number().over(place)).where(F.col("_rn") <= cfg.k + 1).drop("_rn")
    share = min(1.0, 0.95 * cfg.sample_rows / n)
    sample = points.select(*comp).where((F.xxhash64("id") / F.lit(2.0**64) + F.lit(0.5)) < F.lit(share)).limit(cfg.sample_rows).toArrow()
    if not sample.num_rows:
        sample = points.select(*comp).limit(1).toArrow()
    train = np.column_stack([sample.column(c).to_numpy() for c in comp])
    index = Centroids(train, max(1, min(cfg.max_lists, math.ceil(n / cfg.list_rows))), cfg.degree)
    shared = spark.sparkContext.broadcast(index)

    names = ["list", "home", "id", *comp]
    assigned_schema = "list int, home boolean, id bigint, " + ", ".join(f"{c} double" for c in comp)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = shared.value
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy() for c in comp])
            ids = b.column("id").to_numpy()
            home = idx.nearest(x)
            d0 = np.sqrt(((idx.at[home] - x) ** 2).sum(1))
            lists, who, at_home = [home], [np.arange(len(x))], [np.ones(len(x), dtype=bool)]
            if idx.degree:
                far = idx.graph[home]
                d = np.sqrt(((idx.at[far] - x[:, None, :]) ** 2).sum(2))
                r, c = np.nonzero(d <= (1 + cfg.ratio) * d0[:, None])
                lists.append(far[r, c])
                who.append(r)
                at_home.append(np.zeros(len(r), dtype=bool))
            w = np.concatenate(who)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists).astype(np.int32)), pa.array(np.concatenate(at_home)), pa.array(ids[w]), *[pa.array(x[w, i]) for i in range(dim)]], names=names)

    posted, _ = ws.keep(indexed.mapInArrow(assign, assigned_schema))
    homes = posted.where("home")
    found_boxes = homes.groupBy("list").agg(*[f(c).alias(f"{o}{c}") for c in comp for f, o in ((F.min, "lo"), (F.max, "hi"))], F.count(F.lit(1)).alias("n")).toArrow()
    box_lists = found_boxes.column("list").to_numpy()
    lo, hi = (np.full((len(index.at), dim), s) for s in (np.inf, -np.inf))
    for i, c in enumerate(comp):
        lo[box_lists, i] = found_boxes.column(f"lo{c}").to_numpy()
        hi[box_lists, i] = found_boxes.column(f"hi{c}").to_numpy()
    held_rows = np.zeros(len(index.at), dtype=np.int64)
    held_rows[box_lists] = found_boxes.column("n").to_numpy()
    boxes = spark.sparkContext.broadcast((lo, hi, held_rows))

    first_schema = "id bigint, neighbors array<bigint>, squared array<double>, todo array<int>, reach double, " + ", ".join(f"{c} double" for c in comp)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx, (blo, bhi, rows_of) = shared.value, boxes.value
        held: list[tuple] = []
        rows_held = 0
        for at, g in _by_list(batches, names[1:]):
            order = np.argsort(g["id"], kind="stable")
            x = np.column_stack([g[c] for c in comp])[order]
            ids, home = g["id"][order], g["home"][order]
            q, q_ids = x[home], ids[home]
            if not len(q):
                continue
            near, dist = search(q, q_ids, x, ids, cfg.k, cfg.block_rows)
            reach = dist[:, -1].copy()
            few = np.flatnonzero(np.isinf(reach))
            if len(few):
                reach[few] = _bound(blo, bhi, rows_of, at, q[few], cfg.k)
            held.append((q_ids, near, dist, *_uncovered(idx, blo, bhi, at, q, reach, cfg.ratio), reach, q))
            rows_held += len(q)
            if rows_held >= 20_000:
                yield _first_batch(held, comp, with_distance)
                held, rows_held = [], 0
        if held:
            yield _first_batch(held, comp, with_distance)

    answered, seen = ws.keep(posted.repartition("list").sortWithinPartitions("list").mapInArrow(first, first_schema), more=F.count_if(F.size("todo") > 0))
    done = answered.select("id", "neighbors", "squared")
    if seen["more"]:
        open_q = answered.where(F.size("todo") > 0)
        asks = open_q.select(F.explode("todo").alias("list"), F.lit(True).alias("ask"), "id", "reach", *comp)
        full = asks.unionByName(homes.select("list", F.lit(False).alias("ask"), "id", F.lit(0.0).alias("reach"), *comp))

        def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, g in _by_list(batches, ["ask", "id", "reach", *comp]):
                ask = g["ask"]
                if not ask.any() or ask.all():
                    continue
                x = np.column_stack([g[c] for c in comp])
                order = np.argsort(g["id"][~ask], kind="stable")
                near, dist = search(x[ask], g["id"][ask], x[~ask][order], g["id"][~ask][order], cfg.k, cfg.block_rows)
                keep = (near >= 0) & (dist <= g["reach"][ask][:, None])
                r, c = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(g["id"][ask][r]), pa.array(near[r, c]), pa.array(dist[r, c])], names=["id", "near", "sq"])

        extra = full.repartition("list").sortWithinPartitions("list").mapInArrow(second, "id bigint, near bigint, sq double")
        # Cut to k before the union, which compares all with all.
        more = extra.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct(F.col("sq"), F.col("near")))), 1, cfg.k).alias("more"))
        both = done.join(more, "id", "left")
        own = F.arrays_zip(F.col("squared").alias("sq"), F.col("neighbors").alias("near"))
        merged = F.slice(F.array_sort(F.array_union(own, F.col("more"))), 1, cfg.k)
        same = F.col("more").isNull()
        at = both.select("id", "neighbors", "squared", F.when(~same, merged).alias("m"))
        done = at.select("id", F.coalesce("m.near", "neighbors").alias("neighbors"), F.coalesce("m.sq", "squared").alias("squared"))
    # Places with more vectors than were indexed.  Those with over a ``1 / HOT_PLACES`` share of the rows, at most that many, are
    # broadcast, so that no task of the join with the others meets a hot place.
    crowded = points.groupBy(*comp).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cfg.k + 1)
    lead = indexed.join(crowded, comp).groupBy(*comp).agg(F.array_sort(F.collect_list("id")).alias("_top"), F.first("_n").alias("_n"))
    lead, seen = ws.keep(lead, hot=F.count_if(F.col("_n") > n / HOT_PLACES), n=F.count(F.lit(1)))
    if not seen["n"]:
        return done
    hot, cold = F.broadcast(lead.where(F.col("_n") > n / HOT_PLACES)), lead.where(F.col("_n") <= n / HOT_PLACES)
    surplus = points.join(hot, comp, "left_anti").join(cold, comp).unionByName(points.join(hot, comp)) if seen["hot"] else points.join(cold, comp)
    surplus = surplus.where(~F.array_contains("_top", F.col("id")))
    zeros = F.transform(F.slice("_top", 1, cfg.k), lambda _: F.lit(0.0))
    return done.unionByName(surplus.select("id", F.slice("_top", 1, cfg.k).alias("neighbors"), zeros.alias("squared")))


def _bound(lo: np.ndarray, hi: np.ndarray, rows: np.ndarray, at: int, q: np.ndarray, k: int) -> np.ndarray:
    """Squared distance within which each q surely has k others: of the boxes by their farthest corner, the first that hold k together."""
    out = np.full(len(q), np.inf)
    used = np.flatnonzero(rows)
    others = rows[used] - (used == at)
    for start in range(0, len(q), 256):
        part = q[start : start + 256]
        far = np.zeros((len(part), len(used)))
        for i in range(q.shape[1]):
            d = np.maximum(np.abs(part[:, i : i + 1] - lo[used, i]), np.abs(part[:, i : i + 1] - hi[used, i]))
            far += d * d
        order = np.argsort(far, axis=1, kind="stable")
        enough = np.cumsum(others[order], axis=1) >= k
        some = enough.any(1)
        out[start : start + 256][some] = np.take_along_axis(far, order, 1)[some, enough[some].argmax(1)] * (1 + 1e-9)
    return out


def _uncovered(idx: Centroids, lo: np.ndarray, hi: np.ndarray, at: int, q: np.ndarray, sq: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(counts per query, list numbers): lists that may hold a nearer vector than the k-th found.

    A vector p of list j within r of q is a replica in q's list i if i is in j's neighbourhood and
    d(q, c_i) + r <= (1 + ratio) (d(q, c_j) - r), since then d(p, c_i) <= (1 + ratio) d(p, c_j).
    """
    gap = np.maximum(0, np.maximum(lo - q.max(0), q.min(0) - hi))
    near = np.flatnonzero((gap**2).sum(1) <= sq.max())
    near = near[near != at]
    if not len(near):
        return np.zeros(len(q), dtype=np.int64), np.empty(0, dtype=np.int32)
    reach = np.zeros((len(q), len(near)))
    for i in range(q.shape[1]):
        g = np.maximum(0, np.maximum(lo[near, i] - q[:, i : i + 1], q[:, i : i + 1] - hi[near, i]))
        reach += g * g
    need = reach <= sq[:, None]
    r = np.sqrt(sq)
    home = np.sqrt(((q - idx.at[at]) ** 2).sum(1))
    away = np.sqrt(sq_dist(q, idx.at[near]))
    linked = (idx.graph[near] == at).any(1)
    with np.errstate(invalid="ignore"):
        covered = linked & ((home + r)[:, None] * (1 + 1e-9) <= (1 + ratio) * (away - r[:, None]))
    need &= ~covered
    return need.sum(1), near[np.nonzero(need)[1]].astype(np.int32)


def _first_batch(held: list[tuple], comp: list[str], with_distance: bool) -> pa.RecordBatch:
    """Answers; coordinates (and distances, unless asked for) only where the second round needs them."""
    ids, near, dist, counts, lists, reach, q = (np.concatenate(x) for x in zip(*held))
    ok = near >= 0
    ends = np.concatenate([[0], np.cumsum(ok.sum(1))]).astype(np.int32)
    far = ok & (with_distance | (counts > 0))[:, None]
    far_ends = np.concatenate([[0], np.cumsum(far.sum(1))]).astype(np.int32)
    todo = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(lists))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.ListArray.from_arrays(pa.array(ends), pa.array(near[ok])), pa.ListArray.from_arrays(pa.array(far_ends), pa.array(dist[far])), todo, *[pa.array(x, mask=counts == 0) for x in (reach, *q.T)]],
        names=["id", "neighbors", "squared", "todo", "reach", *comp],
    )


def neighbor_pairs(found: DataFrame) -> DataFrame:
    """(point_a, point_b), a < b, each pair once, where one of the two is among the other's neighbours (p4_found)."""
    pairs = found.select("id", F.explode("neighbors").alias("b"))
    return pairs.select(F.least("id", "b").alias("point_a"), F.greatest("id", "b").alias("point_b")).distinct()
