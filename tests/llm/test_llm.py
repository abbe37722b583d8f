"""Brute force, round trips and dirty inputs for the training-data operators, on small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointmill.llm import clusters, components, neighbors, packing, pii, quantiles, tokens

PT = "point_id bigint, x double, y double, z double"


def groups(pairs):
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {v: find(v) for v in list(parent)}


@pytest.mark.parametrize("kind", ["random", "chain", "hub"])
def test_groups_of_links(spark, kind):
    rnd = random.Random(3)
    pairs = {"random": [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)], "chain": [(i, i + 1) for i in range(120)], "hub": [(77, i) for i in range(150)]}[kind]
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs)] + [(900, None, 3), (901, -1, 4), (902, 5, 5), (903, *pairs[0][::-1])]
    edges = spark.createDataFrame(rows, "edge_id bigint, src bigint, dst bigint").withColumn("u", F.lit("clash"))
    vertices = spark.createDataFrame([(1000, 1001), (1002, None), (1003, 1003), (1004, -1)], "vertex_id bigint, parent bigint")
    want = groups([p for p in pairs if p[0] != p[1]] + [(1000, 1001)])
    assert {r.vertex_id: r.group_id for r in components.link_membership(spark, vertices, edges).collect()} == want


def test_no_links(spark):
    edges = spark.createDataFrame([], "src bigint, dst bigint")
    vertices = spark.createDataFrame([(1, None)], "vertex_id bigint, parent bigint")
    assert components.link_membership(spark, vertices, edges).count() == 0
    links = components.clean_links(edges, "src", "dst")
    assert [tuple(r) for r in components.group_all(spark, vertices, links).collect()] == [(1, 1)]


def test_percentiles_are_within_their_error_and_merge(spark):
    rnd = random.Random(1)
    vals = [rnd.lognormvariate(0, 3) * rnd.choice([-1, 1, 1]) for _ in range(3000)] + [0.0] * 40
    rows = [(i % 3, v) for i, v in enumerate(vals)] + [(0, None), (1, math.nan), (2, math.inf)]
    df = spark.createDataFrame(rows, "k int, v double")
    parts = quantiles.sketch(df, ["k"], "v")
    for keys, pick in ((["k"], lambda k: [v for i, v in enumerate(vals) if i % 3 == k]), ([], lambda _: vals)):
        got = quantiles.percentiles(quantiles.merge(parts, keys), keys, [1, 50, 95, 99, 100]).collect()
        for r in got:
            own = sorted(pick(r["k"] if keys else None))
            assert r.n == len(own)
            for q in (1, 50, 95, 99, 100):
                true = own[min(len(own) * q // 100, len(own) - 1)]
                assert abs(r[f"p{q}"] - true) <= 0.0101 * abs(true)
    ends = spark.createDataFrame([(0, v) for v in (1.7976931348623157e308, -1.7976931348623157e308, 5e-324)], "k int, v double")
    r = quantiles.percentiles(quantiles.sketch(ends, ["k"], "v"), ["k"], [1, 100]).first()
    assert abs(r.p1 + 1.7976931348623157e308) <= 0.0101 * 1.7976931348623157e308 and abs(r.p100 - 1.7976931348623157e308) <= 0.0101 * 1.7976931348623157e308
    assert quantiles.percentiles(quantiles.sketch(df.where("v > 1e300 and v < 0"), ["k"], "v"), ["k"], [50]).count() == 0


@pytest.mark.parametrize("shape", ["even", "clumps", "one_place", "tiny"])
def test_nearest_vectors_are_exact(spark, shape):
    rng = np.random.default_rng(5)
    n = 3 if shape == "tiny" else 900
    x = rng.uniform(0, 10, (n, 3)) * (1, 1, 0.05)
    if shape == "clumps":
        x = np.round(rng.choice([0.0, 50.0, 51.0], (n, 1)) + rng.normal(0, 1, (n, 3)), 1)
    if shape == "one_place":
        x[: n // 3] = (1.0, 2.0, 3.0)
    rows = [(i, *map(float, p)) for i, p in enumerate(x)] + [(i, *map(float, x[i])) for i in range(2)] + [(5000, None, 1.0, 1.0), (5001, math.nan, 0.0, 0.0), (None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, PT).withColumn("id", F.lit("clash"))
    cfg = neighbors.Config(list_rows=24, degree=8, block_rows=64)
    got = {r.id: list(r.neighbors) for r in neighbors.nearest_neighbors(spark, df, "point_id", ["x", "y", "z"], cfg).collect()}
    d = neighbors.sq_dist(x, x)
    np.fill_diagonal(d, np.inf)
    want = {i: [int(j) for j in sorted(range(n), key=lambda j: (d[i, j], j))[: min(3, n - 1)]] for i in range(n)}
    assert got == want


@pytest.mark.parametrize("far", [1, 2, 3])
def test_nearest_vectors_of_lists_with_few_rows(spark, far):
    """One, two or three vectors alone in their list have their remaining neighbours in the other lists."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.uniform(0, 1, (193 - far, 3)), rng.uniform(0, 1, (far, 3)) + 1e6])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], PT)
    found = neighbors.nearest_neighbors(spark, df, "point_id", ["x", "y", "z"]).collect()
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert {r.id: list(r.neighbors) for r in found} == {i: np.argsort(d[i], kind="stable")[:3].tolist() for i in range(len(x))}
    assert all(len(r.squared) == 3 for r in found)


@pytest.mark.parametrize("far", [1, 2, 3])
def test_far_vectors_among_many_with_production_settings(spark, far):
    """2,000 normal points and a few at 1e6, at different places or in one direction, by the default configuration; p4_found's pairs too."""
    rng = np.random.default_rng(far)
    x = np.concatenate([rng.normal(0, 1, (2000, 3)), np.array([(1e6, 0.0, 0.0), (0.0, -1e6, 0.0), (1e6, 0.0, 1e3)])[:far]])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], PT)
    found = neighbors.nearest_neighbors(spark, df, "point_id", ["x", "y", "z"], with_distance=False)
    d = neighbors.sq_dist(x, x)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert {r.id: list(r.neighbors) for r in found.collect()} == {i: w.tolist() for i, w in enumerate(want)}
    assert {tuple(r) for r in neighbors.neighbor_pairs(found).collect()} == {(min(i, int(j)), max(i, int(j))) for i, w in enumerate(want) for j in w}


@pytest.mark.parametrize("n", [1, 2, 3])
def test_fewer_vectors_than_k(spark, n):
    df = spark.createDataFrame([(i, 1e5 * i, 0.0, 0.0) for i in range(n)], PT)
    found = neighbors.nearest_neighbors(spark, df, "point_id", ["x", "y", "z"], neighbors.Config(k=5, list_rows=1)).collect()
    assert {r.id: list(r.neighbors) for r in found} == {i: sorted((j for j in range(n) if j != i), key=lambda j: (abs(i - j), j)) for i in range(n)}


def test_the_bound_keeps_most_lists_out():
    """A far vector asks the lists near the cloud's near side, not all."""
    rng = np.random.default_rng(1)
    lo = rng.uniform(0, 100, (500, 3))
    hi, rows = lo + 5, np.full(500, 10)
    q = np.array([[1e6, 50.0, 50.0]])
    reach = neighbors._bound(lo, hi, rows, 7, q, 3)
    gap = (np.maximum(0, np.maximum(lo - q, q - hi)) ** 2).sum(1)
    assert np.isfinite(reach[0]) and 0 < (gap <= reach[0]).sum() < 100


def test_no_vectors(spark):
    assert neighbors.nearest_neighbors(spark, spark.createDataFrame([], PT), "point_id", ["x", "y", "z"]).count() == 0


FEATURE_ROW = PT + ", nx double, ny double, nz double, curvature double"


def brute_clusters(pos, nor, cur, like):
    angle = np.arccos(np.clip(nor[:, None, 0] * nor[None, :, 0] + (nor[:, None, 1] * nor[None, :, 1] + nor[:, None, 2] * nor[None, :, 2]), -1, 1))
    close = (np.linalg.norm(pos[:, None] - pos[None], axis=2) <= like.distance) & (angle <= like.angle) & (np.abs(cur[:, None] - cur[None]) <= like.curvature)
    g = groups([(int(a), int(b)) for a, b in zip(*np.nonzero(close)) if a < b])
    sizes = {}
    for v in g.values():
        sizes[v] = sizes.get(v, 0) + 1
    return {v: r for v, r in g.items() if sizes[r] >= like.min_points}, sizes


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    n = 500
    pos = rng.uniform(0, 6, (n, 3)) * (1, 1, 0.2)
    nor = rng.normal(0, 0.2, (n, 3)) + (0, 0, 1)
    nor /= np.linalg.norm(nor, axis=1)[:, None]
    cur = rng.uniform(0, 0.06, n)
    pos[:80], nor[:80], cur[:80] = (3.0, 3.0, 0.1), (0.0, 0.0, 1.0), 0.01  # a crowd at one spot
    rows = [(i, *map(float, pos[i]), *map(float, nor[i]), float(cur[i])) for i in range(n)] + [(900, None, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0), (901, 1.0, 1.0, 1.0, 0.0, 0.0, 1.0, math.nan), (902, 1e300, 0.0, 0.0, 5.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows + rows[:50], FEATURE_ROW).withColumn("cell", F.lit(1))
    want, sizes = brute_clusters(pos, nor, cur, clusters.Likeness())
    assert {r.point_id: r.group_id for r in clusters.members(spark, df).collect()} == want
    top = {r.group_id: r for r in clusters.describe(spark, df).collect()}
    assert {k: r["size"] for k, r in top.items()} == {k: n for k, n in sizes.items() if n >= 5}
    assert top[want[0]].densest >= 80 and list(top[want[0]].typical)[:1] == [0]
    assert clusters.members(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_clusters_of_full_cells(spark, seed, monkeypatch):
    """Distinct points crowd in few cells; blocks of over 20 cells are divided; pairs of cells whose named points differ are settled on their points."""
    monkeypatch.setattr(clusters, "CROWD", (20, 20, 3000, 3000)[seed])
    rng = np.random.default_rng(seed)
    like = clusters.Likeness(distance=0.5, angle=0.5, curvature=0.02) if seed < 3 else clusters.Likeness(distance=0.3, angle=0.01, curvature=0.005)
    n = 400
    centre = rng.integers(0, 14, n)
    spots = rng.uniform(0, 2.5, (14, 3)), rng.normal(0, 1, (14, 3)), rng.uniform(0, 0.08, 14)
    pos = spots[0][centre] + rng.normal(0, 0.09, (n, 3))
    nor = spots[1][centre] / np.linalg.norm(spots[1][centre], axis=1)[:, None] + rng.normal(0, 0.12 if seed < 3 else 0.003, (n, 3))
    nor /= np.linalg.norm(nor, axis=1)[:, None]
    cur = np.abs(spots[2][centre] + rng.normal(0, 0.006, n))
    rows = [(i, *map(float, pos[i]), *map(float, nor[i]), float(cur[i])) for i in range(n)]
    want, _ = brute_clusters(pos, nor, cur, like)
    got = {r.point_id: r.group_id for r in clusters.members(spark, spark.createDataFrame(rows, FEATURE_ROW), like).collect()}
    assert got == want


def test_open_pairs_are_settled_on_their_points(spark):
    """Two full cells whose named points are apart and of which only one pair of points is alike; and two without such a pair."""
    up = (0.0, 0.0, 1.0)
    rows = []
    for base in (0.0, 100.0):
        near = 0.499 if base == 0 else 0.51
        rows += [(len(rows) + i, base + 0.01 * (i % 5) * 0.1, 0.0, 0.001 * i, *up, 0.001) for i in range(20)]
        rows += [(len(rows) + i, base + 0.004 + near + 0.001 * i, 0.0, 0.019, *up, 0.001) for i in range(20)]
    pos, nor, cur = np.array([r[1:4] for r in rows]), np.array([r[4:7] for r in rows]), np.array([r[7] for r in rows])
    want, _ = brute_clusters(pos, nor, cur, clusters.Likeness())
    assert len(set(want.values())) == 3
    df = spark.createDataFrame(rows, FEATURE_ROW)
    assert {r.point_id: r.group_id for r in clusters.members(spark, df).collect()} == want


def test_thin_cells_are_no_bridges_where_density_is_asked(spark):
    up = (0.0, 0.0, 1.0)
    rows = [(i, 0.001 * i, 0.0, 0.0, *up, 0.001) for i in range(9)] + [(20, 0.45, 0.0, 0.0, *up, 0.001)] + [(30 + i, 0.87 + 0.001 * i, 0.0, 0.0, *up, 0.001) for i in range(9)]
    df = spark.createDataFrame(rows, FEATURE_ROW)
    assert len({r.group_id for r in clusters.members(spark, df).collect()}) == 1
    got = clusters.members(spark, df, clusters.Likeness(min_cell=3)).collect()
    assert len({r.group_id for r in got}) == 2 and 20 not in {r.point_id for r in got}
    with pytest.raises(ValueError, match="positive"):
        clusters.Likeness(angle=0.0)


def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.DEFAULT_VOCABULARY)
    lib.encode_special_tokens = True
    rnd = random.Random(1)
    pool = "abcdefghij klmnop'stédüßшжλ中文日本 0123456789\n\t\x1c\x85\xa0　​-_=+.,!@#\U0001f600éaaaaAAAA"
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 80))) for _ in range(3000)] + ["a" * 3000, " " * 900 + "x", "<|endoftext|>", "", None, "it's we'll 3.14 naïve   end  "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit(0))
    got = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df, "doc_id", "text").collect()}
    assert got == {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    counts = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, ["doc_id"], "text").collect()}
    assert counts == {i: len(x) for i, x in got.items()}


def test_every_vocabulary_entry_encodes_as_its_merges():
    v = tokens.Vocabulary()
    assert all((v.merge(v.bytes[t]) == [t]) == bool(v.valid[t]) for t in range(0, 50_256, 7))


def test_packing(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([rnd.randint(1, 60), rnd.randint(1, 300)]), "hot" if i % 7 == 0 else f"s{i % 40}", i % 900) for i in range(3000)]
    rows += [(5000, 250, None, None), (5001, 100, "a", 1), (5002, 0, "a", 1), (5003, None, "a", 1), (5000, 7, None, None)]
    df = spark.createDataFrame(rows, "item bigint, size bigint, source string, cluster bigint")
    source, cluster = {r[0]: r[2] for r in rows}, {r[0]: r[3] for r in rows}
    out = packing.pack(spark, df, 100, group_items=700).collect()
    fill, parts, inside = {}, {}, {}
    for r in out:
        fill[r.container_id] = fill.get(r.container_id, 0) + r["size"]
        parts.setdefault(r.item, []).append((r.start_at, r["size"]))
        if r["size"]:
            inside.setdefault(r.container_id, []).append(r.item)
    assert max(fill.values()) <= 100 and not any(r.relaxed for r in out)
    for held in inside.values():
        for kind in (source, cluster):
            keys = [kind[i] for i in held if kind[i] is not None]
            assert len(keys) == len(set(keys))
    for i, size, *_ in rows[:3000]:
        at = 0
        for start, n in sorted(parts[i]):
            assert start == at
            at += n
        assert at == size and len(parts[i]) == max(1, -(-size // 100))
    assert sum(n for _, n in parts[5000]) == 257 and parts[5002] == [(0, 0)] and parts[5003] == [(0, 0)]
    total = sum(s or 0 for _, s, *_ in rows)
    assert len(fill) <= math.ceil(total / 100) * 1.03 + 1
    assert packing.pack(spark, df.limit(0), 100).count() == 0


@pytest.mark.parametrize("size", [51, 34])
def test_packing_of_items_that_leave_room_whatever_the_grouping(spark, size):
    """More than 70 % of the items stay in containers that are never full; rounds end when they no longer lower the number."""
    df = spark.range(900).select(F.col("id").alias("item"), F.lit(size).cast("bigint").alias("size"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("bigint").alias("cluster"))
    out = packing.pack(spark, df, 100, group_items=100)
    per = 100 // size
    boxes = {r["count"] for r in out.groupBy("container_id").count().collect()}
    assert out.select("item").distinct().count() == 900 and max(boxes) <= per and out.select("container_id").distinct().count() <= 900 // per + 9


def test_packing_keeps_copies_and_sources_apart():
    box, relaxed = packing.best_fit(np.array([50, 50, 50, 50]), ["a", "a", "b", "b"], [1, 1, 2, 2], 100)
    assert len(set(box)) == 2 and box[0] != box[1] and box[2] != box[3] and not relaxed.any()
    box, relaxed = packing.best_fit(np.array([20] * 10), ["a"] * 10, [None] * 10, 100)
    assert len(set(box)) == 10 and not relaxed.any()
    box, relaxed = packing.best_fit(np.array([20] * 10), ["a"] * 10, [None] * 10, 100, spare=0.0)
    assert len(set(box)) == 2 and relaxed.sum() == 8


TEXT = "Kind regards, Velna Kessetzi, Flat 2, 19 Wenwick STREET, Tel. +1 305 555 0187, ilola AT post DOT merriga DOT test, SSN: 990 21 8130"


def test_personal_information(spark):
    docs = [TEXT, "Photo: Velna Kessetzi | info@shop.test", "Photo: Marro Kessetzi | 14b Isternau Court", "Photo: Marro Unlistedsson, fax +44 1632 960 158", "Tel. 020 7946 0125", "", None, "logo@2x.png Order no. 316164966 on 2019-06-11, Version 5.1.61.9, Kessetzi GmbH, Thanks, Velna!"]
    docs += ["Tel. +1 212 555 0101", "Tel. +1 212 555 0102", "mail a@b.test", "mail c@d.test", "Photo: Velna Kessetzi"] * 3 + ["x" * 50_000 + " a.b@c.test"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").withColumn("kind", F.lit("clash"))
    names = spark.createDataFrame([("Velna", "given", "lat"), ("Kessetzi", "family", "lat"), (None, "given", "lat")], "word string, name_kind string, script string")
    items = pii.find(spark, df, names).cache()
    got = {}
    for r in items.collect():
        got.setdefault(r.doc_id, []).append((r.kind, docs[r.doc_id][r.start_at : r.end_at]))
    assert sorted(got[0]) == [("address", "Flat 2, 19 Wenwick STREET"), ("email", "ilola AT post DOT merriga DOT test"), ("id", "990 21 8130"), ("name", "Velna Kessetzi"), ("phone", "+1 305 555 0187")]
    assert ("name", "Marro Kessetzi") in got[2] and ("address", "14b Isternau Court") in got[2]
    assert ("name", "Marro Unlistedsson") in got[3] and got[4] == [("phone", "020 7946 0125")]
    assert 5 not in got and 6 not in got and 7 not in got
    clean = {r.doc_id: r.text for r in pii.redact(df, items).collect()}
    assert clean[0] == "Kind regards, [NAME], [ADDRESS], Tel. [PHONE], [EMAIL], SSN: [ID]"
    assert clean[6] is None and clean[5] == "" and clean[7] == docs[7]


def test_pairs_of_learned_words_need_no_label(spark):
    """Neither word is listed; both are learned beside listed ones, in other documents."""
    docs = [f"Photo: {a} {b}" for a in ("Velna", "Torva") for b in ("Kessetzi", "Dulclemm", "Orlardun")] * 2
    docs += [f"Photo: Odelis {b}" for b in ("Kessetzi", "Orlardun")] + [f"Photo: {a} Ulfardun" for a in ("Velna", "Torva")]
    docs += ["An interview with Odelis Ulfardun – Suite 212", "we met\nUlfardun, Odelis", "the report by Green Works", "so Odelis Works", "Terms, Green Works"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    names = spark.createDataFrame([(w, "given") for w in ("Velna", "Torva")] + [(w, "family") for w in ("Kessetzi", "Dulclemm", "Orlardun")], "word string, name_kind string")
    got = [(r.doc_id, docs[r.doc_id][r.start_at : r.end_at]) for r in pii.find(spark, df, names).collect() if r.kind == "name"]
    assert sorted(t for d, t in got if d >= 16) == ["Odelis Ulfardun", "Ulfardun, Odelis"] and len(got) == 18


NAMES = [("Velna", "given", "lat"), ("Kessetzi", "family", "lat")]
NO_ADDRESS = ["Im Jahr 2019", "Im August 2020", "Am Samstag 7", "Via Email 24", "Zum Preis 99", "3 Better Way", "2019 Grand Place"]


def test_phrases_with_a_number_are_no_addresses(spark):
    """Alone, and beside streets of the same types that stand in contact lines."""
    names = spark.createDataFrame(NAMES, "word string, name_kind string, script string")
    frames = ["{}", "{} war alles anders.", "Seen today: it was {} again, they said."]
    docs = [f.format(x) for x in NO_ADDRESS for f in frames[1:]] + NO_ADDRESS
    assert pii.find(spark, spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"), names).where("kind = 'address'").count() == 0
    real = [f"Adresse: {s} {i} | Tel. +1 212 555 01{i:02d}" for i in range(10, 40) for s in ("Am Dornigaberg", "Via Lodwick", "Zum Brimtor", "Hauptstraße")] + [f"Address: {i} Velstow {t} | +1 212 555 01{i}" for i in range(10, 40) for t in ("Road", "Street", "Lane", "Way", "Place")]
    docs = [f.format(x) for x in NO_ADDRESS for f in frames[1:]] + real
    found = pii.find(spark, spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"), names).where("kind = 'address'").collect()
    texts = [docs[r.doc_id][r.start_at : r.end_at] for r in found]
    assert not set(texts) & set(NO_ADDRESS) and all(r.doc_id >= 14 for r in found)
    assert {"Am Dornigaberg 12", "Via Lodwick 12", "Zum Brimtor 12", "Hauptstraße 12", "12 Velstow Road", "12 Velstow Way", "12 Velstow Place"} <= set(texts)


def test_plain_emails_need_no_witness_and_files_are_none(spark):
    docs = ["please write to bob.k@site.example soon", "see logo@2x.png and icon@3x.png here", "info (chiocciola) esempio (punto) test"] + [f"<img src=pic{i}@2x.png>" for i in range(5)]
    found = pii.find(spark, spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"), spark.createDataFrame(NAMES, "word string, name_kind string, script string"))
    assert [docs[r.doc_id][r.start_at : r.end_at] for r in found.where("kind = 'email'").collect()] == ["bob.k@site.example"]


def test_labels_are_read_as_far_back_as_their_words_go():
    long = "passport " + "a" * 70 + " " + "b" * 70 + " nr 990218130"
    assert pii.label_before(long, 0, long.index("9902"))[2].split()[0] == "passport"
    line = "first words, passport number " + "z" * 30 + " 990218130"
    assert pii.label_before(line, 0, line.index("9902")) == ("z" * 30, "number " + "z" * 30, "passport number " + "z" * 30)
    assert pii.label_before("one two three.\nx 99", 15, 17) == ("x", "x", "x") and pii.label_before("99", 0, 0) == ("", "", "")


def test_claimed_spans():
    rnd = random.Random(2)
    for _ in range(200):
        taken, plain = pii._Taken(), []
        for _ in range(30):
            a = rnd.randrange(60)
            b = a + rnd.randint(1, 6)
            assert taken.hit(a, b) == any(x < b and a < y for x, y in plain)
            if rnd.random() < 0.5:
                taken.add(a, b)
                plain.append((a, b))


def test_a_document_of_many_contact_lines(spark):
    text = "\n".join(f"Kessetzi, Velna, {i} Velstow Road, Tel. +1 212 555 {i:04d}, a{i}@b.test" for i in range(3000))
    found = pii.find(spark, spark.createDataFrame([(1, text)], "doc_id bigint, text string"), spark.createDataFrame(NAMES, "word string, name_kind string, script string"))
    assert {r.kind: r["count"] for r in found.groupBy("kind").count().collect()} == dict.fromkeys(("email", "address", "phone", "name"), 3000)


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    names = spark.createDataFrame([], "word string, name_kind string")
    assert pii.find(spark, df, names).count() == 0
    assert tokens.encode_corpus(df, "doc_id", "text").count() == 0
