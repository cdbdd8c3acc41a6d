"""Dual-tree joins against brute force."""

import numpy as np
import pytest

from quakeweave.operators import proximity as P
from quakeweave.sources.geojson import POLYGON, parse_geojson

SCHEMA = "id bigint, lat double, lon double, leaf string, task string"


def points(spark, rows):
    return spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)


def brute(rows, km):
    out = set()
    for i, (a, y, x) in enumerate(rows):
        for b, v, u in rows[i + 1 :]:
            if a != b and P.haversine_np(y, x, v, u) < km:
                out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("block", [20, 100_000])
def test_near_pairs(spark, block):
    rng = np.random.default_rng(5)
    rows = [(k, 33 + rng.random(), -118 + rng.random()) for k in range(300)]
    rows += [(1000 + k, 33.5, -117.5) for k in range(70)]  # a hot place
    rows += [(2000 + k, 33.5 + 1e-4 * rng.standard_normal(), -117.5 + 1e-4 * rng.standard_normal()) for k in range(60)]
    got = P.near_pairs(points(spark, rows), "id", "lat", "lon", 1.0, block_points=block)
    pairs = [tuple(r) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute(rows, 1.0)


def test_near_across_the_180th_meridian_and_poles(spark):
    rng = np.random.default_rng(8)
    rows = [(k, float(rng.uniform(-20, 20)), float((180 + 2 * rng.standard_normal() + 180) % 360 - 180)) for k in range(150)]
    rows += [(1000 + k, 89.9 - 0.3 * float(rng.random()), float(rng.uniform(-180, 180))) for k in range(60)]
    rows += [(2000, 5.0, 180.0), (2001, 5.0, -180.0), (2002, 5.001, 540.0), (2003, 5.0, -179.999), (2004, 5.0, 179.999)]
    for block in (15, 100_000):
        pairs = [tuple(r) for r in P.near_pairs(points(spark, rows), "id", "lat", "lon", 60.0, block_points=block).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == brute(rows, 60.0)


def test_many_points_at_one_place(spark):
    df = spark.range(40_000).selectExpr("id", "CASE WHEN id = 7 THEN 33.0001D ELSE 33D END AS lat", "-118D AS lon")
    members, pairs = P.near_places(df, "id", "lat", "lon", 0.12)
    assert members.count() == 40_000
    assert {(r["a_id"], r["a_n"], r["b_id"], r["b_n"]) for r in pairs.collect()} == {(0, 39_999, 0, 39_999), (0, 39_999, 7, 1)}
    assert P.near_pairs(df.where("id < 300"), "id", "lat", "lon", 0.12).count() == 300 * 299 // 2


def test_certain_nodes_are_handed_on_in_slices():
    xyz = P.unit_vectors(np.linspace(33, 33.00001, 4_000), np.full(4_000, -118.0))
    tree = P.KdTree(xyz)
    sizes = [len(i) for i, _ in P.near_index_pairs(tree, tree, 1.0)]
    assert sum(sizes) == 4_000 * 3_999 // 2 and max(sizes) <= P.PAIR_ROWS + 4_000


def test_near_pairs_edges(spark):
    nan = float("nan")
    rows = [(1, 33.0, -118.0), (2, 33.0, -118.0), (None, 33.0, -118.0), (3, nan, -118.0), (4, None, None), (5, float("inf"), 0.0), (1, 33.0, -118.0)]
    got = P.near_pairs(points(spark, rows), "id", "lat", "lon", 0.5).collect()
    assert {tuple(r) for r in got} == {(1, 2)}
    assert P.near_pairs(points(spark, []), "id", "lat", "lon", 0.5).count() == 0
    assert P.near_pairs(points(spark, [(1, 1.0, 1.0)]), "id", "lat", "lon", 0.5).count() == 0


def shape(cx, cy, r, n=9):
    a = np.linspace(0, 2 * np.pi, n + 1)
    ring = np.c_[cx + r * np.cos(a), cy + r * np.sin(a)]
    ring[-1] = ring[0]
    return ring.tolist()


@pytest.fixture(scope="module")
def rings(spark):
    features = [
        {"properties": {"name": "holed"}, "geometry": {"type": "Polygon", "coordinates": [shape(0, 0, 2), shape(0, 0, 1)]}},
        {"properties": {"name": "island"}, "geometry": {"type": "Polygon", "coordinates": [shape(0, 0, 0.5)]}},
        {"properties": {"name": "two"}, "geometry": {"type": "MultiPolygon", "coordinates": [[shape(5, 0, 1)], [shape(8, 0, 1)]]}},
    ]
    return spark.createDataFrame(parse_geojson({"type": "FeatureCollection", "features": features}), POLYGON)


def around(rings):
    edges = {}
    for r in rings.collect():
        edges.setdefault(r["region_id"], []).append(P.ring_edges(r["ring_lons"], r["ring_lats"]))
    return {k: np.concatenate(e) for k, e in sorted(edges.items())}


@pytest.mark.parametrize("vertices", [P.BLOCK_VERTICES, 25, 12])
def test_regions(spark, rings, vertices):
    rng = np.random.default_rng(1)
    rows = [(k, float(y), float(x)) for k, (y, x) in enumerate(zip(rng.uniform(-3, 3, 2000), rng.uniform(-3, 10, 2000)))]
    rows += [(9001, 0.0, 0.0), (9002, None, 1.0), (9003, float("nan"), 0.0), (9004, float("inf"), 0.0), (9005, 99.0, 0.0)]
    index = P.RegionIndex(rings, block_vertices=vertices)
    # With small blocks the ring and the hole of a region, or its two parts, are in different ones.
    assert len(index.trees) == {P.BLOCK_VERTICES: 1, 25: 3, 12: 5}[vertices] and index.shared == (vertices < 100) and index.regions == 3
    got = {r["id"]: r["region_id"] for r in P.locate_regions(points(spark, rows), "lat", "lon", index).collect()}
    edges = around(rings)
    for k, y, x in rows:
        want = None
        if y is not None and np.isfinite(y):
            want = next((i for i, e in edges.items() if P._inside(e, np.array([y]), np.array([x]))[0]), None)
        assert got[k] == want, (k, y, x)
    assert got[9001] == 2


def star(n, seed, cx=0.0, cy=0.0, smooth=False):
    """A jagged ring around (cx, cy), or one like a coast."""
    a = np.linspace(0, 2 * np.pi, n + 1)
    noise = np.random.default_rng(seed).standard_normal(n + 1)
    r = 1 + 0.2 * np.cumsum(noise) / np.sqrt(n) if smooth else 1 + 0.1 * np.abs(noise)
    r[-1] = r[0]
    x, y = cx + r * np.cos(a), cy + r * np.sin(a)
    x[-1], y[-1] = x[0], y[0]
    return P.ring_edges(x, y)


@pytest.mark.parametrize("leaf,depth", [(8, 20), (1, 6), (40, 3)])
def test_trees_equal_plain_test(leaf, depth):
    rng = np.random.default_rng(3)
    # Overlapping regions, grid-aligned squares that share edges and corners, positions on both.
    square = [P.ring_edges([i, i + 1, i + 1, i, i], [j, j, j + 1, j + 1, j]) for i in (-2, -1, 2) for j in (-1, 0)]
    edges = [star(400, 1), star(60, 2, 0.5, 0.2), np.concatenate([star(300, 3), star(50, 4) * 0.4]), *square]
    tree = P.RegionTree(list(range(len(edges))), edges, depth=depth, leaf=leaf)
    lat, lon = rng.uniform(-2, 2, 20_000), rng.uniform(-3, 4, 20_000)
    lat[:2000], lon[:2000] = rng.integers(-4, 5, 2000) / 2, rng.integers(-6, 9, 2000) / 2
    lat[2000:6000], lon[2000:6000] = 0.01 * rng.standard_normal(4000) + 1.0, 0.01 * rng.standard_normal(4000)
    inside = np.stack([P._inside(e, lat, lon) for e in edges])
    want = np.where(inside.any(0), inside.argmax(0), -1)
    assert (tree.locate(lat, lon) == want).all()
    got = np.zeros_like(inside)
    for at, k in tree.around(lat, lon):
        assert not got[k, at].any()
        got[k, at] = True
    assert (got == inside).all() or (got.argmax(0)[inside.any(0)] == want[inside.any(0)]).all()


def test_edges_side_by_side_do_not_multiply():
    edges = star(20_000, 11)
    tree = P.RegionTree([0], [edges])
    assert len(tree.edge_of) < 30 * len(edges)
    rng = np.random.default_rng(12)
    lat, lon = rng.uniform(-1.5, 1.5, 2_000), rng.uniform(-1.5, 1.5, 2_000)
    assert ((tree.locate(lat, lon) == 0) == P._inside(edges, lat, lon)).all()


def test_large_region_looks_at_few_edges(monkeypatch):
    edges = star(1_000_000, 5, smooth=True)
    tree = P.RegionTree([7], [edges])
    rng = np.random.default_rng(6)
    lat, lon = rng.uniform(-1.5, 1.5, 1_000_000), rng.uniform(-1.5, 1.5, 1_000_000)
    looked = []
    real = P._crosses
    monkeypatch.setattr(P, "_crosses", lambda e, *a: looked.append(len(e)) or real(e, *a))
    got = tree.locate(lat, lon)
    assert sum(looked) < 20_000_000
    some = rng.choice(1_000_000, 200, replace=False)
    assert ((got[some] == 0) == P._inside(edges, lat[some], lon[some])).all()


def test_regions_empty(spark, rings):
    assert P.locate_regions(points(spark, []), "lat", "lon", rings).count() == 0
    none = P.locate_regions(points(spark, [(1, 0.0, 0.0)]), "lat", "lon", rings.limit(0)).first()
    assert none["region_id"] is None and none["leaf"] == "a"


def test_boundary_distance(spark):
    edges = P.ring_edges([-118.0, -117.0, -117.0, -118.0, -118.0], [33.0, 33.0, 34.0, 34.0, 33.0])
    many = np.concatenate([np.stack([np.linspace(a[0], a[2], 101)[:-1], np.linspace(a[1], a[3], 101)[:-1], np.linspace(a[0], a[2], 101)[1:], np.linspace(a[1], a[3], 101)[1:]], 1) for a in edges])
    rng = np.random.default_rng(3)
    rows = [(k, float(y), float(x)) for k, (y, x) in enumerate(zip(rng.uniform(32, 35, 200), rng.uniform(-120, -115, 200)))] + [(999, None, 1.0)]
    got = {r["id"]: r["boundary_km"] for r in P.boundary_distance(points(spark, rows), "lat", "lon", many).collect()}
    t = np.linspace(0, 1, 20001)
    line = np.concatenate([np.stack([e[1] + t * (e[3] - e[1]), e[0] + t * (e[2] - e[0])], 1) for e in edges])
    for k, y, x in rows[:-1]:
        assert got[k] == pytest.approx(P.haversine_np(y, x, line[:, 0], line[:, 1]).min(), rel=2e-3, abs=0.02)
    assert got[999] is None
    blocks = {r["id"]: r["boundary_km"] for r in P.boundary_distance(points(spark, rows), "lat", "lon", many, block_vertices=70).collect()}
    assert all(blocks[k] == got[k] for k in got)
    assert P.boundary_distance(points(spark, [(1, 1.0, 1.0)]), "lat", "lon", np.zeros((0, 4))).first()["boundary_km"] is None


def test_boundary_distance_of_many_edges_equals_brute_force():
    edges, rng = star(3_000, 9), np.random.default_rng(2)
    lat, lon = np.r_[rng.uniform(-3, 3, 500), np.full(40, 0.5)], np.r_[rng.uniform(-3, 3, 500), np.full(40, 0.5)]
    got = P.EdgeTree(edges).distance_km(lat, lon)
    want = np.min([P._to_edges(np.repeat(e[None], len(lat), 0), lat, lon) for e in edges], axis=0)
    assert np.allclose(got, want, rtol=1e-12)
