"""Bisecting k-means on planted clusters."""

import numpy as np

from quakeweave.llm import cluster as C


def points(spark, rows):
    return spark.createDataFrame([(i, x, "s", 1) for i, x in rows], "id bigint, features array<double>, leaf string, cluster_id int").repartition(3)


def planted(sizes, seed=0):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0], [4, 0, 0], [0, 4, 0], [4, 4, 1], [-3, -3, 3]])
    rows, truth = [], {}
    for c, n in enumerate(sizes):
        for x in centres[c] + rng.normal(0, 0.15, (n, 3)):
            truth[len(rows)] = c
            rows.append((len(rows), x.tolist()))
    return rows, truth


def test_planted_clusters_of_very_different_sizes(spark):
    rows, truth = planted([400, 90, 30, 6, 2])
    got = C.cluster(points(spark, rows), rms_limit=0.5, radius_limit=1.25).toPandas()
    assert len(got) == len(rows)
    pairs = {(truth[i], c) for i, c in zip(got.id, got.cluster_id)}
    assert len(pairs) == 5
    for c in set(truth.values()):
        assert set(got[got.id.map(truth) == c].cluster_id) == {min(i for i, t in truth.items() if t == c)}
    d = C.describe(C.cluster(points(spark, rows), rms_limit=0.5, radius_limit=1.25), members=2).toPandas()
    assert sorted(d["size"]) == [2, 6, 30, 90, 400] and d.typical_ids.map(len).eq(2).all() and d.rms_distance.max() < 0.5
    big = got[got.cluster_id == 0].sort_values(["distance", "id"]).id.head(2).tolist()
    assert list(d[d["size"] == 400].typical_ids.iloc[0]) == big


def test_edges(spark):
    nan = float("nan")
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (2, [0.0, 0.0]), (None, [9.0, 9.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [float("inf"), 0.0]), (7, [5.0, 5.0])]
    got = sorted((r["id"], r["cluster_id"]) for r in C.cluster(points(spark, rows), rms_limit=0.1, radius_limit=0.2).collect())
    assert got == [(1, 1), (2, 1), (2, 1), (7, 7)]
    assert C.cluster(points(spark, []), rms_limit=1, radius_limit=1).count() == 0
    assert C.cluster(points(spark, [(3, [1.0])]), rms_limit=1, radius_limit=1).collect()[0]["cluster_id"] == 3


def test_leaves_keep_the_limits_and_their_records(spark):
    rng = np.random.default_rng(3)
    rows = [(k, x.tolist()) for k, x in enumerate(rng.uniform(-5, 5, (3_000, 2)))]
    tree, levels = C.bisect(points(spark, rows), rms_limit=0.5, radius_limit=1.25)
    at = {}
    for frame in levels:
        at |= {r["id"]: r["node"] for r in frame.collect() if tree.nodes[r["node"]].left < 0}
    assert len(at) == 3_000 and set(at.values()) == set(tree.leaves)
    for k in tree.leaves:
        x = np.array([rows[i][1] for i, n in at.items() if n == k])
        node = tree.nodes[k]
        assert node.n == len(x) and np.allclose(node.centre, x.mean(0))
        far = np.sqrt(((x - x.mean(0)) ** 2).sum(1))
        assert np.sqrt((far**2).mean()) <= 0.5 and far.max() <= 1.25 and abs(far.max() - node.radius) < 1e-9


def test_thousands_of_leaves(spark):
    """5,000 pairs of equal records, each pair far from the others."""
    n = 5_000
    rows = [(k, [float(k % n % 71), float(k % n // 71)]) for k in range(2 * n)]
    got = C.cluster(points(spark, rows), rms_limit=0.1, radius_limit=0.2).toPandas()
    assert (got.cluster_id == got.id % n).all() and len(got) == 2 * n and got.distance.max() < 1e-9


def test_the_cut_runs_through_the_emptiest_place():
    bins = np.zeros((1, 8, 3))
    for at, n in enumerate([5, 50, 5, 0, 40, 45, 40, 3]):
        bins[0, at] = [n, n * at, n * at * at]
    assert C.best_cut(bins, 1)[:2] == (0, 3) or C.best_cut(bins, 1)[:2] == (0, 2)
    assert C.best_cut(np.zeros((2, 8, 3)), 1) == (-1, -1, -1, -1)


def test_no_split_cuts_a_compact_set(spark):
    rng = np.random.default_rng(7)
    shapes = np.array([[0.9, 0.8, 0.9, 0.8, 0.8], [-0.9, -0.8, -0.9, -0.8, -0.8], [0.9, 0.7, 0, -0.4, -0.9], [-0.9, -0.6, 0, 0.5, 0.9], [0, -0.8, 1, -0.8, 0.1], [-0.2, 0.9, -1, 0.9, 0]])
    rows, truth = [], []
    for c, n in enumerate((900, 500, 700, 60, 350, 150)):
        rows += [(len(rows) + k, x.tolist()) for k, x in enumerate(shapes[c] + rng.normal(0, 0.14, (n, 5)))]
        truth += [c] * n
    got = C.cluster(points(spark, rows), rms_limit=0.5, radius_limit=1.25).toPandas()
    assert len({(truth[i], c) for i, c in zip(got.id, got.cluster_id)}) == 6


def test_cluster_sizes_of_the_query(spark, small):
    from quakeweave.llm import queries as Q

    found, told = Q.p4_found(spark, small).toPandas(), Q.p4_clusters(spark, small).toPandas()
    assert dict(zip(told.cluster_id, told.cluster_size)) == found.groupby("cluster_id").size().to_dict()
    assert (told.n_clusters == len(told)).all() and found.station_id.is_unique
    of = dict(zip(found.station_id, found.cluster_id))
    for r in told.itertuples():
        typical = [int(x) for x in r.typical_stations.split(",")]
        assert len(typical) == min(3, r.cluster_size) and all(of[x] == r.cluster_id for x in typical)
        assert r.cluster_id == min(k for k, c in of.items() if c == r.cluster_id)
