"""Similarity clusters by bisecting k-means over the whole cluster.

Every node that is not compact enough is split in two, largest dispersion first; since
only the limits decide whether a node is split, all such nodes of a level are split in
the same passes. The records carry the node they are in; those of finished leaves take no
part in later passes. The driver holds the tree (centres of nodes), never records.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakeweave.runtime import cut_lineage


@dataclass
class Node:
    centre: np.ndarray
    n: int = 0
    sse: float = 0.0
    radius: float = 0.0
    level: int = 0
    left: int = -1
    right: int = -1
    #: The way from one mean to the other, and the bin along it behind which records go right.
    base: np.ndarray | None = None
    way: np.ndarray | None = None
    cut: int = 0


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=list)

    @property
    def leaves(self) -> list[int]:
        return [k for k, x in enumerate(self.nodes) if x.left < 0]


def _batch(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and features of a batch's records."""
    flat = b.column(b.schema.get_field_index("features"))
    x = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))
    return b.column(b.schema.get_field_index("node")).to_numpy(zero_copy_only=False), x


_PART = "node bigint, sums binary, most binary"


def _gather(points: DataFrame, nodes: np.ndarray, shape: tuple[int, ...], add: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], None], finish: Callable[[int, np.ndarray, np.ndarray], tuple], out: str) -> list:
    """For each node one row ``finish(k, sums, most)``, with the node's place ``k`` among ``nodes``.

    ``add(k, x, sums, most)`` takes in a batch: the sums have the given shape per node, most
    is the greatest square distance and, with it, the record there. A task holds and sends
    one such block per node it has records of; the blocks of a node are added up in two
    rounds, and only finished rows reach the driver.
    """
    schema = pa.schema([("node", pa.int64()), ("sums", pa.binary()), ("most", pa.binary())])
    size = int(np.prod(shape))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, most, seen = np.zeros((len(nodes), *shape)), None, np.zeros(len(nodes), bool)
        for b in batches:
            node, x = _batch(b)
            k = np.searchsorted(nodes, node)
            own = (k < len(nodes)) & (nodes[np.minimum(k, len(nodes) - 1)] == node)
            k, x = k[own], x[own]
            if not len(k):
                continue
            if most is None:
                most = np.full((len(nodes), x.shape[1] + 1), -1.0)
            seen[k] = True
            add(k, x, sums, most)
        some = np.flatnonzero(seen)
        for s in range(0, len(some), 256):
            part = some[s : s + 256]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([sums[k].tobytes() for k in part], pa.binary()), pa.array([most[k].tobytes() for k in part], pa.binary())], schema=schema)

    def added(batches: Iterator[pa.RecordBatch]) -> tuple[int, np.ndarray, np.ndarray]:
        total, most, node = np.zeros(size), None, -1
        for b in batches:
            for node, s, m in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("node", "sums", "most"))):
                total += np.frombuffer(s)
                m = np.frombuffer(m)
                # Ties go to the smaller record, whatever the order of the tasks.
                if most is None or m[0] > most[0] or (m[0] == most[0] and tuple(m[1:]) < tuple(most[1:])):
                    most = m
        return node, total.reshape(shape), most

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, total, most = added(batches)
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([total.tobytes()], pa.binary()), pa.array([most.tobytes()], pa.binary())], schema=schema)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, total, most = added(batches)
        row = finish(node, total, most)
        names, kinds = zip(*(c.split() for c in f"node bigint, {out}".split(", ")))
        types = {"bigint": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
        yield pa.RecordBatch.from_arrays([pa.array([v], types[t]) for v, t in zip((node, *row), kinds)], names=list(names))

    parts = points.select("node", "features").mapInArrow(partial, _PART).withColumn("salt", F.spark_partition_id() % 32)
    once = parts.groupBy("node", "salt").applyInArrow(first, _PART)
    return once.groupBy("node").applyInArrow(last, f"node bigint, {out}").collect()


#: Directions of greatest spread and features of greatest spread along which a split is looked for, bins along each, and nodes in one pass.
AXES, FEATURES, BINS, NODES = 2, 4, 64, 1_024


def _moments(k: np.ndarray, x: np.ndarray, sums: np.ndarray) -> None:
    """Count, sum, sum of squares and cross products of records in groups ``k``."""
    d = x.shape[1]
    for j, v in enumerate([np.ones(len(x)), *x.T, (x**2).sum(1), *(x[:, :, None] * x[:, None, :]).reshape(len(x), d * d).T]):
        sums[:, j] += np.bincount(k, weights=v, minlength=len(sums))


def _spread(n: float, s: np.ndarray, cross: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Standard deviations along the directions and features of greatest spread, and these directions."""
    c = s / n
    cov = cross.reshape(len(s), len(s)) / n - np.outer(c, c)
    value, vector = np.linalg.eigh(cov)
    order, own = np.argsort(-value)[:AXES], np.argsort(-np.diag(cov), kind="stable")[:FEATURES]
    return np.sqrt(np.maximum(np.r_[value[order], np.diag(cov)[own]], 0)), np.r_[vector[:, order].T, np.eye(len(s))[own]]


def best_cut(ways: np.ndarray, d: int) -> tuple[int, int, int, int]:
    """The cut of rows of bins (count and sum first in each bin), one row a way, that explains much and runs through few records.

    Of the cuts that take away at least half as much of the sum of squares as the best one,
    the one in the emptiest place. Gives its way and the last bin on the left, and the same
    of the cut that takes away most; -1 if all records are in one bin.
    """
    found = []
    for way, bins in enumerate(ways):
        gain, crowd = _gains(bins, d)
        found += [(g, c, way, at) for at, (g, c) in enumerate(zip(gain, crowd)) if g >= 0]
    if not found:
        return -1, -1, -1, -1
    most = max(found, key=lambda f: (f[0], -f[2], -f[3]))
    best = min((f for f in found if f[0] >= 0.5 * most[0]), key=lambda f: (f[1], -f[0], f[2], f[3]))
    return best[2], best[3], most[2], most[3]


def _gains(bins: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """What a cut behind each bin takes away of the sum of squares (-1 if it divides nothing), and how many records are around it."""
    n, s = np.cumsum(bins[:, 0])[:-1], np.cumsum(bins[:, 1 : d + 1], axis=0)[:-1]
    all_n, all_s = bins[:, 0].sum(), bins[:, 1 : d + 1].sum(0)
    ok = (n > 0) & (n < all_n)
    a, b = np.maximum(n, 1)[:, None], np.maximum(all_n - n, 1)[:, None]
    gain = np.where(ok, (s**2 / a).sum(1) + ((all_s - s) ** 2 / b).sum(1) - (all_s**2).sum() / max(all_n, 1), -1.0)
    near = np.convolve(bins[:, 0], [1, 1, 1], "same")
    return np.where(ok, np.maximum(gain, 0), -1.0), near[:-1] + near[1:]


def _bin(x: np.ndarray, base: np.ndarray, way: np.ndarray) -> np.ndarray:
    """Bins along the way between two means, and a quarter of it beyond each; the outermost take what lies further out."""
    t = np.einsum("nd,nd->n", x - base, way) / np.maximum(np.einsum("nd,nd->n", way, way), 1e-300)
    return np.clip(((t + 0.25) / 1.5 * BINS).astype(np.int64), 0, BINS - 1)


def bisect(points: DataFrame, *, rms_limit: float, radius_limit: float, rounds: int = 3, least: int = 2, tolerance: float = 1e-3) -> tuple[Tree, list[DataFrame]]:
    """The tree of a bisecting k-means over ``features`` (arrays of equal length without NULL), and the records with their nodes, level by level.

    A node is split while its root mean square distance to the centre exceeds
    ``rms_limit`` or its farthest record lies beyond ``radius_limit``, unless it has fewer
    than ``least`` records or all of them are equal. The two means start from the best cut
    along the directions of greatest spread, found in exact counts over bins, and move for
    at most ``rounds`` passes. The border between them is then put where it runs through
    the fewest records, so that it cuts no compact set in two where there is a gap beside
    it. The number of splits has no cap.
    """
    tree, levels = Tree(), []
    work = cut_lineage(points.select("id", "features", F.lit(0).cast("bigint").alias("node")), "points")
    first = work.select("features").first()
    if first is None:
        return tree, [work]
    d = len(first["features"])
    width = 2 + d + d * d
    root = _gather(work, np.zeros(1, np.int64), (width,), lambda k, x, sums, most: _moments(k, x, sums), lambda k, s, m: (s,), "s array<double>")
    moments = {0: np.array(root[0]["s"])}
    tree.nodes.append(Node(moments[0][1 : d + 1] / moments[0][0]))
    while moments:
        levels.append(work)
        starts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        # Largest dispersion first, as many nodes at a time as a task can hold.
        order = sorted(moments, key=lambda k: -(moments[k][d + 1] - (moments[k][1 : d + 1] ** 2).sum() / moments[k][0]))
        for at in range(0, len(order), NODES):
            starts |= _cuts(work, tree, {k: moments[k] for k in order[at : at + NODES]}, d, rms_limit, radius_limit, least)
        moments = {}
        for at in range(0, len(starts), NODES):
            chosen = dict(list(starts.items())[at : at + NODES])
            moments |= _two_means(work, tree, chosen, d, rounds, tolerance)
        if not moments:
            break
        work = cut_lineage(_children(work, tree, len(levels)), "points")
    return tree, levels


def _cuts(work: DataFrame, tree: Tree, moments: dict[int, np.ndarray], d: int, rms_limit: float, radius_limit: float, least: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Dispersion of each node, written into the tree, and for each that is to be split two starting means and the two ends of the way with the emptiest cut."""
    nodes = np.array(sorted(moments), np.int64)
    ways = min(AXES, d) + min(FEATURES, d)
    centres, base, way = np.empty((len(nodes), d)), np.zeros((len(nodes), ways, d)), np.zeros((len(nodes), ways, d))
    for i, k in enumerate(nodes):
        m = moments[k]
        n, s, q = m[0], m[1 : d + 1], m[d + 1]
        x = tree.nodes[k]
        x.n, x.centre, x.sse = int(n), s / n, max(0.0, q - (s @ s) / n)
        centres[i] = x.centre
        spread, vectors = _spread(n, s, m[d + 2 :])
        # From two standard deviations below the mean to two above.
        way[i] = 4 * np.maximum(spread, 1e-12)[:, None] * vectors
        base[i] = x.centre - way[i] / 2

    def add(k: np.ndarray, x: np.ndarray, sums: np.ndarray, most: np.ndarray) -> None:
        far = ((x - centres[k]) ** 2).sum(1)
        order = np.lexsort((*x.T[::-1], -far, k))
        top = order[np.r_[True, k[order][1:] != k[order][:-1]]]
        better = (far[top] > most[k[top], 0]) | ((far[top] == most[k[top], 0]) & (x[top, 0] < most[k[top], 1]))
        most[k[top[better]]] = np.c_[far[top[better]], x[top[better]]]
        for a in range(ways):
            at = k * BINS + _bin(x, base[k, a], way[k, a])
            for j, v in enumerate([np.ones(len(x)), *x.T]):
                sums[:, a, :, j] += np.bincount(at, weights=v, minlength=len(sums) * BINS).reshape(len(sums), BINS)

    def finish(k: int, sums: np.ndarray, most: np.ndarray) -> tuple:
        empty, _, a, at = best_cut(sums, d)
        if at < 0:
            return float(most[0]), most[1:], np.zeros(0), np.zeros(0), -1
        left, right = sums[a, : at + 1].sum(0), sums[a, at + 1 :].sum(0)
        return float(most[0]), most[1:], left[1:] / left[0], right[1:] / right[0], empty

    starts = {}
    for r in _gather(work, nodes, (ways, BINS, 1 + d), add, finish, "far double, farthest array<double>, a array<double>, b array<double>, way bigint"):
        k, i = int(nodes[r["node"]]), r["node"]
        x = tree.nodes[k]
        x.radius = float(np.sqrt(r["far"]))
        if x.n < least or x.radius <= 1e-12 or (np.sqrt(x.sse / x.n) <= rms_limit and x.radius <= radius_limit):
            continue
        # Where all records share a bin, the farthest one and its opposite.
        pair = np.array([r["a"], r["b"]]) if r["a"] else np.array([2 * x.centre - np.array(r["farthest"]), r["farthest"]])
        starts[k] = pair, np.array([base[i, r["way"]], base[i, r["way"]] + way[i, r["way"]]]) if r["a"] else pair
    return starts


def _two_means(work: DataFrame, tree: Tree, starts: dict[int, tuple[np.ndarray, np.ndarray]], d: int, rounds: int, tolerance: float) -> dict[int, np.ndarray]:
    """Two means and the border between them for each node: its children are put into the tree, and their moments returned."""
    pairs, active = {k: pair for k, (pair, _) in starts.items()}, set(starts)
    for _ in range(rounds):
        if not active:
            break
        nodes = np.array(sorted(active), np.int64)
        pair = np.stack([pairs[k] for k in nodes])

        def halves(k, x, sums, most, pair=pair):
            right = ((x - pair[k, 1]) ** 2).sum(1) < ((x - pair[k, 0]) ** 2).sum(1)
            flat = sums.reshape(2 * len(sums), -1)
            for j, v in enumerate([np.ones(len(x)), *x.T]):
                flat[:, j] += np.bincount(2 * k + right, weights=v, minlength=len(flat))

        for r in _gather(work, nodes, (2, 1 + d), halves, lambda k, s, m: (s.ravel(),), "s array<double>"):
            k = int(nodes[r["node"]])
            m = np.array(r["s"]).reshape(2, -1)
            means = m[:, 1:] / np.maximum(m[:, :1], 1)
            if (m[:, 0] == 0).any() or np.abs(means - pairs[k]).max() <= tolerance:
                active.discard(k)
            else:
                pairs[k] = means
    nodes = np.array(sorted(starts), np.int64)
    # The way between the means, and the one on which a cut was found in the emptiest place.
    ends = np.array([[pairs[k], starts[k][1]] for k in nodes])
    base, way = ends[:, :, 0], ends[:, :, 1] - ends[:, :, 0]

    def along(k, x, sums, most):
        for a in range(2):
            _moments((2 * k + a) * BINS + _bin(x, base[k, a], way[k, a]), x, sums.reshape(2 * len(sums) * BINS, -1))

    def border(k, sums, most):
        a, at, _, _ = best_cut(sums, d)
        return a, at, sums[a, : at + 1].sum(0), sums[a, at + 1 :].sum(0)

    out = {}
    found = _gather(work, nodes, (2, BINS, 2 + d + d * d), along, border, "way bigint, at bigint, a array<double>, b array<double>")
    for r in sorted(found, key=lambda r: r["node"]):
        i, a = r["node"], r["way"]
        k = int(nodes[i])
        if r["at"] < 0:
            continue
        x = tree.nodes[k]
        x.left, x.right, x.base, x.way, x.cut = len(tree.nodes), len(tree.nodes) + 1, base[i, a], way[i, a], r["at"]
        for side in "ab":
            m = np.array(r[side])
            out[len(tree.nodes)] = m
            tree.nodes.append(Node(m[1 : d + 1] / m[0], level=x.level + 1))
    return out


def _children(work: DataFrame, tree: Tree, level: int) -> DataFrame:
    """The records of the nodes that were split, with the child they go to."""
    nodes = np.array([k for k, x in enumerate(tree.nodes) if x.left >= 0 and x.level == level - 1], np.int64)
    left, cut = np.array([tree.nodes[k].left for k in nodes]), np.array([tree.nodes[k].cut for k in nodes])
    base, way = np.stack([tree.nodes[k].base for k in nodes]), np.stack([tree.nodes[k].way for k in nodes])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, x = _batch(b)
            k = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
            own = np.flatnonzero(nodes[k] == node)
            k = k[own]
            right = _bin(x[own], base[k], way[k]) > cut[k] if len(own) else np.zeros(0, bool)
            rest = b.take(pa.array(own))
            yield pa.RecordBatch.from_arrays([rest.column(0), rest.column(1), pa.array(left[k] + right)], names=["id", "features", "node"])

    return work.select("id", "features", "node").mapInArrow(go, work.schema)


#: The table of leaves is broadcast up to so many of them (about 100 bytes each).
BROADCAST_LEAVES = 100_000


def cluster(points: DataFrame, *, rms_limit: float, radius_limit: float) -> DataFrame:
    """Clusters of mutually similar records: ``id``, ``cluster_id``, ``distance`` to the centre.

    ``points`` has ``id`` (bigint) and ``features`` (array of doubles). ``cluster_id`` is the
    smallest id of the cluster. Clusters are the leaves of ``bisect``. Defined results:
    records whose id is NULL or whose features are NULL or hold a NULL, NaN or infinity are
    left out; equal records share a cluster; an id given twice is two records; other columns
    are ignored; an empty input gives no rows.
    """
    usable = F.col("id").isNotNull() & F.col("features").isNotNull() & ~F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    tree, levels = bisect(points.where(usable).select(F.col("id").cast("bigint").alias("id"), F.col("features").cast("array<double>").alias("features")), rms_limit=rms_limit, radius_limit=radius_limit)
    spark = points.sparkSession
    rows = [(k, tree.nodes[k].level, tree.nodes[k].centre.tolist()) for k in tree.leaves]
    leaves = spark.createDataFrame(rows, "node bigint, level int, centre array<double>")
    every = None
    for level, frame in enumerate(levels):
        own = leaves.where(F.col("level") == level)
        own = F.broadcast(own) if len(rows) <= BROADCAST_LEAVES else own
        distance = F.sqrt(F.aggregate(F.zip_with("features", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v))
        part = frame.join(own, "node").select("id", "node", distance.alias("distance"))
        every = part if every is None else every.unionByName(part)
    placed = cut_lineage(every, "placed")
    smallest = placed.groupBy("node").agg(F.min("id").alias("cluster_id"))
    smallest = F.broadcast(smallest) if len(rows) <= BROADCAST_LEAVES else smallest
    return placed.join(smallest, "node").select("id", "cluster_id", "distance")


def describe(clusters: DataFrame, *, members: int = 3) -> DataFrame:
    """Per cluster its size, root mean square distance and the ids of the members nearest to the centre.

    The ranking is cut to ``members`` rows per task before the shuffle. Ties go to the
    smaller id.
    """
    nearest = Window.partitionBy("cluster_id").orderBy("distance", "id")
    top = clusters.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= members)
    typical = top.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("typical_ids"))
    sizes = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.sqrt(F.avg(F.col("distance") ** 2)).alias("rms_distance"))
    return sizes.join(typical, "cluster_id")
