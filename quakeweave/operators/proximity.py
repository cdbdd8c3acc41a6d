"""Points near other points or inside regions, by dual-tree joins.

One tree is made over the points (quadtree blocks of bounded size over the whole cluster,
a k-d tree inside each block; for regions and boundaries a tree over each task's batch)
and one over the other points, the regions or the edges. The two are walked together:
node pairs that cannot match are discarded by their bounds, pairs that must match are
accepted as a whole, and only the uncertain ones are refined down to single points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakeweave.runtime import cut_lineage

# Fixed value: radius in km of the sphere on which distances are taken.
EARTH_RADIUS_KM = 6371.0088

#: Regions and boundaries go to the executors in blocks of at most so many vertices (or of one ring, if that has more).
BLOCK_VERTICES = 500_000
#: Pairs are handed on in batches of about so many.
PAIR_ROWS = 100_000


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=1)


def haversine_np(lat1, lon1, lat2, lon2) -> np.ndarray:
    p, q = np.radians(lat1), np.radians(lat2)
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


# ---------------------------------------------------------------- points near points


class KdTree:
    """Median-split tree over points in space; a node is a range of ``order`` with its bounding box."""

    def __init__(self, xyz: np.ndarray, leaf: int = 32):
        self.order = np.arange(len(xyz))
        self.start, self.stop, self.left, self.right, lows, highs = [], [], [], [], [], []
        stack = [(0, len(xyz), -1, 0)] if len(xyz) else []
        while stack:
            a, b, parent, side = stack.pop()
            at = len(self.start)
            if parent >= 0:
                (self.left if side == 0 else self.right)[parent] = at
            own = xyz[self.order[a:b]]
            low, high = own.min(0), own.max(0)
            for x, v in zip((self.start, self.stop, self.left, self.right, lows, highs), (a, b, -1, -1, low, high)):
                x.append(v)
            if b - a > leaf and (high > low).any():
                axis, mid = int(np.argmax(high - low)), (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
                stack += [(a, a + mid, at, 0), (a + mid, b, at, 1)]
        self.low, self.high = np.array(lows), np.array(highs)
        self.points = xyz[self.order] if len(xyz) else xyz


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start..start+size-1 of all ranges, one range after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def near_index_pairs(a: KdTree, b: KdTree, chord: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into the points the trees were made of) less than ``chord`` apart, about ``PAIR_ROWS`` at a time.

    With the same tree twice, each pair of different points comes once.
    """
    if not a.start or not b.start:
        return
    limit, self_join = chord * chord, a is b
    pairs = np.array([[0, 0]])
    start_a, start_b = np.array(a.start), np.array(b.start)
    size_a, size_b = np.array(a.stop) - start_a, np.array(b.stop) - start_b
    la, ra, lb, rb = (np.array(x) for x in (a.left, a.right, b.left, b.right))
    while len(pairs):
        i, j = pairs[:, 0], pairs[:, 1]
        gap = np.maximum(0, np.maximum(a.low[i] - b.high[j], b.low[j] - a.high[i]))
        far = np.maximum(a.high[i] - b.low[j], b.high[j] - a.low[i])
        possible = (gap * gap).sum(1) < limit
        certain = possible & ((far * far).sum(1) < limit * (1 - 1e-9))
        leaves = (la[i] < 0) & (lb[j] < 0)
        done = np.flatnonzero(possible & (certain | leaves))
        # Node pairs that are settled, as rows of the first node against all of the second, in slices.
        rows = _ranges(start_a[i[done]], size_a[i[done]])
        of = np.repeat(done, size_a[i[done]])
        width = size_b[j[of]]
        cut = 0
        while cut < len(rows):
            stop = cut + max(1, int(np.searchsorted(np.cumsum(width[cut : cut + PAIR_ROWS]), PAIR_ROWS, side="right")))
            x = np.repeat(rows[cut:stop], width[cut:stop])
            y = _ranges(start_b[j[of[cut:stop]]], width[cut:stop])
            keep = np.repeat(certain[of[cut:stop]], width[cut:stop])
            unsure = np.flatnonzero(~keep)
            keep[unsure] = ((a.points[x[unsure]] - b.points[y[unsure]]) ** 2).sum(1) < limit
            if self_join:
                keep &= (x < y) | np.repeat(i[of[cut:stop]] != j[of[cut:stop]], width[cut:stop])
            if keep.any():
                yield a.order[x[keep]], b.order[y[keep]]
            cut = stop
        go = possible & ~certain & ~leaves
        i, j = i[go], j[go]
        if self_join:
            same = i == j
            k = i[same]
            inner = [np.stack(p, 1) for p in ((la[k], la[k]), (la[k], ra[k]), (ra[k], ra[k]))]
            i, j = i[~same], j[~same]
        else:
            inner = []
        first = (lb[j] < 0) | ((la[i] >= 0) & (size_a[i] >= size_b[j]))
        pairs = np.concatenate(
            inner + [np.stack([c[i[first]], j[first]], 1) for c in (la, ra)] + [np.stack([i[~first], c[j[~first]]], 1) for c in (lb, rb)]
        )


def morton(ix: np.ndarray, iy: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(ix), np.int64)
    for k in range(bits):
        out |= ((ix >> k) & 1) << (2 * k) | ((iy >> k) & 1) << (2 * k + 1)
    return out


class Blocks:
    """Quadtree leaves over a bounding box, as ranges of Morton codes at depth ``bits``."""

    def __init__(self, box: tuple[float, float, float, float], bits: int, starts: np.ndarray, splits: np.ndarray):
        self.box, self.bits, self.starts, self.splits = box, bits, starts, splits

    def codes(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        x0, y0, x1, y1 = self.box
        n = 1 << self.bits
        ix = np.clip(((lon - x0) / max(x1 - x0, 1e-12) * n).astype(np.int64), 0, n - 1)
        iy = np.clip(((lat - y0) / max(y1 - y0, 1e-12) * n).astype(np.int64), 0, n - 1)
        return morton(ix, iy, self.bits)

    def leaf(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, self.codes(lat, lon), side="right") - 1


def _margins(lat: np.ndarray, radius_km: float) -> tuple[float, np.ndarray]:
    dlat = np.degrees(radius_km / EARTH_RADIUS_KM) * 1.0001
    s = np.sin(radius_km / (2 * EARTH_RADIUS_KM)) / np.maximum(1e-9, np.cos(np.radians(np.minimum(np.abs(lat) + dlat, 89.999))))
    return dlat, 2 * np.degrees(np.arcsin(np.minimum(1, s))) * 1.0001


def plan_blocks(points: DataFrame, lat: str, lon: str, radius_km: float, block_points: int, step: int = 5) -> Blocks:
    """Split the plane until a block has at most ``block_points`` points or is as narrow as twice the radius.

    Counted from the top: each round counts only the cells that are still too full, by a
    partial aggregation; what reaches the driver is one row per child of such a cell.
    Blocks that cannot be split further are marked with the number of parts into which
    their points are divided by hash.
    """
    r = points.agg(*[f(c).alias(n) for n, f, c in (("x0", F.min, lon), ("y0", F.min, lat), ("x1", F.max, lon), ("y1", F.max, lat))], F.count(F.lit(1)).alias("n")).first()
    if not r["n"]:
        return Blocks((0, 0, 1, 1), 1, np.array([0]), np.array([1]))
    box = (r["x0"], r["y0"], r["x1"] + 1e-9, r["y1"] + 1e-9)
    dlat, dlon = _margins(np.array([r["y0"], r["y1"]]), radius_km)
    widest = max(1, min(20, int(np.log2(max(2, min((box[2] - box[0]) / (2 * dlon.max()), (box[3] - box[1]) / (2 * dlat)))))))
    full = {(0, 0, 0): r["n"]}
    leaves: list[tuple[int, int, int, int]] = []
    while full:
        depth = min(d for d, _, _ in full)
        now = {k: n for k, n in full.items() if k[0] == depth}
        full = {k: n for k, n in full.items() if k[0] != depth}
        small = {k: n for k, n in now.items() if n <= block_points or depth >= widest}
        leaves += [(*k, n) for k, n in small.items()]
        now = {k: n for k, n in now.items() if k not in small}
        if not now:
            continue
        deeper = min(widest, depth + step)
        cell = lambda c, lo, hi, d: F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(hi - lo) * F.lit(1 << d)), F.lit((1 << d) - 1))
        counted = points.select(cell(lon, box[0], box[2], deeper).alias("ix"), cell(lat, box[1], box[3], deeper).alias("iy"))
        if depth:
            shift = deeper - depth
            wanted = points.sparkSession.createDataFrame([(x, y) for _, x, y in now], "px bigint, py bigint")
            counted = counted.join(F.broadcast(wanted), (F.shiftright("ix", shift) == F.col("px")) & (F.shiftright("iy", shift) == F.col("py")), "left_semi")
        found = {(c["ix"], c["iy"]): c["count"] for c in counted.groupBy("ix", "iy").count().collect()}
        # Between the two depths, neighbours that are small together stay one block.
        for d in range(depth + 1, deeper + 1):
            parts: dict[tuple[int, int], int] = {}
            for (x, y), n in found.items():
                k = (x >> (deeper - d), y >> (deeper - d))
                parts[k] = parts.get(k, 0) + n
            ok = {k for k, n in parts.items() if n <= block_points}
            for k in ok:
                leaves.append((d, *k, parts[k]))
            found = {(x, y): n for (x, y), n in found.items() if (x >> (deeper - d), y >> (deeper - d)) not in ok}
        full |= {(deeper, x, y): n for (x, y), n in found.items()}
    bits = widest
    at = np.array(leaves, np.int64)
    codes = morton(at[:, 1] << (bits - at[:, 0]), at[:, 2] << (bits - at[:, 0]), bits)
    order = np.argsort(codes, kind="stable")
    starts, counts = codes[order], at[order, 3]
    starts[0] = 0
    return Blocks(box, bits, starts, np.maximum(1, -(-counts // block_points)))


def near_places(points: DataFrame, key: str, lat: str, lon: str, radius_km: float, *, block_points: int = 40_000) -> tuple[DataFrame, DataFrame]:
    """Members and near pairs of places, a place being all points at the same position.

    The members are ``id``, ``lat``, ``lon``; the pairs ``a_id``, ``a_lat``, ``a_lon``, ``a_n``
    and the same of ``b``, with the smallest id at a place and the number of points there.
    Each pair of different places less than ``radius_km`` apart comes once, and a place with
    several points once with itself; pairs of points at one place need not be spelt out.

    Each place goes to its quadtree block and, if it lies within the radius of another
    block's border, to that block too as a guest; blocks then run their dual-tree joins as
    separate tasks. A block that has too many places and guests when it is as narrow as
    two radii is cut into parts by hash, and each pair of parts is a task, so no task holds
    more than about twice ``block_points`` places. Pairs leave the tasks in batches.
    """
    la, lo = F.col(lat).cast("double"), F.col(lon).cast("double")
    ok = F.col(key).isNotNull() & F.coalesce(la.between(-90, 90) & lo.between(-540, 540), F.lit(False))
    # One way to write each longitude, so that positions on both sides of the 180th meridian meet.
    around = F.when(lo >= 180, lo - 360 * F.ceil((lo - 179.999999999) / 360)).when(lo < -180, lo + 360).otherwise(lo)
    members = points.where(ok).select(F.col(key).cast("bigint").alias("id"), (la + F.lit(0.0)).alias("lat"), (around + F.lit(0.0)).alias("lon")).distinct()
    places = members.groupBy("lat", "lon").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).select("id", "lat", "lon", "n")
    blocks = plan_blocks(places, "lat", "lon", radius_km, block_points)
    chord = 2 * np.sin(radius_km / (2 * EARTH_RADIUS_KM))

    def leaves(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, block and whether it is a guest there."""
        own = blocks.leaf(y, x)
        dlat, dlon = _margins(y, radius_km)
        rows, leaf = [np.arange(len(y))], [own]
        for sy in (-1, 1):
            for sx in (-1, 1):
                other = blocks.leaf(y + sy * dlat, (x + sx * dlon + 180) % 360 - 180)
                k = np.flatnonzero(other != own)
                rows.append(k), leaf.append(other[k])
        rows, leaf = np.concatenate(rows), np.concatenate(leaf)
        once = np.unique(np.stack([rows, leaf], 1), axis=0)
        return once[:, 0], once[:, 1], once[:, 1] != own[once[:, 0]]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(blocks.starts), np.int64)
        for b in batches:
            n += np.bincount(leaves(*(b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)))[1], minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["leaf", "n"])

    for r in places.mapInArrow(weigh, "leaf bigint, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        blocks.splits[r["leaf"]] = max(1, -(-r["n"] // block_points))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, y, x, n = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            rows, leaf, guest = leaves(y, x)
            m = blocks.splits[leaf]
            spread = y[rows].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ x[rows].view(np.uint64)
            part = (spread * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(33)).astype(np.int64) % m
            repeat = np.repeat(np.arange(len(rows)), m)
            other = np.arange(len(repeat)) - np.repeat(np.cumsum(m) - m, m)
            rows, leaf, guest, part, m = (v[repeat] for v in (rows, leaf, guest, part, m))
            task = np.minimum(part, other) * m + np.maximum(part, other)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (leaf, task, part, guest, ids[rows], y[rows], x[rows], n[rows])], names=["leaf", "task", "part", "guest", "id", "lat", "lon", "n"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        part, guest, ids, y, x, n = (t.column(c).to_numpy() for c in ("part", "guest", "id", "lat", "lon", "n"))
        xyz = unit_vectors(y, x)
        # Pairs of two parts are made in their own task, pairs within a part in the part's own.
        same = part.min() == part.max()
        a, b = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(part == part.min()), np.flatnonzero(part == part.max()))
        ta = KdTree(xyz[a])
        for i, j in near_index_pairs(ta, ta if same else KdTree(xyz[b]), chord):
            i, j = a[i], b[j]
            swap = (y[i] > y[j]) | ((y[i] == y[j]) & (x[i] > x[j]))
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            # A pair is found in the block that owns its first place.
            i, j = i[~guest[i]], j[~guest[i]]
            yield _place_pairs([v[k] for k in (i, j) for v in (ids, y, x, n)])
        if same:
            k = np.flatnonzero((n > 1) & ~guest)
            yield _place_pairs([v[k] for _ in range(2) for v in (ids, y, x, n)])

    placed = places.mapInArrow(place, "leaf bigint, task bigint, part bigint, guest boolean, id bigint, lat double, lon double, n bigint")
    return members, placed.groupBy("leaf", "task").applyInArrow(join, ", ".join(f"{side}_{c}" for side in "ab" for c in ("id bigint", "lat double", "lon double", "n bigint")))


def _place_pairs(cols: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[f"{side}_{c}" for side in "ab" for c in ("id", "lat", "lon", "n")])


def near_pairs(points: DataFrame, key: str, lat: str, lon: str, radius_km: float, *, block_points: int = 40_000) -> DataFrame:
    """Pairs ``left_id < right_id`` of points less than ``radius_km`` apart, from the pairs of their places (see ``near_places``).

    Defined results: points without key or position (NULL, NaN, infinite, |lat| > 90) have
    no neighbours; points at the same place are neighbours; a key given twice counts once
    for each different position; an empty input gives no rows; other columns are ignored.
    Longitudes 360 degrees apart are the same.
    """
    members, pairs = near_places(points, key, lat, lon, radius_km, block_points=block_points)
    pairs = cut_lineage(pairs, "near")
    single = (F.col("a_n") == 1) & (F.col("b_n") == 1)
    sides = pairs.where(single).select(F.col("a_id").alias("i"), F.col("b_id").alias("j"))
    # Only places of several points are looked up among the members.
    crowd = pairs.where(~single)
    a = members.select(F.col("id").alias("i"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    b = members.select(F.col("id").alias("j"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    spelt = crowd.join(a, ["a_lat", "a_lon"]).join(b, ["b_lat", "b_lon"])
    one = (F.col("a_lat") == F.col("b_lat")) & (F.col("a_lon") == F.col("b_lon"))
    spelt = spelt.where(~one | (F.col("i") < F.col("j"))).select("i", "j")
    every = sides.unionByName(spelt).where(F.col("i") != F.col("j"))
    return every.select(F.least("i", "j").alias("left_id"), F.greatest("i", "j").alias("right_id"))


# ---------------------------------------------------------------- regions around points

_NONE = -1
#: Depth of the Morton codes by which points are sorted; no cell of a region tree lies deeper.
_MORTON_BITS = 26


class RegionTree:
    """Quadtree over region polygons, split until a cell has few edges.

    Each cell knows the regions around its lower left corner. A cell without edges belongs
    to one region or to none as a whole. In a cell with edges, a position is told from the
    corner by the edges that the way between them crosses: along the cell's left side, then
    along its latitude. Only the cell's own edges are looked at. Regions are rings in
    degrees; holes and several outer rings need no special care. Where regions overlap, the
    one with the smallest id wins.
    """

    def __init__(self, region_ids: list[int], edges: list[np.ndarray], depth: int = 20, leaf: int = 8):
        order = np.argsort(np.array(region_ids, np.int64), kind="stable") if region_ids else []
        self.ids = np.array([region_ids[k] for k in order], np.int64)
        held = [np.asarray(edges[k], float).reshape(-1, 4) for k in order]
        self.edges = np.concatenate(held) if held else np.zeros((0, 4))
        self.owner = np.repeat(np.arange(len(held)), [len(e) for e in held]).astype(np.int64)
        self.box = (0.0, 0.0, 1.0, 1.0)
        if len(self.edges):
            xs, ys = self.edges[:, [0, 2]], self.edges[:, [1, 3]]
            pad = 1e-9 + 1e-6 * max(np.ptp(xs), np.ptp(ys))
            self.box = (xs.min() - pad, ys.min() - pad, xs.max() + pad, ys.max() + pad)
        # Per node: depth, cell, first of four children (-1 for a leaf), region of the whole cell, ranges of edges and of regions at the corner.
        self.level, self.ix, self.iy, self.child, self.whole = [], [], [], [], []
        self.edge_at, self.edge_of, self.corner_at, self.corner_of = [0], [], [0], []
        self._grow(depth, leaf)

    def bounds(self, d, ix, iy) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x0, y0, x1, y1 = self.box
        w, h = (x1 - x0) / 2.0**d, (y1 - y0) / 2.0**d
        return x0 + ix * w, y0 + iy * h, x0 + (ix + 1) * w, y0 + (iy + 1) * h

    def _grow(self, depth: int, leaf: int) -> None:
        regions = max(1, len(self.ids))
        ix = iy = np.zeros(1, np.int64)
        # Pairs of a cell of the level and an edge that touches it, and of a cell and a region around its corner.
        cell, edge = np.zeros(len(self.edges), np.int64), np.arange(len(self.edges))
        in_cell = in_region = np.zeros(0, np.int64)
        held, room = 0, 8 * len(self.edges) + 10_000
        made, out = 0, {k: [] for k in ("level", "ix", "iy", "child", "whole", "edges", "edge_of", "corners", "corner_of")}
        d = 0
        while len(ix):
            n = len(ix)
            count = np.bincount(cell, minlength=n)
            # Where splitting only multiplies the edges, as with many long ones side by side, it ends.
            held += len(cell)
            split = (count > leaf) & (d < depth) & (held <= room)
            held -= int(count[split].sum())
            whole = np.full(n, regions)
            np.minimum.at(whole, in_cell, in_region)
            rank = np.cumsum(split) - 1
            out["level"].append(np.full(n, d)), out["ix"].append(ix), out["iy"].append(iy)
            out["child"].append(np.where(split, made + n + 4 * rank, -1))
            out["whole"].append(np.where((count == 0) & (whole < regions), whole, _NONE))
            kept, inside = ~split[cell], ~split[in_cell] & (count[in_cell] > 0)
            order = np.argsort(cell[kept], kind="stable")
            out["edges"].append(np.where(split, 0, count)), out["edge_of"].append(edge[kept][order])
            order = np.argsort(in_cell[inside], kind="stable")
            out["corners"].append(np.bincount(in_cell[inside], minlength=n)), out["corner_of"].append(in_region[inside][order])
            made += n
            # The four children of each cell that is split.
            cell, edge = rank[cell[~kept]], edge[~kept]
            go = split[in_cell]
            in_cell, in_region = rank[in_cell[go]], in_region[go]
            x0, y0, _, _ = self.bounds(d, ix[split], iy[split])
            child = np.arange(4)
            cx = (2 * ix[split][:, None] + (child & 1)).ravel()
            cy = (2 * iy[split][:, None] + (child >> 1)).ravel()
            d += 1
            bx0, by0, bx1, by1 = self.bounds(d, cx, cy)
            kid, of = (4 * cell[:, None] + child).ravel(), np.repeat(edge, 4)
            e = self.edges[of]
            odd = _crosses(e, np.repeat(x0, 4)[kid], np.repeat(y0, 4)[kid], bx0[kid], by0[kid])
            key = np.concatenate([(4 * in_cell[:, None] + child).ravel() * regions + np.repeat(in_region, 4), kid[odd] * regions + self.owner[of[odd]]])
            key = _odd(key)
            in_cell, in_region = key // regions, key % regions
            touch = _edges_touch(e, bx0[kid], by0[kid], bx1[kid], by1[kid])
            cell, edge, ix, iy = kid[touch], of[touch], cx, cy
        join = {k: np.concatenate(v) for k, v in out.items()}
        self.level, self.ix, self.iy, self.child, self.whole = (join[k] for k in ("level", "ix", "iy", "child", "whole"))
        self.edge_at, self.edge_of = np.r_[0, np.cumsum(join["edges"])], join["edge_of"]
        self.corner_at, self.corner_of = np.r_[0, np.cumsum(join["corners"])], join["corner_of"]

    def locate(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """Index into ``ids`` for each position, -1 for none, by walking a tree over the positions and this one together."""
        out = np.full(len(lat), _NONE, np.int64)
        for at, k in self.around(lat, lon, first=True):
            out[at] = k
        return out

    def around(self, lat: np.ndarray, lon: np.ndarray, *, first: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions and regions (as indices) around them; with ``first`` only the region with the smallest id."""
        x0, y0, x1, y1 = self.box
        with np.errstate(invalid="ignore"):
            within = np.flatnonzero((lon >= x0) & (lon < x1) & (lat >= y0) & (lat < y1))
        if not len(within) or not len(self.edges):
            return
        # The tree over the positions: ranges in the order of Morton codes, cells as in this tree.
        n = 1 << _MORTON_BITS
        x, y = lon[within], lat[within]
        code = morton(np.minimum(((x - x0) / (x1 - x0) * n).astype(np.int64), n - 1), np.minimum(((y - y0) / (y1 - y0) * n).astype(np.int64), n - 1), _MORTON_BITS)
        order = np.argsort(code, kind="stable")
        code, x, y, at = code[order], x[order], y[order], within[order]
        node, start, stop, low = np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([len(at)]), np.zeros(1, np.int64)
        unsure: list[tuple[np.ndarray, ...]] = []
        while len(node):
            sure = (self.child[node] < 0) & (self.edge_at[node + 1] == self.edge_at[node])
            k = np.flatnonzero(sure & (self.whole[node] >= 0))
            # Certain pairs of nodes: all positions of the range are in the region.
            yield at[_ranges(start[k], stop[k] - start[k])], np.repeat(self.whole[node[k]], stop[k] - start[k])
            k = np.flatnonzero((self.child[node] < 0) & ~sure)
            if len(k):
                unsure.append((node[k], start[k], stop[k], self.level[node[k]], low[k]))
            k = np.flatnonzero(self.child[node] >= 0)
            start, stop, low, _ = _quarters(code, start[k], stop[k], low[k], self.level[node[k]])
            node = (self.child[node[k]][:, None] + np.arange(4)).ravel()
            some = stop > start
            node, start, stop, low = node[some], start[some], stop[some], low[some]
        if not unsure:
            return
        node, start, stop, level, low = (np.concatenate(v) for v in zip(*unsure))
        xs, ys = np.append(x, 0.0), np.append(y, 0.0)
        while len(node):
            pairs = np.stack([start, stop], 1).ravel()
            box = [f.reduceat(v, pairs)[::2] for f, v in ((np.minimum, xs), (np.minimum, ys), (np.maximum, xs), (np.maximum, ys))]
            many = self.edge_at[node + 1] - self.edge_at[node]
            of, e = np.repeat(np.arange(len(node)), many), self.edges[self.edge_of[_ranges(self.edge_at[node], many)]]
            busy = np.bincount(of[_edges_touch(e, *(v[of] for v in box))], minlength=len(node)) > 0
            # No edge near the range: what holds for one of its positions holds for all.
            free = np.flatnonzero(~busy)
            for k, r in self._by_edges(node[free], x[start[free]], y[start[free]], first):
                own = free[k]
                size = stop[own] - start[own]
                yield at[_ranges(start[own], size)], np.repeat(r, size)
            last = np.flatnonzero(busy & ((stop - start <= 16) | (level >= _MORTON_BITS)))
            size = stop[last] - start[last]
            each, cell = _ranges(start[last], size), np.repeat(node[last], size)
            for k, r in self._by_edges(cell, x[each], y[each], first):
                yield at[each[k]], r
            more = np.flatnonzero(busy & (stop - start > 16) & (level < _MORTON_BITS))
            node = np.repeat(node[more], 4)
            start, stop, low, level = _quarters(code, start[more], stop[more], low[more], level[more])
            some = stop > start
            node, start, stop, level, low = node[some], start[some], stop[some], level[some], low[some]

    def _by_edges(self, node: np.ndarray, x: np.ndarray, y: np.ndarray, first: bool, step: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indices of the positions that are in a region and the regions, each position being in a leaf with edges."""
        regions = max(1, len(self.ids))
        for s in range(0, len(node), step):
            own, px, py = node[s : s + step], x[s : s + step], y[s : s + step]
            many = self.edge_at[own + 1] - self.edge_at[own]
            of, e = np.repeat(np.arange(len(own)), many), self.edge_of[_ranges(self.edge_at[own], many)]
            cx, cy, _, _ = self.bounds(self.level[own], self.ix[own], self.iy[own])
            odd = _crosses(self.edges[e], cx[of], cy[of], px[of], py[of])
            known = self.corner_at[own + 1] - self.corner_at[own]
            base = np.repeat(np.arange(len(own)), known) * regions + self.corner_of[_ranges(self.corner_at[own], known)]
            key = _odd(np.concatenate([base, of[odd] * regions + self.owner[e[odd]]]))
            k, r = key // regions, key % regions
            if first and len(k):
                keep = np.r_[True, k[1:] != k[:-1]]
                k, r = k[keep], r[keep]
            yield k + s, r


def _quarters(code: np.ndarray, start: np.ndarray, stop: np.ndarray, low: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of sorted Morton codes, cut by their next two bits: start, stop, lowest code and level of four parts each."""
    width = np.int64(1) << (2 * (_MORTON_BITS - level - 1))
    lows = low[:, None] + width[:, None] * np.arange(5)
    # The whole array is sorted, so that places in it are places in the range.
    cuts = np.searchsorted(code, lows)
    cuts = np.clip(cuts, start[:, None], stop[:, None])
    return cuts[:, :4].ravel(), cuts[:, 1:].ravel(), lows[:, :4].ravel(), np.repeat(level + 1, 4)


def _odd(keys: np.ndarray) -> np.ndarray:
    """Keys that occur an odd number of times, sorted."""
    uniq, n = np.unique(keys, return_counts=True)
    return uniq[n % 2 == 1]


def _crosses(e: np.ndarray, cx: np.ndarray, cy: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Whether the way from (cx, cy) straight up or down to py, then along it to px, crosses each edge an odd number of times."""
    with np.errstate(divide="ignore", invalid="ignore"):
        up = (e[:, 0] > cx) != (e[:, 2] > cx)
        at = e[:, 1] + (cx - e[:, 0]) * (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
        up &= (at > cy) != (at > py)
        along = (e[:, 1] > py) != (e[:, 3] > py)
        at = e[:, 0] + (py - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
        along &= (at > cx) != (at > px)
    return up ^ along


def _edges_touch(e: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Edges (each with its cell) whose bounding box meets the cell and whose line does not leave all corners on one side."""
    pad = 1e-9
    x0, y0, x1, y1 = x0 - pad, y0 - pad, x1 + pad, y1 + pad
    meets = (np.minimum(e[:, 0], e[:, 2]) <= x1) & (np.maximum(e[:, 0], e[:, 2]) >= x0) & (np.minimum(e[:, 1], e[:, 3]) <= y1) & (np.maximum(e[:, 1], e[:, 3]) >= y0)
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    side = np.stack([dx * (cy - e[:, 1]) - dy * (cx - e[:, 0]) for cx in (x0, x1) for cy in (y0, y1)])
    return meets & (side.min(0) <= 0) & (side.max(0) >= 0)


def _inside(e: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lat), bool)
    step = max(1, 4_000_000 // max(1, len(e)))
    with np.errstate(divide="ignore", invalid="ignore"):
        for s in range(0, len(lat), step):
            y, x = lat[s : s + step, None], lon[s : s + step, None]
            spans = (e[:, 1] > y) != (e[:, 3] > y)
            at = e[:, 0] + (y - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
            out[s : s + step] = (spans & (x < at)).sum(1) % 2 == 1
    return out


def ring_edges(lons: list[float], lats: list[float]) -> np.ndarray:
    x, y = np.asarray(lons, float), np.asarray(lats, float)
    if len(x) and (x[0] != x[-1] or y[0] != y[-1]):
        x, y = np.append(x, x[0]), np.append(y, y[0])
    return np.stack([x[:-1], y[:-1], x[1:], y[1:]], 1) if len(x) > 1 else np.zeros((0, 4))


def ring_blocks(rings: DataFrame, block_vertices: int = BLOCK_VERTICES) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Region ids and edges of the rings, at most ``block_vertices`` vertices (or one ring) at a time, in order of region and ring.

    The driver holds one block; the rings come to it one partition after the other.
    """
    ids: list[int] = []
    edges: list[np.ndarray] = []
    room = block_vertices
    for r in rings.where(F.size("ring_lons") > 0).select("region_id", "ring_lons", "ring_lats").orderBy("region_id").toLocalIterator():
        own = ring_edges(r["ring_lons"], r["ring_lats"])
        if ids and len(own) > room:
            yield ids, edges
            ids, edges, room = [], [], block_vertices
        ids.append(r["region_id"]), edges.append(own)
        room -= len(own)
    if ids:
        yield ids, edges


def _joined(ids: list[int], edges: list[np.ndarray]) -> tuple[list[int], list[np.ndarray]]:
    own: dict[int, list[np.ndarray]] = {}
    for k, e in zip(ids, edges):
        own.setdefault(k, []).append(e)
    return list(own), [np.concatenate(e) for e in own.values()]


class RegionIndex:
    """Trees over all regions, one broadcast for each block of rings.

    Since a position is in a region if an odd number of the region's rings are around it,
    a region may have its rings in several blocks.
    """

    def __init__(self, rings: DataFrame, block_vertices: int = BLOCK_VERTICES):
        context = rings.sparkSession.sparkContext
        self.trees, self.regions, last = [], 0, None
        self.shared = False
        for ids, edges in ring_blocks(rings, block_vertices):
            self.shared |= ids[0] == last
            self.regions += len(set(ids) - {last})
            last = ids[-1]
            self.trees.append(context.broadcast(RegionTree(*_joined(ids, edges))))


def locate_regions(points: DataFrame, lat: str, lon: str, rings: DataFrame | RegionIndex, *, into: str = "region_id") -> DataFrame:
    """The points with the id of the region around each, NULL for none.

    The points are not shuffled: each task makes a tree over every batch of its different
    positions and walks it against the region trees. If there are several blocks of
    regions, the points pass them one after the other.

    Defined results: positions that are NULL, NaN or infinite are in no region; an empty
    set of regions gives NULL everywhere; a column already named like ``into`` is replaced.
    """
    base = points.drop(into)
    index = rings if isinstance(rings, RegionIndex) else RegionIndex(rings)
    found = base.withColumn(into, F.array().cast("array<bigint>"))
    place = found.schema.fieldNames().index(into)
    for shared in index.trees:

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tree = shared.value
            for b in batches:
                y, x = (np.nan_to_num(b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False), nan=np.inf, posinf=np.inf, neginf=np.inf) for c in (lat, lon))
                uniq, back = np.unique(np.stack([y, x], 1).view(np.complex128).ravel(), return_inverse=True)
                hits = list(tree.around(uniq.real.copy(), uniq.imag.copy()))
                at, k = (np.concatenate(v) for v in zip(*hits)) if hits else (np.zeros(0, np.int64),) * 2
                order = np.argsort(at, kind="stable")
                at, ids = at[order], tree.ids[k[order]]
                start = np.searchsorted(at, np.arange(len(uniq) + 1))
                size = np.diff(start)[back]
                new = ids[_ranges(start[back], size)]
                old = b.column(place)
                if len(old.flatten()):
                    held = np.diff(old.offsets.to_numpy())
                    row = np.r_[np.repeat(np.arange(len(held)), held), np.repeat(np.arange(len(size)), size)]
                    order = np.argsort(row, kind="stable")
                    new, size = np.r_[old.flatten().to_numpy(), new][order], size + held
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(new, pa.int64()))
                yield pa.RecordBatch.from_arrays([lists if k == place else b.column(k) for k in range(b.num_columns)], names=b.schema.names)

        found = found.mapInArrow(look, found.schema)
    around = F.col(into)
    if index.shared:
        around = F.filter(around, lambda r: F.size(F.filter(F.col(into), lambda q: q == r)) % 2 == 1)
    return found.withColumn(into, F.array_min(around))


# ---------------------------------------------------------------- distance to a boundary


class EdgeTree:
    """k-d tree over edges with bounding boxes, for distances to the nearest of them."""

    def __init__(self, edges: np.ndarray, leaf: int = 16):
        self.edges = np.asarray(edges, float).reshape(-1, 4)
        self.tree = KdTree((self.edges[:, :2] + self.edges[:, 2:]) / 2, leaf)
        if len(self.edges):
            self.edges = self.edges[self.tree.order]
            pairs = np.stack([self.tree.start, self.tree.stop], 1).ravel()
            xy = np.append(self.edges, self.edges[:1], axis=0)
            low, high = np.minimum(xy[:, :2], xy[:, 2:]), np.maximum(xy[:, :2], xy[:, 2:])
            self.low, self.high = np.minimum.reduceat(low, pairs)[::2], np.maximum.reduceat(high, pairs)[::2]

    def distance_km(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """To the nearest point of any edge; NaN without edges.

        A tree over the positions is walked against this one: a node of edges is discarded
        for a node of positions if it is certainly farther than another one.
        """
        if not len(self.edges) or not len(lat):
            return np.full(len(lat), np.nan)
        own, edge = KdTree(np.stack([lon, lat], 1)), self.tree
        start, size = np.array(own.start), np.array(own.stop) - np.array(own.start)
        e_start, e_size = np.array(edge.start), np.array(edge.stop) - np.array(edge.start)
        (la, ra), (lb, rb) = ((np.array(t.left), np.array(t.right)) for t in (own, edge))
        best, most = np.full(len(lat), np.inf), np.full(len(start), np.inf)
        p = q = np.zeros(1, np.int64)
        ends: list[np.ndarray] = []
        while len(p):
            least, upper = self._bounds(own, p, q)
            np.minimum.at(most, p, upper)
            keep = least <= most[p]
            leaves = (la[p] < 0) & (lb[q] < 0)
            ends.append(np.stack([p[keep & leaves], q[keep & leaves]], 1))
            p, q = p[keep & ~leaves], q[keep & ~leaves]
            first = (lb[q] < 0) | ((la[p] >= 0) & (size[p] >= e_size[q]))
            for side in (la, ra):
                np.minimum.at(most, side[p[first]], most[p[first]])
            p, q = np.concatenate([la[p[first]], ra[p[first]], p[~first], p[~first]]), np.concatenate([q[first], q[first], lb[q[~first]], rb[q[~first]]])
        ends = np.concatenate(ends)
        p, q = ends[:, 0], ends[:, 1]
        least, _ = self._bounds(own, p, q)
        order = np.lexsort((least, p))
        p, q, least = p[order], q[order], least[order]
        nearest = np.r_[True, p[1:] != p[:-1]]
        # First the nearest node of edges of each leaf; of the others only those that may still be nearer.
        for part in (np.flatnonzero(nearest), np.flatnonzero(~nearest)):
            if len(part) and not nearest[part[0]]:
                far = np.zeros(len(start))
                leaf = np.unique(p)
                far[leaf] = [best[own.order[own.start[k] : own.stop[k]]].max() for k in leaf]
                part = part[least[part] <= far[p[part]]]
            for s in range(0, len(part), 500):
                k = part[s : s + 500]
                row = _ranges(start[p[k]], size[p[k]])
                many = np.repeat(e_size[q[k]], size[p[k]])
                e = self.edges[_ranges(np.repeat(e_start[q[k]], size[p[k]]), many)]
                at = np.repeat(own.order[row], many)
                np.minimum.at(best, at, _to_edges(e, lat[at], lon[at]))
        return best

    def _bounds(self, own: KdTree, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance that a position of each node may have to the edges of a node."""
        low, high, e_low, e_high = own.low[p], own.high[p], self.low[q], self.high[q]
        gap = np.maximum(0, np.maximum(e_low - high, low - e_high))
        far = np.maximum(e_high - low, high - e_low)
        widest = np.minimum(89.9, np.abs(np.stack([low[:, 1], high[:, 1], e_low[:, 1], e_high[:, 1]])).max(0))
        km = np.radians(1) * EARTH_RADIUS_KM
        return 0.9 * km * np.maximum(gap[:, 1], gap[:, 0] * np.cos(np.radians(widest))), km * (far[:, 0] + far[:, 1])


def _to_edges(e: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Distance in km of each position to the nearest point of its edge."""
    x0, y0, x1, y1 = e.T
    c = np.cos(np.radians((lat + (y0 + y1) / 2) / 2))
    ax, ay, bx, by = (x0 - lon) * c, y0 - lat, (x1 - lon) * c, y1 - lat
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = np.clip(np.where(length > 0, -(ax * dx + ay * dy) / np.where(length > 0, length, 1), 0), 0, 1)
    return haversine_np(lat, lon, y0 + t * (y1 - y0), x0 + t * (x1 - x0))


def boundary_distance(points: DataFrame, lat: str, lon: str, boundary: DataFrame | np.ndarray, *, into: str = "boundary_km", block_vertices: int = BLOCK_VERTICES) -> DataFrame:
    """The points with the distance in km to the nearest edge of a boundary: rings, or rows of lon, lat, lon, lat.

    Inside and outside count alike. The edges go to the executors in blocks of at most
    ``block_vertices``; if there are several, the points pass them one after the other and
    keep the smallest distance. Defined results: NULL for a position that is NULL, NaN or
    infinite, and for every row if there are no edges.
    """
    base = points.drop(into)
    schema = T.StructType([*base.schema.fields, T.StructField(into, T.DoubleType())])
    if isinstance(boundary, DataFrame):
        blocks = (np.concatenate(e) for _, e in ring_blocks(boundary, block_vertices))
    else:
        rows = np.asarray(boundary, float).reshape(-1, 4)
        blocks = (rows[k : k + block_vertices] for k in range(0, len(rows), block_vertices))
    out = base.withColumn(into, F.lit(None).cast("double"))
    for edges in blocks:
        shared = points.sparkSession.sparkContext.broadcast(EdgeTree(edges))

        def measure(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                y, x, known = (b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (lat, lon, into))
                ok = np.isfinite(y) & np.isfinite(x)
                km = np.full(len(y), np.nan)
                km[ok] = shared.value.distance_km(y[ok], x[ok])
                km = np.fmin(km, known)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(km, mask=np.isnan(km))], names=b.schema.names)

        out = out.mapInArrow(measure, schema)
    return out
