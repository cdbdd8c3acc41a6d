"""Clusters and principal modes of station feature tables."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakeweave.functions.labels import finite
from quakeweave.runtime import cut_lineage


def prepare_features(df: DataFrame, key: str, features: list[str], *, least_present: int = 1) -> tuple[DataFrame, list[str]]:
    """``key`` and ``features``: standardised (population deviation) with means in place of NULL, constant columns left out.

    Means and deviations are one row; they come to the driver as constants.
    """
    values = {f: finite(f"`{f}`") for f in features}
    stats = df.agg(*[F.avg(v).alias(f"m{k}") for k, v in enumerate(values.values())], *[F.min(v).alias(f"a{k}") for k, v in enumerate(values.values())], *[F.max(v).alias(f"b{k}") for k, v in enumerate(values.values())]).first()
    kept = [(k, f) for k, f in enumerate(features) if stats[f"a{k}"] is not None and stats[f"b{k}"] > stats[f"a{k}"]]
    if not kept:
        raise ValueError("no feature varies")
    there = sum((values[f].isNotNull().cast("int") for _, f in kept), F.lit(0))
    filled = df.where(there >= least_present).select(key, *[F.coalesce(values[f], F.lit(stats[f"m{k}"])).alias(f"f{k}") for k, f in kept])
    sd = filled.agg(*[F.avg(f"f{k}").alias(f"m{k}") for k, _ in kept], *[F.stddev_pop(f"f{k}").alias(f"s{k}") for k, _ in kept]).first()
    z = [(F.col(f"f{k}") - sd[f"m{k}"]) / (sd[f"s{k}"] or 1.0) for k, _ in kept]
    return filled.select(key, F.array(*z).alias("features")), [f for _, f in kept]


def silhouette(points: DataFrame, *, tile: int = 2_000) -> float | None:
    """Mean Euclidean silhouette of ``features`` and ``cluster``; NULL for fewer than two clusters.

    All pairs of a station table (thousands of rows), compared tile by tile across tasks:
    no task holds more than two tiles.
    """
    n = points.count()
    sizes = {r["cluster"]: r["count"] for r in points.groupBy("cluster").count().collect()}
    if len(sizes) < 2:
        return None
    tiles = max(1, -(-n // tile))
    base = points.select(F.monotonically_increasing_id().alias("i"), "features", "cluster")
    base = cut_lineage(base.withColumn("t", F.pmod(F.xxhash64("i"), F.lit(tiles)).cast("int")), "tiles")
    each = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    a = base.withColumn("u", each).withColumn("own", F.lit(True))
    b = base.withColumn("u", F.col("t")).withColumn("own", F.lit(False)).withColumn("t", each)
    schema = "i bigint, cluster int, other int, total double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf.own], pdf[~pdf.own]
        if not len(x) or not len(y):
            return pd.DataFrame(columns=["i", "cluster", "other", "total"])
        p, q = np.stack(x.features), np.stack(y.features)
        d = np.sqrt(np.maximum(0, (p**2).sum(1)[:, None] + (q**2).sum(1)[None] - 2 * p @ q.T))
        labels = y.cluster.to_numpy()
        out = [pd.DataFrame({"i": x.i, "cluster": x.cluster, "other": c, "total": d[:, labels == c].sum(1)}) for c in np.unique(labels)]
        return pd.concat(out)

    sums = a.unionByName(b).groupBy("t", "u").applyInPandas(run, schema).groupBy("i", "cluster", "other").agg(F.sum("total").alias("total"))
    size = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    own = F.col("cluster") == F.col("other")
    mean = F.when(own, F.col("total") / F.greatest(size[F.col("other")] - 1, F.lit(1))).otherwise(F.col("total") / size[F.col("other")])
    s = sums.groupBy("i", "cluster").agg(F.max(F.when(own, mean)).alias("a"), F.min(F.when(~own, mean)).alias("b"))
    s = s.select(F.when(size[F.col("cluster")] > 1, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(F.lit(0.0)).alias("s"))
    return s.agg(F.avg("s")).first()[0]


def seed_centres(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: each further centre is drawn in proportion to the squared distance from those before."""
    rng = np.random.default_rng(seed)
    at = [int(rng.integers(len(x)))]
    d = ((x - x[at[0]]) ** 2).sum(1)
    for _ in range(k - 1):
        total = d.sum()
        at.append(int(rng.choice(len(x), p=d / total)) if total > 0 else int(rng.integers(len(x))))
        d = np.minimum(d, ((x - x[at[-1]]) ** 2).sum(1))
    return x[at]


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = _squared(x, centres)
    label = d.argmin(1)
    return label, d[np.arange(len(x)), label]


def lloyd(points: DataFrame, starts: dict[tuple[int, int], np.ndarray], *, max_iter: int = 300, tol: float = 1e-8) -> dict[tuple[int, int], tuple[float, np.ndarray]]:
    """Cost and centres of each start after k-means over all ``features``; every pass over the points moves all starts.

    A start is done when no centre moves farther than ``tol``. A centre without points stays where it is.
    """
    done: dict[tuple[int, int], tuple[float, np.ndarray]] = {}
    moving = dict(starts)
    schema = "k int, start int, cluster int, n bigint, cost double, total array<double>"
    for step in range(max_iter + 1):
        if not moving:
            break
        now = dict(moving)

        def run(parts, now=now):
            x = [np.stack(pdf.features) for pdf in parts if len(pdf)]
            if not x:
                return
            x, rows = np.concatenate(x), []
            for (k, start), centres in now.items():
                label, d = _nearest(x, centres)
                n, cost = np.bincount(label, minlength=k), np.bincount(label, d, k)
                total = np.stack([np.bincount(label, c, k) for c in x.T], 1)
                rows += [(k, start, c, int(n[c]), float(cost[c]), total[c].tolist()) for c in range(k) if n[c]]
            yield pd.DataFrame(rows, columns=["k", "start", "cluster", "n", "cost", "total"])

        sums: dict[tuple[int, int], list] = {key: [np.zeros(key[0]), 0.0, np.zeros_like(c)] for key, c in now.items()}
        for r in sorted(points.select("features").mapInPandas(run, schema).collect()):
            s = sums[r["k"], r["start"]]
            s[0][r["cluster"]] += r["n"]
            s[1] += r["cost"]
            s[2][r["cluster"]] += r["total"]
        for key, (n, cost, total) in sums.items():
            fresh = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], now[key])
            if step == max_iter or ((fresh - now[key]) ** 2).sum(1).max() <= tol**2:
                done[key] = (cost, moving.pop(key))
            else:
                moving[key] = fresh
    return done


def kmeans_clusters(df: DataFrame, key: str, features: list[str], *, k_range: tuple[int, int] = (2, 6), seed: int = 42, starts: int = 20, position: tuple[str, str] | None = ("lat", "lon"), sample: int = 5_000) -> tuple[DataFrame, list[dict]]:
    """Best k-means by silhouette (the smaller k on a tie): assignments and a summary of every k.

    For each k the lowest cost of ``starts`` seeded starts counts. First centres are drawn from
    ``sample`` points picked by hash (all of a smaller table); the clusters are made from all points.
    Clusters are numbered by the mean position of their members.
    """
    points, used = prepare_features(df, key, features)
    points = cut_lineage(points, "features")
    n, summary, best = points.count(), [], None
    wanted = range(k_range[0], min(k_range[1], n - 1) + 1)
    if not wanted:
        return points.select(key, F.lit(0).alias("cluster")), summary
    drawn = points.orderBy(F.xxhash64(F.lit(seed), key), key).limit(sample).collect()
    x = np.array([r["features"] for r in drawn], float)
    found = lloyd(points, {(k, i): seed_centres(x, k, (seed + 17 * k) * 1_000 + i) for k in wanted for i in range(starts)})
    least = {k: min((found[k, i] for i in range(starts)), key=lambda f: f[0]) for k in wanted}
    schema = T.StructType([*points.schema.fields, *[T.StructField(f"k{k}", T.IntegerType()) for k in wanted]])

    def place(parts):
        for pdf in parts:
            if len(pdf):
                x = np.stack(pdf.features)
                yield pdf.assign(**{f"k{k}": _nearest(x, c)[0].astype("int32") for k, (_, c) in least.items()})

    placed = cut_lineage(points.mapInPandas(place, schema), "placed")
    for k, (cost, _) in least.items():
        at_k = placed.select(key, "features", F.col(f"k{k}").alias("cluster"))
        s = silhouette(at_k)
        summary.append({"n_clusters": k, "silhouette": s, "inertia": cost, "n_samples": n, "n_features": len(used)})
        if s is not None and (best is None or s > best[0] + 1e-12):
            best = (s, at_k)
    if best is None:
        return points.select(key, F.lit(0).alias("cluster")), summary
    out = best[1].select(key, "cluster")
    if position:
        c = out.join(df.select(key, *position), key).groupBy("cluster").agg(F.avg(position[0]).alias("a"), F.avg(position[1]).alias("b"))
        number = c.withColumn("n", (F.row_number().over(Window.orderBy("a", "b", "cluster")) - 1).cast("int")).select("cluster", "n")
        out = out.join(F.broadcast(number), "cluster").select(key, F.col("n").alias("cluster"))
    return out, summary


def cluster_summary(assigned: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """Size, and mean and greatest distance to the centre, per cluster."""
    p = assigned.join(points, key).select(key, "cluster", F.posexplode("features").alias("f", "x"))
    centre = p.groupBy("cluster", "f").agg(F.avg("x").alias("c"))
    d = p.join(F.broadcast(centre), ["cluster", "f"]).groupBy("cluster", key).agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("c"), F.lit(2)))).alias("d"))
    return d.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.avg("d").alias("mean_distance"), F.max("d").alias("max_distance"))


def principal_modes(df: DataFrame, key: str, features: list[str], *, modes: int = 2) -> tuple[DataFrame, DataFrame]:
    """Scores per row and loadings per mode and feature, with the share of variance.

    The covariance, one row of features squared, is summed up across the cluster and solved
    on the driver. The largest loading of each mode is positive.
    """
    points, used = prepare_features(df, key, features)
    points = cut_lineage(points, "features")
    m = len(used)
    f = F.col("features")
    cross = points.agg(*[F.avg(f[i] * f[j]).alias(f"c{i}_{j}") for i in range(m) for j in range(i, m)]).first()
    cov = np.array([[cross[f"c{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)])
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(-value)
    value, vector = np.maximum(value[order], 0), vector[:, order]
    vector = vector * np.sign(vector[np.abs(vector).argmax(0), np.arange(m)])
    modes = min(modes, m)
    scores = [sum((f[i] * float(vector[i, k]) for i in range(m)), F.lit(0.0)).alias(f"PC{k + 1}") for k in range(modes)]
    share = value / value.sum()
    rows = [(f"PC{k + 1}", used[i], float(vector[i, k]), float(share[k]), float(share[: k + 1].sum())) for k in range(modes) for i in range(m)]
    loadings = df.sparkSession.createDataFrame(rows, "mode string, feature string, loading double, variance_ratio double, cumulative_ratio double")
    return points.select(key, *scores), loadings


# ---------------------------------------------------------------- regions of neighbouring stations


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = np.zeros((len(x), len(y)))
    for a, b in zip(x.T, y.T):
        d += (a[:, None] - b[None]) ** 2
    return d


def _blocks(n: int, cells: int = 2_000_000) -> list[slice]:
    """Slices of rows whose distances to all n points are about ``cells`` numbers."""
    step = max(1, cells // max(n, 1))
    return [slice(i, min(i + step, n)) for i in range(0, n, step)]


def neighbour_graph(xy: np.ndarray, k: int) -> dict[int, set[int]]:
    """Symmetric k-nearest graph whose parts are joined at their nearest points until it is connected.

    Distances are made for a block of points at a time, so memory grows with n, not its square.
    """
    n = len(xy)
    k = min(k, n - 1)
    graph: dict[int, set[int]] = {i: set() for i in range(n)}
    if k < 1:
        return graph
    for rows in _blocks(n):
        d = _squared(xy[rows], xy)
        d[np.arange(len(d)), np.arange(rows.start, rows.stop)] = np.inf
        at, near = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
        order = np.lexsort((near, d[at, near], at))
        at, near = at[order], near[order]
        first = np.arange(len(at)) - np.searchsorted(at, at) < k
        for i, j in zip((at[first] + rows.start).tolist(), near[first].tolist()):
            graph[i].add(j)
            graph[j].add(i)
    _connect(xy, graph)
    return graph


def _connect(xy: np.ndarray, graph: dict[int, set[int]]) -> None:
    """Add the edges of the shortest tree over the parts of the graph, one point's distances at a time."""
    parts = components(graph)
    part = np.empty(len(xy), int)
    for p, members in enumerate(parts):
        part[list(members)] = p
    best, source = np.full(len(xy), np.inf), np.zeros(len(xy), int)
    fresh = 0
    for _ in range(len(parts) - 1):
        best[part == fresh] = np.inf
        outside = np.flatnonzero(part >= 0)
        outside = outside[part[outside] != fresh]
        for i in sorted(parts[fresh]):
            d = ((xy[outside] - xy[i]) ** 2).sum(1)
            closer = d < best[outside]
            best[outside[closer]], source[outside[closer]] = d[closer], i
        part[part == fresh] = -1
        j = int(best.argmin())
        graph[int(source[j])].add(j)
        graph[j].add(int(source[j]))
        fresh = part[j]


def components(graph: dict[int, set[int]]) -> list[set[int]]:
    seen: set[int] = set()
    out = []
    for start in graph:
        if start in seen:
            continue
        part, stack = {start}, [start]
        while stack:
            for j in graph[stack.pop()] - part:
                part.add(j)
                stack.append(j)
        seen |= part
        out.append(part)
    return out


def merge_cost(n: int, a: np.ndarray, m: int, b: np.ndarray) -> float:
    """Growth of the sum of squares when two regions become one."""
    return float(n * m / (n + m) * ((a - b) ** 2).sum())


def contiguous_regions(features: np.ndarray, graph: dict[int, set[int]], counts: set[int]) -> dict[int, np.ndarray]:
    """Labels for each wanted number of regions, merging neighbours at the least cost."""
    n = len(features)
    size, centre = {i: 1 for i in range(n)}, {i: features[i].copy() for i in range(n)}
    members, near = {i: [i] for i in range(n)}, {i: set(g) for i, g in graph.items()}
    heap = [(merge_cost(1, features[i], 1, features[j]), i, j) for i in graph for j in graph[i] if i < j]
    heapq.heapify(heap)
    out, fresh = {}, n

    def snapshot() -> None:
        if len(members) in counts:
            labels = np.empty(n, int)
            for k, r in enumerate(sorted(members, key=lambda r: min(members[r]))):
                labels[members[r]] = k
            out[len(members)] = labels

    snapshot()
    while heap and len(members) > min(counts, default=1):
        _, i, j = heapq.heappop(heap)
        if i not in members or j not in members:
            continue
        total = size[i] + size[j]
        centre[fresh] = (centre[i] * size[i] + centre[j] * size[j]) / total
        size[fresh], members[fresh], near[fresh] = total, members.pop(i) + members.pop(j), (near[i] | near[j]) - {i, j}
        for k in near[fresh]:
            near[k] = (near[k] - {i, j}) | {fresh}
            heapq.heappush(heap, (merge_cost(size[k], centre[k], total, centre[fresh]), k, fresh))
        fresh += 1
        snapshot()
    return out


def _silhouette_np(x: np.ndarray, labels: np.ndarray) -> float:
    groups, own = np.unique(labels, return_inverse=True)
    member = (own[:, None] == np.arange(len(groups))).astype(float)
    sums = np.concatenate([np.sqrt(_squared(x[rows], x)) @ member for rows in _blocks(len(x))])
    n = member.sum(0)
    at = np.arange(len(x))
    a = sums[at, own] / np.maximum(n[own] - 1, 1)
    other = sums / n
    other[at, own] = np.inf
    b = other.min(1)
    return float(np.where(n[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0).mean())


def redcap(stations: DataFrame, value: str, *, groups: list[str] | None = None, k_range: tuple[int, int] = (2, 8), neighbours: int = 2, location_weight: float = 0.1, value_weight: float = 2.0, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Contiguous regions of similar stations, one task per group: ``region``, ``n_regions``, ``silhouette``.

    Time grows with the square of a group's stations, memory with their number. Regions are numbered by their mean value.
    """
    by = groups or []
    base = stations.where(finite(value).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(*by, "station", lat, lon, value)
    schema = T.StructType([*base.schema.fields, T.StructField("region", T.IntegerType()), T.StructField("n_regions", T.IntegerType()), T.StructField("silhouette", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("station").reset_index(drop=True)
        x = pdf[[lon, lat, value]].to_numpy(float)
        sd = x.std(0)
        z = (x - x.mean(0)) / np.where(sd > 0, sd, 1) * [location_weight, location_weight, value_weight]
        n = len(pdf)
        wanted = set(range(k_range[0], min(k_range[1], n - 1) + 1))
        if not wanted:
            return pdf.assign(region=0, n_regions=1, silhouette=np.nan)
        found = contiguous_regions(z, neighbour_graph(x[:, :2], neighbours), wanted)
        scored = [(_silhouette_np(z, labels), -k, labels) for k, labels in found.items()]
        s, k, labels = max(scored, key=lambda t: t[:2])
        means = defaultdict(list)
        for g, v in zip(labels, x[:, 2]):
            means[g].append(v)
        rank = {g: r for r, g in enumerate(sorted(means, key=lambda g: np.mean(means[g])))}
        return pdf.assign(region=[rank[g] for g in labels], n_regions=-k, silhouette=s)

    return base.groupBy(*(by or [F.lit(0).alias("__all")])).applyInPandas(run, schema)
