"""Points, paths and corridors against polygons.

Polygons are small beside the records: their trees go to the executors in blocks of
bounded size and the records stay where they are (see ``proximity``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakeweave.functions.text import name_token
from quakeweave.operators.proximity import BLOCK_VERTICES, EARTH_RADIUS_KM, EdgeTree, _inside, haversine_np, ring_edges

RELATIONS = ("crosses_boundary", "begins_in", "ends_in", "station_inside", "event_inside")


@dataclass(frozen=True)
class Shape:
    name: str
    edges: np.ndarray

    def covers(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """Inside or on the boundary."""
        return _inside(self.edges, lat, lon) | on_boundary(self.edges, lat, lon)


def on_boundary(edges: np.ndarray, lat: np.ndarray, lon: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    out = np.zeros(len(lat), bool)
    for x0, y0, x1, y1 in edges:
        cross = (x1 - x0) * (lat - y0) - (y1 - y0) * (lon - x0)
        size = max(abs(x1 - x0), abs(y1 - y0), 1e-12)
        between = (lon >= min(x0, x1) - tolerance) & (lon <= max(x0, x1) + tolerance) & (lat >= min(y0, y1) - tolerance) & (lat <= max(y0, y1) + tolerance)
        out |= between & (np.abs(cross) <= tolerance * size)
    return out


def crossings(edges: np.ndarray, lat0, lon0, lat1, lon1) -> np.ndarray:
    """Whether each path meets any edge, touching included."""
    out = np.zeros(len(lat0), bool)
    for x0, y0, x1, y1 in edges:
        side = lambda px, py: np.sign(np.round((x1 - x0) * (py - y0) - (y1 - y0) * (px - x0), 14))
        a, b = side(lon0, lat0), side(lon1, lat1)
        dx, dy = lon1 - lon0, lat1 - lat0
        c = np.sign(np.round(dx * (y0 - lat0) - dy * (x0 - lon0), 14))
        d = np.sign(np.round(dx * (y1 - lat0) - dy * (x1 - lon0), 14))
        box = (np.minimum(lon0, lon1) <= max(x0, x1)) & (np.maximum(lon0, lon1) >= min(x0, x1)) & (np.minimum(lat0, lat1) <= max(y0, y1)) & (np.maximum(lat0, lat1) >= min(y0, y1))
        out |= box & (a * b <= 0) & (c * d <= 0)
    return out


def inside_share(edges: np.ndarray, lat0, lon0, lat1, lon1) -> np.ndarray:
    """Share of each straight path that runs inside the polygon."""
    n = len(lat0)
    cuts = [np.zeros(n), np.ones(n)]
    for x0, y0, x1, y1 in edges:
        dx, dy, ex, ey = lon1 - lon0, lat1 - lat0, x1 - x0, y1 - y0
        den = dx * ey - dy * ex
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((x0 - lon0) * ey - (y0 - lat0) * ex) / den
            u = ((x0 - lon0) * dy - (y0 - lat0) * dx) / den
        hit = np.isfinite(t) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1)
        if hit.any():
            cuts.append(np.where(hit, t, 0.0))
    at = np.sort(np.stack(cuts, 1), axis=1)
    share = np.zeros(n)
    for k in range(at.shape[1] - 1):
        width, mid = at[:, k + 1] - at[:, k], (at[:, k + 1] + at[:, k]) / 2
        live = width > 1e-12
        share[live] += np.where(_inside(edges, (lat0 + mid * (lat1 - lat0))[live], (lon0 + mid * (lon1 - lon0))[live]), width[live], 0.0)
    return share


def shapes(polygons: DataFrame, name: str = "name", *, most: int = BLOCK_VERTICES) -> list[Shape]:
    """A selection of polygons on the driver, in order of ``region_id``; ValueError beyond ``most`` vertices, for which ``proximity.locate_regions`` works in blocks."""
    if (polygons.agg(F.sum(F.size("ring_lons"))).first()[0] or 0) > most:
        raise ValueError("too many vertices for one set of polygons; classify them in parts")
    edges: dict[tuple, list[np.ndarray]] = {}
    for r in polygons.select("region_id", name, "ring_lons", "ring_lats").collect():
        edges.setdefault((r["region_id"], r[name]), []).append(ring_edges(r["ring_lons"], r["ring_lats"]))
    return [Shape(k[1], np.concatenate(edges[k])) for k in sorted(edges, key=lambda k: k[0])]


def _numbers(pdf: pd.DataFrame, columns: tuple[str, ...]) -> list[np.ndarray]:
    return [pd.to_numeric(pdf[c], errors="coerce").to_numpy(float, na_value=np.nan) for c in columns]


def _map(df: DataFrame, fields: list[T.StructField], work: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    names = {f.name for f in fields}
    base = df.drop(*names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.concat([pdf, work(pdf)], axis=1)

    return base.mapInPandas(run, T.StructType([*base.schema.fields, *fields]))


def annotate_points(df: DataFrame, polygons: DataFrame, lat: str, lon: str, *, prefix: str = "region", per_polygon: bool = False) -> DataFrame:
    """``<prefix>_labels`` (names of all polygons around the point, ``;`` between) and ``<prefix>_inside_any``.

    Boundaries belong to their polygons. With ``per_polygon``, a flag per polygon. Points
    without a position are in none.
    """
    own = shapes(polygons)
    fields = [T.StructField(f"{prefix}_labels", T.StringType()), T.StructField(f"{prefix}_inside_any", T.BooleanType())]
    flags = [f"{prefix}_{''.join(c if c.isalnum() else '_' for c in s.name.lower())}" for s in own] if per_polygon else []
    fields += [T.StructField(f, T.BooleanType()) for f in flags]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = _numbers(pdf, (lat, lon))
        ok = np.isfinite(y) & np.isfinite(x)
        hit = np.zeros((len(own), len(pdf)), bool)
        for k, s in enumerate(own):
            hit[k, ok] = s.covers(y[ok], x[ok])
        labels = [";".join(s.name for s, h in zip(own, column) if h) for column in hit.T]
        out = {f"{prefix}_labels": labels, f"{prefix}_inside_any": hit.any(0)}
        return pd.DataFrame(out | dict(zip(flags, hit)), index=pdf.index)

    return _map(df, fields, work)


def classify_paths(df: DataFrame, polygons: DataFrame, *, start: tuple[str, str] = ("event_lat", "event_lon"), end: tuple[str, str] = ("sta_lat", "sta_lon"), relation: str = "crosses_boundary", direction: str = "either") -> DataFrame:
    """``path_labels`` and ``path_matches``: the polygons to which the straight path has the relation.

    Crossing ``inward`` starts outside and ends inside, ``outward`` the other way round.
    """
    if relation not in RELATIONS or direction not in ("either", "inward", "outward"):
        raise ValueError("unknown relation or direction")
    own = shapes(polygons)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0, y1, x1 = _numbers(pdf, (*start, *end))
        ok = np.isfinite(y0) & np.isfinite(x0) & np.isfinite(y1) & np.isfinite(x1)
        hit = np.zeros((len(own), len(pdf)), bool)
        for k, s in enumerate(own):
            a, b = s.covers(y0[ok], x0[ok]), s.covers(y1[ok], x1[ok])
            if relation == "crosses_boundary":
                m = crossings(s.edges, y0[ok], x0[ok], y1[ok], x1[ok])
                m &= {"either": np.ones(len(a), bool), "inward": ~a & b, "outward": a & ~b}[direction]
            else:
                m = a if relation in ("begins_in", "event_inside") else b
            hit[k, ok] = m
        return pd.DataFrame({"path_labels": [";".join(s.name for s, h in zip(own, column) if h) for column in hit.T], "path_matches": hit.any(0)}, index=pdf.index)

    return _map(df, [T.StructField("path_labels", T.StringType()), T.StructField("path_matches", T.BooleanType())], work)


def edge_zones(df: DataFrame, polygons: DataFrame, target: str, lat: str, lon: str, *, edge_km: float) -> DataFrame:
    """``target_region_zone`` by side and distance to the target's boundary, ``boundary_km`` and ``mapped_region`` (the smallest polygon around)."""
    own = shapes(polygons)
    aim = next(s for s in own if s.name == target)
    size = {s.name: abs(sum((e[0] * e[3] - e[2] * e[1]) for e in s.edges)) for s in own}
    by_size = sorted(own, key=lambda s: (size[s.name], s.name))
    tree = EdgeTree(aim.edges)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = _numbers(pdf, (lat, lon))
        ok = np.isfinite(y) & np.isfinite(x)
        km = np.full(len(pdf), np.nan)
        km[ok] = tree.distance_km(y[ok], x[ok])
        inside = np.zeros(len(pdf), bool)
        inside[ok] = aim.covers(y[ok], x[ok])
        zone = np.where(inside, np.where(km <= edge_km, "target_region_edge_inside", "target_region_interior"), np.where(km <= edge_km, "target_region_edge_outside", "outside_target_region")).astype(object)
        zone[~ok] = None
        region = np.full(len(pdf), None, object)
        for s in reversed(by_size):
            hit = np.zeros(len(pdf), bool)
            hit[ok] = s.covers(y[ok], x[ok])
            region[hit] = s.name
        return pd.DataFrame({"target_region_zone": zone, "boundary_km": km, "mapped_region": region}, index=pdf.index)

    return _map(df, [T.StructField("target_region_zone", T.StringType()), T.StructField("boundary_km", T.DoubleType()), T.StructField("mapped_region", T.StringType())], work)


# ---------------------------------------------------------------- corridors


def _local(lat: np.ndarray, lon: np.ndarray, lat0: float, lon0: float) -> np.ndarray:
    km = np.radians(1) * EARTH_RADIUS_KM
    return np.stack([(lon - lon0) * km * np.cos(np.radians(lat0)), (lat - lat0) * km], -1)


def _global(xy: np.ndarray, lat0: float, lon0: float) -> tuple[np.ndarray, np.ndarray]:
    km = np.radians(1) * EARTH_RADIUS_KM
    return lat0 + xy[..., 1] / km, lon0 + xy[..., 0] / (km * np.cos(np.radians(lat0)))


def boundary_frame(shape: Shape, lat: float, lon: float, window_km: float = 10.0) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Nearest boundary point, mean direction of the boundary within a window around it, and the normal that points inward."""
    e = np.concatenate([_local(shape.edges[:, [1]], shape.edges[:, [0]], lat, lon)[:, 0], _local(shape.edges[:, [3]], shape.edges[:, [2]], lat, lon)[:, 0]], axis=1)
    d = e[:, 2:] - e[:, :2]
    long2 = np.maximum((d**2).sum(1), 1e-18)
    t = np.clip(-(e[:, :2] * d).sum(1) / long2, 0, 1)
    at = e[:, :2] + t[:, None] * d
    k = int(((at) ** 2).sum(1).argmin())
    anchor = at[k]
    tangent = d[k] / np.sqrt(long2[k])
    for j in range(len(e)):
        near = np.clip(((anchor - e[j, :2]) * d[j]).sum() / long2[j], 0, 1)
        gap = np.sqrt(((e[j, :2] + near * d[j] - anchor) ** 2).sum())
        if j != k and gap <= window_km / 2:
            own = d[j] / np.sqrt(long2[j])
            tangent = tangent + own * np.sign(own @ d[k] or 1.0) * (1 - gap / window_km)
    tangent = tangent / np.sqrt((tangent**2).sum())
    normal = np.array([-tangent[1], tangent[0]])
    y, x = _global(anchor + 1e-3 * normal, lat, lon)
    if not shape.covers(np.array([y]), np.array([x]))[0]:
        normal = -normal
    y, x = _global(anchor, lat, lon)
    return float(y), float(x), tangent, normal


def corridor_ring(shape: Shape, lat: float, lon: float, *, form: str = "rectangle", inside_km: float = 30.0, outside_km: float = 0.0, width_km: float = 10.0, half_angle_deg: float = 30.0, window_km: float = 10.0) -> tuple[list[float], list[float]]:
    """Ring of a rectangle across the boundary near a position, or of a fan inward from it."""
    y0, x0, tangent, normal = boundary_frame(shape, lat, lon, window_km)
    if form == "rectangle":
        corners = [-width_km / 2 * tangent - outside_km * normal, width_km / 2 * tangent - outside_km * normal, width_km / 2 * tangent + inside_km * normal, -width_km / 2 * tangent + inside_km * normal]
    else:
        side = np.tan(np.radians(half_angle_deg)) * inside_km
        corners = [np.zeros(2), inside_km * normal - side * tangent, inside_km * normal + side * tangent]
    y, x = _global(np.array([*corners, corners[0]]), y0, x0)
    return x.tolist(), y.tolist()


CORRIDOR = T.StructType([T.StructField("region_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("anchor_id", T.StringType()), T.StructField("distance_km", T.DoubleType()), T.StructField("ring_lons", T.ArrayType(T.DoubleType())), T.StructField("ring_lats", T.ArrayType(T.DoubleType()))])


def opposite_width_km(edges: np.ndarray, lat: float, lon: float, bearing_deg: float) -> float:
    """Distance in km from a boundary point to the next edge along a bearing, in a plane true to distance from the point; NaN if there is none.

    Edges within a metre are those of the point itself.
    """
    p, p0 = np.radians(edges[:, [1, 3]]), np.radians(lat)
    d = np.radians(edges[:, [0, 2]] - lon)
    c = np.arccos(np.clip(np.sin(p0) * np.sin(p) + np.cos(p0) * np.cos(p) * np.cos(d), -1, 1))
    k = np.where(c > 1e-12, c / np.where(c > 1e-12, np.sin(c), 1), 1) * EARTH_RADIUS_KM
    x, y = k * np.cos(p) * np.sin(d), k * (np.cos(p0) * np.sin(p) - np.sin(p0) * np.cos(p) * np.cos(d))
    # Along the bearing and across it.
    a = np.radians(bearing_deg)
    along, across = x * np.sin(a) + y * np.cos(a), x * np.cos(a) - y * np.sin(a)
    meets = (across[:, 0] > 0) != (across[:, 1] > 0)
    if not meets.any():
        return float("nan")
    u, v = along[meets], across[meets]
    at = u[:, 0] - v[:, 0] * (u[:, 1] - u[:, 0]) / (v[:, 1] - v[:, 0])
    at = at[at > 0.001]
    return float(at.min()) if len(at) else float("nan")


def boundary_corridors(anchors: DataFrame, polygons: DataFrame, key: str, lat: str, lon: str, *, near_km: float | None = None, **form) -> DataFrame:
    """A corridor per anchor at its nearest polygon; anchors farther than ``near_km`` from it get none.

    ``region_id`` numbers the corridors by anchor and can be used with ``classify_by_corridors``.
    """
    own = shapes(polygons)
    trees = [EdgeTree(s.edges) for s in own]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            y, x = _numbers(pdf, (lat, lon))
            rows = []
            for k in np.flatnonzero(np.isfinite(y) & np.isfinite(x)):
                far = [t.distance_km(y[k : k + 1], x[k : k + 1])[0] for t in trees]
                s = int(np.argmin(far))
                if near_km is None or far[s] <= near_km:
                    rows.append((None, own[s].name, str(pdf[key].iloc[k]), float(far[s]), *corridor_ring(own[s], y[k], x[k], **form)))
            yield pd.DataFrame(rows, columns=CORRIDOR.names)

    made = anchors.select(key, lat, lon).mapInPandas(run, CORRIDOR)
    return made.withColumn("region_id", F.xxhash64("name", "anchor_id"))


def classify_by_corridors(df: DataFrame, corridors: DataFrame, *, event: tuple[str, str] = ("event_lat", "event_lon"), station: tuple[str, str] = ("sta_lat", "sta_lon"), least_km: float = 0.0, least_share: float = 0.0) -> DataFrame:
    """One row per record and corridor that it touches.

    Adds ``corridor_id``, ``event_inside``, ``station_inside``, ``path_km`` and ``path_share``
    (of the path inside the corridor). Records and corridors are compared per batch of
    records; only corridors whose bounding box meets the path's are looked at.
    """
    own = shapes(corridors, "anchor_id")
    boxes = np.array([[s.edges[:, [0, 2]].min(), s.edges[:, [1, 3]].min(), s.edges[:, [0, 2]].max(), s.edges[:, [1, 3]].max()] for s in own]).reshape(-1, 4)
    fields = [T.StructField("corridor_id", T.StringType()), T.StructField("event_inside", T.BooleanType()), T.StructField("station_inside", T.BooleanType()), T.StructField("path_km", T.DoubleType()), T.StructField("path_share", T.DoubleType())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ends = _numbers(pdf, (*event, *station))
            ok = np.isfinite(np.stack(ends)).all(0)
            for s, (bx0, by0, bx1, by1) in zip(own, boxes):
                y0, x0, y1, x1 = ends
                k = np.flatnonzero(ok & (np.minimum(x0, x1) <= bx1) & (np.maximum(x0, x1) >= bx0) & (np.minimum(y0, y1) <= by1) & (np.maximum(y0, y1) >= by0))
                if not len(k):
                    continue
                y0, x0, y1, x1 = (v[k] for v in ends)
                a, b = s.covers(y0, x0), s.covers(y1, x1)
                share = inside_share(s.edges, y0, x0, y1, x1)
                km = share * haversine_np(y0, x0, y1, x1)
                keep = (a | b | (share > 0)) & (km >= least_km) & (share >= least_share)
                out = pdf.iloc[k[keep]].copy()
                yield out.assign(corridor_id=s.name, event_inside=a[keep], station_inside=b[keep], path_km=km[keep], path_share=share[keep])

    base = df.drop(*[f.name for f in fields])
    return base.mapInPandas(run, T.StructType([*base.schema.fields, *fields]))


def events_in_corridors(events: DataFrame, corridors: DataFrame, lat: str, lon: str, *, depth: str | None = None, depths: tuple[float, float] | None = None) -> DataFrame:
    """Events inside corridors, with ``corridor_id``; within a range of depths if one is given."""
    same = classify_by_corridors(events, corridors, event=(lat, lon), station=(lat, lon)).where("event_inside")
    return same if depths is None else same.where(F.col(depth).between(*depths))


def region_token(c: Column | str) -> Column:
    return name_token(c)
