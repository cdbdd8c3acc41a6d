"""Distances, bearings and projections as column expressions, on a sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeweave.functions.labels import finite

# Fixed value: radius of the sphere in km.
EARTH_RADIUS_KM = 6371.0088


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    p, q = F.radians(_c(lat1)), F.radians(_c(lat2))
    h = F.pow(F.sin((q - p) / 2), F.lit(2)) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(_c(lon2) - _c(lon1)) / 2), F.lit(2))
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def azimuth_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing from the first to the second point, 0 <= x < 360."""
    p, q, d = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lon2) - _c(lon1))
    a = F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d)))
    return F.pmod(F.pmod(a, F.lit(360.0)), F.lit(360.0))


def true_backazimuth_deg(lat1, lon1, lat2, lon2) -> Column:
    """Bearing at the second point towards the first."""
    return azimuth_deg(lat2, lon2, lat1, lon1)


def add_path_geometry(
    df: DataFrame,
    event: tuple[str, str] = ("event_lat", "event_lon"),
    station: tuple[str, str] = ("sta_lat", "sta_lon"),
    *,
    backazimuth: str = "opposite",
    fill_only: bool = False,
    required: bool = False,
) -> DataFrame:
    """``distance_km``, ``azimuth_deg`` and ``backazimuth_deg`` from event to station.

    ``backazimuth`` is ``opposite`` (azimuth plus 180) or ``true`` (the bearing back along the
    great circle). With ``fill_only``, values that are there stay. Without the coordinate
    columns nothing is done, or ValueError raised if they are ``required``.
    """
    missing = [c for c in (*event, *station) if c not in df.columns]
    if missing:
        if required:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        return df
    ends = [finite(c) for c in (*event, *station)]
    az = azimuth_deg(*ends)
    made = {
        "distance_km": haversine_km(*ends),
        "azimuth_deg": az,
        "backazimuth_deg": F.pmod(az + 180, F.lit(360.0)) if backazimuth == "opposite" else true_backazimuth_deg(*ends),
    }
    if fill_only:
        made = {k: F.coalesce(finite(k), v) if k in df.columns else v for k, v in made.items()}
    return df.withColumns(made)


def local_xy_km(df: DataFrame, lat: str, lon: str, *, lat0: float | None = None, x: str = "x_km", y: str = "y_km") -> DataFrame:
    """Equirectangular x and y in km about a latitude, by default the mean of all rows.

    The mean is one row, joined to all; it is found by a partial aggregation.
    """
    if lat0 is not None:
        base, mean = df, F.lit(math.radians(lat0))
    else:
        one = df.agg(F.avg(F.radians(F.col(lat))).alias("__lat0"))
        base, mean = df.crossJoin(F.broadcast(one)), F.col("__lat0")
    out = base.withColumns({x: EARTH_RADIUS_KM * F.radians(F.col(lon)) * F.cos(mean), y: EARTH_RADIUS_KM * F.radians(F.col(lat))})
    return out.drop("__lat0")


def orientation_deg(lat1, lon1, lat2, lon2) -> Column:
    """Bearing of a line without direction, 0 <= x < 180."""
    return F.pmod(azimuth_deg(lat1, lon1, lat2, lon2), F.lit(180.0))


def sector_centers(width: float) -> list[float]:
    if not 0 < width < 180 or math.ceil(180 / width - 1e-9) < 2:
        raise ValueError("sectors must be narrower than 180 degrees, and at least two")
    return [k * width for k in range(math.ceil(180 / width - 1e-9))]


def sector(orientation: Column, width: float) -> Column:
    """Index of the sector whose centre is nearest, sectors being ``width`` degrees wide."""
    return F.floor(F.pmod(orientation + width / 2, F.lit(180.0)) / width).cast("int")


def sector_label(center: float, width: float) -> str:
    if width == 45:
        return {0.0: "N-S", 45.0: "NE-SW", 90.0: "E-W", 135.0: "NW-SE"}[float(center)]
    return f"{center:g} deg"


def hypocentral_km(epicentral, depth) -> Column:
    """Never below 1 m; an unknown depth counts as 0."""
    return F.greatest(F.sqrt(F.pow(finite(epicentral), F.lit(2)) + F.pow(F.coalesce(finite(depth), F.lit(0.0)), F.lit(2))), F.lit(0.001))


def azimuthal_equidistant_km(lat, lon, lat0: float, lon0: float) -> tuple[Column, Column]:
    """x and y in km about a centre, true to distance from there."""
    p, d, p0 = F.radians(_c(lat)), F.radians(_c(lon) - lon0), math.radians(lat0)
    c = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), math.sin(p0) * F.sin(p) + math.cos(p0) * F.cos(p) * F.cos(d))))
    k = F.when(F.abs(c) < 1e-12, F.lit(1.0)).otherwise(c / F.sin(c)) * EARTH_RADIUS_KM
    return k * F.cos(p) * F.sin(d), k * (math.cos(p0) * F.sin(p) - math.sin(p0) * F.cos(p) * F.cos(d))


def grid_cell(c, step: float) -> Column:
    """Lower edge of the cell of width ``step``."""
    return F.floor(finite(c) / step) * F.lit(float(step))


def block_ids(df: DataFrame, x: str, y: str, size_km: float) -> DataFrame:
    """``block`` (``bx###_by###`` from the least x and y) and ``block_stations``, the rows in it."""
    least = df.agg(F.min(x).alias("__x0"), F.min(y).alias("__y0"))
    part = lambda c, c0: F.format_string("%03d", F.floor((F.col(c) - F.col(c0)) / size_km))
    named = df.crossJoin(F.broadcast(least)).withColumn("block", F.concat(F.lit("bx"), part(x, "__x0"), F.lit("_by"), part(y, "__y0")))
    return named.drop("__x0", "__y0").withColumn("block_stations", F.count(F.lit(1)).over(Window.partitionBy("block")))
