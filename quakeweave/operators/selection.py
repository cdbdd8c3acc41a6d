"""Row selections of dashboards, figures and reviews, as predicates that reach the scan."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeweave.functions import text as X
from quakeweave.functions.labels import band_key, finite, metric_key, present
from quakeweave.operators.metrics import existing, first_row


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def in_range(df: DataFrame, columns: list[str], bounds) -> Column:
    """Inclusive bounds (either may be None) on the first of the columns that exists; NULL fails once a bound is given."""
    found = existing(df, columns)
    if bounds is None or not found:
        return F.lit(True)
    low, high = bounds
    v = finite(found[0])
    return every(([v >= low] if low is not None else []) + ([v <= high] if high is not None else []))


def contains(column: str, query: str | None) -> Column:
    q = (query or "").strip().lower()
    return F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(q)) if q else F.lit(True)


def same_text(column: str, value: str | None) -> Column:
    return F.upper(F.trim(column)) == value.strip().upper() if value and value.strip().lower() != "all" else F.lit(True)


def in_bands(df: DataFrame, bands: list[str] | None, columns: list[str]) -> Column:
    """Any of the band columns equals one of the bands, in any of their spellings."""
    found = existing(df, columns)
    if not bands or not found:
        return F.lit(True)
    wanted = F.array(*[band_key(F.lit(b)) for b in bands])
    return reduce(lambda a, b: a | b, [F.coalesce(F.array_contains(wanted, band_key(c)), F.lit(False)) for c in found])


def filter_metrics(df: DataFrame, *, models=None, metric=None, bands=None, vs30=None, distance_km=None, magnitude=None, station="", event="", component=None, least_n=None) -> DataFrame:
    conditions = [
        F.col("model").isin(list(models)) if models else F.lit(True),
        metric_key("metric") == metric_key(F.lit(metric)) if metric else F.lit(True),
        in_bands(df, bands, ["band", "passband"]),
        in_range(df, ["Vs30", "vs30"], vs30),
        in_range(df, ["distance_km", "med_dist_km"], distance_km),
        in_range(df, ["magnitude", "event_magnitude", "Mw"], magnitude),
        contains("station", station) if "station" in df.columns else F.lit(True),
        contains("event_id", event) if "event_id" in df.columns else F.lit(True),
        same_text("component", component) if "component" in df.columns else F.lit(True),
        F.col("n") >= least_n if least_n is not None and "n" in df.columns else F.lit(True),
    ]
    return df.where(every(conditions))


def day_range(column: str, start=None, end=None) -> Column:
    """From the start of one day to the end of another, both included."""
    conditions = []
    if start is not None:
        conditions.append(F.col(column) >= F.lit(dt.date.fromisoformat(str(start)[:10])).cast("timestamp"))
    if end is not None:
        conditions.append(F.col(column) < F.lit(dt.date.fromisoformat(str(end)[:10]) + dt.timedelta(days=1)).cast("timestamp"))
    return every(conditions)


def filter_traces(df: DataFrame, *, event="", family=None, component=None, station="", magnitude=None, distance_km=None, dates=(None, None), accepted=None, reason="", date_column="event_date") -> DataFrame:
    """Trace QC rows; ``accepted`` reads an accepted flag or the reverse of a reject flag."""
    conditions = [contains("event_id", event), contains("station", station), same_text("component", component), in_range(df, ["magnitude"], magnitude), in_range(df, ["distance_km"], distance_km)]
    if family and family != "all":
        conditions.append(F.col("station_family") == family)
    if any(dates):
        conditions.append(day_range(date_column, *dates))
    if accepted is not None:
        flag = X.truthy("accepted") if "accepted" in df.columns else ~X.truthy("reject")
        conditions.append(flag == F.lit(bool(accepted)))
    reasons = [c for c in df.columns if c.startswith("reject_reason")]
    if reason and reasons:
        conditions.append(reduce(lambda a, b: a | b, [contains(c, reason) for c in reasons]))
    return df.where(every(conditions))


def in_bounds(df: DataFrame, bounds: tuple[float, float, float, float] | None, relation: str, lon: list[str], lat: list[str]) -> Column:
    """Inside or outside a box (west, east, south, north), borders inside; ``both`` keeps all."""
    x, y = existing(df, lon), existing(df, lat)
    if bounds is None or relation == "both" or not x or not y:
        return F.lit(True)
    w, e, s, n = bounds
    inside = finite(x[0]).between(w, e) & finite(y[0]).between(s, n)
    return inside if relation == "inside" else ~inside


def in_regions(column: str, regions: list[str] | None, relation: str = "inside") -> Column:
    """Membership of a delimited region column in any of the regions (in any region, if none are named)."""
    if regions is None or relation == "both":
        return F.lit(True)
    inside = X.has_member(column, regions)
    return inside if relation == "inside" else ~inside


def spatial_subset(df: DataFrame, *, station_regions=None, station_region_column="station_regions", station_relation="inside", event_regions=None, event_region_column="event_regions", event_relation="inside", station_bounds=None, event_bounds=None, bounds_relation="inside", require_match: bool = True) -> DataFrame:
    """Rows by the regions and boxes of their stations and events; ValueError if none match (unless allowed)."""
    conditions = [
        in_regions(station_region_column, station_regions, station_relation),
        in_regions(event_region_column, event_regions, event_relation),
        in_bounds(df, station_bounds, bounds_relation, ["sta_lon", "station_lon", "lon"], ["sta_lat", "station_lat", "lat"]),
        in_bounds(df, event_bounds, bounds_relation, ["event_lon"], ["event_lat"]),
    ]
    out = df.where(every(conditions))
    if require_match and out.isEmpty():
        raise ValueError("no rows match the spatial selection")
    return out


def select_traces(traces: DataFrame, keys: list[str], *, prefer: tuple[str, ...] = ("BH", "HN")) -> DataFrame:
    """One trace per key: preferred channel prefixes first, then by channel code."""
    rank = F.lit(len(prefer))
    for k, p in reversed(list(enumerate(prefer))):
        rank = F.when(F.upper("channel").startswith(p), F.lit(k)).otherwise(rank)
    return first_row(traces.withColumn("__rank", rank), keys, ["__rank", "channel"]).drop("__rank")


def review_queue(traces: DataFrame, keys: list[str] | None = None, status: str = "pending") -> DataFrame:
    """Distinct keys of traces that are to be reviewed; rows with a blank key are left out."""
    by = keys or ["event_id", "station"]
    rows = traces.where(every([present(k).isNotNull() for k in by]))
    return rows.select(*[F.trim(k).alias(k) for k in by]).distinct().withColumn("status", F.lit(status))
