"""Tables of many spellings brought to the logical schemas.

Columns are found by ordered lists of names, once per table on the driver; the result is a
single projection, so everything that is not needed is pruned at the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeweave.functions import text as X
from quakeweave.functions.labels import band_key, finite, present
from quakeweave.operators.metrics import existing, first_row

# The names under which a column may come, in order of preference (capitals and separators make no difference where no exact name is there).
STATION_NAMES = {
    "network": ("network", "net", "station_network", "network_code", "Network", "Net", "network_id"),
    "station": ("station", "station_code", "station_name", "code", "Station", "Code", "site", "station_id", "sta"),
    "lat": ("lat", "latitude", "station_lat", "station_latitude", "stationlat", "Lat", "Latitude", "sta_lat", "site_lat"),
    "lon": ("lon", "longitude", "station_lon", "station_longitude", "stationlon", "Lon", "Longitude", "long", "lng", "sta_lon", "site_lon"),
    "elev": ("elev", "elevation", "station_elev", "station_elevation", "Elevation"),
}
EVENT_NAMES = {
    "event_id": ("event_id", "event", "id", "evid", "event_name", "event_title", "EventID"),
    "origin_time": ("origin_time", "time", "event_time", "datetime", "timestamp", "origin", "OriginTime", "start", "start_utc"),
    "lat": ("lat", "latitude", "event_lat", "event_latitude", "hypocenter_lat", "Lat", "Latitude", "source_lat", "origin_lat"),
    "lon": ("lon", "longitude", "event_lon", "event_longitude", "hypocenter_lon", "Lon", "Longitude", "source_lon", "origin_lon"),
    "depth_km": ("depth_km", "depth", "event_depth_km", "hypocenter_depth_km", "DepthKm", "event_depth"),
    "magnitude": ("magnitude", "mag", "mw", "ml", "event_magnitude", "Magnitude"),
}
WAVEFORM_NAMES = {
    "source": ("source", "waveform_source", "waveform_role", "role"),
    "event_id": ("event_id", "event", "event_title", "id"),
    "station": ("station", "station_code", "station_name"),
    "component": ("component", "component_code", "channel_component"),
    "model": ("model", "model_alias", "simulation_model", "synthetic_model"),
    "waveform_path": ("waveform_path", "path", "file", "filename", "filepath"),
    "dt": ("dt", "delta", "sample_interval_s"),
    "sampling_rate": ("sampling_rate", "fs", "sampling_rate_hz"),
    "starttime": ("starttime", "start_time"),
    "endtime": ("endtime", "end_time"),
    "synthetic_max_frequency_hz": ("synthetic_max_frequency_hz", "max_frequency_hz", "fmax_hz"),
}
QC_NAMES = {
    "source": WAVEFORM_NAMES["source"],
    "event_id": WAVEFORM_NAMES["event_id"],
    "station": WAVEFORM_NAMES["station"],
    "component": WAVEFORM_NAMES["component"],
    "passband": ("passband", "passband_label", "band"),
    "metric_group": ("metric_group", "group"),
    "metric": ("metric", "metric_name"),
    "period_s": ("period_s", "period", "period_sec"),
    "qc_status": ("qc_status", "status", "accepted", "reject"),
    "qc_reason": ("qc_reason", "reason", "reject_reason"),
    "trace_start_s": ("trace_start_s", "start_rel_s", "valid_reference_start_s"),
    "sample_interval_s": ("sample_interval_s", "dt", "delta"),
    "valid_start_rel_s": ("valid_start_rel_s", "valid_start_s", "usable_start_rel_s"),
    "valid_end_rel_s": ("valid_end_rel_s", "valid_end_s", "usable_end_rel_s"),
    "valid_start_sample": ("valid_start_sample", "valid_start_index", "usable_start_sample"),
    "valid_end_sample": ("valid_end_sample", "valid_end_index", "usable_end_sample"),
}
METRIC_NAMES = {
    "model": ("simulation_model", "model", "model_name"),
    "band": ("simulation_band", "Band", "band"),
    "component": ("station_component", "Component", "component"),
    "event_id": ("event_title", "event_id", "Event"),
    "event_name": ("event_name", "event_title", "event_id", "Event"),
    "event_magnitude": ("event_magnitude", "magnitude", "mag"),
    "station": ("station_name", "Station", "station"),
    "lat": ("station_latitude", "latitude", "sta_lat", "lat"),
    "lon": ("station_longitude", "longitude", "sta_lon", "lon"),
    "event_lat": ("event_latitude", "event_lat", "source_latitude", "source_lat", "hypocenter_latitude", "origin_latitude"),
    "event_lon": ("event_longitude", "event_lon", "source_longitude", "source_lon", "hypocenter_longitude", "origin_longitude"),
}
#: The names in tables that are long already, with a column ``metric``.
LONG_METRIC_NAMES = {
    "model": ("model", "model_name", "simulation_model"),
    "band": ("band", "passband", "simulation_band"),
    "component": ("component", "station_component"),
    "event_id": ("event_id", "event_title"),
    "event_name": ("event_name", "event_id", "event_title"),
    "event_magnitude": ("event_magnitude", "magnitude", "Mw"),
    "station": ("station", "station_name"),
    "lat": ("lat", "sta_lat", "station_lat", "station_latitude"),
    "lon": ("lon", "sta_lon", "station_lon", "station_longitude"),
    "event_lat": ("event_lat", "event_latitude"),
    "event_lon": ("event_lon", "event_longitude"),
}
PICK_NAMES = {
    "event_id": ("event_id", "event", "id"),
    "station": ("station", "station_code", "sta"),
    "component": ("component", "channel_component"),
    "phase": ("phase", "phase_type", "phase_hint"),
    "pick_time_abs": ("pick_time_abs", "pick_time", "phase_time"),
    "pick_time_rel_s": ("pick_time_rel_s", "rel_s", "time_rel_s"),
    "probability": ("probability", "prob", "phase_score", "score"),
    "method": ("method", "picker"),
}
_NUMBERS = {"lat", "lon", "elev", "depth_km", "magnitude", "dt", "sampling_rate", "synthetic_max_frequency_hz", "period_s", "trace_start_s", "sample_interval_s", "valid_start_rel_s", "valid_end_rel_s", "valid_start_sample", "valid_end_sample", "event_magnitude", "event_lat", "event_lon", "pick_time_rel_s", "probability"}


def resolve(df: DataFrame, names: dict[str, tuple[str, ...]]) -> dict[str, str | None]:
    """The table's column for each wanted one: an exact name first, else one with the same letters and digits."""
    plain = lambda s: re.sub(r"[^a-z0-9]", "", s.lower())
    by_plain: dict[str, str] = {}
    for c in df.columns:
        by_plain.setdefault(plain(c), c)
    out = {}
    for want, aliases in names.items():
        exact = [a for a in aliases if a in df.columns]
        near = [by_plain[plain(a)] for a in aliases if plain(a) in by_plain]
        out[want] = (exact or near or [None])[0]
    return out


def number(c: Column) -> Column:
    """A number from any column; texts that are none, NaN and the infinities are NULL."""
    return finite(c.cast("string").try_cast("double"))


def project(df: DataFrame, names: dict[str, tuple[str, ...]], *, required: list[str] = (), extra: list[str] = ()) -> DataFrame:
    """The wanted columns in order (NULL where the table has none), and extra ones; ValueError if a required one is missing."""
    found = resolve(df, names)
    missing = [r for r in required if found[r] is None]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    cols = [base_col(df, found, want).alias(want) for want in names]
    return df.select(*cols, *[F.col(f"`{e}`") for e in existing(df, list(extra)) if e not in names])


def stations(df: DataFrame, *, order: str | None = None, extra: list[str] = ()) -> DataFrame:
    """Network, station, lat, lon, elev; the last part of a dotted code, upper case; blank networks are UNKNOWN.

    With ``order``, the first row of each station only, rows without station or position left out.
    """
    out = project(df, STATION_NAMES, required=["station", "lat", "lon"], extra=[*extra, *([order] if order else [])])
    out = out.withColumns({"station": X.station_code("station"), "network": F.coalesce(F.upper("network"), F.lit("UNKNOWN"))})
    if order is None:
        return out
    return first_row(out.where(F.col("station").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()), ["station"], [order])


def events(df: DataFrame, *, order: str | None = None, extra: list[str] = ()) -> DataFrame:
    out = project(df, EVENT_NAMES, required=["event_id"], extra=[*extra, *([order] if order else [])])
    out = out.withColumn("origin_time", F.try_to_timestamp("origin_time"))
    return out if order is None else first_row(out.where(F.col("event_id").isNotNull()), ["event_id"], [order])


def waveform_inventory(df: DataFrame, *, source: str | None = None, fmax: float | None = None) -> DataFrame:
    """The eleven inventory columns; a blank source is observed; the highest frequency is filled for synthetics only."""
    out = project(df, WAVEFORM_NAMES, required=["event_id", "station"])
    src = F.lit(source) if source else F.lower(F.coalesce("source", F.lit("observed")))
    out = out.withColumns({"source": src, "station": F.upper("station"), "component": F.upper("component")})
    filled = F.when(F.col("source") == "synthetic", F.coalesce("synthetic_max_frequency_hz", F.lit(fmax).cast("double")))
    return out.withColumn("synthetic_max_frequency_hz", filled)


def qc_table(df: DataFrame, *, source: str | None = None) -> DataFrame:
    """The sixteen QC columns with statuses pass or fail; blank groups and metrics are empty texts."""
    found = resolve(df, QC_NAMES)["qc_status"]
    out = project(df, QC_NAMES, required=["event_id", "station"])
    status = X.qc_status("qc_status")
    if found == "reject":
        status = F.when(X.truthy("qc_status"), F.lit("fail")).otherwise(F.lit("pass"))
    blank = F.lit("")
    return out.withColumns(
        {"source": F.lit(source) if source else F.lower(F.coalesce("source", F.lit("observed"))), "station": F.upper("station"), "component": F.upper("component"), "metric_group": F.coalesce("metric_group", blank), "metric": F.coalesce("metric", blank), "qc_reason": F.coalesce("qc_reason", blank), "qc_status": status}
    )


def metric_field(df: DataFrame, *, value: str | None = None, metric: str | None = None, model: str | None = None) -> DataFrame:
    """The field table: keys, positions and ``field_value`` with ``field_source``.

    The value is the named column, else log2 of ``<metric>_obs`` over ``<metric>_syn`` of a wide table,
    else its score, else ``log2_residual`` of a long one. Rows without value, event, station or
    position are left out.
    """
    wide = bool(metric) and {f"{metric}_obs", f"{metric}_syn"} <= set(df.columns)
    names = resolve(df, LONG_METRIC_NAMES if "metric" in df.columns and not wide else METRIC_NAMES)
    if missing := [r for r in ("event_id", "station", "lat", "lon") if names[r] is None]:
        raise ValueError(f"no column for {', '.join(missing)}")
    if value:
        v, said = finite(F.col(f"`{value}`").cast("string").try_cast("double")), value
    elif metric and {f"{metric}_obs", f"{metric}_syn"} <= set(df.columns):
        o, s = (number(F.col(f"`{metric}_{k}`")) for k in ("obs", "syn"))
        v, said = F.log2(F.when((o > 0) & (s > 0), o / s)), "log2_ratio"
    elif metric and f"{metric}_score" in df.columns:
        v, said = number(F.col(f"`{metric}_score`")), "score"
    elif "log2_residual" in df.columns:
        v, said = finite("log2_residual"), "log2_residual"
    else:
        raise ValueError("no value column")
    own = F.coalesce(F.col("metric") == metric, F.lit(False)) if metric and metric != "all" and "metric" in df.columns else F.lit(True)
    cols = [base_col(df, names, w).alias(w) for w in METRIC_NAMES]
    out = df.where(own).select(*cols, v.alias("field_value"), F.lit(metric or "all").alias("metric"), F.lit(said).alias("field_source"))
    out = out.withColumns({"model": F.coalesce("model", F.lit(model or "unknown")), "band": F.coalesce(band_key("band"), F.lit("all")), "component": F.coalesce("component", F.lit("all"))})
    keep = F.col("field_value").isNotNull()
    for c in ("event_id", "station", "lat", "lon"):
        keep = keep & F.col(c).isNotNull()
    return out.where(keep)


def base_col(df: DataFrame, names: dict[str, str | None], want: str) -> Column:
    have = names[want]
    if have is None:
        return F.lit(None).cast("double" if want in _NUMBERS else "string")
    return number(F.col(f"`{have}`")) if want in _NUMBERS else present(F.col(f"`{have}`").cast("string"))


def picks(df: DataFrame, *, method: str = "catalog") -> DataFrame:
    out = project(df, PICK_NAMES, required=["event_id", "station", "phase"])
    return out.withColumns({"station": F.upper("station"), "component": F.coalesce(F.upper("component"), F.lit("ALL")), "phase": F.upper("phase"), "method": F.coalesce("method", F.lit(method)), "pick_time_abs": F.try_to_timestamp("pick_time_abs")})


def decisions(df: DataFrame) -> DataFrame:
    """Manual decisions in nine columns; a blank scope is the full trace."""
    names = ("event_id", "station", "component", "scope_kind", "scope_label", "decision", "reason_code", "notes", "reviewed_at")
    out = project(df, {n: (n,) for n in names}, required=["event_id", "station"])
    return out.withColumns({"station": F.upper("station"), "component": F.coalesce(F.upper("component"), F.lit("")), "scope_kind": F.coalesce(F.lower("scope_kind"), F.lit("full")), "scope_label": F.coalesce("scope_label", F.lit("")), "decision": F.lower("decision")})


def standard_metrics(df: DataFrame, *, residual: str | None = None, score: str | None = None) -> DataFrame:
    """A long metric table with model, band, component, metric, ``residual`` and ``score``.

    A residual or score column that is empty throughout is replaced by the first of its
    substitutes that is not; one pass counts them all.
    """
    names = resolve(df, {k: LONG_METRIC_NAMES[k] for k in ("model", "band", "component")})
    out = df
    for want, have in names.items():
        c = base_col(df, names, want) if have else F.lit(None).cast("string")
        out = out.withColumn(want, F.coalesce(band_key(c) if want == "band" else c, F.lit("unknown" if want == "model" else "all")))
    candidates = {"residual": [residual, "residual", "log2_residual", "ln_residual"], "score": [score, "score", "anderson_2004_gof", "olsen_mayhew_gof"]}
    cols = sorted({c for cs in candidates.values() for c in cs if c and c in df.columns})
    filled = df.agg(*[F.count(finite(c)).alias(c) for c in cols]).first() if cols else {}
    for want, cs in candidates.items():
        use = next((c for c in cs if c and c in cols and filled[c]), None)
        out = out.withColumn(want, finite(use) if use else F.lit(None).cast("double"))
    return out
