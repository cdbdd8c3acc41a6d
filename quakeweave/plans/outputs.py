"""Sets of tables written by one run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeweave.functions import traces as TR
from quakeweave.functions.geodesy import add_path_geometry
from quakeweave.operators import metrics as M
from quakeweave.operators.joins import fill_from
from quakeweave.operators.normalize import standard_metrics
from quakeweave.operators.qc import resume
from quakeweave.runtime import cut_lineage


def metric_outputs(rows: DataFrame, *, events: DataFrame | None = None, stations: DataFrame | None = None, residual: str | None = None, score: str | None = None, distance_km: float = 10.0, azimuth_deg: float = 30.0) -> dict[str, DataFrame]:
    """The long table with metadata and paths, the path table and bins, and the four dashboard summaries.

    The long table feeds all others; it is written once and read back by them.
    """
    long = rows
    if events is not None:
        long = fill_from(long, events, "event_id")
    if stations is not None:
        long = fill_from(long, stations.withColumnsRenamed({"lat": "sta_lat", "lon": "sta_lon"}), "station")
    long = cut_lineage(add_path_geometry(standard_metrics(long, residual=residual, score=score)), "metrics_long")
    out = {"metrics_long": long}
    if {"distance_km", "azimuth_deg"} <= set(long.columns):
        out["path_table"] = M.path_table(long)
        out["path_summary"] = M.path_bins(out["path_table"], ["model", "metric", "band", "component"], distance_km=distance_km, azimuth_deg=azimuth_deg)
    return out | M.dashboard_cubes(long)


def write_all(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Each table as Parquet under its name."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder}/{name}.parquet"
        df.write.mode("overwrite").parquet(paths[name])
    return paths


def preprocess_traces(traces: DataFrame, *, lowpass_hz: float | None = None, band: tuple[float, float] | None = None, resample_hz: float | None = None, done: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Filtered and resampled traces with their new interval and length; keys that are done already are left out."""
    work = traces if done is None else resume(traces, done, keys or ["source", "channel"])
    x = F.col("samples")
    if band:
        x = TR.bandpassed(x, F.col("dt"), *band)
    elif lowpass_hz:
        x = TR.lowpassed(x, F.col("dt"), lowpass_hz)
    work = work.withColumn("samples", x)
    if resample_hz:
        work = work.withColumn("samples", TR.resampled("samples", "dt", resample_hz)).withColumns({"dt": F.lit(1 / resample_hz), "sampling_rate": F.lit(float(resample_hz))})
    return work.withColumn("npts", F.size("samples"))
