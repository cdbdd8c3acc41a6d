"""Tables behind figures: what a chart or map shows, without drawing it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakeweave.functions.geodesy import haversine_km
from quakeweave.functions.labels import finite, present
from quakeweave.functions.traces import normalized
from quakeweave.operators.metrics import aggregate, existing, pivot_statistic, reattach
from quakeweave.operators.spatial import fit_curve
from quakeweave.runtime import cut_lineage


def require(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    return df


def scatter(df: DataFrame, x: str, values: list[str], keep: list[str] = ()) -> DataFrame:
    """One row per value column; an axis that is not numeric is numbered by first appearance in order of its labels."""
    long = df.select(x, *keep, F.explode(F.array(*[F.struct(F.lit(v).alias("dependent"), finite(v).alias("value")) for v in values])).alias("m")).select(x, *keep, "m.*").where(F.col("value").isNotNull())
    if isinstance(df.schema[x].dataType, T.StringType):
        rank = df.select(x).where(F.col(x).isNotNull()).distinct().withColumn("x_position", F.row_number().over(Window.orderBy(x)) - 1)
        return reattach(long, rank, [x])
    return long.withColumn("x_position", finite(x))


def fitted_curves(df: DataFrame, x: str, y: str, groups: list[str], method: str = "linear") -> DataFrame:
    """A fitted curve per group as rows of x, y and r2. Groups are the series of a figure."""
    schema = T.StructType([*[df.schema[g] for g in groups], *[T.StructField(n, t) for n, t in (("method", T.StringType()), ("x", T.DoubleType()), ("y", T.DoubleType()), ("r2", T.DoubleType()))]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = fit_curve(pdf[x], pdf[y], method)
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] * len(f["x"]) for g in groups}, "method": f["method"], "x": f["x"], "y": f["y"], "r2": f["r2"]}, columns=schema.names)

    return df.select(*groups, x, y).groupBy(*groups).applyInPandas(run, schema)


def box_statistics(df: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """Quartiles, whiskers at 1.5 IQR, count and outliers per group."""
    v = finite(value)
    q = aggregate(df, groups, [F.count(v).alias("n")], {"q25": (v, 0.25), "median": (v, 0.5), "q75": (v, 0.75)})
    inside = v.between(F.col("q25") - 1.5 * (F.col("q75") - F.col("q25")), F.col("q75") + 1.5 * (F.col("q75") - F.col("q25")))
    w = reattach(df, q, groups).groupBy(*groups).agg(F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"), F.count_if(v.isNotNull() & ~inside).alias("outliers"))
    return reattach(q, w, groups)


def record_section(df: DataFrame, distance: str = "distance_km") -> DataFrame:
    """Traces scaled to their greatest value, in order of distance."""
    return df.withColumn("trace", normalized("trace")).orderBy(finite(distance).asc_nulls_last(), *existing(df, ["station"]))


def markers(df: DataFrame, value: str, lat: str, lon: str, most: int = 2_000) -> DataFrame:
    """The positions with the greatest absolute values, a report of the top ``most``."""
    rows = df.where(finite(lat).isNotNull() & finite(lon).isNotNull())
    return rows.orderBy(F.abs(finite(value)).desc_nulls_last(), *existing(df, ["station", "event_id"])).limit(most)


def coverage(df: DataFrame, group: str, counted: str, top: int | None = None) -> DataFrame:
    """Distinct ``counted`` per ``group``, the largest first."""
    out = df.groupBy(group).agg(F.count_distinct(counted).alias("n")).orderBy(F.desc("n"), group)
    return out.limit(top) if top else out


def coverage_totals(df: DataFrame) -> DataFrame:
    coords = existing(df, ["event_lat", "event_lon", "lat", "lon", "sta_lat", "sta_lon"])
    missing = F.lit(False)
    for c in coords:
        missing = missing | finite(c).isNull()
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("event_id").alias("events"), F.count_distinct("station").alias("stations"), F.count_if(missing).alias("rows_missing_coordinates"))


def record_spans(traces: DataFrame, *, on_missing: str = "drop") -> DataFrame:
    """Start and end relative to the origin of both sides of each event and station; rows that lack a side are dropped or raise ValueError."""
    t = traces.withColumns({"s": F.unix_micros("starttime") / 1e6 - F.unix_micros("origin_time") / 1e6, "e": F.unix_micros("endtime") / 1e6 - F.unix_micros("origin_time") / 1e6})
    of = lambda f, c, k: f(F.when(F.col("source") == k, F.col(c)))
    out = t.groupBy("event_id", "station").agg(of(F.min, "s", "observed").alias("observed_start_s"), of(F.max, "e", "observed").alias("observed_end_s"), of(F.min, "s", "synthetic").alias("synthetic_start_s"), of(F.max, "e", "synthetic").alias("synthetic_end_s"))
    whole = F.col("observed_start_s").isNotNull() & F.col("synthetic_start_s").isNotNull()
    if on_missing == "raise" and not out.where(~whole).isEmpty():
        raise ValueError("records lack a side")
    return out.where(whole).withColumns({"overlap_s": F.least("observed_end_s", "synthetic_end_s") - F.greatest("observed_start_s", "synthetic_start_s")})


def value_limits(df: DataFrame, value: str, *, diverging: bool) -> DataFrame:
    """Limits of a colour scale: symmetric about 0, or the range."""
    v = finite(value)
    r = df.agg(F.min(v).alias("low"), F.max(v).alias("high"))
    if not diverging:
        return r
    top = F.greatest(F.abs("low"), F.abs("high"))
    return r.select((-top).alias("low"), top.alias("high"))


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(present(F.col(column).cast("string")), F.lit("unknown")).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def availability_matrix(df: DataFrame) -> DataFrame:
    """Station by event: 1 for an observed record, 2 for a synthetic one, 3 for both."""
    code = F.col("observed_available").cast("int") + 2 * F.col("synthetic_available").cast("int")
    return pivot_statistic(df.withColumn("code", code), "station", "event_id", "code", "max")


def shown(df: DataFrame, columns: list[str] | None = None, labels: dict[str, str] | None = None, rows: int | None = None) -> DataFrame:
    """Columns under their display names, the first rows only if ``rows`` is given."""
    out = df.select(*[F.col(c).alias((labels or {}).get(c, c.replace("_", " ").capitalize())) for c in (columns or df.columns) if c in df.columns])
    return out.limit(rows) if rows else out


def nearest_records(df: DataFrame, *, most_km: float = 50.0, most: int = 12) -> DataFrame:
    """The nearest records within a distance, in order of distance, event and station."""
    return df.where(finite("distance_km") <= most_km).orderBy("distance_km", "event_id", "station").limit(most)


def with_distance(df: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    return df.withColumn("distance_km", haversine_km(*a, *b))


def batches(df: DataFrame, rows: int, order: str) -> DataFrame:
    """Rows numbered into slices of a fixed size by a sortable key; slices are counted from range partitions, not in one task."""
    at = df.repartitionByRange(order).sortWithinPartitions(order)
    schema = T.StructType([*df.schema.fields, T.StructField("__own", T.LongType())])

    def number(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = 0
        for pdf in parts:
            yield pdf.assign(__own=range(seen, seen + len(pdf)))
            seen += len(pdf)

    own = cut_lineage(at.mapInPandas(number, schema).withColumn("__part", F.spark_partition_id()), "slices")
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = own.groupBy("__part").agg((F.max("__own") + 1).alias("__count")).select("__part", F.coalesce(F.sum("__count").over(w), F.lit(0)).alias("__before"))
    return own.join(F.broadcast(before), "__part").withColumn("batch", F.floor((F.col("__before") + F.col("__own")) / rows)).drop("__part", "__own", "__before")
