"""Event tables for geologic contrasts, and the tests on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeweave.functions.geodesy import hypocentral_km
from quakeweave.functions.labels import finite
from quakeweave.functions.residuals import percent_from_log2
from quakeweave.operators.metrics import collapse_and_demean, pivot_statistic
from quakeweave.operators.spatial import bootstrap_contrast, kruskal_wallis, moran_by, morans_i
from quakeweave.runtime import cut_lineage

# Default contrasts as name, left zones, right zones, column.
CONTRASTS = (
    ("target_region_inside_minus_outside", ("target_region_interior", "target_region_edge_inside"), ("target_region_edge_outside", "outside_target_region"), "target_region_zone"),
    ("target_region_edge_inside_minus_outside", ("target_region_edge_inside",), ("target_region_edge_outside", "outside_target_region"), "target_region_zone"),
    ("Basin_minus_Mountains", ("Basin",), ("Mountains",), "mapped_region_type"),
)


def scaled_events(df: DataFrame, keys: list[str], *, datasets: tuple[str, ...] = ("observed",), demean: bool = True, pooled: bool = False) -> DataFrame:
    """ln(value times hypocentral distance) of observed (and synthetic) values above 0, by default less the event's mean.

    With both datasets, only rows that have both values take part; ``pooled`` means over both.
    """
    r = hypocentral_km("distance_km", "depth_km" if "depth_km" in df.columns else F.lit(None))
    o, s = finite("value_obs"), finite("value_syn")
    rows = df.where((o > 0) & (s > 0)) if len(datasets) > 1 else df.where((o if datasets[0] == "observed" else s) > 0)
    sides = {"observed": o, "synthetic": s}
    each = rows.withColumn("d", F.explode(F.array(*[F.struct(F.lit(n).alias("dataset"), F.ln(sides[n] * r).alias("value")) for n in datasets])))
    long = each.select(*[k for k in keys if k != "dataset"], "event_id", "station", "d.dataset", "d.value")
    if not demean:
        return long
    own = [k for k in keys if k not in ("dataset", "event_id", "station")]
    return collapse_and_demean(long, ["dataset", *own, "event_id", "station"], ["dataset", *own, "event_id"], "value", pooled=pooled)


def residual_events(df: DataFrame, keys: list[str], *, distinct: bool = False) -> DataFrame:
    """log2 of observed over synthetic, both above 0, less the event's mean; repeated rows count once if ``distinct``."""
    o, s = finite("value_obs"), finite("value_syn")
    rows = df.where((o > 0) & (s > 0))
    rows = rows.dropDuplicates([*keys, "event_id", "station", "value_obs", "value_syn"]) if distinct else rows
    return collapse_and_demean(rows.withColumn("value", F.log2(o / s)), [*keys, "event_id", "station"], [*keys, "event_id"], "value")


def fingerprint(df: DataFrame, feature: str, value: str, *, least: int = 1, wanted: list | None = None, prefix: str = "") -> DataFrame:
    """Station by feature means with ``features_present``; stations with fewer than ``least`` go."""
    wide = pivot_statistic(df, "station", feature, value, "mean", wanted)
    cols = [c for c in wide.columns if c != "station"]
    there = reduce(lambda a, c: a + F.col(f"`{c}`").isNotNull().cast("int"), cols, F.lit(0))
    named = wide.withColumn("features_present", there).where(F.col("features_present") >= least)
    return named.withColumnsRenamed({c: f"{prefix}{c}" for c in cols}) if prefix else named


def contrast_table(rows: DataFrame, contrasts, *, value: str = "field_centered", log2: bool = True, samples: int = 500, seed: int = 20260529) -> DataFrame:
    """One row per contrast that can be made: estimate, bounds, p, percent effect, and whether the bounds leave out 0."""
    parts = [bootstrap_contrast(rows, column, list(left), list(right), value=value, samples=samples, seed=seed).withColumn("contrast", F.lit(name)) for name, left, right, column in contrasts if column in rows.columns]
    if not parts:
        raise ValueError("no contrast column")
    out = reduce(DataFrame.unionByName, parts)
    percent = percent_from_log2("estimate") if log2 else F.lit(None).cast("double")
    return out.withColumns({"percent_effect": percent, "ci_excludes_zero": (F.col("ci_low") > 0) | (F.col("ci_high") < 0), "significant": F.col("p_value") < 0.05})


def spatial_tests(stations: DataFrame, value: str, zone: str, *, k: int = 8) -> DataFrame:
    """One row: Kruskal-Wallis over zones and Moran's I of a station table."""
    kw = kruskal_wallis(stations, value, zone).select("h", "df", "p_value")
    return morans_i(stations, value, k=k).join(kw, F.lit(True), "left")


def grouped_tests(rows: DataFrame, by: list[str], zone: str, contrasts: list[tuple], *, value: str = "field_centered", k: int = 8, permutations: int = 999, samples: int = 500, seed: int = 42) -> DataFrame:
    """The tests of zones for every group of ``by``, one row per test: ``test``, ``statistic``, ``p_value``, ``n``, bounds for contrasts.

    ``rows`` are centred values with station and position. Kruskal-Wallis and Moran's I (with
    a permutation p-value) take station means. Contrasts are (name, left zones, right zones).
    All groups run in the same plans.
    """
    v = finite(value)
    stations = cut_lineage(rows.where(v.isNotNull()).groupBy(*by, "station").agg(F.avg(v).alias("v"), F.min(F.struct("lat", "lon")).alias("at"), F.min(zone).alias(zone)).select(*by, "station", "v", "at.lat", "at.lon", zone), "zones")
    none = F.lit(None).cast("double")
    cols = lambda test, stat, p, n, low=none, high=none: [*by, F.lit(test).alias("test"), stat.alias("statistic"), p.alias("p_value"), n.cast("bigint").alias("n"), low.alias("ci_low"), high.alias("ci_high")]
    kw = kruskal_wallis(stations, "v", zone, by=by).select(*cols("kruskal_wallis", F.col("h"), F.col("p_value"), F.col("n")))
    moran = moran_by(stations, by, "v", k=k, permutations=permutations, seed=seed).select(*cols("moran_i", F.col("moran_i"), F.col("p_two_sided"), F.col("n")))
    parts = [kw, moran]
    for name, left, right in contrasts:
        c = bootstrap_contrast(rows, zone, list(left), list(right), value=value, by=by, samples=samples, seed=seed)
        parts.append(c.select(*cols(name, F.col("estimate"), F.col("p_value"), F.col("n_left") + F.col("n_right"), F.col("ci_low"), F.col("ci_high"))))
    return reduce(DataFrame.unionByName, parts)


def select_anchors(df: DataFrame, strategy: str = "all", *, key: str = "event_id", column: str | None = None, top: int | None = None, value=None, where: str | None = None) -> DataFrame:
    """Anchors of corridors: all, by id, by a SQL condition, or the first by a column (``max``, ``min``), ``top`` of them."""
    if strategy == "id":
        return df.where(F.col(key).cast("string") == str(value))
    if strategy == "where":
        return df.where(F.expr(where))
    if strategy in ("max", "min"):
        c = finite(column)
        return df.orderBy((c.desc_nulls_last() if strategy == "max" else c.asc_nulls_last()), key).limit(top or 1)
    if strategy != "all":
        raise ValueError(f"unknown strategy {strategy}")
    return df
