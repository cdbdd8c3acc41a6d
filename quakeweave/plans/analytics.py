"""Queries of the metric, spatial and quality-control operators, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakeweave.functions import geodesy as G
from quakeweave.functions import labels as L
from quakeweave.functions import residuals as R
from quakeweave.functions import text as X
from quakeweave.functions import traces as TR
from quakeweave.functions.labels import finite
from quakeweave.operators import clustering as ML
from quakeweave.operators import figures as V
from quakeweave.operators import geometry as GE
from quakeweave.operators import joins as J
from quakeweave.operators import metrics as M
from quakeweave.operators import normalize as N
from quakeweave.operators import qc as Q
from quakeweave.operators import selection as SEL
from quakeweave.operators import spatial as SP
from quakeweave.operators import workflow as W
from quakeweave.plans.fixtures import azi, hav, r6, r8, rounded, view, with_views
from quakeweave.runtime import cut_lineage, table
from quakeweave.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True, digits: int = 6):
    """Register a query under its function's name, with the SQL that gives the same rows to some digits."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, d: rounded(f(spark, d), digits)
        if sql:
            SQL[f.__name__] = with_views(sql) if views else sql
        return f

    return add


def _horner(c: tuple[float, ...], x: str) -> str:
    out = repr(c[0])
    for k in c[1:]:
        out = f"({out} * {x} + {k!r})"
    return out


_X2 = "abs(2 * (value_obs - value_syn) / (value_obs + value_syn))"
_ERFC = (
    f"CASE WHEN x <= 0.46875e0 THEN 1 - x * {_horner(R._ERF_NUM, '(x * x)')} / {_horner(R._ERF_DEN, '(x * x)')} ELSE exp(-x * x) * {_horner(R._ERFC_NUM, 'x')} / {_horner(R._ERFC_DEN, 'x')} END"
)
_RES = "res AS (SELECT *, value_obs - value_syn AS residual, log2(value_obs / value_syn) AS log2_residual, ln(value_obs / value_syn) AS ln_residual FROM v_metrics WHERE value_syn > 0 AND value_obs > 0)"


def metrics(spark: SparkSession, d: str, *, lookup: bool = False) -> DataFrame:
    """The metric view with its transforms."""
    return R.add_transforms(view(spark, d, "v_metrics", lookup=lookup), transforms=["residual", "log2_residual", "ln_residual"])


# ---------------------------------------------------------------- transforms and summaries


@query(
    f"""WITH t AS (SELECT *, {_X2} AS x, (value_obs - value_syn) / least(value_obs, value_syn) AS g FROM v_metrics)
SELECT row_id, {r6("value_obs - value_syn")} AS residual, {r6("log2(value_obs / value_syn)")} AS log2_residual, {r6("ln(value_obs / value_syn)")} AS ln_residual,
 {r6("least(10, 10 * exp(-g * g))")} AS anderson_2004_gof, {r6(f"100 * ({_ERFC})")} AS olsen_mayhew_gof, {r6("10 * pow(0.5, abs(g))")} AS decay_score FROM t"""
)
def metric_transforms(spark, d):
    """All five comparisons of observed and synthetic values, and the decay score."""
    m = R.add_transforms(view(spark, d, "v_metrics"))
    return m.select("row_id", *R.TRANSFORMS, R.decay_score("value_obs", "value_syn").alias("decay_score"))


_STATS = f"count(v) AS n, {r6('avg(v)')} AS mean, {r6('median(v)')} AS median, {r6('stddev_samp(v)')} AS std, {r6('quantile_cont(v, 0.75) - quantile_cont(v, 0.25)')} AS iqr"


@query(f"WITH {_RES} SELECT model, metric, band, {_STATS} FROM (SELECT *, log2_residual AS v FROM res) GROUP BY ALL")
def model_metric_band_summary(spark, d):
    """Count, mean, median, deviation and IQR of the log2 residual by model, metric and band."""
    return M.summarize(metrics(spark, d), "log2_residual", ["model", "metric", "band"])


@query(
    f"""WITH s AS (SELECT model, station, band, least(10, 10 * exp(-pow((value_obs - value_syn) / least(value_obs, value_syn), 2))) AS a, 10 * pow(0.5, abs((value_obs - value_syn) / least(value_obs, value_syn))) AS b FROM v_metrics)
SELECT model, station, band, {r6("avg(a)")} AS anderson_mean, {r6("median(a)")} AS anderson_median, {r6("stddev_samp(a)")} AS anderson_std, count(a) AS anderson_count,
 {r6("avg(b)")} AS decay_mean, {r6("median(b)")} AS decay_median, {r6("stddev_samp(b)")} AS decay_std, count(b) AS decay_count FROM s GROUP BY ALL"""
)
def score_summary(spark, d):
    m = view(spark, d, "v_metrics").withColumns({"anderson": R.anderson_2004_gof("value_obs", "value_syn"), "decay": R.decay_score("value_obs", "value_syn")})
    return M.summarize_scores(m, ["model", "station", "band"], ["anderson", "decay"])


@query(f"WITH {_RES}, e AS (SELECT model, station, event_id, avg(log2_residual) AS v FROM res GROUP BY ALL) SELECT model, station, {r6('avg(v)')} AS log2_residual, count(*) AS n_events FROM e GROUP BY ALL")
def station_mean_over_events(spark, d):
    """Mean over events of event means, each event weighing the same."""
    return M.mean_over_events(metrics(spark, d), "log2_residual", ["model", "station"])


@query(f"WITH {_RES} SELECT station, {r6('avg(log2_residual)')} AS log2_residual, {r6('avg(value_obs)')} AS value_obs FROM res GROUP BY ALL")
def station_means(spark, d):
    return M.group_means(metrics(spark, d), ["station"], ["log2_residual", "value_obs"])


@query(f"WITH {_RES} SELECT metric, {r6('median(log2_residual) FILTER (model = $$cvmsi$$)')} AS cvmsi, {r6('median(log2_residual) FILTER (model = $$cvms5$$)')} AS cvms5 FROM res GROUP BY ALL")
def model_metric_heatmap(spark, d):
    """Metric by model matrix of median residuals."""
    return M.pivot_statistic(metrics(spark, d), "metric", "model", "log2_residual", "median", ["cvmsi", "cvms5"])


_FEATURES = ["PGA", "PGV", "PGD", "PSA", "FAS", "CAV", "arias_duration"]


def _wide(spark, d) -> DataFrame:
    m = view(spark, d, "v_metrics")
    cells = [F.max(F.when(F.col("metric") == s, F.col(c))).alias(f"{s}_{k}") for s in _FEATURES for c, k in (("value_obs", "obs"), ("value_syn", "syn"))]
    return m.groupBy("event_id", "station", "model").agg(*cells)


@query(
    f"""WITH k AS (SELECT DISTINCT event_id, station, model FROM v_metrics), g AS (SELECT * FROM k, (SELECT unnest({_FEATURES}) AS metric)),
w AS (SELECT event_id, station, model, metric, max(value_obs) AS o, max(value_syn) AS s FROM v_metrics GROUP BY ALL)
SELECT event_id, station, model, metric, {r6("o")} AS value_obs, {r6("s")} AS value_syn, {r6("log10(s / o)")} AS residual, CAST(NULL AS DOUBLE) AS score FROM g LEFT JOIN w USING (event_id, station, model, metric)"""
)
def wide_to_long(spark, d):
    """Wide metric columns to long rows with the wide tables' residual."""
    return M.wide_to_long(_wide(spark, d), ["event_id", "station", "model"])


# ---------------------------------------------------------------- paths

_PATHS = f"""paths AS (SELECT m.*, e.event_lat, e.event_lon, e.magnitude, s.lat AS sta_lat, s.lon AS sta_lon, {hav("e.event_lat", "e.event_lon", "s.lat", "s.lon")} AS distance_km, {azi("e.event_lat", "e.event_lon", "s.lat", "s.lon")} AS azimuth_deg
 FROM res m JOIN v_events e USING (event_id) JOIN v_stations s USING (station))"""


def _paths(spark, d, m: DataFrame | None = None) -> DataFrame:
    """Metrics with event, station and path."""
    e = view(spark, d, "v_events").drop("event_name", "depth_km")
    s = view(spark, d, "v_stations").select("station", F.col("lat").alias("sta_lat"), F.col("lon").alias("sta_lon"))
    return G.add_path_geometry((metrics(spark, d) if m is None else m).join(e, "event_id").join(s, "station"))


@query(
    f"""SELECT event_id, upper(station) AS station, {r6(hav("event_lat", "event_lon", "lat", "lon"))} AS distance_km, round({azi("event_lat", "event_lon", "lat", "lon")}, 4) % 360 AS azimuth_deg, round({azi("lat", "lon", "event_lat", "event_lon")}, 4) % 360 AS backazimuth_deg
FROM v_events, v_stations"""
)
def event_station_paths(spark, d):
    """All pairs of events and stations with distance, azimuth and true back azimuth."""
    t = J.event_station_table(view(spark, d, "v_stations").select("station", "lat", "lon"), view(spark, d, "v_events").select("event_id", "event_lat", "event_lon"))
    turn = lambda c: F.pmod(F.round(c, 4), F.lit(360.0)).alias(c)
    return t.select("event_id", "station", "distance_km", turn("azimuth_deg"), turn("backazimuth_deg"))


@query(
    f"WITH {_RES}, {_PATHS} SELECT model, metric, floor(distance_km / 10) * 10e0 AS distance_bin_km, floor(azimuth_deg / 30) * 30e0 AS azimuth_bin_deg, {r6('avg(log2_residual)')} AS mean_residual, {r6('median(log2_residual)')} AS median_residual, count(*) AS n FROM paths GROUP BY ALL"
)
def path_bin_summary(spark, d):
    return M.path_bins(_paths(spark, d), ["model", "metric"], "log2_residual")


_MEDS = f"{r8('median(residual)')} AS med_resid, {r8('median(log2_residual)')} AS med_log2_residual, {r8('median(ln_residual)')} AS med_ln_residual, {r8('median(value_obs)')} AS med_value_obs, {r8('median(value_syn)')} AS med_value_syn"


def _cubes(spark, d) -> dict[str, DataFrame]:
    m = _paths(spark, d).drop("anderson_2004_gof", "olsen_mayhew_gof", "backazimuth_deg")
    return M.dashboard_cubes(m)


@query(f"WITH {_RES} SELECT model, metric, band, component, {r8('quantile_cont(residual, 0.75) - quantile_cont(residual, 0.25)')} AS \"IQR\", count(*) AS n, {_MEDS} FROM res GROUP BY ALL", digits=8)
def dashboard_model_metric_band(spark, d):
    return M.dashboard_cubes(metrics(spark, d).drop("anderson_2004_gof", "olsen_mayhew_gof"))["model_metric_band"]


@query(f"WITH {_RES}, {_PATHS} SELECT station, {r8('sta_lat')} AS sta_lat, {r8('sta_lon')} AS sta_lon, model, metric, band, component, {r8('median(distance_km)')} AS med_dist_km, count(*) AS n, {_MEDS} FROM paths GROUP BY ALL", digits=8)
def dashboard_station_rollup(spark, d):
    return _cubes(spark, d)["station_rollup"]


@query(f"WITH {_RES}, {_PATHS} SELECT event_id, {r8('event_lat')} AS event_lat, {r8('event_lon')} AS event_lon, magnitude, model, metric, band, component, {r8('median(distance_km)')} AS med_dist_km, count(*) AS n, {_MEDS} FROM paths GROUP BY ALL", digits=8)
def dashboard_event_rollup(spark, d):
    m = metrics(spark, d, lookup=True).select("event_id", "station", "model", "metric", "band", "component", "residual", "log2_residual", "ln_residual", "value_obs", "value_syn")
    s = view(spark, d, "v_stations").select("station", F.col("lat").alias("sta_lat"), F.col("lon").alias("sta_lon"))
    few = s.count() <= SP.BROADCAST_STATIONS
    e = view(spark, d, "v_events").drop("event_name", "depth_km")
    # Joined by event last: an event's rows are brought together once, for its position and for its groups.
    paths = m.join(F.broadcast(s) if few else s, "station").join(e, "event_id")
    m = G.add_path_geometry(paths).drop("backazimuth_deg")
    return M.dashboard_cubes(m, only="event_rollup", rows=(view(spark, d, "v_metrics", lookup=True), ["event_id"]))["event_rollup"]


@query(f"WITH {_RES}, {_PATHS} SELECT model, metric, band, component, floor(distance_km / 10) * 10e0 AS dist_bin_km, floor(azimuth_deg / 10) * 10e0 AS az_bin_deg, count(*) AS n, {_MEDS} FROM paths GROUP BY ALL", digits=8)
def dashboard_path_hex(spark, d):
    return _cubes(spark, d)["path_hex"]


@query(f"WITH {_RES}, {_PATHS} SELECT model, {r6('regr_slope(log2_residual, distance_km)')} AS slope, {r6('regr_intercept(log2_residual, distance_km)')} AS intercept, {r6('corr(log2_residual, distance_km)')} AS r, count(*) AS n FROM paths GROUP BY ALL")
def distance_trend(spark, d):
    """Slope, intercept and correlation of residual against distance."""
    return SP.line_fit(_paths(spark, d), "distance_km", "log2_residual", ["model"])


@query(f"WITH {_RES}, {_PATHS} SELECT (floor(sta_lon / 0.25e0) * 0.25e0 + 0.125e0) AS lon, (floor(sta_lat / 0.25e0) * 0.25e0 + 0.125e0) AS lat, {r6('avg(log2_residual)')} AS log2_residual, count(*) AS n FROM paths GROUP BY ALL")
def residual_grid(spark, d):
    return M.grid_means(_paths(spark, d), "sta_lon", "sta_lat", "log2_residual", 0.25)


# ---------------------------------------------------------------- event centring and bias

_CENTRE = """st AS (SELECT event_id, avg(log2_residual) AS event_mean, stddev_samp(log2_residual) AS event_std, count(DISTINCT station) AS event_station_count FROM res GROUP BY 1),
c AS (SELECT r.*, event_mean, event_std, event_station_count, log2_residual - event_mean AS field_centered, CASE WHEN event_std > 0 THEN (log2_residual - event_mean) / event_std END AS field_z FROM res r JOIN st USING (event_id) WHERE event_station_count >= 2)"""


def _field(spark, d, *, lookup: bool = False) -> DataFrame:
    """Rows with their station; with ``lookup``, stations are broadcast where they are few."""
    s = view(spark, d, "v_stations", lookup=lookup).select("station", "lat", "lon", "mapped_region_type")
    if lookup and s.count() <= SP.BROADCAST_STATIONS:
        s = F.broadcast(s)
    return metrics(spark, d, lookup=lookup).join(s, "station").withColumn("field_value", F.col("log2_residual"))


@query(f"WITH {_RES}, {_CENTRE} SELECT row_id, {r6('event_mean')} AS event_mean, {r6('event_std')} AS event_std, event_station_count, {r6('field_centered')} AS field_centered, {r6('field_z')} AS field_z FROM c")
def event_centered_field(spark, d):
    """Each value less its event's mean, and in units of its deviation."""
    return M.center_by_event(_field(spark, d)).select("row_id", "event_mean", "event_std", "event_station_count", "field_centered", "field_z")


@query(
    f"""WITH {_RES}, st AS (SELECT event_id, avg(log2_residual) AS m, count(DISTINCT station) AS n FROM res WHERE component = 'Z' GROUP BY 1)
SELECT row_id, {r6("m")} AS event_mean, n AS event_station_count, {r6("log2_residual - m")} AS field_centered FROM res JOIN st USING (event_id) WHERE n >= 3"""
)
def reference_centered_field(spark, d):
    """Event means from the vertical component only, taken off all components."""
    c = M.center_by_event(_field(spark, d), least_stations=3, reference=F.col("component") == "Z")
    return c.select("row_id", "event_mean", "event_station_count", "field_centered")


@query(
    f"""WITH {_RES}, {_CENTRE}, b AS (SELECT station, avg(lat) AS lat, avg(lon) AS lon, count(DISTINCT event_id) AS n_events, avg(field_centered) AS m, median(field_centered) AS med, stddev_samp(field_centered) AS sd FROM c JOIN v_stations USING (station) GROUP BY 1)
SELECT station, {r6("lat")} AS lat, {r6("lon")} AS lon, n_events, {r6("m")} AS mean_centered, {r6("med")} AS median_centered, {r6("sd")} AS std_centered, {r6("sd / sqrt(n_events)")} AS sem_centered, {r6("abs(m)")} AS abs_mean, round(m / (sd / sqrt(n_events)), 4) AS z_score FROM b"""
)
def event_demeaned_station_bias(spark, d):
    b = M.station_bias(M.center_by_event(_field(spark, d)))
    return b.withColumn("z_score", F.round("z_score", 4))


@query(
    f"""WITH {_RES}, k AS (SELECT station, event_id, metric, model, avg(log2_residual) AS raw, count(*) AS n_rows FROM res GROUP BY ALL), e AS (SELECT event_id, metric, avg(raw) AS m FROM k GROUP BY ALL)
SELECT station, event_id, metric, model, {r6("raw")} AS value_raw, n_rows, {r6("m")} AS event_mean, {r6("raw - m")} AS value FROM k JOIN e USING (event_id, metric)"""
)
def pooled_reference_demean(spark, d):
    """Cell means less the event's mean over both models together."""
    return M.collapse_and_demean(metrics(spark, d), ["station", "event_id", "metric", "model"], ["event_id", "metric", "model"], "log2_residual", pooled=True, dataset="model")


@query(
    f"""WITH {_RES}, a AS (SELECT metric, model, station, avg(value_obs) AS m FROM res GROUP BY ALL), g AS (SELECT metric, model, avg(m) AS gm FROM a GROUP BY ALL)
SELECT metric, model, station, {r6("m")} AS station_mean, {r6("gm")} AS group_mean, {r6("m - gm")} AS anomaly FROM a JOIN g USING (metric, model)"""
)
def station_anomalies(spark, d):
    return SP.anomaly(metrics(spark, d), ["metric", "model"], "value_obs")


@query(
    """SELECT event_id, min_by(event_name, row_id) AS event_name, round(avg(magnitude), 6) + 0e0 AS event_magnitude, round(avg(event_lat), 6) + 0e0 AS event_lat, round(avg(event_lon), 6) + 0e0 AS event_lon, count(DISTINCT station) AS n_stations
FROM v_metrics JOIN v_events USING (event_id) GROUP BY 1"""
)
def event_locations(spark, d):
    m = view(spark, d, "v_metrics").join(view(spark, d, "v_events").withColumnRenamed("magnitude", "event_magnitude"), "event_id")
    return M.event_locations(m, "row_id")


# ---------------------------------------------------------------- pairs, neighbours, correlation

_PAIRS = f"""f AS (SELECT DISTINCT event_id, station, lat, lon, v FROM (SELECT event_id, station, avg(field_centered) AS v FROM c GROUP BY 1, 2) JOIN v_stations USING (station)),
p AS (SELECT a.event_id, a.station AS s1, b.station AS s2, a.v AS va, b.v AS vb, {hav("a.lat", "a.lon", "b.lat", "b.lon")} AS km, ({azi("a.lat", "a.lon", "b.lat", "b.lon")}) AS az FROM f a JOIN f b ON a.event_id = b.event_id AND a.station < b.station)"""


def _pair_field(spark, d) -> DataFrame:
    """Mean centred value by event and station: the same as from ``center_by_event``, but rows are shuffled once, by event, with no more than their value."""
    # A station counts once in an event, at the least of its positions as in ``station_pairs``; others would only be listed to be left out there.
    at = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon"))
    st = view(spark, d, "v_stations", lookup=True).groupBy("station").agg(F.min(at).alias("p"), F.count(F.lit(1)).alias("k"))
    rows = metrics(spark, d, lookup=True).select("event_id", "station", finite("log2_residual").alias("x"))
    # Rows without an event have no pair. Summing up by station before the shuffle would add one and hardly spare rows.
    known = rows.where(F.col("event_id").isNotNull()).repartition("event_id")
    cells = known.groupBy("event_id", "station").agg(F.sum("x").alias("v"), F.count("x").alias("n")).where(F.col("n") > 0)
    few = view(spark, d, "v_stations").count() <= SP.BROADCAST_STATIONS
    # Positions are looked up where an event's rows are, so that they are not shuffled with them.
    joined = cells.join(F.broadcast(st) if few else st, "station")
    # A station that is listed several times counts as often in its event's mean.
    event = Window.partitionBy("event_id")
    c = joined.withColumns({"mean": F.sum(F.col("v") * F.col("k")).over(event) / F.sum(F.col("n") * F.col("k")).over(event), "m": F.count(F.lit(1)).over(event)})
    return c.where(F.col("m") >= 2).select("event_id", "station", "p.*", (F.col("v") / F.col("n") - F.col("mean")).alias("field_centered"))


def _pairs(spark, d) -> DataFrame:
    """Pairs of stations within events."""
    return SP.station_pairs(_pair_field(spark, d), rows=view(spark, d, "v_metrics", lookup=True))


@query(
    f"""WITH {_RES}, {_CENTRE}, {_PAIRS}, g AS (SELECT CAST(floor(km / 10) AS INTEGER) AS distance_bin, count(*) AS n, avg(va * vb) AS mp, avg(pow(va - vb, 2) / 2) AS sv, avg(km) AS mk FROM p WHERE km < 200 GROUP BY 1)
SELECT CAST(r.range AS INTEGER) AS distance_bin, coalesce(n, 0) AS pair_count, {r6("mp")} AS mean_product, {r6("sv")} AS semivariance, {r6("mk")} AS mean_distance_km, r.range * 10e0 AS distance_start_km, (r.range + 0.5e0) * 10e0 AS distance_center_km FROM range(20) r LEFT JOIN g ON g.distance_bin = r.range"""
)
def distance_bin_semivariance(spark, d):
    """Product and semivariance of station pairs within events, by distance."""
    return SP.pair_bins(_pairs(spark, d))


@query(
    f"""WITH {_RES}, {_CENTRE}, {_PAIRS}, g AS (SELECT CAST(floor(((az % 180) + 22.5e0) % 180 / 45) AS INTEGER) AS sector, CAST(floor(km / 50) AS INTEGER) AS distance_bin, count(*) AS n, avg(va * vb) AS mp, avg(pow(va - vb, 2) / 2) AS sv FROM p WHERE km < 200 GROUP BY 1, 2)
SELECT s.range AS sector, r.range AS distance_bin, coalesce(n, 0) AS pair_count, {r6("mp")} AS mean_product, {r6("sv")} AS semivariance FROM range(4) s CROSS JOIN range(4) r LEFT JOIN g ON g.distance_bin = r.range AND g.sector = s.range"""
)
def directional_semivariance(spark, d):
    b = SP.pair_bins(_pairs(spark, d), bin_km=50.0, sector_deg=45.0)
    return b.select(F.col("sector").cast("bigint"), F.col("distance_bin").cast("bigint"), "pair_count", "mean_product", "semivariance")


@query()
def correlation_length(spark, d):
    """Length of an exponential fitted to the correlation by distance."""
    b = SP.pair_bins(_pairs(spark, d))
    return SP.correlation_lengths(b.withColumn("all", F.lit("all")), ["all"])


_KNN = f"knn AS (SELECT a.station, b.station AS neighbour, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS distance_km FROM v_stations a, v_stations b WHERE a.station <> b.station QUALIFY row_number() OVER (PARTITION BY a.station ORDER BY round(distance_km, 9), b.station) <= 2)"


@query(f"WITH {_KNN} SELECT station, count(*) AS n, {r6('min(distance_km)')} AS nearest_km, {r6('max(distance_km)')} AS farthest_km FROM knn GROUP BY 1")
def nearest_stations(spark, d):
    n = SP.nearest_neighbours(view(spark, d, "v_stations"), 2)
    return n.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.min("distance_km").alias("nearest_km"), F.max("distance_km").alias("farthest_km"))


@query(
    f"""WITH {_RES}, {_CENTRE}, {_KNN}, b AS (SELECT station, avg(field_centered) AS v FROM c GROUP BY 1), z AS (SELECT station, v - (SELECT avg(v) FROM b) AS z FROM b),
n AS (SELECT knn.station, neighbour FROM knn WHERE station IN (SELECT station FROM b) AND neighbour IN (SELECT station FROM b))
SELECT (SELECT count(*) FROM z) AS n, CAST(2 AS INTEGER) AS k, {r6("(SELECT count(*) FROM z) / CAST((SELECT count(*) FROM n) AS DOUBLE) * (SELECT sum(p.z * q.z) FROM n JOIN z p USING (station) JOIN z q ON q.station = neighbour) / (SELECT sum(z * z) FROM z)")} AS moran_i"""
)
def global_morans_i(spark, d):
    return SP.morans_i(M.station_bias(M.center_by_event(_field(spark, d))))


@query()
def moran_permutation_test(spark, d):
    return SP.moran_test(M.station_bias(M.center_by_event(_field(spark, d))), permutations=99)


@query()
def block_holdout_skill(spark, d):
    """Prediction of left-out spatial blocks from the other stations."""
    return SP.block_holdout(_field(spark, d, lookup=True).select("event_id", "station", "lat", "lon", "field_value"), size_km=20.0)


@query()
def region_contrast_bootstrap(spark, d):
    return SP.bootstrap_contrast(M.center_by_event(_field(spark, d)), "mapped_region_type", ["ASIA"], ["EUROPE"], samples=100)


@query(
    """WITH x AS (SELECT mapped_region_type AS g, vs30 AS v FROM v_stations), k AS (SELECT g FROM x GROUP BY g HAVING count(*) >= 5),
r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2e0 AS rk FROM x WHERE g IN (SELECT g FROM k)),
s AS (SELECT sum(q) AS q, sum(n) AS n, count(*) AS groups FROM (SELECT g, sum(rk) * sum(rk) / count(*) AS q, count(*) AS n FROM r GROUP BY g)),
t AS (SELECT sum(pow(c, 3) - c) AS t FROM (SELECT count(*) AS c FROM r GROUP BY v))
SELECT round((12e0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (pow(n, 3) - n)), 6) + 0e0 AS h, CAST(groups - 1 AS INTEGER) AS df, CAST(n AS BIGINT) AS n FROM s, t WHERE groups >= 2"""
)
def kruskal_vs30_by_region(spark, d):
    return SP.kruskal_wallis(view(spark, d, "v_stations"), "vs30", "mapped_region_type").select("h", "df", "n")


@query(
    f"""WITH {_RES}, st AS (SELECT metric, band, station, avg(value_obs) AS o, avg(value_syn) AS s FROM res GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY metric, band ORDER BY o) + (count(*) OVER (PARTITION BY metric, band, o) - 1) / 2e0 AS ro, rank() OVER (PARTITION BY metric, band ORDER BY s) + (count(*) OVER (PARTITION BY metric, band, s) - 1) / 2e0 AS rs FROM st),
m AS (SELECT metric, band, median(s - o) AS md FROM st GROUP BY ALL)
SELECT metric, band, count(*) AS n_stations, {r6("corr(o, s)")} AS pearson, {r6("corr(ro, rs)")} AS spearman, {r6("any_value(md)")} AS median_difference, {r6("median(abs(s - o - md))")} AS mad_difference FROM r JOIN m USING (metric, band) GROUP BY ALL HAVING count(*) >= 5"""
)
def pattern_similarity(spark, d):
    return SP.pattern_similarity(metrics(spark, d), ["metric", "band"])


# ---------------------------------------------------------------- clusters and modes


def _profiles(spark, d) -> DataFrame:
    b = M.station_bias(M.center_by_event(_field(spark, d)), groups=["metric"])
    return M.pivot_statistic(b, "station", "metric", "mean_centered", "mean", _FEATURES).join(view(spark, d, "v_stations").select("station", "lat", "lon"), "station")


@query()
def station_kmeans(spark, d):
    got, _ = ML.kmeans_clusters(cut_lineage(_profiles(spark, d)), "station", _FEATURES)
    return got


@query()
def pca_spatial_modes(spark, d):
    return ML.principal_modes(cut_lineage(_profiles(spark, d)), "station", _FEATURES)[1]


@query()
def redcap_regions(spark, d):
    """Contiguous regions over all stations, across network borders."""
    got = ML.redcap(M.station_bias(M.center_by_event(_field(spark, d))), "mean_centered")
    return got.join(view(spark, d, "v_stations").select("station", "network"), "station").select("network", "station", "region", "n_regions")


# ---------------------------------------------------------------- plans, joins, quality control


@query(
    """WITH i AS (SELECT DISTINCT event_id, station, component FROM v_metrics), g AS (SELECT * FROM (VALUES ('PGA'), ('CAV'), ('PSA')) m(metric), (VALUES ('1-2 sec'), ('2-3 sec')) b(passband), (VALUES ('cvmsi'), ('cvms5')) x(model)),
e AS (SELECT * FROM i, g), p AS (SELECT DISTINCT event_id, station, component, metric, band AS passband, model FROM v_metrics)
SELECT (SELECT count(*) FROM e) AS expected, (SELECT count(*) FROM e SEMI JOIN p USING (event_id, station, component, metric, passband, model)) AS present, (SELECT count(*) FROM e ANTI JOIN p USING (event_id, station, component, metric, passband, model)) AS missing"""
)
def plan_completeness(spark, d):
    """Expected, present and missing rows of a metric plan."""
    m = view(spark, d, "v_metrics").withColumnRenamed("band", "passband")
    e = J.expected_rows(m, ["1-2 sec", "2-3 sec"], ["PGA", "CAV", "PSA"], [], ["cvmsi", "cvms5"])
    return J.completeness(e, m, ["event_id", "station", "component", "metric", "passband", "model"])


@query(
    """WITH o AS (SELECT DISTINCT event_id, station, component FROM v_metrics WHERE model = 'cvmsi'), s AS (SELECT DISTINCT event_id, station, component, model FROM v_metrics WHERE model = 'cvms5')
SELECT o.event_id, o.station, o.component, s.model, b.passband, 'metric-' || left(sha1(concat_ws('|', o.event_id, o.station, o.component, s.model, b.passband)), 12) AS task_id FROM o JOIN s USING (event_id, station, component), (VALUES ('1-2 sec'), ('2.5-5 sec')) b(passband)"""
)
def metric_tasks(spark, d):
    """Observed and synthetic records joined and crossed with the passbands, with stable task ids."""
    m = view(spark, d, "v_metrics")
    keys = ["event_id", "station", "component"]
    t = J.plan_tasks(m.where("model = 'cvmsi'").select(*keys).distinct(), m.where("model = 'cvms5'").select(*keys, "model").distinct(), [(1, 2), (2.5, 5)])
    return t.select(*keys, "model", "passband", "task_id")


_QC_ONE = "q AS (SELECT source, event_id, station, component, passband, metric_group, metric, period_s, max_by(qc_status, seq) AS qc_status, max_by(qc_reason, seq) AS qc_reason FROM v_qc GROUP BY ALL)"
_QC_PAIR = "pr AS (SELECT o.*, s.qc_status AS syn_status, o.qc_status = 'pass' AND s.qc_status = 'pass' AS retained FROM q o JOIN q s ON o.source = 'observed' AND s.source = 'synthetic' AND o.event_id = s.event_id AND o.station = s.station AND o.component = s.component AND o.passband = s.passband AND o.metric = s.metric AND o.period_s IS NOT DISTINCT FROM s.period_s)"


def _qc(spark, d) -> DataFrame:
    q = view(spark, d, "v_qc")
    keys = ["source", *Q.PAIR_KEYS]
    return M.first_row(q, keys, ["seq"], last=True).drop("seq")


@query(f"WITH {_QC_ONE}, {_QC_PAIR} SELECT metric, passband, count(*) AS total_pairs, count(*) FILTER (retained) AS retained_pairs, {r6('100e0 * count(*) FILTER (retained) / count(*)')} AS retention_percent FROM pr GROUP BY ALL")
def qc_pair_retention(spark, d):
    """Observed and synthetic QC side by side, and the share of pairs kept."""
    return Q.retention(Q.comparison_pairs(_qc(spark, d)), ["metric", "passband"])


@query(f"WITH {_QC_ONE} SELECT event_id, station, coalesce(bool_and(qc_status = 'pass') FILTER (source = 'observed'), false) AS observed_available, coalesce(bool_and(qc_status = 'pass') FILTER (source = 'synthetic'), false) AS synthetic_available FROM q GROUP BY 1, 2")
def qc_availability(spark, d):
    return Q.availability(_qc(spark, d))


@query(
    """WITH e AS (SELECT passband, unnest(string_split(qc_reason, ';')) AS reason FROM v_qc WHERE qc_status = 'fail')
SELECT passband, reason AS cause, count(*) AS n FROM e WHERE reason <> '' GROUP BY ALL"""
)
def qc_drop_causes(spark, d):
    return Q.drop_causes(view(spark, d, "v_qc"), groups=["passband"])


@query(
    """WITH k AS (SELECT event_id, station, component, passband, source, max_by(qc_reason, seq) FILTER (qc_status = 'fail') AS why, count(*) FILTER (qc_status = 'fail') AS f FROM v_qc GROUP BY ALL),
r AS (SELECT DISTINCT event_id, station FROM v_qc), g AS (SELECT * FROM r, (VALUES ('observed'), ('synthetic')) s(source), (VALUES ('Z'), ('N')) c(component), (VALUES ('1-2 sec'), ('2-3 sec')) p(passband), (VALUES ('amplitude', 'PGA', NULL), ('spectral', 'PSA', 1e0), ('spectral', 'PSA', 0.25e0)) m(metric_group, metric, period_s)),
j AS (SELECT g.*, CASE WHEN source = 'synthetic' AND metric_group = 'spectral' AND period_s < 0.5e0 THEN 'period_below_synthetic_min_period' WHEN f > 0 THEN why ELSE '' END AS qc_reason FROM g LEFT JOIN k USING (event_id, station, component, passband, source))
SELECT source, passband, metric, CASE WHEN qc_reason = '' THEN 'pass' ELSE 'fail' END AS qc_status, qc_reason, count(*) AS n FROM j GROUP BY ALL"""
)
def metric_qc_grid(spark, d):
    """QC of every required metric row, from record, period and trace."""
    q = view(spark, d, "v_qc")
    rec = q.select("event_id", "station").distinct().withColumns({"observed_available": F.lit(True), "synthetic_available": F.lit(True)})
    grid = Q.requirement_grid(rec, sources=["observed", "synthetic"], components=["Z", "N"], passbands=["1-2 sec", "2-3 sec"], metrics=[("amplitude", "PGA"), ("spectral", "PSA")], periods=[1.0, 0.25])
    s = Q.metric_qc_summary(grid, synthetic_fmax=2.0, trace_qc=q)
    return s.groupBy("source", "passband", "metric", "qc_status", "qc_reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH t AS (SELECT event_id, station, component, metric_group, metric, coalesce(regexp_replace(CAST(period_s AS VARCHAR), '\\.0$', ''), '') AS p, max_by(qc_status, seq) AS st FROM v_qc WHERE source = 'observed' GROUP BY ALL),
m AS (SELECT DISTINCT event_id, station, component, CASE WHEN row_id % 2 = 0 THEN 'amplitude' ELSE 'spectral' END AS metric_group, CASE WHEN row_id % 2 = 0 THEN 'PGA' ELSE 'PSA' END AS metric, CASE WHEN row_id % 2 = 1 THEN 1e0 + row_id % 3 END AS period_s FROM v_metrics),
j AS (SELECT m.*, t.st FROM m LEFT JOIN t ON m.event_id = t.event_id AND m.station = t.station AND m.component = t.component AND m.metric_group = t.metric_group AND m.metric = t.metric AND coalesce(regexp_replace(CAST(m.period_s AS VARCHAR), '\\.0$', ''), '') = t.p)
SELECT metric, coalesce(st, 'none') AS qc_status, count(*) AS n FROM j GROUP BY ALL"""
)
def metric_qc_ladder(spark, d):
    """QC of metric rows by a four-step ladder of keys."""
    m = view(spark, d, "v_metrics")
    odd = F.col("row_id") % 2 == 1
    rows = m.select("event_id", "station", "component", F.when(odd, F.lit("spectral")).otherwise(F.lit("amplitude")).alias("metric_group"), F.when(odd, F.lit("PSA")).otherwise(F.lit("PGA")).alias("metric"), F.when(odd, 1.0 + F.col("row_id") % 3).alias("period_s")).distinct()
    rows = rows.withColumns({"source": F.lit("observed"), "model": F.lit("")})
    got = J.metric_qc(rows, view(spark, d, "v_qc").withColumn("model", F.lit("")), order="seq")
    return got.groupBy("metric", F.coalesce("qc_status", F.lit("none")).alias("qc_status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH m AS (SELECT row_id, event_id, station, CASE WHEN row_id % 5 = 0 THEN NULL ELSE 1e0 END AS magnitude FROM v_metrics)
SELECT row_id, event_id, station, coalesce(m.magnitude, e.magnitude) AS magnitude, round(event_lat, 6) + 0e0 AS event_lat FROM m LEFT JOIN v_events e USING (event_id)"""
)
def metadata_fill_join(spark, d):
    """Event metadata joined where values are absent, present ones staying."""
    m = view(spark, d, "v_metrics").select("row_id", "event_id", "station", F.when(F.col("row_id") % 5 != 0, F.lit(1.0)).alias("magnitude"))
    return J.fill_from(m, view(spark, d, "v_events").select("event_id", "magnitude", "event_lat"), "event_id")


@query(
    """WITH i AS (SELECT DISTINCT l_orderkey // 8 AS k, CASE l_linenumber % 3 WHEN 0 THEN '1-2 sec' WHEN 1 THEN '2-3 sec' ELSE '3-5 sec' END AS band FROM lineitem),
b AS (SELECT o_orderkey // 8 AS k, max_by(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), f AS (SELECT o_orderkey // 8 AS k, max_by(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT band, CASE coalesce(CASE WHEN band = '1-2 sec' THEN b.s END, f.s) WHEN 'F' THEN true ELSE false END AS reject, count(*) AS n FROM i LEFT JOIN b USING (k) LEFT JOIN f USING (k) GROUP BY ALL""",
    views=False,
)
def manual_decisions(spark, d):
    """Manual decisions over automatic ones, a band's over the full trace's."""
    li = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 8).cast("string").alias("event_id"), (F.col("l_linenumber") % 3).alias("b")).distinct()
    band = F.when(F.col("b") == 0, F.lit("1-2 sec")).when(F.col("b") == 1, F.lit("2-3 sec")).otherwise(F.lit("3-5 sec"))
    inv = li.select("event_id", F.lit("S").alias("station"), F.lit("Z").alias("component"), band.alias("band"), F.lit(False).alias("reject"), F.lit("").alias("reject_reason"))
    o = table(spark, d, "orders")
    even = F.col("o_orderkey") % 2 == 0
    decision = F.when(F.col("o_orderstatus") == "F", F.lit("reject")).when(F.col("o_orderstatus") == "O", F.lit("accept")).otherwise(F.lit("open"))
    dec = o.select(F.floor(F.col("o_orderkey") / 8).cast("string").alias("event_id"), F.lit("S").alias("station"), F.lit("Z").alias("component"), F.when(even, F.lit("band")).otherwise(F.lit("full")).alias("scope_kind"), F.when(even, F.lit("1-2 sec")).otherwise(F.lit("")).alias("scope_label"), decision.alias("decision"), F.lit("by_hand").alias("reason_code"), F.col("o_orderkey").alias("seq"))
    return Q.apply_decisions(inv, dec).groupBy("band", "reject").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- picks, selections, reshaping


@query("SELECT user_id, event_type, min_by(event_id, {'p': -value, 's': event_id}) AS event_id, round(max(value), 6) + 0e0 AS value FROM events WHERE value >= 10 GROUP BY ALL", views=False)
def best_picks(spark, d):
    """The most probable pick of each key, the first of several."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", F.col("value").alias("probability"))
    return Q.best_picks(e, ["user_id", "event_type"], least=10.0, order="event_id").select("user_id", "event_type", "event_id", "value")


@query(f"WITH {_RES} SELECT row_id, {r6('log2_residual')} AS log2_residual FROM res ORDER BY abs(log2_residual) DESC, row_id LIMIT 50")
def largest_residuals(spark, d):
    return M.top_k(metrics(spark, d), "log2_residual", 50, ties=["row_id"]).select("row_id", "log2_residual")


@query("SELECT row_id FROM v_metrics WHERE model = 'cvmsi' AND upper(metric) = 'PGA' AND band IN ('1-2 sec', '3-5 sec') AND component = 'Z' AND contains(lower(station), '1')")
def dashboard_filter(spark, d):
    m = view(spark, d, "v_metrics")
    return SEL.filter_metrics(m, models=["cvmsi"], metric="pga", bands=["1-2s", "3_5s"], component="z", station="1").select("row_id")


@query(f"SELECT event_id, station FROM v_events CROSS JOIN v_stations WHERE lon BETWEEN -118.9 AND -118.5 AND lat BETWEEN 33.2 AND 34 AND NOT (event_lon BETWEEN -118 AND -117 AND event_lat BETWEEN 33 AND 34)")
def spatial_selection(spark, d):
    t = view(spark, d, "v_events").select("event_id", "event_lat", "event_lon").crossJoin(view(spark, d, "v_stations").select("station", "lat", "lon"))
    s = SEL.spatial_subset(t, station_bounds=(-118.9, -118.5, 33.2, 34.0), require_match=False)
    return s.where(SEL.in_bounds(s, (-118.0, -117.0, 33.0, 34.0), "outside", ["event_lon"], ["event_lat"])).select("event_id", "station")


@query(f"WITH {_RES}, e AS (SELECT min(log2_residual) AS lo, max(log2_residual) AS hi FROM res) SELECT CAST(least(floor((log2_residual - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS bin, count(*) AS n FROM res, e GROUP BY 1")
def residual_histogram(spark, d):
    return M.histogram(metrics(spark, d), "log2_residual", 40).select("bin", "n")


@query("SELECT s_nationkey, min_by(s_name, s_suppkey) FILTER (s_acctbal > 0) AS s_name, min_by(s_acctbal, s_suppkey) FILTER (s_acctbal < 5000) AS s_acctbal FROM supplier GROUP BY 1", views=False)
def master_first_present(spark, d):
    """Per key each column's first present value."""
    b = F.col("s_acctbal")
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.when(b > 0, F.col("s_name")).alias("s_name"), F.when(b < 5000, b).alias("s_acctbal"))
    return M.first_present(s, ["s_nationkey"], ["s_name", "s_acctbal"], "s_suppkey")


@query("SELECT o_custkey, max_by(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS o_orderkey, max_by(o_orderstatus, {'d': o_orderdate, 'k': o_orderkey}) AS o_orderstatus FROM orders GROUP BY 1", views=False)
def latest_row_per_key(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return M.first_row(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], last=True).select("o_custkey", "o_orderkey", "o_orderstatus")


@query(
    """SELECT p.event_id, p.user_id, q.event_id AS seen FROM events p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY ALL) q ON p.user_id = q.user_id AND p.ts >= q.ts""",
    views=False,
)
def as_of_join(spark, d):
    """The latest event of one type at or before each event of the same user."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    kind = e.agg(F.min("event_type").alias("event_type"))
    right = e.join(F.broadcast(kind), "event_type").groupBy("user_id", "ts").agg(F.max("event_id").alias("seen"))
    return J.as_of(e.select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "ts", ["seen"]).select("event_id", "user_id", "seen")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 6) + 0e0 AS total, round(avg(value), 6) + 0e0 AS mean FROM events GROUP BY ALL", views=False)
def hourly_event_windows(spark, d):
    return ingest.windowed_summary(table(spark, d, "events"), "ts", ["event_type"], "value")


@query(
    """WITH s AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM g GROUP BY user_id, k""",
    views=False,
)
def user_sessions(spark, d):
    return ingest.sessions(table(spark, d, "events"), "ts", "user_id")


@query(
    """SELECT station, network, CASE WHEN regexp_matches(upper(station), '^[A-Z]{2}') THEN 'broadband' ELSE 'strong_motion' END AS family, regexp_replace(lower(station), '[^a-z0-9]+', '_', 'g') AS slug,
 left(sha256('{"network":"' || network || '","station":"' || station || '"}'), 10) AS digest FROM v_stations"""
)
def station_labels(spark, d):
    """Family, slug and hash of station codes."""
    s = view(spark, d, "v_stations")
    return s.select("station", "network", X.station_family("network", "station").alias("family"), X.slug("station").alias("slug"), X.stable_hash(["station", "network"], 10).alias("digest"))


# ---------------------------------------------------------------- waveforms

_TR = "t AS (SELECT pair_id, list_transform(obs, lambda x: CAST(x AS DOUBLE)) AS o, list_transform(syn, lambda x: CAST(x AS DOUBLE)) AS s FROM v_traces)"


def _traces(spark, d) -> DataFrame:
    t = view(spark, d, "v_traces")
    wide = lambda c: F.transform(F.col(c), lambda x: x.cast("double"))
    return t.select("pair_id", "grp", wide("obs").alias("obs_samples"), wide("syn").alias("syn_samples"), F.lit(0.05).alias("dt"))


@query(
    f"""WITH {_TR}, u AS (SELECT pair_id, o, list_transform(o, lambda x: abs(x)) AS a, list_transform(o, lambda x: x * x) AS q, list_transform(s, lambda x: x * x) AS qs, list_dot_product(o, s) AS c FROM t)
SELECT pair_id, {r6("list_max(a)")} AS peak, {r6("sqrt(list_sum(q) / len(q))")} AS rms, {r6("1e3 * pi() / (2 * 981e0) * (list_sum(q) - (q[1] + q[-1]) / 2) * 0.05e0")} AS arias_milli, {r6("c / sqrt(list_sum(q) * list_sum(qs))")} AS cc FROM u"""
)
def trace_reductions(spark, d):
    """Peak, RMS, Arias intensity and zero-lag correlation of traces, in SQL."""
    t = _traces(spark, d)
    return t.select("pair_id", TR.peak_abs("obs_samples").alias("peak"), TR.rms("obs_samples").alias("rms"), (1e3 * TR.arias_intensity("obs_samples", F.col("dt"))).alias("arias_milli"), TR.correlation("obs_samples", "syn_samples").alias("cc"))


@query(
    f"""WITH {_TR}, i AS (SELECT pair_id, unnest(o) AS n, unnest(s) AS e FROM t)
SELECT pair_id, {r6("max(abs(-cos(radians(30)) * n - sin(radians(30)) * e))")} AS radial_peak, {r6("max(abs(sin(radians(30)) * n - cos(radians(30)) * e))")} AS transverse_peak FROM i GROUP BY 1"""
)
def rotated_peaks(spark, d):
    """Peaks of radial and transverse components."""
    r, t = TR.rotate_ne_to_rt("obs_samples", "syn_samples", F.lit(30.0))
    return _traces(spark, d).select("pair_id", TR.peak_abs(r).alias("radial_peak"), TR.peak_abs(t).alias("transverse_peak"))


@query()
def trace_metrics(spark, d):
    """Eight amplitude, intensity and duration metrics of every trace."""
    return _traces(spark, d).select("pair_id", TR.metric_struct("obs_samples", "dt", list(TR.TRACE_METRICS)).alias("m")).select("pair_id", "m.*")


@query()
def metric_rows_from_waveforms(spark, d):
    """Long metric rows from waveform pairs: filtered, reduced, compared."""
    t = _traces(spark, d).withColumns({"period_min_s": F.lit(0.2), "period_max_s": F.lit(1.0)})
    return W.calculate(t, ["pair_id", "grp"], metrics=[m for ms in X.METRIC_GROUPS.values() for m in ms], periods=[0.25, 0.5, 1.0])


@query()
def trace_quality(spark, d):
    """Signal and noise levels, reasons and status of traces by passband."""
    t = _traces(spark, d).withColumn("start", F.lit(-1.0))
    return Q.trace_qc(t, ["pair_id"], "obs_samples", "dt", "start", [("0.2-0.5s", 0.2, 0.5)], least_length_s=3.0, least_end_s=2.0)


# ---------------------------------------------------------------- polygons

_BOXES = [("west", -119.0, -118.2, 33.0, 34.0), ("east", -118.2, -116.5, 33.0, 34.0), ("north", -119.0, -116.5, 34.0, 35.0)]


def boxes(spark: SparkSession) -> DataFrame:
    from quakeweave.sources.geojson import POLYGON, parse_geojson

    ring = lambda w, e, s, n: [[w, s], [e, s], [e, n], [w, n], [w, s]]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": b[0], "region_type": "box"}, "geometry": {"type": "Polygon", "coordinates": [ring(*b[1:])]}} for b in _BOXES]}
    return spark.createDataFrame(parse_geojson(doc), POLYGON)


_IN_BOX = ", ".join(f"CASE WHEN {{x}} BETWEEN {w} AND {e} AND {{y}} BETWEEN {s} AND {n} THEN '{name}' END" for name, w, e, s, n in _BOXES)


@query(f"SELECT event_id, concat_ws(';', {_IN_BOX.format(x='event_lon', y='event_lat')}) AS region_labels, len(concat_ws(';', {_IN_BOX.format(x='event_lon', y='event_lat')})) > 0 AS region_inside_any FROM v_events")
def events_in_polygons(spark, d):
    """Names of the polygons around each event, borders belonging to them."""
    e = view(spark, d, "v_events").select("event_id", "event_lat", "event_lon")
    return GE.annotate_points(e, boxes(spark), "event_lat", "event_lon").select("event_id", "region_labels", "region_inside_any")


_INTO = ", ".join(
    f"CASE WHEN NOT (event_lon BETWEEN {w} AND {e} AND event_lat BETWEEN {s} AND {n}) AND sta_lon BETWEEN {w} AND {e} AND sta_lat BETWEEN {s} AND {n} THEN '{name}' END" for name, w, e, s, n in _BOXES
)


@query(f"WITH {_RES}, {_PATHS}, l AS (SELECT row_id, concat_ws(';', {_INTO}) AS path_labels FROM paths) SELECT * FROM l WHERE path_labels <> ''")
def paths_crossing_polygons(spark, d):
    """Paths that enter a polygon from outside."""
    p = _paths(spark, d).select("row_id", "event_lat", "event_lon", "sta_lat", "sta_lon")
    return GE.classify_paths(p, boxes(spark), direction="inward").where("path_matches").select("row_id", "path_labels")


@query()
def boundary_corridor_paths(spark, d):
    """Length of paths inside corridors across the polygons' boundaries."""
    s = view(spark, d, "v_stations").select("station", "lat", "lon")
    c = cut_lineage(GE.boundary_corridors(s, boxes(spark), "station", "lat", "lon", near_km=3.0, inside_km=15.0, outside_km=15.0))
    p = _paths(spark, d).select("event_id", "station", "event_lat", "event_lon", "sta_lat", "sta_lon").distinct()
    return GE.classify_by_corridors(p, c, least_km=1.0).groupBy("corridor_id").agg(F.count(F.lit(1)).alias("n"), F.avg("path_km").alias("mean_path_km"))


@query(
    f"WITH {_RES}, {_PATHS}, l AS (SELECT *, concat_ws(';', {_IN_BOX.format(x='sta_lon', y='sta_lat')}) AS labels FROM paths), x AS (SELECT model, unnest(string_split(labels, ';')) AS label, log2_residual AS v FROM l) SELECT label, model, {_STATS} FROM x WHERE label <> '' GROUP BY ALL"
)
def polygon_summary(spark, d):
    """Residual statistics by polygon around the station."""
    s = view(spark, d, "v_stations").select("station", "lat", "lon")
    named = GE.annotate_points(s, boxes(spark), "lat", "lon").select("station", "region_labels")
    return M.label_summary(metrics(spark, d).join(named, "station"), "region_labels", "log2_residual", ["model"])


# ---------------------------------------------------------------- figures, coverage, normalised tables


@query(
    f"""WITH {_RES}, q AS (SELECT metric, quantile_cont(log2_residual, 0.25) AS q25, median(log2_residual) AS med, quantile_cont(log2_residual, 0.75) AS q75, count(*) AS n FROM res GROUP BY 1),
w AS (SELECT metric, min(log2_residual) FILTER (ok) AS lo, max(log2_residual) FILTER (ok) AS hi, count(*) FILTER (NOT ok) AS outliers FROM (SELECT r.metric, log2_residual, log2_residual BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS ok FROM res r JOIN q USING (metric)) GROUP BY 1)
SELECT metric, {r6("q25")} AS q25, {r6("med")} AS median, {r6("q75")} AS q75, n, {r6("lo")} AS whisker_low, {r6("hi")} AS whisker_high, outliers FROM q JOIN w USING (metric)"""
)
def box_statistics(spark, d):
    """Quartiles, whiskers and outliers of the residuals by metric."""
    return V.box_statistics(metrics(spark, d), "log2_residual", ["metric"])


@query("SELECT station, count(DISTINCT event_id) AS n FROM v_metrics GROUP BY 1 ORDER BY n DESC, station LIMIT 40")
def station_coverage(spark, d):
    """The stations with most events."""
    return V.coverage(view(spark, d, "v_metrics"), "station", "event_id", 40)


@query(f"WITH {_RES}, {_PATHS} SELECT count(*) AS rows, count(DISTINCT event_id) AS events, count(DISTINCT station) AS stations, count(*) FILTER (event_lat IS NULL OR sta_lat IS NULL) AS rows_missing_coordinates FROM paths")
def coverage_totals(spark, d):
    return V.coverage_totals(_paths(spark, d))


@query(f"WITH {_RES} SELECT {r6('-max(abs(log2_residual))')} AS low, {r6('max(abs(log2_residual))')} AS high FROM res")
def symmetric_limits(spark, d):
    return V.value_limits(metrics(spark, d), "log2_residual", diverging=True)


@query(
    "SELECT passband, count(*) AS total, count(*) FILTER (qc_status = 'pass') AS accepted, count(*) FILTER (qc_status <> 'pass') AS rejected, "
    + f"{r6('100e0 * count(*) FILTER (contains(qc_reason, $$low_snr$$)) / count(*)')} AS percent_low_snr, {r6('100e0 * count(*) FILTER (contains(qc_reason, $$record_too_short$$)) / count(*)')} AS percent_record_too_short FROM v_qc GROUP BY 1"
)
def qc_companion_summary(spark, d):
    """Acceptance and shares of reasons by passband."""
    q = view(spark, d, "v_qc").withColumn("ok", F.col("qc_status") == "pass")
    return Q.companion_summary(q, ["passband"], ok="ok", reasons="qc_reason").select("passband", "total", "accepted", "rejected", "percent_low_snr", "percent_record_too_short")


@query(
    """WITH b AS (SELECT event_id, station, qc_status = 'pass' AS ok, CAST(left(passband, 1) AS DOUBLE) AS lo, CAST(substr(passband, 3, 1) AS DOUBLE) AS hi FROM v_qc)
SELECT event_id, station, bool_and(ok) AS all_accepted, bool_or(ok) AS any_accepted FROM b WHERE greatest(lo, 1.5e0) < least(hi, 2.5e0) GROUP BY 1, 2"""
)
def accepted_bands(spark, d):
    """Whether all, or any, of the bands that overlap 1.5 to 2.5 s are accepted."""
    q = view(spark, d, "v_qc").withColumns({"ok": F.col("qc_status") == "pass", "r": X.period_range("passband")}).withColumns({"lo": F.col("r.low"), "hi": F.col("r.high")})
    return Q.accepted_bands(q, ["event_id", "station"], [(1.5, 2.5)], "lo", "hi", "ok")


@query(
    """WITH i AS (SELECT DISTINCT event_id, station, component FROM v_metrics), g AS (SELECT * FROM (VALUES ('PGA'), ('CAV')) m(metric), (VALUES ('1-2 sec')) b(passband), (VALUES ('cvmsi')) x(model)),
p AS (SELECT DISTINCT event_id, station, component, metric, band AS passband, model FROM v_metrics) SELECT event_id, station, component, metric, passband, model FROM (SELECT * FROM i, g) e ANTI JOIN p USING (event_id, station, component, metric, passband, model)"""
)
def plan_gaps(spark, d):
    """Planned rows that are missing."""
    m = view(spark, d, "v_metrics").withColumnRenamed("band", "passband")
    keys = ["event_id", "station", "component", "metric", "passband", "model"]
    return J.missing_rows(J.expected_rows(m, ["1-2 sec"], ["PGA", "CAV"], [], ["cvmsi"]), m, keys).select(*keys)


@query(
    """WITH x AS (SELECT mapped_region_type AS g, vs30 AS v FROM v_stations WHERE mapped_region_type IN ('ASIA', 'EUROPE')), r AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2e0 AS rk FROM x)
SELECT round(sum(rk) FILTER (g = 'ASIA') - count(*) FILTER (g = 'ASIA') * (count(*) FILTER (g = 'ASIA') + 1) / 2e0, 6) + 0e0 AS u, count(*) FILTER (g = 'ASIA') AS n_left, count(*) FILTER (g = 'EUROPE') AS n_right FROM r HAVING n_left > 0 AND n_right > 0"""
)
def mann_whitney_vs30(spark, d):
    return SP.mann_whitney(view(spark, d, "v_stations"), "vs30", "mapped_region_type", "ASIA", "EUROPE").select("u", "n_left", "n_right")


@query(
    """WITH s AS (SELECT upper(trim(station)) AS station, coalesce(upper(CASE WHEN lower(trim(network)) NOT IN ('', 'nan', 'none', 'null') THEN trim(network) END), 'UNKNOWN') AS network, station_lat AS lat, station_lon AS lon, loaded_at FROM selected_stations WHERE isfinite(station_lat) AND isfinite(station_lon))
SELECT station, min_by(lat, loaded_at) AS lat, min_by(lon, loaded_at) AS lon FROM s WHERE lower(station) NOT IN ('', 'nan', 'none', 'null') GROUP BY 1""",
    views=False,
)
def normalized_stations(spark, d):
    """The station list in its logical schema, the first row of each station."""
    s = table(spark, d, "selected_stations").drop("station_id")
    return N.stations(s, order="loaded_at").select("station", "lat", "lon")


_SNAP = r"""CASE WHEN lower(trim(model)) NOT IN ('','nan','none','null') THEN lower(trim(model)) END AS model,
 CASE WHEN regexp_matches(lower(trim(band)), '^[0-9.]+ *[-_] *[0-9.]+ *(s|sec)$') THEN regexp_extract(lower(trim(band)), '^([0-9.]+) *[-_] *([0-9.]+)', 1) || '-' || regexp_extract(lower(trim(band)), '^([0-9.]+) *[-_] *([0-9.]+)', 2) || ' sec' END AS band,
 CASE WHEN isfinite(log2_residual) AND abs(log2_residual) <= 64 THEN log2_residual END AS v"""


@query(f"SELECT model, band, {_STATS} FROM (SELECT {_SNAP} FROM example_metrics_snapshot) GROUP BY ALL", views=False)
def snapshot_model_band_summary(spark, d):
    """Statistics of the usable residuals of the metric snapshot, whatever the spelling of its labels."""
    rows = table(spark, d, "example_metrics_snapshot").select(L.lower_key("model").alias("model"), L.band_key("band").alias("band"), L.usable_residual().alias("v"))
    return M.summarize(rows, "v", ["model", "band"])


@query(
    f"""WITH p AS (SELECT log2_residual AS v, {hav("event_lat", "event_lon", "sta_lat", "sta_lon")} AS km FROM example_metrics_snapshot WHERE isfinite(log2_residual) AND abs(log2_residual) <= 64 AND isfinite(event_lat) AND isfinite(event_lon) AND isfinite(sta_lat) AND isfinite(sta_lon) AND sta_lat BETWEEN 32 AND 36 AND sta_lon BETWEEN -121 AND -114)
SELECT floor(km / 50) * 50e0 AS distance_bin_km, count(*) AS n, {r6("avg(v)")} AS mean_residual FROM p GROUP BY 1""",
    views=False,
)
def snapshot_distance_bins(spark, d):
    """Mean residual of the metric snapshot by distance, computed from usable coordinates."""
    rows = table(spark, d, "example_metrics_snapshot").where(L.usable_position("sta_lat", "sta_lon") & L.finite("event_lat").isNotNull() & L.finite("event_lon").isNotNull())
    g = rows.select(L.usable_residual().alias("v"), G.haversine_km("event_lat", "event_lon", "sta_lat", "sta_lon").alias("km")).where(F.col("v").isNotNull())
    return g.groupBy(G.grid_cell("km", 50.0).alias("distance_bin_km")).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_residual"))


@query("WITH g AS (SELECT station, network, row_number() OVER (ORDER BY station) - 1 AS k FROM v_stations) SELECT CAST(floor(k / 7) AS BIGINT) AS batch, count(*) AS n, min(station) AS first_station FROM g GROUP BY 1")
def work_batches(spark, d):
    """Stations in slices of seven by name."""
    b = V.batches(view(spark, d, "v_stations").select("station", "network"), 7, "station")
    return b.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("station").alias("first_station"))
