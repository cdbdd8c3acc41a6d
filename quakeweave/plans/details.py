"""Queries of label, geodesy, residual, trace, selection and figure operators, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeweave.functions import geodesy as G
from quakeweave.functions import residuals as R
from quakeweave.functions import text as X
from quakeweave.functions import traces as TR
from quakeweave.operators import clustering as ML
from quakeweave.operators import figures as V
from quakeweave.operators import geology as GEO
from quakeweave.operators import geometry as GE
from quakeweave.operators import joins as J
from quakeweave.operators import metrics as M
from quakeweave.operators import qc as Q
from quakeweave.operators import selection as SEL
from quakeweave.operators import spatial as SP
from quakeweave.operators import workflow as W
from quakeweave.plans.analytics import _CENTRE, _PATHS, _RES, _TR, _field, _paths, _traces, boxes, metrics
from quakeweave.plans.fixtures import hav, r6, rounded, view, with_views
from quakeweave.runtime import cut_lineage, table
from quakeweave.sources import tables as TB

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


# ---------------------------------------------------------------- labels

_OLD = list(X.OLD_METRIC_NAMES.values())
_GROUPS = [next(g for g, ms in X.METRIC_GROUPS.items() if m in ms) for m in _OLD]


@query(
    f"""WITH x AS (SELECT row_id, metric, band, model, component, row_id % 13 AS k, concat(' ', metric, ' / ', band, '! ') AS t, replace(band, ' sec', 's') AS short FROM v_metrics)
SELECT row_id, trim(regexp_replace(trim(t), '[^A-Za-z0-9._=-]+', '_', 'g'), '_') AS path_token, trim(regexp_replace(lower(trim(t)), '[^a-z0-9]+', '_', 'g'), '_') AS name_token, trim(left(trim(regexp_replace(lower(trim(t)), '[^a-z0-9]+', '_', 'g'), '_'), 6), '_') AS slug,
 band AS passband, band AS shown_band, short AS from_key, replace(short, '-', '_') AS column_key, CASE WHEN k % 3 > 0 AND k % 3 < k % 5 THEN concat(k % 3, '-', k % 5, 's') END AS band_label,
 CASE WHEN metric IN ('PSA', 'FAS') THEN concat(metric, ' T=2 s') WHEN metric = 'arias_duration' THEN 'Arias Duration' ELSE metric END AS metric_label,
 ({_OLD})[k + 1] AS public_name, ({_GROUPS})[k + 1] AS metric_group, model AS parent_folder, lower(component) = 'z' OR band LIKE '2%' AS member, k IN (1, 2) AS truthy, CASE WHEN k % 4 = 0 THEN concat(k, ' ') ELSE concat(k + 0.5, ' ') END AS number_text FROM x"""
)
def label_forms(spark, d):
    """Labels as tokens, band and metric names, groups, flags and numbers as text."""
    m = view(spark, d, "v_metrics").withColumn("k", F.col("row_id") % 13)
    t = F.concat(F.lit(" "), "metric", F.lit(" / "), "band", F.lit("! "))
    short = F.replace("band", F.lit(" sec"), F.lit("s"))
    old = F.concat(F.lit("C"), (F.col("k") + 1).cast("string"))
    number = F.when(F.col("k") % 4 == 0, F.col("k").cast("double")).otherwise(F.col("k") + 0.5)
    return m.select(
        "row_id", X.token(t).alias("path_token"), X.name_token(t).alias("name_token"), X.slug(t, 6).alias("slug"), X.passband_sec(short).alias("passband"), X.band_display(short).alias("shown_band"),
        X.band_from_column_key(X.band_column_key("band")).alias("from_key"), X.band_column_key("band").alias("column_key"), X.period_band_label(F.col("k") % 3, F.col("k") % 5).alias("band_label"),
        X.metric_display("metric", F.lit(2.0)).alias("metric_label"), X.public_metric_name(old).alias("public_name"), X.metric_group_of(old).alias("metric_group"),
        X.parent_folder(F.concat(F.lit("runs/"), "model", F.lit("/rows.csv"))).alias("parent_folder"), X.has_member(F.concat("component", F.lit(" ; "), F.left("band", F.lit(1))), ["z", "2"]).alias("member"),
        X.truthy(F.when(F.col("k") == 1, F.lit(" TRUE")).when(F.col("k") == 2, F.lit("Reject")).otherwise(F.lit("0"))).alias("truthy"), F.concat(X.number_text(number), F.lit(" ")).alias("number_text"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'broadband' ELSE 'strong_motion' END AS family, CAST(l_linenumber AS DOUBLE) AS sample_interval, 86400e0 * (l_linenumber + 1) AS record_s,
 'metric-' || left(sha1(concat(l_orderkey, '|', l_linenumber, '|')), 12) AS task_id, concat_ws(';', l_returnflag, 'low_snr') AS reasons FROM lineitem""",
    views=False,
)
def record_forms(spark, d):
    """Station families, sample intervals, record lengths, task ids and reason lists."""
    li = table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    code = F.when(n % 2 == 0, F.lit("NC.ABC")).otherwise(F.lit("CE.123A"))
    reasons = X.distinct_reasons(F.array(F.concat(F.lit(" "), "l_returnflag"), F.lit(""), F.lit("low_snr"), F.col("l_returnflag")))
    return li.select(
        "l_orderkey", "l_linenumber", X.station_family(F.lit("NC"), code).alias("family"), X.sample_interval(F.lit(0.0), F.lit(None), F.lit(-1.0), 1.0 / n).alias("sample_interval"),
        X.record_length_s(F.lit(0), F.lit(100.0), F.col("l_shipdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(days=n + 1)).alias("record_s"), X.task_id("l_orderkey", "l_linenumber", F.lit(None)).alias("task_id"), F.array_join(reasons, ";").alias("reasons"),
    )


# ---------------------------------------------------------------- geodesy and residuals


@query(
    f"""WITH {_RES}, {_PATHS}, x AS (SELECT p.row_id, distance_km, azimuth_deg % 180 AS o, e.depth_km, sta_lat, sta_lon FROM paths p JOIN v_events e USING (event_id)),
a AS (SELECT *, acos(least(1e0, sin(radians(34e0)) * sin(radians(sta_lat)) + cos(radians(34e0)) * cos(radians(sta_lat)) * cos(radians(sta_lon + 118e0)))) AS c FROM x)
SELECT row_id, {r6("greatest(1e-3, sqrt(distance_km * distance_km + depth_km * depth_km))")} AS hypocentral_km, round(o, 4) % 180 AS orientation, CAST(floor(((o + 15) % 180) / 30) AS INTEGER) AS sector,
 floor(distance_km / 25) * 25e0 AS cell, {r6("6371.0088e0 * radians(sta_lon) * cos(radians(34e0))")} AS x_km, {r6("6371.0088e0 * radians(sta_lat)")} AS y_km,
 {r6("6371.0088e0 * c / sin(c) * cos(radians(sta_lat)) * sin(radians(sta_lon + 118e0))")} AS ae_x_km, {r6("6371.0088e0 * c / sin(c) * (cos(radians(34e0)) * sin(radians(sta_lat)) - sin(radians(34e0)) * cos(radians(sta_lat)) * cos(radians(sta_lon + 118e0)))")} AS ae_y_km FROM a WHERE c > 1e-9"""
)
def path_forms(spark, d):
    """Hypocentral distance, orientation and its sector, grid cell, local and azimuthal coordinates."""
    p = _paths(spark, d).join(view(spark, d, "v_events").select("event_id", "depth_km"), "event_id")
    p = G.local_xy_km(p, "sta_lat", "sta_lon", lat0=34.0)
    o = G.orientation_deg("event_lat", "event_lon", "sta_lat", "sta_lon")
    ax, ay = G.azimuthal_equidistant_km("sta_lat", "sta_lon", 34.0, -118.0)
    out = p.select("row_id", G.hypocentral_km("distance_km", "depth_km").alias("hypocentral_km"), F.pmod(F.round(o, 4), F.lit(180.0)).alias("orientation"), G.sector(o, 30.0).alias("sector"), G.grid_cell("distance_km", 25.0).alias("cell"), "x_km", "y_km", ax.alias("ae_x_km"), ay.alias("ae_y_km"))
    return out.where((F.abs("ae_x_km") > 1e-6) | (F.abs("ae_y_km") > 1e-6))


@query(
    f"""WITH x AS (SELECT row_id, value_obs AS o, CASE WHEN row_id % 11 = 0 THEN 0e0 WHEN row_id % 11 = 1 THEN -value_syn ELSE value_syn END AS s FROM v_metrics)
SELECT row_id, {r6("s - o")} AS pair_residual, CASE WHEN s > 0 THEN {r6("log2(s / o)")} END AS pair_log2, {r6("s - o")} AS difference, CASE WHEN s > 0 THEN {r6("log10(s / o)")} END AS logratio,
 CASE WHEN s > 0 THEN {r6("least(10, 10 * exp(-pow((o - s) / least(o, s), 2)))")} ELSE 0e0 END AS anderson, CASE WHEN s > 0 THEN {r6("10 * pow(0.5, abs((o - s) / least(o, s)))")} ELSE 0e0 END AS decay,
 CASE WHEN abs(s) > 1e-12 THEN {r6("o / s")} END AS ratio, {r6("(pow(2e0, row_id % 7 - 3) - 1) * 100")} AS percent FROM x"""
)
def residual_forms(spark, d):
    """Residuals in the pair and wide tables' conventions, scores with zeros, ratios and percents."""
    k = F.col("row_id") % 11
    m = view(spark, d, "v_metrics").withColumn("s", F.when(k == 0, F.lit(0.0)).when(k == 1, -F.col("value_syn")).otherwise(F.col("value_syn")))
    a, b = R.pair_residuals("value_obs", "s")
    return m.select(
        "row_id", a.alias("pair_residual"), b.alias("pair_log2"), R.wide_residual("value_obs", "s", "difference").alias("difference"), R.wide_residual("value_obs", "s").alias("logratio"),
        R.score("value_obs", "s", "anderson").alias("anderson"), R.score("value_obs", "s").alias("decay"), R.amplitude_ratio("value_obs", "s").alias("ratio"), R.percent_from_log2(F.col("row_id") % 7 - 3).alias("percent"),
    )


# ---------------------------------------------------------------- traces


@query(
    f"""WITH {_TR}, u AS (SELECT pair_id, unnest(o) AS x, unnest(s) AS y, generate_subscripts(o, 1) AS i FROM t), p AS (SELECT pair_id, max(abs(x)) AS top, sqrt(avg(x * x)) AS r FROM u GROUP BY 1)
SELECT pair_id, {r6("sum(x / top)")} AS normalized, {r6("sum(x / r)")} AS normalized_rms, {r6("sum(x) FILTER (x > 0)")} AS masked, count(*) FILTER (x > 0 AND y < 0) AS common, {r6("sum(abs(x))")} AS back_n, {r6("sum(abs(y))")} AS back_e FROM u JOIN p USING (pair_id) GROUP BY 1"""
)
def trace_forms(spark, d):
    """Scaled and masked traces, samples valid on both sides, and rotation there and back."""
    t = _traces(spark, d)
    good, bad = F.transform("obs_samples", lambda x: x > 0), F.transform("syn_samples", lambda x: x < 0)
    radial, transverse = TR.rotate_ne_to_rt("obs_samples", "syn_samples", F.lit(77.0))
    n, e = TR.rotate_rt_to_ne(radial, transverse, F.lit(77.0))
    size = lambda a: TR.total(F.transform(a, lambda x: F.abs(x)))
    kept = TR.total(F.filter(TR.masked("obs_samples", good), lambda x: x.isNotNull()))
    return t.select("pair_id", TR.total(TR.normalized("obs_samples")).alias("normalized"), TR.total(TR.normalized_rms("obs_samples")).alias("normalized_rms"), kept.alias("masked"), F.size(TR.common_valid("obs_samples", "syn_samples", good, bad)).cast("bigint").alias("common"), size(n).alias("back_n"), size(e).alias("back_e"))


@query(
    f"""WITH {_TR}, u AS (SELECT pair_id, len(o) AS n, unnest(o) AS x, generate_subscripts(o, 1) - 1 AS i FROM t), k AS (SELECT DISTINCT n, unnest(range(1, n // 2 + 1)) AS k FROM u)
SELECT pair_id, k AS bin, {r6("n * 0.05e0 / k")} AS period_s, round(sqrt(pow(sum(x * cos(2 * pi() * k * i / n)), 2) + pow(sum(x * sin(2 * pi() * k * i / n)), 2)), 5) + 0e0 AS amplitude FROM u JOIN k USING (n) WHERE n * 0.05e0 / k BETWEEN 0.11e0 AND 0.51e0 GROUP BY pair_id, n, k"""
)
def trace_period_spectra(spark, d):
    """Fourier amplitudes by period, within bounds, against a plain transform."""
    t = _traces(spark, d)
    rows = t.select("pair_id", (F.size("obs_samples") * F.col("dt")).alias("length"), F.explode(TR.spectrum_between(TR.period_spectrum("obs_samples", "dt"), 0.11, 0.51)).alias("s"))
    return rows.select("pair_id", F.round(F.col("length") / F.col("s.period")).cast("bigint").alias("bin"), F.col("s.period").alias("period_s"), F.round("s.amplitude", 5).alias("amplitude"))


@query(
    f"""WITH {_TR}, u AS (SELECT pair_id, o, len(o) AS n, list_transform(o, lambda x: x * x) AS q, list_transform(o, lambda x: abs(x)) AS a FROM t)
SELECT pair_id, {r6("list_max(a[1 + CAST(floor(0.01e0 * n) AS BIGINT) : n - CAST(floor(0.01e0 * n) AS BIGINT)])")} AS "PGA", {r6("pi() / (2 * 981e0) * (list_sum(q) - (q[1] + q[-1]) / 2) * 0.05e0")} AS arias_intensity FROM u"""
)
def trace_kernel_metrics(spark, d):
    """Peak acceleration and Arias intensity from the Arrow kernels, against array SQL."""
    return _traces(spark, d).select("pair_id", TR.metric_struct("obs_samples", "dt", ["PGA", "arias_intensity"]).alias("m")).select("pair_id", "m.*")


@query()
def filtered_traces(spark, d):
    """Levels of traces after band-pass, low-pass, resampling and integration."""
    t = _traces(spark, d)
    level = lambda c: TR.rms(F.filter(c, lambda x: x.isNotNull()))
    made = t.select("pair_id", TR.bandpassed("obs_samples", "dt", 1.0, 5.0).alias("b"), TR.lowpassed("obs_samples", "dt", 4.0).alias("l"), TR.resampled("obs_samples", "dt", 10.0).alias("r"), TR.integrated("obs_samples", "dt", 1).alias("i"), F.size("obs_samples").alias("n"))
    return made.select("pair_id", level("b").alias("bandpassed_rms"), level("l").alias("lowpassed_rms"), level("r").alias("resampled_rms"), level("i").alias("integrated_rms"), F.size("b").alias("n_bandpassed"), F.size("r").alias("n_resampled"), "n")


@query()
def spectral_quality(spark, d):
    """Response and Fourier spectra at periods, and which of them the record supports."""
    periods = [0.25, 0.5, 1.0, 2.0]
    t = _traces(spark, d)
    s = t.select("pair_id", F.size("obs_samples").alias("n"), "dt", TR.spectrum_at("obs_samples", "dt", periods).alias("psa"), TR.spectrum_at("obs_samples", "dt", periods, "FAS").alias("fas"))
    rows = s.select("pair_id", F.explode(Q.spectral_qc(periods, F.col("psa"), F.col("n"), F.col("dt"))).alias("q"), "fas")
    return rows.select("pair_id", "q.period_s", F.col("q.amplitude").alias("psa"), "q.qc_status", F.element_at("fas", 1).alias("fas_shortest"))


@query()
def trace_pairs(spark, d):
    """Correlation, delay and delay-corrected correlation of trace pairs."""
    return _traces(spark, d).select("pair_id", TR.pair_struct("obs_samples", "syn_samples", "dt").alias("m")).select("pair_id", "m.*")


@query()
def trace_spectrogram(spark, d):
    """Power by period and time, averaged over the traces."""
    s = TR.spectrogram_rows(_traces(spark, d), ["pair_id"], "obs_samples", "dt", nfft=32, overlap=16)
    return s.groupBy("period_s", "time_s").agg(F.count(F.lit(1)).alias("n"), F.avg("power").alias("mean_power"))


# ---------------------------------------------------------------- selections, resume, review


@query("SELECT seq FROM v_qc WHERE contains(event_id, '1') AND component = 'N' AND qc_status <> 'pass' AND contains(qc_reason, 'snr')")
def trace_filter(spark, d):
    """Trace rows by event, component, acceptance and reason."""
    q = view(spark, d, "v_qc").withColumns({"reject": F.col("qc_status") != "pass", "reject_reason_all": F.col("qc_reason")})
    return SEL.filter_traces(q, event="1", component="n", accepted=False, reason="SNR").select("seq")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1994-03-01' AND DATE '1995-02-28'", views=False)
def date_range_filter(spark, d):
    """Rows from the start of one day to the end of another."""
    o = table(spark, d, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp"))
    return o.where(SEL.day_range("t", "1994-03-01", "1995-02-28")).select("o_orderkey")


@query("SELECT DISTINCT event_id, station, 'pending' AS status FROM v_qc WHERE qc_status = 'fail'")
def review_list(spark, d):
    """Distinct events and stations that are to be reviewed."""
    return SEL.review_queue(view(spark, d, "v_qc").where("qc_status = 'fail'"))


@query("SELECT row_id FROM v_metrics m ANTI JOIN (SELECT DISTINCT event_id, station FROM v_qc WHERE qc_status = 'fail') q USING (event_id, station)")
def resumed_work(spark, d):
    """Rows whose keys are not done yet."""
    done = view(spark, d, "v_qc").where("qc_status = 'fail'")
    return Q.resume(view(spark, d, "v_metrics"), done, ["event_id", "station"]).select("row_id")


@query(
    """SELECT event_id, station, min_by(channel, CASE WHEN channel LIKE 'BH%' THEN concat('0', channel) WHEN channel LIKE 'HN%' THEN concat('1', channel) ELSE concat('2', channel) END) AS channel
FROM (SELECT DISTINCT event_id, station, concat(CASE component WHEN 'Z' THEN 'EH' WHEN 'N' THEN 'HN' ELSE 'BH' END, component) AS channel FROM v_metrics) GROUP BY ALL"""
)
def preferred_traces(spark, d):
    """One channel per event and station, preferred prefixes first."""
    kind = F.when(F.col("component") == "Z", F.lit("EH")).when(F.col("component") == "N", F.lit("HN")).otherwise(F.lit("BH"))
    t = view(spark, d, "v_metrics").select("event_id", "station", F.concat(kind, "component").alias("channel")).distinct()
    return SEL.select_traces(t, ["event_id", "station"]).select("event_id", "station", "channel")


@query(f"SELECT row_id FROM v_metrics WHERE value_obs BETWEEN 10 AND 20 AND band IN ('1-2 sec', '2-3 sec')")
def range_and_band_filter(spark, d):
    m = view(spark, d, "v_metrics")
    return m.where(SEL.in_range(m, ["missing", "value_obs"], (10, 20)) & SEL.in_bands(m, ["1_2 s", "2-3 sec"], ["band"])).select("row_id")


@query("SELECT station FROM v_stations WHERE mapped_region_type IN ('ASIA', 'EUROPE') AND NOT (lon BETWEEN -118.5 AND -118 AND lat BETWEEN 33 AND 34)")
def region_filter(spark, d):
    """Stations of some regions and outside a box."""
    s = view(spark, d, "v_stations").withColumn("regions", F.concat(F.lit("x;"), F.col("mapped_region_type")))
    return s.where(SEL.in_regions("regions", ["asia", "Europe"]) & SEL.in_bounds(s, (-118.5, -118.0, 33.0, 34.0), "outside", ["lon"], ["lat"])).select("station")


# ---------------------------------------------------------------- figures, summaries, clusters


@query("SELECT coalesce(mapped_region_type, 'unknown') AS mapped_region_type, count(*) AS n FROM v_stations GROUP BY 1")
def region_counts(spark, d):
    return V.counts_by(view(spark, d, "v_stations"), "mapped_region_type")


@query(f"WITH {_RES} SELECT row_id FROM res ORDER BY abs(log2_residual) DESC, station, event_id, row_id LIMIT 100")
def top_markers(spark, d):
    """The rows with the greatest absolute values, a report of the top hundred."""
    m = metrics(spark, d).withColumns({"lat": F.lit(33.0), "lon": F.lit(-118.0), "station": F.concat("station", F.format_string("%012d", F.lit(0)))})
    order = F.abs("log2_residual").desc()
    top = V.markers(m, "log2_residual", "lat", "lon", 200)
    return top.orderBy(order, "station", "event_id", "row_id").limit(100).select("row_id")


@query(f"WITH {_RES}, {_PATHS} SELECT row_id, {r6('distance_km')} AS distance_km FROM paths WHERE distance_km <= 20 ORDER BY round(distance_km, 6), event_id, station, row_id LIMIT 60")
def nearest_rows(spark, d):
    """The nearest records within a distance, a report of sixty."""
    p = _paths(spark, d).withColumn("distance_km", F.round("distance_km", 6)).withColumn("station", F.concat("station", F.lit("|"), F.format_string("%015d", "row_id")))
    return V.nearest_records(p, most_km=20.0, most=60).select("row_id", "distance_km")


@query("SELECT station, dependent, count(*) AS n, CAST(sum(CAST(round(value * 1e5) AS BIGINT)) AS BIGINT) AS total, CAST(min(pos) AS INTEGER) AS x_position FROM (SELECT m.*, dense_rank() OVER (ORDER BY station) - 1 AS pos FROM v_metrics m), LATERAL (VALUES ('value_obs', value_obs), ('value_syn', value_syn)) v(dependent, value) GROUP BY 1, 2")
def scatter_series(spark, d):
    """Long rows of several value columns over a text axis, numbered."""
    s = V.scatter(view(spark, d, "v_metrics"), "station", ["value_obs", "value_syn"])
    return s.groupBy("station", "dependent").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 1e5).cast("bigint")).alias("total"), F.min("x_position").cast("int").alias("x_position"))


@query("SELECT s_name AS \"Station\", s_nationkey AS \"Nation\" FROM supplier", views=False)
def shown_table(spark, d):
    """Columns under their display names."""
    return V.shown(table(spark, d, "supplier"), ["s_name", "s_nationkey", "none"], {"s_name": "Station", "s_nationkey": "Nation"})


@query(
    """SELECT count(*) AS tasks, count(*) * 5 AS metric_evaluations, count(DISTINCT event_id) AS events, count(DISTINCT station) AS stations, round(count(*) * 60e0 / 3600, 6) + 0e0 AS cpu_hours,
 round(ceil(count(*) / 16e0) * 60e0 / 3600, 6) + 0e0 AS wall_hours, least(count(*), 16) * 2e0 AS memory_gb FROM (SELECT DISTINCT event_id, station, model FROM v_metrics)"""
)
def task_totals(spark, d):
    """Tasks, evaluations and hours of a plan."""
    return W.task_summary(view(spark, d, "v_metrics").select("event_id", "station", "model").distinct(), 5, parallel=16)


@query(
    f"""WITH p AS (SELECT station, CAST(left(station, 1) = 'S' AS INTEGER) + CAST(vs30 > 700 AS INTEGER) AS cluster, vs30 / 1e2 AS a, lat AS b FROM v_stations), c AS (SELECT cluster, avg(a) AS ca, avg(b) AS cb FROM p GROUP BY 1)
SELECT cluster, count(*) AS size, {r6("avg(sqrt(pow(a - ca, 2) + pow(b - cb, 2)))")} AS mean_distance, {r6("max(sqrt(pow(a - ca, 2) + pow(b - cb, 2)))")} AS max_distance FROM p JOIN c USING (cluster) GROUP BY 1"""
)
def cluster_sizes(spark, d):
    """Size, and mean and greatest distance to the centre, of given clusters."""
    s = view(spark, d, "v_stations")
    p = s.select("station", F.array(F.col("vs30") / 100, F.col("lat")).alias("features"))
    a = s.select("station", ((F.left("station", F.lit(1)) == "S").cast("int") + (F.col("vs30") > 700).cast("int")).alias("cluster"))
    return ML.cluster_summary(a, p, "station")


@query(f"WITH {_RES} SELECT station, {r6('avg(log2_residual) FILTER (metric = $$PGA$$)')} AS \"f_PGA\", {r6('avg(log2_residual) FILTER (metric = $$PGV$$)')} AS \"f_PGV\", CAST(count(DISTINCT metric) FILTER (metric IN ('PGA', 'PGV')) AS INTEGER) AS features_present FROM res GROUP BY 1 HAVING features_present >= 1")
def station_fingerprints(spark, d):
    """Station by feature means with the number of features present."""
    return GEO.fingerprint(metrics(spark, d), "metric", "log2_residual", wanted=["PGA", "PGV"], prefix="f_")


@query(
    f"""WITH {_RES}, {_PATHS}, x AS (SELECT event_id, station, metric, avg(ln(value_obs * greatest(1e-3, distance_km))) AS v, count(*) AS n FROM paths GROUP BY ALL), e AS (SELECT event_id, metric, avg(v) AS m FROM x GROUP BY ALL)
SELECT 'observed' AS dataset, metric, event_id, station, {r6("v")} AS value_raw, n AS n_rows, {r6("m")} AS event_mean, {r6("v - m")} AS value FROM x JOIN e USING (event_id, metric)"""
)
def scaled_event_values(spark, d):
    """Observed values times distance, as logarithms, less their event's mean."""
    return GEO.scaled_events(_paths(spark, d), ["metric"])


@query(
    f"""WITH {_RES}, x AS (SELECT metric, event_id, station, avg(log2_residual) AS v, count(*) AS n FROM res GROUP BY ALL), e AS (SELECT metric, event_id, avg(v) AS m FROM x GROUP BY ALL)
SELECT metric, event_id, station, {r6("v")} AS value_raw, n AS n_rows, {r6("m")} AS event_mean, {r6("v - m")} AS value FROM x JOIN e USING (metric, event_id)"""
)
def residual_event_values(spark, d):
    return GEO.residual_events(metrics(spark, d), ["metric"])


@query("SELECT event_id, event_lat FROM v_events ORDER BY event_lat DESC, event_id LIMIT 7")
def anchor_events(spark, d):
    """The seven northernmost events, as anchors of corridors."""
    return GEO.select_anchors(view(spark, d, "v_events").select("event_id", "event_lat"), "max", column="event_lat", top=7)


@query("SELECT station, lat, lon, count(*) AS n_rows, count(DISTINCT event_id) AS n_events FROM (SELECT m.station, event_id, round(lat, 6) + 0e0 AS lat, round(lon, 6) + 0e0 AS lon FROM v_metrics m JOIN v_stations USING (station)) GROUP BY ALL")
def station_list(spark, d):
    """Stations of a field with their rows and events."""
    return M.station_catalog(_field(spark, d))


@query("SELECT concat('<Placemark><name>', event_name, '</name><Point><coordinates>', CAST(round(event_lon, 3) AS DECIMAL(9, 3)), ',', CAST(round(event_lat, 3) AS DECIMAL(9, 3)), '</coordinates></Point></Placemark>') AS value FROM v_events")
def event_placemarks(spark, d):
    """Placemarks of events, one text row each."""
    e = view(spark, d, "v_events").select("event_name", *[F.round(c, 3).cast("decimal(9,3)").alias(c) for c in ("event_lat", "event_lon")])
    return TB.kml(e, "event_name", "event_lat", "event_lon")


@query()
def corridor_events(spark, d):
    """Events inside corridors across the polygons' boundaries, by corridor."""
    s = view(spark, d, "v_stations").select("station", "lat", "lon")
    c = cut_lineage(GE.boundary_corridors(s, boxes(spark), "station", "lat", "lon", near_km=3.0, inside_km=15.0, outside_km=15.0))
    e = view(spark, d, "v_events").select("event_id", "event_lat", "event_lon", "depth_km")
    found = GE.events_in_corridors(e, c, "event_lat", "event_lon", depth="depth_km", depths=(2.0, 12.0))
    return found.groupBy("corridor_id").agg(F.count_distinct("event_id").alias("n_events"), F.min("event_id").alias("first_event"))


@query(
    f"""WITH {_RES}, {_CENTRE}, x AS (SELECT station, CASE mapped_region_type WHEN 'ASIA' THEN 1 WHEN 'EUROPE' THEN -1 END AS side, event_id, avg(field_centered) AS v FROM c JOIN v_stations USING (station) GROUP BY ALL),
m AS (SELECT side, station, avg(v) AS m FROM x WHERE side IS NOT NULL GROUP BY ALL), n AS (SELECT count(DISTINCT event_id) AS n_events FROM x WHERE side IS NOT NULL)
SELECT {r6("avg(m) FILTER (side = 1) - avg(m) FILTER (side = -1)")} AS estimate, count(*) FILTER (side = 1) AS n_left, count(*) FILTER (side = -1) AS n_right, any_value(n_events) AS n_events FROM m, n HAVING n_left >= 3 AND n_right >= 3 AND any_value(n_events) >= 2"""
)
def region_contrast_estimate(spark, d):
    """The contrast of two regions' station means, without its interval."""
    return SP.bootstrap_contrast(M.center_by_event(_field(spark, d)), "mapped_region_type", ["ASIA"], ["EUROPE"], samples=10).select("estimate", "n_left", "n_right", "n_events")


@query()
def contrast_effects(spark, d):
    """Contrasts of regions with percent effects and whether their bounds leave out 0."""
    rows = M.center_by_event(_field(spark, d))
    return GEO.contrast_table(rows, [("asia_minus_europe", ("ASIA",), ("EUROPE",), "mapped_region_type"), ("asia_minus_africa", ("ASIA",), ("AFRICA",), "mapped_region_type")], samples=100)


@query(
    f"""WITH {_RES}, s AS (SELECT metric, station, avg(log2_residual) AS v FROM res GROUP BY ALL), x AS (SELECT metric, mapped_region_type AS g, v FROM s JOIN v_stations USING (station)), k AS (SELECT metric, g FROM x GROUP BY ALL HAVING count(*) >= 5),
r AS (SELECT metric, g, v, rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2e0 AS rk FROM x JOIN k USING (metric, g)),
q AS (SELECT metric, sum(q) AS q, sum(n) AS n, count(*) AS groups FROM (SELECT metric, g, sum(rk) * sum(rk) / count(*) AS q, count(*) AS n FROM r GROUP BY ALL) GROUP BY 1), t AS (SELECT metric, sum(pow(c, 3) - c) AS t FROM (SELECT metric, count(*) AS c FROM r GROUP BY metric, v) GROUP BY 1)
SELECT metric, {r6("(12e0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (pow(n, 3) - n))")} AS h, CAST(groups - 1 AS INTEGER) AS df, CAST(n AS BIGINT) AS n FROM q JOIN t USING (metric) WHERE groups >= 2"""
)
def kruskal_by_metric(spark, d):
    """Kruskal-Wallis over zones for every metric."""
    m = metrics(spark, d).groupBy("metric", "station").agg(F.avg("log2_residual").alias("v")).join(view(spark, d, "v_stations").select("station", "mapped_region_type"), "station")
    return SP.kruskal_wallis(m, "v", "mapped_region_type", by=["metric"]).select("metric", "h", "df", "n")


@query()
def zone_tests_by_metric(spark, d):
    """For every metric: Kruskal-Wallis over zones, Moran's I with its permutation p-value, and the contrasts of zones."""
    rows = M.center_by_event(_field(spark, d))
    return GEO.grouped_tests(rows, ["metric"], "mapped_region_type", [("asia_minus_europe", ("ASIA",), ("EUROPE",))], permutations=49, samples=50)


@query()
def two_sample_bootstrap(spark, d):
    """Difference of means of both models' residuals with a bootstrap interval, by metric."""
    return SP.bootstrap_difference(metrics(spark, d), "log2_residual", "model", "cvmsi", "cvms5", by=["metric"], samples=200)


@query(
    """WITH f AS (SELECT DISTINCT concat('/runs/', model, CASE WHEN metric IN ('PGA', 'PGV') THEN '_v1' ELSE '_v2' END) AS folder, model AS alias FROM v_metrics), n AS (SELECT alias, count(*) AS n FROM f GROUP BY 1)
SELECT alias, CASE WHEN n > 1 THEN concat(alias, '_', row_number() OVER (PARTITION BY alias ORDER BY folder)) ELSE alias END AS name, folder, n > 1 AS ambiguous FROM f JOIN n USING (alias)"""
)
def model_alias_report(spark, d):
    """Folders by model alias; where an alias stands for several, they are told apart and reported."""
    v = F.when(F.col("metric").isin("PGA", "PGV"), F.lit("_v1")).otherwise(F.lit("_v2"))
    folders = view(spark, d, "v_metrics").select(F.concat(F.lit("/runs/"), "model", v).alias("folder"), F.col("model").alias("alias")).distinct()
    return J.alias_report(folders, "alias", "folder")
