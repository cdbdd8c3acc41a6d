"""Queries of the data-quality problems on the metric and site tables (p2, p3, p5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeweave.functions import labels as L
from quakeweave.operators import eav, orphans, proximity
from quakeweave.runtime import cut_lineage, table

NEAR_KM = 0.12
EDGE_REGION = "LAB"

# ------------------------------------------------------------------------- p2


def _sites(spark: SparkSession, d: str) -> DataFrame:
    """Each site once, the latest of its rows, with a usable position."""
    cols = ["site_id", "station_lat", "station_lon", "mapped_region", "lab_edge_distance_km"]
    rows = table(spark, d, "example_site_metadata").where(F.col("site_id").isNotNull())
    one = rows.groupBy("site_id").agg(F.max(F.struct("loaded_at", *cols[1:])).alias("r")).select("site_id", *[F.col(f"r.{c}") for c in cols[1:]])
    return one.where(L.usable_position("station_lat", "station_lon"))


#: Region labels of at most so many regions are broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_REGIONS = 100_000


def _mislabelled(rows: DataFrame, rings: DataFrame, regions: int, true_label) -> DataFrame:
    known = rings.groupBy("region_id").agg(F.min(L.label_core(true_label)).alias("true_label"))
    known = F.broadcast(known) if regions <= BROADCAST_REGIONS else known
    same = F.col("label").eqNullSafe(F.col("true_label"))
    return rows.where(F.col("region_id").isNotNull()).join(known, "region_id").where(~same)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Near sites, and sites and rows whose region or distance contradicts their position."""
    rings = table(spark, d, "region_rings")
    index = proximity.RegionIndex(rings)
    sites = cut_lineage(_sites(spark, d), "sites")
    near = proximity.near_pairs(sites, "site_id", "station_lat", "station_lon", NEAR_KM).select(F.lit("near").alias("case_kind"), "left_id", "right_id")

    labelled = sites.select("site_id", "station_lat", "station_lon", L.label_core("mapped_region").alias("label"))
    at_sites = proximity.locate_regions(labelled, "station_lat", "station_lon", index)
    code_type = F.concat_ws(":", "region_code", "region_type")
    site_region = _mislabelled(at_sites, rings, index.regions, code_type).select(F.lit("site_region").alias("case_kind"), F.col("site_id").alias("left_id"), F.col("region_id").alias("right_id"))

    rows = table(spark, d, "example_metrics_snapshot").where(L.usable_position("sta_lat", "sta_lon"))
    rows = rows.select("row_id", "sta_lat", "sta_lon", L.label_core("region_name").alias("label"))
    at_rows = proximity.locate_regions(rows, "sta_lat", "sta_lon", index)
    row_region = _mislabelled(at_rows, rings, index.regions, F.col("region_name")).select(F.lit("row_region").alias("case_kind"), F.col("row_id").alias("left_id"), F.col("region_id").alias("right_id"))

    edge = rings.where(L.upper_key("region_code") == EDGE_REGION)
    region = edge.agg(F.min("region_id").alias("right_id"))
    stated = sites.where(F.col("lab_edge_distance_km").isNotNull()).select("site_id", "station_lat", "station_lon", F.col("lab_edge_distance_km").alias("stated"))
    measured = proximity.boundary_distance(stated, "station_lat", "station_lon", edge)
    wrong = F.isnan("stated") | (F.abs(F.col("stated") - F.col("boundary_km")) > 1 + 0.1 * F.col("boundary_km"))
    lab_edge = measured.where(F.col("boundary_km").isNotNull() & wrong).crossJoin(F.broadcast(region)).select(F.lit("lab_edge").alias("case_kind"), F.col("site_id").alias("left_id"), "right_id")
    return near.unionByName(site_region).unionByName(row_region).unionByName(lab_edge)


# ------------------------------------------------------------------------- p3

ENTITY = ["event_id", "station", "component", "model", "band"]
TOLERANCE = 1.005


def _attribute_rows(spark: SparkSession, d: str) -> DataFrame:
    # In two steps, so that each label is brought into shape once.
    rows = table(spark, d, "example_metrics_snapshot").select(
        L.lower_key("event_id").alias("event_id"),
        L.upper_key("station").alias("station"),
        L.upper_key("component").alias("component"),
        L.lower_key("model").alias("model"),
        L.band_key("band").alias("band"),
        L.metric_key("metric").alias("name"),
        L.metric_period("metric", "period_s").alias("period"),
        L.finite("value_obs").alias("obs"),
        L.finite("value_syn").alias("syn"),
        "loaded_at",
        "row_id",
    )
    present = F.col("name").isNotNull()
    for c in ENTITY:
        present = present & F.col(c).isNotNull()
    return rows.where(present).withColumn("attribute_name", L.attribute_name(F.col("name"), F.col("period"))).drop("name", "period")


def p3_wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per event, station, component, model and band, with a pair of columns per metric and period."""
    return eav.widen(_attribute_rows(spark, d), ENTITY, "attribute_name", ["obs", "syn"], ["loaded_at", "row_id"], tolerance=TOLERANCE)


def p3_cells(spark: SparkSession, d: str) -> DataFrame:
    """The wide table's cells as rows again, with what it says of each entity: every value of it can be compared."""
    wide = p3_wide(spark, d)
    cells = [c for c in wide.columns if c not in (*ENTITY, "n_attributes", "n_rows", "conflicts")]
    long = wide.withColumn("n_conflicts", F.size("conflicts")).unpivot([*ENTITY, "n_attributes", "n_rows", "n_conflicts"], cells, "cell", "value")
    return long.where(F.col("value").isNotNull())


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The cells of the wide table for which the rows disagree."""
    return p3_wide(spark, d).select(*ENTITY, F.explode("conflicts").alias("attribute_name"))


# ------------------------------------------------------------------------- p5


def _tracked(spark: SparkSession, d: str) -> orphans.OrphanTracker:
    rows = table(spark, d, "example_metrics_snapshot")
    refs = orphans.references(rows, "row_id", "loaded_at", {"example_events": L.lower_key("event_id"), "selected_stations": L.lower_key("station")})
    changes = orphans.parent_changes(table(spark, d, "example_events"), "example_events", L.lower_key("event_id"))
    changes = changes.unionByName(orphans.parent_changes(table(spark, d, "selected_stations"), "selected_stations", L.lower_key("station")))
    return orphans.track_by_month(refs, changes, orphans.OrphanTracker(spark))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """References of metric rows that led nowhere when the row was loaded."""
    return _tracked(spark, d).snapshot().select("row_id", "ref_table", "orphan_kind", F.date_format("at", "yyyy-MM").alias("period_month"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, kind and month."""
    return _tracked(spark, d).counts()


# ------------------------------------------------------------------------- SQL

SQL_KEYS = r"""
rows_ AS (SELECT row_id, loaded_at, computed_at, log2_residual, sta_lat, sta_lon, region_name, value_obs, value_syn,
  CASE WHEN lower(trim(event_id)) NOT IN ('','nan','none','null') THEN lower(trim(event_id)) END AS event_id,
  CASE WHEN lower(trim(station)) NOT IN ('','nan','none','null') THEN upper(trim(station)) END AS station,
  CASE WHEN lower(trim(component)) NOT IN ('','nan','none','null') THEN upper(trim(component)) END AS component,
  CASE WHEN lower(trim(model)) NOT IN ('','nan','none','null') THEN lower(trim(model)) END AS model,
  CASE WHEN regexp_matches(lower(trim(band)), '^[0-9.]+ *[-_] *[0-9.]+ *(s|sec)$')
    THEN regexp_extract(lower(trim(band)), '^([0-9.]+) *[-_] *([0-9.]+)', 1) || '-' || regexp_extract(lower(trim(band)), '^([0-9.]+) *[-_] *([0-9.]+)', 2) || ' sec' END AS band,
  CASE WHEN lower(trim(metric)) IN ('','nan','none','null') THEN NULL
    WHEN regexp_matches(upper(trim(metric)), '^(PSA|FAS)([^A-Z]|$)') THEN upper(trim(metric))[1:3]
    ELSE regexp_replace(upper(trim(metric)), '[^A-Z0-9]+', '_', 'g') END AS metric,
  CASE WHEN isfinite(period_s) AND period_s > 0 THEN period_s ELSE TRY_CAST(regexp_extract(metric, '([0-9.]+)', 1) AS DOUBLE) END AS period_s
  FROM example_metrics_snapshot)"""

P3_SQL = f"""
WITH {SQL_KEYS},
a AS (SELECT *, CASE WHEN metric IN ('PSA','FAS') THEN metric || '@' || printf('%.2f', period_s) ELSE metric END AS attribute_name,
  CASE WHEN isfinite(value_obs) AND value_obs > 0 THEN value_obs END AS o, CASE WHEN isfinite(value_syn) AND value_syn > 0 THEN value_syn END AS s FROM rows_)
SELECT event_id, station, component, model, band, attribute_name FROM a
WHERE event_id IS NOT NULL AND station IS NOT NULL AND component IS NOT NULL AND model IS NOT NULL AND band IS NOT NULL AND attribute_name IS NOT NULL
GROUP BY ALL HAVING (count(o) >= 2 AND max(o) > 1.005 * min(o)) OR (count(s) >= 2 AND max(s) > 1.005 * min(s))"""

P3_CELLS_SQL = f"""
WITH {SQL_KEYS},
a AS (SELECT *, CASE WHEN metric IN ('PSA','FAS') THEN metric || '@' || printf('%.2f', period_s) ELSE metric END AS attribute_name, CASE WHEN isfinite(value_obs) THEN value_obs END AS o, CASE WHEN isfinite(value_syn) THEN value_syn END AS s FROM rows_),
k AS (SELECT * FROM a WHERE event_id IS NOT NULL AND station IS NOT NULL AND component IS NOT NULL AND model IS NOT NULL AND band IS NOT NULL AND attribute_name IS NOT NULL),
c AS (SELECT event_id, station, component, model, band, attribute_name, arg_max(o, {{'t': loaded_at, 'r': row_id}}) AS obs, arg_max(s, {{'t': loaded_at, 'r': row_id}}) AS syn, count(*) AS n,
  (count(o) FILTER (o > 0) >= 2 AND max(o) FILTER (o > 0) > 1.005 * min(o) FILTER (o > 0)) OR (count(s) FILTER (s > 0) >= 2 AND max(s) FILTER (s > 0) > 1.005 * min(s) FILTER (s > 0)) AS bad FROM k GROUP BY ALL),
e AS (SELECT event_id, station, component, model, band, count(*) AS n_attributes, CAST(sum(n) AS BIGINT) AS n_rows, CAST(count(*) FILTER (bad) AS INTEGER) AS n_conflicts FROM c GROUP BY ALL),
v AS (SELECT *, trim(regexp_replace(replace(lower(attribute_name), '.', 'p'), '[^a-z0-9_]+', '_', 'g'), '_') AS token FROM c)
SELECT event_id, station, component, model, band, n_attributes, n_rows, n_conflicts, token || '_obs' AS cell, obs AS value FROM v JOIN e USING (event_id, station, component, model, band) WHERE obs IS NOT NULL
UNION ALL SELECT event_id, station, component, model, band, n_attributes, n_rows, n_conflicts, token || '_syn', syn FROM v JOIN e USING (event_id, station, component, model, band) WHERE syn IS NOT NULL"""

_P5_BODY = f"""
WITH {SQL_KEYS},
parents AS (
  SELECT 'example_events' AS ref_table, lower(trim(event_id)) AS k, min(loaded_at) AS since, min(deleted_at) AS until FROM example_events GROUP BY 1, 2
  UNION ALL SELECT 'selected_stations', lower(trim(station)), min(loaded_at), min(deleted_at) FROM selected_stations GROUP BY 1, 2),
refs AS (SELECT row_id, loaded_at, 'example_events' AS ref_table, event_id AS k FROM rows_ UNION ALL SELECT row_id, loaded_at, 'selected_stations', lower(station) FROM rows_),
found AS (SELECT row_id, r.ref_table, CASE WHEN since IS NULL THEN 'missing' WHEN loaded_at < since THEN 'late' WHEN loaded_at >= until THEN 'deleted' END AS orphan_kind,
  strftime(loaded_at, '%Y-%m') AS period_month FROM refs r LEFT JOIN parents p ON r.ref_table = p.ref_table AND r.k = p.k WHERE r.k IS NOT NULL)
"""
P5_SQL = _P5_BODY + "SELECT row_id, ref_table, orphan_kind, period_month FROM found WHERE orphan_kind IS NOT NULL"
P5_COUNTS_SQL = _P5_BODY + "SELECT ref_table, orphan_kind, period_month, count(*) AS orphans FROM found WHERE orphan_kind IS NOT NULL GROUP BY 1, 2, 3"

P2_SQL = r"""
WITH core AS (SELECT site_id, arg_max(station_lat, loaded_at) AS lat, arg_max(station_lon, loaded_at) AS lon,
  max_by({'m': mapped_region}, loaded_at).m AS mapped_region, max_by({'m': lab_edge_distance_km}, loaded_at).m AS stated FROM example_site_metadata GROUP BY site_id),
sites AS (SELECT * FROM core WHERE lat BETWEEN 32 AND 36 AND lon BETWEEN -121 AND -114),
edges AS (SELECT region_id, region_code, unnest(ring_lons[:-2]) AS x0, unnest(ring_lats[:-2]) AS y0, unnest(ring_lons[2:]) AS x1, unnest(ring_lats[2:]) AS y1 FROM region_rings),
names AS (SELECT region_id, min(regexp_replace(lower(region_code || region_type), '[^a-z0-9]', '', 'g')) AS code_type, min(regexp_replace(lower(region_name), '[^a-z0-9]', '', 'g')) AS name FROM region_rings GROUP BY 1),
rws AS (SELECT row_id, sta_lat AS lat, sta_lon AS lon, region_name FROM example_metrics_snapshot WHERE sta_lat BETWEEN 32 AND 36 AND sta_lon BETWEEN -121 AND -114),
places AS (SELECT DISTINCT lat, lon FROM (SELECT lat, lon FROM sites UNION ALL SELECT lat, lon FROM rws)),
within AS (SELECT lat, lon, min(region_id) AS region_id FROM (
  SELECT lat, lon, region_id FROM places, edges WHERE (y0 > lat) <> (y1 > lat) AND lon < x0 + (lat - y0) * (x1 - x0) / (y1 - y0)
  GROUP BY lat, lon, region_id HAVING count(*) % 2 = 1) GROUP BY lat, lon),
seg AS (SELECT site_id, lat, lon, stated, x0, y0, x1, y1, (x0 - lon) * c AS ax, y0 - lat AS ay, (x1 - x0) * c AS dx, y1 - y0 AS dy FROM (
  SELECT *, cos(radians((lat + (y0 + y1) / 2) / 2)) AS c FROM sites, edges WHERE region_code = 'LAB' AND stated IS NOT NULL)),
nearest AS (SELECT *, greatest(0, least(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS t FROM seg),
dist AS (SELECT site_id, any_value(stated) AS stated, min(2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(y0 + t * (y1 - y0) - lat) / 2), 2)
  + cos(radians(lat)) * cos(radians(y0 + t * (y1 - y0))) * pow(sin(radians(x0 + t * (x1 - x0) - lon) / 2), 2))))) AS km FROM nearest GROUP BY site_id)
SELECT 'near' AS case_kind, a.site_id AS left_id, b.site_id AS right_id FROM sites a JOIN sites b ON a.site_id < b.site_id AND abs(a.lat - b.lat) < 0.002
  AND 2 * 6371.0088 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) < 0.12
UNION ALL SELECT 'site_region', site_id, region_id FROM sites JOIN within USING (lat, lon) JOIN names USING (region_id)
  WHERE CASE WHEN lower(trim(mapped_region)) IN ('nan','none','null') THEN '' ELSE coalesce(regexp_replace(lower(mapped_region), '[^a-z0-9]', '', 'g'), '') END <> code_type
UNION ALL SELECT 'row_region', row_id, region_id FROM rws JOIN within USING (lat, lon) JOIN names USING (region_id)
  WHERE CASE WHEN lower(trim(region_name)) IN ('nan','none','null') THEN '' ELSE coalesce(regexp_replace(lower(region_name), '[^a-z0-9]', '', 'g'), '') END <> name
UNION ALL SELECT 'lab_edge', site_id, (SELECT min(region_id) FROM region_rings WHERE region_code = 'LAB') FROM dist WHERE isnan(stated) OR abs(stated - km) > 1 + 0.1 * km"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p3_found": p3_found, "p3_wide": p3_wide, "p3_cells": p3_cells, "p5_found": p5_found, "p5_counts": p5_counts}
SQL = {"p2_found": P2_SQL, "p3_found": P3_SQL, "p3_cells": P3_CELLS_SQL, "p5_found": P5_SQL, "p5_counts": P5_COUNTS_SQL}
