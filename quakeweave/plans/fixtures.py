"""Seismic views over the driver's tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakeweave.operators.metrics import input_bytes
from quakeweave.runtime import table

VIEWS = {
    "v_stations": """SELECT s_name AS station, concat('N', CAST(s_nationkey AS STRING)) AS network, 33e0 + (s_suppkey % 40) * 5e-2 AS lat,
 -119e0 + floor(s_suppkey / 4e1) * 5e-2 AS lon, 2e2 + (s_acctbal + 1e3) / 1e1 AS vs30, r_name AS mapped_region_type
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_events": """SELECT concat('ev', CAST(p_partkey AS STRING)) AS event_id, p_name AS event_name, 33e0 + ((p_partkey * 7919) % 2000) / 1e3 AS event_lat,
 -119e0 + ((p_partkey * 104729) % 2500) / 1e3 AS event_lon, 1e0 + (p_partkey % 17) AS depth_km, 3.5e0 + p_size / 2e1 AS magnitude FROM part""",
    "v_metrics": """SELECT l_orderkey * 10 + l_linenumber AS row_id, concat('ev', CAST(l_partkey AS STRING)) AS event_id, s_name AS station,
 CASE l_orderkey % 3 WHEN 0 THEN 'Z' WHEN 1 THEN 'N' ELSE 'E' END AS component,
 CASE l_linestatus WHEN 'F' THEN 'cvmsi' ELSE 'cvms5' END AS model,
 CASE l_returnflag WHEN 'A' THEN '1-2 sec' WHEN 'N' THEN '2-3 sec' ELSE '3-5 sec' END AS band,
 CASE l_linenumber WHEN 1 THEN 'PGA' WHEN 2 THEN 'PGV' WHEN 3 THEN 'PGD' WHEN 4 THEN 'PSA' WHEN 5 THEN 'FAS' WHEN 6 THEN 'CAV' ELSE 'arias_duration' END AS metric,
 l_extendedprice / 1e3 AS value_obs, l_extendedprice / 1e3 * (1e0 - l_discount) * (1e0 + l_tax) * (5e-1 + l_quantity / 5e1) AS value_syn
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "v_qc": """SELECT l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_linenumber % 2 = 1 THEN 'observed' ELSE 'synthetic' END AS source,
 concat('ev', CAST(l_partkey % 50 AS STRING)) AS event_id, s_name AS station, CASE l_orderkey % 3 WHEN 0 THEN 'Z' WHEN 1 THEN 'N' ELSE 'E' END AS component,
 CASE l_returnflag WHEN 'A' THEN '1-2 sec' WHEN 'N' THEN '2-3 sec' ELSE '3-5 sec' END AS passband,
 CASE WHEN l_orderkey % 2 = 0 THEN 'amplitude' ELSE 'spectral' END AS metric_group, CASE WHEN l_orderkey % 2 = 0 THEN 'PGA' ELSE 'PSA' END AS metric,
 CASE WHEN l_orderkey % 2 = 1 THEN 1e0 + l_orderkey % 3 END AS period_s,
 CASE WHEN l_discount > 0.08 OR l_quantity < 3 THEN 'fail' ELSE 'pass' END AS qc_status,
 concat(CASE WHEN l_discount > 0.08 THEN 'low_snr' ELSE '' END, CASE WHEN l_discount > 0.08 AND l_quantity < 3 THEN ';' ELSE '' END, CASE WHEN l_quantity < 3 THEN 'record_too_short' ELSE '' END) AS qc_reason
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "v_traces": """SELECT a.vec_id AS pair_id, a.label AS grp, a.embedding AS obs, b.embedding AS syn FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0""",
}
_TABLES = ("supplier", "nation", "region", "part", "lineitem", "embeddings", "orders", "events")


def with_views(body: str) -> str:
    """SQL for DuckDB with the views that the body names as common table expressions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = body.strip()
    return f"WITH {ctes},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"


#: Tables of suppliers are broadcast up to so many bytes of file (about 22 for each supplier).
BROADCAST_BYTES = 2 * 1024 * 1024


def view(spark: SparkSession, d: str, name: str, *, lookup: bool = False) -> DataFrame:
    """The same view in Spark; with ``lookup``, suppliers are broadcast where they are few, so that the other rows are not shuffled for them."""
    text = VIEWS[name]
    names = [t for t in _TABLES if re.search(rf"\b{t}\b", text)]
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(names)})\b", r"\1 {\2}", text)
    tables = {t: table(spark, d, t) for t in names}
    if lookup and "supplier" in tables and input_bytes(tables["supplier"]) <= BROADCAST_BYTES:
        tables |= {t: F.broadcast(tables[t]) for t in ("supplier", "nation", "region") if t in tables}
    return spark.sql(text, **tables)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to some digits, without a negative zero."""
    return df.select(*[(F.round(F.col(f"`{f.name}`").cast("double"), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def r6(x: str) -> str:
    return f"(round({x}, 6) + 0e0)"


def r8(x: str) -> str:
    return f"(round({x}, 8) + 0e0)"


def hav(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371.0088e0 * asin(sqrt(least(1e0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"


def azi(a: str, b: str, c: str, d: str) -> str:
    x = f"degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b}))))"
    return f"((({x}) % 360 + 360) % 360)"
