"""Polygons from GeoJSON, as rows of rings."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

POLYGON = T.StructType(
    [
        T.StructField("region_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("shell", T.IntegerType()),
        T.StructField("ring_role", T.StringType()),
        T.StructField("ring_lons", T.ArrayType(T.DoubleType())),
        T.StructField("ring_lats", T.ArrayType(T.DoubleType())),
    ]
)
_NAME_KEYS = ("name", "Name", "NAME", "region_name", "title", "id")


def parse_geojson(document: dict) -> list[tuple]:
    """Rows of ``POLYGON`` from a FeatureCollection, a Feature or a geometry; equal names get a number."""
    kind = document.get("type")
    features = document["features"] if kind == "FeatureCollection" else [document] if kind == "Feature" else [{"geometry": document, "properties": {}}]
    rows, taken = [], {}
    for k, f in enumerate(features):
        geometry, properties = f.get("geometry") or {}, f.get("properties") or {}
        shells = {"Polygon": [geometry.get("coordinates")], "MultiPolygon": geometry.get("coordinates")}.get(geometry.get("type"))
        if not shells:
            continue
        name = next((str(properties[n]).strip() for n in _NAME_KEYS if str(properties.get(n) or "").strip()), f"polygon_{k + 1}")
        taken[name] = taken.get(name, 0) + 1
        shown = name if taken[name] == 1 else f"{name}_{taken[name]}"
        props = {str(p): None if v is None else str(v) for p, v in properties.items()}
        for s, rings in enumerate(shells):
            for r, ring in enumerate(rings):
                rows.append((k + 1, shown, props, s, "hole" if r else "outer", [float(c[0]) for c in ring], [float(c[1]) for c in ring]))
    return rows


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(parse_geojson(json.loads(Path(path).read_text())), POLYGON)


def select_polygons(polygons: DataFrame, selector="all") -> DataFrame:
    """All polygons, those with given names, or those whose properties equal a mapping; ValueError if there are none."""
    from pyspark.sql import functions as F

    if selector == "all" or selector is None:
        out = polygons
    elif isinstance(selector, dict):
        out = polygons
        for k, v in selector.items():
            out = out.where(F.lower(F.trim(F.col("properties")[str(k)])) == str(v).strip().lower())
    else:
        names = [str(s).strip().lower() for s in ([selector] if isinstance(selector, str) else selector)]
        out = polygons.where(F.lower("name").isin(names) | F.exists(F.map_values("properties"), lambda v: F.lower(v).isin(names)))
    if out.isEmpty():
        raise ValueError(f"no polygon matches {selector!r}")
    return out
