"""Reading and writing tables, registries of outputs, and run manifests."""

from __future__ import annotations

import datetime as dt
import glob
import hashlib
import json
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet by suffix (or a folder of it), JSON lines for ``.json``/``.jsonl``, else CSV with a header; CSV columns are text unless a schema is given."""
    kind = Path(path).suffix.lower()
    if kind in (".parquet", ".pq") or (not kind and Path(path).is_dir()):
        return spark.read.parquet(path)
    if kind in (".json", ".jsonl", ".ndjson"):
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", False)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_table(df: DataFrame, path: str, *, mode: str = "overwrite", partition_by: list[str] | None = None) -> str:
    """Parquet, JSON or CSV by suffix. A job commits its files at its end, so a failed one leaves the former table's readers alone only in another folder: write to a new path to keep it."""
    kind = Path(path).suffix.lower() or ".csv"
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if kind in (".parquet", ".pq"):
        w.parquet(path)
    elif kind in (".json", ".jsonl"):
        w.json(path)
    elif kind == ".csv":
        w.option("header", True).csv(path)
    else:
        raise ValueError(f"unknown table format {kind}")
    return path


def read_bundle(spark: SparkSession, sources, *, source_column: str = "source_path") -> DataFrame:
    """Several CSV files as one table by column names, each row with its file's path.

    ``sources`` is a path, a pattern, a list of them, or a mapping with exactly one of ``input_csv``,
    ``csv_dir`` and ``csv_files``.
    """
    if isinstance(sources, dict):
        given = [k for k in ("input_csv", "csv_dir", "csv_files") if sources.get(k)]
        if len(given) != 1:
            raise ValueError("give exactly one of input_csv, csv_dir, csv_files")
        sources = f"{sources['csv_dir']}/*.csv" if given[0] == "csv_dir" else sources[given[0]]
    paths = sorted({p for s in ([sources] if isinstance(sources, str) else sources) for p in (glob.glob(s) if glob.has_magic(s) else [s])})
    if not paths or any(not os.path.exists(p) for p in paths):
        raise FileNotFoundError(f"no such file: {sources}")
    # Files with equal headers are one scan; the others are united by name.
    by_header: dict[tuple, list[str]] = {}
    for p in paths:
        with open(p) as f:
            by_header.setdefault(tuple(f.readline().rstrip("\r\n").split(",")), []).append(p)
    parts = [spark.read.option("header", True).csv(ps).withColumn(source_column, F.col("_metadata.file_path")) for ps in by_header.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def file_inventory(spark: SparkSession, root: str, *, dataset: str, suffixes: tuple[str, ...] = (), digest: bool = True) -> DataFrame:
    """Path, size, time and SHA-256 of the files below a folder, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if suffixes:
        files = files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin([s.lower() for s in suffixes]))
    cols = [F.lit(dataset).alias("dataset"), "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at")]
    return files.select(*cols, *([F.sha2("content", 256).alias("sha256")] if digest else []))


def write_dashboard_dataset(df: DataFrame, root: str, *, partitioned: bool = True) -> str:
    """The long metric table, by default in folders by model, band and metric.

    The values are kept as columns too, folder names being made safe.
    """
    if not partitioned:
        df.write.mode("overwrite").parquet(root)
        return root
    from quakeweave.functions.text import token

    keys = {f"{c}_key": token(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("model", "band", "metric")}
    # One file per folder and task would be many; rows of a folder are brought together first, large ones staying split by AQE.
    df.withColumns(keys).repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(root)
    return root


def read_dashboard_dataset(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


def records_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON text, NULLs written out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def kml(points: DataFrame, name: str, lat: str, lon: str) -> DataFrame:
    """Placemarks of the points with a position, one text row each."""
    text = F.concat(F.lit("<Placemark><name>"), _xml(name), F.lit("</name><Point><coordinates>"), F.col(lon).cast("string"), F.lit(","), F.col(lat).cast("string"), F.lit("</coordinates></Point></Placemark>"))
    return points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(text.alias("value"))


def _xml(c: str):
    t = F.coalesce(F.col(c).cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


# ---------------------------------------------------------------- small files of the driver


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def stable_hash(value, length: int | None = None) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()[:length]


def slugify(text: str, most: int = 96) -> str:
    return re.sub(r"[^a-z0-9]+", "_", str(text).lower()).strip("_")[:most].strip("_") or "unnamed"


def write_json(path: str, payload) -> None:
    """Write beside the target and rename, so that a reader never meets half a file."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    part = p.with_name(f".{p.name}.{os.getpid()}.part")
    part.write_text(json.dumps(payload, indent=2, sort_keys=True, default=str) + "\n")
    os.replace(part, p)


def read_json(path: str):
    return json.loads(Path(path).read_text())


def run_id(now: dt.datetime | None = None) -> str:
    return (now or dt.datetime.now(dt.timezone.utc)).strftime("%Y%m%dT%H%M%SZ")


def artifact_path(root: str, kind: str, name: str, config: dict, extension: str, subdir: str = "") -> str:
    digest = stable_hash({"kind": kind, "name": name, "config": config}, 10)
    return str(Path(root, subdir, f"{slugify(name)}__{digest}.{extension.lstrip('.')}"))


class ArtifactRegistry:
    """Append-only record of written files, one JSON line each."""

    def __init__(self, path: str):
        self.path = Path(path)

    def record(self, artifact: str, *, kind: str, name: str, status: str = "written", metadata: dict | None = None) -> dict:
        row = {"artifact_path": artifact, "kind": kind, "name": name, "status": status, "metadata": metadata or {}, "recorded_at": dt.datetime.now(dt.timezone.utc).isoformat()}
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with self.path.open("a") as f:
            f.write(canonical_json(row) + "\n")
        return row

    def frame(self, spark: SparkSession) -> DataFrame:
        schema = "artifact_path string, kind string, name string, status string, metadata map<string,string>, recorded_at string"
        return spark.read.schema(schema).json(str(self.path)) if self.path.exists() else spark.createDataFrame([], schema)

    def missing(self) -> list[dict]:
        rows = [json.loads(x) for x in self.path.read_text().splitlines()] if self.path.exists() else []
        return [r for r in rows if not Path(r["artifact_path"]).exists()]
