"""Waveform files as rows: NumPy archives, one row per channel.

Pickles are not read (loading them runs code); other seismic formats need libraries that are
not part of this package.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACE = T.StructType(
    [T.StructField(n, t) for n, t in (("source", T.StringType()), ("network", T.StringType()), ("station", T.StringType()), ("location", T.StringType()), ("channel", T.StringType()), ("component", T.StringType()), ("starttime", T.StringType()), ("sampling_rate", T.DoubleType()), ("dt", T.DoubleType()), ("npts", T.IntegerType()), ("samples", T.ArrayType(T.DoubleType())))]
)


def decode_numpy(path: str, content: bytes) -> list[dict]:
    """Traces of a ``.npy`` or ``.npz`` file: ``data`` with one trace or samples by channels, and what else it says of them."""
    loaded = np.load(io.BytesIO(content), allow_pickle=False)
    parts = {k: loaded[k] for k in loaded.files} if hasattr(loaded, "files") else {"data": loaded}
    data = np.asarray(parts.pop("data"), float)
    data = data[:, None] if data.ndim == 1 else data
    text = lambda k, default=None: str(np.ravel(parts[k])[0]) if k in parts and np.size(parts[k]) else default
    channels = [str(c) for c in np.ravel(parts.get("channels", parts.get("channel", [])))] or [f"CH{k}" for k in range(data.shape[1])]
    rate = float(text("sampling_rate", 0) or 0) or 1 / float(text("delta", text("dt", 1.0)))
    return [
        {"source": path, "network": text("network"), "station": text("station"), "location": text("location"), "channel": c, "component": c[-1:].upper(), "starttime": text("starttime"), "sampling_rate": rate, "dt": 1 / rate, "npts": len(data), "samples": data[:, k].tolist()}
        for k, c in enumerate(channels[: data.shape[1]])
    ]


def read_waveforms(spark: SparkSession, root: str, *, pattern: str = "*.np[yz]") -> DataFrame:
    """All traces below a folder, decoded by the tasks that read the files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame(decode_numpy(path, content), columns=TRACE.names)

    return files.mapInPandas(run, TRACE)


def trace_metadata(traces: DataFrame, event_id: str | None = None) -> DataFrame:
    """The traces' descriptions without samples."""
    end = F.try_to_timestamp("starttime") + F.make_dt_interval(secs=(F.col("npts") - 1) * F.col("dt"))
    return traces.drop("samples").withColumns({"endtime": end, "event_id": F.lit(event_id).cast("string")})


def stations_of(traces: DataFrame) -> DataFrame:
    return traces.select("network", "station").distinct().orderBy("network", "station")
