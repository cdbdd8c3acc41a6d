"""Which format a folder of synthetic waveforms has, and how its traces are brought to the usual components.

Formats whose libraries are not part of this package are told apart, but not read: their
traces come as tables (``samples`` per row) or NumPy archives, written by who has the library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeweave.functions.traces import rotate_ne_to_rt
from quakeweave.runtime import _file_system, list_folder
from quakeweave.sources.tables import read_table
from quakeweave.sources.waveforms import read_waveforms

#: At most so many files are looked at.
LOOKED_AT = 200
#: The first bytes of an HDF5 file.
HDF5_SIGNATURE = b"\x89HDF\r\n\x1a\n"
# Components of simulations in a Cartesian frame, and metres to centimetres.
COMPONENT_MAP = {"X": "E", "Y": "N", "Z": "Z"}
ACCELERATION_SCALE = 100.0


@dataclass(frozen=True)
class Detected:
    """A folder's format, and whether its traces are usable as they are or have to be remapped first."""

    root: str
    format: str
    normalized: bool
    needs_remapping: bool


def sniff(files: list[tuple[str, bytes]]) -> str:
    """The format of files given by name and first bytes.

    MiniSEED records start with six digits and a quality letter. Of HDF5 files, those with
    ``receivers`` in their name or a ``meta.json`` beside them are raw simulation output,
    those with a catalogue of waveforms in their header are ASDF.
    """
    names = [n.rsplit("/", 1)[-1].lower() for n, _ in files]
    ends = {n.rsplit(".", 1)[-1] for n in names if "." in n}
    raw = any(n.startswith("receivers") and n.endswith((".h5", ".hdf5")) for n in names) or ("meta.json" in names and bool(ends & {"h5", "hdf5"}))
    if "asdf" in ends:
        return "asdf"
    if ends & {"mseed", "msd"} or any(len(b) >= 8 and b[:6].isdigit() and b[6:7] in b"DRQM" for _, b in files):
        return "mseed"
    if ends & {"h5", "hdf5"} or any(b.startswith(HDF5_SIGNATURE) for _, b in files):
        if raw:
            return "salvus"
        return "asdf" if any(b"AuxiliaryData" in b or b"Waveforms" in b for _, b in files) else "hdf5"
    for kind, known in (("numpy", {"npy", "npz"}), ("parquet", {"parquet", "pq"}), ("csv", {"csv"})):
        if ends & known:
            return kind
    return "unknown"


def heads(spark: SparkSession, root: str, *, most: int = LOOKED_AT, size: int = 2_048) -> Iterator[tuple[str, bytes]]:
    """Names and first bytes of at most ``most`` files below a folder, read on the driver."""
    files, at = _file_system(spark, root)
    if not files.exists(at):
        raise FileNotFoundError(root)
    walk = files.listFiles(at, True)
    while most > 0 and walk.hasNext():
        status = walk.next()
        stream = files.open(status.getPath())
        data = bytes(stream.readNBytes(min(size, int(status.getLen()))))
        stream.close()
        yield str(status.getPath()), data
        most -= 1


def detect_format(spark: SparkSession, root: str) -> Detected:
    kind = sniff(list(heads(spark, root)))
    return Detected(root, kind, kind not in ("salvus", "unknown"), kind == "salvus")


@dataclass(frozen=True)
class Request:
    """Which traces are wanted; what is not named is not restricted."""

    event_id: str | None = None
    stations: tuple[str, ...] = ()
    components: tuple[str, ...] = ()

    def condition(self, df: DataFrame) -> Column:
        wanted = [("event_id", (self.event_id,) if self.event_id else ()), ("station", self.stations), ("component", self.components)]
        tests = [F.upper(F.trim(c)).isin(*[v.strip().upper() for v in values]) for c, values in wanted if values and c in df.columns]
        return reduce(Column.__and__, tests, F.lit(True))


def _unreadable(kind: str) -> Callable:
    def read(spark: SparkSession, root: str) -> DataFrame:
        raise ValueError(f"traces in {kind} are not read here; write them as tables or NumPy archives first")

    return read


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"numpy": read_waveforms, "parquet": read_table, "csv": read_table}


def reader_for(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """The reader of a format; those that cannot be read raise ValueError when they are used."""
    return READERS.get(kind, _unreadable(kind))


def read_synthetics(spark: SparkSession, root: str, request: Request = Request(), *, kind: str | None = None) -> DataFrame:
    """Traces of a folder that a request names; the request is a filter on the reader's columns."""
    traces = reader_for(kind or detect_format(spark, root).format)(spark, root)
    return traces.where(request.condition(traces))


def remap_components(traces: DataFrame, *, mapping: dict[str, str] | None = None, scale: float = ACCELERATION_SCALE) -> DataFrame:
    """Cartesian components as compass ones and samples scaled; traces of other components go. ValueError unless the scale is positive."""
    if not scale > 0:
        raise ValueError("the scale must be positive")
    known = {k.upper(): v.upper() for k, v in (mapping or COMPONENT_MAP).items()}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    raw = F.upper(F.trim("component"))
    new = F.coalesce(F.try_element_at(table, raw), raw)
    out = traces.withColumns({"component": new, "samples": F.transform("samples", lambda x: x * F.lit(float(scale)))})
    if "channel" in traces.columns:
        out = out.withColumn("channel", F.concat(F.left("channel", F.length("channel") - 1), "component"))
    return out.where(F.col("component").isin("N", "E", "Z"))


def with_rotated(traces: DataFrame, keys: list[str], backazimuth: str) -> DataFrame:
    """The traces with radial and transverse ones for every key that has both horizontal components and a back azimuth."""
    side = lambda c: F.max(F.when(F.col("component") == c, F.col("samples"))).alias(c)
    wide = traces.groupBy(*keys).agg(side("N"), side("E"), F.max(backazimuth).alias("__b"), *[F.min(c).alias(c) for c in traces.columns if c not in (*keys, "component", "samples", "channel", backazimuth)])
    wide = wide.where(F.col("N").isNotNull() & F.col("E").isNotNull() & F.col("__b").isNotNull())
    r, t = rotate_ne_to_rt("N", "E", "__b")
    made = wide.withColumn("c", F.explode(F.array(F.struct(F.lit("R").alias("component"), r.alias("samples")), F.struct(F.lit("T").alias("component"), t.alias("samples")))))
    made = made.select("*", "c.component", "c.samples", F.col("__b").alias(backazimuth))
    own = [c for c in traces.columns if c != "channel"]
    return traces.select(*own).unionByName(made.select(*own))


def convert_once(spark: SparkSession, folder: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, written to a folder the first time and read from there afterwards."""
    if "_SUCCESS" not in list_folder(spark, folder):
        make().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)
