"""Session, tables and the shared folder for intermediate results."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "quakeweave", cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they need no copy of their own."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quakeweave-code-")) / "quakeweave.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


_own_folders: dict[str, str] = {}


def is_local(spark: SparkSession) -> bool:
    """Whether all tasks run on this machine."""
    return spark.sparkContext.master.split("[")[0] in ("local", "local-cluster")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one that all executors share.

    It is the folder in ``spark.checkpoint.dir``. Only where that is unset and all tasks run
    on this machine, as in tests, a temporary folder is made and set for the session, and
    deleted when the process ends. On a cluster, where no folder of one machine is shared,
    RuntimeError is raised.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_folders:
            made = tempfile.mkdtemp(prefix="quakeweave-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            _own_folders[app] = "file://" + made
        base = _own_folders[app]
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, purpose: str = "step") -> DataFrame:
    """Write a frame to the shared folder and read it back.

    What follows then survives lost executors without running what came before. The
    folder lasts as long as frames may be read from it; ``remove_intermediates`` deletes those of
    the application.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_written: dict[str, list[str]] = {}


def remove_intermediates(spark: SparkSession) -> int:
    """Delete what ``cut_lineage`` wrote for this application; for when its results have been used. Gives the number of folders."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        remove_folder(spark, p)
    return len(paths)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system; nothing happens if it is not there."""
    files, at = _file_system(spark, path)
    files.delete(at, True)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of the shared file system; none if it is not there."""
    files, at = _file_system(spark, path)
    return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not there: written under another name, then renamed."""
    files, at = _file_system(spark, path)
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.draft")
    out = files.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(at, False)
    files.rename(draft, at)


def read_text(spark: SparkSession, path: str) -> str:
    files, at = _file_system(spark, path)
    size = files.getFileStatus(at).getLen()
    read = files.open(at)
    data = bytes(read.readNBytes(int(size)))
    read.close()
    return data.decode()
