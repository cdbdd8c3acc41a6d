"""Streams of files: windowed counts, and incremental processing with exactly-once batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quakeweave.operators.orphans import REFERENCE, OrphanTracker


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, *, files_per_batch: int = 100, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(folder)


def windowed_summary(rows: DataFrame, time: str, keys: list[str], value: str, *, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Count, sum and mean per window and key; rows later than ``late`` are dropped by the watermark. Works on streams and tables."""
    base = rows.withWatermark(time, late) if rows.isStreaming else rows
    return base.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total", "mean")


def sessions(rows: DataFrame, time: str, key: str, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    base = rows.withWatermark(time, late) if rows.isStreaming else rows
    return base.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def run_available(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what is there, once per batch, then stop; the checkpoint remembers the files done."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_rows_only(done_path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch function that appends rows whose keys are not in the output yet."""

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        try:
            fresh = fresh.join(spark.read.parquet(done_path).select(*keys), keys, "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(done_path)

    return work


def track_stream(references: DataFrame, parents_of: Callable[[SparkSession, int], DataFrame], tracker: OrphanTracker, checkpoint: str) -> StreamingQuery:
    """Orphan tracking over a stream of references; ``parents_of`` gives each batch's parent changes."""

    def work(batch: DataFrame, batch_id: int) -> None:
        if tracker.batch <= batch_id:
            tracker.advance(batch.select(*REFERENCE.names), parents_of(batch.sparkSession, batch_id))
            tracker.settle()

    return run_available(references, work, checkpoint)
