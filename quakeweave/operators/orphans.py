"""References to records that do not exist, kept as incremental state.

The state is keyed by referenced table and key, and lies in the shared folder:

- the parent index (first arrival and first deletion of each key), as the changed keys of each batch;
- the pending orphans, as a log of transitions: a reference found to lead nowhere, resolved, changed or reopened.

Each batch of new references probes the index. Of the older ones only those are looked at
whose keys the batch changes: arriving parents resolve waiting orphans, deletions reopen
references that had been fine. The counts are written after each batch, and a manifest
closes it, so that another process can go on from the folder.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakeweave.runtime import list_folder, read_text, shared_folder, write_text

KEY = ["ref_table", "ref_key"]
REFERENCE = T.StructType(
    [T.StructField("row_id", T.LongType()), T.StructField("ref_table", T.StringType()), T.StructField("ref_key", T.StringType()), T.StructField("at", T.TimestampType())]
)
PARENT = T.StructType(
    [T.StructField("ref_table", T.StringType()), T.StructField("ref_key", T.StringType()), T.StructField("since", T.TimestampType()), T.StructField("until", T.TimestampType())]
)
ORPHAN = T.StructType([*REFERENCE.fields, T.StructField("orphan_kind", T.StringType())])
#: ``seen`` is the batch in which the reference came, ``batch`` that of the transition, ``was`` the kind before it.
_LOG = T.StructType([*REFERENCE.fields, T.StructField("seen", T.IntegerType()), T.StructField("was", T.StringType()), T.StructField("orphan_kind", T.StringType()), T.StructField("batch", T.IntegerType())])
_DELTA = T.StructType([*PARENT.fields, T.StructField("was_since", T.TimestampType()), T.StructField("was_until", T.TimestampType())])
COUNTS = T.StructType([T.StructField("ref_table", T.StringType()), T.StructField("orphan_kind", T.StringType()), T.StructField("period_month", T.StringType()), T.StructField("change", T.LongType()), T.StructField("batch", T.IntegerType())])

#: A parent index of at most so many keys is broadcast (about 100 bytes a key); a larger one is joined by a shuffle.
BROADCAST_KEYS = 10_000
#: A key with at least this share of the references is hot: there are at most 1 / HOT_SHARE of them, which are broadcast.
HOT_SHARE = 0.005
#: Changes of the index are merged into one table after so many batches.
MERGE_AFTER = 32


def orphan_kind(at: Column, since: Column, until: Column) -> Column:
    """``missing``, ``late``, ``deleted``, or NULL for a reference that leads somewhere."""
    return F.when(since.isNull(), F.lit("missing")).when(at < since, F.lit("late")).when(at >= until, F.lit("deleted"))


def merge_parents(*parts: DataFrame) -> DataFrame:
    """One row per key: it exists from its earliest arrival until its earliest deletion."""
    union = reduce(DataFrame.unionByName, parts)
    return union.where(F.col("ref_key").isNotNull()).groupBy(*KEY).agg(F.min("since").alias("since"), F.min("until").alias("until"))


def hot_keys(refs: DataFrame, share: float = HOT_SHARE) -> list[tuple[str, str]]:
    """Keys with at least ``share`` of all references; counted with a partial aggregation, at most 1 / share rows are collected."""
    counts = refs.where(F.col("ref_key").isNotNull()).groupBy(*KEY).count()
    total = refs.count()
    return [(r[0], r[1]) for r in counts.where(F.col("count") >= share * max(1, total)).select(*KEY).collect()]


def probe(refs: DataFrame, index: DataFrame, index_keys: int, *, hot: list[tuple[str, str]] = (), broadcast_keys: int = BROADCAST_KEYS, how: str = "left") -> DataFrame:
    """References with the columns of their parent, NULL where there is none.

    A small index is broadcast. Otherwise references of hot keys meet a broadcast of just
    these keys, however many references they have, and the others are joined by a shuffle.
    """
    if index_keys <= broadcast_keys:
        return refs.join(F.broadcast(index), KEY, how)
    if not hot:
        return refs.join(index, KEY, how)
    is_hot = reduce(Column.__or__, [(F.col("ref_table") == t) & F.col("ref_key").isin(*[k for u, k in hot if u == t]) for t in sorted({t for t, _ in hot})])
    some = refs.where(is_hot).join(F.broadcast(index.where(is_hot)), KEY, how)
    return some.unionByName(refs.where(~F.coalesce(is_hot, F.lit(False))).join(index.where(~is_hot), KEY, how))


class OrphanTracker:
    """Keyed pending-orphan state over batches.

    ``advance`` takes the references and parent changes of one period. ``snapshot`` gives
    every orphan known now, ``counts`` its counts per table and month, ``count_history``
    those counts after every batch. A tracker made on the folder of an earlier one goes on
    behind that one's last whole batch.

    Defined results: references without a key are none; a reference without a time is an
    orphan only if its parent is missing; a parent without any arrival time does not
    exist; a reference given twice in a batch counts once, one given in two batches is two
    references; repeated parents count once. A reference before its parent's arrival stays
    an orphan of kind ``late``, unless an earlier arrival becomes known. An empty batch
    changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, *, broadcast_keys: int = BROADCAST_KEYS):
        self.spark = spark
        self.folder = folder or shared_folder(spark, "orphans")
        self.broadcast_keys = broadcast_keys
        #: Batch of the merged index, if any; keys in the index, counted once for each change.
        self.batch, self.base, self.index_keys = 0, -1, 0
        self._pool, self._closing = ThreadPoolExecutor(1), None
        done = sorted(n for n in list_folder(spark, self.folder) if n.startswith("done-"))
        if done:
            state = json.loads(read_text(spark, f"{self.folder}/{done[-1]}"))
            self.batch, self.base, self.index_keys = state["batch"] + 1, state["base"], state["index_keys"]

    def _paths(self, name: str, start: int = 0, stop: int | None = None) -> list[str]:
        return [f"{self.folder}/{name}-{k:05d}" for k in range(start, self.batch if stop is None else stop)]

    def _read(self, paths: list[str], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, schema: T.StructType, batch: int | None = None) -> DataFrame:
        path = f"{self.folder}/{name}-{self.batch if batch is None else batch:05d}"
        df.select(*schema.names).write.mode("overwrite").parquet(path)
        return self._read([path], schema)

    def _index(self, stop: int) -> DataFrame:
        merged = [self._read([f"{self.folder}/index-{self.base:05d}"], PARENT)] if self.base >= 0 else []
        changed = self._read(self._paths("changed", self.base + 1, stop), _DELTA).select(*PARENT.names)
        return merge_parents(changed, *merged)

    @property
    def index(self) -> DataFrame:
        self.settle()
        return self._index(self.batch)

    @staticmethod
    def _latest(log: DataFrame) -> DataFrame:
        """References with the kind of their last transition; NULL if that resolved them."""
        return log.groupBy("row_id", *KEY, "at", "seen").agg(F.max_by("orphan_kind", "batch").alias("orphan_kind"))

    def advance(self, refs: DataFrame, parents: DataFrame, *, history: DataFrame | None = None, hot: list[tuple[str, str]] | None = None) -> None:
        """Take in one batch.

        ``history`` are the references of earlier batches (the referring table itself), with
        the batch of each in ``seen``; without that column it is 0. It is read only if the
        batch tells of deletions that lie before now, and only from the earliest of them on
        (if it is split by a column ``month``, only those months). It may be left out if
        deletions come in time. ``hot`` are the hot keys, if they are known.
        """
        batch = F.lit(self.batch)
        old = self._index(self.batch).withColumnsRenamed({"since": "was_since", "until": "was_until"})
        changes = merge_parents(parents).join(old, KEY, "left")
        since, until = F.least("since", "was_since"), F.least("until", "was_until")
        changes = changes.withColumns({"since": since, "until": until})
        # Only keys for which something is new.
        delta = self._write(changes.where(~(F.col("since").eqNullSafe(F.col("was_since")) & F.col("until").eqNullSafe(F.col("was_until")))), "changed", _DELTA)
        ended = F.col("was_since").isNotNull() & F.col("until").isNotNull() & ~F.col("until").eqNullSafe(F.col("was_until"))
        said = delta.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(ended, F.col("until"))).alias("first_end")).first()
        self.index_keys += said["n"]

        new = refs.where(F.col("ref_key").isNotNull()).select(*REFERENCE.names)
        hot = hot_keys(new) if hot is None and self.index_keys > self.broadcast_keys else hot or []
        options = {"hot": hot, "broadcast_keys": self.broadcast_keys}
        kind = orphan_kind(F.col("at"), F.col("since"), F.col("until"))
        found = probe(new, self._index(self.batch + 1), self.index_keys, **options).withColumn("orphan_kind", kind).where(F.col("orphan_kind").isNotNull())
        found = found.select(*ORPHAN.names).distinct()
        parts = [found.select("*", batch.alias("seen"), F.lit(None).cast("string").alias("was"), batch.alias("batch"))]
        if said["n"] and self.batch:
            # Orphans whose key changed: resolved, or of another kind now.
            waiting = probe(self._read(self._paths("log"), _LOG), delta, said["n"], how="inner", **options)
            waiting = waiting.groupBy("row_id", *KEY, "at", "seen", "since", "until").agg(F.max_by("orphan_kind", "batch").alias("was")).where(F.col("was").isNotNull())
            moved = waiting.withColumn("orphan_kind", kind).where(~F.col("orphan_kind").eqNullSafe(F.col("was")))
            parts.append(moved.select("row_id", *KEY, "at", "seen", "was", "orphan_kind", batch.alias("batch")))
        if said["first_end"] is not None and history is not None:
            at = F.col("at")
            past = history if "seen" in history.columns else history.withColumn("seen", F.lit(0))
            if "month" in past.columns:
                past = past.where(F.col("month") >= F.date_format(F.lit(said["first_end"]), "yyyy-MM"))
            past = past.where((at >= F.lit(said["first_end"])) & F.col("ref_key").isNotNull()).select(*REFERENCE.names, "seen")
            touched = probe(past, delta.where(ended), said["n"], how="inner", **options)
            fine = (at >= F.col("was_since")) & (F.col("was_until").isNull() | (at < F.col("was_until")))
            reopened = touched.where(fine & (at >= F.col("until"))).withColumn("orphan_kind", kind).where(F.col("orphan_kind").isNotNull())
            parts.append(reopened.select("row_id", *KEY, "at", "seen", "orphan_kind").distinct().select("*", F.lit(None).cast("string").alias("was"), batch.alias("batch")))
        self.settle()
        log = self._write(reduce(DataFrame.unionByName, [p.select(*[F.col(f.name).cast(f.dataType) for f in _LOG.fields]) for p in parts]), "log", _LOG)
        # What closes the batch is written while the next one begins.
        self._closing = self._pool.submit(self._close, log, self.batch, self.index_keys)
        self.batch += 1
        if said["n"] and self.batch - 1 - self.base >= MERGE_AFTER:
            self.settle()

    def _close(self, log: DataFrame, batch: int, index_keys: int) -> None:
        self._write(self._changes_of(log, batch), "counts", COUNTS, batch)
        if batch - self.base >= MERGE_AFTER:
            self._write(self._index(batch + 1), "index", PARENT, batch)
            self.base = batch
        write_text(self.spark, f"{self.folder}/done-{batch:05d}", json.dumps({"batch": batch, "base": self.base, "index_keys": index_keys}))

    def settle(self) -> None:
        """Wait until the last batch is closed; what failed there is raised here."""
        closing, self._closing = self._closing, None
        if closing is not None:
            closing.result()

    @staticmethod
    def _changes_of(log: DataFrame, batch: int) -> DataFrame:
        steps = F.array(F.struct(F.col("orphan_kind").alias("k"), F.lit(1).alias("d")), F.struct(F.col("was").alias("k"), F.lit(-1).alias("d")))
        each = log.select("ref_table", F.date_format("at", "yyyy-MM").alias("period_month"), F.explode(steps).alias("s")).where(F.col("s.k").isNotNull())
        return each.groupBy("ref_table", F.col("s.k").alias("orphan_kind"), "period_month").agg(F.sum("s.d").cast("bigint").alias("change")).withColumn("batch", F.lit(batch))

    def snapshot(self) -> DataFrame:
        """All orphans, as the index stands: one that waited for a parent which has arrived since is ``late``."""
        self.settle()
        return self._latest(self._read(self._paths("log"), _LOG)).where(F.col("orphan_kind").isNotNull()).select(*ORPHAN.names)

    def transitions(self) -> DataFrame:
        """Every change of an orphan's kind: found or reopened (``was`` is NULL), changed, resolved (``orphan_kind`` is NULL)."""
        self.settle()
        return self._read(self._paths("log"), _LOG)

    def counts(self) -> DataFrame:
        """Orphans per referenced table, kind and month of the reference, added up from the batches' changes."""
        self.settle()
        total = self._read(self._paths("counts"), COUNTS).groupBy("ref_table", "orphan_kind", "period_month").agg(F.sum("change").alias("orphans"))
        return total.where(F.col("orphans") != 0)

    def count_history(self) -> DataFrame:
        """The changes of the counts with each batch: ``ref_table``, ``orphan_kind``, ``period_month``, ``change``, ``batch``."""
        self.settle()
        return self._read(self._paths("counts"), COUNTS)


def references(df: DataFrame, row_id: str, at: str, keys: dict[str, Column]) -> DataFrame:
    """One reference per row and referenced table; absent keys are left out."""
    pairs = F.array(*[F.struct(F.lit(t).alias("ref_table"), k.alias("ref_key")) for t, k in keys.items()])
    one = df.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(at).alias("at"), F.explode(pairs).alias("r"))
    return one.select("row_id", "r.ref_table", "r.ref_key", "at").where(F.col("ref_key").isNotNull())


def parent_changes(df: DataFrame, ref_table: str, key: Column, since: str = "loaded_at", until: str = "deleted_at") -> DataFrame:
    """Arrivals and deletions of one referenced table as separate rows, each with the time it becomes known.

    A deletion is known when it happens, or when the row that tells of it arrives, if that
    is later.
    """
    base = df.select(F.lit(ref_table).alias("ref_table"), key.alias("ref_key"), F.col(since).alias("s"), F.col(until).alias("u")).where(F.col("ref_key").isNotNull())
    none = F.lit(None).cast("timestamp")
    arrived = base.where(F.col("s").isNotNull()).select("ref_table", "ref_key", F.col("s").alias("since"), none.alias("until"), F.col("s").alias("known_at"))
    ended = base.where(F.col("u").isNotNull()).select("ref_table", "ref_key", none.alias("since"), F.col("u").alias("until"), F.greatest("u", "s").alias("known_at"))
    return arrived.unionByName(ended)


def track_by_month(refs: DataFrame, changes: DataFrame, tracker: OrphanTracker) -> OrphanTracker:
    """Run a history through the state, one batch per month of the references.

    The references are written once, split by month, so that each batch reads only its
    own, and reopening only the months from the earliest deletion on. Parent changes before
    the first month come with it, those after the last one in a closing batch without
    references, as do references without a time. A tracker that has done some months goes
    on behind them.
    """
    spark, path = tracker.spark, f"{tracker.folder}/references"
    month = F.date_format("at", "yyyy-MM")
    if "_SUCCESS" not in list_folder(spark, path):
        refs.withColumn("month", F.coalesce(month, F.lit("none"))).write.mode("overwrite").partitionBy("month").parquet(path)
    schema = T.StructType([*REFERENCE.fields, T.StructField("month", T.StringType())])
    staged = spark.read.schema(schema).parquet(path)
    months = sorted(n.removeprefix("month=") for n in list_folder(spark, path) if n.startswith("month=") and n != "month=none")
    known = F.date_format("known_at", "yyyy-MM")
    written = f"{tracker.folder}/changes"
    if "_SUCCESS" not in list_folder(spark, written):
        changes.select(*PARENT.names, F.coalesce(known, F.lit("0000-00")).alias("known_month")).write.mode("overwrite").parquet(written)
    changed = spark.read.schema(T.StructType([*PARENT.fields, T.StructField("known_month", T.StringType())])).parquet(written)
    hot = hot_keys(staged)
    number = F.create_map(*[F.lit(x) for k, m in enumerate(months) for x in (m, k)]) if months else None
    for k, m in enumerate([*months, None]):
        if k < tracker.batch:
            continue
        after = months[k - 1] if k else ""
        due = changed.where((F.col("known_month") > after) & (F.col("known_month") <= m)) if m else changed.where(F.col("known_month") > after)
        own = staged.where(F.col("month") == (m or "none"))
        past = None
        if k:
            past = (staged.where(F.col("month") < m) if m else staged.where(F.col("month") != "none")).withColumn("seen", number[F.col("month")])
        tracker.advance(own, due.drop("known_month"), history=past, hot=hot)
    tracker.settle()
    return tracker
