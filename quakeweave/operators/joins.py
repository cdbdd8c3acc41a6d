"""Joins of events, stations, inventories and plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeweave.functions import text as X
from quakeweave.functions.geodesy import add_path_geometry
from quakeweave.functions.labels import finite, present
from quakeweave.operators.metrics import first_row


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The table itself; ValueError if a key occurs twice."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"keys {keys} are not unique")
    return df


def attach(df: DataFrame, dim: DataFrame, key: str, suffix: str) -> DataFrame:
    """Left join of a dimension; its columns that the table has already get a suffix."""
    clash = [c for c in dim.columns if c != key and c in df.columns]
    return df.join(dim.withColumnsRenamed({c: f"{c}{suffix}" for c in clash}), key, "left")


def fill_from(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left join that only fills: present values of the table stay, new columns are added."""
    own = dim.dropDuplicates([key])
    other = [c for c in own.columns if c != key]
    joined = df.join(own.select(key, *[F.col(c).alias(f"__{c}") for c in other]), key, "left")
    kept = [F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in other else F.col(c) for c in df.columns]
    return joined.select(*kept, *[F.col(f"__{c}").alias(c) for c in other if c not in df.columns])


def event_station_table(stations: DataFrame, events: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Pairs of events and stations, all of them if none are given, with both sides' columns and the path between.

    Distances and azimuths that are there already stay; the back azimuth is the true one.
    All pairs are made from the two tables at once: no pair is shuffled to get its columns, and
    the events are spread over the tasks first, as a small table is one task and its pairs would be too.
    """
    s = stations.where(present("station").isNotNull()).withColumn("station", F.upper(present("station")))
    e = events.where(present("event_id").isNotNull()).withColumn("event_id", present("event_id"))
    if pairs is None:
        spark = e.sparkSession
        e = e.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "event_id")
        own = s.withColumnsRenamed({"event_id": "event_id_station"})
        made = own.columns
        full = e.withColumnsRenamed({c: f"{c}_event" for c in e.columns if c in made}).crossJoin(own)
        full = full.select("event_id", "station", *[c for c in made if c != "station"], *[c for c in full.columns if c not in ("event_id", *made)])
    else:
        base = pairs.dropDuplicates(["event_id", "station"])
        full = attach(attach(base, s, "station", "_station"), e, "event_id", "_event")
    return add_path_geometry(full, station=("lat", "lon"), backazimuth="true", fill_only=True)


def plan_tasks(observed: DataFrame, synthetic: DataFrame | None, passbands: list[tuple[float, float]], *, components: list[str] | None = None, models: list[str] | None = None) -> DataFrame:
    """One task per observed record, matching synthetic record and passband (per record and passband with one side only)."""
    spark = observed.sparkSession
    bands = spark.createDataFrame([(float(a), float(b)) for a, b in passbands], "period_min_s double, period_max_s double").coalesce(1)
    keys = ["event_id", "station", "component"]
    o = observed if not components else observed.where(F.col("component").isin(components))
    both = o
    if synthetic is not None:
        s = synthetic if not models else synthetic.where(F.col("model").isin(models))
        both = o.drop("model").withColumnsRenamed({c: f"obs_{c}" for c in o.columns if c not in keys}).join(s.withColumnsRenamed({c: f"syn_{c}" for c in s.columns if c not in (*keys, "model")}), keys)
    label = F.concat(X.number_text("period_min_s"), F.lit("-"), X.number_text("period_max_s"), F.lit(" sec"))
    tasks = both.crossJoin(F.broadcast(bands)).withColumn("passband", label)
    return tasks.withColumn("task_id", X.task_id(*[c for c in (*keys, "model", "passband") if c in tasks.columns]))


def expected_rows(inventory: DataFrame, passbands: list[str], metrics: list[str], periods: list[float], models: list[str]) -> DataFrame:
    """Every row that a plan asks for: periods only for PSA and FAS."""
    m = [(x, p) for x in metrics for p in ((periods or [None]) if x in ("PSA", "FAS") else [None])]
    rows = [(*x, b, k) for x in m for b in passbands for k in models]
    grid = inventory.sparkSession.createDataFrame(rows, "metric string, period_s double, passband string, model string").coalesce(1)
    return inventory.select("event_id", "station", "component").distinct().crossJoin(F.broadcast(grid))


def missing_rows(expected: DataFrame, present_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Expected rows that are not there, by trimmed text keys; NULL periods match each other."""
    a, b = (d.withColumns({f"__{k}": F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) for k in keys}) for d in (expected, present_rows))
    names = [f"__{k}" for k in keys]
    return a.join(b.select(*names).distinct(), names, "left_anti").drop(*names)


def completeness(expected: DataFrame, present_rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: expected, present, missing."""
    miss = missing_rows(expected, present_rows, keys).agg(F.count(F.lit(1)).alias("missing"))
    return expected.agg(F.count(F.lit(1)).alias("expected")).crossJoin(miss).select("expected", (F.col("expected") - F.col("missing")).alias("present"), "missing")


def ladder_lookup(df: DataFrame, table: DataFrame, exact: list[str], steps: list[dict[str, Column]], columns: list[str], order: list[str]) -> DataFrame:
    """The best match on a ladder of keys.

    A step maps the columns that vary to what they must equal; the first step with a match
    counts. The last of several rows of a key (by ``order``) is taken. One left join per step,
    each on a table with one row per key.
    """
    vary = list(steps[0])
    one = first_row(table.select(*exact, *vary, *columns, *[o for o in order if o not in columns]), [*exact, *vary], order, last=True)
    out = df
    for k, step in enumerate(steps):
        side = one.select(*[F.col(c).alias(f"__k_{c}") for c in (*exact, *vary)], *[F.col(c).alias(f"__{k}_{c}") for c in columns], F.lit(True).alias(f"__{k}_hit"))
        on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in exact] + [v.eqNullSafe(F.col(f"__k_{c}")) for c, v in step.items()])
        out = out.join(side, on, "left").drop(*[f"__k_{c}" for c in (*exact, *vary)])
    picked = [reduce(lambda rest, k: F.when(F.col(f"__{k}_hit"), F.col(f"__{k}_{c}")).otherwise(rest), reversed(range(len(steps))), F.lit(None)).alias(c) for c in columns]
    return out.select(*df.columns, *picked)


def metric_qc(df: DataFrame, qc: DataFrame, *, order: str, strict: bool = True) -> DataFrame:
    """QC status and reason of metric rows: by group, metric and period; by metric and period; by group and period; else for the whole trace.

    ``strict`` leaves the passband out of the key, so that the last row of several passbands
    counts; otherwise it is part of it. A row without QC passes.
    """
    exact = ["source", "event_id", "station", "component", "model", *([] if strict else ["passband"])]
    blank = F.lit("")
    q = qc.withColumns({c: F.coalesce(present(c), blank) for c in ("metric_group", "metric")}).withColumn("period_key", F.coalesce(X.number_text(finite("period_s")), blank))
    g, m, p = F.col("metric_group"), F.col("metric"), F.coalesce(X.number_text(finite("period_s")), blank)
    steps = [{"metric_group": a, "metric": b, "period_key": c} for a, b, c in ((g, m, p), (blank, m, p), (g, blank, blank), (blank, blank, blank))]
    out = ladder_lookup(df, q, exact, steps, ["qc_status", "qc_reason"], [order])
    return out.withColumn("qc_pass", F.coalesce(X.qc_status("qc_status") == "pass", F.lit(True)))


def interval_overlap(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Pairs of rows with equal keys whose open intervals overlap."""
    return left.join(right, keys).where(F.greatest(a[0], b[0]) < F.least(a[1], b[1]))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, columns: list[str], *, bucket: str = "DAY") -> DataFrame:
    """The latest right row at or before each left row (of several at one time, the greatest by ``columns``).

    Rows are put in order within a key and a ``bucket`` of time (a unit of ``date_trunc``), so a key with
    a large part of all rows is as many tasks as it has buckets. What a bucket starts with is
    carried over from those before on one row per key and bucket. Left rows without a key or
    time, or without an earlier right row, get NULL.
    """
    row = F.struct(F.col(since).alias("__since"), *[F.col(c).alias(f"__{c}") for c in columns])
    named = right.select(*keys, F.col(since).alias("__t"), F.date_trunc(bucket, since).alias("__b"), row.alias("__row"))
    others = [c for c in left.columns if c not in keys]
    empty = named.schema["__row"].dataType
    a = named.select(*keys, "__t", "__b", F.lit(0).alias("__side"), "__row", *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in others])
    b = left.select(*keys, F.col(at).alias("__t"), F.date_trunc(bucket, at).alias("__b"), F.lit(1).alias("__side"), F.lit(None).cast(empty).alias("__row"), *others)
    w = Window.partitionBy(*keys, "__b").orderBy("__t", "__side", "__row").rowsBetween(Window.unboundedPreceding, 0)
    within = a.unionByName(b).withColumn("__row", F.last("__row", ignorenulls=True).over(w)).where(F.col("__side") == 1)
    # The last row of every bucket, and of the latest one before each bucket of the left side.
    lasts = named.groupBy(*keys, "__b").agg(F.max("__row").alias("__last")).unionByName(left.select(*keys, F.date_trunc(bucket, at).alias("__b")).distinct().withColumn("__last", F.lit(None).cast(empty)))
    per = lasts.groupBy(*keys, "__b").agg(F.max("__last").alias("__last"))
    v = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(*keys, "__b", F.last("__last", ignorenulls=True).over(v).alias("__before"))
    joined = within.join(carried, [*keys, "__b"], "left").withColumn("__row", F.coalesce("__row", "__before"))
    return joined.select(*left.columns, *[F.col(f"__row.__{c}").alias(c) for c in columns])


def alias_report(folders: DataFrame, alias: str, folder: str) -> DataFrame:
    """Distinct folders by alias: ``alias``, ``name``, ``folder``, ``ambiguous``.

    An alias that stands for several folders gets a number behind it, in order of the folders.
    """
    each = folders.where(F.col(alias).isNotNull() & F.col(folder).isNotNull()).select(F.col(alias).alias("alias"), F.col(folder).alias("folder")).distinct()
    listed = each.groupBy("alias").agg(F.array_sort(F.collect_list("folder")).alias("__f"))
    out = listed.select("alias", F.size("__f").alias("__n"), F.posexplode("__f").alias("__k", "folder"))
    several = F.col("__n") > 1
    return out.select("alias", F.when(several, F.concat("alias", F.lit("_"), F.col("__k") + 1)).otherwise(F.col("alias")).alias("name"), "folder", several.alias("ambiguous"))
