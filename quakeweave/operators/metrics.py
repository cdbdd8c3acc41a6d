"""Metric tables: reshaping, summaries, event centring and station bias.

Group statistics that are put back onto rows are made by a partial aggregation and a
join, not by a window: a window would gather a hot event or station in one task, while
here such a key is pre-aggregated and its rows stay where they are (AQE broadcasts the
statistics if they are small and splits skewed keys otherwise).

Where the summaries keep NULL group keys (as they do unless said otherwise), NULL is a
group of its own. Medians and percentiles are exact by default, and selected in two passes
where the input is large (see ``aggregate``); ``exact=False`` uses mergeable summaries of bounded size.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeweave.functions import residuals as R
from quakeweave.functions.geodesy import add_path_geometry, grid_cell
from quakeweave.functions.labels import finite, present
from quakeweave.runtime import cut_lineage


#: Inputs of more bytes (of their files, as Spark knows them) get their quantiles by selection, others from one buffer per group.
SELECT_BYTES = 128 * 1024 * 1024
#: Groups of at most so many rows may be listed whole.
LIST_ROWS = 4_096
#: Ranks of the mergeable summaries that narrow a selection are right to one in so many.
ACCURACY = 10_000


def input_bytes(df: DataFrame) -> int:
    """Bytes that a frame's plan reads, by the statistics of its sources; no job runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))


#: Bytes of input for each bucket of keys in which ``crowded`` counts rows.
BUCKET_BYTES = 16 * 1024


def crowded(rows: DataFrame, by: list[str], most: int) -> tuple[Column, list[int]]:
    """A bucket of the keys, and the buckets that hold more than ``most`` rows; a key outside these has no more rows than that.

    Rows are counted by bucket, not by key, so that little is shuffled however many keys there
    are. At most one bucket in ``most`` rows is listed.
    """
    n = min(max(256, input_bytes(rows) // BUCKET_BYTES), 1 << 24)
    bucket = F.pmod(F.xxhash64(*by), F.lit(n))
    full = rows.groupBy(bucket.alias("b")).count().where(F.col("count") > most).select("b").collect()
    return bucket, [r["b"] for r in full]


def aggregate(df: DataFrame, by: list[str], aggs: list[Column], quantiles: dict[str, tuple[Column, float]], *, exact: bool = True, select_bytes: int | None = None, rows: tuple[DataFrame, list[str]] | None = None) -> DataFrame:
    """One row per group with aggregates and quantiles (NULL left out, linear between two ranks).

    Exact quantiles of small inputs come from Spark's ``percentile``, which keeps every
    different value of a group. Those of large inputs are selected in two passes: a mergeable
    summary of bounded size narrows each quantile to a few ranks, then only the values there
    are counted, so that no group's values are ever in one place. Both give the same.
    Otherwise (``exact=False``) they come from the summary itself.

    With ``rows`` the groups of a large input are taken to be many and mostly small: those whose rows are few are
    listed and sorted, and only larger ones selected. It has a frame in which rows are counted and the keys
    for that, of ``by``; each key has at least as many rows there as in ``df``.
    """
    if not exact:
        return df.groupBy(*by).agg(*aggs, *[F.percentile_approx(c, q, ACCURACY).alias(n) for n, (c, q) in quantiles.items()])
    if input_bytes(df) <= (SELECT_BYTES if select_bytes is None else select_bytes):
        return df.groupBy(*by).agg(*aggs, *[F.percentile(c, F.lit(q)).alias(n) for n, (c, q) in quantiles.items()])
    if rows is None:
        return _selected(df, by, aggs, quantiles)
    bucket, large = crowded(*rows, LIST_ROWS)
    if not large:
        return _listed(df, by, aggs, quantiles)
    there = bucket.isin(large)
    return _listed(df.where(~there), by, aggs, quantiles).unionByName(_selected(df.where(there), by, aggs, quantiles))


def _listed(df: DataFrame, by: list[str], aggs: list[Column], quantiles: dict[str, tuple[Column, float]]) -> DataFrame:
    wanted = list(quantiles.items())
    # A list leaves NULL out.
    lists = df.groupBy(*by).agg(*aggs, *[F.collect_list(c.cast("double")).alias(f"__m{k}") for k, (_, (c, _)) in enumerate(wanted)])
    lists = lists.withColumns({f"__m{k}": F.sort_array(f"__m{k}") for k in range(len(wanted))})

    def rank(k: int, q: float) -> Column:
        v = F.col(f"__m{k}")
        place = (F.size(v) - 1) * F.lit(float(q))
        first = F.floor(place).cast("int")
        a, b = F.get(v, first), F.get(v, F.ceil(place).cast("int"))
        return F.when(F.size(v) > 0, a + (b - a) * (place - first))

    return lists.select(*[c for c in lists.columns if not c.startswith("__m")], *[rank(k, q).alias(name) for k, (name, (_, q)) in enumerate(wanted)])


def _selected(df: DataFrame, by: list[str], aggs: list[Column], quantiles: dict[str, tuple[Column, float]]) -> DataFrame:
    wanted = list(quantiles.items())
    slack = 1.5 / ACCURACY
    ends = [F.percentile_approx(c.cast("double"), F.array(F.lit(max(0.0, q - slack)), F.lit(min(1.0, q + slack))), ACCURACY).alias(f"__e{k}") for k, (_, (c, q)) in enumerate(wanted)]
    sizes = [F.count(c.cast("double")).alias(f"__n{k}") for k, (_, (c, _)) in enumerate(wanted)]
    stats = cut_lineage(df.groupBy(*by).agg(*aggs, *ends, *sizes), "ranges")
    values = df.select(*by, *[c.cast("double").alias(f"__v{k}") for k, (_, (c, _)) in enumerate(wanted)])
    bounds = [c for k in range(len(wanted)) for c in (f"__e{k}",)]
    rows = reattach(values, stats.select(*by, *bounds), by, "inner") if by else values.crossJoin(F.broadcast(stats.select(*bounds)))
    value, low, high = (lambda k: F.col(f"__v{k}")), (lambda k: F.col(f"__e{k}")[0]), (lambda k: F.col(f"__e{k}")[1])
    # How many values lie below each range, and the nearest ones outside it.
    outside = [f for k in range(len(wanted)) for f in (F.count_if(value(k) < low(k)).alias(f"__b{k}"), F.max(F.when(value(k) < low(k), value(k))).alias(f"__l{k}"), F.min(F.when(value(k) > high(k), value(k))).alias(f"__h{k}"))]
    around = rows.groupBy(*by).agg(*outside)
    # The values inside, each with how often it occurs: ties are counted where they are read.
    picks = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), value(k).alias("v"), value(k).between(low(k), high(k)).alias("in")) for k in range(len(wanted))]), lambda x: x["in"])
    inside = rows.select(*by, F.explode(picks).alias("p")).groupBy(*by, F.col("p.k").alias("__k"), F.col("p.v").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    listed = inside.groupBy(*by).agg(*[F.array_sort(F.collect_list(F.when(F.col("__k") == k, F.struct(F.col("__v").alias("v"), F.col("__n").alias("n"))))).alias(f"__i{k}") for k in range(len(wanted))])
    every = stats
    for part in (around, listed):
        every = reattach(every, part, by) if by else every.crossJoin(part)

    def at(k: int, rank: Column) -> Column:
        # The value whose stretch of ranks holds the wanted one.
        step = lambda acc, x: F.struct((acc["seen"] + x["n"]).alias("seen"), F.when((acc["v"].isNull()) & (acc["seen"] + x["n"] > rank - F.col(f"__b{k}")), x["v"]).otherwise(acc["v"]).alias("v"))
        found = F.aggregate(f"__i{k}", F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("v")), step)["v"]
        return F.when(rank < F.col(f"__b{k}"), F.col(f"__l{k}")).otherwise(F.coalesce(found, F.col(f"__h{k}")))

    out = []
    for k, (name, (_, q)) in enumerate(wanted):
        place = (F.col(f"__n{k}") - 1) * F.lit(float(q))
        first = F.floor(place).cast("bigint")
        a, b = at(k, first), at(k, F.ceil(place).cast("bigint"))
        out.append(F.when(F.col(f"__n{k}") > 0, a + (b - a) * (place - first)).alias(name))
    internal = {f"__{c}{k}" for c in "enblhi" for k in range(len(wanted))}
    return every.select(*[c for c in every.columns if c not in internal], *out)


def existing(df: DataFrame, names: list[str]) -> list[str]:
    return [c for c in names if c in df.columns]


def first_existing(df: DataFrame, names: list[str], default=None) -> Column:
    """The first of the columns that the table has; a choice for the whole table, not for each row."""
    found = existing(df, names)
    return F.col(found[0]) if found else F.lit(default)


def reattach(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join group statistics back by keys, NULL matching NULL."""
    renamed = stats.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in stats.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return df.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


# ---------------------------------------------------------------- wide tables


def metric_order(name: str) -> tuple:
    """Sort key of metric names: numbered ones by number, PSA by period, others by name."""
    if m := re.fullmatch(r"C(\d+)", name):
        return (0, float(m[1]), name)
    if m := re.fullmatch(r"PSA_T(\d+(?:\.\d+)?)", name):
        return (1, float(m[1]), name)
    return (2 if name == "rms" else 3, 0.0, name)


def stems(df: DataFrame, *, need: tuple[str, ...] = ("obs", "syn"), family: str = "all") -> list[str]:
    """Metrics of a wide table that have all of the needed columns (``<stem>_obs`` and so on)."""
    have = set(df.columns)
    found = {c[: -len(need[0]) - 1] for c in have if c.endswith(f"_{need[0]}")}
    found = {s for s in found if all(f"{s}_{n}" in have for n in need)}
    kinds = {"psa": r"PSA_T.*", "legacy": r"C\d+", "named": r"(?!C\d+$)(?!PSA_T).*", "all": r".*"}
    return sorted((s for s in found if re.fullmatch(kinds[family], s)), key=metric_order)


def wide_to_long(df: DataFrame, context: list[str], mode: str = "logratio") -> DataFrame:
    """One row per metric of a wide table: context, metric, value_obs, value_syn, residual, score."""
    parts = []
    for s in stems(df):
        o, v = finite(f"{s}_obs"), finite(f"{s}_syn")
        kept = finite(f"{s}_score") if f"{s}_score" in df.columns else F.lit(None).cast("double")
        parts.append(F.struct(F.lit(s).alias("metric"), o.alias("value_obs"), v.alias("value_syn"), R.wide_residual(o, v, mode).alias("residual"), kept.alias("score")))
    if not parts:
        raise ValueError("no metric has both an _obs and a _syn column")
    return df.select(*existing(df, context), F.explode(F.array(*parts)).alias("m")).select(*existing(df, context), "m.*")


def coalesce_columns(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Rename columns; where several get the same name, the first present value of a row is kept."""
    targets: dict[str, list[str]] = {}
    for c in df.columns:
        targets.setdefault(renames.get(c, c), []).append(c)
    return df.select(*[(F.coalesce(*[F.col(f"`{c}`") for c in cs]) if len(cs) > 1 else F.col(f"`{cs[0]}`")).alias(t) for t, cs in targets.items()])


# ---------------------------------------------------------------- summaries


def summarize(df: DataFrame, value: str, groups: list[str], *, exact: bool = True) -> DataFrame:
    """Count, mean, median, standard deviation and interquartile range of the finite values per group."""
    v = finite(value)
    by = existing(df, groups)
    got = aggregate(df, by, [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")], {"median": (v, 0.5), "__q1": (v, 0.25), "__q3": (v, 0.75)}, exact=exact)
    return got.select(*by, "n", "mean", "median", "std", (F.col("__q3") - F.col("__q1")).alias("iqr"))


def summarize_scores(df: DataFrame, groups: list[str], scores: list[str], *, exact: bool = True) -> DataFrame:
    by = existing(df, groups)
    aggs = [f for s in scores for f in (F.avg(finite(s)).alias(f"{s}_mean"), F.stddev_samp(finite(s)).alias(f"{s}_std"), F.count(finite(s)).alias(f"{s}_count"))]
    got = aggregate(df, by, aggs, {f"{s}_median": (finite(s), 0.5) for s in scores}, exact=exact)
    return got.select(*by, *[f"{s}_{k}" for s in scores for k in ("mean", "median", "std", "count")])


def group_means(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Means per group without NULL keys."""
    keyed = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    return keyed.groupBy(*keys).agg(*[F.avg(finite(v)).alias(v) for v in values])


def mean_over_events(df: DataFrame, value: str, keys: list[str], event: str = "event_id") -> DataFrame:
    """Mean over events of the events' means, and the number of events; every event weighs the same."""
    rows = df.where(finite(value).isNotNull())
    per_event = rows.groupBy(*keys, event).agg(F.avg(finite(value)).alias("__m"))
    return per_event.groupBy(*keys).agg(F.avg("__m").alias(value), F.count_distinct(event).alias("n_events"))


def path_table(df: DataFrame, value: str = "residual") -> DataFrame:
    """Rows with value, distance and azimuth, computed from coordinates where the table has them."""
    g = add_path_geometry(df)
    return g.where(finite(value).isNotNull() & finite("distance_km").isNotNull() & finite("azimuth_deg").isNotNull())


def path_bins(df: DataFrame, groups: list[str], value: str = "residual", *, distance_km: float = 10.0, azimuth_deg: float = 30.0, exact: bool = True) -> DataFrame:
    binned = df.withColumns({"distance_bin_km": grid_cell("distance_km", distance_km), "azimuth_bin_deg": grid_cell(F.pmod(finite("azimuth_deg"), F.lit(360.0)), azimuth_deg)})
    by = [*existing(df, groups), "distance_bin_km", "azimuth_bin_deg"]
    got = aggregate(binned, by, [F.avg(finite(value)).alias("mean_residual"), F.count(F.lit(1)).alias("n")], {"median_residual": (finite(value), 0.5)}, exact=exact)
    return got.select(*by, "mean_residual", "median_residual", "n")


# Value columns of a dashboard summary, the first present one of a row counting.
SUMMARY_VALUES = ("residual", "log2_residual", "ln_residual", "anderson_2004_gof", "olsen_mayhew_gof", "score", "value", "value_obs", "value_syn")


def summary_value(df: DataFrame) -> Column:
    found = existing(df, list(SUMMARY_VALUES))
    return F.coalesce(*[finite(c) for c in found]) if found else F.lit(None).cast("double")


def _medians(df: DataFrame) -> dict[str, tuple[Column, float]]:
    names = {"residual": "med_resid", "score": "med_score"}
    return {names.get(c, f"med_{c}"): (finite(c), 0.5) for c in existing(df, list(SUMMARY_VALUES))}


def dashboard_cubes(df: DataFrame, *, distance_km: float = 10.0, azimuth_deg: float = 10.0, exact: bool = True, only: str | None = None, rows: tuple[DataFrame, list[str]] | None = None) -> dict[str, DataFrame]:
    """The four dashboard summaries: by model, metric and band; by station; by event; by path bin.

    With ``only``, the summary of that name alone: large inputs are read for each summary here
    already. ``rows`` is for the events' groups (see ``aggregate``).
    """
    base = ["model", "metric", "band", "component"]
    n = F.count(F.lit(1)).alias("n")
    meds = _medians(df)
    has_far = "distance_km" in df.columns
    far = {"med_dist_km": (finite("distance_km"), 0.5)} if has_far else {}
    # Without distances the column counts the rows.
    aggs = [n] if has_far else [n, F.count(F.lit(1)).alias("med_dist_km")]

    def cube(frame: DataFrame, keys: list[str], aggs: list[Column], quantiles: dict[str, tuple[Column, float]], order: list[str], rows: tuple[DataFrame, list[str]] | None = None) -> DataFrame:
        by = existing(frame, keys)
        return aggregate(frame, by, aggs, quantiles, exact=exact, rows=rows).select(*by, *order)

    def overall() -> DataFrame:
        got = aggregate(df, existing(df, base), [n], {"__q1": (summary_value(df), 0.25), "__q3": (summary_value(df), 0.75), **meds}, exact=exact)
        return got.select(*existing(df, base), (F.col("__q3") - F.col("__q1")).alias("IQR"), "n", *meds)

    def path_hex() -> DataFrame:
        binned = df.withColumns({"dist_bin_km": grid_cell("distance_km", distance_km), "az_bin_deg": grid_cell(F.pmod(finite("azimuth_deg"), F.lit(360.0)), azimuth_deg)})
        return cube(binned, [*base, "dist_bin_km", "az_bin_deg"], [n], meds, ["n", *meds])

    make = {
        "model_metric_band": overall,
        "station_rollup": lambda: cube(df, ["station", "sta_lat", "sta_lon", "Vs30", "vs30", "geology_class", *base], aggs, far | meds, ["med_dist_km", "n", *meds]),
        "event_rollup": lambda: cube(df, ["event_id", "event_lat", "event_lon", "magnitude", "event_magnitude", *base], aggs, far | meds, ["med_dist_km", "n", *meds], rows),
    }
    if {"distance_km", "azimuth_deg"} <= set(df.columns):
        make["path_hex"] = path_hex
    return {k: f() for k, f in make.items() if only in (None, k)}


def label_summary(df: DataFrame, labels: str, value: str, groups: list[str], *, exact: bool = True) -> DataFrame:
    """As ``summarize``, each row counting for every label of a ``;``-delimited text."""
    each = df.withColumn("label", F.explode(F.filter(F.transform(F.split(F.coalesce(F.col(labels), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)))
    return summarize(each, value, ["label", *groups], exact=exact)


def pivot_statistic(df: DataFrame, rows: str, columns: str, value: str, how: str = "median", wanted: list | None = None) -> DataFrame:
    """Matrix of a statistic. Without ``wanted`` column values they are looked up first (and are thereby as many as the result has columns)."""
    if wanted is None:
        wanted = [r[0] for r in df.select(columns).distinct().where(F.col(columns).isNotNull()).orderBy(columns).limit(10_001).collect()]
        if len(wanted) > 10_000:
            raise ValueError("too many columns")
    if how == "median":
        cells = aggregate(df, [rows, columns], [], {"__median": (finite(value), 0.5)})
        return cells.groupBy(rows).pivot(columns, wanted).agg(F.max("__median"))
    make = {"mean": F.avg, "count": F.count, "max": F.max, "min": F.min, "sum": F.sum}
    return df.groupBy(rows).pivot(columns, wanted).agg(make[how](finite(value) if how != "count" else F.col(value)))


def histogram(df: DataFrame, value: str, bins: int = 40, *, clip: bool = False, bounds: tuple[float, float] | None = None) -> DataFrame:
    """Counts in equal bins over the range of the values, which may be bounded or clipped to 1.5 IQR around the quartiles."""
    v = df.select(finite(value).alias("v")).where(F.col("v").isNotNull())
    if bounds:
        v = v.where(F.col("v").between(*bounds))
    if clip:
        q = aggregate(v, [], [], {"a": (F.col("v"), 0.25), "b": (F.col("v"), 0.75)})
        v = v.crossJoin(F.broadcast(q)).where(F.col("v").between(F.col("a") - 1.5 * (F.col("b") - F.col("a")), F.col("b") + 1.5 * (F.col("b") - F.col("a")))).select("v")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    return v.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin"), (F.col("lo") + at * width).alias("bin_start")).agg(F.count(F.lit(1)).alias("n"))


def bin_edges(df: DataFrame, value: str, step: float) -> DataFrame:
    """``edge`` from the step below the least to one step beyond the greatest value."""
    r = df.agg(F.min(finite(value)).alias("lo"), F.max(finite(value)).alias("hi")).where(F.col("lo").isNotNull())
    k = F.sequence(F.floor(F.col("lo") / step), F.ceil(F.col("hi") / step) + 1)
    return r.select((F.explode(k) * F.lit(float(step))).alias("edge"))


def grid_means(df: DataFrame, lon: str, lat: str, value: str, cell: float) -> DataFrame:
    """Mean value per cell, at the cell's centre."""
    return df.groupBy((grid_cell(lon, cell) + cell / 2).alias("lon"), (grid_cell(lat, cell) + cell / 2).alias("lat")).agg(F.avg(finite(value)).alias(value), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- events and stations


def center_by_event(field: DataFrame, *, value: str = "field_value", groups: list[str] | None = None, least_stations: int = 2, remove_mean: bool = True, reference: Column | None = None) -> DataFrame:
    """``event_mean``, ``event_std``, ``event_station_count``, ``field_centered`` and ``field_z``.

    An event is a set of ``groups`` (default ``event_id``). Events of fewer than ``least_stations``
    stations go. With ``reference``, statistics come from the rows where it is true and are
    applied to all rows of the event. ``field_z`` is NULL where the deviation is 0 or undefined,
    and everywhere if the mean is not removed.
    """
    by = groups or ["event_id"]
    v = finite(value)
    used = v if reference is None else F.when(reference, v)
    station = F.when(used.isNotNull(), F.col("station"))
    stats = field.groupBy(*by).agg(F.avg(used).alias("event_mean"), F.stddev_samp(used).alias("event_std"), F.count_distinct(station).alias("event_station_count"))
    joined = reattach(field, stats.where(F.col("event_station_count") >= least_stations), by, "inner")
    centred = v - F.col("event_mean") if remove_mean else v
    z = F.when(F.col("event_std") > 0, (v - F.col("event_mean")) / F.col("event_std")) if remove_mean else F.lit(None).cast("double")
    return joined.withColumns({"field_centered": centred, "field_z": z})


def collapse_and_demean(df: DataFrame, keys: list[str], event_keys: list[str], value: str = "value", *, pooled: bool = False, dataset: str = "dataset") -> DataFrame:
    """Mean per key, less the mean of those means over the event's keys; ``pooled`` takes both datasets' means together."""
    cells = df.where(finite(value).isNotNull()).groupBy(*keys).agg(F.avg(finite(value)).alias("value_raw"), F.count(F.lit(1)).alias("n_rows"))
    by = [k for k in event_keys if not (pooled and k == dataset)]
    stats = cells.groupBy(*by).agg(F.avg("value_raw").alias("event_mean"))
    return reattach(cells, stats, by).withColumn("value", F.col("value_raw") - F.col("event_mean"))


def station_bias(centred: DataFrame, *, value: str = "field_centered", groups: list[str] | None = None, least_events: int = 1, exact: bool = True) -> DataFrame:
    """Per station: position, events, mean, median, deviation, standard error, |mean| and mean over standard error.

    Largest |mean| first is ``orderBy(desc(abs_mean), station)``; the rows come unordered.
    """
    by = [*(groups or []), "station"]
    v = finite(value)
    rows = centred.where(F.col("station").isNotNull() & v.isNotNull())
    aggs = [F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count_distinct("event_id").alias("n_events"), F.avg(v).alias("mean_centered"), F.stddev_samp(v).alias("std_centered")]
    s = aggregate(rows, by, aggs, {"median_centered": (v, 0.5)}, exact=exact).select(*by, "lat", "lon", "n_events", "mean_centered", "median_centered", "std_centered")
    sem = F.col("std_centered") / F.sqrt(F.greatest(F.col("n_events"), F.lit(1)))
    out = s.where(F.col("n_events") >= least_events).withColumn("sem_centered", sem)
    return out.withColumns({"abs_mean": F.abs("mean_centered"), "z_score": F.when(F.col("sem_centered") > 0, F.col("mean_centered") / F.col("sem_centered"))})


def event_locations(field: DataFrame, order: str) -> DataFrame:
    """Per event: first present name by ``order``, mean position and magnitude, stations."""
    named = F.when(present("event_name").isNotNull(), F.struct(F.col(order).alias("o"), present("event_name").alias("v")))
    return field.where(F.col("event_id").isNotNull()).groupBy("event_id").agg(
        F.min(named)["v"].alias("event_name"), F.avg("event_magnitude").alias("event_magnitude"), F.avg("event_lat").alias("event_lat"), F.avg("event_lon").alias("event_lon"), F.count_distinct("station").alias("n_stations")
    )


def station_catalog(field: DataFrame) -> DataFrame:
    return field.where(F.col("station").isNotNull()).groupBy("station").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("event_id").alias("n_events"))


def feature_table(centred: DataFrame, feature: str, value: str, *, keys: list[str] | None = None, wanted: list | None = None) -> DataFrame:
    """Station by feature matrix of mean values."""
    return pivot_statistic(centred.withColumn("__k", F.struct(*(keys or ["station"]))), "__k", feature, value, "mean", wanted).select("__k.*", "*").drop("__k")


def first_present(df: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """One row per key: each column's first present value in the given order."""
    pick = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))["v"].alias(c)
    return df.groupBy(*keys).agg(*[pick(c) for c in columns])


def first_row(df: DataFrame, keys: list[str], order: list[str], *, last: bool = False) -> DataFrame:
    """The first (or last) whole row of each key, by an aggregation that needs no sort of a key's rows."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)], *rest)
    picked = df.groupBy(*keys).agg((F.max if last else F.min)(row).alias("__r"))
    return picked.select(*keys, *[F.col(f"__r.`{c}`").alias(c) for c in rest])


def top_k(df: DataFrame, value: str, k: int, *, ties: list[str] | None = None, absolute: bool = True) -> DataFrame:
    by = F.abs(finite(value)) if absolute else finite(value)
    return df.orderBy(by.desc_nulls_last(), *(ties or [])).limit(k)
