"""Queries of the training-data problems (p1, p4, p6, p7, p8)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeweave.functions import labels as L
from quakeweave.llm import cluster as C
from quakeweave.llm import language as G
from quakeweave.llm import packing as P
from quakeweave.llm import sketch as S
from quakeweave.llm import tokenizer as K
from quakeweave.runtime import cut_lineage, table

# ------------------------------------------------------------------------- p1

SPEC = S.SketchSpec(low=-L.USABLE_RESIDUAL, high=L.USABLE_RESIDUAL, bits=20, depth=5, width=1024, exact=2048)
CLOSE = 0.1
#: A group is a level with those labels that belong to it; the others are NULL.
GROUP = ["level", "model", "band", "metric", "event_id", "period_month"]
LABELS = {"metric_band": ["model", "band", "metric", "period_month"], "model_band": ["model", "band", "period_month"], "event_model": ["event_id", "model"]}
QUANTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def _group(level: str, *labels: str) -> Column:
    return F.struct(F.lit(level).alias("level"), *[(F.col(c) if c in labels else F.lit(None).cast("string")).alias(c) for c in GROUP[1:]])


def _residuals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "example_metrics_snapshot").select(
        L.lower_key("model").alias("model"),
        L.band_key("band").alias("band"),
        L.metric_key("metric").alias("metric"),
        L.lower_key("event_id").alias("event_id"),
        F.date_format("computed_at", "yyyy-MM").alias("period_month"),
        L.usable_residual().alias("v"),
    )
    return rows.where(F.col("v").isNotNull())


def _in_groups(rows: DataFrame, *levels: str) -> DataFrame:
    """Each row once for every level of which it has all labels."""

    def complete(labels: list[str]) -> Column:
        return reduce(Column.__and__, [F.col(c).isNotNull() for c in labels])

    groups = F.array_compact(F.array(*[F.when(complete(LABELS[x]), _group(x, *LABELS[x])) for x in levels]))
    return rows.select(F.explode(groups).alias("g"), "v").select("g.*", "v")


def _group_medians(spark: SparkSession, d: str) -> DataFrame:
    """Median and its bounds for every group of the three levels.

    The parts of the metrics' sketches are written once. Added up by metric they give
    ``metric_band``, added up over the metrics ``model_band``; rows without a metric are in
    the latter only.
    """
    rows = _residuals(spark, d)
    whole = _in_groups(rows.withColumn("metric", F.coalesce("metric", F.lit(""))), "metric_band", "event_model")
    parts = cut_lineage(S.sketch_parts(whole, {c: F.col(c) for c in GROUP}, F.col("v"), SPEC), "sketches")
    by_band = parts.where(F.col("level") == "metric_band").withColumn("level", F.lit("model_band")).withColumn("metric", F.lit(None).cast("string"))
    every = parts.where((F.col("level") != "metric_band") | (F.col("metric") != "")).unionByName(by_band)
    return S.merge_sketches(every, SPEC, qs=[0.5])


def _stated(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "example_dashboard_summary").select(
        "summary_id",
        F.lower(L.trimmed("summary_level")).alias("level"),
        L.lower_key("model").alias("model"),
        L.band_key("band").alias("band"),
        L.metric_key("metric").alias("metric"),
        L.lower_key("event_id").alias("event_id"),
        L.present("period_month").alias("period_month"),
        F.col("median_value").cast("double").alias("stated"),
    )
    # Labels that don't belong to the level are no part of the group.
    return s.select("summary_id", "stated", "level", *[F.when(F.col("level").isin(*[x for x, labels in LABELS.items() if c in labels]), F.col(c)).alias(c) for c in GROUP[1:]])


def _same_group(a: DataFrame, b: DataFrame) -> Column:
    return reduce(Column.__and__, [a[c].eqNullSafe(b[c]) for c in GROUP])


def _exactly_wrong(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """Of summary rows that the bounds leave open, those whose true median is too far away.

    By counting only: a middle value is too far above if enough values are. One row per
    summary row and task is shuffled.
    """
    grouped = _in_groups(rows, "metric_band", "model_band", "event_model")
    joined = grouped.join(open_, _same_group(grouped, open_)).select("summary_id", "stated", "v")
    above, below = F.col("v") - F.col("stated") > CLOSE, F.col("stated") - F.col("v") > CLOSE
    c = joined.groupBy("summary_id", "stated").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(above).alias("above"),
        F.min(F.when(above, F.col("v"))).alias("least_above"),
        F.max(F.when(~above, F.col("v"))).alias("most_not_above"),
        F.count_if(below).alias("below"),
        F.max(F.when(below, F.col("v"))).alias("most_below"),
        F.min(F.when(~below, F.col("v"))).alias("least_not_below"),
    )
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    # Ranks from 0. If only the upper middle value is too far above, the mean of the two decides.
    first_above, last_below = F.col("n") - F.col("above"), F.col("below") - 1
    mean_above = (F.col("least_above") + F.col("most_not_above")) / 2 - F.col("stated") > CLOSE
    mean_below = F.col("stated") - (F.col("most_below") + F.col("least_not_below")) / 2 > CLOSE
    wrong = (first_above <= low) | ((first_above == high) & mean_above) | (last_below >= high) | ((last_below == low) & mean_below)
    return c.where(wrong).select("summary_id")


def judge_medians(spark: SparkSession, d: str) -> DataFrame:
    """Every summary row with its group and the verdict of the median's bounds: ``wrong``, ``right`` or ``open``."""
    stated, m = _stated(spark, d), _group_medians(spark, d)
    got = stated.join(m, _same_group(stated, m), "left").select(stated["*"], m["lower"][0].alias("lower"), m["upper"][0].alias("upper"))
    none = F.col("stated").isNull() | F.isnan("stated")
    far = F.greatest(F.abs(F.col("lower") - F.col("stated")), F.abs(F.col("upper") - F.col("stated")))
    inside = (F.col("lower") <= F.col("stated")) & (F.col("stated") <= F.col("upper"))
    near = F.when(inside, F.lit(0.0)).otherwise(F.least(F.abs(F.col("lower") - F.col("stated")), F.abs(F.col("upper") - F.col("stated"))))
    verdict = F.when(none | (near > CLOSE), F.lit("wrong")).when(F.col("lower").isNull() | (far <= CLOSE), F.lit("right")).otherwise(F.lit("open"))
    return got.select("summary_id", "stated", *GROUP, verdict.alias("verdict"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Summary rows whose stated median is absent or more than 0.1 from the group's."""
    judged = cut_lineage(judge_medians(spark, d), "judged")
    wrong = judged.where(F.col("verdict") == "wrong").select("summary_id")
    open_ = judged.where(F.col("verdict") == "open").drop("verdict")
    if open_.isEmpty():
        return wrong
    return wrong.unionByName(_exactly_wrong(_residuals(spark, d), open_))


def _merged_months(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles by model and band, from the months' sketches added up."""
    rows = _residuals(spark, d).where(F.col("model").isNotNull() & F.col("band").isNotNull() & F.col("period_month").isNotNull())
    months = cut_lineage(S.build_sketches(rows, {c: F.col(c) for c in ("model", "band", "period_month")}, F.col("v"), SPEC), "months")
    return S.merge_sketches(months.drop("period_month"), SPEC, qs=list(QUANTILES.values()))


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the usable residuals by model and band, merged from the months' sketches."""
    cols = [F.col("value")[k].alias(q) for k, q in enumerate(QUANTILES)]
    return _merged_months(spark, d).select("model", "band", "n", *cols, F.col("lower")[2].alias("p50_lower"), F.col("upper")[2].alias("p50_upper"))


def p1_percentile_bounds(spark: SparkSession, d: str) -> DataFrame:
    """For each of those percentiles whether it keeps its promise: the true one lies within the bounds, which span at most 4 % of the ranks (12 ranks in small groups).

    By counting the values below the bounds: one row per group, percentile and task is shuffled.
    """
    got = cut_lineage(_merged_months(spark, d), "quantiles")
    one = got.select("model", "band", "n", F.explode(F.arrays_zip(F.array(*[F.lit(q) for q in QUANTILES]).alias("q"), F.array(*[F.lit(x) for x in QUANTILES.values()]).alias("at"), "lower", "upper")).alias("b"))
    one = one.select("model", "band", "n", "b.*")
    rows = _residuals(spark, d).where(F.col("period_month").isNotNull())
    c = rows.join(one, ["model", "band"]).groupBy("model", "band", "q", "at", "n").agg(F.count_if(F.col("v") < F.col("lower")).alias("below"), F.count_if(F.col("v") <= F.col("upper")).alias("to"), F.count(F.lit(1)).alias("rows"))
    place = F.col("at") * (F.col("n") - 1)
    within = (F.col("rows") == F.col("n")) & (F.col("below") <= F.floor(place)) & (F.col("to") > F.ceil(place))
    return c.select("model", "band", F.col("q").alias("percentile"), "n", within.alias("within"), ((F.col("to") - F.col("below")) <= F.greatest(0.04 * F.col("n"), F.lit(12))).alias("narrow"))


# ------------------------------------------------------------------------- p4

BANDS = ["0.5-1 sec", "1-2 sec", "2-3 sec", "3-5 sec", "5-8 sec"]
#: A cluster's stations stay within a factor of about 1.4 (half a log2 unit) of its profile on the whole, and none is further than a factor of 2.4.
RMS_LIMIT, RADIUS_LIMIT = 0.5, 1.25


def station_profiles(spark: SparkSession, d: str, *, least: int = 20, least_band: int = 4) -> DataFrame:
    """``id`` and ``features``, the median usable residual of each band, of stations with enough rows.

    Medians come from mergeable summaries of bounded size (rank error at most 1 in 10,000), so
    a station with a large part of all rows is no burden for a task.
    """
    rows = table(spark, d, "example_metrics_snapshot").select(L.upper_key("station").alias("station"), L.band_key("band").alias("band"), L.usable_residual().alias("v"))
    known = table(spark, d, "selected_stations").where(F.col("station_id").isNotNull())
    ids = known.groupBy(L.upper_key("station").alias("station")).agg(F.min("station_id").alias("id")).where(F.col("station").isNotNull())
    bands = rows.where(F.col("v").isNotNull() & F.col("station").isNotNull()).groupBy("station", "band").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", 0.5, 10_000).alias("m"))
    wide = bands.groupBy("station").agg(
        F.sum("n").alias("n"), *[F.max(F.when(F.col("band") == b, F.col("n"))).alias(f"n{k}") for k, b in enumerate(BANDS)], *[F.max(F.when(F.col("band") == b, F.col("m"))).alias(f"m{k}") for k, b in enumerate(BANDS)]
    )
    enough = F.col("n") >= least
    for k in range(len(BANDS)):
        enough = enough & (F.col(f"n{k}") >= least_band)
    return wide.where(enough).join(ids, "station").select("id", F.array(*[f"m{k}" for k in range(len(BANDS))]).alias("features"))


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return C.cluster(station_profiles(spark, d), rms_limit=RMS_LIMIT, radius_limit=RADIUS_LIMIT)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The cluster of every station with enough residuals."""
    return _clusters(spark, d).select(F.col("id").alias("station_id"), "cluster_id")


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Number of clusters, and of each its size, compactness and most typical stations."""
    got = C.describe(cut_lineage(_clusters(spark, d), "clusters"))
    n = got.agg(F.count(F.lit(1)).alias("n_clusters"))
    return got.crossJoin(F.broadcast(n)).select("n_clusters", "cluster_id", F.col("size").alias("cluster_size"), "rms_distance", F.array_join("typical_ids", ",").alias("typical_stations"))


# ------------------------------------------------------------------------- p6, p7

CAPACITY = 2_048
BUCKETS = 16


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return K.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Container and place of every document or piece."""
    sizes = cut_lineage(K.count_tokens(table(spark, d, "documents"), "doc_id", "text"), "sizes")
    return P.pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p7_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Length buckets of least padding, and the room that token-budget batches inside each leave unused."""
    sizes = cut_lineage(K.count_tokens(table(spark, d, "documents"), "doc_id", "text"), "sizes")
    counts = P.length_histogram(P.cut_pieces(sizes, "doc_id", "n_tokens", CAPACITY), "piece_tokens", CAPACITY)
    rows = P.bucket_batches(counts, P.optimal_buckets(counts, BUCKETS), CAPACITY)
    schema = "bound bigint, items bigint, tokens bigint, containers bigint, unused bigint"
    return spark.createDataFrame([tuple(r[c] for c in ("bound", "items", "tokens", "containers", "unused")) for r in rows], schema)


# ------------------------------------------------------------------------- p8


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every document with words, and of every line of mixed ones."""
    docs = table(spark, d, "documents")
    return G.identify_languages(docs, "doc_id", "text", G.fit_filters(docs, "doc_id", "text", "lang"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """True languages of documents whose label is absent or wrong, and of the lines of mixed ones."""
    docs = table(spark, d, "documents")
    found = G.identify_languages(docs.select(F.struct("doc_id", G.language_code(F.col("lang")).alias("label")).alias("k"), "text"), "k", "text", G.fit_filters(docs, "doc_id", "text", "lang"))
    case = F.col("mixed") | F.col("k.label").isNull() | (F.col("k.label") != F.col("language"))
    return found.where(case & (F.col("language") != "und")).select("k.doc_id", "line_no", F.col("language").alias("lang"))


# ------------------------------------------------------------------------- SQL

_KEYED = r"""
WITH r AS (SELECT CASE WHEN lower(trim(model)) NOT IN ('','nan','none','null') THEN lower(trim(model)) END AS model,
  CASE WHEN lower(trim(event_id)) NOT IN ('','nan','none','null') THEN lower(trim(event_id)) END AS event_id,
  CASE WHEN regexp_matches(lower(trim(band)), '^[0-9.]+ *[-_] *[0-9.]+ *(s|sec)$')
    THEN regexp_extract(lower(trim(band)), '^([0-9.]+) *[-_] *([0-9.]+)', 1) || '-' || regexp_extract(lower(trim(band)), '^([0-9.]+) *[-_] *([0-9.]+)', 2) || ' sec' END AS band,
  CASE WHEN lower(trim(metric)) IN ('','nan','none','null') THEN NULL WHEN regexp_matches(upper(trim(metric)), '^(PSA|FAS)([^A-Z]|$)') THEN upper(trim(metric))[1:3]
    ELSE regexp_replace(upper(trim(metric)), '[^A-Z0-9]+', '_', 'g') END AS metric,
  strftime(computed_at, '%Y-%m') AS month, log2_residual AS v FROM example_metrics_snapshot WHERE isfinite(log2_residual) AND abs(log2_residual) <= 64)
"""
P1_SQL = (
    _KEYED
    + """,
g AS (
  SELECT 'metric_band' AS l, model, band, metric, NULL AS event_id, month, median(v) AS m FROM r WHERE model IS NOT NULL AND band IS NOT NULL AND metric IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'model_band', model, band, NULL, NULL, month, median(v) FROM r WHERE model IS NOT NULL AND band IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'event_model', model, NULL, NULL, event_id, NULL, median(v) FROM r WHERE model IS NOT NULL AND event_id IS NOT NULL GROUP BY ALL)
SELECT summary_id FROM example_dashboard_summary s LEFT JOIN g ON s.summary_level = g.l AND s.model IS NOT DISTINCT FROM g.model AND s.band IS NOT DISTINCT FROM g.band
  AND upper(s.metric) IS NOT DISTINCT FROM g.metric AND lower(s.event_id) IS NOT DISTINCT FROM g.event_id AND s.period_month IS NOT DISTINCT FROM g.month
WHERE s.median_value IS NULL OR isnan(s.median_value) OR abs(s.median_value - g.m) > 0.1"""
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_percentiles": p1_percentiles,
    "p1_percentile_bounds": p1_percentile_bounds,
    "p4_found": p4_found,
    "p4_clusters": p4_clusters,
    "p6_ids": p6_ids,
    "p7_containers": p7_containers,
    "p7_buckets": p7_buckets,
    "p8_found": p8_found,
    "p8_languages": p8_languages,
}
P1_BOUNDS_SQL = (
    _KEYED
    + """SELECT model, band, percentile, count(*) AS n, true AS within, true AS narrow FROM r, (SELECT unnest(['p05', 'p25', 'p50', 'p75', 'p95']) AS percentile)
WHERE model IS NOT NULL AND band IS NOT NULL AND month IS NOT NULL GROUP BY 1, 2, 3"""
)
SQL = {"p1_found": P1_SQL, "p1_percentile_bounds": P1_BOUNDS_SQL}
