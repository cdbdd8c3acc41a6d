"""Quality control of records and metrics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakeweave.functions import kernels as K
from quakeweave.functions import text as X
from quakeweave.functions.labels import finite, present
from quakeweave.functions.traces import _array
from quakeweave.operators.metrics import first_row, reattach

# Inventory bands in seconds, and reasons of rejection in their order.
BANDS = (("1-3s", 1.0, 3.0), ("3-5s", 3.0, 5.0), ("5-10s", 5.0, 10.0))
REASONS = (
    "record_too_short",
    "end_before_origin_plus_60s",
    "no_clear_horizontal_onset",
    "signal_before_origin",
    "horizontal_onset_inconsistent",
    "insufficient_noise_window",
    "insufficient_signal_window",
    "insufficient_preorigin_window",
    "low_snr",
    "high_preorigin_energy",
    "high_origin_energy",
)
PAIR_KEYS = ["event_id", "station", "component", "passband", "metric_group", "metric", "period_s"]


def _reasons(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in pairs]))


def global_reasons(length_s, end_s, onset_reasons=None, *, least_length_s: float = 60.0, least_end_s: float = 60.0) -> Column:
    """Reasons that reject a whole trace; an unknown length or end rejects."""
    short = F.coalesce(finite(length_s) < least_length_s, F.lit(True))
    early = F.coalesce(finite(end_s) < least_end_s, F.lit(True))
    own = _reasons((short, REASONS[0]), (early, REASONS[1]))
    return X.distinct_reasons(own if onset_reasons is None else F.concat(own, onset_reasons))


def passband_reasons(shared: Column, *, noise_ok, signal_ok, snr, snr_least: float = 3.0, pre_ok=None, pre_ratio=None, origin_ok=None, origin_ratio=None, ratio_most: float = 0.5) -> Column:
    """The shared reasons and those of one passband."""
    c = lambda x: F.lit(False) if x is None else F.col(x) if isinstance(x, str) else x
    noise, signal = c(noise_ok), c(signal_ok)
    low = noise & signal & F.coalesce(finite(snr) < snr_least, F.lit(True))
    high = lambda ok, ratio: c(ok) & signal & F.coalesce(finite(ratio if ratio is not None else F.lit(None)) > ratio_most, F.lit(True))
    own = _reasons((~noise, REASONS[5]), (~signal, REASONS[6]), (low, REASONS[8]), (high(pre_ok, pre_ratio), REASONS[9]), (high(origin_ok, origin_ratio), REASONS[10]))
    return X.distinct_reasons(F.concat(shared, own))


def period_supported(period, fmax) -> Column:
    """False if the period is shorter than the synthetic's highest frequency allows; the limit itself is fine."""
    p, f = finite(period), finite(fmax)
    return F.coalesce(~(p < F.when(f > 0, 1 / f)), F.lit(True))


def requirement_grid(records: DataFrame, *, sources: list[str], components: list[str], passbands: list[str], metrics: list[tuple[str, str]], periods: list[float]) -> DataFrame:
    """Everything that needs a QC row: records by source, component, passband, metric and, for spectra, period."""
    m = [(g, x, p) for g, x in metrics for p in ((periods or [None]) if g == "spectral" else [None])]
    rows = [(s, c, b, *x) for s in sources for c in components for b in passbands for x in m]
    # One small partition: it is multiplied with those of the records.
    grid = records.sparkSession.createDataFrame(rows, "source string, component string, passband string, metric_group string, metric string, period_s double").coalesce(1)
    return records.select("event_id", "station", "observed_available", "synthetic_available").distinct().crossJoin(F.broadcast(grid))


def metric_qc_summary(grid: DataFrame, *, synthetic_fmax: float | None = None, trace_qc: DataFrame | None = None, order: str = "seq") -> DataFrame:
    """QC status and reason of each required row.

    A missing record fails, then a period the synthetic cannot support, then a trace that
    failed QC (any failing row of its key outweighs passing ones; the last one's reason counts).
    """
    there = F.when(F.col("source") == "observed", F.col("observed_available")).otherwise(F.col("synthetic_available"))
    unsupported = (F.col("source") == "synthetic") & (F.col("metric_group") == "spectral") & ~period_supported("period_s", F.lit(synthetic_fmax).cast("double"))
    reason = F.when(~F.coalesce(there, F.lit(False)), F.concat(F.lit("missing_"), F.col("source"), F.lit("_waveform"))).when(unsupported, F.lit("period_below_synthetic_min_period"))
    out = grid.withColumn("qc_reason", reason)
    if trace_qc is not None:
        keys = ["source", "event_id", "station", "component", "passband"]
        failed = trace_qc.where(X.qc_status("qc_status") == "fail")
        last = first_row(failed.select(*keys, "qc_reason", order), keys, [order], last=True).select(*keys, F.coalesce(present("qc_reason"), F.lit("trace_qc_failed")).alias("trace_reason"))
        out = reattach(out, last, keys).withColumn("qc_reason", F.coalesce("qc_reason", "trace_reason")).drop("trace_reason")
    return out.withColumn("qc_status", F.when(F.col("qc_reason").isNull(), F.lit("pass")).otherwise(F.lit("fail"))).withColumn("qc_reason", F.coalesce("qc_reason", F.lit("")))


def comparison_pairs(qc: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Observed and synthetic QC side by side, NULL periods matching, with ``retained``: both pass."""
    by = keys or PAIR_KEYS
    side = lambda s, p: qc.where(F.col("source") == s).select(*by, F.col("qc_status").alias(f"{p}_qc_status"), F.col("qc_reason").alias(f"{p}_qc_reason"))
    b = side("synthetic", "syn").withColumnsRenamed({k: f"__{k}" for k in by})
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by])
    joined = side("observed", "obs").join(b, on).drop(*[f"__{k}" for k in by])
    return joined.withColumn("retained", (X.qc_status("obs_qc_status") == "pass") & (X.qc_status("syn_qc_status") == "pass"))


def retention(pairs: DataFrame, groups: list[str]) -> DataFrame:
    n, r = F.count(F.lit(1)), F.count_if(F.col("retained"))
    return pairs.groupBy(*groups).agg(n.alias("total_pairs"), r.alias("retained_pairs"), (F.lit(100.0) * r / n).alias("retention_percent"))


def availability(qc: DataFrame, *, every: bool = True) -> DataFrame:
    """Whether each event and station has an observed and a synthetic record that passes (in all rows, or in any)."""
    ok = X.qc_status("qc_status") == "pass"
    test = F.bool_and if every else F.bool_or
    flag = lambda s: F.coalesce(test(F.when(F.col("source") == s, ok)), F.lit(False))
    return qc.groupBy("event_id", "station").agg(flag("observed").alias("observed_available"), flag("synthetic").alias("synthetic_available"))


def accepted_bands(inventory: DataFrame, keys: list[str], wanted: list[tuple[float, float]] | None, low: str, high: str, ok: str) -> DataFrame:
    """Per key whether all bands that overlap the wanted ones are accepted, and whether any is."""
    rows = inventory
    if wanted:
        rows = rows.where(reduce(lambda a, b: a | b, [F.greatest(F.col(low), F.lit(a)) < F.least(F.col(high), F.lit(b)) for a, b in wanted]))
    return rows.groupBy(*keys).agg(F.bool_and(ok).alias("all_accepted"), F.bool_or(ok).alias("any_accepted"))


def drop_causes(qc: DataFrame, *, top: int = 12, groups: list[str] | None = None) -> DataFrame:
    """Counts of reasons of failing rows, those beyond the ``top`` most frequent together as ``Other``."""
    each = qc.where(X.qc_status("qc_status") == "fail").withColumn("reason", F.explode(X.distinct_reasons(F.split(F.coalesce(F.col("qc_reason"), F.lit("")), ";"))))
    first = each.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(top).select("reason", F.lit(True).alias("named"))
    shown = F.when(F.col("named"), F.col("reason")).otherwise(F.lit("Other"))
    return reattach(each, first, ["reason"]).groupBy(*(groups or []), shown.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


def companion_summary(inventory: DataFrame, groups: list[str], *, ok: str, reasons: str) -> DataFrame:
    """Totals, acceptance and the share of each reason per group."""
    n = F.count(F.lit(1))
    own = F.split(F.coalesce(F.col(reasons), F.lit("")), ";")
    share = [(F.lit(100.0) * F.count_if(F.array_contains(own, r)) / n).alias(f"percent_{r}") for r in REASONS]
    return inventory.groupBy(*groups).agg(n.alias("total"), F.count_if(F.col(ok)).alias("accepted"), (n - F.count_if(F.col(ok))).alias("rejected"), *share)


def apply_decisions(inventory: DataFrame, decisions: DataFrame, *, order: str = "seq") -> DataFrame:
    """Manual decisions over automatic ones: a band's decision outweighs the full trace's, the exact component outweighs all components.

    ``inventory`` has event_id, station, component, band, reject and reject_reason.
    """
    from quakeweave.operators.joins import ladder_lookup

    d = decisions.withColumns({"component": F.coalesce(F.upper(present("component")), F.lit("")), "scope_kind": F.coalesce(F.lower(present("scope_kind")), F.lit("full")), "scope_label": F.coalesce(present("scope_label"), F.lit(""))})
    d = d.withColumn("component", F.when(F.col("component") == "ALL", F.lit("")).otherwise(F.col("component")))
    c, b, blank = F.upper(F.col("component")), F.col("band"), F.lit("")
    steps = [{"component": x, "scope_kind": F.lit(k), "scope_label": y} for k, y in (("band", b), ("full", blank)) for x in (c, blank)]
    got = ladder_lookup(inventory, d, ["event_id", "station"], steps, ["decision", "reason_code"], [order])
    said = F.lower(F.trim("decision"))
    manual = F.when(said == "reject", F.lit(True)).when(said == "accept", F.lit(False))
    reason = F.when(manual, F.coalesce(present("reason_code"), F.lit("manual_reject"))).when(manual == F.lit(False), F.lit("")).otherwise(F.col("reject_reason"))
    return got.withColumns({"reject_reason": reason, "reject": F.coalesce(manual, F.col("reject"))}).drop("decision", "reason_code")


def best_picks(picks: DataFrame, keys: list[str], *, least: float = 0.0, order: str = "seq") -> DataFrame:
    """The most probable pick of each key, the first of several."""
    rows = picks.where(finite("probability") >= least).withColumn("__p", -finite("probability"))
    return first_row(rows, keys, ["__p", order]).drop("__p")


def resume(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose keys are not done yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


TRACE_QC = T.StructType([T.StructField(n, T.DoubleType()) for n in ("record_length_s", "start_rel_s", "end_rel_s", "onset_s", "noise_rms", "signal_rms", "snr", "pre_origin_ratio", "origin_ratio")] + [T.StructField("noise_ok", T.BooleanType()), T.StructField("signal_ok", T.BooleanType())])


def trace_quality(samples: np.ndarray, dt: float, start_rel_s: float, *, period_s: float = 1.0, noise_gap_s: float = 0.5, noise_least_s: float = 1.0, signal_least_s: float = 10.0, pick_s: float | None = None) -> dict:
    """Lengths, onset, noise and signal level of one trace; times are relative to the event's origin."""
    x = K.clean(samples)
    x = x - x.mean() if len(x) else x
    t = start_rel_s + np.arange(len(x)) * dt
    out = dict.fromkeys(TRACE_QC.names) | {"noise_ok": False, "signal_ok": False, "record_length_s": len(x) * dt, "start_rel_s": start_rel_s}
    if not len(x):
        return out
    out["end_rel_s"] = float(t[-1])
    envelope = K.smooth_abs(x, dt)
    onset = pick_s
    if onset is None:
        over = np.flatnonzero((t >= 0) & (envelope >= K.onset_threshold(envelope, t)))
        onset = float(t[over[0]]) if len(over) else None
    out["onset_s"] = onset
    if onset is None:
        return out
    wide = max(noise_least_s, 2 * period_s)
    noise_end = onset - noise_gap_s
    noise_start = max(t[0], noise_end - 5 * wide)
    signal_end = min(t[-1], onset + max(signal_least_s, 5 * period_s))
    noise, signal = K.window_rms(x, t, noise_start, noise_end), K.window_rms(x, t, onset, signal_end)
    out["noise_ok"] = bool(np.isfinite(noise) and noise_end - noise_start >= noise_least_s)
    out["signal_ok"] = bool(np.isfinite(signal) and signal_end - onset >= signal_least_s)
    num = lambda v: float(v) if np.isfinite(v) else None
    out["noise_rms"], out["signal_rms"] = num(noise), num(signal)
    if signal > 0:
        out["snr"] = num(signal / noise) if noise > 0 else None
        out["pre_origin_ratio"] = num(K.window_rms(x, t, t[0], -period_s) / signal)
        out["origin_ratio"] = num(K.window_rms(x, t, -period_s, period_s) / signal)
    return out


def trace_qc(df: DataFrame, keys: list[str], samples: str, dt: str, start: str, passbands: list[tuple[str, float, float]], **thresholds) -> DataFrame:
    """One row per trace and passband with its quality, reasons and ``qc_status``."""
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("passband", T.StringType()), *TRACE_QC.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                for name, low, high in passbands:
                    q = trace_quality(_array(r[samples] if r[samples] is not None else []), r[dt], r[start] or 0.0, period_s=high)
                    rows.append({**{k: r[k] for k in keys}, "passband": name, **q})
            yield pd.DataFrame(rows, columns=schema.names)

    q = df.select(*keys, samples, dt, start).mapInPandas(run, schema)
    shared = global_reasons("record_length_s", "end_rel_s", least_length_s=thresholds.get("least_length_s", 60.0), least_end_s=thresholds.get("least_end_s", 60.0))
    reasons = passband_reasons(shared, noise_ok="noise_ok", signal_ok="signal_ok", snr="snr", snr_least=thresholds.get("snr_least", 3.0))
    out = q.withColumn("qc_reason", F.array_join(reasons, ";"))
    return out.withColumn("qc_status", F.when(F.col("qc_reason") == "", F.lit("pass")).otherwise(F.lit("fail")))


def spectral_qc(periods: list[float], amplitudes: Column, npts: Column, dt: Column, *, threshold: float = 0.25, cycles: float = 3.0, fmax: float | None = None) -> Column:
    """``array<struct<period_s, amplitude, qc_status>>``: supported by the record and not too weak beside the strongest."""
    low = F.greatest(2 * dt, F.lit(1 / fmax if fmax else 0.0))
    high = npts * dt / cycles
    rows = F.zip_with(F.array(*[F.lit(float(p)) for p in periods]), amplitudes, lambda p, a: F.struct(p.alias("period_s"), a.alias("amplitude")))
    fits = lambda r: (r["period_s"] >= low) & (r["period_s"] <= high) & r["amplitude"].isNotNull()
    top = F.array_max(F.transform(F.filter(rows, fits), lambda r: r["amplitude"]))
    return F.transform(rows, lambda r: F.struct(r["period_s"].alias("period_s"), r["amplitude"].alias("amplitude"), F.when(fits(r) & (r["amplitude"] >= threshold * top), F.lit("pass")).otherwise(F.lit("fail")).alias("qc_status")))
