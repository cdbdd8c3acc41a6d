"""From waveform pairs to long metric rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakeweave.functions import kernels as K
from quakeweave.functions import traces as R
from quakeweave.functions.residuals import add_transforms
from quakeweave.functions.text import METRIC_GROUPS

ROW = T.StructType(
    [T.StructField(n, t) for n, t in (("metric_group", T.StringType()), ("metric", T.StringType()), ("period_s", T.DoubleType()), ("value_obs", T.DoubleType()), ("value_syn", T.DoubleType()), ("value", T.DoubleType()), ("status", T.StringType()))]
)
_GROUP = {m: g for g, ms in METRIC_GROUPS.items() for m in ms}


def as_array(samples) -> np.ndarray | None:
    """Samples of a row with NaN for NULL; None if there are none."""
    return None if samples is None or not len(samples) else R._array(samples)


def prepare_sides(traces: list[np.ndarray | None], dt: list[float], bands: list[tuple[float, float]], *, lowpass_hz=None, resample_hz=None) -> list:
    """Each trace low-passed, resampled, band-passed to its periods and cut to its valid samples, with its interval.

    Traces of equal length, interval and band are filtered together. Instead of a trace that
    cannot be filtered its ValueError is given; None stays None.
    """
    out: list = [None] * len(traces)
    stacks: dict[tuple, list[int]] = {}
    ready: dict[int, np.ndarray] = {}
    for k, x in enumerate(traces):
        if x is None:
            continue
        try:
            ready[k], h = K.preprocess(x, dt[k], lowpass_hz=lowpass_hz, resample_hz=resample_hz)
            stacks.setdefault((len(ready[k]), h, bands[k]), []).append(k)
        except ValueError as e:
            out[k] = e
    for (_, h, (low_s, high_s)), rows in stacks.items():
        try:
            y, ok = K.bandpass(np.stack([ready[k] for k in rows]), h, 1 / high_s, 1 / low_s)
        except ValueError as e:
            for k in rows:
                out[k] = e
            continue
        for k, trace, mask in zip(rows, y, ok):
            valid = np.flatnonzero(mask)
            out[k] = (trace[valid[0] : valid[-1] + 1] if len(valid) else trace[:0], h)
    return out


def spectra(traces: list[np.ndarray | None], dt: list[float], metric: str, periods: list[float]) -> list:
    """Spectrum of each trace at the periods; response spectra of equally long traces are made together."""
    out: list = [None] * len(traces)
    stacks: dict[tuple, list[int]] = {}
    for k, x in enumerate(traces):
        if x is not None and len(x):
            if metric == "PSA":
                stacks.setdefault((len(x), dt[k]), []).append(k)
            else:
                out[k] = R.SPECTRAL_METRICS[metric](x, dt[k], periods)
    for (_, h), rows in stacks.items():
        for k, v in zip(rows, R.SPECTRAL_METRICS[metric](np.stack([traces[k] for k in rows]), h, periods)):
            out[k] = v
    return out


def metric_rows(obs: np.ndarray | None, syn: np.ndarray | None, dt: float, metrics: list[str], periods: list[float], made: dict[str, tuple], *, cycles: float = 3.0) -> list[dict]:
    """Rows of ``ROW`` for one pair; ``made`` holds both sides' spectra, which give a row per period."""
    rows = []
    num = lambda v: float(v) if v is not None and np.isfinite(v) else None
    sides = [s if s is not None and len(s) else None for s in (obs, syn)]
    both = all(s is not None for s in sides)
    for m in metrics:
        base = dict.fromkeys(ROW.names) | {"metric_group": _GROUP.get(m), "metric": m, "status": "pass"}
        if m in R.PAIR_METRICS:
            rows.append(base | ({"value": num(R.PAIR_METRICS[m](*sides, dt))} if both else {"status": "missing_waveform"}))
        elif m in R.SPECTRAL_METRICS:
            bounds = [K.support_bounds(len(s), dt, cycles) for s in sides if s is not None]
            for k, p in enumerate(periods):
                o, s = (None if v is None else num(v[k]) for v in made[m])
                fits = all(a <= p <= b for a, b in bounds)
                rows.append(base | {"period_s": float(p), "value_obs": o, "value_syn": s, "status": "missing_waveform" if not both else "pass" if fits else "insufficient_cycles"})
        else:
            o, s = (None if v is None else num(R.TRACE_METRICS[m](v, dt)) for v in sides)
            rows.append(base | {"value_obs": o, "value_syn": s, "status": "pass" if both else "missing_waveform"})
    return rows


def calculate(tasks: DataFrame, keys: list[str], *, metrics: list[str], periods: list[float] = (), transforms: list[str] | None = None, obs: str = "obs_samples", syn: str = "syn_samples", dt: str = "dt", filtered: bool = True) -> DataFrame:
    """Long metric rows of tasks that carry their waveforms.

    ``tasks`` has the keys, both sides' samples, dt and, to be band-passed here, period_min_s and
    period_max_s. Each task is one row and is worked on where it lies. Comparisons are made
    only for rows that pass. A task that cannot be filtered gives one row per metric with the
    reason as status.
    """
    schema = T.StructType([*[tasks.schema[k] for k in keys], *ROW.fields])
    bands = ["period_min_s", "period_max_s"] if filtered else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = len(pdf)
            traces = [as_array(x) for c in (obs, syn) for x in pdf[c]]
            steps = [float(h) for h in pdf[dt]] * 2
            if filtered:
                limits = list(zip(pdf["period_min_s"], pdf["period_max_s"])) * 2
                got = prepare_sides(traces, steps, limits)
                errors = [str(g) if isinstance(g, ValueError) else None for g in got]
                traces = [g[0] if isinstance(g, tuple) else None for g in got]
                steps = [g[1] if isinstance(g, tuple) else h for g, h in zip(got, steps)]
            else:
                errors = [None] * (2 * n)
            made = {m: spectra(traces, steps, m, list(periods)) for m in metrics if m in R.SPECTRAL_METRICS}
            rows = []
            for k, own in enumerate(pdf[keys].to_dict("records")):
                if why := errors[k] or errors[k + n]:
                    rows += [own | dict.fromkeys(ROW.names) | {"metric_group": _GROUP.get(m), "metric": m, "status": why} for m in metrics]
                else:
                    pair = {m: (v[k], v[k + n]) for m, v in made.items()}
                    rows += [own | x for x in metric_rows(traces[k], traces[k + n], steps[k], metrics, list(periods), pair)]
            yield pd.DataFrame(rows, columns=schema.names)

    out = tasks.select(*keys, obs, syn, dt, *bands).mapInPandas(run, schema)
    ok = F.col("status") == "pass"
    made = add_transforms(out.withColumns({"__o": F.when(ok, F.col("value_obs")), "__s": F.when(ok, F.col("value_syn"))}), "__o", "__s", transforms)
    return made.drop("__o", "__s")


def task_summary(tasks: DataFrame, n_metrics: int, *, seconds_per_task: float = 60.0, memory_gb: float = 2.0, cpus: int = 1, parallel: int | None = None) -> DataFrame:
    """One row: tasks, evaluations, events, stations, CPU hours, wall hours and memory at the planned parallelism."""
    n = F.count(F.lit(1))
    lanes = F.lit(parallel) if parallel else F.greatest(n, F.lit(1))
    return tasks.agg(
        n.alias("tasks"), (n * n_metrics).alias("metric_evaluations"), F.count_distinct("event_id").alias("events"), F.count_distinct("station").alias("stations"),
        (n * F.lit(seconds_per_task * cpus / 3600)).alias("cpu_hours"), (F.ceil(n / lanes) * F.lit(seconds_per_task / 3600)).alias("wall_hours"), (F.least(n, lanes) * F.lit(memory_gb)).alias("memory_gb"),
    )
