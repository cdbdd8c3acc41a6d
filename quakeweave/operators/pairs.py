"""The numbered pair metrics C1 to C13, their scores, and lags of picked phases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quakeweave.functions import kernels as K
from quakeweave.functions.text import OLD_METRIC_NAMES

# Frequencies (Hz) over which C8 and C9 are averaged.
SPECTRUM_HZ = tuple(np.logspace(-1, 1, 40).tolist())
_TRACE = {"C1": K.arias_duration, "C2": K.energy_duration, "C3": K.arias_intensity, "C4": K.energy_intensity, "C5": K.pga, "C6": K.pgv, "C7": K.pgd, "C13": K.cav}


def score_np(a: float, b: float, scoring: str = "decay") -> float:
    """Score from 0 to 10 of two values: NaN if one is undefined, 0 if one is not positive."""
    if not (np.isfinite(a) and np.isfinite(b)):
        return float("nan")
    if a <= 0 or b <= 0:
        return 0.0
    gap = abs(a - b) / min(a, b)
    return float(10 * 0.5**gap if scoring == "decay" else 10 * np.exp(-(gap**2)))


def pair_metrics(obs: np.ndarray, syn: np.ndarray, dt: float, *, scoring: str = "decay", max_lag_s: float | None = None, periods: tuple[float, ...] = tuple(np.arange(1.0, 10.01, 0.5))) -> dict[str, tuple[float, float, float]]:
    """Observed value, synthetic value and score of each metric; of C10 to C12 the value stands once.

    C8 and C9 are log means of response and Fourier spectra over ``SPECTRUM_HZ`` with mean scores;
    ``PSA_T<period>`` are single periods. C11 is the delay, scored against the length of the record.
    """
    nan = float("nan")
    out = {m: (a := f(obs, dt), b := f(syn, dt), score_np(a, b, scoring)) for m, f in _TRACE.items()}
    hz = np.array([f for f in SPECTRUM_HZ if 1 / (min(len(obs), len(syn)) * dt) <= f < 0.5 / dt])
    for m, make in (("C8", lambda x: K.response_spectrum(x, dt, 1 / hz)), ("C9", lambda x: K.fas(x, dt, 1 / hz, hann=False))):
        a, b = make(obs), make(syn)
        scores = [score_np(p, q, scoring) for p, q in zip(a, b)]
        out[m] = (K.log_mean(a), K.log_mean(b), float(np.nanmean(scores)) if np.isfinite(scores).any() else nan)
    own, other = K.response_spectrum(obs, dt, periods), K.response_spectrum(syn, dt, periods)
    for p, a, b in zip(periods, own, other):
        out[f"PSA_T{p:.1f}"] = (float(a), float(b), score_np(a, b, scoring))
    r = K.correlation(obs, syn)
    delay = K.traveltime_delay(obs, syn, dt, max_lag_s)
    moved = K.delay_corrected_cc(obs, syn, dt, delay)
    length = len(obs) * dt
    out["C10"] = (r, nan, 10 * max(r, 0.0) if np.isfinite(r) else nan)
    out["C11"] = (delay, nan, 10 * max(0.0, 1 - abs(delay) / length) if np.isfinite(delay) and length > 0 else nan)
    out["C12"] = (moved, nan, 10 * max(moved, 0.0) if np.isfinite(moved) else nan)
    return out


PAIR_ROW = T.StructType([T.StructField(n, t) for n, t in (("code", T.StringType()), ("metric", T.StringType()), ("value_obs", T.DoubleType()), ("value_syn", T.DoubleType()), ("score", T.DoubleType()))])


def pair_metric_rows(df: DataFrame, keys: list[str], *, obs: str = "obs_samples", syn: str = "syn_samples", dt: str = "dt", scoring: str = "decay") -> DataFrame:
    """One row per pair and numbered metric; pairs that lack a trace give none."""
    schema = T.StructType([*[df.schema[k] for k in keys], *PAIR_ROW.fields])
    num = lambda v: float(v) if np.isfinite(v) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                if r[obs] is None or r[syn] is None or not len(r[obs]) or not len(r[syn]):
                    continue
                a, b = (np.array([np.nan if v is None else v for v in r[c]], float) for c in (obs, syn))
                for m, (x, y, s) in pair_metrics(a, b, r[dt], scoring=scoring).items():
                    rows.append({**{k: r[k] for k in keys}, "code": m, "metric": OLD_METRIC_NAMES.get(m, m.split("_")[0]), "value_obs": num(x), "value_syn": num(y), "score": num(s)})
            yield pd.DataFrame(rows, columns=schema.names)

    return df.select(*keys, obs, syn, dt).mapInPandas(run, schema)


def phase_lag(obs: np.ndarray, syn: np.ndarray, dt: float, pick_obs_s: float, pick_syn_s: float, *, before_s: float = 1.0, after_s: float = 2.0, max_lag_s: float | None = None) -> dict:
    """Lag of a picked phase, and the correlation of the windows around both picks."""
    out = {"lag_s": None, "correlation": None, "status": "fail", "reason": ""}
    if not (np.isfinite(pick_obs_s) and np.isfinite(pick_syn_s)):
        return out | {"reason": "missing_pick"}
    lag = pick_syn_s - pick_obs_s
    if max_lag_s is not None and abs(lag) > max_lag_s:
        return out | {"lag_s": lag, "reason": "lag_exceeds_limit"}
    parts = []
    for x, p in ((obs, pick_obs_s), (syn, pick_syn_s)):
        a, b = int(round((p - before_s) / dt)), int(round((p + after_s) / dt)) + 1
        if a < 0 or b > len(x):
            return out | {"lag_s": lag, "reason": "window_outside_trace"}
        parts.append(K.clean(x[a:b]))
    n = min(map(len, parts))
    r = K.correlation(parts[0][:n], parts[1][:n])
    return out | {"lag_s": lag, "correlation": r if np.isfinite(r) else None, "status": "pass", "reason": ""}
