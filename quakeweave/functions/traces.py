"""Waveforms as ``array<double>`` columns: reductions in SQL, kernels as Arrow functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakeweave.functions import kernels as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(a) -> Column:
    """Sum of an array; 0 for an empty one."""
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x)


def peak_abs(a) -> Column:
    return F.array_max(F.transform(_c(a), lambda x: F.abs(x)))


def rms(a) -> Column:
    n = F.size(_c(a))
    return F.when(n > 0, F.sqrt(total(F.transform(_c(a), lambda x: x * x)) / n))


def trapezoid(a, dt) -> Column:
    v = _c(a)
    return F.when(F.size(v) > 1, (total(v) - (F.get(v, F.lit(0)) + F.get(v, F.size(v) - 1)) / 2) * dt).otherwise(F.lit(0.0))


def arias_intensity(a, dt) -> Column:
    return F.lit(np.pi / (2 * K.GRAVITY)) * trapezoid(F.transform(_c(a), lambda x: x * x), dt)


def dot(a, b) -> Column:
    """Product over the common length."""
    n = F.least(F.size(_c(a)), F.size(_c(b)))
    return total(F.zip_with(F.slice(_c(a), 1, n), F.slice(_c(b), 1, n), lambda x, y: x * y))


def correlation(a, b) -> Column:
    n = F.least(F.size(_c(a)), F.size(_c(b)))
    x, y = F.slice(_c(a), 1, n), F.slice(_c(b), 1, n)
    norm = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm)


def scaled(a, by) -> Column:
    return F.when(by > 0, F.transform(_c(a), lambda x: x / by))


def normalized(a) -> Column:
    """Trace over its greatest absolute value."""
    return scaled(a, peak_abs(a))


def normalized_rms(a) -> Column:
    return scaled(a, rms(a))


def masked(a, mask) -> Column:
    """NULL where the mask is not true."""
    return F.zip_with(_c(a), _c(mask), lambda x, m: F.when(m, x))


def common_valid(a, b, mask_a, mask_b) -> Column:
    """Pairs of samples over the common length that are valid on both sides."""
    rows = F.arrays_zip(_c(a).alias("a"), _c(b).alias("b"), _c(mask_a).alias("p"), _c(mask_b).alias("q"))
    return F.filter(rows, lambda r: r[r"p"] & r["q"] & r["a"].isNotNull() & r["b"].isNotNull())


def rotate_ne_to_rt(north, east, backazimuth) -> tuple[Column, Column]:
    s, c = F.sin(F.radians(_c(backazimuth))), F.cos(F.radians(_c(backazimuth)))
    return F.zip_with(_c(north), _c(east), lambda n, e: -c * n - s * e), F.zip_with(_c(north), _c(east), lambda n, e: s * n - c * e)


def rotate_rt_to_ne(radial, transverse, backazimuth) -> tuple[Column, Column]:
    s, c = F.sin(F.radians(_c(backazimuth))), F.cos(F.radians(_c(backazimuth)))
    return F.zip_with(_c(radial), _c(transverse), lambda r, t: -c * r + s * t), F.zip_with(_c(radial), _c(transverse), lambda r, t: -s * r - c * t)


def spectrum_between(spectrum, low, high) -> Column:
    """The part of an ``array<struct<period, amplitude>>`` within inclusive bounds."""
    return F.filter(_c(spectrum), lambda s: (s["period"] >= low) & (s["period"] <= high))


# Kernels that reduce one trace to a number, by the metric's public name.
TRACE_METRICS: dict[str, Callable[[np.ndarray, float], float]] = {
    "PGA": K.pga,
    "PGV": K.pgv,
    "PGD": K.pgd,
    "CAV": K.cav,
    "arias_intensity": K.arias_intensity,
    "arias_duration": K.arias_duration,
    "energy_intensity": K.energy_intensity,
    "energy_duration": K.energy_duration,
}
PAIR_METRICS: dict[str, Callable[[np.ndarray, np.ndarray, float], float]] = {
    "original_cc": lambda o, s, dt: K.correlation(o, s),
    "traveltime_delay": K.traveltime_delay,
    "delay_corrected_cc": K.delay_corrected_cc,
}
SPECTRAL_METRICS: dict[str, Callable[[np.ndarray, float, list[float]], np.ndarray]] = {"PSA": K.response_spectrum, "FAS": K.fas}


def _number(v: float) -> float | None:
    return float(v) if np.isfinite(v) else None


def _array(v) -> np.ndarray:
    """Samples with NaN for NULL; Arrow batches come so already."""
    if isinstance(v, np.ndarray) and v.dtype.kind == "f":
        return v
    return np.array([np.nan if x is None else x for x in v], float)


def metric_struct(samples, dt, metrics: list[str]) -> Column:
    """``struct`` with one field per trace metric, in one pass over Arrow batches."""
    schema = T.StructType([T.StructField(m, T.DoubleType()) for m in metrics])

    @F.pandas_udf(schema)
    def run(x: pd.Series, h: pd.Series) -> pd.DataFrame:
        rows = [{m: None for m in metrics} if a is None or not len(a) else {m: _number(TRACE_METRICS[m](_array(a), d)) for m in metrics} for a, d in zip(x, h)]
        return pd.DataFrame(rows, columns=metrics, dtype=float)

    return run(_c(samples), _c(dt))


def pair_struct(observed, synthetic, dt, metrics: list[str] | None = None) -> Column:
    """``struct`` with one field per pair metric."""
    names = list(PAIR_METRICS) if metrics is None else metrics
    schema = T.StructType([T.StructField(m, T.DoubleType()) for m in names])

    @F.pandas_udf(schema)
    def run(x: pd.Series, y: pd.Series, h: pd.Series) -> pd.DataFrame:
        rows = [{m: None if a is None or b is None or not len(a) or not len(b) else _number(PAIR_METRICS[m](_array(a), _array(b), d)) for m in names} for a, b, d in zip(x, y, h)]
        return pd.DataFrame(rows, columns=names, dtype=float)

    return run(_c(observed), _c(synthetic), _c(dt))


def spectrum_at(samples, dt, periods: list[float], metric: str = "PSA") -> Column:
    """``array<double>`` of PSA or FAS at the periods, NULL where undefined."""
    kernel = SPECTRAL_METRICS[metric]

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or not len(a) else [_number(v) for v in kernel(_array(a), d, periods)] for a, d in zip(x, h)])

    return run(_c(samples), _c(dt))


def _trace_udf(kernel) -> Callable[[pd.Series, pd.Series], pd.Series]:
    @F.pandas_udf("array<double>")
    def run(x: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else [_number(v) for v in kernel(_array(a), d)] for a, d in zip(x, h)])

    return run


def bandpassed(samples, dt, low_hz: float, high_hz: float) -> Column:
    """Band-passed trace with NULL at samples that the filter's ends make unsafe."""
    return _trace_udf(lambda a, d: np.where((r := K.bandpass(a, d, low_hz, high_hz))[1], r[0], np.nan))(_c(samples), _c(dt))


def lowpassed(samples, dt, cutoff_hz: float) -> Column:
    return _trace_udf(lambda a, d: K.lowpass(a, d, cutoff_hz))(_c(samples), _c(dt))


def resampled(samples, dt, target_hz: float) -> Column:
    return _trace_udf(lambda a, d: K.resample(a, d, target_hz))(_c(samples), _c(dt))


def integrated(samples, dt, times: int = 1) -> Column:
    return _trace_udf(lambda a, d: K.integrate(a, d, times))(_c(samples), _c(dt))


def period_spectrum(samples, dt) -> Column:
    """``array<struct<period, amplitude>>`` by rising period."""

    @F.pandas_udf("array<struct<period: double, amplitude: double>>")
    def run(x: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for a, d in zip(x, h):
            out.append(None if a is None or len(a) < 2 else [{"period": p, "amplitude": v} for p, v in zip(*(q.tolist() for q in K.period_spectrum(_array(a), d)))])
        return pd.Series(out)

    return run(_c(samples), _c(dt))


def spectrogram_rows(df: DataFrame, keys: list[str], samples: str, dt: str, nfft: int = 256, overlap: int = 192) -> DataFrame:
    """One row per trace, period and time with its power."""
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("period_s", T.DoubleType()), T.StructField("time_s", T.DoubleType()), T.StructField("power", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                if r[samples] is None or len(r[samples]) < 2:
                    continue
                f, t, p = K.spectrogram(_array(r[samples]), r[dt], nfft, overlap)
                f, p = f[1:], p[1:]
                yield pd.DataFrame({**{k: [r[k]] * p.size for k in keys}, "period_s": np.repeat(1 / f, len(t)), "time_s": np.tile(t, len(f)), "power": p.ravel()})

    return df.select(*keys, samples, dt).mapInPandas(run, schema)
