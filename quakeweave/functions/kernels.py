"""Signal kernels on NumPy arrays: filters, integrals, spectra, durations, correlations.

A kernel takes one trace (1-D) or, where stated, a stack of equally long traces (2-D, one
per row). ``dt`` is the sample interval in seconds. Undefined results are NaN, which the
Spark wrappers turn into NULL.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np

# Gravity in cm/s2 as used in Arias intensity, damping of response spectra, order of filters.
GRAVITY = 981.0
DAMPING = 0.05
FILTER_ORDER = 4


def clean(x) -> np.ndarray:
    return np.nan_to_num(np.asarray(x, float), nan=0.0, posinf=0.0, neginf=0.0)


# ---------------------------------------------------------------- filters


def butterworth(order: int, cutoff, dt: float, kind: str) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a digital Butterworth filter.

    ``kind`` is low, high or band (two cutoffs, in Hz). Analogue poles are placed on the
    circle, shifted to the band and mapped by the bilinear transform with prewarping.
    """
    nyquist = 0.5 / dt
    edges = np.atleast_1d(np.asarray(cutoff, float))
    if len(edges) != (2 if kind == "band" else 1) or (edges <= 0).any() or (edges >= nyquist).any() or (np.diff(edges) <= 0).any():
        raise ValueError("cutoffs must rise and lie between 0 and the Nyquist frequency")
    fs2 = 2.0 / dt
    warped = fs2 * np.tan(np.pi * edges * dt)
    k = np.arange(1, order + 1)
    poles = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    if kind == "low":
        poles, zeros = poles * warped[0], np.array([])
    elif kind == "high":
        poles, zeros = warped[0] / poles, np.zeros(order)
    else:
        width, centre2 = warped[1] - warped[0], warped[0] * warped[1]
        half = poles * width / 2
        root = np.sqrt(half**2 - centre2)
        poles, zeros = np.r_[half + root, half - root], np.zeros(order)
    z, p = (fs2 + zeros) / (fs2 - zeros), (fs2 + poles) / (fs2 - poles)
    z = np.r_[z, -np.ones(len(p) - len(z))]
    # Conjugate pairs first by frequency; real poles are paired with each other.
    upper = sorted(p[p.imag > 1e-12], key=lambda v: abs(np.angle(v)))
    real = sorted(p[np.abs(p.imag) <= 1e-12].real)
    z = sorted(z.real)
    sections = []
    for v in upper:
        sections.append(np.r_[np.poly([z.pop(0), z.pop()]) if len(z) > 1 else np.poly(z), 1.0, -2 * v.real, abs(v) ** 2])
    while real:
        a = [real.pop()] + ([real.pop()] if real else [])
        b = [z.pop() for _ in a]
        sections.append(np.r_[np.r_[np.poly(b), np.zeros(2 - len(b))], np.r_[np.poly(a), np.zeros(2 - len(a))]])
    sos = np.array(sections)
    # Unit gain in the middle of the passband.
    at = {"low": 0.0, "high": nyquist, "band": np.arctan(np.sqrt(warped[0] * warped[-1]) / fs2) / (np.pi * dt)}[kind]
    w = np.exp(-1j * 2 * np.pi * at * dt * np.arange(3))
    sos[0, :3] /= abs(np.prod((sos[:, :3] @ w) / (sos[:, 3:] @ w)))
    return sos


def frequency_response(sos: np.ndarray, freq: np.ndarray, dt: float) -> np.ndarray:
    w = np.exp(-2j * np.pi * np.outer(np.arange(3), np.asarray(freq) * dt))
    return np.prod((sos[:, :3] @ w) / (sos[:, 3:] @ w), axis=0)


def _steady_state(sos: np.ndarray) -> np.ndarray:
    """State of each section in which a constant input of 1 gives a constant output."""
    state, level = np.zeros((len(sos), 2)), 1.0
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        state[k] = [(gain - b0) * level, (b2 - a2 * gain) * level]
        level *= gain
    return state


def run_sections(sos: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """Filter a stack of traces (rows) sample by sample, all rows at once."""
    y = np.array(x, float, ndmin=2)
    first = y[:, :1].copy()
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        s1 = np.zeros(len(y)) if state is None else state[k, 0] * first[:, 0]
        s2 = np.zeros(len(y)) if state is None else state[k, 1] * first[:, 0]
        out = np.empty_like(y)
        for n in range(y.shape[1]):
            v = y[:, n]
            w = b0 * v + s1
            s1 = b1 * v - a1 * w + s2
            s2 = b2 * v - a2 * w
            out[:, n] = w
        y = out
    return y if np.ndim(x) == 2 else y[0]


def zero_phase(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward over traces extended by their mirror image; short traces pass once."""
    y = np.array(x, float, ndmin=2)
    sections = len(sos)
    pad = 3 * (2 * sections + 1 - min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum()))
    if y.shape[1] <= pad:
        out = run_sections(sos, y)
    else:
        ext = np.concatenate([2 * y[:, :1] - y[:, pad:0:-1], y, 2 * y[:, -1:] - y[:, -2 : -pad - 2 : -1]], axis=1)
        state = _steady_state(sos)
        there = run_sections(sos, ext, state)
        out = run_sections(sos, there[:, ::-1], state)[:, ::-1][:, pad : pad + y.shape[1]]
    return out if np.ndim(x) == 2 else out[0]


def detrend(x: np.ndarray) -> np.ndarray:
    """Less the least-squares line; of a trace or a stack of traces."""
    x = np.asarray(x, float)
    n = x.shape[-1]
    if n < 2:
        return x - x.mean(-1, keepdims=True) if n else x
    t = np.arange(n) - (n - 1) / 2
    return x - x.mean(-1, keepdims=True) - (x @ t)[..., None] * t / (t @ t)


def edge_mask(n: int, fraction: float = 0.05) -> np.ndarray:
    """True except for ``fraction`` of the samples at both ends."""
    m = int(np.floor(n * fraction))
    out = np.ones(n, bool)
    out[:m] = False
    out[n - m :] = False
    return out


def bandpass(x, dt: float, low_hz: float, high_hz: float, order: int = FILTER_ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Zero-phase band-passed trace (or stack), and the mask of its valid samples (finite, not within 5 % of an end)."""
    x = np.asarray(x, float)
    y = zero_phase(butterworth(order, (low_hz, high_hz), dt, "band"), detrend(clean(x)))
    return y, np.isfinite(x) & edge_mask(x.shape[-1])


def lowpass(x, dt: float, cutoff_hz: float | None, order: int = FILTER_ORDER) -> np.ndarray:
    if not cutoff_hz or cutoff_hz <= 0:
        return np.array(x, float)
    return zero_phase(butterworth(order, cutoff_hz, dt, "low"), clean(x))


def highpass(x, dt: float, cutoff_hz: float, order: int = FILTER_ORDER) -> np.ndarray:
    return zero_phase(butterworth(order, cutoff_hz, dt, "high"), clean(x))


def resample(x, dt: float, target_hz: float) -> np.ndarray:
    """To another rate by a windowed-sinc filter at a rational factor (denominator at most 1000)."""
    x = np.asarray(x, float)
    ratio = Fraction(target_hz * dt).limit_denominator(1000)
    up, down = ratio.numerator, ratio.denominator
    if up == down or not len(x):
        return x.copy()
    wide = max(up, down)
    half = 10 * wide
    t = np.arange(-half, half + 1)
    h = np.sinc(t / wide) * np.kaiser(2 * half + 1, 5.0)
    h *= up / h.sum()
    full = np.zeros(len(x) * up)
    full[::up] = x
    return np.convolve(full, h)[half : half + len(full)][::down]


def preprocess(x, dt: float, *, lowpass_hz=None, highpass_hz=None, band=None, resample_hz=None, order: int = FILTER_ORDER) -> tuple[np.ndarray, float]:
    """Band-pass, or high- then low-pass, then resampling; the trace and its interval.

    Traces of fewer than max(8, 3 * order) samples are not filtered.
    """
    if band is not None and (lowpass_hz or highpass_hz):
        raise ValueError("a band excludes single cutoffs")
    y = np.asarray(x, float)
    if (band is not None or lowpass_hz or highpass_hz) and len(y) >= max(8, 3 * order):
        y = np.where(np.isfinite(y), y, np.median(y[np.isfinite(y)]) if np.isfinite(y).any() else 0.0)
        y = y - y.mean()
        for cutoff, kind in ((band, "band"), (highpass_hz, "high"), (lowpass_hz, "low")):
            if cutoff:
                y = zero_phase(butterworth(order, cutoff, dt, kind), y)
    if resample_hz and abs(1 / dt - resample_hz) > 1e-12:
        y, dt = resample(y, dt, resample_hz), 1 / resample_hz
    return y, dt


# ---------------------------------------------------------------- integrals, peaks, durations


def cumulative_trapezoid(y, dt: float) -> np.ndarray:
    y = np.asarray(y, float)
    return np.r_[0.0, np.cumsum((y[1:] + y[:-1]) * dt / 2)] if len(y) else np.zeros(0)


def trapezoid(y, dt: float) -> float:
    y = np.asarray(y, float)
    return float((y.sum() - (y[0] + y[-1]) / 2) * dt) if len(y) else 0.0


def integrate(x, dt: float, times: int = 1, fmin: float | None = None) -> np.ndarray:
    """Integrate in the frequency domain: padded, without mean, frequencies below ``fmin`` left out."""
    x = clean(x)
    n = len(x)
    if not n:
        return x
    pad = n if not fmin else min(2 * n, max(n, int(np.ceil(4 / (fmin * dt)))))
    f = np.fft.rfftfreq(n + pad, dt)
    spec = np.fft.rfft(x - x.mean(), n + pad)
    use = f > 0 if not fmin else f >= fmin
    spec = np.where(use, spec, 0)
    spec[use] /= (2j * np.pi * f[use]) ** times
    return np.fft.irfft(spec, n + pad)[:n]


def peak(x, edge: float = 0.01) -> float:
    """Greatest absolute value without ``edge`` of the samples at both ends; 0 if there are none."""
    x = clean(x)
    m = int(len(x) * edge)
    x = x[m : len(x) - m] if len(x) > 2 * m else x
    return float(np.abs(x).max()) if len(x) else 0.0


def pga(x, dt=None, edge: float = 0.01) -> float:
    return peak(x, edge)


def pgv(x, dt: float, fmin=None, edge: float = 0.01) -> float:
    return peak(integrate(x, dt, 1, fmin), edge)


def pgd(x, dt: float, fmin=None, edge: float = 0.01) -> float:
    return peak(integrate(x, dt, 2, fmin), edge)


def arias_intensity(x, dt: float) -> float:
    return np.pi / (2 * GRAVITY) * trapezoid(clean(x) ** 2, dt)


def energy_intensity(x, dt: float, fmin=None) -> float:
    return trapezoid(integrate(x, dt, 1, fmin) ** 2, dt)


def significant_duration(power: np.ndarray, dt: float, low: float = 0.05, high: float = 0.95) -> float:
    """Time in which the cumulative integral of ``power`` goes from ``low`` to ``high`` of its total."""
    c = cumulative_trapezoid(power, dt)
    if len(c) < 2 or not c[-1] > 0:
        return float("nan")
    a, b = np.interp([low, high], c / c[-1], np.arange(len(c)) * dt)
    return float(b - a)


def arias_duration(x, dt: float) -> float:
    return significant_duration(clean(x) ** 2, dt)


def energy_duration(x, dt: float, fmin=None) -> float:
    return significant_duration(integrate(x, dt, 1, fmin) ** 2, dt)


def simpson(y, dt: float) -> float:
    """Composite Simpson; for an even number of samples the last interval uses a parabola through three points."""
    y = np.asarray(y, float)
    n = len(y)
    if n < 2:
        return 0.0
    if n == 2:
        return float((y[0] + y[1]) * dt / 2)
    m = n if n % 2 else n - 1
    total = (y[0] + y[m - 1] + 4 * y[1 : m - 1 : 2].sum() + 2 * y[2 : m - 2 : 2].sum()) * dt / 3
    if m < n:
        total += dt * (5 * y[-1] + 8 * y[-2] - y[-3]) / 12
    return float(total)


def cav(x, dt: float, window: tuple[float, float] | None = None) -> float:
    """Integral of the absolute value, over a window of seconds if one is given; NaN if that leaves the trace."""
    a = np.abs(clean(x))
    if window is None:
        return simpson(a, dt)
    start, stop = window
    end = (len(a) - 1) * dt
    if not 0 <= start < stop <= end + 1e-12:
        return float("nan")
    t = np.arange(len(a)) * dt
    inner = (t > start) & (t < stop)
    times = np.r_[start, t[inner], stop]
    return float(np.trapezoid(np.interp(times, t, a), times))


# ---------------------------------------------------------------- spectra


def response_spectrum(x, dt: float, periods, damping: float = DAMPING) -> np.ndarray:
    """Pseudo-acceleration by the average-acceleration step, for all periods (and all traces of a stack) at once.

    One step is a fixed 3 x 3 matrix on (displacement, velocity, acceleration), so the
    recurrence runs over time for all oscillators together. NaN for periods not above 0.
    """
    x = clean(x)
    t = np.asarray(periods, float)
    ok = np.isfinite(t) & (t > 0)
    w = 2 * np.pi / np.where(ok, t, 1.0)
    shape = (*x.shape[:-1], len(t))
    if not x.shape[-1] or dt <= 0 or not ok.any():
        return np.full(shape, np.nan)
    # From u' = u + h v + h2/4 (a + a'), v' = v + h/2 (a + a') and a' = -g - 2 z w v' - w2 u'.
    h, z = dt, damping
    m = 1 + z * w * h + (w * h) ** 2 / 4
    au, av, aa = -(w**2) / m, -(2 * z * w + w**2 * h) / m, -(z * w * h + (w * h) ** 2 / 4) / m
    u = v = a = most = np.zeros(shape)
    for g in np.moveaxis(x, -1, 0):
        new = au * u + av * v + aa * a - g[..., None] / m
        u = u + h * v + h * h / 4 * (a + new)
        v = v + h / 2 * (a + new)
        a = new
        most = np.maximum(most, np.abs(u))
    return np.where(ok, w**2 * most, np.nan)


def fourier_spectrum(x, dt: float, hann: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """One-sided amplitude spectrum in units times seconds, corrected for the window's mean."""
    x = np.asarray(x, float)
    n = len(x)
    if n == 0 or dt <= 0:
        return np.zeros(1), np.zeros(1)
    x = x - np.nanmean(x)
    w = np.hanning(n) if hann else np.ones(n)
    amp = dt * np.abs(np.fft.rfft(x * w)) / (w.mean() if w.any() else 1.0)
    amp[1:-1] *= 2
    return np.fft.rfftfreq(n, dt), clean(amp)


def fas(x, dt: float, periods, hann: bool = True) -> np.ndarray:
    """Fourier amplitude at periods; NaN outside the spectrum."""
    f, a = fourier_spectrum(x, dt, hann)
    t = np.asarray(periods, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        want = 1 / t
    ok = np.isfinite(want) & (t > 0) & (want >= f[0]) & (want <= f[-1])
    return np.where(ok, np.interp(np.where(ok, want, 0), f, a), np.nan)


def plain_spectrum(x, dt: float) -> tuple[np.ndarray, np.ndarray]:
    x = np.asarray(x, float)
    if x.ndim != 1 or dt <= 0:
        raise ValueError("one trace and a positive interval are needed")
    return np.fft.rfftfreq(len(x), dt), np.abs(np.fft.rfft(x)) / max(1, len(x))


def period_spectrum(x, dt: float) -> tuple[np.ndarray, np.ndarray]:
    """Amplitudes by rising period, without the mean."""
    x = np.asarray(x, float)
    f = np.fft.rfftfreq(len(x), dt)[1:]
    return (1 / f)[::-1], np.abs(np.fft.rfft(x))[1:][::-1]


def at_periods(periods, amplitudes, wanted) -> np.ndarray:
    p, a = np.asarray(periods, float), np.asarray(amplitudes, float)
    order = np.argsort(p)
    return np.interp(np.asarray(wanted, float), p[order], a[order], left=np.nan, right=np.nan) if len(p) else np.full(len(wanted), np.nan)


def spectrogram(x, dt: float, nfft: int = 256, overlap: int = 192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies, times and power density of overlapping Hann-windowed segments without mean."""
    x = clean(x)
    nfft = min(nfft, len(x))
    if nfft < 2:
        return np.zeros(0), np.zeros(0), np.zeros((0, 0))
    step = max(1, nfft - min(overlap, nfft - 1))
    seg = np.lib.stride_tricks.sliding_window_view(x, nfft)[::step]
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nfft) / nfft)
    power = np.abs(np.fft.rfft((seg - seg.mean(1, keepdims=True)) * w)) ** 2 * dt / (w**2).sum()
    power[:, 1 : -1 if nfft % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(nfft, dt), (np.arange(len(seg)) * step + nfft / 2) * dt, power.T


def log_mean(values) -> float:
    v = np.asarray(values, float)
    v = v[np.isfinite(v) & (v > 0)]
    return float(np.exp(np.log(v).mean())) if len(v) else float("nan")


# ---------------------------------------------------------------- pairs of traces


def correlation(x, y) -> float:
    """Normalised product of the common part at zero lag; NaN if one is all zero."""
    n = min(len(x), len(y))
    x, y = clean(x)[:n], clean(y)[:n]
    norm = np.sqrt((x @ x) * (y @ y))
    return float(x @ y / norm) if norm > 0 else float("nan")


def best_lag(x, y, dt: float, max_lag_s: float | None = None) -> tuple[float, float]:
    """Lag of the second trace behind the first (s) with the greatest correlation, and that correlation."""
    x, y = clean(x), clean(y)
    norm = np.sqrt((x @ x) * (y @ y))
    if not len(x) or not len(y) or not norm > 0:
        return float("nan"), float("nan")
    n = len(x) + len(y) - 1
    size = 1 << (n - 1).bit_length()
    r = np.fft.irfft(np.fft.rfft(y, size) * np.conj(np.fft.rfft(x, size)), size)
    lag = np.r_[np.arange(len(y)), np.arange(-(len(x) - 1), 0)]
    r = np.r_[r[: len(y)], r[size - (len(x) - 1) :]]
    if max_lag_s is not None:
        keep = np.abs(lag) * dt <= max_lag_s + 1e-12
        lag, r = lag[keep], r[keep]
    # Of equal peaks the one with the smallest shift.
    best = max(np.flatnonzero(r >= r.max() - 1e-12 * abs(r.max())), key=lambda k: (-abs(lag[k]), -lag[k]))
    return float(lag[best] * dt), float(r[best] / norm)


def traveltime_delay(observed, synthetic, dt: float, max_lag_s: float | None = None) -> float:
    """Shift in seconds that brings the synthetic onto the observed trace."""
    return -best_lag(observed, synthetic, dt, max_lag_s)[0]


def shifted_correlation(observed, synthetic, dt: float, delay_s: float) -> float:
    """Correlation after the synthetic is shifted by ``delay_s``, over the samples both then have (three at least)."""
    x, y = clean(observed), clean(synthetic)
    t = np.arange(len(x)) * dt
    at = t - delay_s
    ok = (at >= 0) & (at <= (len(y) - 1) * dt + 1e-12)
    if ok.sum() < 3:
        return float("nan")
    return correlation(x[ok], np.interp(at[ok], np.arange(len(y)) * dt, y))


def delay_corrected_cc(observed, synthetic, dt: float, delay_s: float | None = None, max_lag_s: float | None = None) -> float:
    d = traveltime_delay(observed, synthetic, dt, max_lag_s) if delay_s is None else delay_s
    return shifted_correlation(observed, synthetic, dt, d) if np.isfinite(d) else float("nan")


# ---------------------------------------------------------------- quality windows


def smooth_abs(x, dt: float, seconds: float = 0.5) -> np.ndarray:
    """Moving average of the absolute value, zeros beyond the ends."""
    w = max(3, int(round(seconds / dt)))
    return np.convolve(np.abs(clean(x)), np.ones(w) / w, mode="same")


def onset_threshold(envelope, times) -> float:
    """The larger of 5 % of the peak after the origin and median plus five deviations before it."""
    e, t = np.asarray(envelope, float), np.asarray(times, float)
    after, before = e[t >= 0], e[t < 0]
    top = 0.05 * after.max() if len(after) else 0.0
    if not len(before):
        return float(top)
    middle = np.median(before)
    return float(max(top, middle + 5 * np.median(np.abs(before - middle))))


def window_rms(x, times, start: float, stop: float) -> float:
    """Root mean square of the samples in a closed window; NaN for fewer than three."""
    t = np.asarray(times, float)
    own = np.asarray(x, float)[(t >= start) & (t <= stop)]
    return float(np.sqrt((own**2).mean())) if len(own) >= 3 else float("nan")


def dominant_band(freq, power, bands: list[tuple[str, float, float]]) -> tuple[str | None, dict[str, float]]:
    """The band with most power, and each band's share of all of them."""
    f, p = np.asarray(freq, float), np.asarray(power, float)
    sums = {name: float(p[(f >= lo) & (f < hi)].sum()) for name, lo, hi in bands}
    total = sum(sums.values())
    if not total > 0:
        return None, dict.fromkeys(sums, float("nan"))
    return max(sums, key=sums.get), {k: v / total for k, v in sums.items()}


def relative_amplitude_mask(periods, amplitudes, threshold: float = 0.25, low: float | None = None, high: float | None = None) -> np.ndarray:
    """Periods within bounds whose amplitude reaches ``threshold`` of the greatest within them."""
    p, a = np.asarray(periods, float), np.asarray(amplitudes, float)
    ok = np.isfinite(p) & np.isfinite(a) & (p > 0)
    if low is not None:
        ok &= p >= low
    if high is not None:
        ok &= p <= high
    return ok & (a >= threshold * a[ok].max()) if ok.any() else ok


def support_bounds(npts: int, dt: float, min_cycles: float = 3.0, fmax: float | None = None) -> tuple[float, float]:
    """Shortest and longest period a record can tell of."""
    return max(2 * dt, 1 / fmax if fmax and fmax > 0 else 0.0), npts * dt / min_cycles
