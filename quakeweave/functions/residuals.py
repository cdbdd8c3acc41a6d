"""Comparison of observed and synthetic values as column expressions.

NULL stands for every undefined result; NaN and the infinities count as NULL. Three sign and
base conventions exist side by side and are kept apart by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeweave.functions.labels import finite

# Names of the transforms, and other names that are understood.
TRANSFORMS = ("residual", "log2_residual", "ln_residual", "anderson_2004_gof", "olsen_mayhew_gof")
TRANSFORM_ALIASES = {"olsen_2011": "olsen_mayhew_gof", "olsen_mayhew_2011_gof": "olsen_mayhew_gof", "anderson_gof": "anderson_2004_gof"}


def _both(obs, syn) -> tuple[Column, Column]:
    return finite(obs), finite(syn)


def residual(obs, syn) -> Column:
    o, s = _both(obs, syn)
    return o - s


def log2_residual(obs, syn) -> Column:
    o, s = _both(obs, syn)
    return F.log2(F.when((o > 0) & (s > 0), o / s))


def ln_residual(obs, syn) -> Column:
    o, s = _both(obs, syn)
    return F.ln(F.when((o > 0) & (s > 0), o / s))


def _relative_gap(o: Column, s: Column) -> Column:
    """Difference over the smaller value, for two positive values."""
    return F.when((o > 0) & (s > 0), (o - s) / F.least(o, s))


def anderson_2004_gof(obs, syn) -> Column:
    o, s = _both(obs, syn)
    return 10 * F.exp(-F.pow(_relative_gap(o, s), F.lit(2)))


# Coefficients of W. J. Cody's rational approximations of erf and erfc (1969), highest power first.
_ERF_NUM = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
_ERF_DEN = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
_ERFC_NUM = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
_ERFC_DEN = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862021514e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def erfc(x: Column) -> Column:
    """Complementary error function to about 15 digits for |x| <= 4, and to 1e-8 of absolute error beyond."""
    y = F.abs(x)
    small = 1 - x * _polynomial(_ERF_NUM, x * x) / _polynomial(_ERF_DEN, x * x)
    large = F.exp(-y * y) * _polynomial(_ERFC_NUM, F.least(y, F.lit(26.0))) / _polynomial(_ERFC_DEN, F.least(y, F.lit(26.0)))
    return F.when(y <= 0.46875, small).when(x < 0, 2 - large).otherwise(large)


def olsen_mayhew_gof(obs, syn) -> Column:
    o, s = _both(obs, syn)
    return 100 * erfc(F.abs(F.when(o + s != 0, 2 * (o - s) / (o + s))))


def decay_score(a, b) -> Column:
    """10, halved for each relative difference of 1; 0 where a value is not positive."""
    o, s = _both(a, b)
    return F.coalesce(10 * F.pow(F.lit(0.5), F.abs(_relative_gap(o, s))), F.when(o.isNotNull() & s.isNotNull(), F.lit(0.0)))


def anderson_score(a, b) -> Column:
    """As ``anderson_2004_gof`` but 0 where a value is not positive."""
    o, s = _both(a, b)
    return F.coalesce(anderson_2004_gof(o, s), F.when(o.isNotNull() & s.isNotNull(), F.lit(0.0)))


def score(a, b, scoring: str = "decay") -> Column:
    if scoring not in ("decay", "anderson"):
        raise ValueError("scoring is decay or anderson")
    return decay_score(a, b) if scoring == "decay" else anderson_score(a, b)


def pair_residuals(obs, syn) -> tuple[Column, Column]:
    """The pair kernel's convention: synthetic less observed, and log2 of synthetic over observed."""
    return residual(syn, obs), log2_residual(syn, obs)


def wide_residual(obs, syn, mode: str = "logratio") -> Column:
    """The wide tables' convention: log10 of synthetic over observed, or synthetic less observed."""
    if mode not in ("logratio", "difference"):
        raise ValueError("mode is logratio or difference")
    o, s = _both(obs, syn)
    return F.log10(F.when((o > 0) & (s > 0), s / o)) if mode == "logratio" else s - o


def transform_names(transforms=None) -> list[str]:
    """Transform names with aliases resolved, in the given order, without repeats; unknown ones raise ValueError."""
    out: list[str] = []
    for t in TRANSFORMS if transforms is None else ([transforms] if isinstance(transforms, str) else transforms):
        name = TRANSFORM_ALIASES.get(str(t).strip(), str(t).strip())
        if name not in TRANSFORMS:
            raise ValueError(f"unknown transform {t}")
        if name not in out:
            out.append(name)
    return out


def add_transforms(df: DataFrame, obs: str = "value_obs", syn: str = "value_syn", transforms=None) -> DataFrame:
    """The selected transforms as columns; those not selected are NULL, so that the columns are always the same."""
    chosen = transform_names(transforms)
    make = {f.__name__: f for f in (residual, log2_residual, ln_residual, anderson_2004_gof, olsen_mayhew_gof)}
    return df.withColumns({t: make[t](obs, syn) if t in chosen else F.lit(None).cast("double") for t in TRANSFORMS})


def percent_from_log2(effect) -> Column:
    return (F.pow(F.lit(2.0), finite(effect)) - 1) * 100


def amplitude_ratio(obs, syn) -> Column:
    """Observed over synthetic; NULL where the synthetic is practically 0."""
    o, s = _both(obs, syn)
    return F.when(F.abs(s) > 1e-12, o / s)
