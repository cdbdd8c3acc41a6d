"""Column expressions that bring keys and labels into one spelling.

All of them give NULL for an absent value: NULL, blank, or one of the words of
``ABSENT_WORDS`` in any case.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for "nothing" in ids and labels.
ABSENT_WORDS = ("", "nan", "none", "null")
_BLANKS = " \t\r\n "


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(_BLANKS))


def _unless_absent(text: Column) -> Column:
    """The text, NULL where it is one of the absent words in any case. Evaluates ``text`` once."""
    return F.get(F.filter(F.array(text), lambda t: ~F.lower(t).isin(*ABSENT_WORDS)), F.lit(0))


def present(c: Column | str) -> Column:
    """The trimmed text, NULL where it is absent."""
    return _unless_absent(trimmed(c))


def lower_key(c: Column | str) -> Column:
    return _unless_absent(F.lower(trimmed(c)))


def upper_key(c: Column | str) -> Column:
    return _unless_absent(F.upper(trimmed(c)))


_NUMBER = r"0*([0-9]+(?:\.[0-9]*[1-9])?)\.?0*"
_BAND = rf"^{_NUMBER}\s*(?:-|_|:|to)\s*{_NUMBER}\s*(?:s|sec|secs|second|seconds)?$"


def band_key(c: Column | str) -> Column:
    """``1-2 sec`` for 1-2s, 1_2s, '1 - 2.0 SEC' and the like; any other label lower-cased."""
    return _unless_absent(F.regexp_replace(F.lower(trimmed(c)), _BAND, "$1-$2 sec"))


# Metrics that exist once per period.
PERIOD_METRICS = ("PSA", "FAS")
_STATED = r"^(" + "|".join(PERIOD_METRICS) + r")(?:[^A-Z0-9]+T?[^A-Z0-9]*([0-9]*\.?[0-9]+)[^0-9]*)?$"


def metric_key(c: Column | str) -> Column:
    """The metric's name in upper case with ``_`` as separator, without a period stated in it."""
    return _unless_absent(F.btrim(F.regexp_replace(F.regexp_replace(F.upper(trimmed(c)), _STATED, "$1"), "[^A-Z0-9]+", "_"), F.lit("_")))


def metric_period(metric: Column | str, period_s: Column | str) -> Column:
    """Seconds of a period metric: ``period_s`` if it is a positive number, else the one in the label."""
    p = finite(period_s)
    said = F.regexp_extract(F.upper(trimmed(metric)), _STATED, 2).try_cast("double")
    return F.coalesce(F.when(p > 0, p), F.when(said > 0, said))


def attribute_name(name: Column, period: Column) -> Column:
    """``PGA``, ``ARIAS_DURATION``, ``PSA@2.00`` from ``metric_key`` and ``metric_period``; NULL for a period metric without a period."""
    with_period = F.when(period.isNotNull(), F.concat(name, F.lit("@"), F.format_string("%.2f", period)))
    return F.when(name.isin(*PERIOD_METRICS), with_period).otherwise(name)


def finite(c: Column | str) -> Column:
    """The number, NULL for NaN and the infinities."""
    c = _col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def label_core(c: Column | str) -> Column:
    """Letters and digits of a present label in lower case: separators and blanks make no difference."""
    return _unless_absent(F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}]+", ""))


# The area of usable positions and the largest usable residual, as TESTDATA.md states them.
USABLE_LAT, USABLE_LON, USABLE_RESIDUAL = (32.0, 36.0), (-121.0, -114.0), 64.0


def usable_position(lat: Column | str, lon: Column | str) -> Column:
    return F.coalesce(finite(lat).between(*USABLE_LAT) & finite(lon).between(*USABLE_LON), F.lit(False))


def usable_residual(c: Column | str = "log2_residual") -> Column:
    v = finite(c)
    return F.when(F.abs(v) <= USABLE_RESIDUAL, v)
