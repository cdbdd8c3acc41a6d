"""Scalar functions on labels, codes, passbands and times, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quakeweave.functions.labels import finite, present, trimmed


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Metrics by group, and the names of older tables.
METRIC_GROUPS = {
    "duration": ("arias_duration", "energy_duration"),
    "amplitude": ("PGA", "PGV", "PGD"),
    "spectral": ("PSA", "FAS"),
    "intensity": ("arias_intensity", "energy_intensity", "CAV"),
    "delay": ("traveltime_delay",),
    "cross_correlation": ("original_cc", "delay_corrected_cc"),
}
OLD_METRIC_NAMES = {
    "C1": "arias_duration",
    "C2": "energy_duration",
    "C3": "arias_intensity",
    "C4": "energy_intensity",
    "C5": "PGA",
    "C6": "PGV",
    "C7": "PGD",
    "C8": "PSA",
    "C9": "FAS",
    "C10": "original_cc",
    "C11": "traveltime_delay",
    "C12": "delay_corrected_cc",
    "C13": "CAV",
}


def _lookup(c: Column, table: dict[str, str]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(m, c)


def public_metric_name(metric) -> Column:
    """``C5`` -> ``PGA``; other names as they are, trimmed."""
    t = trimmed(_c(metric))
    return F.coalesce(_lookup(F.upper(t), OLD_METRIC_NAMES), t)


def metric_group_of(metric) -> Column:
    groups = {m: g for g, ms in METRIC_GROUPS.items() for m in ms}
    return _lookup(public_metric_name(metric), groups)


def token(c, *, keep: str = "A-Za-z0-9._=-", blank: str = "unknown", lower: bool = False) -> Column:
    """A text as part of a file or column name: other characters become one ``_``."""
    t = F.lower(trimmed(_c(c))) if lower else trimmed(_c(c))
    t = F.btrim(F.regexp_replace(t, f"[^{keep}]+", "_"), F.lit("_"))
    return F.when(F.length(t) > 0, t).otherwise(F.lit(blank))


def name_token(c) -> Column:
    return token(c, keep="a-z0-9", blank="unnamed", lower=True)


def slug(c, max_length: int = 96) -> Column:
    return F.btrim(F.left(name_token(c), F.lit(max_length)), F.lit("_"))


def number_text(c) -> Column:
    """A number without needless digits: ``1.0`` -> ``1``."""
    return F.regexp_replace(_c(c).cast("string"), r"\.0$", "")


def passband_sec(c) -> Column:
    """A label with its unit written ``sec``: ``1-2 seconds`` and ``1-2s`` -> ``1-2 sec``; ``raw`` stays."""
    t = trimmed(_c(c))
    return F.when(F.lower(t) == "raw", F.lit("raw")).otherwise(F.concat(F.regexp_replace(t, r"(?i)\s*(?:seconds|sec|s)\s*$", ""), F.lit(" sec")))


def period_band_label(low, high) -> Column:
    """``a-bs`` if 0 < a < b."""
    a, b = finite(low), finite(high)
    return F.when((a > 0) & (a < b), F.concat(number_text(a), F.lit("-"), number_text(b), F.lit("s")))


def period_range(label) -> Column:
    """``struct<low, high>`` of the first two numbers of a band label, NULL unless 0 < low < high."""
    n = F.regexp_extract_all(_c(label), F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    low, high = F.get(n, F.lit(0)).try_cast("double"), F.get(n, F.lit(1)).try_cast("double")
    return F.when((low > 0) & (low < high), F.struct(low.alias("low"), high.alias("high")))


def band_column_key(label) -> Column:
    """``1.5-3 sec`` -> ``1p5_3s``."""
    r = period_range(label)
    part = lambda c: F.replace(number_text(c), F.lit("."), F.lit("p"))
    return F.concat(part(r["low"]), F.lit("_"), part(r["high"]), F.lit("s"))


def band_from_column_key(key) -> Column:
    """``1p5_3s`` -> ``1.5-3s``."""
    t = trimmed(_c(key))
    a, b = (F.replace(F.regexp_extract(t, r"^([0-9p]+)_([0-9p]+)s$", k), F.lit("p"), F.lit(".")) for k in (1, 2))
    return F.when(t.rlike(r"^[0-9p]+_[0-9p]+s$"), F.concat(a, F.lit("-"), b, F.lit("s")))


def band_display(label) -> Column:
    """``1-2s`` and ``1_2`` -> ``1-2 sec``; blank and ``all`` -> ``All periods``."""
    t = present(_c(label))
    n = r"(?i)^([0-9.]+)\s*[-_]\s*([0-9.]+)\s*(?:s|sec|seconds)?$"
    return F.when(t.isNull() | (F.lower(t) == "all"), F.lit("All periods")).otherwise(F.regexp_replace(t, n, "$1-$2 sec"))


def metric_display(metric, period=None) -> Column:
    name = public_metric_name(metric)
    shown = F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
    shown = F.when(name.rlike("^[A-Z]+$"), name).otherwise(shown)
    if period is None:
        return shown
    p = finite(period)
    return F.when(name.isin("PSA", "FAS") & p.isNotNull(), F.concat(name, F.lit(" T="), number_text(p), F.lit(" s"))).otherwise(shown)


def parent_folder(path) -> Column:
    """The name of the folder that holds a file."""
    p = F.split(_c(path), "/")
    return F.when(F.size(p) >= 2, F.get(p, F.size(p) - 2))


def station_code(c) -> Column:
    """The last part of a dotted code, upper case."""
    return F.upper(F.element_at(F.split(present(_c(c)), r"\."), -1))


def truthy(c) -> Column:
    return F.coalesce(F.lower(trimmed(_c(c).cast("string"))).isin("1", "true", "yes", "y", "reject", "rejected"), F.lit(False))


def qc_status(c) -> Column:
    """``pass`` or ``fail`` for the usual words, blank counting as pass; other words as they are."""
    t = F.lower(trimmed(F.coalesce(_c(c).cast("string"), F.lit(""))))
    return (
        F.when((t == "") | t.isin("nan", "none", "null"), F.lit("pass"))
        .when(t.isin("false", "0") | t.startswith("reject") | t.startswith("fail"), F.lit("fail"))
        .when(t.isin("true", "1", "ok") | t.startswith("accept") | t.startswith("pass"), F.lit("pass"))
        .otherwise(t)
    )


def station_family(network, station) -> Column:
    """``broadband``, ``strong_motion`` or ``unknown`` from the letters and digits of a code."""
    code = F.regexp_replace(F.coalesce(station_code(station), F.lit("")), r"[^\p{L}\p{N}]", "")
    letters, digits = F.length(F.regexp_replace(code, r"[^\p{L}]", "")), F.length(F.regexp_replace(code, r"[^\p{N}]", ""))
    broad, strong = F.lit("broadband"), F.lit("strong_motion")
    return (
        F.when(F.length(code) == 0, F.lit("unknown"))
        .when(code.rlike(r"^\p{L}{2}"), broad)
        .when(F.upper(trimmed(_c(network))) == "CE", strong)
        .when(digits > letters, strong)
        .when(F.length(code).between(3, 4) & (letters >= F.greatest(F.lit(1), digits)), broad)
        .when(letters == 0, strong)
        .otherwise(broad)
    )


def distinct_reasons(reasons: Column) -> Column:
    """Reasons of an array in order, without blanks and repeats."""
    return F.array_distinct(F.filter(F.transform(reasons, lambda r: F.trim(r)), lambda r: F.length(r) > 0))


def sample_interval(dt_obs, rate_obs, dt_syn, rate_syn) -> Column:
    """The first positive interval or inverse rate, observed side first."""
    inverse = lambda r: F.when(finite(r) > 0, 1 / finite(r))
    known = lambda d: F.when(finite(d) > 0, finite(d))
    return F.coalesce(known(dt_obs), inverse(rate_obs), known(dt_syn), inverse(rate_syn))


def seconds_between(later, earlier) -> Column:
    return (F.unix_micros(_c(later)) - F.unix_micros(_c(earlier))) / F.lit(1e6)


def record_length_s(npts, rate, start, end) -> Column:
    """Samples over rate, else the time between start and end."""
    n, r = finite(npts), finite(rate)
    return F.coalesce(F.when((n > 0) & (r > 0), n / r), seconds_between(end, start))


def origin_time(*candidates) -> Column:
    """The first candidate that reads as a time."""
    return F.coalesce(*[F.try_to_timestamp(trimmed(_c(c).cast("string"))) for c in candidates])


def task_id(*parts) -> Column:
    """``metric-`` and 12 hex digits of the SHA-1 of the parts joined by ``|``."""
    return F.concat(F.lit("metric-"), F.left(F.sha1(F.concat_ws("|", *[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts])), F.lit(12)))


def stable_hash(columns: list[str], length: int | None = None) -> Column:
    """SHA-256 of the columns as JSON, sorted by name."""
    digest = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    return digest if length is None else F.left(digest, F.lit(length))


def members(c) -> Column:
    """The lower-case members of a text with ``;``, ``,`` or ``|`` between them."""
    return F.filter(F.transform(F.split(F.coalesce(_c(c), F.lit("")), "[;,|]"), lambda x: F.lower(F.trim(x))), lambda x: ~x.isin("", "nan", "none", "null"))


def has_member(c, wanted: list[str]) -> Column:
    """Whether a delimited text holds any of the wanted values; any at all if none are named."""
    own = members(c)
    return F.size(own) > 0 if not wanted else F.arrays_overlap(own, F.array(*[F.lit(w.strip().lower()) for w in wanted]))


def model_basin_scope(folder) -> Column:
    """Base model and scope words in a folder's name, joined by ``+``."""
    t = F.lower(_c(folder))
    words = F.array(*[F.when(t.contains(w.lower()), F.lit(w)) for w in ("LABonly", "SI", "Ely")])
    return F.array_join(F.array_compact(words), "+")
