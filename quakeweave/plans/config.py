"""Settings: files, scenarios, named areas, output paths, metric plans."""

from __future__ import annotations

import copy
import json
import os
from dataclasses import dataclass, field
from pathlib import Path

from quakeweave.functions.residuals import transform_names
from quakeweave.functions.text import METRIC_GROUPS, OLD_METRIC_NAMES

OUTPUT_MODES = ("observed", "synthetic", "residual", "gof", "full")


def find_config(explicit: str | None = None, *, variable: str = "QUAKEWEAVE_CONFIG", start: str = ".", names=("quakeweave.yaml", "quakeweave.json")) -> Path | None:
    """A given file, else the one that the environment names, else the first in this folder or one above."""
    for given in (explicit, os.environ.get(variable)):
        if given:
            return Path(given)
    here = Path(start).resolve()
    return next((p / n for p in (here, *here.parents) for n in names if (p / n).exists()), None)


def load_config(path: str | Path) -> dict:
    text = Path(path).read_text()
    if Path(path).suffix.lower() == ".json":
        data = json.loads(text)
    else:
        import yaml

        data = yaml.safe_load(text) or {}
    if not isinstance(data, dict):
        raise ValueError("a configuration is a mapping")
    return data


def merged(base: dict, over: dict) -> dict:
    """``base`` with the values of ``over``, mapping by mapping."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def dotted(config: dict, key: str, default=None):
    at = config
    for part in key.split("."):
        if not isinstance(at, dict) or part not in at:
            return default
        at = at[part]
    return at


def run_defaults(config: dict, command: str | None = None) -> dict:
    """Defaults for all commands, then for the command's group, then for the command."""
    defaults = config.get("defaults", {})
    out = merged({}, defaults.get("common", {}))
    if command:
        out = merged(out, dotted(defaults, f"groups.{command.split('.')[0]}", {}) or {})
        out = merged(out, defaults.get("commands", {}).get(command, {}))
    return out


def with_scenario(config: dict, name: str | None) -> dict:
    """The configuration under a scenario; one that names metrics replaces named groups, and the other way round."""
    if not name:
        return config
    if name not in config.get("scenarios", {}):
        raise KeyError(f"no scenario {name}")
    over = config["scenarios"][name]
    out = merged(config, over)
    chosen = over.get("metrics", {}) if isinstance(over.get("metrics"), dict) else {}
    for own, other in (("names", "groups"), ("groups", "names")):
        if own in chosen and other not in chosen:
            out["metrics"].pop(other, None)
    return out


def resolve_path(value: str, *, base: str | Path = ".", root: str | Path | None = None, must_exist: bool = False) -> Path:
    """A path with ``{root}``, ``~`` and variables filled in, relative ones below ``base``."""
    p = Path(os.path.expandvars(str(value).replace("{root}", str(root or base)))).expanduser()
    p = p if p.is_absolute() else Path(base) / p
    if must_exist and not p.exists():
        raise FileNotFoundError(p)
    return p


def bounds_of(keyword, presets: dict[str, tuple[float, float, float, float]]) -> tuple[float, float, float, float]:
    """A named area or four numbers (west, east, south, north)."""
    if isinstance(keyword, str):
        if keyword.strip().lower() not in presets:
            raise KeyError(f"unknown area {keyword}; known: {', '.join(sorted(presets))}")
        return presets[keyword.strip().lower()]
    w, e, s, n = map(float, keyword)
    if not (w < e and s < n):
        raise ValueError("bounds are west < east, south < north")
    return w, e, s, n


def output_path(key: str, registry: dict[str, str], *, root: str, explicit: str | None = None, overrides: dict[str, str] | None = None) -> Path:
    """An explicit path, else the artifact's own, else the registered name, else ``<key>.parquet``, below ``root``."""
    return resolve_path(explicit or (overrides or {}).get(key) or registry.get(key) or f"{key}.parquet", base=root)


def metric_names(metrics=None, groups=None) -> list[str]:
    """Distinct public names of metrics and of all metrics of groups, ``all`` being every one; unknown names raise ValueError."""
    known = [m for ms in METRIC_GROUPS.values() for m in ms]
    wanted: list[str] = []
    for g in [groups] if isinstance(groups, str) else groups or []:
        if g not in METRIC_GROUPS:
            raise ValueError(f"unknown metric group {g}")
        wanted += METRIC_GROUPS[g]
    for m in [metrics] if isinstance(metrics, str) else metrics or []:
        wanted += known if str(m).lower() == "all" else [OLD_METRIC_NAMES.get(str(m).upper(), str(m))]
    if not wanted:
        wanted = known
    unknown = [m for m in wanted if m not in known]
    if unknown:
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    return list(dict.fromkeys(wanted))


def passbands(value) -> list[tuple[float, float]]:
    """Pairs of seconds from ``1-2``, ``1:2`` or pairs; each must rise and be above 0."""
    out = []
    for v in value or []:
        a, b = (float(x) for x in (v.replace(":", "-").split("-") if isinstance(v, str) else v))
        if not 0 < a < b:
            raise ValueError(f"not a passband: {v}")
        out.append((a, b))
    return out


@dataclass(frozen=True)
class MetricPlan:
    """What to calculate: every combination of metric, passband, component and model."""

    metrics: list[str]
    passbands: list[tuple[float, float]]
    components: list[str]
    models: list[str] = field(default_factory=list)
    transforms: list[str] = field(default_factory=lambda: transform_names())
    periods_s: list[float] = field(default_factory=lambda: [1.0 + 0.5 * k for k in range(19)])
    output_mode: str = "full"
    relative_amplitude: float = 0.25
    least_cycles: float = 3.0
    synthetic_max_frequency_hz: float | None = None

    @classmethod
    def from_config(cls, config: dict, *, command: str = "metrics.calculate", overrides: dict | None = None) -> MetricPlan:
        c = merged(merged(run_defaults(config, command), dotted(config, "metrics", {}) or {}), overrides or {})
        if c.get("names") and c.get("groups"):
            raise ValueError("name metrics or groups, not both")
        mode = c.get("output_mode", "full")
        if mode not in OUTPUT_MODES:
            raise ValueError(f"output_mode must be one of {OUTPUT_MODES}")
        s = c.get("spectral", {})
        more = {"periods_s": [float(p) for p in s["periods_s"]]} if s.get("periods_s") else {}
        return cls(
            metric_names(c.get("names"), c.get("groups")), passbands(c.get("passbands")), list(c.get("components", ["Z", "N", "E"])), list(c.get("models", [])), transform_names(c.get("transforms")),
            output_mode=mode, relative_amplitude=float(s.get("relative_amplitude", 0.25)), least_cycles=float(s.get("least_cycles", 3.0)), synthetic_max_frequency_hz=c.get("synthetic_max_frequency_hz"), **more,
        )
