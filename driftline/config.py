"""Typed configuration: defaults, profiles and a TOML loader."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

# Transponder codes of the three emergency types, by priority, and ordinary codes
# that start like an emergency code.
EMERGENCY_CODES = ("7500", "7600", "7700")
DIAL_PREFIX = "77"
DIAL_EXCLUDED = ("7700", "7777")
UNBOUNDED = 99999


def _positive(name: str, value: float) -> None:
    if value <= 0:
        raise ValueError(f"{name} must be positive, not {value}")


@dataclass(frozen=True)
class SegmentRules:
    """Gap that splits trips (seconds), and what a kept trip needs."""

    gap_s: float = 1200
    min_duration_s: float = 600
    min_distance_km: float = 30.0
    batch_size: int = 5000

    def __post_init__(self) -> None:
        for f in fields(self):
            _positive(f.name, getattr(self, f.name))


@dataclass(frozen=True)
class Gates:
    """Thresholds of the incident gates, score tiers (seconds), debounce and cap."""

    min_samples: int = 5
    window_s: float = 60
    persistence_s: float = 45
    ground_ratio: float = 0.3
    tiers_s: tuple[float, float, float] = (60, 120, 180)
    debounce_s: float = 900
    cap_s: float = 5400


@dataclass(frozen=True)
class Profile:
    """Filter applied to scored incidents; sample bounds by emergency code."""

    name: str = "none"
    min_confidence: int = 50
    min_duration_s: float = 45
    max_samples: dict[str, int] = field(default_factory=dict)
    min_samples: dict[str, int] = field(default_factory=dict)

    def bounds(self, code: str) -> tuple[int, int]:
        return self.min_samples.get(code, 5), self.max_samples.get(code, UNBOUNDED)


def _profile(name: str, confidence: int, duration: float, most: tuple[int, int, int], least: tuple[int, int, int]) -> Profile:
    return Profile(name, confidence, duration, dict(zip(EMERGENCY_CODES, most, strict=True)), dict(zip(EMERGENCY_CODES, least, strict=True)))


# The shipped profiles.
PROFILES = {
    "none": Profile(),
    "production": _profile("production", 70, 120, (430, 379, 224), (186, 163, 116)),
    "research": _profile("research", 50, 60, (993, 614, 538), (100, 86, 82)),
    "high_security": _profile("high_security", 80, 180, (186, 163, 116), (186, 163, 116)),
}


@dataclass(frozen=True)
class Config:
    data_dir: str = "data"
    segments: SegmentRules = SegmentRules()
    gates: Gates = Gates()
    default_profile: str = "none"
    profiles: dict[str, Profile] = field(default_factory=lambda: dict(PROFILES))
    resolutions: tuple[int, ...] = (3, 4, 5, 6)
    #: Key of ``functions.geo.CELL_SYSTEMS``.
    cells: str = "grid"
    spark: dict[str, str] = field(default_factory=dict)

    def profile(self, name: str | None = None) -> Profile:
        name = name or self.default_profile
        if name not in self.profiles:
            raise ValueError(f"Unknown filter profile: {name}; known are {', '.join(sorted(self.profiles))}")
        return self.profiles[name]


def check_size(text: str) -> str:
    """Memory sizes such as 8GB."""
    if not re.fullmatch(r"\d+[KMGT]B", text):
        raise ValueError(f"not a size: {text}")
    return text


def load(path: str | Path) -> Config:
    """Read a TOML file; what it leaves out keeps its default.  A missing file raises."""
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    base = Config()
    seg = raw.get("segments", {})
    rules = SegmentRules(
        gap_s=seg["gap_minutes"] * 60 if "gap_minutes" in seg else base.segments.gap_s,
        min_duration_s=seg.get("min_duration_s", base.segments.min_duration_s),
        min_distance_km=seg.get("min_distance_km", base.segments.min_distance_km),
        batch_size=seg.get("batch_size", base.segments.batch_size),
    )
    inc = raw.get("incidents", {})
    for name in ("debounce_minutes", "max_duration_cap_s"):
        if name in inc:
            _positive(name, inc[name])
    gates = replace(base.gates, debounce_s=inc.get("debounce_minutes", base.gates.debounce_s / 60) * 60, cap_s=inc.get("max_duration_cap_s", base.gates.cap_s))
    profiles = dict(base.profiles)
    for key, p in inc.get("profiles", {}).items():
        profiles[key] = Profile(
            p.get("name", key),
            p.get("min_confidence", 50),
            p.get("min_duration_s", 45),
            {c: p[f"max_samples_{c}"] for c in EMERGENCY_CODES if f"max_samples_{c}" in p},
            {c: p[f"min_samples_{c}"] for c in EMERGENCY_CODES if f"min_samples_{c}" in p},
        )
    spark = {k: str(v) for k, v in raw.get("spark", {}).items()}
    return Config(raw.get("data_dir", base.data_dir), rules, gates, inc.get("default_profile", base.default_profile), profiles, tuple(raw.get("aggregation", {}).get("resolutions", base.resolutions)), raw.get("aggregation", {}).get("cells", base.cells), spark)
