"""Run configuration: species sections, environment, types and bounds."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

#: The names below are those of users' files.
RESOLUTIONS = ("0.125x0.15625", "0.25x0.3125", "0.5x0.625", "2.0x2.5", "4.0x5.0")


@dataclass(frozen=True)
class RunConfig:
    StartDate: int = 20180501
    EndDate: int = 20180508
    Species: str = "CH4"
    Res: str = "0.25x0.3125"
    isRegional: bool = True
    LonMin: float = -180.0
    LonMax: float = 180.0
    LatMin: float = -90.0
    LatMax: float = 90.0
    PriorError: tuple = (0.5,)
    ObsError: tuple = (15.0,)
    Gamma: tuple = (1.0,)
    PriorErrorBCs: tuple = (10.0,)
    PriorErrorOH: tuple = (0.5,)
    OptimizeBCs: bool = False
    OptimizeOH: bool = False
    LognormalErrors: bool = False
    UseWaterObs: bool = False
    NumberOfElements: int = 100
    KalmanMode: bool = False
    UpdateFreqDays: int = 7
    NudgeFactor: float = 0.1
    DOFSThreshold: float = 0.0
    BufferReductionFactor: int = 4


#: Keys that every run names, and those that it names where a switch is on.
REQUIRED = ("StartDate", "EndDate", "Species", "Res", "isRegional", "LonMin", "LonMax", "LatMin", "LatMax", "PriorError", "ObsError", "Gamma")
NEEDED_WITH = {
    "KalmanMode": ("UpdateFreqDays", "NudgeFactor"),
    "OptimizeBCs": ("PriorErrorBCs",),
    "OptimizeOH": ("PriorErrorOH",),
    "ReducedDimensionStateVector": ("NumberOfElements",),
    "PrecomputedJacobian": ("ReferenceRunDir",),
    "OffDiagonalPriorCov": ("LengthScalePriorCov",),
}


def problems(values: Mapping) -> list[str]:
    """All that is wrong with a file's keys: missing ones, those that a switch needs, and bounds off the globe or in the wrong order."""
    on = [k for k in NEEDED_WITH if k in values and parse_bool(values[k])]
    found = [f"{k} is missing" for k in REQUIRED if k not in values]
    found += [f"{k} is missing, which {switch} needs" for switch in on for k in NEEDED_WITH[switch] if k not in values]
    for axis, most in (("Lon", 180), ("Lat", 90)):
        low, high = (values.get(f"{axis}{end}") for end in ("Min", "Max"))
        if isinstance(low, (int, float)) and isinstance(high, (int, float)):
            if max(abs(low), abs(high)) > most:
                found.append(f"{axis}Min and {axis}Max must lie within {most} degrees of 0")
            if low >= high:
                found.append(f"{axis}Min must be below {axis}Max")
    return found


def flatten(raw: Mapping) -> dict:
    """The section of the chosen species over the common keys; $VARIABLES of strings are expanded."""
    out = {k: v for k, v in raw.items() if not isinstance(v, Mapping)}
    section = raw.get(raw.get("Species", "CH4"))
    out |= dict(section) if isinstance(section, Mapping) else {}
    return {k: os.path.expandvars(v) if isinstance(v, str) else v for k, v in out.items()}


def overridden(values: dict, environ: Mapping[str, str], prefix: str = "RUN_") -> dict:
    return values | {k.removeprefix(prefix): v for k, v in environ.items() if k.startswith(prefix)}


def parse_bool(v) -> bool:
    if isinstance(v, str):
        if v.strip().lower() in ("true", "yes", "1"):
            return True
        if v.strip().lower() in ("false", "no", "0"):
            return False
        raise ValueError(f"not a truth value: {v!r}")
    return bool(v)


def load(raw: Mapping, environ: Mapping[str, str] | None = None) -> RunConfig:
    """A checked configuration; unknown keys and bad bounds are errors."""
    values = overridden(flatten(raw), environ or {})
    known = {f.name: f for f in fields(RunConfig)}
    if unknown := sorted(set(values) - set(known)):
        raise ValueError(f"unknown keys: {unknown}")
    typed = {}
    for k, v in values.items():
        default = known[k].default
        if isinstance(default, bool):
            typed[k] = parse_bool(v)
        elif isinstance(default, tuple):
            typed[k] = tuple(float(x) for x in (v if isinstance(v, (list, tuple)) else [v]))
        else:
            typed[k] = type(default)(v)
    c = RunConfig(**typed)
    if c.StartDate >= c.EndDate:
        raise ValueError("StartDate must come before EndDate")
    if not (c.LonMin < c.LonMax and c.LatMin < c.LatMax):
        raise ValueError("bounds are empty")
    if c.Res not in RESOLUTIONS:
        raise ValueError(f"resolution {c.Res!r} is none of {RESOLUTIONS}")
    return c
