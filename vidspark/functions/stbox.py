"""Spatio-temporal boxes as plain structs, so that their fields push down to Parquet."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import STBOX

_NUMBER = r"\s*(-?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)\s*"
_TEXT = re.compile(rf"^\s*(?:stbox\s+)?'?\s*STBOX\s+Z(T)?\s*\(\(([^)]*)\)\s*,\s*\(([^)]*)\)\)\s*'?\s*$", re.I)


@dataclass(frozen=True)
class Volume:
    """A constant box; corners are put in order. A dimension that is None is not part of it."""

    xmin: float | None = None
    ymin: float | None = None
    zmin: float | None = None
    xmax: float | None = None
    ymax: float | None = None
    zmax: float | None = None
    tmin: datetime | None = None
    tmax: datetime | None = None

    def __post_init__(self) -> None:
        for d in "xyzt":
            low, high = getattr(self, f"{d}min"), getattr(self, f"{d}max")
            if (low is None) != (high is None):
                raise ValueError(f"one bound of {d} is missing")
            if low is not None and low > high:
                object.__setattr__(self, f"{d}min", high)
                object.__setattr__(self, f"{d}max", low)

    def __contains__(self, item: object) -> bool:
        raise TypeError("'in' gives a truth value, not a condition; write location.overlaps(volume)")


def parse_volume(text: str) -> Volume:
    """Reads ``STBOX Z((x,y,z),(x,y,z))`` or ``STBOX ZT((x,y,z,t),(x,y,z,t))``, with or without ``stbox '...'`` around."""
    found = _TEXT.match(text)
    if not found:
        raise ValueError(f"not a box: {text!r}")
    a, b = ([x.strip() for x in found[k].split(",")] for k in (2, 3))
    n = 4 if found[1] else 3
    if len(a) != n or len(b) != n or not all(re.fullmatch(_NUMBER, x) for x in [*a[:3], *b[:3]]):
        raise ValueError(f"not a box: {text!r}")
    times = [datetime.fromisoformat(x[3].strip("'\"")) for x in (a, b)] if n == 4 else [None, None]
    return Volume(*map(float, a[:3]), *map(float, b[:3]), *times)


def stbox(x1, y1, z1, x2, y2, z2, tmin=None, tmax=None) -> Column:
    """A box column from two corners in any order."""
    pairs = [(_c(a).cast("double"), _c(b).cast("double")) for a, b in ((x1, x2), (y1, y2), (z1, z2))]
    low = [F.least(a, b).alias(f"{d}min") for d, (a, b) in zip("xyz", pairs, strict=True)]
    high = [F.greatest(a, b).alias(f"{d}max") for d, (a, b) in zip("xyz", pairs, strict=True)]
    tmin, tmax = _c(tmin), _c(tmin if tmax is None else tmax)
    return F.struct(*low, *high, tmin.cast("timestamp_ntz").alias("tmin"), tmax.cast("timestamp_ntz").alias("tmax"))


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def volume_column(volume: Volume) -> Column:
    return F.struct(*[F.lit(getattr(volume, f.name)).cast(f.dataType).alias(f.name) for f in STBOX.fields])


def overlaps(box: Column, other: Column | Volume | str) -> Column:
    """Whether boxes meet in all dimensions that both have; touching counts.

    With a constant volume only its own dimensions are compared, as conjuncts that reach the scan.
    """
    if isinstance(other, str):
        other = parse_volume(other)
    out = F.lit(True)
    for d in "xyzt":
        low, high = f"{d}min", f"{d}max"
        if isinstance(other, Volume):
            if getattr(other, low) is None:
                continue
            kind = "timestamp_ntz" if d == "t" else "double"
            a, b = F.lit(getattr(other, low)).cast(kind), F.lit(getattr(other, high)).cast(kind)
            both = (box.getField(low) <= b) & (box.getField(high) >= a)
            out &= both if d in "xy" else F.coalesce(both, F.lit(True))
        else:
            both = (box.getField(low) <= other.getField(high)) & (box.getField(high) >= other.getField(low))
            out &= both if d in "xy" else F.coalesce(both, F.lit(True))
    return out


def centre(box: Column) -> Column:
    """Centre of a box as a struct of x, y, z."""
    return F.struct(*[(box.getField(f"{d}min") + (box.getField(f"{d}max") - box.getField(f"{d}min")) / 2).alias(d) for d in "xyz"])


def half_extents(box: Column) -> Column:
    return F.struct(*[((box.getField(f"{d}max") - box.getField(f"{d}min")) / 2).alias(d) for d in "xyz"])
