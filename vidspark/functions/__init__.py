"""Scalar functions as column expressions: boxes, moving points, lenses, vision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import stbox, tpoint

#: Functions that predicates and projections may name; any other name goes to Spark's own functions.
REGISTRY: dict[str, Callable[..., Column]] = {
    "overlap": stbox.overlaps,
    "at_period": tpoint.at_period,
    "atPeriodSet": tpoint.at_period,
    "at_periods": tpoint.at_periods,
    "coordinates": tpoint.coordinates,
    "asMFJSON": tpoint.as_mfjson,
    "cumulativeLength": tpoint.cumulative_length,
    "speed": tpoint.speed,
    **{name: (lambda field: lambda box: box.getField(field))(name.lower()) for name in ("Xmin", "Ymin", "Zmin", "Xmax", "Ymax", "Zmax", "Tmin", "Tmax")},
    **{f"ST_{d}": (lambda field: lambda point: point.getField(field))(d.lower()) for d in "XYZ"},
}


def call(name: str, *args) -> Column:
    """A registered function, or Spark's function of that name."""
    if name in REGISTRY:
        return REGISTRY[name](*args)
    return F.call_function(name, *[a if isinstance(a, Column) else F.lit(a) for a in args])
