"""The logical plan of a query and its translation to DataFrame operations.

Which tables are read follows from the attributes in use, in whatever order they were named: boxes alone,
trajectories alone, or both joined. So multiplicity is visible: a query on boxes has a row per box until it
is made distinct.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import call
from ..functions.stbox import overlaps
from ..types import DIMENSIONS
from .predicate import ATTRIBUTES, Predicate


@dataclass(frozen=True)
class Projection:
    """A named verb: the columns it gives and the attributes it needs."""

    name: str
    columns: tuple[Column, ...]
    uses: frozenset[str]


@dataclass(frozen=True)
class Join:
    """Another frame to join: on item_id unless a condition is given."""

    other: DataFrame
    how: str = "inner"
    on: str | list[str] | Column = "item_id"


@dataclass(frozen=True)
class Plan:
    """What to compute: all parts are immutable; verbs make new plans."""

    projections: tuple[Projection, ...] = ()
    predicates: tuple[Predicate, ...] = ()
    distinct: bool = False
    group: tuple[str, ...] = ()
    aggregates: tuple[tuple[str, frozenset[str], Column], ...] = ()
    joins: tuple[Join, ...] = ()
    source: DataFrame | None = None
    touched: bool = False

    def add(self, projection: Projection, distinct: bool) -> Plan:
        return replace(self, projections=(*self.projections, projection), distinct=distinct, touched=True)

    def where(self, predicate: Predicate) -> Plan:
        return replace(self, predicates=(*self.predicates, predicate), touched=True)

    def uses(self) -> frozenset[str]:
        parts = [p.uses for p in (*self.projections, *self.predicates)] + [u for _, u, _ in self.aggregates]
        return frozenset().union(*parts, self.group)

    def tables(self) -> frozenset[str]:
        """The fewest tables that have all attributes in use; trajectories if either will do."""
        need = [ATTRIBUTES[a][1] for a in self.uses()]
        for choice in (frozenset({"trajectories"}), frozenset({"bboxes"})):
            if all(choice & n for n in need):
                return choice
        return frozenset({"trajectories", "bboxes"})


def scan(plan: Plan, trajectories: DataFrame, bboxes: DataFrame) -> DataFrame:
    """The rows that a plan's attributes call for.

    With both tables and a constant volume, trajectories are first held against it by their largest box: an object
    whose extent misses the volume has no box in it.
    """
    if plan.source is not None:
        return plan.source
    tables = plan.tables()
    if tables == {"trajectories"}:
        return trajectories
    if tables == {"bboxes"}:
        return bboxes
    for volume in (p.volume for p in plan.predicates if p.volume):
        spatial = replace(volume, tmin=None, tmax=None)
        trajectories = trajectories.filter(F.col("largest_bbox").isNull() | overlaps(F.col("largest_bbox"), spatial))
    left = trajectories.drop("camera_id") if "camera_id" in bboxes.columns else trajectories
    return left.join(bboxes, "item_id")


def compile_plan(plan: Plan, trajectories: DataFrame, bboxes: DataFrame) -> DataFrame:
    """The frame of a plan."""
    rows = scan(plan, trajectories, bboxes)
    for join in plan.joins:
        rows = rows.join(join.other, join.on, join.how)
    for p in plan.predicates:
        if not p.having:
            rows = rows.filter(p.condition)
    if plan.group or plan.aggregates:
        return _grouped(plan, rows)
    columns = [c for p in plan.projections for c in p.columns]
    names = _unique([n for p in plan.projections for n in rows.select(*p.columns).columns])
    if not columns:
        return rows.dropDuplicates(["item_id"]) if plan.distinct else rows
    named = [c.alias(n) for c, n in zip(columns, names, strict=True)]
    if not plan.distinct:
        return rows.select(*named)
    if {p.name for p in plan.projections} == {"item_id"}:
        return rows.select(*named).distinct()
    return first_per_item(rows, named, names)


def first_per_item(rows: DataFrame, named: list[Column], names: list[str]) -> DataFrame:
    """One row per item: that of the earliest box, then the least corners.

    Each task keeps one row per item before the shuffle. The minimum is of a struct, so Spark aggregates by sorting.
    """
    order = [F.col(f"bbox.{d}") for d in ("tmin", *DIMENSIONS, "tmax")] if "bbox" in rows.columns else [F.lit(0)]
    picked = rows.groupBy("item_id").agg(F.min_by(F.struct(*named), F.struct(*order)).alias("_row"))
    return picked.select(*[F.col("_row").getField(n).alias(n) for n in names])


def _unique(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        k = n
        i = 2
        while k in out:
            k, i = f"{n}_{i}", i + 1
        out.append(k)
    return out


def _grouped(plan: Plan, rows: DataFrame) -> DataFrame:
    keys = [F.col(ATTRIBUTES[a][0]).alias(ATTRIBUTES[a][0].replace(".", "_")) for a in plan.group]
    having = [(f"_having{i}", p.condition) for i, p in enumerate(p for p in plan.predicates if p.having)]
    aggregates = [c.alias(n) for n, _, c in plan.aggregates] + [c.alias(n) for n, c in having]
    if not aggregates:
        return rows.select(*keys).distinct()
    out = rows.groupBy(*keys).agg(*aggregates)
    for name, _ in having:
        out = out.filter(name).drop(name)
    return out


def wrapped(name: str, function: str | Callable[..., Column], *args) -> Column:
    """A function, registered or Spark's, over a column by name."""
    return function(F.col(name), *args) if callable(function) else call(function, F.col(name), *args)
