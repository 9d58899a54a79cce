"""Moving points: arrays of instants in order of time."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Steps whose running sums are one list.
BLOCK = 256


def _bound(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("timestamp_ntz")


def at_period(traj: Column, start=None, end=None) -> Column:
    """Instants in [start, end); null if none is left. A missing bound does not bind."""
    if start is None and end is None:
        return traj
    inside = lambda p: (F.lit(True) if start is None else p["t"] >= _bound(start)) & (F.lit(True) if end is None else p["t"] < _bound(end))
    kept = F.filter(traj, inside)
    return F.when(F.size(kept) > 0, kept)


def normal_periods(periods: Column) -> Column:
    """Half-open periods (array of structs low, high) in order, with those that meet or touch made one; empty and null ones go."""
    sound = F.array_sort(F.filter(periods, lambda p: p["low"] < p["high"]))
    kind = "array<struct<low:timestamp_ntz,high:timestamp_ntz>>"

    def take(out: Column, p: Column) -> Column:
        last = F.element_at(out, -1)
        joined = F.struct(last["low"].alias("low"), F.greatest(last["high"], p["high"]).alias("high"))
        apart = (F.size(out) == 0) | (F.try_element_at(out, F.lit(-1))["high"] < p["low"])
        return F.when(apart, F.array_append(out, p)).otherwise(F.array_append(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), joined))

    return F.aggregate(F.transform(sound, lambda p: F.struct(p["low"].cast("timestamp_ntz").alias("low"), p["high"].cast("timestamp_ntz").alias("high"))), F.array().cast(kind), take)


def at_periods(traj: Column, periods: list[tuple[datetime, datetime]] | Column) -> Column:
    """Instants in any of a set of half-open periods; null if none is left.

    Constant periods are put in order and joined before the plan is made; a column of them is normalised for each row. Then one pass over the instants keeps those within.
    """
    if isinstance(periods, Column):
        found = normal_periods(periods)
        kept = F.filter(traj, lambda p: F.exists(found, lambda x: (p["t"] >= x["low"]) & (p["t"] < x["high"])))
        return F.when(F.size(kept) > 0, kept)
    joined: list[list[datetime]] = []
    for low, high in sorted((a, b) for a, b in periods if a < b):
        if joined and low <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], high)
        else:
            joined.append([low, high])
    inside = lambda p: _any([(p["t"] >= _bound(a)) & (p["t"] < _bound(b)) for a, b in joined])
    kept = F.filter(traj, inside)
    return F.when(F.size(kept) > 0, kept)


def _any(conditions: list[Column]) -> Column:
    """Whether one of them holds, as a tree that is not deep."""
    if len(conditions) < 2:
        return conditions[0] if conditions else F.lit(False)
    half = len(conditions) // 2
    return _any(conditions[:half]) | _any(conditions[half:])


def coordinates(traj: Column) -> Column:
    """List of [x, y, z]."""
    return F.transform(traj, lambda p: F.array(p["x"], p["y"], p["z"]))


def as_mfjson(traj: Column) -> Column:
    """Moving-features JSON text of a moving point."""
    stamp = lambda p: F.date_format(p["t"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    record = F.struct(F.lit("MovingPoint").alias("type"), coordinates(traj).alias("coordinates"), F.transform(traj, stamp).alias("datetimes"), F.array(F.lit("Discrete")).alias("interpolations"))
    return F.when(traj.isNotNull(), F.to_json(record))


def seconds_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / 1e6


def _steps(traj: Column, of) -> Column:
    """of(previous, next) of each pair of neighbours."""
    n = F.greatest(F.size(traj) - 1, F.lit(0))
    return F.zip_with(F.slice(traj, F.lit(1), n), F.slice(traj, F.lit(2), n), of)


def _let(value: Column, of) -> Column:
    """of(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _length(a: Column, b: Column) -> Column:
    return F.sqrt(sum(((b[d] - a[d]) * (b[d] - a[d]) for d in "yz"), (b["x"] - a["x"]) * (b["x"] - a["x"])))


def segments(traj: Column) -> Column:
    """Of each segment: start time t, length, and speed per second (null where no time passes)."""
    one = lambda a, b: F.struct(a["t"].alias("t"), b["t"].alias("until"), _length(a, b).alias("length"), F.try_divide(_length(a, b), seconds_between(a["t"], b["t"])).alias("speed"))
    return _steps(traj, one)


def cumulative_length(traj: Column, interp: str = "linear") -> Column:
    """Running length as a list of (t, length), 0 at the first instant; all 0 for ``discrete`` points."""
    if interp == "discrete":
        return F.transform(traj, lambda p: F.struct(p["t"].alias("t"), F.lit(0.0).alias("length")))
    first = F.struct(F.get(traj, F.lit(0))["t"].alias("t"), F.lit(0.0).alias("length"))
    empty = F.array().cast("array<struct<t:timestamp_ntz,length:double>>")
    last = lambda out: F.coalesce(F.get(out, F.size(out) - 1)["length"], F.lit(0.0))
    add = lambda out, s: F.array_append(out, F.struct(s["until"].alias("t"), (last(out) + s["length"]).alias("length")))
    shift = lambda sums, by: F.transform(sums, lambda p: F.struct(p["t"].alias("t"), (p["length"] + by).alias("length")))

    # Appending copies a list, so lists stay short: running sums of blocks, then of the blocks' ends.
    def blocks(steps: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1)), F.lit(BLOCK))
        return F.transform(firsts, lambda k: F.aggregate(F.slice(steps, k, BLOCK), empty, add))

    def joined(sums: Column) -> Column:
        before = F.aggregate(sums, F.array(F.lit(0.0)), lambda out, b: F.array_append(out, F.element_at(out, -1) + last(b)))
        return F.flatten(F.zip_with(sums, F.slice(before, F.lit(1), F.size(sums)), shift))

    return F.when(F.size(traj) > 0, F.concat(F.array(first), _let(_let(segments(traj), blocks), joined)))


def total_length(traj: Column) -> Column:
    return F.when(F.size(traj) > 0, F.aggregate(segments(traj), F.lit(0.0), lambda a, s: a + s["length"]))


def speed(traj: Column, interp: str = "linear") -> Column:
    """Speed as a step list of (t, speed), the last repeated at the end; null for a single instant or ``discrete`` points."""
    if interp == "discrete":
        return F.when(F.lit(False), F.transform(traj, lambda p: F.struct(p["t"].alias("t"), F.lit(0.0).alias("speed"))))
    steps = F.transform(segments(traj), lambda s: F.struct(s["t"].alias("t"), s["speed"].alias("speed")))
    last = F.element_at(segments(traj), -1)
    return F.when(F.size(traj) > 1, F.array_append(steps, F.struct(last["until"].alias("t"), last["speed"].alias("speed"))))


def time_of_frame(frame: Column, start: datetime, seconds_per_frame: float = 1.0) -> Column:
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (frame * F.lit(seconds_per_frame)).cast("decimal(18,6)"))
    return F.lit(start).cast("timestamp_ntz") + step


def frame_of_time(t: Column, start: datetime, seconds_per_frame: float = 1.0) -> Column:
    return F.round(seconds_between(F.lit(start).cast("timestamp_ntz"), t) / seconds_per_frame).cast("int")


def period(start: datetime, interval: list | tuple | None, seconds_per_frame: float = 1.0) -> tuple[datetime | None, datetime | None]:
    """Bounds of a half-open interval in frames from ``start``; empty has none."""
    if not interval:
        return None, None
    low, high = (start + timedelta(seconds=x * seconds_per_frame) for x in interval)
    return low, high
