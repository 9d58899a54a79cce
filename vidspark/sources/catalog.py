"""Worlds and cameras."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.lens import Lens, PinholeLens
from ..types import CAMERAS, WORLDS


@dataclass(frozen=True)
class Point:
    """Where something is: of an object, at a time."""

    point_id: str
    object_id: str
    x: float
    y: float
    z: float
    time: object = None
    type: str = "pos"

    @property
    def coordinate(self) -> tuple[float, float, float]:
        return self.x, self.y, self.z


@dataclass(frozen=True)
class Camera:
    """A camera of a world."""

    cam_id: str
    location: Point | None = None
    ratio: float | None = None
    video_file: str | None = None
    metadata_id: str | None = None
    lens: Lens | None = None
    properties: Mapping[str, object] = field(default_factory=lambda: MappingProxyType({}))

    def row(self, world_id: str) -> Row:
        at = self.location.coordinate if self.location else (None, None, None)
        if self.lens is not None:  # a camera with a lens projects from the lens's origin
            at = (*self.lens.origin, 0.0)[:3]
        pinhole = self.lens if isinstance(self.lens, PinholeLens) else None
        focal = pinhole.focal if pinhole else (None, None)
        numbers = lambda xs: tuple(None if x is None else float(x) for x in xs)
        return Row(self.cam_id, world_id, None if self.ratio is None else float(self.ratio), numbers(at), numbers(focal), int(pinhole.fov) if pinhole else None, float(pinhole.skew) if pinhole else None)


def worlds(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, WORLDS)


def worlds_of(table: DataFrame) -> DataFrame:
    """The worlds of a table (world_id, units), each id once, with the least of its units; rows without id go."""
    return table.filter(F.col("world_id").isNotNull()).groupBy("world_id").agg(F.min("units").alias("units"))


def upsert_worlds(old: DataFrame, new: DataFrame) -> DataFrame:
    """All worlds; those of ``new`` take the place of old ones with the same id."""
    return old.join(new, "world_id", "left_anti").select(*old.columns).unionByName(new)


def cameras(spark: SparkSession, world_id: str, some: list[Camera]) -> DataFrame:
    return spark.createDataFrame([c.row(world_id) for c in some], CAMERAS)


def upsert_cameras(old: DataFrame, new: DataFrame) -> DataFrame:
    """All cameras; those of ``new`` take the place of old ones with the same world and id."""
    return old.join(new, ["world_id", "camera_id"], "left_anti").select(*old.columns).unionByName(new)


def fetch_cameras(table: DataFrame, world_id: str, ids: list[str] | None = None) -> DataFrame:
    """Nine plain columns of a world's cameras, of those ids only if some are given."""
    out = table.filter(F.col("world_id") == world_id)
    if ids:
        out = out.filter(F.col("camera_id").isin(list(ids)))
    return out.select(
        "camera_id", "ratio", F.col("origin.x").alias("origin_x"), F.col("origin.y").alias("origin_y"), F.col("origin.z").alias("origin_z"), F.col("focal.x").alias("focal_x"), F.col("focal.y").alias("focal_y"), "fov", "skew_factor"
    )
