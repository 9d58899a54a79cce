"""The fluent API: an immutable world of cameras and objects, whose verbs build a plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import constants
from .constants import START_TIME
from .functions import tpoint
from .functions.lens import Lens
from .functions.stbox import Volume
from .operators import video
from .plans.plan import Join, Plan, Projection, compile_plan, wrapped
from .plans.predicate import ATTRIBUTES, Predicate, read_predicate
from .sources import catalog
from .sources.catalog import Camera, Point
from .sources.ingest import ingest, merge_boxes, merge_trajectories
from .types import BBOXES, DETECTIONS, DIMENSIONS, TRAJECTORIES

#: The volume that is used unless another is chosen.
DEFAULT_VOLUME = Volume(*constants.DEFAULT_VOLUME)

Verb = Callable[["World"], "World"]


@dataclass(frozen=True)
class World:
    """Cameras, tables and a plan. Every verb returns a new world; ``execute`` gives a lazy DataFrame.

    Intervals are in frames from start_time, half-open; a frame takes seconds_per_frame.
    """

    spark: SparkSession
    name: str
    units: str = "metrics"
    start_time: datetime = START_TIME
    seconds_per_frame: float = 1.0
    cameras: Mapping[str, Camera] = field(default_factory=lambda: MappingProxyType({}))
    detections: Mapping[str, DataFrame] = field(default_factory=lambda: MappingProxyType({}))
    trajectories: DataFrame | None = None
    bboxes: DataFrame | None = None
    camera_table: DataFrame | None = None
    plan: Plan = Plan()
    video: tuple[str, ...] | None = None

    # Catalog.

    def get_name(self) -> str:
        return self.name

    def get_units(self) -> str:
        return self.units

    def worlds(self) -> DataFrame:
        return catalog.worlds(self.spark, [(self.name, self.units)])

    def camera(self, cam_id: str, location: Point | None = None, ratio: float | None = None, video_file: str | None = None, metadata_identifier: str | None = None, lens: Lens | None = None) -> World:
        """Adds a camera; one that is there already stays as it is."""
        if cam_id in self.cameras:
            return self
        return self._camera(Camera(cam_id, location, ratio, video_file, metadata_identifier, lens))

    def _camera(self, camera: Camera) -> World:
        return replace(self, cameras=MappingProxyType({**self.cameras, camera.cam_id: camera}))

    def add_lens(self, cam_id: str, lens: Lens) -> World:
        return self._camera(replace(self.cameras[cam_id], lens=lens))

    def add_properties(self, cam_id: str, properties: object, property_type: str) -> World:
        camera = self.cameras[cam_id]
        return self._camera(replace(camera, properties=MappingProxyType({**camera.properties, property_type: properties})))

    def remove_camera(self, cam_id: str) -> World:
        return replace(self, cameras=MappingProxyType({k: v for k, v in self.cameras.items() if k != cam_id}))

    def clear_cameras(self) -> World:
        return replace(self, cameras=MappingProxyType({}))

    def get_lens(self, cam_id: str) -> Lens | None:
        return self.cameras[cam_id].lens

    def get_camera(self, cam_id: list[str] | str = ()) -> DataFrame:
        """Nine plain columns of this world's cameras."""
        ids = [cam_id] if isinstance(cam_id, str) else list(cam_id)
        own = catalog.cameras(self.spark, self.name, list(self.cameras.values()))
        table = own if self.camera_table is None else catalog.upsert_cameras(self.camera_table, own)
        return catalog.fetch_cameras(table, self.name, ids)

    # Ingest.

    def recognize(self, cam_id: str, detections: DataFrame | None = None, algo: str = "Yolo", tracker_type: str = "multi", tracker: Callable[[Camera], DataFrame] | None = None) -> World:
        """Schedules a camera's detections: a frame of them, or what a tracker makes of the camera."""
        found = tracker(self.cameras[cam_id]) if tracker is not None else detections
        if found is None:
            raise ValueError("give detections or a tracker")
        return self._detected(cam_id, found)

    def _detected(self, cam_id: str, found: DataFrame) -> World:
        found = found if "camera_id" in found.columns else found.withColumn("camera_id", F.lit(cam_id))
        if cam_id in self.detections:
            found = self.detections[cam_id].unionByName(found, allowMissingColumns=True)
        return replace(self, detections=MappingProxyType({**self.detections, cam_id: found}))

    def item(self, item_id: str, cam_id: str, item_type: str, location: tuple[int, int, int, int], frame: int = 1) -> World:
        """Adds an object by hand: its box (x1, y1, x2, y2) in a frame."""
        return self._detected(cam_id, self.spark.createDataFrame([Row(cam_id, item_id, item_type, frame, *location)], DETECTIONS))

    def with_tables(self, trajectories: DataFrame, bboxes: DataFrame, camera_table: DataFrame | None = None) -> World:
        return replace(self, trajectories=trajectories, bboxes=bboxes, camera_table=camera_table if camera_table is not None else self.camera_table)

    def clear_tables(self) -> World:
        """Without trajectories and boxes; cameras stay."""
        return replace(self, trajectories=None, bboxes=None, detections=MappingProxyType({}))

    def ingested(self) -> World:
        """This world with its scheduled detections in the tables; cameras add up, and instants that are there stay."""
        trajectories, bboxes = self.trajectories, self.bboxes
        for cam_id, found in self.detections.items():
            camera = self.cameras.get(cam_id)
            new_t, new_b = ingest(found, camera.lens if camera else None, self.start_time, self.seconds_per_frame)
            trajectories = new_t if trajectories is None else merge_trajectories(trajectories, new_t)
            bboxes = new_b if bboxes is None else merge_boxes(bboxes, new_b)
        return replace(self, trajectories=trajectories, bboxes=bboxes, detections=MappingProxyType({}))

    # Plan.

    def _plan(self, plan: Plan) -> World:
        return replace(self, plan=plan)

    def predicate(self, condition: Callable, evaluated_var: Mapping | None = None) -> World:
        """Keeps objects for which a lambda holds; evaluated_var gives names in it their values."""
        return self._plan(self.plan.where(read_predicate(condition, evaluated_var)))

    def interval(self, time_interval: list | tuple = ()) -> World:
        """Keeps boxes within [start, end); without bounds it only asks for boxes."""
        low, high = tpoint.period(self.start_time, time_interval, self.seconds_per_frame)
        condition = F.lit(True)
        if low is not None:
            condition = (F.col("bbox.tmin") >= F.lit(low).cast("timestamp_ntz")) & (F.col("bbox.tmax") < F.lit(high).cast("timestamp_ntz"))
        return self._plan(self.plan.where(Predicate(condition, frozenset({"location"}))))

    def _select(self, name: str, attribute: str, columns: list[Column], distinct: bool) -> World:
        return self._plan(self.plan.add(Projection(name, tuple(columns), frozenset({attribute})), distinct))

    def selectkey(self, distinct: bool = False) -> World:
        return self._select("item_id", "object_id", [F.col("item_id")], distinct)

    def get_object_type(self, distinct: bool = False) -> World:
        return self._select("object_type", "object_type", [F.col("object_type")], distinct)

    def _restricted(self, interval) -> Column:
        return tpoint.at_period(F.col("traj"), *tpoint.period(self.start_time, interval, self.seconds_per_frame))

    def get_trajectory(self, interval: list | tuple = (), distinct: bool = False) -> World:
        """Coordinates of the whole trajectory, or of its part in an interval; not cut to the filter's volume."""
        return self._select("coordinates", "trajectory", [tpoint.coordinates(self._restricted(interval)).alias("coordinates")], distinct)

    def get_mfjson(self, interval: list | tuple = (), distinct: bool = False) -> World:
        return self._select("mfjson", "trajectory", [tpoint.as_mfjson(self._restricted(interval)).alias("mfjson")], distinct)

    def get_distance(self, interval: list | tuple = (), distinct: bool = False, interp: str = "linear") -> World:
        return self._select("distance", "trajectory", [tpoint.cumulative_length(self._restricted(interval), interp).alias("distance")], distinct)

    def get_speed(self, interval: list | tuple = (), distinct: bool = False, interp: str = "linear") -> World:
        return self._select("speed", "trajectory", [tpoint.speed(self._restricted(interval), interp).alias("speed")], distinct)

    def get_geo(self, interval: list | tuple = (), distinct: bool = False) -> World:
        """The six bounds of each box, of the boxes in an interval only."""
        return self._select("geometry", "location", [F.col(f"bbox.{d}").alias(d) for d in DIMENSIONS], distinct).interval(interval)

    def get_time(self, distinct: bool = False) -> World:
        return self._select("t", "location", [F.col("bbox.tmin").alias("t")], distinct)

    def get_columns(self, *verbs: Verb, distinct: bool = False) -> World:
        """Applies verbs such as ``primarykey`` or ``geometry`` in turn; distinct is that of this call."""
        out = self
        for verb in verbs:
            out = verb(out)
        return out._plan(replace(out.plan, distinct=distinct))

    def select_column(self, attribute: str, function: str | Callable[..., Column] | None = None, *args, alias: str | None = None, distinct: bool = False) -> World:
        """An attribute by name, through a function (registered, Spark's, or a Python one on columns) if one is given."""
        name = ATTRIBUTES[attribute][0]
        column = wrapped(name, function, *args) if function else F.col(name)
        label = alias or (f"{function if isinstance(function, str) else function.__name__}_{attribute}" if function else name.replace(".", "_"))
        return self._select(label, attribute, [column.alias(label)], distinct)

    def delete_column(self, name: str) -> World:
        """Takes a projection out, by the name of its verb's column."""
        return self._plan(replace(self.plan, projections=tuple(p for p in self.plan.projections if p.name != name)))

    def clear(self) -> World:
        """Drops the whole plan."""
        return replace(self, plan=Plan(), video=None)

    def count(self, what: str = "rows", distinct: bool = False, alias: str = "count") -> World:
        """Counts rows, or values of an attribute (different ones, if distinct), of all or of each group."""
        if what == "rows":
            entry = (alias, frozenset({"object_id"}), F.count(F.lit(1)))
        else:
            column = F.col(ATTRIBUTES[what][0])
            entry = (alias, frozenset({what}), F.count_distinct(column) if distinct else F.count(column))
        return self._plan(replace(self.plan, aggregates=(*self.plan.aggregates, entry), touched=True))

    def group(self, *attributes: str) -> World:
        """Groups by attributes; a predicate that counts then holds for groups."""
        for a in attributes:
            if a not in ATTRIBUTES:
                raise AttributeError(f"an object has no {a}")
        return self._plan(replace(self.plan, group=(*self.plan.group, *attributes), touched=True))

    def view(self, view_name: str) -> World:
        """Reads a named view in place of the tables."""
        return self._plan(replace(self.plan, source=self.spark.table(view_name), touched=True))

    def join(self, other: World | DataFrame | str, how: str = "inner", on: str | list[str] | Column = "item_id") -> World:
        """Joins another world's result, a frame, or a view; on item_id and inner unless said otherwise."""
        frame = other.execute() if isinstance(other, World) else self.spark.table(other) if isinstance(other, str) else other
        return self._plan(replace(self.plan, joins=(*self.plan.joins, Join(frame, how, on)), touched=True))

    def get_video(self, cam_id: list[str] | str = ()) -> World:
        """Asks for regions of interest of the objects, in some cameras or all."""
        return replace(self, video=(cam_id,) if isinstance(cam_id, str) else tuple(cam_id))

    # Results.

    def execute(self, create_view: bool = False, view_name: str = "") -> DataFrame | None:
        """The plan's result; None if nothing was asked but ingest. As a temporary view too, if wanted."""
        world = self.ingested() if self.detections else self
        if world.video is not None:
            out = world._video_plan()
        elif not world.plan.touched:
            return None
        else:
            out = compile_plan(world.plan, *world._tables())
        if create_view:
            out.createOrReplaceTempView(view_name or f"{self.name}_view")
        return out

    def _tables(self) -> tuple[DataFrame, DataFrame]:
        t = self.trajectories if self.trajectories is not None else self.spark.createDataFrame([], TRAJECTORIES)
        b = self.bboxes if self.bboxes is not None else self.spark.createDataFrame([], BBOXES)
        return t, b

    def _video_plan(self) -> DataFrame:
        asked = Projection("video", (F.col("item_id"), F.col("bbox")), frozenset({"object_id", "location"}))
        rows = compile_plan(replace(self.plan, projections=(asked,), distinct=False, touched=True), *self._tables())
        some = [c for c in self.cameras.values() if not self.video or c.cam_id in self.video]
        own = catalog.cameras(self.spark, self.name, some)
        return video.roi_plan(video.project_boxes(rows, own), self.start_time, self.seconds_per_frame, metadata_id=f"{self.name}_", keys=("camera_id", "item_id"))

    def select_intersection_of_interest_or_use_default(self, cam_id: str | None = None, default: bool = True, pixels: tuple[tuple[float, float], tuple[float, float]] | None = None) -> Volume:
        """The default volume, or that of two pixels of a camera, at depth 1 and from z 0 to 2."""
        if default or pixels is None:
            return DEFAULT_VOLUME
        lens = self.cameras[cam_id].lens
        (x1, y1), (x2, y2) = pixels
        a, b = (lens.pixel_to_world(F.lit(float(x)), F.lit(float(y)), F.lit(1.0)) for x, y in ((x1, y1), (x2, y2)))
        r = self.spark.range(1).select(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")).first()
        return Volume(r.x1, r.y1, constants.VOLUME_Z[0], r.x2, r.y2, constants.VOLUME_Z[1])

    def overlay_trajectory(self, cam_id: str, trajectories: DataFrame) -> DataFrame:
        """Pixel of each point of trajectories (a column coordinates) in a camera: what a drawing needs."""
        lens = self.cameras[cam_id].lens
        keep = [c for c in trajectories.columns if c != "coordinates"]
        points = trajectories.select(*keep, F.posexplode("coordinates").alias("point", "c"))
        u, v = lens.world_to_pixel(F.get("c", F.lit(0)), F.get("c", F.lit(1)), F.get("c", F.lit(2)))
        return points.select(*keep, "point", u.alias("u"), v.alias("v"))


primarykey: Verb = World.selectkey
object_type: Verb = World.get_object_type
trajectory: Verb = World.get_trajectory
distance: Verb = World.get_distance
speed: Verb = World.get_speed
geometry: Verb = World.get_geo
time: Verb = World.get_time
