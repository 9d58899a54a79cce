"""The registered queries on moving objects, each with equal SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import call, recognition, tpoint, vision
from .functions.lens import PinholeLens, VRLens
from .functions.stbox import Volume, centre, half_extents, overlaps, stbox
from .operators import tiling, tracking, video
from .operators.joins import overlap_join, with_items
from .sources import catalog, events, roi_video, store, tile_store
from .sources.ingest import boxes, ingest, label_rows, merge_boxes, merge_trajectories
from .streaming.merge import merge_stream, merged_store
from .world import World, geometry, primarykey, time

VOLUME = Volume(10.0, 20.0, 0.0, 30.0, 60.0, 2.0)
START = datetime(2024, 1, 1)
DAY = 86400
INTERVAL = [4 * DAY, 19 * DAY]
LENS = PinholeLens((1280, 720), (0.0, 0.0, 0.0), 120.0)
VR = VRLens((1280, 720), (1.0, 2.0, 3.0), yaw=0.1, pitch=0.2, roll=0.3)

_DET = """det AS (
  SELECT event_type || '-' || CAST(user_id AS VARCHAR) AS item_id, event_type AS object_type, ts AS t, event_id, value AS x1,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS DOUBLE) AS y1, value + 1 + event_id % 7 AS x2,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS DOUBLE) + 1 + event_id % 5 AS y2
  FROM events)"""
_MEETS = "x1 <= 30 AND x2 >= 10 AND y1 <= 60 AND y2 >= 20"
_IN_TIME = "t >= TIMESTAMP '2024-01-05' AND t < TIMESTAMP '2024-01-20'"
_POINTS = "pts AS (SELECT item_id, t, x1 + (x2 - x1) / 2 AS x, y1 + (y2 - y1) / 2 AS y FROM det)"
_STEPS = """steps AS (
  SELECT item_id, t, lead(t) OVER w AS until, sqrt(power(lead(x) OVER w - x, 2) + power(lead(y) OVER w - y, 2)) AS len FROM pts WINDOW w AS (PARTITION BY item_id ORDER BY t))"""


def world(spark: SparkSession, sf_dir: str) -> World:
    trajectories, bboxes = ingest(events.detections(spark, sf_dir))
    return World(spark, "events", start_time=START).with_tables(trajectories, bboxes, events.cameras(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None, det: bool = True):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = f"WITH RECURSIVE {_DET}{', ' if sql.lstrip().startswith('@') else ' '}{sql.lstrip().lstrip('@')}" if det else sql
        return fn

    return add


@_query("SELECT DISTINCT item_id FROM det WHERE object_type = 'click'")
def filter_type_select_key(spark, sf_dir):
    return world(spark, sf_dir).predicate(lambda obj: obj.object_type == "click").selectkey().execute()


@_query("SELECT DISTINCT item_id FROM det WHERE object_type <> 'click'")
def filter_type_ne(spark, sf_dir):
    return world(spark, sf_dir).predicate(lambda obj: obj.object_type != "click").selectkey().execute()


@_query("SELECT DISTINCT item_id, object_type FROM det WHERE item_id IN ('click-1', 'view-2', 'error-3', 'none-0')")
def filter_id_isin(spark, sf_dir):
    wanted = ["click-1", "view-2", "error-3", "none-0"]
    return world(spark, sf_dir).predicate(lambda obj: obj.object_id in wanted).selectkey().get_object_type().execute()


@_query("SELECT DISTINCT item_id, object_type FROM det WHERE (object_type = 'click' OR object_type = 'view') AND NOT item_id < 'view-3'")
def filter_or_not(spark, sf_dir):
    out = world(spark, sf_dir).predicate(lambda obj: (obj.object_type == "click" or obj.object_type == "view") and not obj.object_id < "view-3")
    return out.selectkey().get_object_type().execute()


@_query("SELECT DISTINCT item_id FROM det WHERE length(item_id) BETWEEN 7 AND 8")
def filter_function_call(spark, sf_dir):
    return world(spark, sf_dir).predicate(lambda obj: 7 <= char_length(obj.object_id) <= 8).selectkey().execute()  # noqa: F821


@_query(f"SELECT item_id FROM det WHERE {_MEETS}")
def overlap_bag_keys(spark, sf_dir):
    return world(spark, sf_dir).predicate(lambda obj: obj.location in VOLUME).selectkey().execute()


@_query(f"SELECT x1 AS xmin, y1 AS ymin, 1.0::DOUBLE AS zmin, x2 AS xmax, y2 AS ymax, 1.0::DOUBLE AS zmax, t FROM det WHERE {_IN_TIME}")
def interval_boxes(spark, sf_dir):
    return world(spark, sf_dir).get_geo(INTERVAL).get_time().execute()


@_query(f"SELECT DISTINCT item_id FROM det WHERE object_type = 'click' AND {_MEETS} AND {_IN_TIME}")
def flagship_distinct_ids(spark, sf_dir):
    filtered = world(spark, sf_dir).predicate(lambda obj: obj.object_type == "click").predicate(lambda obj: obj.location in VOLUME)
    return filtered.interval(INTERVAL).selectkey(distinct=True).execute()


@_query("SELECT item_id, t, x1 AS xmin, y1 AS ymin FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY t, x1, y1) AS n FROM det) WHERE n = 1")
def distinct_first_box(spark, sf_dir):
    return world(spark, sf_dir).get_columns(primarykey, time, geometry, distinct=True).execute().select("item_id", "t", "xmin", "ymin")


@_query(f"SELECT item_id, x1 AS xmin, y1 AS ymin, 1.0::DOUBLE AS zmin, x2 AS xmax, y2 AS ymax, 1.0::DOUBLE AS zmax, t FROM det WHERE object_type = 'view' AND {_IN_TIME}")
def columns_key_geo_time(spark, sf_dir):
    return world(spark, sf_dir).predicate(lambda obj: obj.object_type == "view").get_columns(primarykey, geometry, time).interval(INTERVAL).execute()


@_query("SELECT DISTINCT object_type FROM det")
def object_types_distinct(spark, sf_dir):
    return world(spark, sf_dir).get_object_type().execute().distinct()


@_query(f"@{_POINTS} SELECT item_id, x, y, 1.0::DOUBLE AS z FROM pts WHERE item_id LIKE 'click-%' AND {_IN_TIME}")
def trajectory_points(spark, sf_dir):
    out = world(spark, sf_dir).predicate(lambda obj: obj.object_type == "click").selectkey().get_trajectory(INTERVAL).execute()
    return out.select("item_id", F.explode("coordinates").alias("c")).select("item_id", *[F.get("c", F.lit(i)).alias(d) for i, d in enumerate("xyz")])


@_query(f"@{_POINTS} SELECT item_id, 'MovingPoint' AS type, 'Discrete' AS interpolation, t, round(x, 8) AS x, round(y, 8) AS y, 1.0::DOUBLE AS z FROM pts WHERE {_IN_TIME}")
def trajectory_mfjson(spark, sf_dir):
    """The JSON text of each trajectory, read back as points."""
    read = F.from_json("mfjson", "type string, coordinates array<array<double>>, datetimes array<timestamp_ntz>, interpolations array<string>").alias("m")
    out = world(spark, sf_dir).selectkey().get_mfjson(INTERVAL).execute().filter("mfjson IS NOT NULL").select("item_id", read)
    points = out.select("item_id", "m.type", F.get("m.interpolations", F.lit(0)).alias("interpolation"), F.explode(F.arrays_zip("m.datetimes", "m.coordinates")).alias("p"))
    return points.select("item_id", "type", "interpolation", F.col("p.datetimes").alias("t"), *[F.round(F.get("p.coordinates", F.lit(i)), 8).alias(d) for i, d in enumerate("xyz")])


@_query(
    f"""@{_POINTS}, {_STEPS}, v AS (SELECT *, round(len / nullif((epoch_us(until) - epoch_us(t)) / 1e6, 0), 8) AS v, count(*) OVER (PARTITION BY item_id) AS n FROM steps)
SELECT item_id, t, CASE WHEN until IS NULL THEN lag(v) OVER (PARTITION BY item_id ORDER BY t) ELSE v END AS speed FROM v WHERE n > 1"""
)
def speed_steps(spark, sf_dir):
    out = world(spark, sf_dir).selectkey().get_speed().execute().select("item_id", F.inline("speed"))
    return out.select("item_id", "t", F.round("speed", 8).alias("speed"))


@_query(f"SELECT item_id, t FROM det WHERE {_MEETS}")
def overlap_text_volume(spark, sf_dir):
    volume = "stbox 'STBOX Z((10, 20, 0), (30, 60, 2))'"
    return world(spark, sf_dir).predicate(lambda obj: obj.location in v, {"v": volume}).selectkey().get_time().execute()  # noqa: F821


@_query(f"@{_POINTS} SELECT item_id, t, round(x, 6) AS cx, round(y, 6) AS cy, 1.0::DOUBLE AS cz, round((x2 - x1) / 2, 6) AS hx, round((y2 - y1) / 2, 6) AS hy FROM det JOIN pts USING (item_id, t)")
def centres_and_extents(spark, sf_dir):
    c = centre(F.col("bbox"))
    h = half_extents(F.col("bbox"))
    return world(spark, sf_dir).bboxes.select("item_id", F.col("bbox.tmin").alias("t"), *[F.round(call(f"ST_{d.upper()}", c), 6).alias(f"c{d}") for d in "xyz"], *[F.round(h.getField(d), 6).alias(f"h{d}") for d in "xy"])


@_query("SELECT DISTINCT item_id, object_type, 'default_color' AS color FROM det WHERE object_type = 'click'")
def empty_projection(spark, sf_dir):
    return world(spark, sf_dir).predicate(lambda obj: obj.object_type == "click").execute().select("item_id", "object_type", "color")


@_query("SELECT object_type FROM (SELECT DISTINCT item_id, object_type FROM det)")
def deleted_column(spark, sf_dir):
    cleared = world(spark, sf_dir).predicate(lambda obj: obj.object_type == "none").get_time().clear()
    return cleared.selectkey().get_object_type().delete_column("item_id").execute()


_VIDEO = """640 / tan(radians(60)) AS fx, 360 / tan(radians(60)) AS fy"""


@_query(
    f"""@b AS (SELECT item_id, t, greatest(fx * x1, 0) AS x1, greatest(fy * y1, 0) AS y1, greatest(fx * x2, 0) AS x2, greatest(fy * y2, 0) AS y2 FROM det, (SELECT {_VIDEO}) WHERE object_type = 'click' AND {_MEETS}),
e AS (SELECT item_id, min(t) AS first_t, CAST(round_even(max(x2 - x1), 0) AS INTEGER) AS out_w, CAST(round_even(max(y2 - y1), 0) AS INTEGER) AS out_h FROM b GROUP BY item_id),
f AS (SELECT *, CAST(round((epoch_us(t) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6) AS INTEGER) AS frame, CAST(round((epoch_us(first_t) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6) AS INTEGER) AS f0 FROM b JOIN e USING (item_id))
SELECT 'north' AS camera_id, item_id, frame, frame - f0 AS frame_index, CAST(trunc(x1) AS INTEGER) AS x1, CAST(trunc(y1) AS INTEGER) AS y1, CAST(trunc(x2) AS INTEGER) AS x2, CAST(trunc(y2) AS INTEGER) AS y2, out_w, out_h,
  CAST(greatest(floor((out_w - trunc(x2 - x1)) / 2), 0) AS INTEGER) AS pad_x, CAST(greatest(floor((out_h - trunc(y2 - y1)) / 2), 0) AS INTEGER) AS pad_y, './output/events_' || item_id || '.mp4' AS path FROM f"""
)
def video_plan(spark, sf_dir):
    w = world(spark, sf_dir).camera("north", lens=LENS).camera("south", lens=PinholeLens((640, 480), (0.0, 0.0, 0.0), 90.0))
    return w.predicate(lambda obj: obj.object_type == "click").predicate(lambda obj: obj.location in VOLUME).get_video(["north"]).execute()


@_query(f"@{_POINTS} SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY t) - 1 AS INTEGER) AS point, round(fx * x, 4) AS u, round(fy * y, 4) AS v FROM pts, (SELECT {_VIDEO}) WHERE item_id LIKE 'click-%'")
def overlay_points(spark, sf_dir):
    w = world(spark, sf_dir).camera("north", lens=LENS)
    out = w.overlay_trajectory("north", w.predicate(lambda obj: obj.object_type == "click").selectkey().get_trajectory().execute())
    return out.select("item_id", "point", F.round("u", 4).alias("u"), F.round("v", 4).alias("v"))


@_query(f"SELECT item_id, t FROM det, (SELECT {_VIDEO}) WHERE x1 <= 11000.5 / fx AND x2 >= 3700.5 / fx AND y1 <= 12400.5 / fy AND y2 >= 4150.5 / fy")
def volume_of_pixels(spark, sf_dir):
    w = world(spark, sf_dir).camera("north", lens=LENS)
    volume = w.select_intersection_of_interest_or_use_default("north", False, ((3700.5, 12400.5), (11000.5, 4150.5)))
    return w.predicate(lambda obj: obj.location in volume).selectkey().get_time().execute()


@_query("SELECT DISTINCT r_name AS world_id, 'metrics' AS units FROM region UNION ALL SELECT DISTINCT n_name, 'feet' FROM nation", det=False)
def world_rows(spark, sf_dir):
    """The table of worlds: one for each region, and in other units for each nation."""
    made = lambda table, column, units: catalog.worlds_of(events.read(spark, sf_dir, table).select(F.col(column).alias("world_id"), F.lit(units).alias("units")))
    return catalog.upsert_worlds(made("region", "r_name", "metrics"), made("nation", "n_name", "feet"))


@_query(
    """SELECT *, '1' AS world, 'metrics' AS units, 90.0::DOUBLE AS new_lens_fov, 'pole' AS new_mount FROM (SELECT n_name AS camera_id, 0.5::DOUBLE AS ratio, 0.0::DOUBLE AS origin_x, NULL::DOUBLE AS focal_x, CAST(60 + 2 * n_nationkey AS INTEGER) AS fov FROM nation WHERE n_regionkey = 1 AND n_name NOT IN (SELECT min(n_name) FROM nation WHERE n_regionkey = 1)
UNION ALL SELECT min(n_name), 2.0, 0.0, round(640 / tan(radians(60)), 6), 120 FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'new', NULL, 0.0, round(320 / tan(radians(45)), 6), 90)""",
    det=False,
)
def camera_registry(spark, sf_dir):
    """Cameras put in, changed and taken out: one that is in the table is replaced, one that is in the world stays as it was."""
    table = events.cameras(spark, sf_dir)
    first = table.filter("world_id = '1'").agg(F.min("camera_id")).first()[0]
    gone = World(spark, "1", camera_table=table).camera("gone").clear_cameras().camera("other").remove_camera("other")
    w = gone.camera(first, catalog.Point("p", first, 7.0, 8.0, 9.0), 2.0, lens=PinholeLens((1, 1), fov=30.0)).camera(first, ratio=9.0).camera("new").add_properties("new", "pole", "mount")
    w = w.add_lens(first, LENS).add_lens("new", PinholeLens((640, 480), (0.0, 0.0, 0.0), 90.0))
    said = {"world": w.get_name(), "units": w.get_units(), "new_lens_fov": w.get_lens("new").fov, "new_mount": w.cameras["new"].properties["mount"]}
    return w.get_camera().select("camera_id", F.col("ratio").cast("double").alias("ratio"), "origin_x", F.round("focal_x", 6).alias("focal_x"), "fov", *[F.lit(v).alias(k) for k, v in said.items()])


@_query("SELECT DISTINCT item_id, object_type FROM det WHERE object_type IN ('click', 'view') UNION ALL SELECT 'dog-1', 'dog'")
def recognized_items(spark, sf_dir):
    """Items of two cameras' detections, one of them through a tracker, and one by hand, in a world whose tables were cleared."""
    d = events.detections(spark, sf_dir)
    w = world(spark, sf_dir).clear_tables().camera("a").camera("b").recognize("a", d.filter("object_type = 'click'")).recognize("b", tracker=lambda camera: d.filter("object_type = 'view'"))
    return w.item("dog-1", "a", "dog", (1, 1, 2, 2), 5).selectkey().get_object_type().execute()


@_query(
    """SELECT CAST(event_id // 200 AS INTEGER) AS frame, object_type || '-' || CAST(event_id % 50 AS VARCHAR) AS item_id, CAST(trunc(x1) AS INTEGER) AS x1, CAST(trunc(y2) AS INTEGER) AS y2
FROM det WHERE event_id % 3 > 0 AND event_id % 4 <= 1 AND object_type IN ('click', 'view')"""
)
def tracked_classes(spark, sf_dir):
    e = F.col("event_id")
    d = events.detections(spark, sf_dir).select(F.lit("cam1").alias("camera_id"), (e % 50).alias("track_id"), "object_type", F.floor(e / 200).cast("int").alias("frame"), "x1", "y1", "x2", "y2", (e % 3 > 0).alias("confirmed"), (e % 4).alias("frames_since_update"))
    return vision.confirmed_tracks(vision.allowed_classes(d, ["click", "view"])).select("frame", "item_id", "x1", "y2")


@_query(f"@{_POINTS}, {_STEPS} SELECT item_id, t, round(coalesce(sum(before) OVER (PARTITION BY item_id ORDER BY t), 0), 4) AS length FROM (SELECT item_id, t, lag(len) OVER (PARTITION BY item_id ORDER BY t) AS before FROM steps)")
def cumulative_length_running(spark, sf_dir):
    out = world(spark, sf_dir).selectkey().get_distance().execute().select("item_id", F.inline("distance"))
    return out.select("item_id", "t", F.round("length", 4).alias("length"))


@_query(f"@{_POINTS}, {_STEPS} SELECT item_id, round(coalesce(sum(len), 0), 4) AS length FROM steps GROUP BY item_id")
def cumulative_length_total(spark, sf_dir):
    return world(spark, sf_dir).selectkey().select_column("trajectory", tpoint.total_length, alias="length").execute().select("item_id", F.round("length", 4).alias("length"))


@_query(f"@{_POINTS}, {_STEPS} SELECT item_id, t, round(len / nullif((epoch_us(until) - epoch_us(t)) / 1e6, 0), 8) AS speed FROM steps WHERE until IS NOT NULL")
def speed_segments(spark, sf_dir):
    out = world(spark, sf_dir).selectkey().select_column("trajectory", tpoint.segments, alias="segments").execute()
    return out.select("item_id", F.inline("segments")).select("item_id", "t", F.round("speed", 8).alias("speed"))


@_query("SELECT item_id, min(x1) AS xmin, min(y1) AS ymin, max(x2) AS xmax, max(y2) AS ymax FROM det GROUP BY item_id")
def largest_bbox(spark, sf_dir):
    return world(spark, sf_dir).trajectories.select("item_id", *[F.col(f"largest_bbox.{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@_query("SELECT event_id, round(x1 / (640 / tan(radians(60))), 6) AS wx, round(y1 / (360 / tan(radians(60))), 6) AS wy, 1.0::DOUBLE AS wz FROM det")
def pixel_to_world_pinhole(spark, sf_dir):
    x, y, z = LENS.pixel_to_world(F.col("x1"), F.col("y1"), F.lit(1.0))
    return events.detections(spark, sf_dir).select("event_id", F.round(x, 6).alias("wx"), F.round(y, 6).alias("wy"), z.alias("wz"))


@_query("SELECT event_id, round(x1 * 640 / tan(radians(60)), 4) AS u, round(y1 * 360 / tan(radians(60)), 4) AS v FROM det")
def world_to_pixel_pinhole(spark, sf_dir):
    u, v = LENS.world_to_pixel(F.col("x1"), F.col("y1"), F.lit(1.0))
    return events.detections(spark, sf_dir).select("event_id", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"))


# Yaw 0.1, pitch 0.2, roll 0.3, origin (1, 2, 3), written out: rows of the rotation, and its product with the origin.
_VR = """r AS (SELECT cos(0.2) * cos(0.1) AS r1, cos(0.2) * sin(0.1) AS r2, -sin(0.2) AS r3,
  sin(0.3) * sin(0.2) * cos(0.1) - cos(0.3) * sin(0.1) AS r4, sin(0.3) * sin(0.2) * sin(0.1) + cos(0.3) * cos(0.1) AS r5, sin(0.3) * cos(0.2) AS r6,
  cos(0.3) * sin(0.2) * cos(0.1) + sin(0.3) * sin(0.1) AS r7, cos(0.3) * sin(0.2) * sin(0.1) - sin(0.3) * cos(0.1) AS r8, cos(0.3) * cos(0.2) AS r9),
o AS (SELECT *, r1 + 2 * r2 + 3 * r3 AS a, r4 + 2 * r5 + 3 * r6 AS b, r7 + 2 * r8 + 3 * r9 AS c FROM r)"""


@_query(
    f"""@{_VR} SELECT event_id, round(r1 * x1 + r2 * y1 + r3 - a, 6) AS wx, round(r4 * x1 + r5 * y1 + r6 - b, 6) AS wy, round(r7 * x1 + r8 * y1 + r9 - c, 6) AS wz,
  round(r1 * (x1 + a) + r4 * (y1 + b) + r7 * (1 + c), 6) AS u, round(r2 * (x1 + a) + r5 * (y1 + b) + r8 * (1 + c), 6) AS v FROM det, o"""
)
def vr_world(spark, sf_dir):
    w = VR.pixel_to_world(F.col("x1"), F.col("y1"), F.lit(1.0))
    p = VR.world_to_pixel(F.col("x1"), F.col("y1"), F.lit(1.0))
    return events.detections(spark, sf_dir).select("event_id", *[F.round(c, 6).alias(n) for c, n in zip([*w, *p], ("wx", "wy", "wz", "u", "v"), strict=True)])


@_query("SELECT n_name AS camera_id, n_regionkey::VARCHAR AS world_id, CAST(60 + 2 * n_nationkey AS INTEGER) AS fov FROM nation", det=False)
def camera_catalog(spark, sf_dir):
    return events.cameras(spark, sf_dir).select("camera_id", "world_id", "fov")


@_query("SELECT n_name AS camera_id, 0.0::DOUBLE AS origin_x, CAST(60 + 2 * n_nationkey AS INTEGER) AS fov FROM nation WHERE n_regionkey = 1 AND n_name IN ('CANADA', 'BRAZIL', 'NATION_1', 'NATION_6')", det=False)
def camera_by_id(spark, sf_dir):
    return catalog.fetch_cameras(events.cameras(spark, sf_dir), "1", ["CANADA", "BRAZIL", "NATION_1", "NATION_6"]).select("camera_id", "origin_x", "fov")


@_query("SELECT object_type, count(DISTINCT item_id) AS count FROM det GROUP BY object_type")
def count_by_type(spark, sf_dir):
    return world(spark, sf_dir).group("object_type").count().execute()


@_query("SELECT count(DISTINCT item_id) AS count, count(*) AS boxes FROM det")
def count_distinct_keys(spark, sf_dir):
    return world(spark, sf_dir).count("object_id", distinct=True).count("timestamp", alias="boxes").execute()


@_query("SELECT item_id, count(*) AS count FROM det GROUP BY item_id HAVING count(*) >= 15")
def group_having(spark, sf_dir):
    return world(spark, sf_dir).group("object_id").count("location").predicate(lambda obj: count(obj) >= 15).execute()  # noqa: F821


@_query(f"SELECT d.item_id, t FROM det d JOIN (SELECT DISTINCT item_id FROM det WHERE object_type = 'error' AND {_MEETS}) USING (item_id) WHERE {_IN_TIME}")
def view_join(spark, sf_dir):
    w = world(spark, sf_dir)
    w.predicate(lambda obj: obj.object_type == "error").predicate(lambda obj: obj.location in VOLUME).selectkey(distinct=True).execute(create_view=True, view_name="vs_errors")
    return w.join("vs_errors").interval(INTERVAL).selectkey().get_time().execute()


@_query("SELECT item_id, t, region_id FROM det JOIN (VALUES (1, 0, 0, 20, 20), (2, 50, 50, 90, 90)) r(region_id, a, b, c, d) ON x1 <= c AND x2 >= a AND y1 <= d AND y2 >= b")
def overlap_join_regions(spark, sf_dir):
    regions = spark.createDataFrame([(1, 0.0, 0.0, 20.0, 20.0), (2, 50.0, 50.0, 90.0, 90.0)], "region_id int, a double, b double, c double, d double")
    regions = regions.select("region_id", stbox("a", "b", F.lit(0.0), "c", "d", F.lit(2.0)).alias("region"))
    return overlap_join(world(spark, sf_dir).bboxes.select("item_id", "bbox"), regions).select("item_id", F.col("bbox.tmin").alias("t"), "region_id")


@_query(f"@{_POINTS} SELECT item_id, count(*) AS n, round(sum(x), 4) AS sx FROM pts WHERE item_id IN (SELECT item_id FROM det WHERE object_type = 'click' AND {_MEETS} AND {_IN_TIME}) GROUP BY item_id")
def semi_trajectories(spark, sf_dir):
    w = world(spark, sf_dir)
    chosen = w.predicate(lambda obj: obj.object_type == "click").predicate(lambda obj: obj.location in VOLUME).interval(INTERVAL).selectkey(distinct=True).execute()
    points = with_items(w.trajectories, chosen).select("item_id", F.explode("traj").alias("p"))
    return points.groupBy("item_id").agg(F.count("*").alias("n"), F.round(F.sum("p.x"), 4).alias("sx"))


@_query("SELECT item_id, t FROM det")
def merge_trajectory(spark, sf_dir):
    bboxes = world(spark, sf_dir).bboxes
    day = lambda d: F.lit(datetime(2024, 1, d)).cast("timestamp_ntz")
    old, new = bboxes.filter(F.col("bbox.tmin") < day(12)), bboxes.filter(F.col("bbox.tmin") >= day(8))
    return merge_boxes(old, new).select("item_id", F.col("bbox.tmin").alias("t"))


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.detections(spark, sf_dir).select("item_id", "t", "x1", "y1", "x2", "y2")


@_query("SELECT item_id, min(t) AS first_t, max(t) AS last_t, CAST(round_even(max(x2 - x1), 0) AS INTEGER) AS out_w, CAST(round_even(max(y2 - y1), 0) AS INTEGER) AS out_h FROM det GROUP BY item_id")
def roi_extent(spark, sf_dir):
    return video.roi_extent(_pixels(spark, sf_dir))


@_query(
    """@e AS (SELECT item_id, min(t) AS first_t, CAST(round_even(max(x2 - x1), 0) AS INTEGER) AS out_w, CAST(round_even(max(y2 - y1), 0) AS INTEGER) AS out_h FROM det GROUP BY item_id),
r AS (SELECT item_id, CAST(round((epoch_us(t) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6) AS INTEGER) AS frame, CAST(round((epoch_us(first_t) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6) AS INTEGER) AS f0,
  greatest(x1, 0) AS x1, greatest(y1, 0) AS y1, greatest(x2, 0) AS x2, greatest(y2, 0) AS y2, out_w, out_h FROM det JOIN e USING (item_id))
SELECT item_id, frame, frame - f0 AS frame_index, CAST(trunc(x1) AS INTEGER) AS x1, CAST(trunc(y1) AS INTEGER) AS y1, CAST(trunc(x2) AS INTEGER) AS x2, CAST(trunc(y2) AS INTEGER) AS y2, out_w, out_h,
  CAST(greatest(floor((out_w - trunc(abs(x2 - x1))) / 2), 0) AS INTEGER) AS pad_x, CAST(greatest(floor((out_h - trunc(abs(y2 - y1))) / 2), 0) AS INTEGER) AS pad_y, './output/' || item_id || '.mp4' AS path FROM r"""
)
def roi_plan(spark, sf_dir):
    return video.roi_plan(_pixels(spark, sf_dir), START)


@_query("SELECT unnest([object_type, item_id]) AS label, event_id, least(greatest(CAST(trunc(x1 * 100 - 500) AS INTEGER), 0), 3840) AS x1, least(greatest(CAST(y1 * 30 AS INTEGER), 0), 2160) AS y1, least(greatest(CAST(trunc(x2 * 100 - 500) AS INTEGER), 0), 3840) AS x2, least(greatest(CAST(y2 * 30 AS INTEGER), 0), 2160) AS y2 FROM det")
def label_rows_clamped(spark, sf_dir):
    d = events.detections(spark, sf_dir).select("item_id", "object_type", F.col("event_id").alias("frame"), (F.col("x1") * 100 - 500).cast("int").alias("x1"), (F.col("y1") * 30).cast("int").alias("y1"), (F.col("x2") * 100 - 500).cast("int").alias("x2"), (F.col("y2") * 30).cast("int").alias("y2"))
    return label_rows(d, "m").select("label", F.col("frame").alias("event_id"), "x1", "y1", "x2", "y2")


_DEPTH = "p AS (SELECT CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 % 100 AS INTEGER) AS y, event_id // 10000 AS frame, (event_id % 97 + 1) / 100.0::DOUBLE AS disp, (event_id % 13) / 13.0::DOUBLE AS value FROM events)"


def _depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = events.read(spark, sf_dir, "events")
    return rows.select((e % 100).cast("int").alias("x"), (F.floor(e / 100) % 100).cast("int").alias("y"), F.floor(e / 10000).alias("frame"), ((e % 97 + 1) / F.lit(100.0)).alias("disp"), ((e % 13) / F.lit(13.0)).alias("value"))


@_query(f"WITH {_DEPTH} SELECT frame, y, x, round(1 / (0.01 + 9.99 * disp), 8) AS depth FROM p", det=False)
def disp_to_depth(spark, sf_dir):
    return _depth(spark, sf_dir).select("frame", "y", "x", F.round(vision.disp_to_depth(F.col("disp")), 8).alias("depth"))


@_query(
    f"""WITH {_DEPTH}, q AS (SELECT disp AS gt, disp * (0.8 + 0.5 * value) AS pred FROM p)
SELECT round(avg(abs(gt - pred) / gt), 6) AS abs_rel, round(avg((gt - pred) * (gt - pred) / gt), 6) AS sq_rel, round(sqrt(avg((gt - pred) * (gt - pred))), 6) AS rmse, round(sqrt(avg(power(ln(gt) - ln(pred), 2))), 6) AS rmse_log,
  round(avg(CASE WHEN greatest(gt / pred, pred / gt) < 1.25 THEN 1.0 ELSE 0.0 END), 6) AS a1, round(avg(CASE WHEN greatest(gt / pred, pred / gt) < 1.5625 THEN 1.0 ELSE 0.0 END), 6) AS a2,
  round(avg(CASE WHEN greatest(gt / pred, pred / gt) < 1.953125 THEN 1.0 ELSE 0.0 END), 6) AS a3 FROM q""",
    det=False,
)
def depth_metrics(spark, sf_dir):
    out = vision.depth_metrics(_depth(spark, sf_dir).select(F.col("disp").alias("gt"), (F.col("disp") * (0.8 + 0.5 * F.col("value"))).alias("pred")))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@_query(
    f"""WITH {_DEPTH}, a AS (SELECT frame, avg(v) AS s FROM (SELECT frame, abs(disp - lead(disp) OVER w) * exp(-abs(value - lead(value) OVER w)) AS v FROM p WINDOW w AS (PARTITION BY frame, y ORDER BY x)) GROUP BY frame),
b AS (SELECT frame, avg(v) AS s FROM (SELECT frame, abs(disp - lead(disp) OVER w) * exp(-abs(value - lead(value) OVER w)) AS v FROM p WINDOW w AS (PARTITION BY frame, x ORDER BY y)) GROUP BY frame)
SELECT frame, round(a.s + b.s, 6) AS smoothness FROM a JOIN b USING (frame)""",
    det=False,
)
def smoothness(spark, sf_dir):
    return vision.smoothness(_depth(spark, sf_dir)).select("frame", F.round("smoothness", 6).alias("smoothness"))


@_query(
    """@b AS (SELECT CAST(event_id // 200 AS INTEGER) AS frame, object_type, (event_id % 11) / 10.0::DOUBLE AS score, x1, y1, x2, y2 FROM det),
r AS (SELECT *, row_number() OVER (PARTITION BY frame, object_type ORDER BY score DESC, x1, y1, x2, y2) AS i FROM b WHERE score >= 0.5),
k AS (
  SELECT frame, object_type, i, [{'score': score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}] AS kept FROM r WHERE i = 1
  UNION ALL SELECT r.frame, r.object_type, r.i, CASE WHEN len(kept) < 50 AND len(list_filter(kept, lambda o:
      greatest(0, least(o.x2, r.x2) - greatest(o.x1, r.x1)) * greatest(0, least(o.y2, r.y2) - greatest(o.y1, r.y1)) > 0.45 * ((o.x2 - o.x1) * (o.y2 - o.y1) + (r.x2 - r.x1) * (r.y2 - r.y1)
        - greatest(0, least(o.x2, r.x2) - greatest(o.x1, r.x1)) * greatest(0, least(o.y2, r.y2) - greatest(o.y1, r.y1))))) = 0
    THEN list_append(kept, {'score': r.score, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}) ELSE kept END
  FROM k JOIN r ON r.frame = k.frame AND r.object_type = k.object_type AND r.i = k.i + 1),
l AS (SELECT frame, object_type, unnest(arg_max(kept, i)) AS o FROM k GROUP BY frame, object_type),
f AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY o.score DESC, object_type, o.x1, o.y1, o.x2, o.y2) AS n FROM l)
SELECT 'cam1' AS camera_id, frame, object_type, o.score AS score, o.x1 AS x1, o.y1 AS y1, o.x2 AS x2, o.y2 AS y2 FROM f WHERE n <= 50"""
)
def nms_per_frame(spark, sf_dir):
    d = events.detections(spark, sf_dir)
    b = d.select(F.lit("cam1").alias("camera_id"), F.floor(F.col("event_id") / 200).cast("int").alias("frame"), "object_type", ((F.col("event_id") % 11) / 10.0).alias("score"), "x1", "y1", "x2", "y2")
    return vision.non_max_suppression(b)


def _suppression(name: str, rows: str, iou: float) -> str:
    """SQL that suppresses the boxes of a table one after the other and leaves 50 a frame in table ``name``."""
    shared = "greatest(0, least(o.x2, r.x2) - greatest(o.x1, r.x1)) * greatest(0, least(o.y2, r.y2) - greatest(o.y1, r.y1))"
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY frame, object_type ORDER BY score DESC, x1, y1, x2, y2) AS i FROM {rows} WHERE score >= 0.5),
{name}_k AS (
  SELECT frame, object_type, i, [{{'score': score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM {name}_r WHERE i = 1
  UNION ALL SELECT r.frame, r.object_type, r.i, CASE WHEN len(kept) < 50 AND len(list_filter(kept, lambda o: {shared} > {iou} * ((o.x2 - o.x1) * (o.y2 - o.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - {shared}))) = 0
    THEN list_append(kept, {{'score': r.score, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}}) ELSE kept END
  FROM {name}_k k JOIN {name}_r r ON r.frame = k.frame AND r.object_type = k.object_type AND r.i = k.i + 1),
{name}_l AS (SELECT frame, object_type, unnest(arg_max(kept, i)) AS o FROM {name}_k GROUP BY frame, object_type),
{name}_n AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY o.score DESC, object_type, o.x1, o.y1, o.x2, o.y2) AS n FROM {name}_l),
{name} AS (SELECT frame, object_type, o.score AS score, o.x1 AS x1, o.y1 AS y1, o.x2 AS x2, o.y2 AS y2 FROM {name}_n WHERE n <= 50)"""


@_query(
    f"""@b AS (SELECT CAST(event_id // 200 AS INTEGER) AS frame, object_type, (event_id % 11) / 10.0::DOUBLE AS score, x1, y1, x2, y2 FROM det),
{_suppression("once", "b", 0.45)}, {_suppression("twice", "once", 0.1)}
SELECT 'cam1' AS camera_id, * FROM twice"""
)
def second_suppression(spark, sf_dir):
    """What a detector's suppression leaves is suppressed once more, by a threshold of its own, before it is tracked."""
    return vision.non_max_suppression(nms_per_frame(spark, sf_dir), iou=0.1)


@_query(f"SELECT object_type, count(*) AS n FROM det WHERE {_MEETS} GROUP BY object_type")
def overlap_counts(spark, sf_dir):
    typed = boxes(events.detections(spark, sf_dir))
    return typed.filter(overlaps(F.col("bbox"), VOLUME)).groupBy("object_type").agg(F.count("*").alias("n"))


@_query("SELECT item_id, CAST(round((epoch_us(min(t)) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6) AS INTEGER) AS first_frame, CAST(round((epoch_us(max(t)) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6) AS INTEGER) AS last_frame FROM det GROUP BY item_id")
def frame_span(spark, sf_dir):
    return video.frame_span(world(spark, sf_dir).bboxes, START)


@_query("SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY t) - 1 AS INTEGER) AS n, t, x1 AS xmin, y1 AS ymin, x2 AS xmax, y2 AS ymax FROM det")
def item_tracks(spark, sf_dir):
    out = video.item_tracks(world(spark, sf_dir).bboxes).select("item_id", F.posexplode("track").alias("n", "p"))
    return out.select("item_id", "n", F.col("p.t").alias("t"), *[F.col(f"p.bbox.{d}").alias(d) for d in ("xmin", "ymin", "xmax", "ymax")])


@_query(
    """@c AS (SELECT n_name AS camera_id, 640 / tan(radians((60 + 2 * n_nationkey) / 2.0)) AS fx, 360 / tan(radians((60 + 2 * n_nationkey) / 2.0)) AS fy FROM nation)
SELECT camera_id, item_id, t, round(fx * x1, 4) AS x1, round(fy * y1, 4) AS y1, round(fx * x2, 4) AS x2, round(fy * y2, 4) AS y2 FROM det, c"""
)
def project_boxes(spark, sf_dir):
    half = F.tan(F.radians(F.col("fov") / 2))
    cameras = events.cameras(spark, sf_dir).withColumn("focal", F.struct((640 / half).alias("x"), (360 / half).alias("y")))
    out = video.project_boxes(world(spark, sf_dir).bboxes, cameras)
    return out.select("camera_id", "item_id", "t", *[F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")])


@_query("SELECT item_id, count(*) AS points, min(t) AS first_t, max(t) AS last_t FROM det GROUP BY item_id")
def merged_trajectories(spark, sf_dir):
    d = events.detections(spark, sf_dir)
    day = lambda n: F.lit(datetime(2024, 1, n)).cast("timestamp_ntz")
    old, new = (ingest(d.filter(c))[0] for c in (F.col("t") < day(12), F.col("t") >= day(8)))
    traj = F.col("traj")
    return merge_trajectories(old, new).select("item_id", F.size(traj).cast("long").alias("points"), F.get(traj, F.lit(0))["t"].alias("first_t"), F.element_at(traj, -1)["t"].alias("last_t"))


_K = np.array([[100.0, 0, 50, 0], [0, 80, 40, 0], [0, 0, 1, 0]])


@_query(
    f"""WITH {_DEPTH}, q AS (SELECT frame, y, x, 1 / (0.01 + 9.99 * disp) AS d FROM p)
SELECT frame, y, x, round(d * (x - 50) / 97, 5) AS px, round(d * (y - 40) / 83, 5) AS py, round(d, 5) AS pz FROM q""",
    det=False,
)
def back_project(spark, sf_dir):
    p = _depth(spark, sf_dir).withColumn("d", vision.disp_to_depth(F.col("disp")))
    cloud = vision.back_project(F.col("d"), F.col("x"), F.col("y"), np.array([[97.0, 0, 50], [0, 83, 40], [0, 0, 1]]))
    return p.select("frame", "y", "x", *[F.round(c, 5).alias(n) for c, n in zip(cloud, ("px", "py", "pz"), strict=True)])


@_query(
    f"""WITH {_DEPTH} SELECT frame, y, x, round(((100 * value + 50 * disp) / (disp + 1e-7) / 99 - 0.5) * 2, 5) AS u, round(((80 * value + 40 * disp) / (disp + 1e-7) / 99 - 0.5) * 2, 5) AS v FROM p""",
    det=False,
)
def project_points(spark, sf_dir):
    u, v = vision.project_points(F.col("value"), F.col("value"), F.col("disp"), _K, 100, 100)
    return _depth(spark, sf_dir).select("frame", "y", "x", F.round(u, 5).alias("u"), F.round(v, 5).alias("v"))


@_query(f"WITH {_DEPTH} SELECT frame, y * 2 + dy AS y, x * 2 + dx AS x, disp FROM p, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx)", det=False)
def upsample(spark, sf_dir):
    return vision.upsample(_depth(spark, sf_dir).select("frame", "y", "x", "disp"))


@_query(
    f"""WITH {_DEPTH}, m AS (SELECT frame, max(y) AS my, max(x) AS mx FROM p GROUP BY frame),
n AS (SELECT p.frame, p.y, p.x, CASE WHEN p.y + dy < 0 THEN 1 WHEN p.y + dy > my THEN my - 1 ELSE p.y + dy END AS ny, CASE WHEN p.x + dx < 0 THEN 1 WHEN p.x + dx > mx THEN mx - 1 ELSE p.x + dx END AS nx
  FROM p JOIN m USING (frame), (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx)),
s AS (SELECT n.frame, n.y, n.x, avg(q.disp) AS a, avg(q.value) AS b, avg(q.disp * q.disp) AS aa, avg(q.value * q.value) AS bb, avg(q.disp * q.value) AS ab
  FROM n JOIN p q ON q.frame = n.frame AND q.y = n.ny AND q.x = n.nx GROUP BY n.frame, n.y, n.x)
SELECT frame, y, x, round(least(greatest((1 - (2 * a * b + 0.0001) * (2 * (ab - a * b) + 0.0009) / ((a * a + b * b + 0.0001) * (aa - a * a + bb - b * b + 0.0009))) / 2, 0), 1), 6) AS ssim FROM s""",
    det=False,
)
def ssim(spark, sf_dir):
    p = _depth(spark, sf_dir)
    out = vision.ssim(p.select("frame", "y", "x", F.col("disp").alias("value")), p.select("frame", "y", "x", "value"))
    return out.select("frame", "y", "x", F.round("ssim", 6).alias("ssim"))


_RIGID = vision.rigid((0.1, 0.2, 0.3), (1.0, 2.0, 3.0))


@_query(
    """@k AS (SELECT sqrt(0.01 + 0.04 + 0.09) AS g), u AS (SELECT cos(g) AS c, sin(g) AS s, 0.1 / (g + 1e-7) AS x, 0.2 / (g + 1e-7) AS y, 0.3 / (g + 1e-7) AS z FROM k)
SELECT event_id, round((c + (1 - c) * x * x) * x1 + ((1 - c) * x * y - s * z) * y1 + ((1 - c) * x * z + s * y) + 1, 6) AS px,
  round(((1 - c) * x * y + s * z) * x1 + (c + (1 - c) * y * y) * y1 + ((1 - c) * y * z - s * x) + 2, 6) AS py, round(((1 - c) * x * z - s * y) * x1 + ((1 - c) * y * z + s * x) * y1 + (c + (1 - c) * z * z) + 3, 6) AS pz FROM det, u"""
)
def rigid_transform(spark, sf_dir):
    p = vision.transform_point(_RIGID, F.col("x1"), F.col("y1"), F.lit(1.0))
    return events.detections(spark, sf_dir).select("event_id", *[F.round(c, 6).alias(n) for c, n in zip(p, ("px", "py", "pz"), strict=True)])


@_query(
    """WITH e AS (SELECT vec_id, embedding FROM embeddings), a AS (SELECT vec_id AS anchor_id, embedding AS anchor FROM embeddings WHERE vec_id % 100 = 0)
SELECT vec_id, anchor_id FROM e, a WHERE 1 - list_sum(list_transform(list_zip(embedding, anchor), lambda z: z[1]::DOUBLE * z[2])) / sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v)) * list_sum(list_transform(anchor, lambda v: v::DOUBLE * v))) <= 0.4""",
    det=False,
)
def appearance_gate(spark, sf_dir):
    e = events.read(spark, sf_dir, "embeddings")
    return vision.cosine_pairs(e, e.filter("vec_id % 100 = 0"))


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of 25 cameras with the look of their user: the vector of that id."""
    looks = events.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("user_id"), "embedding")
    user = F.element_at(F.split("item_id", "-"), -1).cast("long")
    d = events.detections(spark, sf_dir).select((user % 25).cast("string").alias("camera_id"), F.floor(F.col("event_id") / 40).cast("int").alias("frame"), "object_type", "x1", "y1", "x2", "y2", user.alias("user_id"))
    return d.join(looks, "user_id", "left")


#: Users come back after frames without them, so one detection makes a track, and looks alone tell where it goes on.
TRACKING = tracking.Rules(motion_gate=None, hits=1)


@_query(None)
def track_association(spark, sf_dir):
    """Items of detections that are associated by look and motion, frame by frame, in each camera."""
    return vision.confirmed_tracks(tracking.track(_seen(spark, sf_dir), TRACKING)).select("camera_id", "item_id", "frame", "x1", "y1", "x2", "y2")


@_query(
    """SELECT a.item_id AS a, b.item_id AS b, a.t AS at, b.t AS bt FROM det a JOIN det b ON a.object_type = 'click' AND b.object_type = 'view' AND a.x1 <= b.x2 AND a.x2 >= b.x1 AND a.y1 <= b.y2 AND a.y2 >= b.y1
  AND a.t <= b.t + INTERVAL 1 HOUR AND b.t <= a.t + INTERVAL 1 HOUR"""
)
def objects_meet(spark, sf_dir):
    """Objects of two types that are at one place within an hour: a join of boxes with boxes in space and time."""
    d = boxes(events.detections(spark, sf_dir))
    lasting = F.col("bbox").withField("tmax", F.col("bbox.tmin") + F.expr("interval 1 hour"))
    of = lambda kind, item, box: d.filter(F.col("object_type") == kind).select(F.col("item_id").alias(item), lasting.alias(box))
    return overlap_join(of("click", "a", "bbox"), of("view", "b", "region")).select("a", "b", F.col("bbox.tmin").alias("at"), F.col("region.tmin").alias("bt"))


def _pictures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Boxes of items by frame, and a picture of 32 x 24 pixels of each hundred events, one pixel an event."""
    d, e = events.detections(spark, sf_dir), F.col("event_id")
    frame = F.floor(e / 100).cast("int")
    placed = d.select("item_id", frame.alias("frame"), (F.floor("x1").cast("int") % 20).alias("x1"), (F.col("y1").cast("int") % 16).alias("y1"), (1 + e % 9).cast("int").alias("w"), (1 + e % 7).cast("int").alias("h"))
    found = placed.groupBy("item_id", "frame").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max(F.col("x1") + F.col("w")).alias("x2"), F.max(F.col("y1") + F.col("h")).alias("y2"))
    at = F.map_from_entries(F.collect_list(F.struct((e * 7919 % 768).cast("int"), F.lpad(F.hex(e % 251), 2, "0"))))
    dots = F.col("dots")
    # Each dot after the dark pixels since the one before it.
    lit_ = F.transform(dots, lambda p, i: F.concat(F.repeat(F.lit("00"), p["key"] - 1 - F.coalesce(F.get(dots, i - 1)["key"], F.lit(-1))), p["value"]))
    hexes = F.concat(F.array_join(lit_, ""), F.repeat(F.lit("00"), 767 - F.element_at(dots, -1)["key"]))
    frames = d.groupBy(frame.alias("frame")).agg(F.array_sort(F.map_entries(at)).alias("dots")).select("frame", F.lit(32).alias("width"), F.lit(24).alias("height"), F.unhex(hexes).alias("data"))
    return found.withColumn("t", tpoint.time_of_frame(F.col("frame"), START)), frames


@_query(
    """@e AS (SELECT event_id, item_id, event_id // 100 AS frame, CAST(floor(x1) AS INTEGER) % 20 AS x1, CAST(y1 AS INTEGER) % 16 AS y1, 1 + event_id % 9 AS w, 1 + event_id % 7 AS h FROM det),
b AS (SELECT item_id, frame, min(x1) AS x1, min(y1) AS y1, max(x1 + w) AS x2, max(y1 + h) AS y2 FROM e GROUP BY ALL),
c AS (SELECT *, max(x2 - x1) OVER (PARTITION BY item_id) AS out_w, max(y2 - y1) OVER (PARTITION BY item_id) AS out_h, frame - min(frame) OVER (PARTITION BY item_id) AS frame_index FROM b),
p AS (SELECT frame, event_id * 7919 % 768 % 32 AS x, event_id * 7919 % 768 // 32 AS y, event_id % 251 AS v FROM e)
SELECT item_id, CAST(frame_index AS INTEGER) AS frame_index, CAST(out_w AS INTEGER) AS width, CAST(out_h AS INTEGER) AS height,
  CAST(coalesce(sum(v * (1 + (y - y1 + (out_h - y2 + y1) // 2) * out_w + x - x1 + (out_w - x2 + x1) // 2)), 0) AS BIGINT) AS checksum
FROM c LEFT JOIN p ON p.frame = c.frame AND x >= x1 AND x < x2 AND y >= y1 AND y < y2 GROUP BY item_id, frame_index, out_w, out_h"""
)
def roi_videos(spark, sf_dir):
    """Regions of items are cropped, padded and written as videos, a file an item, and read back frame by frame."""
    found, frames = _pictures(spark, sf_dir)
    path = roi_video.shared_folder(spark, "videos")
    roi_video.write_videos(roi_video.canvases(video.roi_plan(found, START), frames), path)
    return roi_video.read_videos(spark, path).select("item_id", "frame_index", "width", "height", roi_video.checksum(F.col("data")).alias("checksum"))


@_query(
    f"""@{_POINTS} SELECT item_id, t FROM pts WHERE t >= TIMESTAMP '2024-01-03' AND t < TIMESTAMP '2024-01-09' OR t >= TIMESTAMP '2024-01-15' AND t < TIMESTAMP '2024-01-16'"""
)
def trajectory_periods(spark, sf_dir):
    """The part of each trajectory in a set of periods, three of which overlap or touch."""
    day = lambda n: datetime(2024, 1, n)
    some = [(day(5), day(7)), (day(15), day(16)), (day(3), day(6)), (day(7), day(9)), (day(20), day(20))]
    out = world(spark, sf_dir).selectkey().select_column("trajectory", tpoint.at_periods, some, alias="part").execute()
    return out.select("item_id", F.explode("part").alias("p")).select("item_id", "p.t")


@_query(f"SELECT DISTINCT item_id FROM det WHERE object_type = 'click' AND {_MEETS} AND {_IN_TIME}")
def stored_flagship(spark, sf_dir):
    """The flagship over tables that are written along the curve, of two cameras one after the other, and read back."""
    d = events.detections(spark, sf_dir).withColumn("camera_id", F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd"))
    path = roi_video.shared_folder(spark, "store")
    for camera in ("even", "odd", "even"):  # what is written again takes its own place
        store.write_tables(*ingest(d.filter(F.col("camera_id") == camera)), path)
    stored = World(spark, "events", start_time=START).with_tables(*store.read_tables(spark, path))
    clicks = stored.predicate(lambda obj: obj.object_type == "click").predicate(lambda obj: obj.location in VOLUME)
    return clicks.interval(INTERVAL).selectkey(distinct=True).execute()


#: 25 videos of 10 events a frame; pictures as in ``_pictures``.
TILES = tiling.TileCosts(32, 24, segment_frames=25)
#: Number of the cut (0 to 3) to which an end of the region h goes in the layout cut at l.
_CUT = {
    (axis, end): f"CASE WHEN h.{axis}{end} {'<' if end == 1 else '>'} l.{axis}{end} THEN {0 if end == 1 else 3} WHEN h.{axis}{end} {'<' if end == 1 else '>'} l.{axis}{3 - end} THEN {end} ELSE {3 - end} END"
    for axis in "xy"
    for end in (1, 2)
}


@_query(
    f"""@b AS (SELECT CAST(split_part(item_id, '-', 2) AS BIGINT) % 25 AS video, event_id // 10 AS frame, object_type AS label, t, CAST(floor(x1) AS BIGINT) % 20 AS x1, CAST(y1 AS BIGINT) % 16 AS y1, 1 + event_id % 9 AS w, 1 + event_id % 7 AS h FROM det),
h AS (SELECT video, frame // 25 AS segment, label, min(x1) AS x1, min(y1) AS y1, max(x1 + w) AS x2, max(y1 + h) AS y2 FROM b GROUP BY ALL),
q AS (SELECT row_number() OVER (ORDER BY day, label) AS seq, * FROM (SELECT date_trunc('day', t) AS day, label, max(frame) AS last FROM b GROUP BY ALL)),
g AS (SELECT h.video, h.segment, h.label AS asked, l.label, {_CUT["x", 1]} AS xa, {_CUT["x", 2]} AS xb, {_CUT["y", 1]} AS ya, {_CUT["y", 2]} AS yb, [0, l.x1, l.x2, 32] AS xs, [0, l.y1, l.y2, 24] AS ys FROM h JOIN h l USING (video, segment)),
p AS (SELECT video, segment, asked, list_prepend('whole', list(label ORDER BY label)) AS names, list_prepend(32 * 24 * 25 + 200, list(CAST((xs[xb + 1] - xs[xa + 1]) * (ys[yb + 1] - ys[ya + 1]) * 25 + 200 * (xb - xa) * (yb - ya) AS BIGINT) ORDER BY label)) AS c FROM g GROUP BY ALL),
s AS (SELECT video, segment, seq, names, c, row_number() OVER (PARTITION BY video, segment ORDER BY seq) AS i FROM p JOIN q ON q.label = p.asked AND segment * 25 <= q.last),
r AS (SELECT video, segment, 0 AS i, 0 AS seq, 1 AS cur, list_transform(c, lambda z: 0::BIGINT) AS g, 0::BIGINT AS cost, false AS retiled, '' AS layout FROM s WHERE i = 1
  UNION ALL SELECT video, segment, i, seq, CASE WHEN list_max(g) > {TILES.retile} THEN list_position(g, list_max(g)) ELSE cur END, CASE WHEN list_max(g) > {TILES.retile} THEN list_transform(g, lambda z: 0::BIGINT) ELSE g END, c[cur], list_max(g) > {TILES.retile},
    names[CASE WHEN list_max(g) > {TILES.retile} THEN list_position(g, list_max(g)) ELSE cur END]
  FROM (SELECT s.video, s.segment, s.i, s.seq, r.cur, s.names, s.c, list_transform(list_zip(r.g, s.c), lambda z: z[1] + s.c[r.cur] - z[2]) AS g FROM r JOIN s ON s.video = r.video AND s.segment = r.segment AND s.i = r.i + 1))
SELECT video, segment, seq, layout, cost, retiled FROM r WHERE i > 0"""
)
def tile_regret(spark, sf_dir):
    """Segments of videos are tiled anew where the queries so far, one a day and type for all frames until then, would have gained more than that costs."""
    d, e = events.detections(spark, sf_dir), F.col("event_id")
    at = [(F.floor("x1").cast("long") % 20).alias("x1"), (F.col("y1").cast("long") % 16).alias("y1")]
    b = d.select((F.element_at(F.split("item_id", "-"), -1).cast("long") % 25).alias("video"), F.floor(e / 10).cast("long").alias("frame"), F.col("object_type").alias("label"), "t", *at, e)
    b = b.withColumns({"x2": F.col("x1") + 1 + e % 9, "y2": F.col("y1") + 1 + e % 7})
    asked = b.groupBy(F.date_trunc("day", "t").alias("day"), "label").agg(F.max("frame").alias("last_frame"))
    order = F.array_sort(F.collect_list(F.struct("day", "label", "last_frame")))  # a row a day and label
    asked = asked.agg(order.alias("q")).select(F.posexplode("q").alias("k", "q")).select((F.col("k") + 1).cast("long").alias("seq"), "q.label", F.lit(0).alias("first_frame"), "q.last_frame")
    return tiling.choose_layouts(b, asked, TILES)


#: Frames of a segment in ``stored_tiles``; each fifth picture is of one video.
SEGMENT_FRAMES = 4


@_query(
    f"""@e AS (SELECT event_id, object_type AS label, event_id // 100 % 5 AS video, event_id // 100 // 5 AS frame, CAST(floor(x1) AS INTEGER) % 20 AS x1, CAST(y1 AS INTEGER) % 16 AS y1, 1 + event_id % 9 AS w, 1 + event_id % 7 AS h FROM det),
h AS (SELECT video, frame // {SEGMENT_FRAMES} AS segment, label, min(x1) AS x1, min(y1) AS y1, max(x1 + w) AS x2, max(y1 + h) AS y2 FROM e GROUP BY ALL),
l AS (SELECT h.* FROM h JOIN (SELECT video, segment, CASE WHEN segment % 2 = 1 THEN max(label) ELSE min(label) END AS label FROM h GROUP BY video, segment) USING (video, segment, label)),
g AS (SELECT h.*, {_CUT["x", 1]} AS xa, {_CUT["x", 2]} AS xb, {_CUT["y", 1]} AS ya, {_CUT["y", 2]} AS yb, [0, l.x1, l.x2, 32] AS xs, [0, l.y1, l.y2, 24] AS ys FROM h JOIN l USING (video, segment)),
f AS (SELECT DISTINCT video, frame FROM e),
p AS (SELECT video, frame, event_id * 7919 % 768 % 32 AS x, event_id * 7919 % 768 // 32 AS y, event_id % 251 AS v FROM e)
SELECT CAST(g.video AS BIGINT) AS video, CAST(segment AS BIGINT) AS segment, label, CAST(f.frame AS BIGINT) AS frame, CAST(x2 - x1 AS INTEGER) AS width, CAST(y2 - y1 AS INTEGER) AS height,
  CAST(coalesce(sum(v * (1 + (y - y1) * (x2 - x1) + x - x1)), 0) AS BIGINT) AS checksum, CAST((any_value(xs)[xb + 1] - any_value(xs)[xa + 1]) * (any_value(ys)[yb + 1] - any_value(ys)[ya + 1]) AS BIGINT) AS decoded
FROM g JOIN f ON f.video = g.video AND f.frame // {SEGMENT_FRAMES} = segment LEFT JOIN p ON p.video = f.video AND p.frame = f.frame AND x >= x1 AND x < x2 AND y >= y1 AND y < y2
GROUP BY g.video, segment, label, f.frame, x1, y1, x2, y2, xa, xb, ya, yb"""
)
def stored_tiles(spark, sf_dir):
    """Pictures are stored in tiles, cut at one type's region in each segment; every other segment is then cut anew at another's; each type's regions are read back from the tiles they touch."""
    found, frames = _pictures(spark, sf_dir)
    k = F.col("frame").cast("long")
    label = F.element_at(F.split("item_id", "-"), 1)
    costs = tiling.TileCosts(32, 24, SEGMENT_FRAMES)
    seen = tiling.regions(found.select((k % 5).alias("video"), F.floor(k / 5).alias("frame"), label.alias("label"), "x1", "y1", "x2", "y2"), costs)
    cut_at = lambda pick: seen.groupBy("video", "segment").agg(pick(F.struct("label", "x1", "y1", "x2", "y2")).alias("c")).select("video", "segment", "c.*")
    path = roi_video.shared_folder(spark, "tiles")
    tile_store.write_tiles(frames.select((k % 5).alias("video"), F.floor(k / 5).alias("frame"), "width", "height", "data"), cut_at(F.min), path, SEGMENT_FRAMES)
    tile_store.retile(spark, path, cut_at(F.max).filter("segment % 2 = 1"), SEGMENT_FRAMES)
    return tile_store.fetch_regions(spark, path, seen).select("video", "segment", "label", "frame", "width", "height", roi_video.checksum(F.col("data")).alias("checksum"), "decoded")


@_query(
    """@e AS (SELECT CAST(event_id // 100 AS INTEGER) AS frame, event_id * 7919 % 768 % 32 AS x, event_id * 7919 % 768 // 32 AS y FROM det WHERE event_id % 251 >= 64), p AS (SELECT DISTINCT * FROM e),
n AS (SELECT a.frame, a.x, a.y, b.x AS nx, b.y AS ny FROM p a JOIN p b ON a.frame = b.frame AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
r AS (SELECT frame, x, y, x AS rx, y AS ry FROM p UNION SELECT r.frame, r.x, r.y, n.nx, n.ny FROM r JOIN n ON n.frame = r.frame AND n.x = r.rx AND n.y = r.ry),
c AS (SELECT frame, x, y, min(ry * 32 + rx) AS region FROM r GROUP BY ALL)
SELECT frame, CAST(min(x) AS INTEGER) AS x1, CAST(min(y) AS INTEGER) AS y1, CAST(max(x) + 1 AS INTEGER) AS x2, CAST(max(y) + 1 AS INTEGER) AS y2, CAST(count(*) AS INTEGER) AS pixels,
  count(*) / ((max(x) + 1 - min(x)) * (max(y) + 1 - min(y)))::DOUBLE AS score FROM c GROUP BY frame, region"""
)
def recognized_regions(spark, sf_dir):
    """Connected regions of bright pixels in the pictures, by a table function."""
    _, frames = _pictures(spark, sf_dir)
    return recognition.recognized(frames, 64)


@_query("SELECT item_id, t, x, y FROM (SELECT *, row_number() OVER (PARTITION BY item_id, t ORDER BY x, y) AS n FROM (SELECT item_id, t, x1 + (x2 - x1) / 2 AS x, y1 + (y2 - y1) / 2 AS y FROM det)) WHERE n = 1")
def streamed_trajectories(spark, sf_dir):
    """Trajectories of detections that come as a stream of files, merged into a store batch after batch."""
    folder = roi_video.shared_folder(spark, "stream")
    d = events.detections(spark, sf_dir)
    d.repartition(12, "event_id").write.parquet(f"{folder}/arriving")
    arriving = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/arriving")
    merge_stream(arriving, f"{folder}/store", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return merged_store(spark, f"{folder}/store").select("item_id", F.explode("traj").alias("p")).select("item_id", "p.t", "p.x", "p.y")
