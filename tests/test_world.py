from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vidspark.constants import START_TIME
from vidspark.functions import tpoint
from vidspark.functions.lens import IdentityLens
from vidspark.functions.stbox import Volume, overlaps, parse_volume, stbox, volume_column
from vidspark.sources.catalog import Camera, Point, cameras, upsert_cameras
from vidspark.sources.ingest import ingest, label_rows, merge_boxes, merge_trajectories
from vidspark.types import DETECTIONS
from vidspark.world import DEFAULT_VOLUME, World, geometry, primarykey, time

ROWS = [
    ("cam1", "car-1", "car", 1, 0, 0, 2, 2), ("cam1", "car-1", "car", 2, 3, 4, 5, 6), ("cam1", "car-1", "car", 4, 3, 4, 5, 6),
    ("cam1", "car-2", "car", 1, 10, 10, 12, 12), ("cam1", "person-3", "person", 3, 2, 2, 4, 4),
]
VOLUME = Volume(2.0, 2.0, 0.0, 3.0, 3.0, 2.0)


@pytest.fixture(scope="module")
def detections(spark):
    return spark.createDataFrame(ROWS, DETECTIONS)


@pytest.fixture(scope="module")
def world(spark, detections):
    return World(spark, "w").camera("cam1", Point("p", "cam1", 0, 0, 0), 0.5, "v.mp4", "w_cam1", IdentityLens()).recognize("cam1", detections).ingested()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_key_per_object_and_per_box(world):
    cars = world.predicate(lambda obj: obj.object_type == "car")
    assert rows(cars.selectkey().execute()) == [("car-1",), ("car-2",)]
    assert rows(cars.interval().selectkey().execute()) == [("car-1",)] * 3 + [("car-2",)]
    assert rows(cars.interval().selectkey(distinct=True).execute()) == [("car-1",), ("car-2",)]


def test_volume_touches_and_overlaps(world):
    inside = world.predicate(lambda obj: obj.location in VOLUME)
    assert rows(inside.selectkey().execute()) == [("car-1",), ("person-3",)]
    text = "stbox 'STBOX Z((3,3,0),(2,2,2))'"
    assert rows(world.predicate(lambda obj: obj.location in v, {"v": text}).selectkey().execute()) == [("car-1",), ("person-3",)]  # noqa: F821
    assert rows(world.predicate(lambda obj: obj.location not in VOLUME).selectkey().execute()) == [("car-1",), ("car-1",), ("car-2",)]
    assert rows(world.predicate(lambda obj: obj.location.overlaps(VOLUME)).selectkey().execute()) == [("car-1",), ("person-3",)]


def test_prefilter_keeps_what_the_join_keeps(world):
    a = world.predicate(lambda obj: obj.object_type == "car").predicate(lambda obj: obj.location in VOLUME).selectkey().execute()
    b = world.predicate(lambda obj: obj.location in VOLUME).predicate(lambda obj: obj.object_type == "car").selectkey().execute()
    assert rows(a) == rows(b) == [("car-1",)]


def test_interval_is_half_open(world):
    assert [r.t for r in world.interval([1, 2]).get_time().execute().collect()] == [START_TIME + timedelta(seconds=1)] * 2
    assert rows(world.get_geo([1, 2]).execute()) == [(0.0, 0.0, 1.0, 2.0, 2.0, 1.0), (10.0, 10.0, 1.0, 12.0, 12.0, 1.0)]


def test_trajectory_distance_speed(world):
    car = world.predicate(lambda obj: obj.object_id == "car-1")
    assert car.get_trajectory().execute().first()[0] == [[1.0, 1.0, 1.0], [4.0, 5.0, 1.0], [4.0, 5.0, 1.0]]
    assert [p.length for p in car.get_distance().execute().first()[0]] == [0.0, 5.0, 5.0]
    assert [p.speed for p in car.get_speed().execute().first()[0]] == [5.0, 0.0, 0.0]
    assert car.get_speed(interp="discrete").execute().first()[0] is None
    single = world.predicate(lambda obj: obj.object_id == "car-2")
    assert [p.length for p in single.get_distance().execute().first()[0]] == [0.0]
    assert single.get_speed().execute().first()[0] is None
    assert car.get_trajectory([10, 20]).execute().first()[0] is None
    assert "MovingPoint" in car.get_mfjson().execute().first()[0]


def test_extent(world):
    box = world.trajectories.filter("item_id = 'car-1'").first().largest_bbox
    assert (box.xmin, box.ymin, box.xmax, box.ymax, box.tmin) == (0.0, 0.0, 5.0, 6.0, None)


def test_boolean_predicates(world):
    ids = ["car-2", "person-3"]
    def keys(w):
        return rows(w.selectkey().execute())

    assert keys(world.predicate(lambda obj: obj.object_id in ids)) == [("car-2",), ("person-3",)]
    assert keys(world.predicate(lambda obj: obj.object_id in [])) == []
    assert keys(world.predicate(lambda obj: obj.object_type != "car")) == [("person-3",)]
    assert keys(world.predicate(lambda obj: obj.object_type == "car" and not obj.object_id == "car-1")) == [("car-2",)]
    assert keys(world.predicate(lambda obj: obj.object_type == "person" or obj.object_id == "car-2")) == [("car-2",), ("person-3",)]
    assert keys(world.predicate(lambda obj: "car-1" < obj.object_id <= "person-3")) == [("car-2",), ("person-3",)]
    assert keys(world.predicate(lambda obj: obj.color is not None)) == [("car-1",), ("car-2",), ("person-3",)]
    assert keys(world.predicate(lambda obj: upper(obj.object_type) == "PERSON")) == [("person-3",)]  # noqa: F821
    two = world.predicate(lambda obj: obj.object_type == "car").predicate(lambda obj: obj.object_id == "car-1")
    assert keys(two) == [("car-1",)]
    with pytest.raises(AttributeError):
        world.predicate(lambda obj: obj.table_name == "x")


def test_predicate_without_source(world):
    fn = eval("lambda obj: (obj.object_type == 'car') & obj.object_id.isin(['car-1'])")
    assert rows(world.predicate(fn).selectkey().execute()) == [("car-1",)]
    with pytest.raises(TypeError):
        world.predicate(eval("lambda obj: obj.object_type == 'car' and obj.object_id == 'car-1'"))


def test_verbs_leave_the_world_as_it_was(world):
    before = world.plan
    world.predicate(lambda obj: obj.object_type == "car").selectkey().interval([0, 1])
    assert world.plan is before
    assert world.execute() is None


def test_columns_distinct_and_names(world):
    out = world.get_columns(primarykey, geometry, time, distinct=True).execute()
    assert out.columns == ["item_id", "xmin", "ymin", "zmin", "xmax", "ymax", "zmax", "t"]
    assert [r.xmin for r in out.orderBy("item_id").collect()] == [0.0, 10.0, 2.0]
    assert world.selectkey().selectkey().execute().columns == ["item_id", "item_id_2"]
    assert world.selectkey().get_object_type().delete_column("item_id").execute().columns == ["object_type"]
    assert world.selectkey().clear().execute() is None
    assert world.select_column("object_type", "upper").execute().columns == ["upper_object_type"]


def test_group_count_having_view_join(world, spark):
    assert rows(world.group("object_type").count().execute()) == [("car", 2), ("person", 1)]
    assert rows(world.group("object_id").count("location").predicate(lambda obj: count(obj) >= 3).execute()) == [("car-1", 3)]  # noqa: F821
    assert rows(world.count("object_id", distinct=True).execute()) == [(3,)]
    world.predicate(lambda obj: obj.object_type == "person").selectkey().execute(create_view=True, view_name="people")
    assert rows(world.join("people").selectkey().execute()) == [("person-3",)]
    assert rows(world.join(world.predicate(lambda obj: obj.object_type == "car").selectkey(), how="left_anti").selectkey().execute()) == [("person-3",)]
    assert world.view("people").execute().columns == ["item_id"]


def test_cameras(spark, world):
    more = world.camera("cam2", lens=IdentityLens()).camera("cam2", ratio=9.0)
    assert more.cameras["cam2"].ratio is None
    assert [r.camera_id for r in more.get_camera().collect()] == ["cam1", "cam2"]
    assert [r.camera_id for r in more.get_camera(["cam2"]).collect()] == ["cam2"]
    assert more.add_properties("cam2", 3, "height").cameras["cam2"].properties == {"height": 3}
    assert list(more.remove_camera("cam1").cameras) == ["cam2"] and not more.clear_cameras().cameras
    assert more.get_lens("cam2") == IdentityLens() and more.get_name() == "w" and more.get_units() == "metrics"
    old = cameras(spark, "w", [Camera("a", ratio=1.0), Camera("b", ratio=1.0)])
    out = upsert_cameras(old, cameras(spark, "w", [Camera("b", ratio=2.0)]))
    assert rows(out.select("camera_id", "ratio")) == [("a", 1.0), ("b", 2.0)]


def test_second_camera_adds_up(spark, world):
    more = spark.createDataFrame([("cam2", "bus-9", "bus", 1, 0, 0, 1, 1)], DETECTIONS)
    both = world.camera("cam2").recognize("cam2", more)
    assert rows(both.selectkey().execute()) == [("bus-9",), ("car-1",), ("car-2",), ("person-3",)]
    by_hand = world.item("dog-1", "cam1", "dog", (1, 1, 2, 2), 5)
    assert ("dog-1",) in rows(by_hand.selectkey().execute())
    hooked = world.recognize("cam1", tracker=lambda camera: more.withColumn("item_id", F.lit(camera.cam_id)))
    assert ("cam1",) in rows(hooked.selectkey().execute())
    with pytest.raises(ValueError):
        world.recognize("cam1")


def test_merge_keeps_old_instants(spark, detections):
    old_t, old_b = ingest(detections.filter("frame <= 2"))
    new_t, new_b = ingest(detections.filter("frame >= 2").withColumn("x1", F.col("x1") - 1))
    merged = merge_boxes(old_b, new_b)
    assert merged.count() == 5
    traj = merge_trajectories(old_t, new_t).filter("item_id = 'car-1'").first()
    assert [p.x for p in traj.traj] == [1.0, 4.0, 3.5]
    assert merge_boxes(old_b, old_b).count() == old_b.count()


def test_video_plan(world):
    from vidspark.functions.lens import PinholeLens

    w = world.add_lens("cam1", PinholeLens((2, 2), (0.0, 0.0), 90.0)).predicate(lambda obj: obj.object_id == "car-1").get_video(["cam1"])
    plan = w.execute().orderBy("frame").collect()
    assert [(r.frame, r.frame_index, r.x1, r.y1, r.out_w, r.out_h, r.pad_x) for r in plan] == [(1, 0, 0, 0, 2, 2, 0), (2, 1, 3, 4, 2, 2, 0), (4, 3, 3, 4, 2, 2, 0)]
    assert plan[0].path == "./output/w_car-1.mp4"


def test_labels_are_clamped_and_doubled(detections):
    out = label_rows(detections.filter("frame = 3").withColumn("x1", F.lit(-5)).withColumn("y2", F.lit(9999)), "m")
    assert rows(out.select("label", "x1", "y2")) == [("person", 0, 2160), ("person-3", 0, 2160)]


def test_default_volume_and_pixels(world):
    assert world.select_intersection_of_interest_or_use_default("cam1") == DEFAULT_VOLUME
    assert world.select_intersection_of_interest_or_use_default("cam1", False, ((3, 4), (1, 2))) == Volume(1.0, 2.0, 0.0, 3.0, 4.0, 2.0)
    points = world.overlay_trajectory("cam1", world.selectkey().get_trajectory().execute())
    assert points.count() == 5 and set(points.columns) == {"item_id", "point", "u", "v"}


def test_boxes_ignore_missing_dimensions(spark):
    a, b = stbox(F.lit(0), F.lit(0), F.lit(None), F.lit(2), F.lit(2), F.lit(None)), volume_column(Volume(2.0, 2.0, 5.0, 3.0, 3.0, 6.0))
    assert spark.range(1).select(overlaps(a, b), overlaps(b, a)).first()[:] == (True, True)
    v = parse_volume("STBOX ZT((0,0,0,2021-01-01 00:00:00),(1,1,1,2021-01-02 00:00:00))")
    assert v.tmax == datetime(2021, 1, 2) and (v.xmin, v.zmax) == (0.0, 1.0)
    with pytest.raises(ValueError):
        parse_volume("box(1,2)")
    with pytest.raises(TypeError):
        1 in Volume(0.0, 0.0, 0.0, 1.0, 1.0, 1.0)  # noqa: B015


def test_frames_and_times(spark):
    one = spark.range(1)
    t = tpoint.time_of_frame(F.lit(45), START_TIME, 1 / 30)
    assert one.select(t).first()[0] == START_TIME + timedelta(seconds=1.5)
    assert one.select(tpoint.frame_of_time(t, START_TIME, 1 / 30)).first()[0] == 45


def test_stream_appends_boxes(spark, detections, tmp_path):
    from vidspark.streaming import append_boxes

    detections.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(DETECTIONS).parquet(str(tmp_path / "in"))
    query = append_boxes(stream, str(tmp_path / "out"), str(tmp_path / "mark")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
