import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vidspark.functions import tpoint, vision
from vidspark.functions.lens import IdentityLens, Lens, PinholeLens, VRLens, project
from vidspark.functions.stbox import Volume, overlaps, stbox, volume_column
from vidspark.operators.joins import overlap_join
from vidspark.operators.video import crops, encode_rois, read_frames

NUMBER = st.floats(-100, 100, allow_nan=False).map(lambda x: round(x, 3))
FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def volumes():
    return st.builds(lambda *v: Volume(*v), NUMBER, NUMBER, NUMBER, NUMBER, NUMBER, NUMBER)


@FEW
@given(st.lists(st.tuples(volumes(), volumes()), min_size=1, max_size=20))
def test_overlap_is_symmetric_and_exact(spark, pairs):
    frame = spark.range(1)
    for a, b in pairs[:4]:
        want = all(getattr(a, f"{d}min") <= getattr(b, f"{d}max") and getattr(a, f"{d}max") >= getattr(b, f"{d}min") for d in "xyz")
        got = frame.select(overlaps(volume_column(a), b), overlaps(volume_column(b), a), overlaps(volume_column(a), volume_column(b))).first()
        assert tuple(got) == (want,) * 3


@FEW
@given(st.lists(st.tuples(NUMBER, NUMBER), min_size=2, max_size=6))
def test_length_is_additive_and_restriction_idempotent(spark, points):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    data = [(start + timedelta(seconds=i), x, y, 0.0) for i, (x, y) in enumerate(points)]
    df = spark.createDataFrame([(data,)], "traj array<struct<t timestamp_ntz, x double, y double, z double>>")
    cut = start + timedelta(seconds=len(points) // 2)
    once = tpoint.at_period(F.col("traj"), start, cut)
    got = df.select(tpoint.total_length(F.col("traj")).alias("l"), once.alias("a"), tpoint.at_period(once, start, cut).alias("b"), F.element_at(tpoint.cumulative_length(F.col("traj")), -1)["length"].alias("c")).first()
    want = sum(math.dist(p, q) for p, q in zip(points, points[1:], strict=False))
    assert got.l == pytest.approx(want) and got.c == pytest.approx(want)
    assert got.a == got.b and len(got.a) == len(points) // 2


def test_lengths_of_long_points_take_linear_time(spark):
    import time

    n = 40_000
    points = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.timestamp_seconds(i).cast("timestamp_ntz").alias("t"), i.cast("double").alias("x"), (i % 2).cast("double").alias("y"), F.lit(0.0).alias("z")))
    df = spark.range(1).select(points.alias("traj")).cache()
    df.count()
    began = time.perf_counter()
    got = df.select(tpoint.cumulative_length(F.col("traj")).alias("l")).select(F.size("l"), F.element_at("l", -1)["length"], F.get("l", F.lit(300))["length"]).first()
    assert time.perf_counter() - began < 5
    assert got[0] == n and got[1] == pytest.approx((n - 1) * 2**0.5) and got[2] == pytest.approx(300 * 2**0.5)


@pytest.mark.parametrize("skew", [0.0, 3.0])
def test_pinhole_round_trip(spark, skew):
    lens = PinholeLens((1280, 720), (10.0, 20.0), 100.0, skew)
    x, y, z = lens.pixel_to_world(F.lit(33.0), F.lit(44.0), F.lit(2.0))
    u, v = lens.world_to_pixel(x, y, z, perspective=True)
    got = spark.range(1).select(u / 1.0, v / 1.0, x, y, z).first()
    k = lens.intrinsics() @ np.array([got[2], got[3], got[4]])
    assert k[0] == pytest.approx(33.0) and k[1] == pytest.approx(44.0)
    assert got[0] == pytest.approx(33.0 / 2) and got[1] == pytest.approx(44.0 / 2)


def test_base_lens_leaves_both_maps_to_its_kinds(spark):
    for ask in (Lens().pixel_to_world, Lens().world_to_pixel):
        with pytest.raises(NotImplementedError):
            ask(1.0, 2.0, 3.0)
    seen = spark.createDataFrame([(1.5, 2.5, 3.5), (None, 0.0, 1.0)], "x double, y double, z double")
    rows = seen.select(*IdentityLens().pixel_to_world(F.col("x"), F.col("y"), F.col("z")), *IdentityLens().world_to_pixel(F.col("x"), F.col("y"), F.col("z"))).collect()
    assert sorted(map(tuple, rows), key=str) == [(1.5, 2.5, 3.5, 1.5, 2.5), (None, 0.0, 1.0, None, 0.0)]


def test_camera_row_projection_equals_lens(spark):
    lens = PinholeLens((4, 4), (1.0, 2.0), 90.0, 0.5)
    fx, fy = lens.focal
    a = lens.world_to_pixel(F.lit(3.0), F.lit(4.0), F.lit(5.0))
    b = project(*[F.lit(float(x)) for x in (3, 4, 5, fx, fy, 1, 2, 0.5)])
    got = spark.range(1).select(*a, *b).first()
    assert got[:2] == got[2:]


def test_vr_both_ways(spark):
    lens = VRLens((1, 1), (1.0, 2.0, 3.0), 0.1, 0.2, 0.3)
    w = lens.pixel_to_world(F.lit(5.0), F.lit(7.0), F.lit(1.0))
    p = lens.world_to_pixel(F.lit(5.0), F.lit(7.0), F.lit(1.0))
    got = spark.range(1).select(*w, *p, *lens.world_to_pixel(*w)).first()
    assert got[:5] == pytest.approx((4.787, 4.055, -2.375, 5.836, 8.909), abs=1e-3)
    assert got[5:] == pytest.approx((5.0, 7.0))
    assert np.allclose(lens.matrix()[:3, :3] @ lens.matrix()[:3, :3].T, np.eye(3))


def test_rigid_inverse():
    m = vision.rigid((0.1, 0.2, 0.3), (1, 2, 3))
    assert np.allclose(vision.rigid((0.1, 0.2, 0.3), (1, 2, 3), invert=True) @ m, np.eye(4), atol=1e-5)


def test_suppression(spark):
    rows = [("c", 1, "car", 0.9, 0.0, 0.0, 10.0, 10.0), ("c", 1, "car", 0.8, 1.0, 1.0, 10.0, 10.0), ("c", 1, "car", 0.7, 20.0, 20.0, 30.0, 30.0), ("c", 1, "bus", 0.6, 0.0, 0.0, 10.0, 10.0), ("c", 1, "car", 0.4, 50.0, 50.0, 60.0, 60.0)]
    df = spark.createDataFrame(rows, "camera_id string, frame int, object_type string, score double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.score for r in vision.non_max_suppression(df).collect()) == [0.6, 0.7, 0.9]
    assert [r.score for r in vision.non_max_suppression(df, most_a_frame=1).collect()] == [0.9]
    assert vision.allowed_classes(df, ["bus"]).count() == 1


def test_tracks_and_gate(spark):
    df = spark.createDataFrame([("c", 7, "car", 1, 1.9, 2.9, 3.0, 4.0, True, 0), ("c", 8, "car", 1, 0.0, 0.0, 1.0, 1.0, True, 2), ("c", 9, "car", 1, 0.0, 0.0, 1.0, 1.0, False, 0)], "camera_id string, track_id int, object_type string, frame int, x1 double, y1 double, x2 double, y2 double, confirmed boolean, frames_since_update int")
    assert [tuple(r) for r in vision.confirmed_tracks(df).collect()] == [("c", "car-7", "car", 1, 1, 2, 3, 4)]
    got = spark.range(1).select(vision.cosine_gate(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.1))), vision.cosine_gate(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))).first()
    assert tuple(got) == (True, False)


def test_ssim_against_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random((5, 4)), rng.random((5, 4))
    frame = lambda m: spark.createDataFrame([(0, i, j, float(m[i, j])) for i in range(5) for j in range(4)], "frame int, y int, x int, value double")
    got = {(r.y, r.x): r.ssim for r in vision.ssim(frame(a), frame(b)).collect()}
    pa, pb = np.pad(a, 1, "reflect"), np.pad(b, 1, "reflect")
    for i in range(5):
        for j in range(4):
            p, q = pa[i : i + 3, j : j + 3], pb[i : i + 3, j : j + 3]
            mp, mq = p.mean(), q.mean()
            s = (2 * mp * mq + 1e-4) * (2 * ((p * q).mean() - mp * mq) + 9e-4) / ((mp**2 + mq**2 + 1e-4) * ((p * p).mean() - mp**2 + (q * q).mean() - mq**2 + 9e-4))
            assert got[i, j] == pytest.approx(min(1, max(0, (1 - s) / 2)))


def test_back_projection_round_trip(spark):
    k = np.array([[100.0, 0, 50, 0], [0, 100, 40, 0], [0, 0, 1, 0]])
    p = vision.back_project(F.lit(2.0), F.lit(10.0), F.lit(20.0), k)
    u, v = vision.project_points(*p, k, 101, 81)
    got = spark.range(1).select(u, v).first()
    assert got[0] == pytest.approx((10 / 100 - 0.5) * 2, abs=1e-5) and got[1] == pytest.approx((20 / 80 - 0.5) * 2, abs=1e-5)


def test_upsample(spark):
    out = vision.upsample(spark.createDataFrame([(0, 1, 2, 0.5)], "frame int, y int, x int, value double"))
    assert sorted((r.y, r.x) for r in out.collect()) == [(2, 4), (2, 5), (3, 4), (3, 5)]


def test_grid_join_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    boxes = [Volume(*map(float, (x, y, 0, x + w, y + h, 1))) for x, y, w, h in zip(*rng.integers(-20, 20, (2, 40)), *rng.integers(0, 15, (2, 40)), strict=True)]
    make = lambda part, n, c: spark.createDataFrame([(i, tuple(getattr(v, d) for d in ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax"))) for i, v in enumerate(part)], f"{n} int, {c} struct<xmin double, ymin double, zmin double, xmax double, ymax double, zmax double>").withColumn(c, F.col(c).withField("tmin", F.lit(None).cast("timestamp_ntz")).withField("tmax", F.lit(None).cast("timestamp_ntz")))
    got = sorted((r.a, r.b) for r in overlap_join(make(boxes[:20], "a", "bbox"), make(boxes[20:], "b", "region")).collect())
    want = sorted((i, j) for i, p in enumerate(boxes[:20]) for j, q in enumerate(boxes[20:]) if p.xmin <= q.xmax and p.xmax >= q.xmin and p.ymin <= q.ymax and p.ymax >= q.ymin)
    assert got == want


def test_overlap_join_of_boxes_of_any_size(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(zip(*rng.uniform(-500, 500, (2, 60)), *(2.0 ** rng.uniform(-3, 12, (2, 60))), strict=True))] + [(99, None, 0.0, None, 1.0)]
    made = lambda part, name, box: spark.createDataFrame(part, f"{name} int, a double, b double, c double, d double").select(name, stbox("a", "b", F.lit(0.0), "c", "d", F.lit(0.0)).alias(box))
    joined = overlap_join(made(rows[:30] + rows[-1:], "i", "bbox"), made(rows[30:], "j", "region"))
    assert sorted((r.i, r.j) for r in joined.collect()) == sorted((p[0], q[0]) for p in rows[:30] for q in rows[30:60] if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2])


def test_videos_models_and_trackers(spark, tmp_path):
    import pandas as pd

    (tmp_path / "v.raw").write_bytes(bytes(range(32)))
    decode = lambda name, data: [pd.DataFrame({"frame": [k // 16 + 1], "y": [k % 16 // 4], "x": [k % 4], "value": [b]}) for k, b in enumerate(data)]
    frames = read_frames(spark, str(tmp_path), decode, "frame int, y int, x int, value int")
    assert frames.count() == 32
    plan = spark.createDataFrame([("i", f, f - 1, 1, 1, 3, 2, 2, 1, 0, 0, "./output/i.mp4") for f in (1, 2)], "item_id string, frame int, frame_index int, x1 int, y1 int, x2 int, y2 int, out_w int, out_h int, pad_x int, pad_y int, path string")
    video = encode_rois(crops(plan, frames), plan, lambda group: bytes(group["value"].tolist())).collect()
    assert [(r.item_id, r.path, bytes(r.video)) for r in video] == [("i", "./output/i.mp4", bytes([5, 6, 21, 22]))]
    seen = vision.run_model(frames, lambda batch: batch[batch["value"] > 29], "frame int, y int, x int, value int")
    assert sorted(r.value for r in seen.collect()) == [30, 31]
    follow = lambda group: group.assign(track_id=range(len(group)))[["frame", "track_id"]]
    tracks = vision.associate(seen.withColumn("camera_id", F.lit("c")), follow, "frame int, track_id int")
    assert sorted(r.track_id for r in tracks.collect()) == [0, 1]


def test_crops(spark):
    plan = spark.createDataFrame([("i", 1, 0, 1, 1, 3, 2, 4, 3, 1, 1)], "item_id string, frame int, frame_index int, x1 int, y1 int, x2 int, y2 int, out_w int, out_h int, pad_x int, pad_y int")
    frames = spark.createDataFrame([(1, y, x, y * 10 + x) for y in range(4) for x in range(4)], "frame int, y int, x int, value int")
    assert sorted((r.y, r.x, r.value) for r in crops(plan, frames).collect()) == [(1, 1, 11), (1, 2, 12)]


def test_sets_of_periods(spark):
    from datetime import datetime

    day = lambda n: datetime(2024, 1, n)
    points = [(day(n), float(n), 0.0, 0.0) for n in range(1, 20)]
    some = [(day(5), day(7)), (day(3), day(6)), (day(9), day(9)), (day(7), day(8)), (day(15), day(17)), (None, day(3)), (day(16), day(12))]
    f = spark.createDataFrame([(points, some), (points, []), (points, None), ([], some), (None, some)], "traj array<struct<t timestamp_ntz, x double, y double, z double>>, ps array<struct<low timestamp_ntz, high timestamp_ntz>>")
    assert [[(p.low.day, p.high.day) for p in r[0]] for r in f.limit(1).select(tpoint.normal_periods(F.col("ps"))).collect()] == [[(3, 8), (15, 17)]]
    got = f.select(F.transform(tpoint.at_periods(F.col("traj"), F.col("ps")), lambda p: p["x"]).alias("x")).collect()
    assert [r.x for r in got] == [[3, 4, 5, 6, 7, 15, 16], None, None, None, None]
    constant = f.select(F.transform(tpoint.at_periods(F.col("traj"), [p for p in some if p[0]]), lambda p: p["x"]).alias("x")).collect()
    assert [r.x for r in constant] == [[3, 4, 5, 6, 7, 15, 16]] * 3 + [None, None]
