"""ROI videos: written and read back, failed tasks, frame ranges, filters that reach the source."""

import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from vidspark.sources import roi_video
from vidspark.sources.roi_video import SCHEMA, FilteringVideoReader, canvases, read_videos, write_videos

PLAN = "item_id string, frame int, frame_index int, x1 int, y1 int, x2 int, y2 int, out_w int, out_h int, pad_x int, pad_y int"


def pictures(spark, items=("car-1", "a/b ü"), frames=100):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(i, f, 3, 2, bytes(rng.integers(0, 256, 6).astype(np.uint8))) for i in items for f in range(0, 2 * frames, 2)], SCHEMA).repartition(5)


def rows(frame):
    return sorted((r.item_id, r.frame_index, r.width, r.height, bytes(r.data)) for r in frame.collect())


def test_canvases_are_cropped_and_padded(spark):
    plan = spark.createDataFrame([("i", 1, 0, 1, 1, 3, 2, 4, 3, 1, 1), ("edge", 1, 0, 3, 3, 9, 9, 6, 6, 0, 0), ("none", 2, 0, 0, 0, 1, 1, 1, 1, 0, 0), (None, 1, 0, 0, 0, 1, 1, 1, 1, 0, 0)], PLAN)
    frames = spark.createDataFrame([(1, 4, 4, bytes(y * 10 + x for y in range(4) for x in range(4))), (2, 4, 4, None)], "frame int, width int, height int, data binary")
    got = {r.item_id: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width) for r in canvases(plan, frames).collect()}
    assert sorted(got) == ["edge", "i"]
    assert got["i"].tolist() == [[0, 0, 0, 0], [0, 11, 12, 0], [0, 0, 0, 0]]
    assert got["edge"][0, 0] == 33 and got["edge"].sum() == 33


def test_round_trip_by_four_tasks(spark, tmp_path):
    path = str(tmp_path / "videos")
    frame = pictures(spark)
    write_videos(frame, path)
    assert sorted(os.listdir(path)) == ["a%2Fb%20%C3%BC.roi", "car-1.roi"]
    back = read_videos(spark, path, 50)
    assert back.rdd.getNumPartitions() == 4 and rows(back) == rows(frame)
    assert read_videos(spark, path, 1000).rdd.getNumPartitions() == 1
    write_videos(pictures(spark, ("new",)), path, "append")
    assert len(os.listdir(path)) == 3
    write_videos(pictures(spark, ("x" * 300,), 2), path)  # overwrites all
    assert len(os.listdir(path)) == 1 and {r.item_id for r in read_videos(spark, path).collect()} == {"x" * 300}
    write_videos(frame.limit(0), path)
    assert read_videos(spark, path).count() == 0


def test_filters_read_their_range_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "videos")
    write_videos(pictures(spark), path)
    reader = FilteringVideoReader(path, 10)
    assert list(reader.pushFilters([GreaterThanOrEqual(("frame_index",), 41), LessThan(("frame_index",), 80), EqualTo(("item_id",), "car-1"), EqualTo(("width",), 3)])) == [EqualTo(("width",), 3)]
    parts = reader.partitions()
    assert [s for p in parts for s in p.spans] == [("car-1.roi", 21, 31), ("car-1.roi", 31, 40)]
    assert [f for p in parts for b in reader.read(p) for f in b.column(1).to_pylist()] == list(range(42, 80, 2))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = read_videos(spark, path, 10).filter("frame_index >= 41 and frame_index < 80 and item_id = 'car-1'")
        assert some.rdd.getNumPartitions() == 2 and rows(some) == rows(pictures(spark).filter("frame_index between 41 and 79 and item_id = 'car-1'"))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "videos")
    wrong = pictures(spark).withColumn("width", F.when((F.col("item_id") == "car-1") & (F.col("frame_index") == 198), 7).otherwise(F.col("width")))
    with pytest.raises(PySparkException):
        write_videos(wrong, path)
    assert not os.path.exists(path)
    write_videos(pictures(spark), path)
    with pytest.raises(PySparkException):
        write_videos(wrong, path)
    assert rows(read_videos(spark, path)) == rows(pictures(spark))  # as it was


def test_other_stores_are_refused():
    assert roi_video.local_path("file:///a/b") == "/a/b"
    with pytest.raises(ValueError):
        roi_video.local_path("s3://a/b")
