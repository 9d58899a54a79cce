"""Tile layouts by regret, regions of pixels, merges of streams: against brute force and on odd rows."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidspark.functions.recognition import connected_regions, recognized, register
from vidspark.operators.tiling import TileCosts, choose_layouts
from vidspark.sources.ingest import boxes, trajectories
from vidspark.streaming import merge

COSTS = TileCosts(10, 10, segment_frames=2, tile=1, encode=1)
BOXES = "video long, frame int, label string, x1 int, y1 int, x2 int, y2 int"
ASKED = "seq int, label string, first_frame int, last_frame int"


def chosen(spark, rows, asked):
    return [tuple(r) for r in choose_layouts(spark.createDataFrame(rows, BOXES), spark.createDataFrame(asked, ASKED), COSTS).orderBy("video", "segment", "seq").collect()]


def test_a_segment_is_tiled_when_regret_passes_its_cost(spark):
    rows = [(1, 0, "car", 2, 2, 4, 4), (1, 1, "bus", 6, 6, 9, 9), (1, 2, "bus", 0, 0, 10, 10)]
    # Whole: 200 + 1 a query. Cut at the car: 2 * 2 * 2 + 1 = 9, so regret is 192, then 384 > 200.
    assert chosen(spark, rows, [(k, "car", 0, 1) for k in (1, 2, 3)]) == [(1, 0, 1, "whole", 201, False), (1, 0, 2, "car", 201, True), (1, 0, 3, "car", 9, False)]
    # The bus is in the last tile of that layout (6 by 6 pixels); a layout of its own takes 3 by 3.
    assert chosen(spark, rows, [(1, "car", 0, 1), (2, "car", 0, 1), (3, "bus", 0, 1)])[-1] == (1, 0, 3, "car", 6 * 6 * 2 + 1, False)
    # A query touches the segments of its frames only; the bus fills all of segment 1, where no layout saves anything.
    assert chosen(spark, rows, [(1, "bus", 2, 9)]) == [(1, 1, 1, "whole", 201, False)]


def test_layouts_of_odd_rows(spark):
    assert chosen(spark, [], []) == []
    rows = [(None, 0, "car", 2, 2, 4, 4), (1, None, "car", 2, 2, 4, 4), (1, 0, None, 2, 2, 4, 4), (1, 0, "car", None, 2, 4, 4), (1, 0, "car", 4, 4, 4, 9), (2, 0, "car", -5, 2, 99, 4)]
    asked = [(1, "car", 0, 9), (None, "car", 0, 9), (2, None, 0, 9), (3, "car", None, 9), (4, "tree", 0, 9)]
    # A video without name is one; corners are kept within the picture; the rest counts for nothing.
    assert chosen(spark, rows, asked) == [(None, 0, 1, "whole", 201, False), (2, 0, 1, "whole", 201, False)]


def brute_regions(on):
    left, out = {tuple(p) for p in np.argwhere(on)}, []
    while left:
        todo, region = [left.pop()], []
        while todo:
            y, x = todo.pop()
            region.append((y, x))
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        ys, xs = zip(*region, strict=True)
        out.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(region)))
    return sorted(out, key=lambda r: (r[1], r[0], r[2], r[3]))


@pytest.mark.parametrize("share", [0.0, 0.1, 0.35, 0.5, 0.8, 1.0])
def test_regions_equal_brute_force(share):
    rng = np.random.default_rng(3)
    for shape in ((1, 1), (1, 9), (9, 1), (17, 23), (40, 12)):
        on = rng.random(shape) < share
        assert sorted(connected_regions(on)) == sorted(brute_regions(on))


def test_regions_by_frame_and_by_sql(spark):
    rows = [(1, "a", 3, 2, bytes([0, 9, 0, 9, 0, 0])), (2, "b", 3, 2, bytes(6)), (3, None, 3, 2, None), (4, "d", 0, 0, b""), (1, "a", 3, 2, bytes([0, 9, 0, 9, 0, 0]))]
    frames = spark.createDataFrame(rows, "frame int, camera_id string, width int, height int, data binary")
    want = [(1, "a", 0, 0, 2, 2, 2, 0.5)] * 2
    assert [tuple(r) for r in recognized(frames, 9).collect()] == want
    register(spark)
    frames.createOrReplaceTempView("frames_of_regions")
    assert [tuple(r) for r in spark.sql("SELECT * FROM regions(TABLE(frames_of_regions), 9, 2)").collect()] == want
    assert recognized(frames, 9, 3).count() == 0 and recognized(frames.limit(0), 9).count() == 0
    for wrong in (frames.drop("data"), frames.withColumn("x1", F.lit(1))):
        with pytest.raises(Exception, match="columns"):
            recognized(wrong, 9).collect()
    short = frames.limit(1).withColumn("width", F.lit(4))
    with pytest.raises(Exception, match="bytes"):
        recognized(short, 9).collect()


DETECTIONS = "item_id string, object_type string, t timestamp_ntz, x1 double, y1 double, x2 double, y2 double"


def _rows():
    at = lambda k: datetime(2024, 1, 1, 0, 0, k)
    some = [(f"car-{k % 3}", "car", at(k % 7), float(k % 5), 0.0, float(k % 5 + 2), 2.0) for k in range(40)]
    return some, [(None, "car", at(1), 0.0, 0.0, 1.0, 1.0), ("car-1", "car", None, 0.0, 0.0, 1.0, 1.0)]


def _points(frame):
    return sorted((r.item_id, p.t, p.x, p.y) for r in frame.collect() for p in r.traj)


@pytest.mark.parametrize("order", ["forward", "backward", "again"])
def test_batches_in_any_order_give_the_result_of_one(spark, tmp_path, order, monkeypatch):
    monkeypatch.setattr(merge, "FANOUT", 3)
    some, odd = _rows()
    parts = [[*some[k::10], *(odd if k == 4 else [])] for k in range(10)]
    want = _points(merge.merge_segments(trajectories(boxes(spark.createDataFrame(some, DETECTIONS)))))
    assert len(want) == len({(i, t) for i, t, *_ in want}) == 21
    numbers = {"forward": list(range(10)), "backward": list(range(9, -1, -1)), "again": [*range(10), 8, 2]}[order]
    for k in numbers:
        merge.add_batch(spark.createDataFrame(parts[k], DETECTIONS), k, str(tmp_path))
    assert _points(merge.merged_store(spark, str(tmp_path))) == want
    if order != "backward":
        assert merge._runs(spark, str(tmp_path)) == [(2, 8), (0, 9)]


def test_empty_store_and_unfinished_runs(spark, tmp_path):
    assert merge.merged_store(spark, str(tmp_path / "none")).count() == 0
    merge.add_batch(spark.createDataFrame([], DETECTIONS), 0, str(tmp_path))
    merge.add_batch(spark.createDataFrame(_rows()[0], DETECTIONS), 1, str(tmp_path))
    (tmp_path / "level-0-end-000000001" / "_SUCCESS").unlink()
    assert merge.merged_store(spark, str(tmp_path)).count() == 0


def test_stream_with_watermark(spark, tmp_path):
    some, _ = _rows()
    want = _points(merge.merge_segments(trajectories(boxes(spark.createDataFrame(some, DETECTIONS)))))
    for k in range(2):  # everything comes twice
        spark.createDataFrame(some, DETECTIONS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(DETECTIONS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = merge.merge_stream(stream, str(tmp_path / "store"), str(tmp_path / "progress"), lateness="1 hour").trigger(availableNow=True).start()
    query.awaitTermination()
    assert _points(merge.merged_store(spark, str(tmp_path / "store"))) == want
