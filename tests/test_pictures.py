"""Pictures of events and checksums: bytes as they should be, and work that grows with the dots."""

import numpy as np

from tests.conftest import SF
from vidspark import queries
from vidspark.sources import events, roi_video


def test_pictures_hold_their_dots_and_are_not_searched_pixel_by_pixel(spark):
    _, frames = queries._pictures(spark, SF)
    want = {}
    for (e,) in events.detections(spark, SF).select("event_id").collect():
        want.setdefault(e // 100, np.zeros(768, np.uint8))[e * 7919 % 768] = e % 251
    assert {r.frame: bytes(r.data) for r in frames.collect()} == {k: v.tobytes() for k, v in want.items()}
    assert "sequence(0, 767" not in frames._jdf.queryExecution().toString()


def test_checksums_are_taken_of_whole_pictures(spark):
    rows = [(0, None), (1, b""), (2, bytes([3, 0, 255]))]
    out = spark.createDataFrame(rows, "k int, data binary").select("k", roi_video.checksum(queries.F.col("data")).alias("c"))
    assert {r.k: r.c for r in out.collect()} == {0: 0, 1: 0, 2: 768}
    assert "ArrowEvalPython" in out._jdf.queryExecution().toString()  # not an expression a byte
