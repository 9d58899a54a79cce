"""Suppression: boxes at the limit."""

import numpy as np
import pytest

from tests.conftest import oracle_rows
from vidspark import queries
from vidspark.functions import vision

BOXES = "camera_id string, frame int, object_type string, score double, x1 double, y1 double, x2 double, y2 double"


def by_sql(rows, iou):
    values = ", ".join(f"({r[1]}, '{r[2]}', {', '.join(f'{x!r}::DOUBLE' for x in r[3:])})" for r in rows)
    _, want = oracle_rows(f"WITH RECURSIVE b(frame, object_type, score, x1, y1, x2, y2) AS (VALUES {values}), {queries._suppression('once', 'b', iou)} SELECT 'c', * FROM once")
    return sorted(want)


def test_boxes_right_at_the_limit_are_judged_as_by_sql(spark):
    """Shared and joint area are as 5 to 50, up to rounding: a quotient would be above 0.1."""
    rows = [("c", 1, "car", 1.0, 15.69, 45.0, 15.69 + 1 + 5, 50.0), ("c", 1, "car", 0.6, 16.56, 41.0, 21.56, 46.0)]
    got = sorted(map(tuple, vision.non_max_suppression(spark.createDataFrame(rows, BOXES), iou=0.1).collect()))
    assert got == by_sql(rows, 0.1) and len(got) == 2


def some_boxes(n=1200, frames=3):
    """Groups of some 200 boxes with ties, repeats and nothing left out."""
    rng = np.random.default_rng(3)
    at = rng.integers(0, 40, (n, 2)) / 2
    size = rng.integers(1, 8, (n, 2))
    return [("c", int(rng.integers(frames)), str(rng.choice(["bus", "car"])), int(rng.integers(5, 11)) / 10, float(x), float(y), float(x + w), float(y + h)) for (x, y), (w, h) in zip(at, size, strict=True)]


@pytest.mark.parametrize("batch", [7, 10000])
def test_groups_go_on_over_batches(spark, batch):
    """Boxes of a group that come in many batches are kept as by SQL, up to 50 of a class and frame."""
    rows = some_boxes()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for iou in (0.1, 0.45):
            got = sorted(map(tuple, vision.non_max_suppression(spark.createDataFrame(rows, BOXES), iou=iou).collect()))
            assert got == by_sql(rows, iou)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_group_is_no_call_of_its_own(spark):
    """Groups were frames of pandas, one call each."""
    plan = vision.non_max_suppression(spark.createDataFrame(some_boxes(10), BOXES))._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
