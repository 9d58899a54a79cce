"""The overlap join: objects with objects in space and time, hot spots, boxes without bounds; merges of several rows."""

from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidspark.operators import joins
from vidspark.sources.ingest import merge_trajectories
from vidspark.types import STBOX, TRAJECTORIES

INF, START = float("inf"), datetime(2024, 1, 1)


def rows_of(kind, n, seed):
    rng = np.random.default_rng(seed)
    x, y, t = rng.uniform(0, 100, (3, n))
    w, h, d = rng.uniform(0, 4, (3, n))
    if kind == "spot":
        x[:], y[:], t[:] = 5, 5, 5
    if kind == "equal":
        x[:], y[:], t[:], w[:], h[:], d[:] = 5, 5, 5, 1, 1, 1
    if kind == "dense":
        x[: n // 2], y[: n // 2] = x[: n // 2] / 1000, y[: n // 2] / 1000
        w[: n // 2] /= 500
    out = [[float(a), float(b), 0.0, float(a + p), float(b + q), 1.0, START + timedelta(seconds=float(c)), START + timedelta(seconds=float(c + r))] for a, b, c, p, q, r in zip(x, y, t, w, h, d, strict=True)]
    if kind == "odd":
        for k, row in enumerate(out[:60]):
            if k % 6 == 0:
                row[0], row[3] = -INF, INF
            elif k % 6 == 1:
                row[4] = INF
            elif k % 6 == 2:
                row[6] = row[7] = None
            elif k % 6 == 3:
                row[2] = row[5] = None
            elif k % 6 == 4:
                row[1] = None
            else:
                row[3] = float("nan")
    return out


def brute(left, right):
    def meet(a, b):
        if any(v is None or v != v for row in (a, b) for v in (row[0], row[1], row[3], row[4])):
            return False
        return all(None in (a[k], b[m], a[m], b[k]) or a[k] <= b[m] and a[m] >= b[k] for k, m in ((0, 3), (1, 4), (2, 5), (6, 7)))

    return Counter((i, j) for i, a in enumerate(left) for j, b in enumerate(right) if meet(a, b))


@pytest.mark.parametrize("kind,n,quota", [("random", 700, 50), ("spot", 500, 100), ("equal", 300, 64), ("dense", 700, 40), ("odd", 500, 60)])
def test_join_equals_brute_force(spark, monkeypatch, kind, n, quota):
    monkeypatch.setattr(joins, "FEW", 10)
    left, right = rows_of(kind, n, 1), rows_of(kind, n - 100, 2)
    make = lambda rows, name, box: spark.createDataFrame([(i, tuple(r)) for i, r in enumerate(rows)], f"{name} int, {box} {STBOX.simpleString()}")
    out = joins.overlap_join(make(left, "i", "bbox"), make(right, "j", "region"), quota=quota)
    assert out.columns == ["i", "bbox", "j", "region"]
    assert Counter((r.i, r.j) for r in out.select("i", "j").collect()) == brute(left, right)


def cell_sizes(p, left, right):
    """Rows of either side that each group gets when rows are dealt in turn."""
    sizes = np.zeros((p.first[-1], 2), int)
    for mine, boxes in enumerate((left, right)):
        row, cell = joins.cells_of(p, boxes)
        for r, c in zip(row, cell, strict=True):
            own = r % (p.a, p.b)[mine][c]
            for k in range((p.b, p.a)[mine][c]):
                sizes[p.first[c] + (own * p.b[c] + k if mine == 0 else k * p.b[c] + own), mine] += 1
    return sizes


@pytest.mark.parametrize("kind", ["spot", "equal", "dense", "random"])
def test_no_group_is_far_above_its_quota(kind):
    plain = lambda rows: np.array([[a, b, (t - START).total_seconds(), c, d, (u - START).total_seconds()] for a, b, _, c, d, _, t, u in rows])
    left, right = plain(rows_of(kind, 6000, 3)), plain(rows_of(kind, 4000, 4))
    p = joins.partition(left[::4], right[::4], 6000, 4000, 250)
    sizes = cell_sizes(p, left, right)
    assert sizes.max() <= 1.5 * 250 and len(sizes) > 20
    if kind in ("dense", "random"):
        assert sizes[:, 0].sum() < 3 * 6000  # few boxes lie in many cells


def test_a_small_side_goes_to_every_task(spark):
    few = spark.createDataFrame([(0, (-INF, 0.0, None, INF, 50.0, None, None, None))], f"j int, region {STBOX.simpleString()}")
    many = spark.createDataFrame([(i, tuple(r)) for i, r in enumerate(rows_of("random", 400, 5))], f"i int, bbox {STBOX.simpleString()}")
    out = joins.overlap_join(many, few)
    assert "BroadcastNestedLoopJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == many.filter("bbox.ymin <= 50").count()
    assert joins.overlap_join(many, few.limit(0)).count() == 0 and joins.overlap_join(many.limit(0), few).count() == 0


def test_merge_takes_all_rows_of_an_item(spark):
    at = lambda *ks: [(START + timedelta(seconds=k), float(k), 0.0, 0.0) for k in ks]
    box = (0.0, 0.0, 0.0, 1.0, 1.0, 1.0, None, None)
    rows = lambda *points: spark.createDataFrame([("c", item, "car", "red", p, box) for item, p in points], TRAJECTORIES)
    out = merge_trajectories(rows(("car-1", at(1, 2)), ("car-1", at(3, 4)), ("car-2", None)), rows(("car-1", at(5)), ("car-1", at(4, 6)), ("car-3", at(1))))
    got = {r.item_id: [p.x for p in r.traj] for r in out.select("item_id", "traj").collect()}
    assert got == {"car-1": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], "car-2": [], "car-3": [1.0]}
    assert out.select(F.count_distinct("item_id")).first()[0] == 3
