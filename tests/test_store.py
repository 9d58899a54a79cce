"""Stored tables: the curve, what is overwritten and added, and how little a volume reads."""

import itertools
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

from tests.conftest import SF
from vidspark.functions.stbox import Volume
from vidspark.sources import events, store
from vidspark.sources.ingest import ingest


def test_the_curve_visits_each_cell_once_and_steps_to_a_neighbour():
    points = np.array(list(itertools.product(range(8), repeat=3)))
    places = store.hilbert(*points.T, bits=3)
    assert sorted(places) == list(range(512))
    walk = points[np.argsort(places)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def groups_touched(folder, volume):
    """Row groups whose statistics meet the volume in x and y, and all."""
    touched = every = 0
    for file in Path(folder).rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            stats = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
            every += 1
            touched += all(stats[f"bbox.{d}min"].min <= getattr(volume, f"{d}max") and stats[f"bbox.{d}max"].max >= getattr(volume, f"{d}min") for d in "xy")
    return touched, every


def test_a_volume_reads_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FILE_ROWS", 100)
    d = events.detections(spark, "/root/testdata/sf0.01")
    trajectories, bboxes = ingest(d)
    store.write_tables(trajectories, bboxes, str(tmp_path / "laid"))
    bboxes.repartition(40).write.parquet(str(tmp_path / "plain"))
    small = Volume(10, 20, 0, 14, 30, 2)
    touched, every = groups_touched(tmp_path / "laid" / "bboxes", small)
    plain, _ = groups_touched(tmp_path / "plain", small)
    assert every >= 80 and touched < 0.4 * every and plain == 40
    back = store.read_tables(spark, str(tmp_path / "laid"))
    assert [f.count() for f in back] == [trajectories.count(), bboxes.count()]


def test_cameras_are_replaced_or_added_to(spark, tmp_path):
    d = events.detections(spark, SF)
    path = str(tmp_path / "s")
    of = lambda camera: ingest(d.selectExpr(f"{camera} AS camera_id", "*"))
    n = d.count()
    for camera, append, want in (("'a'", False, n), ("'b'", False, 2 * n), ("'a'", False, 2 * n), ("'a'", True, 3 * n), ("cast(null as string)", False, 4 * n), ("cast(null as string)", False, 4 * n)):
        store.write_tables(*of(camera), path, append)
        assert store.read_tables(spark, path)[1].count() == want
    assert {r[0] for r in store.read_tables(spark, path)[0].select("camera_id").distinct().collect()} == {"a", "b", None}
    store.write_tables(*(t.limit(0) for t in of("'a'")), path)
    assert store.read_tables(spark, path)[1].count() == 4 * n
