"""Stored tiles: what is read back, what is not read, and odd rows."""

from pathlib import Path

import numpy as np
import pytest

from vidspark.operators.tiling import TileCosts, choose_layouts
from vidspark.sources import tile_store

CUTS = "video long, segment long, x1 int, y1 int, x2 int, y2 int"
WANTED = "video long, segment long, label string, x1 int, y1 int, x2 int, y2 int"


def picture(seed, width=10, height=8):
    return np.random.default_rng(seed).integers(0, 256, (height, width)).astype(np.uint8)


def pictures(spark, keys):
    return spark.createDataFrame([(v, f, 10, 8, bytearray(picture(10 * (v or 0) + f).tobytes())) for v, f in keys], tile_store.PICTURES)


def fetched(spark, path, wanted):
    rows = tile_store.fetch_regions(spark, path, spark.createDataFrame(wanted, WANTED)).collect()
    return {(r.video, r.segment, r.label, r.frame, r.x1, r.y1): (np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width), r.decoded) for r in rows}


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "tiles")
    keys = [(v, f) for v in (1, 2) for f in range(6)]
    tile_store.write_tiles(pictures(spark, keys), spark.createDataFrame([(1, 0, 2, 3, 5, 6), (1, 1, 0, 0, 4, 8), (1, 1, 9, 9, 9, 9), (2, 0, None, 0, 4, 8)], CUTS), path, 3)
    return path


def test_regions_are_put_together_from_the_tiles_they_touch(spark, stored):
    for x1, y1, x2, y2, decoded in [(2, 3, 5, 6, 9), (0, 0, 10, 8, 80), (0, 0, 2, 3, 6), (1, 3, 3, 4, 15), (4, 5, 6, 7, 40), (-3, -3, 1, 1, 6), (9, 7, 99, 99, 10)]:
        got = fetched(spark, stored, [(1, 0, "a", x1, y1, x2, y2)])
        assert sorted(k[3] for k in got) == [0, 1, 2]
        for (video, _, _, frame, *_), (data, read) in got.items():
            assert np.array_equal(data, picture(10 * video + frame)[max(y1, 0) : y2, max(x1, 0) : x2]) and read == decoded
    # Of two cuts the least; at the edge of a picture it makes no tile of its own. A null cut is none.
    assert {n for _, n in fetched(spark, stored, [(1, 1, "a", 0, 0, 1, 1)]).values()} == {32}
    assert {n for _, n in fetched(spark, stored, [(2, 0, "a", 0, 0, 1, 1)]).values()} == {80}


def test_only_wanted_segments_are_read(spark, stored, monkeypatch):
    for file in Path(stored).glob("video=2/segment=*/*.parquet"):
        file.write_bytes(b"broken")
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    assert len(fetched(spark, stored, [(1, 0, "a", 0, 0, 1, 1), (1, 1, "b", 0, 0, 1, 1)])) == 6
    with pytest.raises(Exception, match="broken|footer|Parquet|PARQUET"):
        fetched(spark, stored, [(2, 0, "a", 0, 0, 1, 1)])


def test_more_segments_than_are_named_give_the_same(spark, stored, monkeypatch):
    wanted = [(v, s, "a", 1, 1, 7, 7) for v in (1, 2) for s in (0, 1)]
    before = fetched(spark, stored, wanted)
    monkeypatch.setattr(tile_store, "NAMED_FOLDERS", 1)
    after = fetched(spark, stored, wanted)
    assert before.keys() == after.keys() and len(before) == 12
    assert all(np.array_equal(before[k][0], after[k][0]) for k in before)


def test_retiling_writes_its_segments_only(spark, stored):
    kept = {f.name for f in Path(stored).glob("video=1/segment=1/*.parquet")} | {f.name for f in Path(stored).glob("video=2/segment=*/*.parquet")}
    tile_store.retile(spark, stored, spark.createDataFrame([(1, 0, 0, 0, 10, 4)], CUTS), 3)
    assert kept <= {f.name for f in Path(stored).glob("video=*/segment=*/*.parquet")}
    got = fetched(spark, stored, [(1, 0, "a", 1, 1, 9, 3), (1, 0, "b", 1, 1, 9, 5)])
    assert {k[2]: n for k, (_, n) in got.items()} == {"a": 40, "b": 80}
    assert all(np.array_equal(d, picture(10 + k[3])[1 : 3 if k[2] == "a" else 5, 1:9]) for k, (d, _) in got.items())
    tile_store.retile(spark, stored, spark.createDataFrame([(1, 0, None, None, None, None)], CUTS), 3)
    assert {n for _, n in fetched(spark, stored, [(1, 0, "a", 1, 1, 2, 2)]).values()} == {80}


def test_layouts_chosen_by_regret_are_stored(spark, tmp_path):
    costs = TileCosts(10, 8, segment_frames=3, tile=1, encode=1)
    boxes = spark.createDataFrame([(1, 0, "car", 2, 3, 5, 6), (1, 4, "bus", 0, 0, 10, 8)], "video long, frame int, label string, x1 int, y1 int, x2 int, y2 int")
    asked = spark.createDataFrame([(k, "car", 0, 9) for k in (1, 2, 3)] + [(4, "bus", 0, 9)], "seq int, label string, first_frame int, last_frame int")
    cuts = tile_store.chosen_cuts(boxes, choose_layouts(boxes, asked, costs), costs)
    assert sorted(map(tuple, cuts.collect())) == [(1, 0, 2, 3, 5, 6), (1, 1, None, None, None, None)]
    path = str(tmp_path / "tiles")
    tile_store.write_tiles(pictures(spark, [(1, f) for f in range(6)]), cuts, path, 3)
    assert {k[1]: n for k, (_, n) in fetched(spark, path, [(1, 0, "car", 2, 3, 5, 6), (1, 1, "bus", 2, 3, 5, 6)]).items()} == {0: 9, 1: 80}


def test_odd_pictures_and_regions(spark, tmp_path):
    path = str(tmp_path / "tiles")
    twice = pictures(spark, [(None, 0), (None, 0), (1, 0)])
    odd = spark.createDataFrame([(1, None, 10, 8, bytearray(80)), (1, 1, 10, 8, None), (1, 2, None, 8, bytearray(80))], tile_store.PICTURES)
    tile_store.write_tiles(twice.union(odd), spark.createDataFrame([(None, 0, 2, 3, 5, 6)], CUTS), path, 3)
    got = fetched(spark, path, [(None, 0, None, 3, 3, 4, 4), (None, 0, None, 3, 3, 4, 4), (1, 0, "a", 3, 3, 3, 4), (1, 0, "b", None, 3, 4, 4), (1, None, "c", 0, 0, 9, 9), (1, 0, "d", 50, 50, 60, 60), (7, 0, "e", 0, 0, 9, 9)])
    assert list(got) == [(None, 0, None, 0, 3, 3)] and np.array_equal(next(iter(got.values()))[0], picture(0)[3:4, 3:4]) and next(iter(got.values()))[1] == 18
    assert fetched(spark, path, []) == {}
    with pytest.raises(Exception, match="of 3 bytes"):
        tile_store.write_tiles(spark.createDataFrame([(1, 0, 10, 8, bytearray(3))], tile_store.PICTURES), spark.createDataFrame([], CUTS), str(tmp_path / "other"), 3)


def test_segments_are_written_by_many_tasks(spark, tmp_path):
    """A folder takes a writer's time however small it is; few tasks wrote them all where there were few bytes."""
    path = str(tmp_path / "tiles")
    keys = [(1, f) for f in range(40)]
    for _ in range(2):  # a new store, then one that is written again
        tile_store.write_tiles(pictures(spark, keys), spark.createDataFrame([], CUTS), path, 1)
        files = list(Path(path).glob("video=*/segment=*/*.parquet"))
        assert len(files) == 40 and len({f.name.split("-")[1] for f in files}) > 20
