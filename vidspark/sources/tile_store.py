"""Stored tiles: pictures cut as the layout of their segment says, Parquet folders by video and segment, of which a query decodes the tiles that its region touches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tiling import WHOLE, TileCosts, regions

#: A byte a pixel, row by row.
PICTURES = "video long, frame long, width int, height int, data binary"
TILES = "frame long, width int, height int, tile int, x int, y int, w int, h int, data binary, video long, segment long"
FETCHED = "video long, segment long, label string, frame long, x1 int, y1 int, width int, height int, data binary, decoded long"
#: Folders that are named one by one where a query asks for no more than these; beyond, the join alone finds them.
NAMED_FOLDERS = 1000
#: Tasks that segments are dealt to for writing: a folder takes a writer's time, however few bytes it has.
TASKS = 100
_CORNERS = ("x1", "y1", "x2", "y2")
_END = 2**31 - 1


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def chosen_cuts(boxes: DataFrame, choices: DataFrame, costs: TileCosts) -> DataFrame:
    """video, segment, x1, y1, x2, y2: where the layout that each segment has after its last query (``tiling.choose_layouts``) is cut; null corners where it is whole."""
    last = choices.groupBy("video", "segment").agg(F.max_by("layout", "seq").alias("label")).filter(F.col("label") != WHOLE)
    return _by_segment(choices.select("video", "segment").distinct(), regions(boxes, costs).join(last, ["video", "segment", "label"]).drop("label"), "left")


def _by_segment(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Join by video and segment in which a null video is one like others."""
    keyed = other.withColumnsRenamed({"video": "_video", "segment": "_segment"})
    return rows.join(keyed, F.col("video").eqNullSafe(F.col("_video")) & (F.col("segment") == F.col("_segment")), how).drop("_video", "_segment")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each picture as its tiles, numbered row by row."""
    for batch in batches:
        out: list[tuple] = []
        for video, segment, frame, width, height, data, *corners in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(data) != width * height:
                raise ValueError(f"picture {frame} of video {video} is {width} x {height} of {len(data)} bytes")
            picture = np.frombuffer(data, np.uint8).reshape(height, width)
            sides = [(0, most, *(min(max(c, 0), most) for c in some if c is not None)) for some, most in ((corners[::2], width), (corners[1::2], height))]
            xs, ys = (sorted(set(s)) for s in sides)
            tiles = [(x, y, to_x - x, to_y - y) for y, to_y in zip(ys, ys[1:], strict=False) for x, to_x in zip(xs, xs[1:], strict=False)]
            out += [(frame, width, height, k, x, y, w, h, picture[y : y + h, x : x + w].tobytes(), video, segment) for k, (x, y, w, h) in enumerate(tiles)]
        columns = list(zip(*out, strict=True)) or [()] * len(_names(TILES))
        kinds = [pa.int64(), *[pa.int32()] * 7, pa.binary(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _names(TILES))


def write_tiles(pictures: DataFrame, cuts: DataFrame, path: str, segment_frames: int) -> None:
    """Stores pictures (PICTURES) under a path, cut at the sides of their segment's cut (video, segment, x1, y1, x2, y2).

    Segments that are in the pictures take the place of what is stored of them; others stay. A segment is written by one task, sorted by tile, and has ``segment_frames`` pictures.
    Segments without a cut, or with a null in it, are stored whole; of several cuts the least counts. Pictures without frame, size or data are left out; one with bytes missing is an error.
    Pictures without video are one video. Repeated pictures are stored each.
    """
    known = pictures.select(*_names(PICTURES)).filter(" AND ".join(f"{c} IS NOT NULL" for c in ("frame", "width", "height", "data")))
    rows = known.withColumn("segment", F.floor(F.col("frame") / segment_frames).cast("long"))
    sound = cuts.filter(" AND ".join(f"{c} IS NOT NULL" for c in _CORNERS))
    one = sound.groupBy("video", "segment").agg(F.min(F.struct(*_CORNERS)).alias("cut")).select("video", "segment", *[F.col(f"cut.{c}").cast("int").alias(c) for c in _CORNERS])
    tiles = _by_segment(rows, one, "left").select("video", "segment", "frame", "width", "height", "data", *_CORNERS).mapInArrow(_cut, TILES)
    laid = tiles.repartition(TASKS, "video", "segment").sortWithinPartitions("video", "segment", "tile", "frame")
    out = laid.write.partitionBy("video", "segment")
    try:
        out.mode("errorifexists").parquet(path)  # a new store is moved to its place by task, not by segment
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        out.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TILES).parquet(path)


def _meets() -> Column:
    return (F.col("x") < F.col("x2")) & (F.col("x") + F.col("w") > F.col("x1")) & (F.col("y") < F.col("y2")) & (F.col("y") + F.col("h") > F.col("y1"))


def fetch_regions(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The wanted regions (video, segment, label, x1, y1, x2, y2) of all stored frames of their segments, as FETCHED: pixels in the picture, and decoded, the pixels of the tiles that were read for them.

    Only folders of wanted segments are read, and of them the tiles that a region touches. Tiles meet by frame, sorted by Spark; a task holds one region of one frame.
    Regions without area, with a null corner or segment, or outside of the picture give nothing; repeated ones come once, those of a null label under that. Of repeated pictures
    each tile is that of the greatest bytes, and decoded counts all.
    """
    asked = wanted.select("video", "segment", "label", *[F.col(c).cast("int").alias(c) for c in _CORNERS]).filter("x1 < x2 AND y1 < y2").distinct()
    tiles = read_tiles(spark, path)
    folders = asked.select("video", "segment").distinct().limit(NAMED_FOLDERS + 1).collect()
    if len(folders) <= NAMED_FOLDERS:
        videos = {f.video for f in folders}
        named = F.col("video").isin([v for v in videos if v is not None]) | (F.col("video").isNull() if None in videos else F.lit(False))
        tiles = tiles.filter(named & F.col("segment").isin([s for s in {f.segment for f in folders} if s is not None]))
    met = _by_segment(tiles, asked, "inner").filter(_meets())
    key = ["video", "segment", "label", "frame", *_CORNERS]
    sides = ["x", "y", "w", "h", "width", "height", "data"]

    def paste(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, canvas, decoded, done, size = None, None, 0, [], 0

        def close() -> None:
            if now is not None:
                video, segment, label, frame, x1, y1 = now[:6]
                done.append((video, segment, label, frame, max(x1, 0), max(y1, 0), canvas.shape[1], canvas.shape[0], canvas.tobytes(), decoded))

        def made() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), *[pa.int32()] * 4, pa.binary(), pa.int64()]
            columns = list(zip(*done, strict=True)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _names(FETCHED))

        for batch in batches:
            for *own, x, y, w, h, width, height, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x1, y1, x2, y2 = max(own[4], 0), max(own[5], 0), min(own[6], width), min(own[7], height)
                if own != now:
                    close()
                    now, canvas, decoded = own, np.zeros((y2 - y1, x2 - x1), np.uint8), 0
                    size += canvas.size
                tile = np.frombuffer(data, np.uint8).reshape(h, w)
                left, top, right, low = max(x, x1), max(y, y1), min(x + w, x2), min(y + h, y2)
                canvas[top - y1 : low - y1, left - x1 : right - x1] = tile[top - y : low - y, left - x : right - x]
                decoded += w * h
                if size > 1 << 24:  # the open one stays open
                    yield made()
                    done, size = [], 0
        close()
        yield made()

    return met.select(*key, *sides).repartition(*key[:4]).sortWithinPartitions(*key, "y", "x", "data").mapInArrow(paste, FETCHED)


def retile(spark: SparkSession, path: str, cuts: DataFrame, segment_frames: int) -> None:
    """Stores the segments of ``cuts`` anew, cut as these say (whole where a corner is null); other segments are neither read nor written.

    Repeated pictures of a segment become one.
    """
    ends = (0, 0, _END, _END)
    whole = cuts.select("video", "segment", F.lit("").alias("label"), *[F.lit(e).alias(c) for c, e in zip(_CORNERS, ends, strict=True)])
    write_tiles(fetch_regions(spark, path, whole).select(*_names(PICTURES)), cuts, path, segment_frames)
