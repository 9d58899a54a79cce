"""Regions of interest: which part of which frame an item's own video shows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import OUTPUT_FOLDER, START_TIME
from ..functions.lens import project
from ..functions.tpoint import frame_of_time


#: Cameras that are sent to every task.
MOST_CAMERAS = 10_000


def project_boxes(boxes: DataFrame, cameras: DataFrame, perspective: bool = False, own: bool = False) -> DataFrame:
    """Pixel corners x1, y1, x2, y2 of world boxes in every camera given, or each in its own camera only.

    boxes: item_id, bbox, and camera_id if own is asked for. cameras: camera_id, focal, origin, skew_factor. Every box in every camera is the
    question asked, and cameras are few by nature; they are broadcast only if they are counted to be MOST_CAMERAS or fewer.
    """
    lenses = cameras.select("camera_id", "focal", "origin", "skew_factor")
    if lenses.limit(MOST_CAMERAS + 1).count() <= MOST_CAMERAS:
        lenses = F.broadcast(lenses)
    pairs = boxes.join(lenses, "camera_id") if own else boxes.drop("camera_id").crossJoin(lenses)
    lens = [F.col("focal.x"), F.col("focal.y"), F.col("origin.x"), F.col("origin.y"), F.coalesce(F.col("skew_factor").cast("double"), F.lit(0.0))]
    a, b = (project(F.col(f"bbox.x{m}"), F.col(f"bbox.y{m}"), F.col(f"bbox.z{m}"), *lens, perspective) for m in ("min", "max"))
    return pairs.select("camera_id", "item_id", F.col("bbox.tmin").alias("t"), a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))


def roi_extent(pixel_boxes: DataFrame, keys: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """Per item: first and last time, and width and height of the canvas that holds each of its boxes."""
    size = lambda c: F.bround(F.max(F.col(f"{c}2") - F.col(f"{c}1"))).cast("int")
    return pixel_boxes.groupBy(*keys).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), size("x").alias("out_w"), size("y").alias("out_h"))


def roi_plan(pixel_boxes: DataFrame, start: datetime = START_TIME, seconds_per_frame: float = 1.0, folder: str = OUTPUT_FOLDER, metadata_id: str = "", keys: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """Per item and frame: the crop (corners not below 0, cut to whole pixels), the canvas, its zero padding, and the file it goes to.

    A crop, as wide and high as its corners are apart before they are cut, lies in the middle of the canvas; half pixels go to the right and below. frame_index counts from the
    item's first frame, by frame number, so gaps stay gaps.
    """
    extent = roi_extent(pixel_boxes, keys)
    rows = pixel_boxes.join(extent, list(keys))
    low = lambda c: F.greatest(F.col(c).cast("double"), F.lit(0.0))
    rows = rows.select(*keys, frame_of_time(F.col("t"), start, seconds_per_frame).alias("frame"), frame_of_time(F.col("first_t"), start, seconds_per_frame).alias("_first"), *[low(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")], "out_w", "out_h", *[F.abs(low(f"{c}2") - low(f"{c}1")).cast("int").alias(f"_{c}") for c in "xy"])
    pad = lambda c, side: F.greatest(F.floor((F.col(side) - F.col(f"_{c}")) / 2).cast("int"), F.lit(0))
    path = F.concat(F.lit(f"{folder}/{metadata_id}"), F.col("item_id"), F.lit(".mp4"))
    return rows.select(*keys, "frame", (F.col("frame") - F.col("_first")).alias("frame_index"), "x1", "y1", "x2", "y2", "out_w", "out_h", pad("x", "out_w").alias("pad_x"), pad("y", "out_h").alias("pad_y"), path.alias("path"))


def item_tracks(boxes: DataFrame) -> DataFrame:
    """Per item: its boxes with their times, in order of time, whatever order they came in."""
    return boxes.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct(F.col("bbox.tmin").alias("t"), "bbox"))).alias("track"))


def crops(plan: DataFrame, frames: DataFrame) -> DataFrame:
    """Pixels of the crops: item_id, frame_index, y, x, value on the canvas, from frames (frame, y, x, value)."""
    inside = (F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y2")) & (F.col("x") >= F.col("x1")) & (F.col("x") < F.col("x2"))
    placed = frames.join(plan, "frame").filter(inside)
    return placed.select("item_id", "frame_index", (F.col("y") - F.col("y1") + F.col("pad_y")).alias("y"), (F.col("x") - F.col("x1") + F.col("pad_x")).alias("x"), "value")


def read_frames(spark: SparkSession, path: str, decode: Callable[[str, bytes], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Frames of the video files under a path, as a decoder gives them: it takes a file's path and bytes and yields frames of ``schema``.

    Files are read by Spark's binary source, one is decoded in one task, since a video is sequential by nature. Empty folders give no rows.
    """

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                yield from decode(name, bytes(content))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decoded, schema)


def encode_rois(pixels: DataFrame, plan: DataFrame, encode: Callable[[pd.DataFrame], bytes], keys: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """keys, path, video: each item's crops (see ``crops``) as an encoder packs them, in order of frame, y and x; write them wherever they are to lie.

    One item's video is one group, as an encoder is sequential. Items without pixels have no video.
    """
    paths = plan.select(*keys, "path", "out_w", "out_h").distinct()
    rows = pixels.join(paths, list(keys))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        out = group[[*keys, "path"]].head(1).copy()
        out["video"] = [encode(group.sort_values(["frame_index", "y", "x"], kind="stable"))]
        return out

    return rows.groupBy(*keys).applyInPandas(packed, ", ".join([*(f"{k} string" for k in keys), "path string, video binary"]))


def frame_span(boxes: DataFrame, start: datetime = START_TIME, seconds_per_frame: float = 1.0) -> DataFrame:
    """First and last frame of each item, as a tile store is asked for."""
    t = F.col("bbox.tmin")
    return boxes.groupBy("item_id").agg(F.min(t).alias("a"), F.max(t).alias("b")).select("item_id", frame_of_time(F.col("a"), start, seconds_per_frame).alias("first_frame"), frame_of_time(F.col("b"), start, seconds_per_frame).alias("last_frame"))
