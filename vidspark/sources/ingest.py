"""Detections to boxes and trajectories."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_COLOR, LABEL_HEIGHT, LABEL_WIDTH, START_TIME
from ..functions.lens import IdentityLens, Lens
from ..functions.stbox import centre, stbox
from ..functions.tpoint import time_of_frame


def boxes(detections: DataFrame, lens: Lens | None = None, start: datetime = START_TIME, seconds_per_frame: float = 1.0, depth: str | float = 1.0) -> DataFrame:
    """A world box per detection: both corners through the lens at a depth (a number or a column's name)."""
    lens = lens or IdentityLens()
    d = F.col(depth).cast("double") if isinstance(depth, str) else F.lit(float(depth))
    a, b = (lens.pixel_to_world(F.col(x).cast("double"), F.col(y).cast("double"), d) for x, y in (("x1", "y1"), ("x2", "y2")))
    t = F.col("t").cast("timestamp_ntz") if "t" in detections.columns else time_of_frame(F.col("frame"), start, seconds_per_frame)
    camera = F.col("camera_id") if "camera_id" in detections.columns else F.lit(None).cast("string").alias("camera_id")
    color = F.col("color") if "color" in detections.columns else F.lit(DEFAULT_COLOR)
    return detections.select(camera, "item_id", "object_type", F.coalesce(color, F.lit(DEFAULT_COLOR)).alias("color"), stbox(*a, *b, t).alias("bbox"))


def trajectories(typed_boxes: DataFrame) -> DataFrame:
    """A row per item from its boxes (with object_type and color): centroids in order of time, and the extent of all boxes."""
    c = centre(F.col("bbox"))
    instant = F.struct(F.col("bbox.tmin").alias("t"), *[c.getField(d).alias(d) for d in "xyz"])
    extent = [f(f"bbox.{d}{m}").alias(f"{d}{m}") for m, f in (("min", F.min), ("max", F.max)) for d in "xyz"]
    out = typed_boxes.groupBy("item_id").agg(F.min("camera_id").alias("camera_id"), F.min("object_type").alias("object_type"), F.min("color").alias("color"), F.array_sort(F.collect_list(instant)).alias("traj"), *extent)
    nothing = F.lit(None).cast("timestamp_ntz")
    largest = F.struct(*[F.col(f"{d}{m}") for m in ("min", "max") for d in "xyz"], nothing.alias("tmin"), nothing.alias("tmax"))
    return out.select("camera_id", "item_id", "object_type", "color", "traj", largest.alias("largest_bbox"))


def ingest(detections: DataFrame, lens: Lens | None = None, start: datetime = START_TIME, seconds_per_frame: float = 1.0, depth: str | float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Trajectories and boxes of detections."""
    typed = boxes(detections, lens, start, seconds_per_frame, depth)
    return trajectories(typed), typed.select("camera_id", "item_id", "bbox")


def merge_boxes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Boxes of both; of new ones only those at instants that the item does not have yet, each once."""
    key = lambda df: df.withColumn("_t", F.col("bbox.tmin"))
    fresh = key(new).join(key(old).select("item_id", "_t").distinct(), ["item_id", "_t"], "left_anti")
    return old.unionByName(fresh.dropDuplicates(["item_id", "_t"]).drop("_t").select(*old.columns))


def merge_trajectories(old: DataFrame, new: DataFrame) -> DataFrame:
    """Trajectories with the instants of both; at an instant that both have, the old one stays.

    An item may have several rows on either side; all their points count. Old points at one instant all stay, of new ones the least does. Null trajectories have no points.
    """
    both = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    box = F.col("largest_bbox")
    extent = [f(box.getField(f"{d}{m}")).alias(f"{d}{m}") for m, f in (("min", F.min), ("max", F.max)) for d in "xyz"]
    first = lambda c: F.min_by(c, F.struct("_new", c)).alias(c)
    side = lambda which: F.flatten(F.collect_list(F.when(which, F.col("traj"))))
    parts = both.groupBy("item_id").agg(first("camera_id"), first("object_type"), first("color"), side(~F.col("_new")).alias("_old"), side(F.col("_new")).alias("_added"), *extent)
    # Both lists in order of time, old before new; a new instant goes if the one before it has its time.
    tagged = lambda c, new: F.transform(F.coalesce(c, F.array().cast(old.schema["traj"].dataType)), lambda p: F.struct(p["t"].alias("t"), F.lit(new).alias("new"), *[p[d].alias(d) for d in "xyz"]))
    every = F.array_sort(F.concat(tagged("_old", False), tagged("_added", True)))
    follows = F.zip_with(every, F.concat(F.array(F.lit(None).cast("timestamp_ntz")), F.transform(every, lambda p: p["t"])), lambda p, before: F.struct(p.alias("p"), before.alias("before")))
    kept = F.filter(follows, lambda x: x["p"].isNotNull() & (~x["p"]["new"] | ~F.equal_null(x["before"], x["p"]["t"])))
    merged = F.transform(kept, lambda x: F.struct(x["p"]["t"].alias("t"), *[x["p"][d].alias(d) for d in "xyz"]))
    nothing = F.lit(None).cast("timestamp_ntz")
    largest = F.struct(*[F.col(f"{d}{m}") for m in ("min", "max") for d in "xyz"], nothing.alias("tmin"), nothing.alias("tmax"))
    return parts.select("camera_id", "item_id", "object_type", "color", merged.alias("traj"), largest.alias("largest_bbox"))


def label_rows(detections: DataFrame, metadata_id: str, width: int = LABEL_WIDTH, height: int = LABEL_HEIGHT) -> DataFrame:
    """Two label rows per box, one for the type and one for the item, corners kept within the picture."""
    within = lambda c, most: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(most)).alias(c)
    return detections.select(F.lit(metadata_id).alias("metadata_id"), F.explode(F.array("object_type", "item_id")).alias("label"), "frame", within("x1", width), within("y1", height), within("x2", width), within("y2", height))
