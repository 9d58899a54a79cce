"""Trajectories that grow as detections arrive.

The store is a folder of runs, each a row per item: level 0 has one a micro-batch, named by its number, and FANOUT runs of a level become one of the next,
so a point is written again once a level. Reading merges the runs that no finished run of a higher level covers. Merging takes of several points at one
instant the least, so it does not matter in which batches, in what order or how often a detection comes.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..constants import START_TIME
from ..functions.lens import Lens
from ..sources.ingest import boxes, trajectories
from ..types import TRAJECTORIES

FANOUT = 8


def merge_segments(segments: DataFrame) -> DataFrame:
    """A row per item from any number of partial ones, with the least point of each instant; extents are joined, other columns are the least."""
    box = F.col("largest_bbox")
    extent = [f(box.getField(f"{d}{m}")).alias(f"{d}{m}") for m, f in (("min", F.min), ("max", F.max)) for d in "xyz"]
    least = [F.min(c).alias(c) for c in ("camera_id", "object_type", "color")]
    parts = segments.groupBy("item_id").agg(*least, F.array_sort(F.flatten(F.collect_list("traj"))).alias("_all"), *extent)
    before = F.concat(F.array(F.lit(None).cast("timestamp_ntz")), F.transform("_all", lambda p: p["t"]))
    follows = F.slice(F.zip_with("_all", before, lambda p, b: F.struct(p.alias("p"), b.alias("b"))), 1, F.size("_all"))
    traj = F.transform(F.filter(follows, lambda x: x["p"]["t"].isNotNull() & ~F.equal_null(x["p"]["t"], x["b"])), lambda x: x["p"])
    nothing = F.lit(None).cast("timestamp_ntz")
    largest = F.struct(*[F.col(f"{d}{m}") for m in ("min", "max") for d in "xyz"], nothing.alias("tmin"), nothing.alias("tmax"))
    return parts.select("camera_id", "item_id", "object_type", "color", traj.alias("traj"), largest.alias("largest_bbox"))


def _runs(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """Level and last batch of each finished run that no other finished one covers, oldest first."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        name = re.fullmatch(r"level-(\d+)-end-(\d+)", status.getPath().getName())
        if name and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append((int(name[1]), int(name[2])))
    covered = lambda level, end: any(up > level and last - FANOUT**up < end <= last for up, last in found)
    return sorted((r for r in found if not covered(*r)), key=lambda r: r[1])


def _run_path(path: str, run: tuple[int, int]) -> str:
    return f"{path}/level-{run[0]}-end-{run[1]:09d}"


def merged_store(spark: SparkSession, path: str) -> DataFrame:
    """The trajectories of all batches that are finished; none if there are none."""
    runs = _runs(spark, path)
    if not runs:
        return spark.createDataFrame([], TRAJECTORIES)
    return merge_segments(spark.read.schema(TRAJECTORIES).parquet(*(_run_path(path, r) for r in runs)))


def add_batch(detections: DataFrame, number: int, path: str, lens: Lens | None = None, start: datetime = START_TIME, seconds_per_frame: float = 1.0) -> None:
    """Adds a batch of detections to the store. The same number again takes its own place, so a batch that failed may be run again.
    A level is made only of batches that are all there, so numbers may come in any order.

    Detections without item have no trajectory; those without time or frame no point in it. Runs that others cover are left for readers; nothing reads them later.
    """
    spark = detections.sparkSession
    known = boxes(detections, lens, start, seconds_per_frame).filter("item_id IS NOT NULL AND bbox.tmin IS NOT NULL")
    merge_segments(trajectories(known)).write.mode("overwrite").parquet(_run_path(path, (0, number)))
    level, size = 1, FANOUT
    while (number + 1) % size == 0:
        parts = [r for r in _runs(spark, path) if number - size < r[1] <= number]
        if (level, number) not in parts and sum(FANOUT ** r[0] for r in parts) == size:  # all its batches are there
            merge_segments(spark.read.schema(TRAJECTORIES).parquet(*(_run_path(path, r) for r in parts))).write.mode("overwrite").parquet(_run_path(path, (level, number)))
        level, size = level + 1, size * FANOUT


def merge_stream(detections: DataFrame, path: str, checkpoint: str, lens: Lens | None = None, start: datetime = START_TIME, seconds_per_frame: float = 1.0, lateness: str | None = None) -> DataStreamWriter:
    """A writer that merges a stream of detections into the store; start() it.

    Without ``lateness`` there is no state and nothing is ever too late. With it, equal detections (item, time and corners) within that time are dropped before they are merged, and
    so is what comes later than it, by Spark's watermark on t.
    """
    if lateness is not None:
        seen = detections.withColumn("_seen", F.col("t").cast("timestamp")).withWatermark("_seen", lateness)
        detections = seen.dropDuplicatesWithinWatermark(["item_id", "t", "x1", "y1", "x2", "y2"]).drop("_seen")
    return detections.writeStream.foreachBatch(lambda batch, number: add_batch(batch, number, path, lens, start, seconds_per_frame)).option("checkpointLocation", checkpoint)
