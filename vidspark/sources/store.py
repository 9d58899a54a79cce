"""Stored object tables: Parquet folders by camera, laid out along a Hilbert curve of x, y and time, so that a volume or interval touches few files and row groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import BBOXES, TRAJECTORIES

#: Bits of each dimension on the curve; rows in one file, about, and in one row group.
BITS, FILE_ROWS, GROUP_BYTES = 16, 2_000_000, 8 << 20


def hilbert(x: np.ndarray, y: np.ndarray, t: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each point of a cube of 2^bits a side on its Hilbert curve (J. Skilling, 2004): neighbours on the curve are neighbours in space."""
    v = [np.asarray(c, np.int64).copy() for c in (x, y, t)]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for c in v:
            up = (c & bit) > 0
            swap = np.where(up, 0, (v[0] ^ c) & low)
            v[0] ^= np.where(up, low, swap)
            if c is not v[0]:
                c ^= swap
    v[1] ^= v[0]
    v[2] ^= v[1]
    turn = np.zeros_like(v[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(v[2] & (1 << level), (1 << level) - 1, 0)
    out = np.zeros_like(v[0])
    for level in range(bits - 1, -1, -1):
        for c in v:
            out = (out << 1) | ((c ^ turn) >> level & 1)
    return out


@F.pandas_udf(T.LongType())
def _place(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for x, y, t in batches:
        yield pd.Series(hilbert(x.to_numpy(), y.to_numpy(), t.to_numpy()))


def curve(points: list[Column], df: DataFrame) -> Column:
    """Place of three numbers of each row on the curve through all of them; nulls and infinities lie at the lower end."""
    finite = lambda c: F.when((F.abs(c) < F.lit(float("inf"))) & ~F.isnan(c), c)
    sound = [finite(p.cast("double")) for p in points]
    ends = df.agg(*[f(p).alias(f"{n}{i}") for i, p in enumerate(sound) for n, f in (("a", F.min), ("b", F.max))]).first()
    cells = []
    for i, p in enumerate(sound):
        a, b = ends[f"a{i}"], ends[f"b{i}"]
        width = (b - a) if a is not None and b > a else 1.0
        cells.append(F.coalesce(((p - (a or 0.0)) / width * (2**BITS - 1)).cast("long"), F.lit(0).cast("long")))
    return _place(*cells)


def _centre(box: str) -> list[Column]:
    b = F.col(box)
    return [*((b.getField(f"{d}min") + b.getField(f"{d}max")) / 2 for d in "xy"), F.unix_micros(b.getField("tmin").cast("timestamp"))]


def _put(df: DataFrame, points: list[Column], path: str, append: bool) -> None:
    n = df.count()
    placed = df.withColumn("_place", curve(points, df))
    files = max(1, -(-n // FILE_ROWS))
    laid = placed.repartitionByRange(files, "camera_id", "_place").sortWithinPartitions("camera_id", "_place").drop("_place")
    writer = laid.write.partitionBy("camera_id").option("parquet.block.size", GROUP_BYTES).option("partitionOverwriteMode", "dynamic")
    writer.mode("append" if append else "overwrite").parquet(path)


def write_tables(trajectories: DataFrame, bboxes: DataFrame, path: str, append: bool = False) -> None:
    """Writes both object tables under a path. Cameras that are in the tables take the place of what is stored of them, or are added to it; other cameras stay. Rows without camera are one camera.

    Boxes lie along the curve of their centres and times, trajectories along that of the centres of their extents and their first instants. A hot camera is spread over files, as files are ranges of the curve.
    """
    _put(bboxes.select(*BBOXES.fieldNames()), _centre("bbox"), f"{path}/bboxes", append)
    first = F.unix_micros(F.get(F.col("traj"), F.lit(0))["t"].cast("timestamp"))
    _put(trajectories.select(*TRAJECTORIES.fieldNames()), [*_centre("largest_bbox")[:2], first], f"{path}/trajectories", append)


def read_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Trajectories and boxes that are stored under a path; for ``World.with_tables``."""
    return spark.read.schema(TRAJECTORIES).parquet(f"{path}/trajectories"), spark.read.schema(BBOXES).parquet(f"{path}/bboxes")
