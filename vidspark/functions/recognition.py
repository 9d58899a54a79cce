"""A detector that needs no model, as a table function: connected regions of bright pixels.

``recognized(frames, 64)`` gives a frame; after ``register(spark)`` SQL may say ``SELECT * FROM regions(TABLE(frames), 64, 1)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

_PICTURE = ("width", "height", "data")
_FOUND = [*(T.StructField(c, T.IntegerType()) for c in ("x1", "y1", "x2", "y2", "pixels")), T.StructField("score", T.DoubleType())]


def connected_regions(on: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """x1, y1, x2, y2 (exclusive) and pixels of each region of a mask, by y1, x1, x2, y2; pixels touch at sides and corners.

    Runs of a row are joined with those of the row above that they touch, so memory and time go with runs, not with pixels a region.
    """
    padded = np.zeros((on.shape[0], on.shape[1] + 2), np.int8)
    padded[:, 1:-1] = on
    change = np.diff(padded, axis=1)
    rows, starts = np.nonzero(change == 1)
    ends = np.nonzero(change == -1)[1]
    parent = list(range(len(rows)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    first = np.searchsorted(rows, np.arange(on.shape[0] + 1)).tolist()
    s, e = starts.tolist(), ends.tolist()
    for y in range(1, on.shape[0]):
        above, here = first[y - 1], first[y]
        while above < first[y] and here < first[y + 1]:
            if s[above] <= e[here] and s[here] <= e[above]:
                a, b = root(above), root(here)
                parent[max(a, b)] = min(a, b)
            if e[above] < e[here]:
                above += 1
            else:
                here += 1
    found: dict[int, list[int]] = {}
    for k, (y, a, b) in enumerate(zip(rows.tolist(), s, e, strict=True)):
        box = found.setdefault(root(k), [a, y, b, y + 1, 0])
        box[0], box[2], box[3], box[4] = min(box[0], a), max(box[2], b), y + 1, box[4] + b - a
    return sorted(map(tuple, found.values()), key=lambda r: (r[1], r[0], r[2], r[3]))


class _Regions:
    @staticmethod
    def analyze(frames: AnalyzeArgument, threshold: AnalyzeArgument, least_pixels: AnalyzeArgument) -> AnalyzeResult:
        if not frames.isTable or not isinstance(frames.dataType, T.StructType):
            raise ValueError("the first argument is a table of frames")
        missing = [c for c in ("frame", *_PICTURE) if c not in frames.dataType.fieldNames()]
        if missing:
            raise ValueError(f"frames need the columns {', '.join(missing)}")
        for name, given in (("threshold", threshold), ("least_pixels", least_pixels)):
            if not given.isConstantExpression or given.value is None or given.value < 1:
                raise ValueError(f"{name} is a constant of 1 or more")
        clashing = [f.name for f in _FOUND if f.name in frames.dataType.fieldNames()]
        if clashing:
            raise ValueError(f"frames have columns of the result: {', '.join(clashing)}")
        return AnalyzeResult(schema=T.StructType([*(f for f in frames.dataType.fields if f.name not in _PICTURE), *_FOUND]))

    def eval(self, frame: Row, threshold: int, least_pixels: int) -> Iterator[tuple]:
        width, height, data = (frame[c] for c in _PICTURE)
        if not width or not height or data is None:
            return
        if len(data) != width * height:
            raise ValueError(f"frame {frame['frame']} has {len(data)} bytes for {width} x {height} pixels")
        kept = tuple(frame[c] for c in frame.__fields__ if c not in _PICTURE)
        for x1, y1, x2, y2, pixels in connected_regions(np.frombuffer(data, np.uint8).reshape(height, width) >= threshold):
            if pixels >= least_pixels:
                yield (*kept, x1, y1, x2, y2, pixels, pixels / ((x2 - x1) * (y2 - y1)))


def recognized(frames: DataFrame, threshold: int, least_pixels: int = 1) -> DataFrame:
    """The regions of pixels of ``threshold`` or more: a row each, with the frame's columns but its picture.

    frames: frame, width, height, data (a byte a pixel, row by row) and others. A frame without picture has no regions, repeated frames have theirs again; the score is the share
    of the box that is filled. Each frame stands for itself, so nothing is shuffled.
    """
    return F.udtf(_Regions)(frames.asTable(), F.lit(threshold), F.lit(least_pixels))


def register(spark: SparkSession, name: str = "regions") -> None:
    """Makes the table function known to SQL: name(TABLE(frames), threshold, least_pixels)."""
    spark.udtf.register(name, F.udtf(_Regions))
