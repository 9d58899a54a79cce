"""ROI videos: cropped and padded frames, written and read by a data source of uncompressed files.

A file is one item's video: 16 bytes of head (magic, width, height, frames), an item id with its length, the index of frames (4 bytes each, ascending), then width x height bytes for each
frame. So a reader finds any frame by its place, and a long video is read by many tasks.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import shutil
import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

NAME = "roi_video"
SCHEMA = "item_id string, frame_index int, width int, height int, data binary"
SUFFIX = ".roi"
#: Frames that one task reads, unless the option frames_per_task says otherwise.
FRAMES_PER_TASK = 4096
_HEAD = struct.Struct("<4sIII")
_MAGIC = b"ROI1"


def local_path(path: str) -> str:
    """The folder that a path or file URI names: one that driver and executors share, as it is opened by name."""
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"videos are written to a folder that is mounted everywhere, not to {path}")
    return parsed.path


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir; without that setting a temporary one, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="vidspark-")
    return f"{local_path(base)}/vidspark-{name}-{uuid.uuid4().hex}"


def canvases(plan: DataFrame, frames: DataFrame) -> DataFrame:
    """Each crop of a plan (``video.roi_plan``) on its canvas, as SCHEMA: what is outside of the crop, or the crop outside of the frame, is 0.

    frames: frame, width, height, data (a byte a pixel, row by row). Frames that are missing or null give no canvas; those that are repeated give one each.
    """
    rows = plan.join(frames.select("frame", "width", "height", "data"), "frame").filter("data IS NOT NULL AND item_id IS NOT NULL")
    names = ["item_id", "frame_index", "x1", "y1", "x2", "y2", "out_w", "out_h", "pad_x", "pad_y", "width", "height", "data"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(batch.column(n).to_pylist() for n in names[2:]), strict=True):
                x1, y1, x2, y2, out_w, out_h, pad_x, pad_y, width, height, data = row
                picture = np.frombuffer(data, np.uint8).reshape(height, width)[y1:y2, x1:x2]
                canvas = np.zeros((out_h, out_w), np.uint8)
                h, w = min(picture.shape[0], out_h - pad_y), min(picture.shape[1], out_w - pad_x)
                canvas[pad_y : pad_y + h, pad_x : pad_x + w] = picture[:h, :w]
                out.append(canvas.tobytes())
            columns = [batch.column(n) for n in ("item_id", "frame_index", "out_w", "out_h")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], [c.split()[0] for c in SCHEMA.split(", ")])

    return rows.select(*names).mapInArrow(cut, SCHEMA)


def write_videos(pictures: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes a file per item to a folder; pictures as SCHEMA. An item's frames meet in one task, sorted by Spark, and pass through it one by one."""
    pictures.sparkSession.dataSource.register(RoiVideoSource)
    rows = pictures.select(*[c.split()[0] for c in SCHEMA.split(", ")])
    rows.repartition("item_id").sortWithinPartitions("item_id", "frame_index").write.format(NAME).mode(mode).save(path)


def read_videos(spark: SparkSession, path: str, frames_per_task: int = FRAMES_PER_TASK) -> DataFrame:
    """The pictures of a folder, as SCHEMA. A task reads some frames; filters on frame_index and item_id reach the source where spark.sql.python.filterPushdown.enabled is set."""
    spark.dataSource.register(RoiVideoSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(NAME).option("frames_per_task", frames_per_task).option("pushdown", pushdown).load(path)


class RoiVideoSource(DataSource):
    """``spark.read`` and ``write.format("roi_video")``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        kind = FilteringVideoReader if self.options.get("pushdown", "false") == "true" else VideoReader
        return kind(local_path(self.options["path"]), int(self.options.get("frames_per_task", FRAMES_PER_TASK)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return VideoWriter(local_path(self.options["path"]), overwrite)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task, in the staging folder."""

    files: list[str]


def _file_name(item: str) -> str:
    name = quote(item, safe="")
    return (name if len(name) <= 100 else f"{name[:60]}-{hashlib.sha256(item.encode()).hexdigest()}") + SUFFIX


class VideoWriter(DataSourceArrowWriter):
    """Tasks write to a staging folder, under names of their own attempt; the commit moves files to their place, an abort drops the folder. Files of a failed task or a second attempt are never seen."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.staging = f"{path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        os.makedirs(folder, exist_ok=True)
        files: list[str] = []
        try:
            item, size, index, pixels = None, (0, 0), [], None

            def close() -> None:
                """Head and index, then the pixels that were put aside."""
                if pixels is None:
                    return
                name = f"{folder}/{_file_name(item)}"
                with open(name, "wb") as out:
                    key = item.encode()
                    out.write(_HEAD.pack(_MAGIC, *size, len(index)) + struct.pack("<I", len(key)) + key + np.array(index, "<i4").tobytes())
                    pixels.seek(0)
                    shutil.copyfileobj(pixels, out, 1 << 20)
                pixels.close()
                files.append(name)

            for batch in iterator:
                for name, frame, width, height, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if name is None or frame is None or data is None:
                        continue
                    if name != item:
                        close()
                        item, size, index, pixels = name, (width, height), [], tempfile.TemporaryFile(dir=folder)
                    if (width, height) != size or len(data) != width * height:
                        raise ValueError(f"a picture of {item} is {width} x {height} of {len(data)} bytes, the video {size[0]} x {size[1]}")
                    index.append(frame)
                    pixels.write(data)
            close()
        except BaseException:
            shutil.rmtree(folder, ignore_errors=True)
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        new = {os.path.basename(f): f for m in messages if m is not None for f in m.files}
        os.makedirs(self.path, exist_ok=True)
        if self.overwrite:
            for name in os.listdir(self.path):
                if name.endswith(SUFFIX) and name not in new:
                    os.remove(f"{self.path}/{name}")
        for name, file in new.items():
            os.replace(file, f"{self.path}/{name}")
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)
        with contextlib.suppress(OSError):
            os.rmdir(self.path)  # if it was made for this and is empty


@dataclass
class Frames(InputPartition):
    """Places of frames in files: (file, first, one beyond the last)."""

    spans: list[tuple[str, int, int]]


def _head(file) -> tuple[str, int, int, int, int]:
    """item, width, height, frames and where the index begins."""
    magic, width, height, n = _HEAD.unpack(file.read(_HEAD.size))
    if magic != _MAGIC:
        raise ValueError(f"{file.name} is no video of regions")
    (size,) = struct.unpack("<I", file.read(4))
    return file.read(size).decode(), width, height, n, _HEAD.size + 4 + size


class VideoReader(DataSourceReader):
    """Plans by heads, and by indices where frames are asked for; a task seeks to its frames and reads no others."""

    def __init__(self, path: str, frames_per_task: int):
        self.path, self.most = path, frames_per_task
        self.low, self.high, self.items = -(2**31), 2**31 - 1, None

    def partitions(self) -> list[InputPartition]:
        out, held, size = [], [], 0
        bound = self.low > -(2**31) or self.high < 2**31 - 1
        for name in sorted(n for n in os.listdir(self.path) if n.endswith(SUFFIX)):
            if self.items is not None and name not in {_file_name(i) for i in self.items if i is not None}:
                continue
            with open(f"{self.path}/{name}", "rb") as file:
                _, _, _, n, _ = _head(file)
                first, last = 0, n
                if bound:
                    index = np.frombuffer(file.read(4 * n), "<i4")
                    first, last = (int(np.searchsorted(index, x, side)) for x, side in ((self.low, "left"), (self.high, "right")))
            while first < last:
                to = min(last, first + self.most - size)
                held.append((name, first, to))
                size, first = size + to - first, to
                if size == self.most:
                    out.append(Frames(held))
                    held, size = [], 0
        return [*out, *([Frames(held)] if held else [])] or [Frames([])]

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        for name, first, last in partition.spans:
            with open(f"{self.path}/{name}", "rb") as file:
                item, width, height, n, at = _head(file)
                file.seek(at + 4 * first)
                index = np.frombuffer(file.read(4 * (last - first)), "<i4")
                file.seek(at + 4 * n + first * width * height)
                for k in range(0, last - first, step := max(1, (1 << 23) // max(1, width * height))):
                    some = index[k : k + step]
                    data = [file.read(width * height) for _ in some]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(some)), pa.array(some), pa.array([width] * len(some), pa.int32()), pa.array([height] * len(some), pa.int32()), pa.array(data, pa.binary())], [c.split()[0] for c in SCHEMA.split(", ")])


class FilteringVideoReader(VideoReader):
    """A reader that takes filters; Spark refuses it where pushdown to Python sources is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes bounds on frame_index and names of items; leaves all others to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == ("frame_index",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            elif getattr(f, "attribute", None) == ("item_id",) and isinstance(f, (EqualTo, In)):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.items = names if self.items is None else self.items & names
            else:
                yield f


def _checksums(data: pd.Series) -> pd.Series:
    places = np.arange(1, 1 + max((len(d) for d in data if d is not None), default=0), dtype=np.int64)
    return pd.Series([0 if d is None else int(np.frombuffer(d, np.uint8) @ places[: len(d)]) for d in data], dtype="int64")


def checksum(data: Column) -> Column:
    """Sum of each byte times its place, from 1; 0 for null."""
    return F.pandas_udf(_checksums, T.LongType())(data)
