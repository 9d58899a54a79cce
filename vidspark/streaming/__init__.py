"""Detections as they arrive."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..constants import START_TIME
from ..functions.lens import Lens
from ..sources.ingest import boxes


def stream_boxes(detections: DataFrame, lens: Lens | None = None, start: datetime = START_TIME, seconds_per_frame: float = 1.0) -> DataFrame:
    """World boxes of a stream of detections; without state, as each detection stands for itself."""
    return boxes(detections, lens, start, seconds_per_frame)


def append_boxes(detections: DataFrame, path: str, checkpoint: str, lens: Lens | None = None) -> DataStreamWriter:
    """A writer that appends a stream's boxes to Parquet files, each once; start() it. Trajectories are built from the files."""
    return stream_boxes(detections, lens).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
