"""Tile layouts of stored video, chosen by the regret of not having chosen them.

A video is cut into segments of frames. A segment is stored whole, or cut at the sides of the region that one label's boxes fill
in it (three by three tiles at most). A query for a label decodes the tiles that its own region touches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Name of the layout without cuts.
WHOLE = "whole"
_CORNERS = ("x1", "y1", "x2", "y2")
CHOICES = "video long, segment long, seq long, layout string, cost long, retiled boolean"
_CHOICES = [c.split()[0] for c in CHOICES.split(", ")]


@dataclass(frozen=True)
class TileCosts:
    """Costs in decoded pixels: of opening a tile, and of encoding a pixel anew."""

    width: int
    height: int
    segment_frames: int
    tile: int = 200
    encode: int = 2

    @property
    def picture(self) -> int:
        return self.width * self.height * self.segment_frames

    @property
    def retile(self) -> int:
        return self.encode * self.picture


def regions(boxes: DataFrame, costs: TileCosts) -> DataFrame:
    """video, segment, label, x1, y1, x2, y2: what each label's boxes fill in a segment; boxes (video, frame, label, corners) with a null or without area count for nothing."""
    inside = lambda c, most: F.least(F.greatest(F.col(c).cast("long"), F.lit(0)), F.lit(most)).alias(c)
    known = boxes.filter(" AND ".join(f"{c} IS NOT NULL" for c in _CORNERS))  # least() would pass over nulls
    placed = known.select(
        "video", F.floor(F.col("frame") / costs.segment_frames).cast("long").alias("segment"), "label", inside("x1", costs.width), inside("y1", costs.height), inside("x2", costs.width), inside("y2", costs.height)
    ).filter(" AND ".join(f"{c} IS NOT NULL" for c in ("segment", "label")))
    return placed.filter("x1 < x2 AND y1 < y2").groupBy("video", "segment", "label").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def _decoded(cut: Column, costs: TileCosts) -> Column:
    """Cost of decoding the tiles that the region in columns x1 to y2 touches, in a layout cut at the sides of ``cut``."""

    def along(low: str, high: str, most: int) -> tuple[Column, Column]:
        a, b = F.col(low), F.col(high)
        start = F.when(a < cut[low], 0).when(a < cut[high], 1).otherwise(2)
        end = F.when(b > cut[high], 3).when(b > cut[low], 2).otherwise(1)
        at = lambda k: F.when(k == 0, 0).when(k == 1, cut[low]).when(k == 2, cut[high]).otherwise(most)
        return at(end) - at(start), end - start

    (w, across), (h, down) = along("x1", "x2", costs.width), along("y1", "y2", costs.height)
    return (w * h * costs.segment_frames + costs.tile * across * down).cast("long")


def query_costs(boxes: DataFrame, queries: DataFrame, costs: TileCosts) -> DataFrame:
    """video, segment, seq, layouts, costs: what each query (seq, label, first_frame, last_frame) costs in the segments that it touches, under each layout.

    A segment has a layout a label seen there, by name, after the whole one. Queries for labels that are not seen cost nothing and give no rows; nor do those with a null.
    """
    segment = Window.partitionBy("video", "segment")
    cuts = F.array_sort(F.collect_list(F.struct("label", "x1", "y1", "x2", "y2")).over(segment))
    seen = regions(boxes, costs).withColumn("_cuts", cuts)
    whole = F.lit(costs.picture + costs.tile).cast("long")
    priced = seen.withColumn("layouts", F.concat(F.array(F.lit(WHOLE)), F.transform("_cuts", lambda c: c["label"]))).withColumn("costs", F.concat(F.array(whole), F.transform("_cuts", lambda c: _decoded(c, costs))))
    first, last = F.col("segment") * costs.segment_frames, (F.col("segment") + 1) * costs.segment_frames - 1
    asked = queries.select("seq", F.col("label").alias("_label"), "first_frame", "last_frame")
    met = priced.join(asked, (F.col("label") == F.col("_label")) & (F.col("first_frame") <= last) & (F.col("last_frame") >= first))
    return met.filter("seq IS NOT NULL").select("video", "segment", F.col("seq").cast("long").alias("seq"), "layouts", "costs")


def choose_layouts(boxes: DataFrame, queries: DataFrame, costs: TileCosts) -> DataFrame:
    """video, segment, seq, layout, cost, retiled: what each query decodes in each segment, in order of seq, and the layout that the segment has after it.

    Each query adds, for every layout, what it would have saved; once the greatest sum (the first by name, of equal ones) is more than encoding the segment anew, the
    segment takes that layout and all sums begin again. One segment's queries are a sequence by nature: Spark sorts them, and a task holds one segment's sums.
    """
    rows = query_costs(boxes, queries, costs).withColumn("video", F.col("video").cast("long"))
    limit = costs.retile

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, current, regret = None, 0, []
        for batch in batches:
            video, segment, seq, layouts, prices = (batch.column(c).to_pylist() for c in ("video", "segment", "seq", "layouts", "costs"))
            after, paid, anew = [], [], []
            for k, names, price in zip(zip(video, segment, strict=True), layouts, prices, strict=True):
                if k != key:
                    key, current, regret = k, 0, [0] * len(price)
                cost = price[current]
                regret = [r + cost - p for r, p in zip(regret, price, strict=True)]
                most = max(regret)
                changes = most > limit
                if changes:
                    current, regret = regret.index(most), [0] * len(price)
                after.append(names[current])
                paid.append(cost)
                anew.append(changes)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("video", "segment", "seq")), pa.array(after, pa.string()), pa.array(paid, pa.int64()), pa.array(anew, pa.bool_())], names=_CHOICES)

    return rows.repartition("video", "segment").sortWithinPartitions("video", "segment", "seq").mapInArrow(run, CHOICES)
