"""Joins of boxes by overlap, and semi joins on items."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stbox import overlaps

#: Rows of a side that are sent to every task instead of a partition of space.
FEW = 256
#: Rows of a side in one cell, about; pairs that are compared at a time; cells at most (beyond, they are split by rows).
QUOTA, PAIRS, MOST_CELLS = 4096, 1 << 20, 1 << 14
#: Boxes from which the partition is made, about.
SAMPLE = 20_000


@dataclass(frozen=True)
class Partition:
    """A k-d tree over x, y and t. Node i is cut at cut[i] across axis[i] (-1: it is the cell leaf[i]); what is below the cut goes to below[i], the rest to above[i].

    low, high: bounds of the cells, half-open. a, b: parts into which a cell's left and right rows are dealt. first: number of a cell's first pair of parts.
    """

    axis: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    above: np.ndarray
    leaf: np.ndarray
    low: np.ndarray
    high: np.ndarray
    a: np.ndarray
    b: np.ndarray
    first: np.ndarray


def partition(left: np.ndarray, right: np.ndarray, n_left: int, n_right: int, quota: int = QUOTA) -> Partition:
    """The partition for samples of both sides (rows of low and high x, y, t) that stand for so many rows.

    A cell is halved at the median of its boxes' centres, across the axis on which they spread most for their size, while it has more than quota rows of a side and that
    spread is more than twice the size. Where boxes lie upon one another no cut parts them; such a cell's rows are dealt into parts, and each part of the left meets each of the right.
    """
    every = np.concatenate([left, right])
    side = np.repeat([0, 1], [len(left), len(right)])
    weight = np.array([n_left / max(1, len(left)), n_right / max(1, len(right))])
    low, high = every[:, :3], every[:, 3:]
    with np.errstate(invalid="ignore"):
        centre = np.where(np.isfinite(low) & np.isfinite(high), low + (high - low) / 2, np.nan)
    axis, cut, below, above, leaf, bounds, parts = [], [], [], [], [], [], []

    def grow(some: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> int:
        i = len(axis)
        for x, none in ((axis, -1), (cut, 0.0), (below, -1), (above, -1), (leaf, -1)):
            x.append(none)
        rows = np.bincount(side[some], minlength=2) * weight
        if rows.max(initial=0) > quota and len(bounds) < MOST_CELLS:
            best = (2.0, -1, 0.0)
            for d in range(3):
                c = centre[some, d]
                c = c[np.isfinite(c)]
                if len(c) * 2 > len(some):
                    near, middle, far = np.quantile(c, [0.1, 0.5, 0.9])
                    size = np.median((high - low)[some, d])
                    if near < far and lower[d] < middle < upper[d] and (far - near) / max(size, 1e-300) > best[0]:
                        best = ((far - near) / max(size, 1e-300), d, middle)
            _, d, middle = best
            if d >= 0:
                axis[i], cut[i] = d, middle
                inner, outer = upper.copy(), lower.copy()
                inner[d] = outer[d] = middle
                below[i] = grow(some[low[some, d] < middle], lower, inner)
                above[i] = grow(some[high[some, d] >= middle], outer, upper)
                return i
        leaf[i] = len(bounds)
        bounds.append((lower, upper))
        parts.append(np.maximum(1, np.ceil(rows / quota)).astype(np.int64))
        return i

    grow(np.arange(len(every)), np.full(3, -np.inf), np.full(3, np.inf))
    deal = np.array(parts)
    first = np.append(0, np.cumsum(deal[:, 0] * deal[:, 1]))
    return Partition(*map(np.array, (axis, cut, below, above, leaf)), *(np.array([b[k] for b in bounds]) for k in (0, 1)), deal[:, 0], deal[:, 1], first)


def cells_of(p: Partition, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """row and cell of each box and cell that meet."""
    row, node = np.arange(len(boxes)), np.zeros(len(boxes), np.int64)
    rows, cells = [], []
    while len(row):
        ended = p.axis[node] < 0
        rows.append(row[ended])
        cells.append(p.leaf[node[ended]])
        row, node = row[~ended], node[~ended]
        d, cut = p.axis[node], p.cut[node]
        down, up = boxes[row, d] < cut, boxes[row, d + 3] >= cut
        row, node = np.concatenate([row[down], row[up]]), np.concatenate([p.below[node[down]], p.above[node[up]]])
    return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _corners(box: str) -> list[Column]:
    """Low x, y, t, high x, y, t as doubles, in microseconds; a missing bound of t is infinite."""
    b = F.col(box)
    micros = lambda m, none: F.coalesce(F.timestamp_diff("MICROSECOND", F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz"), b.getField(f"t{m}")).cast("double"), F.lit(none))
    return [*(b.getField(f"{d}min") for d in "xy"), micros("min", float("-inf")), *(b.getField(f"{d}max") for d in "xy"), micros("max", float("inf"))]


def _whole(df: DataFrame, box: str) -> DataFrame:
    """Rows whose box has x and y."""
    b = F.col(box)
    sound = [b.getField(f"{d}{m}") for d in "xy" for m in ("min", "max")]
    kept = F.lit(True)
    for c in sound:
        kept &= c.isNotNull() & ~F.isnan(c)
    return df.filter(kept)


def _matrix(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.stack([batch.column(at + k).to_numpy(zero_copy_only=False) for k in range(6)], 1) if batch.num_rows else np.zeros((0, 6))


def sweep(left: np.ndarray, right: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows whose boxes meet in x, each once: a sweep over x, in which a box meets those of the other side that begin within it. About ``most`` at a time."""
    order = np.argsort(left[:, 0], kind="stable"), np.argsort(right[:, 0], kind="stable")
    begins = left[order[0], 0], right[order[1], 0]
    for one, other, mine, how in ((0, 1, left, "left"), (1, 0, right, "right")):
        start = np.searchsorted(begins[other], begins[one], how)
        stop = np.maximum(np.searchsorted(begins[other], mine[order[one], 3], "right"), start)
        upto = np.cumsum(stop - start)
        i = 0
        while i < len(start):
            to = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, "right")))
            counts = (stop - start)[i:to]
            own = np.repeat(np.arange(i, to), counts)
            its = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(start[i:to], counts)
            pair = order[one][own], order[other][its]
            yield pair if one == 0 else pair[::-1]
            i = to


def overlap_join(left: DataFrame, right: DataFrame, left_box: str = "bbox", right_box: str = "region", quota: int = QUOTA) -> DataFrame:
    """All pairs of rows whose boxes overlap in all dimensions that both have; both sides' columns must have different names.

    A side of FEW rows or fewer, by count, goes to every task. Otherwise space and time are parted by a k-d tree made of a sample of both sides, so that cells have about
    quota rows of a side wherever boxes are dense; a cell that no cut relieves has its rows dealt into parts. Cells are groups that Spark shuffles; within one a plane sweep finds the pairs, which leave in batches.
    A pair is taken only in the cell with the lower corner of its intersection, so none comes twice. A box goes to every cell that it touches: those without bounds on a
    side to many, so they should be few, or the bound missing throughout (then nothing is cut across it).

    Bounds may be infinite. Boxes without x or y, or with NaN there, meet nothing; a missing z or t meets any. Equal rows make pairs each. Times are compared to the microsecond up to the year 2255. Empty tables give no rows.
    """
    left, right = _whole(left, left_box), _whole(right, right_box)
    meets = overlaps(F.col(left_box), F.col(right_box))
    for few, many in ((right, left), (left, right)):
        if few.limit(FEW + 1).count() <= FEW:  # so many rows at most are sent
            return many.join(F.broadcast(few), meets).select(*left.columns, *right.columns)
    n_left, n_right = left.count(), right.count()
    spark = left.sparkSession
    sampled = lambda df, box, n: np.array([list(r) for r in df.select(*_corners(box)).sample(min(1.0, SAMPLE / n), 7).collect()], float).reshape(-1, 6)
    p = partition(sampled(left, left_box, n_left), sampled(right, right_box, n_right), n_left, n_right, quota)
    sent = spark.sparkContext.broadcast(p)  # MOST_CELLS cells at most

    def dealt(df: DataFrame, box: str, mine: int) -> DataFrame:
        names = df.columns
        rows = df.select(F.struct(*names).alias("_row"), *[c.alias(f"_k{k}") for k, c in enumerate(_corners(box))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, dealt_out = sent.value, TaskContext.get().partitionId() * 7919
            for batch in batches:
                row, cell = cells_of(p, _matrix(batch, 1))
                turn = dealt_out + row
                dealt_out += batch.num_rows
                # A left row is in one part, and meets all parts of the right; so it comes once for each of them.
                copies = (p.b, p.a)[mine][cell]
                own = np.repeat(turn % (p.a, p.b)[mine][cell], copies)
                each = np.arange(len(own)) - np.repeat(np.cumsum(copies) - copies, copies)
                row, cell = np.repeat(row, copies), np.repeat(cell, copies)
                spot = p.first[cell] + (own * p.b[cell] + each if mine == 0 else each * p.b[cell] + own)
                for at in range(0, len(row), 1 << 16):
                    took = batch.take(pa.array(row[at : at + (1 << 16)]))
                    yield pa.RecordBatch.from_arrays([*took.columns, pa.array(cell[at : at + (1 << 16)]), pa.array(spot[at : at + (1 << 16)])], [*batch.schema.names, "_cell", "_spot"])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_cell", T.LongType()), T.StructField("_spot", T.LongType())]))

    sides = []
    for mine, (df, box) in enumerate(((left, left_box), (right, right_box))):
        out = dealt(df, box, mine).withColumnRenamed("_row", f"_row{mine}")
        sides.append(out.withColumn("_side", F.lit(mine)))
    both = sides[0].unionByName(sides[1], allowMissingColumns=True).select("_side", "_cell", *[f"_k{k}" for k in range(6)], "_row0", "_row1", "_spot")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        whole = pa.Table.from_batches(list(batches)).combine_chunks().to_batches()[0]
        own = [np.flatnonzero(whole.column(0).to_numpy() == k) for k in (0, 1)]
        boxes = _matrix(whole, 2)
        a, b = boxes[own[0]], boxes[own[1]]
        cell = int(whole.column(1)[0].as_py())
        low, high = p.low[cell], p.high[cell]
        for i, j in sweep(a, b):
            corner = np.maximum(a[i, :3], b[j, :3])
            kept = (np.minimum(a[i, 3:], b[j, 3:]) >= corner).all(1) & (corner >= low).all(1) & ((corner < high) | (high == np.inf)).all(1)
            i, j = own[0][i[kept]], own[1][j[kept]]
            for at in range(0, len(i), 1 << 14):
                yield pa.RecordBatch.from_arrays([whole.column(8 + k).take(pa.array(x[at : at + (1 << 14)])) for k, x in enumerate((i, j))], ["_row0", "_row1"])

    schema = T.StructType([T.StructField(f"_row{k}", both.schema[f"_row{k}"].dataType) for k in (0, 1)])
    pairs = both.groupBy("_spot").applyInArrow(joined, schema).select("_row0.*", "_row1.*")
    return pairs.filter(meets)  # z as well


def with_items(table: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of a table whose item is among those of another frame; nothing is collected."""
    return table.join(items.select("item_id"), "item_id", "left_semi")
