"""Image-side functions: suppression of boxes, depth, rigid transforms, image losses.

Pixels are rows (frame, y, x, value). The depth part follows the formulas of Godard et al., ICCV 2019.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEPTH_RATIO, MAX_COSINE_DISTANCE, MAX_DEPTH, MAX_IOU, MIN_DEPTH, MIN_SCORE, MOST_A_CLASS, MOST_A_FRAME, SSIM_C1, SSIM_C2


def non_max_suppression(boxes: DataFrame, score: float = MIN_SCORE, iou: float = MAX_IOU, most_a_class: int = MOST_A_CLASS, most_a_frame: int = MOST_A_FRAME) -> DataFrame:
    """Boxes (camera_id, frame, object_type, score, x1, y1, x2, y2, ...) that greedy suppression keeps.

    Boxes are sorted by Spark and pass through tasks in batches; in a batch the best boxes of all groups (camera, frame and class) suppress at once, then the best of what is left. Of a group that goes on in the
    next batch only the boxes kept are held. Of a frame the best ``most_a_frame`` boxes over all classes stay.
    """
    group = ("camera_id", "frame", "object_type")

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, np.zeros((0, 4))
        for batch in batches:
            if not batch.num_rows:
                continue
            values = [batch.column(c) for c in group]
            starts = np.zeros(batch.num_rows, bool)
            for v in values:
                codes = v.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                starts[1:] |= codes[1:] != codes[:-1]
            of = np.cumsum(starts)
            xy = np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")], 1)
            kept = np.zeros(of[-1] + 1, int)
            left = np.arange(len(xy))
            if key == (key := tuple(v[0].as_py() for v in values)):
                kept[0] = len(held)
                own = np.flatnonzero(of == 0)
                free = np.ones(len(xy), bool)
                for box in held:
                    free[own] &= ~_suppressed(xy[own], box[None], iou)
                left = left[free]
            left = left[kept[of[left]] < most_a_class]
            chosen = [np.zeros(0, int)]
            while left.size:
                g = of[left]
                first = np.append(True, g[1:] != g[:-1])
                best = left[first]
                chosen.append(best)
                kept[of[best]] += 1
                left = left[~first & (kept[g] < most_a_class) & ~_suppressed(xy[left], xy[best[np.cumsum(first) - 1]], iou)]
            rows = np.sort(np.concatenate(chosen))
            last = xy[rows[of[rows] == of[-1]]]
            held = np.vstack([held, last]) if not of[-1] and kept[0] > len(last) else last
            key = tuple(v[-1].as_py() for v in values)
            yield batch.take(pa.array(rows))

    corners = [F.asc_nulls_last(c) for c in ("x1", "y1", "x2", "y2")]
    kept = boxes.filter(F.col("score") >= score).repartition(*group).sortWithinPartitions(*group, F.desc("score"), *corners).mapInArrow(greedy, boxes.schema)
    best = Window.partitionBy("camera_id", "frame").orderBy(F.desc("score"), "object_type", "x1", "y1", "x2", "y2")
    return kept.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= most_a_frame).drop("_rank")


def _suppressed(boxes: np.ndarray, by: np.ndarray, iou: float) -> np.ndarray:
    """Whether each box shares more than iou of the joint area with the one beside it; not divided, so that boxes right at the limit are judged by the numbers as they are."""
    side = lambda a, b: np.clip(np.minimum(boxes[:, b], by[:, b]) - np.maximum(boxes[:, a], by[:, a]), 0, None)
    area = lambda x: np.clip(x[:, 2] - x[:, 0], 0, None) * np.clip(x[:, 3] - x[:, 1], 0, None)
    both = side(0, 2) * side(1, 3)
    return both > iou * (area(boxes) + area(by) - both)


def run_model(frames: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What a model makes of batches of frames, such as a detector's boxes or a network's disparities; each frame stands for itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield model(batch)

    return frames.mapInPandas(run, schema)


def allowed_classes(boxes: DataFrame, classes: list[str] | None = None) -> DataFrame:
    return boxes if classes is None else boxes.filter(F.col("object_type").isin(classes))


def confirmed_tracks(tracks: DataFrame) -> DataFrame:
    """Detections of confirmed, current tracks: item ids ``class-track``, corners cut to whole pixels."""
    current = tracks.filter(F.col("confirmed") & (F.col("frames_since_update") <= 1))
    corners = [F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")]
    return current.select("camera_id", F.concat_ws("-", "object_type", "track_id").alias("item_id"), "object_type", "frame", *corners)


def associate(detections: DataFrame, tracker, schema: str) -> DataFrame:
    """A tracker function over each camera's detections or frames in order of frame, for one object or several. One camera is sequential by nature."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return tracker(group.sort_values("frame", kind="stable"))

    return detections.groupBy("camera_id").applyInPandas(run, schema)


def cosine_gate(a: Column, b: Column, most: float = MAX_COSINE_DISTANCE) -> Column:
    """Whether two appearance vectors are within a cosine distance."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))) <= most


def cosine_pairs(vectors: DataFrame, anchors: DataFrame, most: float = MAX_COSINE_DISTANCE, block: int = 512) -> DataFrame:
    """vec_id and anchor_id of all pairs within a cosine distance. Both: vec_id, embedding, of one length throughout.

    Blocks of vectors meet blocks of anchors, each pair of blocks is one product of matrices. Nulls and vectors of
    length zero are near nothing.
    """

    def packed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                part = part.filter(part.column(1).is_valid())
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes()], pa.binary())], ["ids", "data"])

    def near(batches):
        for batch in batches:
            for ids, data, anchor_ids, anchor_data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not ids or not anchor_ids:
                    continue
                a, b = np.frombuffer(data, "<f8").reshape(len(ids), -1), np.frombuffer(anchor_data, "<f8").reshape(len(anchor_ids), -1)
                with np.errstate(all="ignore"):
                    within = 1 - a @ b.T / np.sqrt(np.outer((a * a).sum(1), (b * b).sum(1))) <= most
                i, j = np.nonzero(within)
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in i.tolist()], pa.int64()), pa.array([anchor_ids[k] for k in j.tolist()], pa.int64())], ["vec_id", "anchor_id"])

    rows, others = (df.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(packed, "ids array<long>, data binary") for df in (vectors, anchors))
    return rows.crossJoin(others.toDF("anchor_ids", "anchor_data")).mapInArrow(near, "vec_id long, anchor_id long")


def disp_to_scaled(disp: Column, least: float = MIN_DEPTH, most: float = MAX_DEPTH) -> Column:
    return 1 / most + (1 / least - 1 / most) * disp


def disp_to_depth(disp: Column, least: float = MIN_DEPTH, most: float = MAX_DEPTH) -> Column:
    return 1 / disp_to_scaled(disp, least, most)


def rotation(axis_angle: tuple[float, float, float]) -> np.ndarray:
    """Rodrigues' formula, 4 x 4."""
    v = np.array(axis_angle, float)
    angle = float(np.linalg.norm(v))
    out = np.eye(4)
    if angle > 0:
        x, y, z = v / (angle + 1e-7)
        k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
        u = np.array([x, y, z])
        out[:3, :3] = math.cos(angle) * np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * np.outer(u, u)
    return out


def translation(shift: tuple[float, float, float]) -> np.ndarray:
    out = np.eye(4)
    out[:3, 3] = shift
    return out


def rigid(axis_angle: tuple[float, float, float], shift: tuple[float, float, float], invert: bool = False) -> np.ndarray:
    """Turn then shift; inverted: shift back, then turn back."""
    if invert:
        return rotation(axis_angle).T @ translation(tuple(-s for s in shift))
    return translation(shift) @ rotation(axis_angle)


def transform_point(m: np.ndarray, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return tuple(F.lit(float(m[i, 0])) * x + F.lit(float(m[i, 1])) * y + F.lit(float(m[i, 2])) * z + F.lit(float(m[i, 3])) for i in range(3))


def back_project(depth: Column, u: Column, v: Column, intrinsics: np.ndarray) -> tuple[Column, Column, Column]:
    """Point of the cloud: depth times the inverse intrinsics times (u, v, 1)."""
    m = np.linalg.inv(np.asarray(intrinsics, float)[:3, :3])
    return tuple(depth * (F.lit(float(m[i, 0])) * u + F.lit(float(m[i, 1])) * v + F.lit(float(m[i, 2]))) for i in range(3))


def project_points(x: Column, y: Column, z: Column, projection: np.ndarray, width: int, height: int) -> tuple[Column, Column]:
    """Pixel of a point, scaled to -1 ... 1 over the image."""
    p = [F.lit(float(r[0])) * x + F.lit(float(r[1])) * y + F.lit(float(r[2])) * z + F.lit(float(r[3])) for r in np.asarray(projection, float)[:3]]
    u, v = p[0] / (p[2] + 1e-7), p[1] / (p[2] + 1e-7)
    return (u / (width - 1) - 0.5) * 2, (v / (height - 1) - 0.5) * 2


def upsample(pixels: DataFrame) -> DataFrame:
    """Nearest-neighbour doubling: each pixel becomes four."""
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in (0, 1) for j in (0, 1)])).alias("at")
    rest = [c for c in pixels.columns if c not in ("y", "x")]
    return pixels.select("*", at).select(*rest, (F.col("y") * 2 + F.col("at.dy")).alias("y"), (F.col("x") * 2 + F.col("at.dx")).alias("x"))


def smoothness(pixels: DataFrame) -> DataFrame:
    """Per frame: mean of |step of disp| exp(-|step of image|) along x plus the same along y. pixels: frame, y, x, disp, value."""
    out = None
    for line, along in (("y", "x"), ("x", "y")):
        w = Window.partitionBy("frame", line).orderBy(along)
        step = lambda c, w=w: F.abs(F.col(c) - F.lead(c).over(w))
        part = pixels.select("frame", (step("disp") * F.exp(-step("value"))).alias("v")).groupBy("frame").agg(F.avg("v").alias(f"smooth_{along}"))
        out = part if out is None else out.join(part, "frame")
    return out.select("frame", (F.col("smooth_x") + F.col("smooth_y")).alias("smoothness"))


def ssim(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per pixel: (1 - SSIM) / 2 within 0 ... 1, over 3 x 3 windows with reflected borders. Both: frame, y, x, value, every pixel of a frame once.

    A window's sums are those of its three rows, and a row's those of three neighbours, so two passes over neighbours give them, along x and along y; no pixel is multiplied. Of a pixel that is missing, what is
    beside it in its row is missing too for the rows above and below.
    """
    p, q = F.col("p"), F.col("q")
    both = a.select("frame", "y", "x", F.col("value").alias("p")).join(b.select("frame", "y", "x", F.col("value").alias("q")), ["frame", "y", "x"])
    out = both.select("frame", "y", "x", F.struct(F.lit(1.0).alias("n"), p.alias("mp"), q.alias("mq"), (p * p).alias("pp"), (q * q).alias("qq"), (p * q).alias("pq")).alias("s"))
    names = ("n", "mp", "mq", "pp", "qq", "pq")
    for line, along in (("y", "x"), ("x", "y")):
        w = Window.partitionBy("frame", line).orderBy(along)
        beside = lambda f, step, w=w, along=along: F.when(f(along).over(w) == F.col(along) + step, f("s").over(w))
        out = out.select("frame", "y", "x", "s", beside(F.lag, -1).alias("l"), beside(F.lead, 1).alias("r"), F.lag(along).over(w).alias("before"), F.lead(along).over(w).alias("after"))
        # Beyond the first pixel of a line lies the reflection of the second, beyond the last that of the last but one; a line of one pixel is its own neighbour.
        lone = F.col("before").isNull() & F.col("after").isNull()
        left = F.when(lone, F.col("s")).when(F.col("before").isNull(), F.col("r")).otherwise(F.col("l"))
        right = F.when(lone, F.col("s")).when(F.col("after").isNull(), F.col("l")).otherwise(F.col("r"))
        out = out.withColumns({"l": left, "r": right})
        out = out.select("frame", "y", "x", F.struct(*[(F.col(f"s.{c}") + F.coalesce(f"l.{c}", F.lit(0.0)) + F.coalesce(f"r.{c}", F.lit(0.0))).alias(c) for c in names]).alias("s"))
    m = out.select("frame", "y", "x", *[(F.col(f"s.{c}") / F.col("s.n")).alias(c) for c in names[1:]])
    c1, c2 = SSIM_C1, SSIM_C2
    mp, mq = F.col("mp"), F.col("mq")
    top = (2 * mp * mq + c1) * (2 * (F.col("pq") - mp * mq) + c2)
    low = (mp * mp + mq * mq + c1) * (F.col("pp") - mp * mp + F.col("qq") - mq * mq + c2)
    return m.select("frame", "y", "x", F.least(F.greatest((1 - top / low) / 2, F.lit(0.0)), F.lit(1.0)).alias("ssim"))


def depth_metrics(pairs: DataFrame) -> DataFrame:
    """Errors of pred against gt over all rows: abs_rel, sq_rel, rmse, rmse_log and the shares within 1.25, its square and its cube."""
    gt, pred = F.col("gt"), F.col("pred")
    ratio = F.greatest(gt / pred, pred / gt)
    within = [F.avg(F.when(ratio < DEPTH_RATIO**k, 1.0).otherwise(0.0)).alias(f"a{k}") for k in (1, 2, 3)]
    log = F.ln(gt) - F.ln(pred)
    return pairs.agg(
        F.avg(F.abs(gt - pred) / gt).alias("abs_rel"), F.avg((gt - pred) * (gt - pred) / gt).alias("sq_rel"), F.sqrt(F.avg((gt - pred) * (gt - pred))).alias("rmse"), F.sqrt(F.avg(log * log)).alias("rmse_log"), *within
    )
