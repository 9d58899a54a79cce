"""Association of detections to tracks, frame by frame: over whole tables, or over streams with keyed state.

The method is that of Wojke, Bewley and Paulus, ICIP 2017: boxes move by a Kalman filter of constant velocity, tracks meet detections
in a cascade from the ones seen last to the ones seen longest ago, by an optimal assignment of cosine distances under gates, and what is left by overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..constants import GREATEST_AGE, HITS_TO_CONFIRM, MAX_COSINE_DISTANCE, MAX_OVERLAP_DISTANCE, MOTION_GATE, POSITION_WEIGHT, VELOCITY_WEIGHT

#: Of equal looks, the nearer by motion is cheaper by up to this.
TIE = 1e-6
#: Matrices of costs of so many numbers are assigned without arrays.
FEW = 64
#: Tasks that cameras are dealt to: many more than there are cores, so that few tasks get two.
TASKS = 200
OUTPUT = "camera_id string, frame int, track_id long, object_type string, confirmed boolean, frames_since_update int, x1 double, y1 double, x2 double, y2 double"


@dataclass(frozen=True)
class Rules:
    """max_distance: of appearances. motion_gate: greatest squared Mahalanobis distance, None for none. max_overlap_distance: 1 - intersection over union. gallery: appearances that a track remembers."""

    max_distance: float = MAX_COSINE_DISTANCE
    motion_gate: float | None = MOTION_GATE
    max_overlap_distance: float = MAX_OVERLAP_DISTANCE
    greatest_age: int = GREATEST_AGE
    hits: int = HITS_TO_CONFIRM
    gallery: int = 100


@dataclass
class Track:
    """mean: centre x and y, width / height, height, and their speeds; spread: variances of place, place with speed, and speed, of x, y and height, which have the same, then of width / height; rows: where its last looks are.

    The four measures do not touch each other in this filter, so it is four filters of two numbers. A track moves on only when it is asked for: ``behind`` is by how many frames.
    """

    track_id: int
    object_type: str | None
    mean: list[float]
    spread: list[float]
    hits: int = 1
    since: int = 0
    confirmed: bool = False
    behind: int = 0
    rows: list[int] = field(default_factory=list)

    def box(self) -> tuple[float, float, float, float]:
        x, y, aspect, h = self.mean[:4]
        return x - aspect * h / 2, y - h / 2, x + aspect * h / 2, y + h / 2


@dataclass
class State:
    """What is known of a camera after frame ``last``. Looks of all tracks are rows of one array; a row without owner is free. odd: a box was not finite."""

    last: int | None = None
    next_id: int = 1
    tracks: list[Track] = field(default_factory=list)
    looks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    owners: list[Track | None] = field(default_factory=list)
    free: list[int] = field(default_factory=list)
    odd: bool = False

    def remember(self, track: Track, look: np.ndarray, most: int) -> None:
        if len(track.rows) >= most:
            self._release(track.rows[: len(track.rows) - most + 1])
            del track.rows[: len(track.rows) - most + 1]
        if not self.free:
            n = len(self.owners)
            if n == len(self.looks):
                self.looks = np.vstack([self.looks.reshape(n, len(look)), np.zeros((max(16, n), len(look)))])
            self.owners.append(None)
            self.free.append(n)
        row = self.free.pop()
        self.looks[row], self.owners[row] = look, track
        track.rows.append(row)

    def _release(self, rows: list[int]) -> None:
        for row in rows:
            self.owners[row] = None
        self.free += rows

    def keep(self, tracks: list[Track], ended: list[Track]) -> None:
        self.tracks = tracks
        for track in ended:
            self._release(track.rows)

    def gallery(self, track: Track) -> np.ndarray:
        return self.looks[track.rows]


def _measured(box: list[float]) -> tuple[float, float, float, float]:
    h = max(box[3] - box[1], 1e-6)
    return (box[0] + box[2]) / 2, (box[1] + box[3]) / 2, (box[2] - box[0]) / h, h


def _begun(box: list[float]) -> tuple[list[float], list[float]]:
    at = _measured(box)
    p, v = POSITION_WEIGHT * at[3] * 2, VELOCITY_WEIGHT * at[3] * 10
    return [*at, 0.0, 0.0, 0.0, 0.0], [p * p, 0.0, v * v, 1e-2 * 1e-2, 0.0, 1e-5 * 1e-5]


def _moved(track: Track) -> Track:
    """The track, where it is expected in this frame."""
    if track.behind:
        x, y, aspect, h, dx, dy, d_aspect, dh = track.mean
        pp, pv, vv, qq, qv, ww = track.spread
        for _ in range(track.behind):
            p, v = POSITION_WEIGHT * h, VELOCITY_WEIGHT * h
            pp, pv, vv = pp + pv + (pv + vv) + p * p, pv + vv, vv + v * v
            qq, qv, ww = qq + qv + (qv + ww) + 1e-2 * 1e-2, qv + ww, ww + 1e-5 * 1e-5
            x, y, aspect, h = x + dx, y + dy, aspect + d_aspect, h + dh
        track.mean, track.spread, track.behind = [x, y, aspect, h, dx, dy, d_aspect, dh], [pp, pv, vv, qq, qv, ww], 0
    return track


def _update(state: State, track: Track, box: list[float], look: np.ndarray | None, rules: Rules) -> None:
    x, y, aspect, h, dx, dy, d_aspect, dh = _moved(track).mean
    pp, pv, vv, qq, qv, ww = track.spread
    p = POSITION_WEIGHT * h
    s, r = pp + p * p, qq + 1e-1 * 1e-1
    a, b, c, d = pp / s, pv / s, qq / r, qv / r
    to = _measured(box)
    gx, gy, ga, gh = to[0] - x, to[1] - y, to[2] - aspect, to[3] - h
    track.mean = [x + a * gx, y + a * gy, aspect + c * ga, h + a * gh, dx + b * gx, dy + b * gy, d_aspect + d * ga, dh + b * gh]
    track.spread = [pp - a * s * a, pv - a * s * b, vv - b * s * b, qq - c * r * c, qv - c * r * d, ww - d * r * d]
    if look is not None:
        state.remember(track, look, rules.gallery)
    track.hits, track.since = track.hits + 1, 0
    track.confirmed |= track.hits >= rules.hits


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the cheapest assignment of all rows, or all columns if they are fewer, by shortest augmenting paths."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assign(cost.T))
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.full(m + 1, n)
    for i in range(n):
        owner[m] = i
        at, least, way, done = m, np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[at] != n:
            done[at] = True
            row = owner[at]
            slack = cost[row] - u[row] - v[:m]
            closer = ~done[:m] & (slack < least)
            least[closer], way[closer] = slack[closer], at
            nxt = int(np.where(done[:m], np.inf, least).argmin())
            delta = least[nxt]
            u[owner[done]] += delta
            v[done] -= delta
            least[~done[:m]] -= delta
            at = nxt
        while at != m:
            owner[at], at = owner[way[at]], way[at]
    return sorted((int(owner[j]), j) for j in range(m) if owner[j] != n)


def _assign_few(cost: list[list[float]]) -> list[tuple[int, int]]:
    """``assign`` by plain numbers, for few rows and columns."""
    if len(cost) > len(cost[0]):
        return sorted((i, j) for j, i in _assign_few([list(c) for c in zip(*cost, strict=True)]))
    n, m = len(cost), len(cost[0])
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [n] * (m + 1)
    for i in range(n):
        owner[m] = i
        at, least, way, done = m, [np.inf] * m, [m] * m, [False] * (m + 1)
        while owner[at] != n:
            done[at] = True
            row, nxt = owner[at], -1
            for j in range(m):
                if not done[j]:
                    slack = cost[row][j] - u[row] - v[j]
                    if slack < least[j]:
                        least[j], way[j] = slack, at
                    if nxt < 0 or least[j] < least[nxt]:
                        nxt = j
            delta = least[nxt]
            for j in range(m + 1):
                if done[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                elif j < m:
                    least[j] -= delta
            at = nxt
        while at != m:
            owner[at], at = owner[way[at]], way[at]
    return sorted((owner[j], j) for j in range(m) if owner[j] != n)


def _paired(cost: np.ndarray, most: float) -> list[tuple[int, int]]:
    """The cheapest assignment, without pairs that cost more than ``most``."""
    if not cost.size:
        return []
    capped = np.minimum(cost, most + 1e-5)
    return [(i, j) for i, j in (_assign_few(capped.tolist()) if cost.size <= FEW else assign(capped)) if cost[i, j] <= most]


def _distances(state: State, tracks: list[Track], boxes: list, looks: np.ndarray | None, rules: Rules) -> np.ndarray:
    if not tracks or not boxes:
        return np.zeros((len(tracks), len(boxes)))
    known = np.array([(*t.mean[:4], t.spread[0], t.spread[3]) for t in map(_moved, tracks)])
    p = np.square(POSITION_WEIGHT * known[:, 3]) + known[:, 4]
    gap = np.array([_measured(b) for b in boxes]) - known[:, None, :4]
    g = np.square(gap)
    motion = g[..., 0] / p[:, None] + g[..., 1] / p[:, None] + g[..., 2] / (known[:, 5:6] + 1e-2) + g[..., 3] / p[:, None]
    # Where there is nothing to look at: the nearest by motion, each within max_distance.
    out = motion / (motion + 1 if rules.motion_gate is None else rules.motion_gate) * rules.max_distance
    for i, track in enumerate(tracks):
        if looks is not None and track.rows:
            look = (1 - state.gallery(track) @ looks.T).min(0)
            out[i] = np.where(look <= rules.max_distance, look + TIE * motion[i] / (motion[i] + 1), np.inf)
    if rules.motion_gate is not None:
        out[motion > rules.motion_gate] = np.inf
    return np.nan_to_num(out, nan=np.inf, posinf=1e5)


def _overlaps(tracks: list[Track], boxes: list) -> np.ndarray:
    own, boxes = np.array([_moved(t).box() for t in tracks]).reshape(-1, 1, 4), np.array(boxes, float)
    side = lambda a, b: np.clip(np.minimum(own[..., b], boxes[:, b]) - np.maximum(own[..., a], boxes[:, a]), 0, None)
    both = side(0, 2) * side(1, 3)
    area = lambda x: np.clip(x[..., 2] - x[..., 0], 0, None) * np.clip(x[..., 3] - x[..., 1], 0, None)
    return 1 - both / np.maximum(area(own) + area(boxes) - both, 1e-12)


def _meet(track: Track, box: list[float]) -> bool:
    a = _moved(track).box()
    return a[0] < box[2] and box[0] < a[2] and a[1] < box[3] and box[1] < a[3]


def step(state: State, frame: int, boxes: np.ndarray, looks: np.ndarray | None, types: list, rules: Rules = Rules()) -> list[tuple]:
    """Takes the next frame into a camera's state; rows (frame, track_id, object_type, confirmed, frames_since_update, x1, y1, x2, y2) of the tracks that were seen in it or the frame before.

    Confirmed tracks, those seen last first, are assigned by appearance; then new tracks, and confirmed ones that were seen in the frame before, by overlap. Detections without a track begin one. A track that is not confirmed ends with the first
    frame that lacks it, a confirmed one after greatest_age frames. Frames between the last and this one count as frames without detections.
    """
    rows: list[tuple] = []
    gap = frame - 1 - state.last if state.last is not None else 0
    for k in range(min(gap, rules.greatest_age + 1)):  # after so many all tracks have ended
        _frame(state, [], None, [], rules)
        rows += _rows(state, state.last + k + 1)
    _frame(state, boxes.tolist(), looks if looks is not None and looks.size else None, types, rules)
    state.last = frame
    return rows + _rows(state, frame)


def _frame(state: State, boxes: list[list[float]], looks: np.ndarray | None, types: list, rules: Rules) -> None:
    for t in state.tracks:
        t.since += 1
        t.behind += 1
    open_ = list(range(len(boxes)))

    def take(pairs: list[tuple[Track, int]]) -> None:
        for t, d in pairs:
            _update(state, t, boxes[d], None if looks is None else looks[d], rules)
            open_.remove(d)

    if boxes:
        state.odd |= not max(abs(c) for b in boxes for c in b) < 1e100
        most = rules.max_distance + TIE
        for age, pairs in sorted(_candidates(state, len(boxes), looks, rules).items()):
            left = [(t, d) for t, d in pairs if d in open_]
            if not left:
                continue
            # Pairs that share no track and no detection all are in the cheapest assignment.
            if rules.motion_gate is None and not state.odd and all(looks is not None and t.rows for t, _ in left) and len({t.track_id for t, _ in left}) == len({d for _, d in left}) == len(left):
                take(left)
            else:
                some = [t for t in state.tracks if t.confirmed and t.since == age]
                cost = _distances(state, some, [boxes[d] for d in open_], None if looks is None else looks[open_], rules)
                take([(some[i], open_[j]) for i, j in _paired(cost, most)])
        rest = [t for t in state.tracks if t.since and (not t.confirmed or t.since == 1)]
        # Boxes that do not meet are never paired, unless that is no hindrance.
        if rest and open_ and (rules.max_overlap_distance >= 1 or state.odd or any(_meet(t, boxes[d]) for t in rest for d in open_)):
            take([(rest[i], open_[j]) for i, j in _paired(_overlaps(rest, [boxes[d] for d in open_]), rules.max_overlap_distance)])
    stays = [t for t in state.tracks if not t.since or t.confirmed and t.since <= rules.greatest_age]
    if len(stays) < len(state.tracks):
        state.keep(stays, [t for t in state.tracks if t.since and not (t.confirmed and t.since <= rules.greatest_age)])
    for d in open_:
        t = Track(state.next_id, types[d], *_begun(boxes[d]), confirmed=rules.hits <= 1)
        if looks is not None:
            state.remember(t, looks[d], rules.gallery)
        state.tracks.append(t)
        state.next_id += 1


def _candidates(state: State, n: int, looks: np.ndarray | None, rules: Rules) -> dict[int, list[tuple[Track, int]]]:
    """Pairs of confirmed tracks and detections that may be assigned, by the track's age: those of near looks, and all where there is nothing to look at."""
    out: dict[int, list[tuple[Track, int]]] = {}
    if looks is not None and state.owners:
        near, at = np.nonzero(1 - state.looks[: len(state.owners)] @ looks.T <= rules.max_distance)
        seen = set()
        for row, d in zip(near.tolist(), at.tolist(), strict=True):
            t = state.owners[row]
            if t is not None and t.confirmed and (t.track_id, d) not in seen:
                seen.add((t.track_id, d))
                out.setdefault(t.since, []).append((t, d))
    for t in state.tracks:
        if t.confirmed and (looks is None or not t.rows):
            out.setdefault(t.since, []).extend((t, d) for d in range(n))
    return out


def _rows(state: State, frame: int) -> list[tuple]:
    return [(frame, t.track_id, t.object_type, t.confirmed, t.since, *_moved(t).box()) for t in state.tracks if t.since <= 1]


def _columns(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray | None, list]:
    """Boxes, appearances of length one (None if the column is missing or has nulls in this frame) and types of one frame."""
    looks = None
    if "embedding" in rows and len(rows) and rows["embedding"].notna().all():
        looks = _unit(np.array(rows["embedding"].tolist(), float))
    return rows[["x1", "y1", "x2", "y2"]].to_numpy(float), looks, rows["object_type"].tolist()


_ORDER = ["camera_id", "frame", "x1", "y1", "x2", "y2", "object_type"]


def _usable(detections: DataFrame) -> DataFrame:
    kept = [*_ORDER, *(c for c in ("embedding",) if c in detections.columns)]
    return detections.select(*kept).dropna(subset=["camera_id", "frame", "x1", "y1", "x2", "y2"])


def track(detections: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Tracks of each camera, as OUTPUT: a row for each track and frame in which it was seen, or was in the frame before.

    detections: camera_id, frame, x1, y1, x2, y2, object_type, and embedding if there are appearances; further columns are not read. ``vision.confirmed_tracks`` makes items of the result. A camera
    is sequential by nature: its detections are sorted by Spark (which spills) and pass through one task frame by frame, of which no more than a frame and the live tracks are held.
    Rows without camera, frame or corners are left out. Equal detections are detections each. No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        camera, state, held = None, State(), []

        def ended() -> list[tuple]:
            boxes, looks, types = (sum(part, []) if k == 2 else None if any(p is None for p in part) else np.concatenate(part) for k, part in enumerate(zip(*(h[1:] for h in held), strict=True))) if len(held) > 1 else held[0][1:]
            frame = held[0][0]
            held.clear()
            return [(camera, *r) for r in step(state, frame, boxes, looks, types, rules)]

        for batch in batches:
            out: list[tuple] = []
            names, frames, types = (batch.column(c).to_pylist() for c in ("camera_id", "frame", "object_type"))
            boxes = np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")], 1)
            looks = _looks(batch.column("embedding")) if "embedding" in batch.schema.names else None
            cuts = [0, *(k for k in range(1, len(names)) if frames[k] != frames[k - 1] or names[k] != names[k - 1])] if names else []
            for at, to in zip(cuts, [*cuts[1:], len(names)], strict=True) if cuts else ():
                if held and (names[at] != camera or frames[at] != held[0][0]):
                    out += ended()
                if names[at] != camera:
                    camera, state = names[at], State()
                held.append((frames[at], boxes[at:to], None if looks is None else looks(at, to), types[at:to]))
            yield _output(out)
        if held:
            yield _output(ended())

    rows = _usable(detections)
    return rows.withColumns({"camera_id": F.col("camera_id").cast("string"), "frame": F.col("frame").cast("int")}).repartition(TASKS, "camera_id").sortWithinPartitions(*_ORDER).mapInArrow(run, OUTPUT)


def _looks(column: pa.Array) -> Callable[[int, int], np.ndarray | None]:
    """Appearances of length one of some rows, None if one of them is null."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    before = np.append(0, np.cumsum(known)).tolist()
    sizes = set(column.value_lengths().drop_null().to_pylist())
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if len(sizes) == 1:
        all_ = _unit(flat.reshape(-1, *sizes))
        return lambda at, to: all_[before[at] : before[to]] if before[to] - before[at] == to - at else None
    return lambda at, to: _unit(np.array(column[at:to].to_pylist(), float)) if before[to] - before[at] == to - at else None


def _unit(looks: np.ndarray) -> np.ndarray:
    return looks / np.maximum(np.linalg.norm(looks, axis=1, keepdims=True), 1e-12)


def _output(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), *[pa.float64()] * 4]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES)


_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
_STATE = "track_id long, object_type string, hits int, since int, confirmed boolean, mean array<double>, spread array<double>, gallery array<double>"


class TrackProcessor(StatefulProcessor):
    """Keeps each camera's live tracks between micro-batches: a clock (last frame, next id) and a row for each track, which goes when the track ends."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "last int, next_id long")
        self.live = handle.getListState("live", _STATE)

    def _load(self) -> State:
        if not self.clock.exists():
            return State()
        state = State(*self.clock.get())
        for i, kind, hits, since, confirmed, mean, spread, gallery in self.live.get() if self.live.exists() else ():
            track = Track(i, kind, list(mean), list(spread), hits, since, confirmed)
            for look in np.array(gallery[1:], float).reshape(-1, int(gallery[0])) if gallery else ():
                state.remember(track, look, self.rules.gallery)
            state.odd |= not max(map(abs, track.mean)) < 1e100
            state.tracks.append(track)
        return state

    def _save(self, state: State) -> None:
        self.clock.update((state.last, state.next_id))
        packed = lambda g: [float(g.shape[1]), *g.ravel().tolist()] if g.size else []
        rows = [(t.track_id, t.object_type, t.hits, t.since, bool(t.confirmed), t.mean, t.spread, packed(state.gallery(t))) for t in map(_moved, state.tracks)]
        if rows:
            self.live.put(rows)
        else:
            self.live.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self._load()
        arrived = pd.concat(list(rows), ignore_index=True).sort_values(_ORDER, kind="stable")
        out: list[tuple] = []
        for frame, some in arrived.groupby("frame", sort=True):
            if state.last is None or frame > state.last:
                out += [(key[0], *r) for r in step(state, int(frame), *_columns(some), self.rules)]
        self._save(state)
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


def track_stream(detections: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """What ``track`` gives, over a stream: each camera is a key whose tracks are state. Needs the RocksDB state store.

    A camera's frames come whole and in order: a micro-batch may hold many frames, and its rows in any order, but a frame is not split between two. Rows of a frame that is over,
    or was passed by a later one, are left out. State is the clock and the tracks alive, which end at greatest_age frames without a match; their galleries are bounded by ``Rules.gallery``.
    """
    return _usable(detections).groupBy("camera_id").transformWithStateInPandas(TrackProcessor(replace(rules)), OUTPUT, "Append", "None")
