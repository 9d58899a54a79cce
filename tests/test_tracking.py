"""Association: assignment against brute force, identities of moving boxes, batch against stream, the end of state."""

import itertools
import random

import numpy as np
import pytest

from tests.conftest import SF
from vidspark import queries
from vidspark.functions import vision
from vidspark.operators import tracking
from vidspark.operators.tracking import Rules, State, step

DETECTIONS = "camera_id string, frame int, object_type string, x1 double, y1 double, x2 double, y2 double, embedding array<double>"


@pytest.mark.parametrize("shape", [(1, 1), (3, 3), (2, 5), (5, 3), (4, 4)])
def test_assignment_equals_brute_force(shape):
    rng = np.random.default_rng(sum(shape))
    for k in range(60):
        cost = rng.random(shape) if k % 2 else rng.integers(0, 3, shape).astype(float)
        small, large = sorted(shape)
        flat = cost if shape[0] <= shape[1] else cost.T
        best = min(sum(flat[i, j] for i, j in enumerate(some)) for some in itertools.permutations(range(large), small))
        pairs = tracking.assign(cost)
        assert len(pairs) == small == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        assert abs(sum(cost[i, j] for i, j in pairs) - best) < 1e-9


def walkers(seed=1, n=4, frames=40, cameras=("a", "b"), dim=8):
    """Boxes that walk on lines that cross, each with a look of its own, lost now and then; rows and the walker of each."""
    rng = random.Random(seed)
    rows = []
    for camera in cameras:
        look = [[float(i == j) for j in range(dim)] for i in range(n)]
        start = [(rng.uniform(0, 300), rng.uniform(0, 300), rng.uniform(-4, 4), rng.uniform(-4, 4)) for _ in range(n)]
        for frame in range(1, frames + 1):
            for k, (x, y, dx, dy) in enumerate(start):
                if not (10 < frame < 10 + 3 * k or frame == 30):  # walker k is away for 3 k - 1 frames, frame 30 has none
                    x1, y1 = x + dx * frame + rng.uniform(-0.5, 0.5), y + dy * frame + rng.uniform(-0.5, 0.5)
                    rows.append((camera, frame, f"w{k}", x1, y1, x1 + 20, y1 + 40, [v + rng.uniform(-0.05, 0.05) for v in look[k]]))
    rng.shuffle(rows)
    return rows


def rounded(frame):
    return sorted((r.camera_id, r.frame, r.track_id, r.object_type, r.confirmed, r.frames_since_update, round(r.x1, 6), round(r.y2, 6)) for r in frame.collect())


def test_walkers_keep_their_tracks(spark):
    out = tracking.track(spark.createDataFrame(walkers(), DETECTIONS))
    items = vision.confirmed_tracks(out).select("camera_id", "object_type", "item_id").distinct().collect()
    assert sorted((r.camera_id, r.object_type) for r in items) == [(c, f"w{k}") for c in "ab" for k in range(4)]


def test_no_track_is_given_two_detections_and_tracks_end():
    state, rules = State(), Rules(greatest_age=3, hits=2)
    box = np.array([[0.0, 0, 10, 20], [100, 100, 110, 120]])
    step(state, 1, box, None, ["a", "b"], rules)
    rows = step(state, 2, box, None, ["a", "b"], rules)
    assert [r[1] for r in rows] == [1, 2] and all(r[3] for r in rows)
    rows = step(state, 4, box[:1], None, ["a"], rules)  # frame 3 was empty, both are expected in it
    assert [(r[0], r[1], r[4]) for r in rows] == [(3, 1, 1), (3, 2, 1), (4, 1, 0)]
    step(state, 5, box[:1], None, ["a"], rules)
    assert [t.track_id for t in state.tracks] == [1, 2] and state.tracks[1].since == 3
    step(state, 6, box[:1], None, ["a"], rules)
    assert [t.track_id for t in state.tracks] == [1]  # the other is older than 3 frames
    step(state, 1000, np.zeros((0, 4)), None, [], rules)
    assert state.tracks == [] and state.next_id == 3


def test_a_new_track_ends_with_the_first_frame_that_lacks_it():
    state = State()
    step(state, 1, np.array([[0.0, 0, 10, 20]]), None, ["a"])
    assert step(state, 2, np.array([[500.0, 0, 510, 20]]), None, ["a"])[0][1] == 2 and [t.track_id for t in state.tracks] == [2]


def test_looks_decide_where_boxes_cross():
    """Two boxes that change places between two frames: with looks they keep their tracks, without they do not."""
    left, right, looks = [0.0, 0, 10, 20], [6.0, 0, 16, 20], np.eye(2)
    for known in (True, False):
        state, rules = State(), Rules(motion_gate=None)
        for frame in range(1, 5):
            step(state, frame, np.array([left, right]), looks if known else None, ["a", "b"], rules)
        step(state, 5, np.array([right, left]), looks if known else None, ["a", "b"], rules)
        assert (state.tracks[0].mean[0] > 6) == known


def test_stream_agrees_with_batch(spark, tmp_path):
    frame = spark.createDataFrame(walkers(2), DETECTIONS)
    want = rounded(tracking.track(frame))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for low, high in ((1, 7), (8, 15), (16, 33), (34, 40)):  # frames 30 and some of walkers' are missing, and so is a batch's order
            frame.filter(f"frame between {low} and {high}").repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = tracking.track_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")))
            query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert query.exception() is None
        assert rounded(spark.read.parquet(str(tmp_path / "out"))) == want
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def brute_items(rows, rules):
    """The rules written out for one camera, with every assignment tried; tracks are lists [id, type, mean, covariance, looks, hits, since, confirmed]."""
    frames = {}
    for r in sorted(rows, key=lambda r: (r["frame"], r["x1"], r["y1"], r["x2"], r["y2"], r["object_type"])):
        frames.setdefault(r["frame"], []).append(r)
    move = np.eye(8) + np.eye(8, k=4)
    tracks, count, out = [], 0, []

    def cheapest(cost, most):
        n, m = cost.shape
        if not n or not m:
            return []
        capped = np.where(cost > most, most + 1e-5, cost)
        if n > m:
            some = min(itertools.permutations(range(n), m), key=lambda p: sum(capped[i, j] for j, i in enumerate(p)))
            pairs = [(i, j) for j, i in enumerate(some)]
        else:
            some = min(itertools.permutations(range(m), n), key=lambda p: sum(capped[i, j] for i, j in enumerate(p)))
            pairs = list(enumerate(some))
        return [(i, j) for i, j in pairs if cost[i, j] <= most]

    for frame in range(min(frames), max(frames) + 1):
        seen = frames.get(frame, [])
        z = [np.array([(r["x1"] + r["x2"]) / 2, (r["y1"] + r["y2"]) / 2, (r["x2"] - r["x1"]) / (r["y2"] - r["y1"]), r["y2"] - r["y1"]]) for r in seen]
        looks = [np.array(r["embedding"]) / np.linalg.norm(r["embedding"]) for r in seen]
        for t in tracks:
            h = t[2][3]
            t[2], t[3] = move @ t[2], move @ t[3] @ move.T + np.diag(np.square([h / 20, h / 20, 1e-2, h / 20, h / 160, h / 160, 1e-5, h / 160]))
            t[6] += 1
        free, done = list(range(len(seen))), []
        corners = lambda v: (v[0] - v[2] * v[3] / 2, v[1] - v[3] / 2, v[0] + v[2] * v[3] / 2, v[1] + v[3] / 2)

        def overlap(t, d):
            a, b = corners(t[2]), corners(z[d])
            w, h = (max(0, min(a[k + 2], b[k + 2]) - max(a[k], b[k])) for k in (0, 1))
            return 1 - w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)

        def look(t, d):
            h, gap = t[2][3], z[d] - t[2][:4]
            motion = gap @ np.linalg.inv(t[3][:4, :4] + np.diag(np.square([h / 20, h / 20, 1e-1, h / 20]))) @ gap
            apart = min(1 - one @ looks[d] for one in t[4])
            return apart + 1e-6 * motion / (motion + 1) if apart <= rules.max_distance else 1e5

        for age in [*range(1, rules.greatest_age + 2), None]:
            some = [t for t in tracks if not any(t is x for x in done) and (t[7] and t[6] == age if age else not t[7] or t[6] == 1)]
            cost = [[overlap(t, d) if age is None else look(t, d) for d in free] for t in some]
            pairs = cheapest(np.array(cost).reshape(len(some), len(free)), rules.max_overlap_distance if age is None else rules.max_distance + 1e-6)
            for i, j in pairs:
                t, d = some[i], free[j]
                h = t[2][3]
                s = t[3][:4, :4] + np.diag(np.square([h / 20, h / 20, 1e-1, h / 20]))
                k = t[3][:, :4] @ np.linalg.inv(s)
                t[2], t[3] = t[2] + k @ (z[d] - t[2][:4]), t[3] - k @ s @ k.T
                t[4].append(looks[d])
                t[5], t[6], t[7] = t[5] + 1, 0, t[7] or t[5] + 1 >= rules.hits
                done.append(t)
            free = [d for k, d in enumerate(free) if k not in {j for _, j in pairs}]
        tracks = [t for t in tracks if any(t is x for x in done) or t[7] and t[6] <= rules.greatest_age]
        for d in free:
            count += 1
            h = z[d][3]
            tracks.append([count, seen[d]["object_type"], np.append(z[d], [0, 0, 0, 0]), np.diag(np.square([h / 10, h / 10, 1e-2, h / 10, h / 16, h / 16, 1e-5, h / 16])), [looks[d]], 1, 0, rules.hits <= 1])
        out += [(frame, t[0], t[1], bool(t[7]), t[6], *(round(float(x), 6) for x in corners(t[2]))) for t in tracks if t[6] <= 1]
    return out


def test_query_equals_brute_force(spark):
    """A few cameras of the query, where frames are small enough to try all assignments."""
    rules = queries.TRACKING
    seen = queries._seen(spark, SF).filter("camera_id in ('1', '7', '12')")
    got = {}
    for r in tracking.track(seen, rules).collect():
        got.setdefault(r.camera_id, []).append((*r[1:6], *(round(x, 6) for x in r[6:])))
    rows = seen.collect()
    for camera in ("1", "7", "12"):
        own = [r.asDict() for r in rows if r.camera_id == camera]
        assert max(sum(r["frame"] == f for r in own) for f in {r["frame"] for r in own}) <= 9
        assert sorted(got[camera]) == sorted(brute_items(own, rules))


def test_tracking_of_odd_rows(spark):
    rows = [("a", 1, None, 0.0, 0.0, 5.0, 5.0, None), ("a", 1, "x", 0.0, 0.0, 5.0, 5.0, [1.0, 0.0]), ("a", None, "x", 0.0, 0.0, 5.0, 5.0, None), (None, 1, "x", 0.0, 0.0, 5.0, 5.0, None), ("a", 2, "x", None, 0.0, 5.0, 5.0, None), ("b", 5, "x", 3.0, 3.0, 3.0, 3.0, [0.0, 0.0])]
    out = tracking.track(spark.createDataFrame(rows, DETECTIONS))
    assert sorted((r.camera_id, r.frame, r.track_id) for r in out.collect()) == [("a", 1, 1), ("a", 1, 2), ("b", 5, 1)]
    assert tracking.track(spark.createDataFrame([], DETECTIONS)).count() == 0
