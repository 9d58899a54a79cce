"""Centroid clustering: exact k-means on integer vectors, whose nearest centroids a vantage-point tree finds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, fresh, written

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SEED = 2
#: Larger components are taken as this, so that a squared distance of 64 of them is a long.
MOST = 2**27
#: Vectors that are searched for at a time.
BLOCK = 2048
#: How much a distance in doubles may be off, as a part of it; bounds give way by that.
SLACK = 1e-9


@dataclass(frozen=True)
class VantageTree:
    """A vantage-point tree over centroids, as arrays: node i holds centroid point[i]; those within radius[i] of it, inclusive, are below inner[i], the others below outer[i] (-1: none).

    reach: of either side of a node the least and greatest distance from its centroid.
    """

    centroids: np.ndarray
    point: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    reach: np.ndarray


def build(centroids: np.ndarray) -> VantageTree:
    """The tree. The vantage point of a set is the one whose distances to the others spread most, of equals the first; the radius is their median."""
    x = centroids.astype(float)
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    point, inner, outer, reach = [], [], [], []

    def grow(some: np.ndarray) -> int:
        if not len(some):
            return -1
        at = int(some[np.argmax(apart[np.ix_(some, some)].var(1))])
        rest = some[some != at]
        far = apart[at, rest]
        near = far <= np.median(far) if len(rest) else np.zeros(0, bool)
        i = len(point)
        point.append(at)
        inner.append(-1)
        outer.append(-1)
        reach.append([[d.min(initial=np.inf), d.max(initial=0.0)] for d in (far[near], far[~near])])
        inner[i], outer[i] = grow(rest[near]), grow(rest[~near])
        return i

    grow(np.arange(len(centroids)))
    return VantageTree(centroids, np.array(point), np.array(inner), np.array(outer), np.array(reach).reshape(-1, 2, 2))


def nearest(tree: VantageTree, vectors: np.ndarray, visits: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (of equals the smaller number) and exact squared distance of each vector.

    Each vector goes through the tree best first: of the subtrees open to it, it takes the one with the least lower bound, and ends
    when that is beyond its best distance; a bound equal to it is still followed, as it may hide a tie. All vectors of a block take a step together. Bounds are doubles and
    give way by SLACK; distances that decide are integers. visits, if given, gets the number of distances computed.
    """
    n, nodes = len(vectors), len(tree.point)
    best, which = np.full(n, np.iinfo(np.int64).max), np.full(n, len(tree.centroids))
    bound = np.full((n, nodes), np.inf)
    bound[:, 0] = 0.0
    live = np.arange(n)
    while len(live):
        node = bound[live].argmin(1)
        open_ = bound[live, node] <= np.sqrt(best[live].astype(float)) * (1 + SLACK)
        live, node = live[open_], node[open_]
        if not len(live):
            break
        low = bound[live, node]
        bound[live, node] = np.inf
        at = tree.point[node]
        step = vectors[live] - tree.centroids[at]
        square = np.einsum("ij,ij->i", step, step)
        if visits is not None:
            visits.append(len(live))
        better = (square < best[live]) | (square == best[live]) & (at < which[live])
        best[live[better]], which[live[better]] = square[better], at[better]
        d = np.sqrt(square.astype(float))
        for side, child in enumerate((tree.inner[node], tree.outer[node])):
            has = child >= 0
            gap = np.maximum(d - tree.reach[node, side, 1], tree.reach[node, side, 0] - d) - SLACK * (d + tree.reach[node, side, 1])
            bound[live[has], child[has]] = np.maximum(low, gap)[has]
    return which, best


def _integers(batch: pa.RecordBatch, at: int) -> np.ndarray:
    x = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, DIMENSIONS)
    return np.clip(np.floor(x * SCALE), -MOST, MOST).astype(np.int64)


def _usable(vector: Column) -> Column:
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) == DIMENSIONS) & F.forall(vector, sound), F.lit(False))


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """``vectors`` (vec_id, embedding) that have 64 sound components, with cluster, distance, cluster_inertia, inertia and centroid_sha256.

    A component x counts as floor(256 x) in doubles. Centroids begin as the vectors with the least sha256 of ``seed:vec_id``; in each round all vectors go to their
    nearest centroid, of equals the smaller number, and each centroid that has any becomes the floor of their mean. Then all are assigned once more.
    A round is one pass over the table: the tree of the centroids is built anew and goes to the tasks with it, a task adds up each cluster's vectors as integers, and
    ``clusters`` sums come back, however many vectors there are. So nothing is shuffled but one row a task and cluster.

    Vectors that are null, of another length, or with null, NaN or infinite components are left out. Components beyond 2^27 after scaling count as 2^27. Rows without vec_id
    are assigned like others and begin a cluster only when too few have an id; rows of one id have equal hashes, of those the lesser vector begins first.
    Equal vectors that begin two clusters leave the second one empty, and it stays as it was. Fewer vectors than clusters make as many clusters as vectors. An empty table gives
    no rows. Columns named as the new ones are replaced, all others are kept.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    new = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    vectors = vectors.drop(*new)
    names = vectors.columns
    x = fresh("_x", names)
    rows = vectors.withColumn(x, F.col("embedding").cast("array<double>"))
    rows = rows.filter(_usable(F.col(x)))
    at = len(names)
    hashed = F.when(F.col("vec_id").isNotNull(), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    first = rows.select(hashed.alias("h"), F.col(x).alias("x")).orderBy(F.asc_nulls_last("h"), "x").limit(clusters).collect()  # `clusters` rows
    start = np.array([r.x for r in first], float).reshape(-1, DIMENSIONS)
    centroids = np.clip(np.floor(start * SCALE), -MOST, MOST).astype(np.int64)

    def assigned(tree: VantageTree, batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = _integers(batch, column)
        parts = [nearest(tree, v[k : k + BLOCK]) for k in range(0, len(v), BLOCK)]
        return v, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    for _ in range(rounds if len(centroids) else 0):
        tree = build(centroids)

        def sums(batches: Iterator[pa.RecordBatch], tree: VantageTree = tree) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((len(tree.point), DIMENSIONS), np.int64), np.zeros(len(tree.point), np.int64)
            for batch in batches:
                if batch.num_rows:
                    v, which, _ = assigned(tree, batch, 0)
                    count += np.bincount(which, minlength=len(count))
                    order = np.argsort(which, kind="stable")
                    cuts = np.flatnonzero(np.append(True, np.diff(which[order]) > 0))
                    total[which[order][cuts]] += np.add.reduceat(v[order], cuts)
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some], pa.int64()), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

        parts = rows.select(x).mapInArrow(sums, "cluster int, n long, sums array<long>")
        wide = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(DIMENSIONS)]
        for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect():  # a row a cluster
            centroids[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(DIMENSIONS)]
    tree = build(centroids)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, which, square = assigned(tree, batch, at)
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(which, pa.int32()), pa.array(square, pa.int64())], [*names, "cluster", "distance"])

    out = rows.mapInArrow(last, vectors.withColumns({"cluster": F.lit(0).cast("int"), "distance": F.lit(0).cast("long")}).schema)
    out = written(out, "assigned")
    far = {r.cluster: int(r.d) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row a cluster
    whole = lambda d: min(d, 2**63 - 1)
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    facts = [(k, whole(far.get(k, 0)), whole(sum(far.values())), digest(c)) for k, c in enumerate(centroids)]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select(*names, *new)  # a row a cluster is sent
