"""Near-duplicate classes: DartMinHash signatures, banded joining, exact check, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, fresh, give_back_memory, mix, text_buffers, written
from ._words import runs, word_hashes
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
COORDINATES = 96
BAND_ROWS = 4
#: A bucket with more different texts is not compared all against all but by its rarest elements.
BUCKET = 16
#: Counters of how frequent elements are. Elements that share one are taken for equally frequent; any order that is
#: the same for all sets gives right results.
SLOTS = 1 << 18

_RANK, _COORDINATE, _LAYER = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


def weighted(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different elements of a text, in order, and how often it holds each."""
    return np.unique(shingles, return_counts=True)


def dart_minhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n_sets: int, k: int) -> np.ndarray:
    """Signatures (n_sets x k) of weighted sets; two agree at a coordinate with their weighted Jaccard similarity.

    Each element owns a region: its weight wide, and without end in rank. Hashed darts lie in it as a
    Poisson process of unit rate, the same for every set, drawn a unit of weight and one step of
    rank at a time. A dart also hashes to one of k coordinates, and each coordinate keeps the earliest
    dart that hits its set's region. About k ln k + 4k darts a set are thrown; the few sets with an
    empty coordinate throw as many again, until none is empty. So the work follows the size of a set
    plus k ln k, not their product.
    """
    out = np.full(n_sets * k, np.iinfo(np.uint64).max, np.uint64)
    total = np.bincount(owner, weights, n_sets)
    limit = k * (math.log(k) + 4) / np.maximum(total, 1e-300)
    layers = np.ceil(weights).astype(np.int64)
    each = np.repeat(np.arange(len(elements)), layers)
    layer = np.arange(len(each)) - np.repeat(np.cumsum(layers) - layers, layers)
    seed, owner = mix(elements[each] + layer.astype(np.uint64) * _LAYER), owner[each]
    width = np.minimum(weights[each] - layer, 1.0)
    rank = np.zeros(len(seed))
    live = np.arange(len(seed))
    step, ahead = np.zeros(len(seed), np.uint64), np.zeros(len(seed))

    while len(live):
        # The next dart of each live unit; a unit beyond its set's limit waits with that dart undecided.
        step[live] += np.uint64(1)
        dart = mix(seed[live] + step[live] * _RANK)
        ahead[live] = rank[live] - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        hit = ahead[live] <= limit[owner[live]]
        now, dart = live[hit], dart[hit]
        rank[now] = ahead[now]
        step[live[~hit]] -= np.uint64(1)
        second = mix(dart ^ _COORDINATE)
        inside = ((second >> np.uint64(40)).astype(np.float64) + 0.5) * 2.0**-24 < width[now]
        spot = (second & np.uint64(0xFFFFFFFF)) * np.uint64(k) >> np.uint64(32)
        packed = (ahead[now].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (dart & np.uint64(0xFFFFFFFF))
        np.minimum.at(out, (owner[now] * k + spot.astype(np.int64))[inside], packed[inside])
        live = now
        if not len(live):
            short = np.flatnonzero((out.reshape(n_sets, k) == np.iinfo(np.uint64).max).any(axis=1) & (total > 0))
            if len(short):
                limit[short] *= 2
                wide = np.zeros(n_sets, bool)
                wide[short] = True
                live = np.flatnonzero(wide[owner])
    return out.reshape(n_sets, k)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    bands = signatures.shape[1] // rows
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), parts.shape[:2]).copy()
    for i in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return keys.view(np.int64)


def _signed(docs: DataFrame, shingle: int, k: int, rows: int) -> DataFrame:
    """id, own, key and band keys of each text. The key is 128 bits of the words in order, or of a text without words.

    A text that the batch holds twice is signed once.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, bounds = word_hashes(*text_buffers(batch.column(2)))
            keys: list[bytes | None] = []
            first: dict[bytes, int] = {}
            slots, elements, weights = [], [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if a == b:
                    text = batch.column(2)[len(keys)].as_py()
                    keys.append(None if text is None else xxhash.xxh3_128_digest(b"\0" + text.encode()))
                    slots.append(None)
                    continue
                key = xxhash.xxh3_128_digest(words[a:b].tobytes())
                keys.append(key)
                if key not in first:
                    first[key] = len(first)
                    e, w = weighted(runs(words[a:b], shingle))
                    elements.append(e)
                    weights.append(w)
                slots.append(first[key])
            sizes = [len(x) for x in elements]
            parts, at = [], 0
            while at < len(sizes):  # so many elements at a time that the darts stay few
                to, n = at, 0
                while to < len(sizes) and (to == at or n + sizes[to] < 100_000) and to - at < 150:
                    n += sizes[to]
                    to += 1
                owner = np.repeat(np.arange(to - at), sizes[at:to])
                signatures = dart_minhash(np.concatenate(elements[at:to]), np.concatenate(weights[at:to]).astype(np.float64), owner, to - at, k)
                parts.append(band_keys(signatures, rows))
                at = to
            bands = np.concatenate(parts) if parts else np.zeros((0, k // rows), np.int64)
            lists = [None if s is None else bands[s] for s in slots]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], ["id", "own", "key", "bands"])
        give_back_memory()

    return docs.mapInArrow(sign, "id long, own int, key binary, bands array<long>")


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays with repeats: least counts over greatest counts."""
    total = len(a) + len(b)
    (x, n), (y, m) = weighted(a), weighted(b)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (total - both) if total else 1.0


def _shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """id and set (sorted element hashes, with repeats, as bytes) of the wanted ids' whole texts."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, bounds = word_hashes(*text_buffers(batch.column(1)))
            sets = [np.sort(runs(words[a:b], shingle)).tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "set"])
        give_back_memory()

    return docs.join(wanted, "id", "left_semi").mapInArrow(shingles, "id long, set binary").dropDuplicates(["id", "set"])


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have that weighted Jaccard similarity, computed exactly."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [weighted_jaccard(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) >= least for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])
        give_back_memory()

    sided = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return sided.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _unlike_stars(stars: DataFrame, labels: DataFrame) -> DataFrame:
    """The stars' pairs whose ends are not yet in one component."""
    a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    return stars.join(a, "a", "left").join(b, "b", "left").filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _live(rows: DataFrame, key: str) -> DataFrame:
    """The rows (key, node, label) whose key is held by more than one component, with the key's count n."""
    live = rows.groupBy(key).agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most")).filter(F.col("least") != F.col("most"))
    return written(rows.join(written(live.select(key, "n"), "live"), key), "live-rows")


def _unlike_pairs(rows: DataFrame, key: str, similarity: float | None = None) -> DataFrame:
    """Pairs of different components' nodes at a key; with a similarity, those whose places and sizes allow it.

    A common element at place i of a sorted set leaves size - i others that can be common, if it is
    the first; a pair that fails at its first common element fails at later ones.
    """
    more = ["at", "size"] if similarity else []
    x = rows.select(key, F.col("node").alias("a"), F.col("label").alias("la"), *(F.col(c).alias(f"{c}_a") for c in more))
    y = rows.select(key, F.col("node").alias("b"), F.col("label").alias("lb"), *(F.col(c).alias(f"{c}_b") for c in more))
    allowed = (F.col("la") != F.col("lb")) & (F.col("a") < F.col("b"))
    if similarity:
        least = similarity / (1 + similarity) * (F.col("size_a") + F.col("size_b")) - 1e-6
        allowed &= F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) + 1 >= least
    return x.join(y, key).filter(allowed).select("a", "b")


def _across(members: DataFrame, sets: DataFrame, labels: DataFrame, bucket: int, similarity: float) -> DataFrame:
    """Candidate pairs of different components' members in buckets that hold more than one component.

    Buckets of ``bucket`` members or fewer give all such pairs. The members of larger ones are compared by
    prefix and positional filtering, which are exact: of two sets at a similarity of s, each has one of the
    other's elements among its rarest (1 - s) part and one more, and enough elements after it. A member far
    from the rest of its bucket has only elements of its own there and meets none. No members, or buckets of one component only, give no pairs; a
    member that is listed twice gives its pairs twice.
    """
    live = _live(_labelled(members.select("bucket", "node"), labels), "bucket")
    small, large = live.filter(F.col("n") <= bucket), live.filter(F.col("n") > bucket)
    pairs = _unlike_pairs(small, "bucket")
    if large.isEmpty():
        return pairs

    wanted = large.select(F.col("node").alias("id"), "label").distinct()
    chosen = written(sets.join(wanted, "id").select("id", "label", "set"), "chosen")
    held = np.ones(SLOTS, np.int64)
    for row in chosen.select("set").mapInArrow(_slot_counts, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():  # SLOTS rows at most
        held[row.slot] = row.n
    order = chosen.sparkSession.sparkContext.broadcast(held)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            for node, label, data in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2), strict=True):
                own = _numbered(data)
                first = np.lexsort((own, order.value[_slots(own)]))[: len(own) - math.ceil(similarity * len(own) - 1e-6) + 1]
                parts.append((own[first].view(np.int64), np.full(len(first), node), np.full(len(first), label), np.arange(1, len(first) + 1), np.full(len(first), len(own))))
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["element", "node", "label", "at", "size"])
        give_back_memory()

    prefix = written(chosen.mapInArrow(rarest, "element long, node long, label long, at long, size long"), "prefixes")
    return pairs.union(_unlike_pairs(_live(prefix, "element"), "element", similarity))


def _numbered(data: pa.Scalar) -> np.ndarray:
    """The elements of a set, repeats told apart by their number, so that no element comes twice."""
    own = np.frombuffer(data.as_buffer(), np.uint64)
    at = np.arange(len(own))
    nth = at - np.maximum.accumulate(np.where(np.append(True, own[1:] != own[:-1])[: len(own)], at, 0)) if len(own) else at
    return np.where(nth > 0, mix(own + nth.astype(np.uint64) * _LAYER), own)


def _slots(elements: np.ndarray) -> np.ndarray:
    return (mix(elements ^ _COORDINATE) % np.uint64(SLOTS)).astype(np.int64)


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many elements of a task's sets fall into each slot."""
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for data in batch.column(0):
            np.add.at(counts, _slots(_numbered(data)), 1)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], ["slot", "n"])


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, k: int = COORDINATES, rows: int = BAND_ROWS, bucket: int = BUCKET) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, class_id, class_size (rows) and is_kept.

    Words as in ``contamination``. An element is ``shingle`` consecutive words (all words of a shorter
    text) and weighs how often the text holds it. Texts are linked at a weighted Jaccard similarity of
    ``similarity`` or more; classes are the components of the links, named by their least doc_id.
    is_kept marks the document of that id.

    1. Texts of equal words are one node, by a pre-aggregated key, so copies are never paired.
    2. Nodes that share a band (``rows`` of ``k`` DartMinHash coordinates) are candidates. Each is first
       paired with the bucket centre that it shares most bands with, then with the centres of its other
       buckets that are not yet in its component. Pairs are checked on the whole texts.
    3. Buckets that still hold more than one component are searched as ``_across`` says. Members of one
       component need no comparison: they are in one class already.
    With 24 bands of 4 rows a pair at 0.8 shares no band with probability 3e-6.

    A text without words is linked to equal texts only; null texts stand alone. Rows without doc_id have
    the class of their copies, else a null one, and are kept. Rows of one doc_id are one document. An empty
    table stays empty; other columns are not read.
    """
    return _classes(docs, shingle, similarity, k, rows, bucket).drop("own")


def _classes(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, k: int = COORDINATES, rows: int = BAND_ROWS, bucket: int = BUCKET) -> DataFrame:
    """What ``near_duplicates`` gives, and own, a hash of the text."""
    bound_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    signed_docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.hash(text).alias("own"), text.alias("text"))
    docs = signed_docs.drop("own")
    signed = written(_signed(signed_docs, shingle, k, rows), "signed")
    named = signed.filter(F.col("key").isNotNull())
    nodes = written(named.groupBy("key").agg(F.min("id").alias("node"), F.first("bands").alias("bands")), "nodes")
    buckets = written(nodes.filter(F.col("node").isNotNull()).select("node", F.explode("bands").alias("bucket")), "buckets")
    shared = written(buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > 1), "shared")
    members = buckets.join(shared, "bucket")
    # The centre of a bucket is the node with the most company in all its buckets, as an original has among its copies.
    company = written(members.groupBy("node").agg(F.sum("n").alias("company")), "company")
    members = written(members.select("bucket", "node").join(company, "node"), "members")
    centres = written(members.groupBy("bucket").agg(F.max_by("node", F.struct("company", -F.col("node"))).alias("centre")), "centres")
    sets = written(_shingle_sets(docs, company.select(F.col("node").alias("id")), shingle), "sets")
    stars = members.join(centres, "bucket").filter(F.col("node") != F.col("centre")).groupBy("node", "centre").agg(F.count("*").alias("bands"))
    stars = written(stars.select("node", "bands", F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")), "stars")
    done = written(stars.groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct("bands", -F.col("a"), -F.col("b"))).alias("p")).select("p.a", "p.b").distinct(), "pairs")
    edges = written(_similar(done, sets, similarity), "similar")
    labels = components(edges)
    for search in (lambda now: _unlike_stars(stars.select("a", "b"), now), lambda now: _across(members, sets, now, bucket, similarity)):
        pairs = written(search(labels).distinct().join(done, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        done = done.union(pairs)
        new = written(_similar(pairs, sets, similarity), "similar")
        if not new.isEmpty():
            edges = edges.union(new)
            labels = components(edges)
    classes = written(_labelled(nodes.select("key", "node"), labels).select("key", F.col("label").alias("class_id")), "classes")
    out = written(named.select("id", "own", "key").join(classes, "key").select("id", "own", "class_id").union(signed.filter(F.col("key").isNull()).select("id", "own", F.col("id").alias("class_id"))), "rows")
    sizes = written(out.filter(F.col("class_id").isNotNull()).groupBy("class_id").agg(F.count("*").alias("class_size")), "sizes")
    return out.join(sizes, "class_id", "left").select(
        F.col("id").alias("doc_id"), "own", "class_id", F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("is_kept")
    )


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class, the one of the least doc_id; rows without doc_id all stay. See ``near_duplicates``.

    Of rows that share an id each is judged by its own text, and one of those that are equal in both stays. Null texts stay. An empty table stays empty.
    """
    keys = [fresh(c, docs.columns) for c in ("_id", "_own")]
    kept = _classes(docs, similarity=similarity).filter(F.col("is_kept") & F.col("doc_id").isNotNull()).select("doc_id", "own").distinct().toDF(*keys)
    named = docs.withColumns({keys[0]: F.col("doc_id").cast("long"), keys[1]: F.hash(F.col("text").cast("string"))})
    one = named.join(kept, keys, "left_semi").dropDuplicates(keys).drop(*keys)
    return one.unionByName(docs.filter(F.col("doc_id").isNull()))
