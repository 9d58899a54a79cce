"""Benchmark decontamination with suffix arrays over the training text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bound_batches, give_back_memory, text_buffers, with_fields
from ._words import stretch_hashes, word_hashes

WINDOW = 10
#: Words of training text in one suffix array; a longer document has one of its own.
SHARD_WORDS = 1 << 20
#: Bytes of benchmark text in one block.
BLOCK_BYTES = 16 << 20
#: Places in documents and items that are compared at a time.
PAIRS = 1 << 19


class SuffixArray:
    """The suffixes of a shard's documents in order of their first ``depth`` words or more.

    Words have dense ranks, in the order of their hashes; a suffix ends with its document. Three ranks, or
    two where they need more than 21 bits, make one sort key; only suffixes that still tie are sorted again, by the places of what follows
    them, which doubles the words that count.
    """

    def __init__(self, words: np.ndarray, bounds: np.ndarray, depth: int):
        self.vocabulary, ranks = np.unique(words, return_inverse=True)
        n = len(words)
        self.ranks = np.zeros(n + 3, np.int64)
        self.ranks[:n] = ranks + 1
        self.bits = max(1, int(len(self.vocabulary) + 1).bit_length())
        self.lead = 3 if 3 * self.bits <= 63 else 2
        self.ends = np.repeat(bounds[1:], np.diff(bounds))
        left = self.ends - np.arange(n)
        second = np.where(left > 1, self.ranks[1 : n + 1], 0)
        keys = (self.ranks[:n] << self.bits) | second
        if self.lead == 3:
            keys = (keys << self.bits) | np.where(left > 2, self.ranks[2 : n + 2], 0)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        del keys, second
        known = self.lead
        if n and known < depth:
            place = np.empty(n, np.int64)
            first = np.ones(n, bool)
            first[1:] = self.keys[1:] != self.keys[:-1]
            group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
            place[self.order] = group
            while known < depth:
                tied = np.flatnonzero(~first | np.append(~first[1:], False))
                if not len(tied):
                    break
                at = self.order[tied]
                follow = np.where(left[at] > known, place[np.minimum(at + known, n - 1)] + 1, 0)
                resort = np.lexsort((follow, group[tied]))
                at, follow = at[resort], follow[resort]
                self.order[tied] = at
                new = np.ones(len(tied), bool)
                new[1:] = (group[tied][1:] != group[tied][:-1]) | (follow[1:] != follow[:-1])
                first[tied] = new
                group[tied] = np.maximum.accumulate(np.where(new, tied, 0))
                place[at] = group[tied]
                known *= 2

    def _word_after(self, at: np.ndarray, offset: np.ndarray) -> np.ndarray:
        suffix = self.order[at] + offset
        inside = suffix < self.ends[self.order[at]]
        return np.where(inside, self.ranks[np.where(inside, suffix, 0)], 0)

    def _narrow(self, low: np.ndarray, high: np.ndarray, offset: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the suffixes from low to high, which agree before offset, those with this word there."""
        out = []
        for above in (0, 1):
            a, b = low.copy(), high.copy()
            while True:
                active = np.flatnonzero(a < b)
                if not len(active):
                    break
                middle = (a[active] + b[active]) >> 1
                less = self._word_after(middle, offset[active]) < rank[active] + above
                a[active] = np.where(less, middle + 1, a[active])
                b[active] = np.where(less, b[active], middle)
            out.append(a)
        return out[0], out[1]

    def find(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that begin with words[start : start + length], for each start."""
        slot = np.searchsorted(self.vocabulary, words)
        found = self.vocabulary[np.minimum(slot, len(self.vocabulary) - 1)] == words if len(self.vocabulary) else np.zeros(len(words), bool)
        ranks = np.zeros(len(words) + 3, np.int64)
        ranks[: len(words)] = np.where(found, slot + 1, 0)
        key = (ranks[starts] << self.bits) | np.where(lengths > 1, ranks[starts + 1], 0)
        if self.lead == 3:
            key = (key << self.bits) | np.where(lengths > 2, ranks[starts + 2], 0)
        free = np.maximum(0, self.lead - lengths) * self.bits
        low = np.searchsorted(self.keys, key)
        high = np.searchsorted(self.keys, key + (np.int64(1) << free))
        known = (ranks[starts] > 0) & ((lengths < 2) | (ranks[starts + 1] > 0)) & ((lengths < 3) | (ranks[starts + 2] > 0))
        high = np.where(known, high, low)
        for offset in range(self.lead, int(lengths.max(initial=0))):
            live = np.flatnonzero((high > low) & (lengths > offset))
            if not len(live):
                break
            rank = ranks[starts[live] + offset]
            a, b = self._narrow(low[live], high[live], np.full(len(live), offset), rank)
            low[live], high[live] = a, np.where(rank > 0, b, a)
        return low, high


@dataclass
class Block:
    """Some benchmark items: the words of all of them (item i has those from bounds[i] to bounds[i + 1]), the different windows (starts, lengths), and every place of a window.

    Places of window k are those from places[k] to places[k + 1]: its first word (at) and its item. All are arrays, about 40 bytes a word.
    """

    words: np.ndarray
    bounds: np.ndarray
    names: list[str | None]
    starts: np.ndarray
    lengths: np.ndarray
    places: np.ndarray
    at: np.ndarray
    item: np.ndarray

    def items_of(self, kinds: np.ndarray) -> set[str]:
        """Ids of the items that hold any of these windows."""
        some = np.unique(np.concatenate([self.item[self.places[k] : self.places[k + 1]] for k in kinds.tolist()]))
        return {self.names[i] for i in some.tolist()} - {None}


def block_of(item_ids: list, texts: list[str | None], window: int) -> Block:
    words, bounds = word_hashes(*text_buffers(pa.array(texts, pa.string())))
    sizes = np.diff(bounds)
    length = np.minimum(window, sizes)
    counts = np.where(sizes > 0, sizes - length + 1, 0)
    item = np.repeat(np.arange(len(sizes), dtype=np.int32), counts)
    start = np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(bounds[:-1], counts)
    one, two = stretch_hashes(words, start, start + length[item])
    order = np.lexsort((start, two, one))
    one, two = one[order], two[order]
    first = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[: len(order)])
    at, item = start[order], item[order]
    return Block(words, bounds, [None if x is None else str(x) for x in item_ids], at[first], length[item[first]], np.append(first, len(order)), at, item)


@dataclass
class Found:
    """Of one document: hit ranges of words, the items found, and the longest verbatim match with its place."""

    ranges: list[tuple[int, int]]
    items: set[str]
    longest: int = 0
    longest_at: int | None = None


def _longest(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, kind: np.ndarray, block: Block) -> np.ndarray:
    """How far each occurrence (at, kind) goes on as some item does, over every place of its window, PAIRS at a time.

    An occurrence and place whose words before agree too are part of a longer match that begins earlier, and not followed.
    """
    out = block.lengths[kind].copy()
    counts = block.places[kind + 1] - block.places[kind]
    upto = np.cumsum(counts)
    i = 0
    while i < len(at):
        to = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIRS, "right")))
        own = np.repeat(np.arange(i, to), counts[i:to])
        place = np.arange(len(own)) - np.repeat(np.cumsum(counts[i:to]) - counts[i:to], counts[i:to]) + block.places[kind[own]]
        p, q = at[own], block.at[place]
        before = (p > starts[own]) & (q > block.bounds[block.item[place]])
        before[before] = words[p[before] - 1] == block.words[q[before] - 1]
        own, place = own[~before], place[~before]
        upper = block.bounds[block.item[place] + 1]
        match = block.lengths[kind[own]].copy()
        live = np.arange(len(own))
        while len(live):
            p, q = at[own[live]] + match[live], block.at[place[live]] + match[live]
            inside = (p < ends[own[live]]) & (q < upper[live])
            live, p, q = live[inside], p[inside], q[inside]
            live = live[words[p] == block.words[q]]
            match[live] += 1
        np.maximum.at(out, own, match)
        i = to
    return out


def search(words: np.ndarray, bounds: np.ndarray, block: Block, array: SuffixArray | None = None) -> dict[int, Found]:
    """What each document of a shard has of the block's windows; every test suffix is looked up. array: the shard's, if it is there already."""
    if not len(words) or not len(block.starts):
        return {}
    if array is None:
        array = SuffixArray(words, bounds, int(block.lengths.max()))
    low, high = array.find(block.words, block.starts, block.lengths)
    found: dict[int, Found] = {}
    got = np.flatnonzero(high > low)
    if not len(got):
        return found
    sizes = (high - low)[got]
    kind = np.repeat(got, sizes)
    at = array.order[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low[got], sizes)]
    doc = np.searchsorted(bounds, at, "right") - 1
    order = np.lexsort((at, doc))
    kind, at, doc = kind[order], at[order], doc[order]
    match = _longest(words, bounds[doc], bounds[doc + 1], at, kind, block)
    cuts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(doc)], strict=True):
        base, ranges = int(bounds[doc[a]]), []
        for start, length in zip((at[a:b] - base).tolist(), block.lengths[kind[a:b]].tolist(), strict=True):
            ranges.append((start, start + length))
        names = block.items_of(np.unique(kind[a:b]))
        best = a + int(np.argmax(match[a:b]))
        found[int(doc[a])] = Found(_joined(ranges), names, int(match[best]), int(at[best]) - base)
    return found


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges, with those that meet made one."""
    out: list[tuple[int, int]] = []
    for a, b in ranges:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _both(one: Found | None, other: Found) -> Found:
    """What two blocks found in a document."""
    if one is None:
        return other
    longest = min((-x.longest, x.longest_at) for x in (one, other))
    return Found(_joined(sorted([*one.ranges, *other.ranges])), one.items | other.items, -longest[0], longest[1])


def shards(bounds: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield at, to
        at = to


_FIELDS = (("n_words", T.LongType()), ("hit_ranges", T.ArrayType(T.LongType())), ("items", T.ArrayType(T.StringType())), ("longest_match", T.LongType()), ("longest_at", T.LongType()))
_TYPES = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64(), pa.int64())


def gathered(batches: Iterator[pa.RecordBatch], at: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until their texts have about ``most`` bytes, so that a shard is worth its search."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(at).nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def blocks(benchmark: DataFrame, most: int, window: int) -> Iterator[Block]:
    """The stated query set, read block by block."""
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", F.col("text").cast("string")).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1] or "")
        if size >= most:
            yield block_of(ids, texts, window)
            ids, texts, size = [], [], 0
    if ids or not size:
        yield block_of(ids, texts, window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with what they hold of the benchmark.

    Words are longest runs of ``[0-9a-z]`` and code points from U+0080 on, A-Z lower-cased. A window is
    ``window`` consecutive words of an item; an item of fewer, but not none, is one window. Adds n_words, n_hit
    (words inside an occurrence of a window), items (sorted item_ids, as strings, with an occurring
    window), n_items, items_sha256 of their comma-joined list, contaminated, hit_ranges (start and end
    word of each hit stretch, flat), longest_match (words of the longest verbatim match that holds a
    window) and longest_at (its first word).

    Each task builds suffix arrays over shards of its own documents, so no document moves. The
    benchmark is a stated query set: it is read and sent out in blocks of ``block_bytes``, each a broadcast of its own, which a task
    looks for one after the other in its shards of about ``shard_words`` words. Driver and workers hold one block at a time, as arrays: a worker drops a block before it loads the next. What is
    sent lies in Spark's block store, which goes to disk.

    Null and empty texts have no words. Repeated rows are judged each for itself; items of one id are
    one item; an item without id contaminates but is not listed. An empty benchmark hits nothing. An
    empty table stays empty. Columns named as the new ones are replaced, all others are kept.
    """
    bound_batches(docs.sparkSession)
    new = ("n_words", "n_hit", "items", "n_items", "items_sha256", "contaminated", "hit_ranges", "longest_match", "longest_at")
    docs = docs.drop(*new)
    keep = docs.columns
    docs = docs.withColumn("text", F.col("text").cast("string"))
    sent = [docs.sparkSession.sparkContext.broadcast(block) for block in blocks(benchmark, block_bytes, window)]
    at = keep.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, at, 8 * shard_words):
            words, bounds = word_hashes(*text_buffers(batch.column(at)))
            found: dict[int, Found] = {}
            parts = [(a, words[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]) for a, b in shards(bounds, shard_words)]
            arrays = [SuffixArray(own, ends, window) if len(own) else None for _, own, ends in parts]
            for block in sent:
                for (a, own, ends), array in zip(parts, arrays, strict=True):
                    for k, new in search(own, ends, block.value, array).items():
                        found[a + k] = _both(found.get(a + k), new)
                if len(sent) > 1:
                    vars(block).pop("_value", None)  # what a worker has loaded of it
            nothing = Found([], set())
            each = [found.get(i, nothing) for i in range(batch.num_rows)]
            new = [np.diff(bounds), [[x for pair in f.ranges for x in pair] for f in each], [sorted(f.items) for f in each], [f.longest for f in each], [f.longest_at for f in each]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, k) for x, k in zip(new, _TYPES, strict=True))], [*keep, *(n for n, _ in _FIELDS)])
        give_back_memory()

    docs = docs.mapInArrow(scan, with_fields(docs, *_FIELDS))
    hit = F.aggregate("hit_ranges", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")), lambda s, x: F.struct((s.n + s.sign * x).alias("n"), (-s.sign).alias("sign")), lambda s: s.n)
    docs = docs.withColumn("n_hit", hit)
    return docs.select(
        *keep, "n_words", "n_hit", "items", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "hit_ranges", "longest_match", "longest_at",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any hit word, with their own columns; see ``contamination`` for odd cases."""
    out = contamination(docs, benchmark, window)
    return out.filter(~F.col("contaminated")).select(*docs.columns)


