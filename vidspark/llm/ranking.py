"""Ranked lexical search: document FP-trees, searched for each item by depth-first branch-and-bound."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bound_batches, give_back_memory, sliced, text_buffers, written
from ._words import word_hashes

TOP = 50
#: Bytes of item text in one block; what is held of a block, in driver and tasks, takes about 30 times that.
BLOCK_BYTES = 1 << 22
#: Documents and occurrences of terms in one tree at most; a larger document has a tree of its own.
TREE_DOCS, TREE_TERMS = 1 << 15, 1 << 21
#: Documents of a node that are no longer told apart by their next terms, if they are so few.
LEAF = 32
#: Branchings above one another at most; what lies deeper is a leaf, and no less exact.
LEVELS = 48
#: Lists of the best that are merged before those of an item meet.
LANES = 64

#: Stands for a missing doc_id within a search, so that it comes last among equals.
NO_ID = 2**63 - 1


def measure(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term that a document of measure m holds tf times counts, before its weight. Grows with tf, falls with m."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class DocumentTree:
    """An FP-tree of documents: each is the path of its terms, the commonest first, so common beginnings are shared.

    ids, m: of the documents, which are put in the order of their paths, so that each subtree is a range of them. Steps that all documents of a node take are one.
    A node of LEAF documents or fewer, or of equal paths, is not split further. For each node the tree has the least m in its subtree, and for each term in it the greatest tf: these pairs lie
    in the order of terms, as the header table of a term.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, bounds: np.ndarray, terms: np.ndarray, tfs: np.ndarray):
        """bounds: where each document's terms begin; terms: numbers, the commonest term is 0, ascending in each document."""
        n, sizes = len(ids), np.diff(bounds)
        paths = terms.astype(">u4")
        order = np.array(sorted(range(n), key=lambda i: paths[bounds[i] : bounds[i + 1]].tobytes()), np.int64)
        self.ids, self.m, sizes = ids[order], m[order], sizes[order]
        self.bounds = np.append(0, np.cumsum(sizes))
        take = np.arange(self.bounds[-1]) - np.repeat(self.bounds[:-1], sizes) + np.repeat(bounds[order], sizes)
        self.terms, self.tfs = terms[take].astype(np.int64), tfs[take].astype(np.int64)
        self.gain = measure(self.tfs, np.repeat(self.m, sizes))
        self._split(sizes)
        self._bound(sizes)

    def _split(self, sizes: np.ndarray) -> None:
        low, high, children, level, at = [0], [len(self.ids)], [[]], [0], 0
        while at < len(low):
            a, b = low[at], high[at]
            if b - a > LEAF and level[at] < LEVELS:
                # What the first and the last have in common, all between them have; after it those that end come first, the others go by their next term.
                first, last = (self.terms[self.bounds[k] : self.bounds[k + 1]] for k in (a, b - 1))
                same = min(len(first), len(last))
                differ = np.flatnonzero(first[:same] != last[:same])
                depth = int(differ[0]) if len(differ) else same
                nexts = np.where(sizes[a:b] > depth, self.terms[np.minimum(self.bounds[a:b] + depth, len(self.terms) - 1)], -1)
                cuts = np.flatnonzero(np.append(True, nexts[1:] != nexts[:-1]))
                for start, end in zip(cuts.tolist(), [*cuts[1:].tolist(), b - a], strict=True) if len(cuts) > 1 else ():
                    children[at].append(len(low))
                    low.append(a + start)
                    high.append(a + end)
                    level.append(level[at] + 1)
                    children.append([])
            at += 1
        self.low, self.high, self.children, self.level = low, high, children, np.array(level)

    def _bound(self, sizes: np.ndarray) -> None:
        nodes, span = len(self.low), int(self.terms.max(initial=0)) + 1
        self.least = np.array([self.m[a:b].min() for a, b in zip(self.low, self.high, strict=True)], np.int64)
        parent, leaf_of = np.full(nodes, -1), np.empty(len(self.ids), np.int64)
        for node, below in enumerate(self.children):
            parent[below] = node
            if not below:
                leaf_of[self.low[node] : self.high[node]] = node
        keys, tops = _greatest(np.repeat(leaf_of, sizes) * span + self.terms, self.tfs)
        all_keys, all_tops = [keys], [tops]
        # Up the tree: a node's pairs are those of its children, the greatest tf of each term.
        node_of, term_of = np.divmod(keys, span)
        level = self.level[node_of]
        below, below_tops = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for d in range(int(self.level.max()), 0, -1):
            here = level == d
            own = np.concatenate([parent[node_of[here]] * span + term_of[here], parent[below // span] * span + below % span])
            below, below_tops = _greatest(own, np.concatenate([tops[here], below_tops]))
            all_keys.append(below)
            all_tops.append(below_tops)
        keys, tops = np.concatenate(all_keys), np.concatenate(all_tops)
        node, term = np.divmod(keys, span)
        order = np.argsort(term, kind="stable")
        self.pair_node, self.pair_gain = node[order], measure(tops[order], self.least[node[order]])
        self.header = np.searchsorted(term[order], np.arange(span + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], most: int) -> list[int]:
        """Puts the documents with the highest scores for weighted terms into best, a heap of (score, -doc_id) of ``most`` at most, and returns how many nodes and documents it looked at.

        Depth first, the child with the higher bound before the others. A bound is the sum of what each term could count at the greatest tf and the least m of the subtree;
        a subtree is passed over if that is less than the last of a full heap. One that is equal may hold a lesser doc_id.
        """
        known = terms < len(self.header) - 1
        terms, weights = terms[known], weights[known]
        bound = np.zeros(len(self.low), np.int64)
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            a, b = self.header[t], self.header[t + 1]
            bound[self.pair_node[a:b]] += w * self.pair_gain[a:b]  # a node once for each term
        weight = np.zeros(len(self.header), np.int64)
        weight[terms] = weights
        seen = [0, 0]
        stack = [0]
        while stack:
            node = stack.pop()
            reach = int(bound[node])
            if not reach or len(best) == most and reach < best[0][0]:
                continue
            seen[0] += 1
            if self.children[node]:
                stack.extend(sorted(self.children[node], key=lambda k: bound[k]))
                continue
            a, b = self.low[node], self.high[node]
            p, q = self.bounds[a], self.bounds[b]
            sums = np.append(0, np.cumsum(weight[self.terms[p:q]] * self.gain[p:q]))
            scores = sums[self.bounds[a + 1 : b + 1] - p] - sums[self.bounds[a:b] - p]
            seen[1] += b - a
            for k in np.flatnonzero(scores >= max(1, best[0][0] if len(best) == most else 1)).tolist():
                entry = int(scores[k]), -int(self.ids[a + k])
                if len(best) < most:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return seen


def _greatest(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the greatest value of each."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.maximum.reduceat(values[order], first)


def item_blocks(items: DataFrame, most: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """The stated query set, block by block: ids, and each item's different terms as hashes. Rows of one id follow each other and are one item."""
    ids, texts, size = [], [], 0
    for row in items.select("item_id", F.col("text").cast("string")).orderBy("item_id").toLocalIterator():
        if ids and row[0] == ids[-1]:
            texts[-1] += f" {row[1] or ''}"
        else:
            if size >= most:
                yield ids, _terms(texts)
                ids, texts, size = [], [], 0
            ids.append(row[0])
            texts.append(row[1] or "")
        size += len(row[1] or "")
    if ids:
        yield ids, _terms(texts)


def _terms(texts: list[str]) -> list[np.ndarray]:
    words, bounds = word_hashes(*text_buffers(pa.array(texts, pa.string())))
    return [np.unique(words[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


_VECTORS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])


def term_vectors(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n (all terms of the whole text, with repeats), and which terms of a sorted vocabulary (hashes) it holds, by number, and how often. Documents without terms are left out."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in sliced(batches, 1):
            words, bounds = word_hashes(*text_buffers(batch.column(1)))
            n = np.diff(bounds)
            slot = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
            hit = np.flatnonzero(known[slot] == words) if len(known) else np.zeros(0, np.int64)
            doc = np.searchsorted(bounds, hit, "right") - 1
            keys, counts = np.unique(doc * max(1, len(known)) + slot[hit], return_counts=True)
            doc, term = np.divmod(keys, max(1, len(known)))
            offsets = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x, pa.int32())) for x in (term, counts)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], _VECTORS.names)
            yield out.filter(pa.array(n > 0))
        give_back_memory()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _VECTORS)


def _trees(batches: Iterator[pa.RecordBatch], rank: np.ndarray, n_docs: int, n_terms: int) -> Iterator[DocumentTree]:
    """Trees of the vectors, each of TREE_DOCS documents and TREE_TERMS terms at most."""
    held: list[pa.RecordBatch] = []
    docs = terms = 0

    def made() -> DocumentTree:
        (whole,) = pa.Table.from_batches(held).combine_chunks().to_batches()
        ids, n = whole.column(0).fill_null(NO_ID).to_numpy(), whole.column(1).to_numpy()
        sizes = whole.column(2).value_lengths().to_numpy()
        term, tf = rank[whole.column(2).flatten().to_numpy()], whole.column(3).flatten().to_numpy()
        order = np.lexsort((term, np.repeat(np.arange(len(ids)), sizes)))
        return DocumentTree(ids, 50 + 50 * n * n_docs // n_terms, np.append(0, np.cumsum(sizes)), term[order], tf[order])

    for batch in batches:
        batch = batch.filter(pc.greater(pc.list_value_length(batch.column(2)), 0))  # the others have none of the terms asked for
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            held.append(part)
            docs += part.num_rows
            terms += len(part.column(2).flatten())
            if docs >= TREE_DOCS or terms >= TREE_TERMS:
                yield made()
                held.clear()
                docs = terms = 0
    if held:
        yield made()


def _best_of_block(docs: DataFrame, ids: list, items: list[np.ndarray], top: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = np.unique(np.concatenate(items)) if items else np.zeros(0, np.uint64)
    vectors = written(term_vectors(docs, vocabulary), "vectors")
    whole = vectors.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(vocabulary), np.int64)
    counted = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # a row a term of this block
    df[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * whole.docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
    asked = [np.searchsorted(vocabulary, t) for t in items]
    sent = spark.sparkContext.broadcast((rank, [(rank[t], weight[t]) for t in asked]))  # of one block of items
    n_docs, n_terms = int(whole.docs), int(whole.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, queries = sent.value
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        for tree in _trees(batches, ranks, n_docs, n_terms):
            for (terms, weights), heap in zip(queries, best, strict=True):
                tree.search(terms, weights, heap, top)
        rows = [(i, -minus, score) for i, heap in enumerate(best) for score, minus in heap]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["item", "doc", "score"])
        give_back_memory()

    found = vectors.mapInArrow(run, "item int, doc long, score long").withColumn("lane", F.spark_partition_id() % LANES)
    order = (F.desc("score"), F.asc("doc"))
    for keys in (("item", "lane"), ("item",)):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    names = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", T.LongType())]))
    out = found.join(F.broadcast(names), "item")  # a row an item of this block
    return out.select("item_id", "rank", F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "score")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: of each item the ``top`` documents with the highest scores above 0, equal scores by doc_id.

    docs: doc_id, text; items: item_id (a whole number), text. Terms are longest runs of ``[0-9a-z]`` and code points from U+0080 on, A-Z lower-cased. The score sums, over an item's different
    terms, the whole weight floor(1000 ln((2N + 2) / (2 df + 1))) times (1e9 tf) div (1000 tf + 20 m), with m = 50 + (50 n N) div L: N documents have terms, L in all, n this one, df of them hold the term, tf times this one.

    The items are a stated query set, read and sent out in blocks. For a block, a pass over whole texts writes each document's terms that the block asks for, with their counts; df, N and L are sums
    over these. A second pass builds FP-trees of up to TREE_DOCS documents in each task and searches them for each item, with the heap of the trees before; so ``top`` rows a task and item move.

    Null and empty texts have no terms; neither such documents nor such items come up. Repeated rows are ranked each; rows without doc_id come last among equals. Items
    that share an id (null is one) are one item with the terms of all. Empty tables give no rows. Other columns are not read.
    """
    out = None
    for ids, terms in item_blocks(items.withColumn("item_id", F.col("item_id").cast("long")), block_bytes):
        part = _best_of_block(docs, ids, terms, top)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
