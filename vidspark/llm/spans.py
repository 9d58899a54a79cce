"""Substring dedup: repeated runs of consecutive sentences lose all but their first occurrence."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import NULL_END, NULL_ID, bound_batches, fresh, give_back_memory, identity, sliced, text_buffers, texts_of, written
from ._words import stretch_hashes, word_hashes

MIN_SENTENCES = 2
MIN_WORDS = 20
#: A sentence with so many spaces or more is long: its clauses count as sentences.
LONG_SENTENCE = 12

#: A sentence ends after marks and white space, or at line ends.
_END = re.compile(rb"[.!?][\"')\]]*[ \t\r]+|\n+")
#: A clause ends after these marks and white space.
_CLAUSE = re.compile(rb"[,;:][\"')\]]*[ \t\r]+")
#: No word goes on over the end of a sentence or clause.
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def sentence_bounds(text: bytes) -> list[int]:
    """Where the sentences of a text, or clauses of its long sentences, begin, and its length; white space after one is part of it."""
    out, at = [0], 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        if end > at:
            if text.count(b" ", at, end) >= LONG_SENTENCE:
                out += [m.end() for m in _CLAUSE.finditer(text, at, end) if m.end() < end]
            out.append(end)
            at = end
    return out


def batch_spans(words: np.ndarray, per_sentence: np.ndarray, row: np.ndarray, min_sentences: int, min_words: int) -> tuple[np.ndarray, ...]:
    """Of every run of some texts, in order of text and place: hashes of 64 and 32 bits, first and last sentence (as places in per_sentence).

    ``row`` says whose each sentence is. Runs go from each sentence with words to the nearest end, and from the nearest start to each
    such sentence, that leave ``min_sentences`` sentences with words and ``min_words`` words or more. So every sentence of a repeated
    stretch of that size is in a run. All texts are handled at once: word counts only rise, so one search serves them all.
    """
    own = np.flatnonzero(per_sentence)
    ends = np.cumsum(per_sentence[own])
    starts, every, n = ends - per_sentence[own], np.arange(len(own)), len(own)
    last = np.maximum(np.searchsorted(ends, starts + min_words), every + min_sentences - 1)
    first = np.minimum(np.searchsorted(starts, ends - min_words, side="right") - 1, every - min_sentences + 1)
    onward = np.flatnonzero(last < np.searchsorted(row[own], row[own], side="right"))
    back = np.flatnonzero(first >= np.searchsorted(row[own], row[own]))
    runs = np.unique(np.concatenate([onward * n + last[onward], first[back] * n + back]))
    a, b = runs // max(n, 1), runs % max(n, 1)
    hash_, more = stretch_hashes(words, starts[a], ends[b])
    return hash_.view(np.int64), more.astype(np.uint32).view(np.int32), own[a], own[b]


def _sentences(batch_text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all rows, words of each sentence, each sentence's row and its number there."""
    raw, offsets = text_buffers(batch_text)
    data, cuts, sizes = raw.tobytes(), [0], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = sentence_bounds(data[a:b])
        cuts += [a + x for x in own[1:]]
        sizes.append(len(own) - 1)
    words, at = word_hashes(raw, np.array(cuts, np.int64))
    n = np.array(sizes, np.int64)
    return words, np.diff(at), np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def repeated_spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """_id and _own of rows (see ``identity``), the sentences (start, end) of every run that is not the first of its kind, and the _id of the first.

    First is the least _id, then the least sentence. Runs are grouped by their hash with partial minima and counts; hot
    runs are joined back under adaptive execution, so none meets in one task. The texts are cut into runs twice, for the
    counts and for the join, so that the runs of all texts, which are several times as many as the sentences, never lie in a table.
    """
    bound_batches(docs.sparkSession)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            words, counts, row, number = _sentences(batch.column(2))
            hash_, more, start, end = batch_spans(words, counts, row, min_sentences, min_words)
            order = np.lexsort((more, hash_, row[start]))  # stable: equal runs of a row stay in order of place
            equal = (np.diff(hash_[order]) == 0) & (np.diff(more[order]) == 0) & (np.diff(row[start[order]]) == 0)
            again = np.zeros(len(order), bool)
            again[order[1:]] = equal
            owner = pa.array(row[start])
            columns = [batch.column(0).take(owner), batch.column(1).take(owner), hash_, more, number[start].astype(np.int32), (number[end] + 1).astype(np.int32), again]
            made = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["_id", "_own", "hash", "more", "start", "end", "again"])
            for at in range(0, made.num_rows, 50_000):
                yield made.slice(at, 50_000)
        give_back_memory()

    every = docs.select(*identity(), F.col("text").cast("string")).mapInArrow(spans, "_id long, _own int, hash long, more int, start int, end int, again boolean")
    firsts = every.groupBy("hash", "more").agg(F.count("*").alias("n"), F.min("_id").alias("first"))
    firsts = written(firsts.filter(F.col("n") > 1).select("hash", "more", "first"), "firsts")
    again = every.join(firsts, ["hash", "more"]).filter((F.col("_id") != F.col("first")) | F.col("again"))
    return again.select("_id", "_own", "start", "end", "first")


def _real(doc_id: int) -> int | None:
    return None if doc_id < NULL_END else doc_id


def dedup_spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without sentences that a non-first repeated run covers; adds n_sentences, n_removed, n_words_removed, first_doc_id, kept_sha256.

    first_doc_id is the least document that holds the first occurrence of something removed; null if nothing is.
    Sentences end after ``.``, ``!`` or ``?`` and white space, or at line ends; a sentence with LONG_SENTENCE spaces
    or more counts as its clauses, so that a passage within one loses little. They are compared by their words (as
    in ``contamination``), so case, marks and spacing do not matter. What is kept stays byte for byte.

    Null and empty texts have no sentences; a null text stays null. Each row loses sentences of its own only. Rows
    of one doc_id are one document's versions: what it is the first to hold stays in each of them. Rows without doc_id come
    before all ids (below NULL_END there are none), each different text a document of its own. Rows that are equal
    in id and text have equal results. Empty tables stay empty. Columns named as the new ones are replaced, all others are kept.
    """
    new = ("n_sentences", "n_removed", "n_words_removed", "first_doc_id", "kept_sha256")
    docs = docs.drop(*new)
    names, at = docs.columns, docs.columns.index("text")
    gone = repeated_spans(docs, min_sentences, min_words)
    keys, runs = [fresh(c, names) for c in ("_id", "_own")], fresh("_gone", names)
    gone = gone.groupBy("_id", "_own").agg(F.collect_set(F.struct("start", "end", "first")).alias(runs)).toDF(*keys, runs)
    both = docs.withColumns(dict(zip(keys, identity(), strict=True))).join(gone, keys, "left").select(*names, runs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            texts, numbers, valid = [], [], batch.column(at).is_valid().to_pylist()
            for there, gone, text in zip(valid, batch.column(len(names)).to_pylist(), texts_of(batch.column(at)), strict=True):
                bounds, n_words = sentence_bounds(text), 0
                drop = np.zeros(len(bounds) - 1, bool)
                for span in gone or ():
                    drop[span["start"] : span["end"]] = True
                if drop.any():
                    pieces = [(text[a:b], d) for a, b, d in zip(bounds[:-1], bounds[1:], drop.tolist(), strict=True)]
                    n_words = sum(len(_WORD.findall(x)) for x, d in pieces if d)
                    text = b"".join(x for x, d in pieces if not d)
                texts.append(text if there else None)
                numbers.append((len(drop), int(drop.sum()), n_words, _real(min((span["first"] for span in gone or ()), default=NULL_ID)), hashlib.sha256(text).hexdigest()))
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            added = [pa.array(c, k) for c, k in zip(list(zip(*numbers, strict=True)) or [()] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *added], [*names, *new])
        give_back_memory()

    fields = [T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema.fields]
    added = [T.StructField(n, t) for n, t in zip(new, (T.LongType(), T.LongType(), T.LongType(), T.LongType(), T.StringType()), strict=True)]
    return both.mapInArrow(cut, T.StructType([*fields, *added]))
