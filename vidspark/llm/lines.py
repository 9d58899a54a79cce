"""Line dedup: Bloom filters pick out the suspected repeats, a shuffle of those alone decides."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bound_batches, fresh, identity, mix, texts_of, written

WHITE = b" \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3
#: Filters have about so many bits a line. One task fills those of one key range, of RANGE_LINES lines or so.
BITS_A_LINE = 16
RANGE_LINES = 1 << 21
#: The twice-seen filter of a range is halved while at most this part of its bits is set,
FULL = 0.05
#: and all of them together are sent out up to so many bytes.
MOST_BYTES = 64 << 20


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The key of each line, or None if it is too short to count."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(WHITE).lower()
        long = len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)
        out.append(key if long else None)
    return out


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two bits of a filter for each 64-bit hash; its top bits say its range."""
    return np.stack([hashes & np.uint64(bits - 1), mix(hashes) & np.uint64(bits - 1)], axis=1).astype(np.int64)


def _set(filled: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(filled, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def _has(filled: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _distinct(text: bytes, min_chars: int) -> list[bytes]:
    return [_hash(x) for x in {x for x in line_keys(text, min_chars) if x is not None}]


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _firsts(hashes: list[bytes]) -> np.ndarray:
    """The first 64 bits of 128-bit hashes."""
    return np.frombuffer(b"".join(hashes), "<u8")[::2]


def _halved(filled: np.ndarray) -> np.ndarray:
    """A filter folded on itself while few of its bits are set; a place is then taken modulo its new size."""
    while len(filled) > 8 and int(np.bitwise_count(filled).sum()) <= FULL * 4 * len(filled):
        filled = filled[: len(filled) // 2] | filled[len(filled) // 2 :]
    return filled


def twice_seen(docs: DataFrame, lines: int, min_chars: int = MIN_CHARS) -> dict[int, np.ndarray] | None:
    """By key range, the filter of hashes that two documents or more hold (and a few others); None if they have more than MOST_BYTES.

    The keys are split into ranges by their first bits. 8 bytes of each line's hash go to the range's task, twice at most from each
    batch of documents. It fills a once-seen filter; what that has already goes into the twice-seen filter. So there is one of each
    for a range, however many tasks read the documents, and the memory of a task does not grow with the corpus.
    """
    ranges = max(1, -(-lines // RANGE_LINES))
    bits = 1 << max(10, (BITS_A_LINE * -(-lines // ranges) - 1).bit_length())

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [x for text in texts_of(batch.column(0)) for x in _distinct(text, min_chars)]
            if hashes:
                words, counts = np.unique(_firsts(hashes), return_counts=True)
                words = np.repeat(words, np.minimum(counts, 2))
                cuts = np.searchsorted(_range_of(words, ranges), np.arange(ranges + 1))
                rows = [(k, words[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["range", "hashes"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, own = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8), None
        for batch in batches:
            for own, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words, counts = np.unique(np.frombuffer(data.as_buffer(), "<u8"), return_counts=True)
                at = _places(words, bits)
                _set(twice, at[(counts > 1) | _has(once, at)])
                _set(once, at)
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([_halved(twice).tobytes()], pa.binary())], ["range", "twice"])

    filters = docs.mapInArrow(hashed, "range int, hashes binary").repartitionById(ranges, F.col("range")).mapInArrow(fill, "range int, twice binary")
    filters = written(filters, "filters")
    if (filters.agg(F.sum(F.octet_length("twice"))).first()[0] or 0) > MOST_BYTES:
        return None
    return {r.range: np.frombuffer(r.twice, np.uint8) for r in filters.toLocalIterator()}  # MOST_BYTES at most


def _suspected(hashes: list[bytes], twice: dict[int, np.ndarray], ranges: int) -> np.ndarray:
    words = _firsts(hashes)
    out, where = np.zeros(len(words), bool), _range_of(words, ranges)
    for k in np.unique(where).tolist():
        if k in twice:
            own = where == k
            out[own] = _has(twice[k], _places(words[own], 8 * len(twice[k])))
    return out


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """_id and _own (see ``identity``) and hash of each row's lines that go: found in ``min_docs`` documents, and not in the keeper.

    Lines that the filters of ``twice_seen`` do not have are in one document only. Beyond MOST_BYTES of filters every line is a suspect.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(*[c.alias(n) for c, n in zip(identity(), ("_id", "_own"), strict=True)], F.col("text").cast("string").alias("text"))
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    ranges, twice = max(1, -(-lines // RANGE_LINES)), twice_seen(docs.select("text"), lines, min_chars)
    seen = spark.sparkContext.broadcast(twice)

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = seen.value
        for batch in batches:
            at, hashes = [], []
            for i, text in enumerate(texts_of(batch.column(2))):
                own = _distinct(text, min_chars)
                at += [i] * len(own)
                hashes += own
            if hashes:
                keep = pa.array(_suspected(hashes, twice, ranges) if twice is not None else np.ones(len(hashes), bool))
                rows = pa.array(at, pa.int64()).filter(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(hashes, pa.binary()).filter(keep)], ["_id", "_own", "hash"])

    suspects = written(docs.mapInArrow(suspect, "_id long, _own int, hash binary"), "suspects")
    confirmed = suspects.groupBy("hash").agg(F.countDistinct("_id").alias("n"), F.max("_id").alias("keeper")).filter(F.col("n") >= min_docs).select("hash", "keeper")
    # A table between the sums and the join, so that adaptive execution can split the join's hot hashes.
    return suspects.join(written(confirmed, "confirmed"), "hash").filter(F.col("_id") != F.col("keeper")).select("_id", "_own", "hash")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` without repeated lines: text is what stays, and n_lines, n_dropped and kept_sha256 follow.

    A line's key is the line without white space (space, U+0009 to U+000D) at its ends, A-Z
    lower-cased. Keys of ``min_chars`` code points or more that ``min_docs`` documents hold lose all
    their lines except in the largest doc_id that holds them. The other lines stay as they are, joined
    by line ends.

    Null and empty texts are one empty line; a null text stays null. Rows of one doc_id are one
    document; rows without doc_id come before all ids, so they are never keepers beside others, and each different text of
    theirs is a document. A line that a
    document repeats stays or goes with all its copies. Empty tables stay empty. Columns named as the
    new ones are replaced, all others are kept.
    """
    new = ("n_lines", "n_dropped", "kept_sha256")
    docs = docs.drop(*new)
    keys, drops = [fresh(c, docs.columns) for c in ("_id", "_own")], fresh("_gone", docs.columns)
    gone = repeated_lines(docs, min_chars, min_docs).groupBy("_id", "_own").agg(F.collect_set("hash").alias(drops)).toDF(*keys, drops)
    both = docs.withColumns(dict(zip(keys, identity(), strict=True))).join(gone, keys, "left").select(*docs.columns, drops)
    at, names = docs.columns.index("text"), docs.columns

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = batch.column(at).is_valid().to_pylist()
            n_lines, n_dropped, texts, digests = [], [], [], []
            for text, gone in zip(texts_of(batch.column(at)), batch.column(len(names)).to_pylist(), strict=True):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if gone:
                    gone = set(gone)
                    lines = [line for line, key in zip(lines, line_keys(text, min_chars), strict=True) if key is None or _hash(key) not in gone]
                    text = b"\n".join(lines)
                n_dropped.append(n_lines[-1] - len(lines))
                texts.append(text)
                digests.append(hashlib.sha256(text).hexdigest())
            kept = pa.array([x if y else None for x, y in zip(texts, there, strict=True)], pa.binary()).cast(pa.string())
            columns = [kept if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests, pa.string())], [*names, *new])

    fields = [T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema.fields]
    more = [T.StructField(n, t) for n, t in zip(new, (T.LongType(), T.LongType(), T.StringType()), strict=True)]
    return both.mapInArrow(drop, T.StructType([*fields, *more]))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with what ``dedup_lines`` leaves of each text; a column n_chars is the text's new length."""
    out = dedup_lines(docs, min_chars, min_docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
