"""Packing of tokenized documents into windows of one length by best-fit decreasing."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, give_back_memory, written

WINDOW = 2048
END_ID = 1
#: Remainders that one task packs; from some thousand on, padding no longer falls.
GROUP = 20_000
#: Words whose ids a task keeps at a time.
KEPT_WORDS = 800_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_encoders: dict[str, TextIds] = {}


class TextIds:
    """Ids of whole texts, as little-endian 32-bit numbers, from the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def forget(self) -> None:
        """Frees what was kept for later texts."""


class WordIds(TextIds):
    """The same from the ids of words, each encoded once, for tokenizers that drop white space and case.

    There no token spans a space or line end, so the ids of a text are those of its parts between them. A
    part that is plain letters, perhaps with marks after them, is made of the ids of the lower-cased letters
    and of the marks. New letters are encoded many in one call, a space between each, and told apart by
    the library's own word numbers.
    """

    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#%&()*+,\-./:;=?@\[\]^{}~]{0,4})")
    #: Texts whose ids must be those of the library: marks, contractions, digits, accents and their parts, case that changes length, other scripts, white
    #: and control characters, words of any length, unknown symbols and strings of special tokens.
    PROBES = (
        "Ab, cd. EF'S it's x1y,2 ÉÀß.,. Öl ÿ <|endoftext|>a\nq  \t(z)\n\n", "", " ", "\n", "a", "A" * 300, "ab" * 60 + ", " + "Zz" * 120 + "!?", "e\u0301 E\u0301 n\u0303o ǅ İi ıI ẞ ß ﬁ Σας", "漢字かな 한글 ไทย עברית العربية हिन्दी",
        "1 12 123 1234 12345 3.14 1,000 2nd x2 4x v1.2.3", "a\u00a0b c\u2003d e\u200bf g\x00h i\x1cj k\x85l m\u2028n", "(a) [b] {c} a-b a_b a/b a\\b a@b.c #d $5 50% ^ ~ `q` \"r\" '' --- ... !!! ?!", "😀 👩\u200d👩\u200d👧 ♥ → € ™ ½", "[CLS] [UNK] <s> </s> [PAD] ##ing",
        "The THE the tHe; Über ÜBER über. Ça, çA? Ñandú:", "don't DON'T I'm we'll o'clock 'quoted' rock'n'roll", "\ta\n\nb\r\nc\x0bd\x0ce",
    )

    def __init__(self, path: str):
        super().__init__(path)
        self.parts: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.forget()

    def fits(self) -> bool:
        """Whether this tokenizer is of the kind."""
        odd = any(x.lstrip or x.rstrip or " " in x.content or "\n" in x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        return not odd and self(list(self.PROBES)) == super().__call__(list(self.PROBES))

    def forget(self) -> None:
        self.parts, self.stems, self.marks = {"": b""}, {}, {"": b""}

    def _learn_stems(self, stems: list[str]) -> None:
        for i in range(0, len(stems), 20_000):
            lots = [stems[k : k + 500] for k in range(i, min(i + 20_000, len(stems)), 500)]
            for lot, encoded in zip(lots, self.tokenizer.encode_batch([" ".join(x) for x in lots], add_special_tokens=False), strict=True):
                numbers = np.array(encoded.word_ids)
                cuts = np.flatnonzero(np.diff(numbers)) + 1
                if len(cuts) + 1 == len(lot):
                    data = array("I", encoded.ids).tobytes()
                    ends = [0, *(4 * cuts).tolist(), len(data)]
                    self.stems.update((stem, data[a:b]) for stem, a, b in zip(lot, ends[:-1], ends[1:], strict=True))
                else:
                    self.stems.update(zip(lot, super().__call__(lot), strict=True))

    def _learn(self, parts: set[str]) -> None:
        known, stems, marks, plain = self.parts, self.stems, self.marks, self.PLAIN.fullmatch
        waiting, other = [], []
        for part in parts:
            if found := plain(part):
                stem, mark = found.groups()
                stem = stem.lower()
                if stem in stems and mark in marks:
                    known[part] = stems[stem] + marks[mark] if mark else stems[stem]
                else:
                    waiting.append((part, stem, mark))
            else:
                other.append(part)
        self._learn_stems(list({stem for _, stem, _ in waiting}.difference(stems)))
        if new := list({mark for _, _, mark in waiting}.difference(marks)):
            marks.update(zip(new, super().__call__(new), strict=True))
        for part, stem, mark in waiting:
            known[part] = stems[stem] + marks[mark] if mark else stems[stem]
        for i in range(0, len(other), 20_000):
            known.update(zip(other[i : i + 20_000], super().__call__(other[i : i + 20_000]), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [text.replace("\n", " ").split(" ") for text in texts]
        new = set().union(*split).difference(self.parts)
        if len(self.parts) + len(new) > KEPT_WORDS:
            self.forget()
            new = set().union(*split).difference(self.parts)
        self._learn(new)
        return [b"".join(map(self.parts.__getitem__, parts)) for parts in split]


def ids_of(path: str) -> TextIds:
    words = WordIds(path)
    return words if words.fits() else TextIds(path)


def _encoder(path: str) -> TextIds:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = ids_of(path)
    return _encoders[path]


def _by_bytes(texts: list[str], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, text in enumerate(texts):
        if i > at and size + len(text) > most:
            yield at, i
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)


def token_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Each document's ids and the end id, cut into full windows and a remainder.

    Gives doc_id, start, length, ids_crc32, doc_tokens, ids (if asked for), and part and row, which
    together are unique for each piece. Only the numbers leave the task, not the ids.
    """
    bound_batches(docs.sparkSession)
    end = array("I", [end_id]).tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for a, b in _by_bytes(texts):
                out: list[tuple] = []
                for doc_id, ids in zip(doc_ids[a:b], _encoder(tokenizer)(texts[a:b]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        cut = ids[4 * start : 4 * min(start + window, n)]
                        out.append((doc_id, start, len(cut) // 4, zlib.crc32(cut), n, part, row, *([cut] if with_ids else [])))
                        row += 1
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *([pa.binary()] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        if tokenizer in _encoders:
            _encoders[tokenizer].forget()
        give_back_memory()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "row", *(["ids"] if with_ids else [])]
    schema = f"{PIECES}, part int, row long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, schema)


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: longest first, each into the tightest open bin.

    A segment tree over remaining capacities holds how many open bins have each; the first capacity
    that suffices is found by one way up and one way down. Of equal lengths the earlier goes first,
    and of bins with equal room the one that got there last is taken.
    """
    leaves = 1 << int(window).bit_length()
    tree, open_bins = [0] * (2 * leaves), [[] for _ in range(window + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0

    def change(capacity: int, by: int) -> None:
        i = capacity + leaves
        while i:
            tree[i] += by
            i >>= 1

    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        i = length + leaves
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i > 1:
                i += 1
                while i < leaves:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
        if i > 1:
            room = i - leaves
            own = open_bins[room].pop()
            change(room, -1)
        else:
            room, own = window, made
            made += 1
        bins[item], offsets[item] = own, window - room
        if room > length:
            open_bins[room - length].append(own)
            change(room - length, 1)
    return bins, offsets


def pack(pieces: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """The pieces with sequence_id and offset.

    A full window is a sequence of its own. Remainders are dealt by hash into groups of about
    ``group``, whose number follows their count, and each group is packed in one task; no document id
    decides a group, so no id can make one large. sequence_id is unique; its lowest bit tells packed
    sequences from full ones.
    """
    keep = [c for c in pieces.columns if c not in ("part", "row")]
    full = pieces.filter(F.col("length") == window).select(*keep, ((F.col("part").cast("long") * 2**30 + F.col("row")) * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < window)
    groups = max(1, -(-rest.count() // group))
    rest = rest.withColumn("_group", F.pmod(F.xxhash64("part", "row"), F.lit(groups)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name in keep) + ", sequence_id long, offset long"

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("row", "ascending")])
        bins, offsets = best_fit_decreasing(table.column("length").to_numpy(), window)
        base = table.column("_group")[0].as_py() * 2**31 + 1
        return table.select(keep).append_column("sequence_id", pa.array(base + 2 * bins)).append_column("offset", pa.array(offsets))

    return full.unionByName(rest.groupBy("_group").applyInArrow(one, schema))


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """Every document's token pieces placed in sequences of at most ``window`` tokens.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Each
    id lies in one piece; the pieces of a sequence fill it without gaps from 0; what is left of it is
    padding. With ``sequences`` the ids themselves can be had.

    Null and empty texts are a single end id. Overlong documents are first cut into full windows; a
    document of an exact multiple has no remainder. Documents of equal length go in order of
    reading. Rows with null or repeated ids are packed like others. An empty table gives no pieces.
    Columns other than doc_id and text are not read.
    """
    return pack(written(token_pieces(docs, tokenizer, window, end_id), "pieces"), window, group)


def sequences(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, pad_id: int = 0, group: int = GROUP) -> DataFrame:
    """sequence_id and its ``window`` ids (array<int>), padded with ``pad_id``; a null document is as an empty one."""
    placed = pack(written(token_pieces(docs, tokenizer, window, end_id, with_ids=True), "pieces"), window, group)

    def joined(table: pa.Table) -> pa.Table:
        ids = b"".join(table.sort_by("offset").column("ids").to_pylist())
        out = np.full(window, pad_id, np.int32)
        out[: len(ids) // 4] = np.frombuffer(ids, np.int32)
        return pa.table({"sequence_id": table.column("sequence_id")[:1], "ids": pa.array([out.tolist()], pa.list_(pa.int32()))})

    return placed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(joined, "sequence_id long, ids array<int>")
