"""Token counts of whole texts with a public tokenizer."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import bound_batches, with_fields

#: A text over so many characters is encoded in pieces.
PIECE_CHARS = 1 << 16
#: An encoder call gets about so many bytes of text.
CALL_BYTES = 1 << 19

#: A text that has as many tokens whole as in pieces, if the tokenizer lets texts be cut: letters, digits, marks, other scripts and white space around its places.
PROBE = "The quick  brown fox jumps over 13 lazy dogs, it's 2 x4 yards. A b c 1 2 34 567 end\n x y\t z Q'S don t É a ß b 漢字 c d <|endoftext|> e f g"

_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?= [A-Za-z0-9])")
_loaded: dict[str, object] = {}


class Lengths:
    """Counts tokens with the library that the file's ending names."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.splits, self.skip = True, 0
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            added = tokenizer.get_added_tokens_decoder().values()
            self.splits = not any(x.lstrip or x.rstrip or " " in x.content for x in added)
            self._batch = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self.splits &= self._batch([PROBE]) == [sum(self._batch(safe_pieces(PROBE, 1)))]
        elif path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._batch = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            # The library begins a text as if a space stood before it, so the space at a cut is left out.
            self.splits, self.skip = model.encode("ab cd") == model.encode("ab") + model.encode("cd"), 1
        elif path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._batch = lambda texts: [len(encoding.encode_ordinary(x)) for x in texts]
        else:
            raise ValueError(f"no library known for {path}")

    def __call__(self, texts: list[str]) -> list[int]:
        counts, pieces, owners, size = [0] * len(texts), [], [], 0

        def encode() -> None:
            for owner, n in zip(owners, self._batch(pieces), strict=True):
                counts[owner] += n

        for i, text in enumerate(texts):
            for k, piece in enumerate(safe_pieces(text, PIECE_CHARS) if self.splits else [text]):
                piece = piece[self.skip :] if k else piece
                n_bytes = len(piece.encode())
                if pieces and size + n_bytes > CALL_BYTES:
                    encode()
                    pieces, owners, size = [], [], 0
                pieces.append(piece)
                owners.append(i)
                size += n_bytes
        if pieces:
            encode()
        return counts


def safe_pieces(text: str, most: int) -> list[str]:
    """Cuts a text before single spaces between letters or digits, where no token can span.

    A stretch without such a place stays whole, however long it is.
    """
    out, at = [], 0
    while len(text) - at > most:
        found = _SAFE.search(text, at + most)
        if found is None or found.start() == len(text):
            break
        out.append(text[at : found.start()])
        at = found.start()
    out.append(text[at:])
    return out


def lengths(path: str) -> Lengths:
    """The tokenizer of this worker; loaded once."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = Lengths(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit.

    tokenizer: path of a .json, .model or .tiktoken file, readable on every executor. Counts are those
    of the library for the whole text, without begin, end or added special tokens; strings of special
    tokens inside a text count as the library's default has it.

    Null and empty texts have 0 bytes and 0 tokens. Texts of any length are counted whole. Repeated
    rows stay repeated. An empty table gives an empty table. Columns of ``docs`` that are named as
    the new ones are replaced; all others are kept.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    at = docs.columns.index(text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            n = lengths(tokenizer)(texts)
            new = [pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(count, with_fields(docs, ("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())))
