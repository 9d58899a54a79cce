"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a null document id inside an operator; where rows without id are told apart, they have numbers from it to NULL_END.
#: Real ids below do not occur.
NULL_ID, NULL_END = -(2**63), -(2**62)
BATCH_BYTES = "16m"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only in local mode, where none is configured (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="vidspark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


_written: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which ``clean_scratch`` will delete."""
    _written.append(f"{scratch_dir(spark)}/vidspark-{name}-{uuid.uuid4().hex}")
    return _written[-1]


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df = df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "void"})
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """Where the tables that are put into the shared folder from now on begin; for ``drop_scratch``."""
    return len(_written)


def drop_scratch(spark: SparkSession, mark: int, keep: int = 0) -> None:
    """Deletes what this process has put into the shared folder since the mark, but for the last ``keep`` tables; frames that read it end with it."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    last = len(_written) - keep
    for name in _written[mark:last]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    del _written[mark : max(mark, last)]


def clean_scratch(spark: SparkSession) -> None:
    """Deletes all that this process has put into the shared folder; frames that read it end with it."""
    drop_scratch(spark, 0)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches end at BATCH_BYTES, so that a batch of very long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def give_back_memory() -> None:
    """Returns what a worker has freed to the system; workers live on, and an executor has several."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that is not taken."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def with_fields(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    """Schema of ``df`` and further fields."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in fields)])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the offsets of the rows (nulls are empty)."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row; null is empty."""
    raw, offsets = text_buffers(column)
    data = raw.tobytes()
    return [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def sliced(batches: Iterator[pa.RecordBatch], at: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts, in column ``at``, have about ``most`` bytes; a longer text has a slice of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def identity() -> tuple[Column, Column]:
    """What tells rows (doc_id, text) apart: the doc_id, or for a row without one a number below NULL_END made of its text; and a hash of the text."""
    text = F.col("text").cast("string")
    nameless = F.lit(NULL_ID) + F.pmod(F.xxhash64(text), F.lit(NULL_END - NULL_ID))
    return F.coalesce(F.col("doc_id").cast("long"), nameless), F.hash(text)


def id_key(column: Column | str) -> Column:
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("long"), F.lit(NULL_ID))
