"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes each as Parquet in the shared folder
and reads it again as the next one's documents. All stages but the last return the columns of their documents, in order.

Every stage takes documents with null texts, ids or other columns, empty and very long texts, repeated rows, rows that share an
id, empty tables, and further columns of any name, and says below what becomes of them. A stage judges whole texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vidspark.llm import decontam, lines, minhash, packing, quality
from vidspark.llm._common import drop_scratch, read_table, scratch_mark, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are.

    Null and empty texts have no words and go. Each row is judged by its own text and language (null is a language of its own), so
    equal rows stay or go together. No rows give no rows.
    """
    return quality.drop_low_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that three documents hold, but for the one of the largest id; n_chars is that of the new text.

    A text may become empty; its row stays. A null text stays null, with null n_chars. Rows of one id are one document; each different text
    without id is one, and never the one that keeps a line. No rows give no rows.
    """
    return lines.drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each class of near duplicates, as it is.

    Rows without id and null texts all stay. Rows that share an id are judged by their own texts; of rows that are equal in id and text one
    stays. Texts without words are duplicates of equal ones only. No rows give no rows.
    """
    return minhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item, as they are.

    Null and empty texts hold nothing and stay; each row is judged for itself. Null items count for nothing, items without id like others.
    No rows give no rows, and without a benchmark all stay.
    """
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, placed in sequences; other columns are not read.

    A null or empty text is its end id alone. Rows that share an id, or have none, are packed each for itself. No rows give no pieces.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]

#: SQL has no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. What a stage has put into the shared folder goes when its result is written."""
    docs = read_table(spark, sf_dir, "documents")
    mark = scratch_mark()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
            drop_scratch(spark, mark, keep=1)
    return docs
