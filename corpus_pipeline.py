"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

Every stage works on all rows its predecessor kept. All but the last return the
columns of documents; `n_chars` follows the text. Rows with a null doc_id pass
the stages that compare documents untouched.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm import common as C
from seriesforge.llm.near_dedup import near_duplicates
from seriesforge.llm.packing import pack, token_pieces
from seriesforge.llm.pii import find_pii, redacted
from seriesforge.llm.quality import score_quality
from seriesforge.llm.suffix_dedup import suffix_dedup


def _rebuilt(made: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of docs from `row`, with this text and its length."""
    new = {} if text is None else {"text": text.cast(docs.schema["text"].dataType), "n_chars": F.length(text).cast("long")}
    return made.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    scored = score_quality(docs, C.table(spark, sf_dir, "labels"), threshold=0.3, carry=docs.columns)
    return _rebuilt(scored.where("predicted = 1"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words a shingle, similarity of 0.8 or more."""
    gone = near_duplicates(docs, shingle=5, percent=80).where("not kept").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def suffix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of at least 100 bytes that stand earlier in the corpus are cut."""
    return _rebuilt(suffix_dedup(docs, length=100, carry=docs.columns, as_text=True), docs, F.col("kept"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    found = find_pii(docs, carry=docs.columns)
    return _rebuilt(found.withColumn("whole", redacted(found)), docs, F.col("whole"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, size=2048)
    return pack(pieces, size=2048).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix), ("pii", personal_data), ("packing", packing)]

#: SQL can't express the first stage's fit nor the last one's plan; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = C.stage(step(spark, docs, sf_dir), name)
    return docs
