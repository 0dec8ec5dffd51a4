"""What several of the text operators share: reading, staging and Arrow buffers.

Text reaches numpy as Arrow buffers: one batch is a byte array with the offset
of each document, so that hashing runs over whole batches and not row by row.
"""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task hashes at once; numpy needs about 60 times as much.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The application's folder for tables between stages, below spark.checkpoint.dir, so that one folder can go when the application is done.

    Only a local master may do without that setting (as in tests): elsewhere a folder of one machine is none that executors share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "seriesforge-stages")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: later steps survive lost executors, and nothing is computed twice."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the input, by shuffles whatever their size.

    Left alone, Spark judges a table by its compressed files, of which rows in memory take 20 times the room
    (more, if rows are multiplied first), and sends what seems small to all tasks through the driver.
    """
    return left.join(right.hint("merge"), on, how)


def with_text(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id as long, text as string (null: empty); with carry, also `row`, a struct of those columns."""
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    return docs.select(*cols, *([F.struct(*carry).alias("row")] if carry else []))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column, and the offset at which each row starts (one more than rows)."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut into runs of rows of at most `limit` bytes of text (or one row)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, starts = text_bytes(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def tidy(job):
    """A task function over batches that gives memory back when it ends, since Spark keeps the worker for other tasks."""

    @functools.wraps(job)
    def run(*args):
        try:
            yield from job(*args)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not this C library
                pass

    return run


def table_of_words(seed: int) -> np.ndarray:
    """256 odd 64-bit numbers, one for each byte."""
    return np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes (a finalizer of multiply-and-shift steps)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def power(base: int, n: int) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


def lists(values: pa.Array, starts: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the offset of each list."""
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), values)
