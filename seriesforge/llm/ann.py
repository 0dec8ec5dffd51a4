"""Approximate nearest neighbours by additive quantisation.

A vector is stored as one code from each of M codebooks of full dimension; the
sum of their words approximates it. Codebooks are fitted to a bounded sample:
k-means on the residuals that the codebooks before leave, then beam search and
sweeps that move each codebook to where it serves the others best. Every row is
encoded by beam search, with the squared norm of its approximation stored.

Only codes and norms are packed in chunks. A block of queries meets a chunk in
one task: tables of inner products with all codewords score the whole chunk,
and the task keeps the SHORT best of each query over the chunks that it sees.
Of all tasks' lists the SHORT best of a query are its shortlist, whatever the
chunks and partitions are; these ids are joined to the original vectors, whose
exact distances give the k nearest. Every row is indexed and scored; no table
size has another way.

What takes no part and how repeated ids count is said in vectors.valid_vectors.
Tables without valid vectors have no neighbours.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import vectors as V

#: Rows that the codebooks are fitted to, at most.
TRAINING = 16_384
M, WORDS, BEAM, SHORT = 24, 256, 4, 128
#: Chunks that one list of a block of queries covers, at most.
COVERED = 256


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """The codes of each row: of the `beam` best sums so far, the best continuations, codebook by codebook."""
    n, dim = x.shape
    rest = x[:, None, :].astype(np.float32)  # what each sum of the beam leaves
    codes, left = np.zeros((n, 1, 0), np.uint8), (rest**2).sum(2)
    for book in books.astype(np.float32):
        step = (rest.reshape(-1, dim) @ (-2 * book.T)).reshape(n, -1, len(book))
        step += left[:, :, None] + (book**2).sum(1)
        step = step.reshape(n, -1)
        width = min(beam, step.shape[1])
        pick = np.argpartition(step, width - 1, axis=1)[:, :width]
        left = np.take_along_axis(step, pick, 1)
        before, word = pick // len(book), pick % len(book)
        rest = np.take_along_axis(rest, before[:, :, None], 1) - book[word]
        codes = np.concatenate([np.take_along_axis(codes, before[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
    return codes[np.arange(n), left.argmin(1)]


def _means(x: np.ndarray, group: np.ndarray, old: np.ndarray) -> np.ndarray:
    """The mean of each group of rows; groups without rows stay as they are."""
    order = np.argsort(group, kind="stable")
    counts = np.bincount(group, minlength=len(old))
    first = np.cumsum(counts) - counts
    some = counts > 0
    out = old.copy()
    out[some] = np.add.reduceat(x[order], first[some], axis=0) / counts[some][:, None]
    return out


def fit(x: np.ndarray, m: int = M, words: int = WORDS, sweeps: int = 3, seed: int = 0) -> np.ndarray:
    """The codebooks, of shape (m, words, dimension)."""
    r = np.random.default_rng(seed)
    words = max(1, min(words, len(x)))
    books, rest = [], x.astype(np.float32)
    nearest_word = lambda rest, book: ((book**2).sum(1) - 2 * rest @ book.T).argmin(1)
    for _ in range(m):
        book = rest[r.choice(len(rest), words, replace=False)]
        for _ in range(6):
            book = _means(rest, nearest_word(rest, book), book)
        rest = rest - book[nearest_word(rest, book)]
        books.append(book)
    out = np.stack(books).astype(np.float64)
    codes = np.concatenate([encode(x[i : i + 512], out) for i in range(0, len(x), 512)])
    rest = x - out[np.arange(m), codes].sum(1)
    for _ in range(sweeps):
        for k in range(m):
            target = rest + out[k][codes[:, k]]
            out[k] = _means(target, codes[:, k], out[k])
            rest = target - out[k][codes[:, k]]
    return out


@C.tidy
def _encode(books: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m, _, dim = books.shape
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            codes = encode(V.matrix(part.column("embedding"), dim), books)
            norms = (books[np.arange(m), codes].sum(1) ** 2).sum(1)
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(m), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())
            yield pa.record_batch([part.column("vec_id"), flat, pa.array(norms)], names=["vec_id", "codes", "norm"])


@C.tidy
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, V.CHUNK):
            part = batch.slice(lo, V.CHUNK)
            ids, codes = part.column("vec_id").to_numpy(), C.text_bytes(part.column("codes"))[0]
            cells = [np.ascontiguousarray(c).tobytes() for c in (ids, codes, part.column("norm").to_numpy())]
            yield pa.record_batch([pa.array([int(ids[0])]), *(pa.array([c], pa.binary()) for c in cells)], names=["chunk", "ids", "codes", "norms"])


class _Block:
    """A block of queries, its tables and its lists."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, books: np.ndarray, short: int):
        self.table = -2 * np.einsum("qd,mwd->mqw", q, books)
        self.lists = V.Lists(q_ids, short, np.inf)

    def add(self, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> None:
        n = self.table.shape[1]
        for lo in range(0, n, 64):  # a few queries at a time bound the memory
            rows = np.arange(lo, min(n, lo + 64))
            score = np.broadcast_to(norms, (len(rows), len(ids))).copy()
            for j, part in enumerate(self.table):
                score += part[rows][:, codes[:, j]]
            self.lists.add(rows, ids, score)

    def rows(self) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c) for c in self.lists.rows()], names=["query_id", "vec_id", "near"])


@C.tidy
def _shortlists(books: np.ndarray, short: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One list after the other; rows of one block that come apart make lists of their own, which the ranking merges."""
    m, _, dim = books.shape
    held, key = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            if key != (new := (row.column("block")[0].as_py(), row.column("part")[0].as_py())):
                if held:
                    yield held.rows()
                q = np.asarray(row.column("q_embedding")[0].values.flatten()).reshape(-1, dim)
                held, key = _Block(np.asarray(row.column("q_vec_id")[0].values), q, books, short), new
            ids, norms = (np.frombuffer(row.column(c)[0].as_buffer(), t) for c, t in (("ids", np.int64), ("norms", np.float64)))
            held.add(ids, np.frombuffer(row.column("codes")[0].as_buffer(), np.uint8).reshape(-1, m), norms)
    if held:
        yield held.rows()


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, queries, k: int = 10, short: int = SHORT) -> DataFrame:
    """The k nearest rows found of each query (a condition on vec_id): query_id, rank, vec_id, score (Euclidean distance)."""
    spark = vectors.sparkSession
    v, dim = V.valid_vectors(vectors, zeros=False)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = C.stage(v, "vectors")
    books = fit(V.sample(v, TRAINING, dim))
    coded = C.stage(v.mapInArrow(functools.partial(_encode, books), "vec_id long, codes binary, norm double"), "codes")
    n, asked = coded.agg(F.count("*"), F.count_if(queries)).first()
    n_chunks, n_blocks = -(-n // V.CHUNK), max(1, -(-asked // V.BLOCK))
    # as few lists a query as the table allows, but enough tasks for the cluster
    parts = max(-(-n_chunks // COVERED), min(n_chunks, -(-2 * spark.sparkContext.defaultParallelism // n_blocks)))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    chunks = coded.withColumn("part", part).repartition("part").sortWithinPartitions("part").drop("part").mapInArrow(_pack, "chunk long, ids binary, codes binary, norms binary")
    dealt = chunks.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    blocks = V.blocks_of(v.where(queries), n_blocks).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = dealt.join(blocks, ["block", "part"])
    listed = met.mapInArrow(functools.partial(_shortlists, books, short), "query_id long, vec_id long, near double")
    ranked = listed.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("near", "vec_id"))).where(F.col("place") <= short)
    pairs = ranked.select("query_id", "vec_id")
    q = v.where(queries).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    exact = pairs.join(v, "vec_id").join(q, "query_id").select("query_id", "vec_id", distance(F.col("q"), F.col("embedding")).alias("score"))
    return V.top(exact, k, ascending=True)
