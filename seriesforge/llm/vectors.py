"""What the two vector searches share: valid vectors, packed chunks and blocks of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a packed chunk, and queries in a block.
CHUNK, BLOCK = 4096, 512


def valid_vectors(df: DataFrame, zeros: bool) -> tuple[DataFrame, int]:
    """vec_id long and embedding array<double> of the rows that take part, one for each vec_id, and their dimension.

    Rows with a null id or vector, or with a null or non-finite component, take
    no part, nor do zero vectors unless `zeros`, nor vectors of another
    dimension than most have (of two equally frequent ones, the smaller). Of
    rows that share a vec_id the least vector counts.
    """
    v = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(finite)
    if not zeros:
        v = v.where(F.exists("embedding", lambda x: x != 0))
    common = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return v, 0
    return v.where(F.size("embedding") == common["d"]).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), common["d"]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def sample(v: DataFrame, n: int, dim: int) -> np.ndarray:
    """n vectors in the order of a hash of their ids, for the driver; n bounds them."""
    rows = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select("embedding").toArrow()
    return matrix(rows.column(0).combine_chunks(), dim) if rows.num_rows else np.zeros((0, dim))


def blocks_of(queries: DataFrame, parts: str | int, keys: tuple[str, ...] = (), lists: tuple[str, ...] = ()) -> DataFrame:
    """Queries in `parts` rows (for each value of keys): `block`, and lists of ids, vectors and what `lists` names."""
    parts = F.col(parts) if isinstance(parts, str) else F.lit(parts)
    gathered = [F.collect_list(c).alias(f"q_{c}") for c in ("vec_id", "embedding", *lists)]
    return queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), parts).cast("int")).groupBy(*keys, "block").agg(*gathered)


def top(rows: DataFrame, k: int, ascending: bool) -> DataFrame:
    order = F.col("score") if ascending else F.desc("score")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


class Lists:
    """The k least scores of each query of a block, ties to the smaller id, over the rows seen so far; a query's own row doesn't count."""

    def __init__(self, q_ids: np.ndarray, k: int, worst):
        self.q_ids, self.k, self.worst = q_ids, k, worst
        self.ids = np.full((len(q_ids), k), np.iinfo(np.int64).max)
        self.scores = np.full((len(q_ids), k), worst)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: of these queries (places in the block) with these ids."""
        scores[self.q_ids[rows, None] == ids[None, :]] = self.worst
        every = np.concatenate([self.scores[rows], scores], 1)
        edge = np.partition(every, self.k - 1, axis=1)[:, self.k - 1 : self.k]
        q, col = np.nonzero(every <= edge)
        value = every[q, col]
        own = col < self.k
        found = np.where(own, self.ids[rows[q], np.minimum(col, self.k - 1)], ids[np.maximum(col - self.k, 0)])
        order = np.lexsort((found, value, q))
        q, found, value = q[order], found[order], value[order]
        keep = np.arange(len(q)) - np.searchsorted(q, np.arange(len(rows)))[q] < self.k
        self.ids[rows], self.scores[rows] = found[keep].reshape(-1, self.k), value[keep].reshape(-1, self.k)

    def rows(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query, id and score of what was found, and of that only where keep is true."""
        some = self.scores != self.worst
        some = some if keep is None else some & keep
        return np.broadcast_to(self.q_ids[:, None], some.shape)[some], self.ids[some], self.scores[some]
