"""Exact top-k by inner product: a Voronoi join.

Vectors are integer, floor(scale * x). A bounded set of them, in hash order,
are pivots; every vector belongs to the cell of its nearest pivot, and so does
every query. Summaries of a cell: its count and radius; of a group of queries
(those in one cell): its radius, and the least, over its queries, of the k-th
best score that the query reaches among the pivots alone. As pivots are
candidates themselves, that is a lower bound of what the group needs.

For a query q = a + u in the group of pivot a and a vector x = c + v in the
cell of pivot c, q.x = a.c + a.v + u.c + u.v, at most a.c + |a| r_c + s_a |c| +
s_a r_c with the cell's radius r_c and the group's s_a. Only cells that reach
the group's bound meet it.

Groups, in blocks of queries, are put in bundles, one after the other, and the
rows of the cells in parts; a bundle or a part has MEET bytes of vectors. A row
goes once to each bundle that has a group which its cell may serve, a block once
to each part that has rows of such a cell, and there a cell's rows are scored
for those queries that can gain from them; a ranking keeps k.

Summaries and bounds are a few numbers for each of at most PIVOTS cells; only
these reach the driver. Sums that could pass 2**53 are taken in 64-bit integers.

What takes no part and how repeated ids count is said in vectors.valid_vectors;
here zero vectors do take part.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import vectors as V

#: At most so many cells; the driver holds a few numbers for each pair of them.
PIVOTS = 1024
#: Bytes of vectors in a part, and in a bundle of queries, about: what of either side a task holds at once.
MEET = 8 << 20


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows."""
    if len(a) and len(b) and np.sqrt((a**2).sum(1).max() * (b**2).sum(1).max()) < 2**53:
        return a @ b.T
    return a.astype(np.int64) @ b.astype(np.int64).T


@C.tidy
def _cells(scale: int, k: int, pivots: np.ndarray, pivot_ids: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    norms = (pivots**2).sum(1)
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.floor(scale * V.matrix(batch.column("embedding"), pivots.shape[1]))
        ids = batch.column("vec_id").to_numpy()
        scores = x @ pivots.T
        cell = (norms - 2 * scores).argmin(1)
        radius = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
        scores[ids[:, None] == pivot_ids[None, :]] = -np.inf
        kth = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(x), -np.inf)
        flat = pa.array(x.ravel())
        yield pa.record_batch([batch.column("vec_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat), pa.array(cell.astype(np.int32)), pa.array(radius), pa.array(kth)], names=["vec_id", "embedding", "cell", "radius", "kth"])


@C.tidy
def _solve(k: int, pivots: np.ndarray, radius: np.ndarray, asked: pa.Table, rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The k best rows of a part for each query of a bundle; those of a cell raise what further cells must reach."""
    if not asked.num_rows or not rows.num_rows:
        return
    dim = pivots.shape[1]
    q = V.matrix(asked.column("q_embedding").combine_chunks().flatten(), dim)
    length = np.sqrt((q**2).sum(1))
    floor = asked.column("q_kth").combine_chunks().flatten().to_numpy()
    need = floor.copy()
    held = V.Lists(asked.column("q_vec_id").combine_chunks().flatten().to_numpy(), k, np.iinfo(np.int64).max)
    cell = rows.column("cell").to_numpy()
    order = np.argsort(cell, kind="stable")
    cell, ids, x = cell[order], rows.column("vec_id").to_numpy()[order], V.matrix(rows.column("embedding").combine_chunks(), dim)[order]
    for c in np.unique(cell):
        begin, end = np.searchsorted(cell, [c, c + 1])
        for lo in range(begin, end, V.CHUNK):
            hi = min(end, lo + V.CHUNK)
            open_ = np.flatnonzero((q @ pivots[c] + length * radius[c]) * (1 + 1e-9) + 1 >= need)
            for at in range(0, len(open_), 128):
                some = open_[at : at + 128]
                scores = _inner(q[some], x[lo:hi])
                gains = np.flatnonzero((scores >= need[some][:, None]).any(0))
                if len(gains):
                    held.add(some, ids[lo:hi][gains], -scores[:, gains].astype(np.int64))
            full = held.scores[:, -1] != held.worst
            need = np.where(full, np.maximum(need, -held.scores[:, -1].astype(float)), need)
    cols = held.rows(-held.scores >= floor[:, None])  # less than the pivots alone reach is never needed
    yield pa.record_batch([pa.array(cols[0]), pa.array(cols[1]), pa.array(-cols[2])], names=["query_id", "vec_id", "score"])


def _runs(open_: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """The numbers from first to last of what is open, as runs of (lo, hi) that share none; first and last never fall."""
    at = np.flatnonzero(open_)
    lo, hi = first[at], last[at]
    new = np.concatenate([[True], lo[1:] > hi[:-1] + 1])
    return list(zip(lo[new].tolist(), hi[np.append(new[1:], True)].tolist(), strict=True))


def _each(runs: str) -> Column:
    """A row for each number of the runs."""
    return F.explode(F.flatten(F.transform(runs, lambda r: F.sequence(r["lo"], r["hi"]))))


def top_inner_products(vectors: DataFrame, queries, k: int = 5, scale: int = 256) -> DataFrame:
    """The k highest scores of each query (a condition on vec_id): query_id, rank, vec_id, score (inner product of floor(scale * x))."""
    spark = vectors.sparkSession
    v, dim = V.valid_vectors(vectors, zeros=True)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    v = C.stage(v, "vectors")
    total = v.count()
    n = max(k + 1, min(PIVOTS, int(total**0.5) // 4))
    rows = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).toArrow().combine_chunks()
    pivot_ids, pivots = rows.column("vec_id").to_numpy(), np.floor(scale * V.matrix(rows.column("embedding").combine_chunks(), dim))
    placed = C.stage(v.mapInArrow(functools.partial(_cells, scale, k, pivots, pivot_ids), "vec_id long, embedding array<double>, cell int, radius double, kth double"), "placed")
    is_query = F.when(queries, True).otherwise(False)
    summary = placed.groupBy("cell", is_query.alias("q")).agg(F.count("*").alias("n"), F.max("radius").alias("radius"), F.min("kth").alias("kth")).collect()
    count, n_asked = np.zeros(len(pivots), np.int64), np.zeros(len(pivots), np.int64)
    radius, spread, bound = np.zeros(len(pivots)), np.full(len(pivots), -1.0), np.zeros(len(pivots))
    for r in summary:
        count[r["cell"]] += r["n"]
        radius[r["cell"]] = max(radius[r["cell"]], r["radius"])
        if r["q"]:
            n_asked[r["cell"]], spread[r["cell"]], bound[r["cell"]] = r["n"], r["radius"], r["kth"]
    size = np.sqrt((pivots**2).sum(1))
    reach = pivots @ pivots.T + np.outer(size, radius) + spread[:, None] * (size + radius)[None, :]
    open_ = (spread >= 0)[:, None] & (count > 0)[None, :] & (reach + 1 >= bound[:, None])

    # rows are numbered along the cells, queries along the groups; of each group (at most PIVOTS) the parts it needs, of each cell the bundles that need it
    held = max(1, MEET // (8 * dim))
    blocks, row, query = -(-n_asked // V.BLOCK), np.cumsum(count) - count, np.cumsum(n_asked) - n_asked
    last_block = (blocks - 1) * n_asked // np.maximum(blocks, 1)
    parts, bundles = (row // held, (row + count - 1) // held), (query // held, (query + last_block) // held)
    groups = [(g, int(query[g]), int(n_asked[g]), int(blocks[g]), _runs(open_[g], *parts)) for g in np.flatnonzero(open_.any(1)).tolist()]
    groups = F.broadcast(spark.createDataFrame(groups, "grp int, first long, n long, blocks int, parts array<struct<lo long, hi long>>"))
    cells = [(c, int(row[c]), int(count[c]), _runs(open_[:, c], *bundles)) for c in np.flatnonzero(open_.any(0)).tolist()]
    cells = F.broadcast(spark.createDataFrame(cells, "cell int, first long, n long, bundles array<struct<lo long, hi long>>"))

    asked = placed.where(queries).withColumnRenamed("cell", "grp").join(groups, "grp")
    asked = V.blocks_of(asked, "blocks", ("grp",), ("kth",)).join(groups, "grp")
    asked = asked.select(F.expr(f"(first + block * n div blocks) div {held}").alias("bundle"), _each("parts").alias("part"), "q_vec_id", "q_embedding", "q_kth")
    rows = placed.join(cells, "cell").withColumn("part", F.expr(f"(first + pmod(xxhash64(vec_id), n)) div {held}"))
    rows = rows.select(_each("bundles").alias("bundle"), "part", "cell", "vec_id", "embedding")
    found = pa.schema([(c, pa.int64()) for c in ("query_id", "vec_id", "score")])
    solve = lambda asked, rows: pa.Table.from_batches(_solve(k, pivots, radius, asked, rows), found)
    met = asked.groupBy("bundle", "part").cogroup(rows.groupBy("bundle", "part")).applyInArrow(solve, "query_id long, vec_id long, score long")
    return V.top(met, k, ascending=False)
