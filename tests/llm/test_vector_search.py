import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesforge.llm import ann, knn_join


def table(spark, x, ids=None, extra=()):
    ids = range(len(x)) if ids is None else ids
    rows = [(int(i), [float(c) for c in v], 1.5) for i, v in zip(ids, x, strict=True)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double").repartition(5)


def odd_rows():
    return [(None, [1.0] * 16, 0.0), (100, None, 0.0), (200, [float("nan")] + [1.0] * 15, 0.0), (300, [None] + [1.0] * 15, 0.0), (9990, [1.0, 2.0], 0.0), (9991, [float("inf")] * 16, 0.0), (400, [0.0] * 16, 0.0)]


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(6)
    centres = r.normal(size=(12, 16))
    x = (centres[r.integers(0, 12, 1500)] + 0.4 * r.normal(size=(1500, 16))).astype(np.float32)
    x[700:720] = x[700]  # ties
    return x, np.arange(1500) + 1000


def test_nearest_recall_and_exact_scores(spark, data):
    x, ids = data
    df = table(spark, x, ids, odd_rows() + [(1000, [float(c) for c in x[0]], 2.0)])
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == [i for i in ids.tolist() if i % 100 == 0]
    hits = total = 0
    for q, rows in got.items():
        d = np.sqrt(((x.astype(float) - x[q - 1000].astype(float)) ** 2).sum(1))
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11)) and q not in [r[1] for r in rows]
        assert all(abs(s - d[v - 1000]) < 1e-9 for _, v, s in rows)
        assert [(s, v) for _, v, s in rows] == sorted((s, v) for _, v, s in rows)
        want = [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hits += len(set(want) & {r[1] for r in rows})
        total += 10
    assert hits / total >= 0.95


@pytest.mark.parametrize("chunk", [4096, 50])
def test_shortlists_do_not_depend_on_chunks_or_partitions(spark, data, monkeypatch, chunk):
    x, ids = data
    want = sorted(map(tuple, ann.nearest(table(spark, x, ids).coalesce(1), F.col("vec_id") % 100 == 0, short=20).collect()))
    monkeypatch.setattr(ann.V, "CHUNK", chunk)
    monkeypatch.setattr(ann.V, "BLOCK", 4)
    monkeypatch.setattr(ann, "COVERED", 3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert sorted(map(tuple, ann.nearest(table(spark, x, ids), F.col("vec_id") % 100 == 0, short=20).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/embeddings.parquet"), reason="no test tables")
def test_recall_of_the_query(spark):
    """All queries of the whole table, with production parameters."""
    from seriesforge.llm.queries import QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas().dropna().drop_duplicates("vec_id")
    rows = rows[[bool(np.isfinite(e).all() and np.any(e)) for e in rows.embedding]]
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    got = {(r.query_id, r.vec_id) for r in QUERIES["op3_ann"](spark, "/root/testdata/sf0.1").collect()}
    hits = total = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        want = ids[np.lexsort((ids, d))[:10]]
        hits += sum((ids[i], w) in got for w in want)
        total += len(want)
    assert hits / total >= 0.95


def test_few_and_no_vectors(spark, data):
    x, _ = data
    assert {(r.query_id, r.vec_id) for r in ann.nearest(table(spark, x[:3]), F.col("vec_id") % 100 == 0).collect()} == {(0, 1), (0, 2)}
    assert ann.nearest(table(spark, x[:0], [], odd_rows()[:2]), F.col("vec_id") % 100 == 0).count() == 0
    assert knn_join.top_inner_products(table(spark, x[:3]), F.col("vec_id") % 50 == 0).count() == 2
    assert knn_join.top_inner_products(table(spark, x[:0], []).where("false"), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("chunk,block", [(4096, 512), (64, 3)])
def test_inner_products_are_exact(spark, data, monkeypatch, chunk, block):
    monkeypatch.setattr(knn_join.V, "CHUNK", chunk)
    monkeypatch.setattr(knn_join.V, "BLOCK", block)
    x, ids = data
    got = sorted(map(tuple, knn_join.top_inner_products(table(spark, x, ids, odd_rows()), F.col("vec_id") % 50 == 0).collect()))
    v = {int(i): np.floor(256 * r.astype(float)).astype(np.int64) for i, r in zip(ids, x, strict=True)} | {400: np.zeros(16, np.int64)}
    want = []
    for q in v:
        if q % 50 == 0:
            rows = sorted((-int(v[q] @ y), i) for i, y in v.items() if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(rows)]
    assert got == sorted(want)


def best(x, ids):
    """query_id, rank, vec_id and score by all inner products, of rows of which the least vector of an id counts."""
    v = {}
    for i, r in sorted(zip(ids, x.tolist(), strict=True), reverse=True):
        v[int(i)] = np.floor(256 * np.array(r)).astype(np.int64)
    want = []
    for q in v:
        if q % 50 == 0:
            rows = sorted((-int(v[q] @ y), i) for i, y in v.items() if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(rows)]
    return sorted(want)


@pytest.mark.parametrize("rows", [1, 7, 400])
def test_bundles_and_parts_that_meet_do_not_change_the_best(spark, data, monkeypatch, rows):
    """One vector takes a third of the table, so one cell and one group fill many parts and bundles; some rows come twice."""
    x, ids = data[0][:600].copy(), data[1][:600].copy()
    x[::3] = x[1]
    ids[-20:] = ids[:20]
    monkeypatch.setattr(knn_join, "MEET", 8 * 16 * rows)
    monkeypatch.setattr(knn_join.V, "BLOCK", 2)
    got = sorted(map(tuple, knn_join.top_inner_products(table(spark, x, ids), F.col("vec_id") % 50 == 0).collect()))
    assert got == best(x, ids)


def test_rows_that_gain_nothing_reach_no_list(monkeypatch):
    x = np.floor(256 * np.random.default_rng(5).normal(size=(500, 8)))
    scores = x[:3] @ x.T
    scores[np.arange(3), np.arange(3)] = -np.inf
    floor = np.sort(scores, axis=1)[:, -4]  # better than the two best need, so four rows a query pass, its own aside
    lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, 8, dtype=np.int32)), pa.array(m.ravel()))
    whole = lambda a: pa.ListArray.from_arrays(pa.array([0, 3], pa.int32()), a)
    asked = pa.table({"q_vec_id": whole(pa.array(np.arange(3))), "q_embedding": whole(lists(x[:3])), "q_kth": whole(pa.array(floor))})
    rows = pa.table({"cell": pa.array(np.arange(500) % 2, pa.int32()), "vec_id": pa.array(np.arange(500)), "embedding": lists(x)})
    seen, add = [], knn_join.V.Lists.add
    monkeypatch.setattr(knn_join.V.Lists, "add", lambda self, rows, ids, scores: seen.append(len(ids)) or add(self, rows, ids, scores))
    found = pa.Table.from_batches(knn_join._solve(2, x[:2], np.array([1e9, 1e9]), asked, rows)).to_pydict()
    want = {(i, int(j), int(scores[i, j])) for i in range(3) for j in np.argsort(-scores[i])[:2]}
    assert set(zip(*found.values(), strict=True)) == want and sum(seen) <= 3 * (4 + 1)


def shuffled(df):
    """Bytes of rows in the shuffles of the plan that ran."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        elif name != "ReusedExchange":
            children = p.children()
            todo += [children.apply(i) for i in range(children.size())]
            if name == "Exchange":
                total += p.metrics().apply("dataSize").value()
    return total


def test_vectors_are_sent_once_to_queries_that_fit_a_bundle(spark):
    """No cell can be left out here, so each meets the queries of every group."""
    x = np.random.default_rng(3).normal(size=(4000, 64))
    df = knn_join.top_inner_products(table(spark, x), F.col("vec_id") % 50 == 0)
    assert len(df.collect()) == 400
    assert shuffled(df) < 2 * 8 * x.size


def test_sums_beyond_doubles_are_integers():
    a, b = np.array([[2.0**27, 1.0]]), np.array([[2.0**27, 1.0]])
    assert knn_join._inner(a, b)[0, 0] == 2**54 + 1


def test_beam_search_beats_greedy_and_fits(data):
    x = data[0].astype(float)
    books = ann.fit(x, m=4, words=32)
    err = [((x - books[np.arange(4), ann.encode(x, books, beam)].sum(1)) ** 2).sum() for beam in (1, 8)]
    assert err[1] <= err[0] < ((x - x.mean(0)) ** 2).sum()
