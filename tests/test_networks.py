import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesforge.operators import correlation as CO
from seriesforge.operators import linkage
from seriesforge.sources.staging import Stages


def table_of(spark, series):
    """series: entity to a dict of day numbers and values."""
    rows = [(e, i, v) for e, days in series.items() for i, v in days.items()]
    df = spark.createDataFrame(rows, "entity string, i int, value double")
    return df.select("entity", F.date_add(F.to_date(F.lit("2020-01-01")), F.col("i")).alias("ts"), "value").repartition(3)


def best_lag(x, y, max_lag, least, common):
    days = sorted(set(x) & set(y))
    if len(days) < common:
        return None
    a, b = (np.array([z[i] for i in days]) for z in (x, y))
    out = []
    for lag in range(-max_lag, max_lag + 1):
        n = len(a) - abs(lag)
        if n >= least:
            p, q = a[max(0, -lag) : max(0, -lag) + n], b[max(0, lag) : max(0, lag) + n]
            r = 0.0 if p.std() < 1e-9 or q.std() < 1e-9 else float(np.corrcoef(p, q)[0, 1])
            out.append((-round(abs(r), 10), lag, n, r))
    return min(out)[1:]


@pytest.mark.parametrize("block", [3, 100])
def test_lags_like_pair_by_pair(spark, block):
    """Series of different spans, with holes, missing values, one without variance and one too short."""
    r = np.random.default_rng(2)
    base = r.normal(size=90)
    series = {f"e{k}": {i: float(base[(i + k) % 90] + r.normal() * 0.5) for i in range(5 * (k % 3), 90 - 4 * (k % 2)) if r.random() > 0.1 * (k % 2)} for k in range(7)}
    series |= {"flat": dict.fromkeys(range(90), 4.0), "short": {i: float(i) for i in range(12)}, "twin": dict(series["e0"])}
    df = table_of(spark, series | {"e1": series["e1"]}).unionByName(table_of(spark, {"e2": {200: float("nan")}}))
    got = {(x.a, x.b): (x.lag, x.n, x.r) for x in CO.lagged(df, 8, 20, 30, block).collect()}
    want = {(a, b): best_lag(series[a], series[b], 8, 20, 30) for a, b in itertools.combinations(sorted(series), 2)}
    want = {k: v for k, v in want.items() if v}
    assert set(got) == set(want)
    for k, (lag, n, x) in got.items():
        assert (lag, n) == want[k][:2] and math.isclose(x, want[k][2], abs_tol=1e-9), k
    edges = {(x.a, x.b): x.r for x in CO.edges(df, 30, block).collect()}
    assert set(edges) == set(want) and edges[("e0", "flat")] is None and edges[("e0", "twin")] == pytest.approx(1)
    assert "generate explode(sequence(-8" not in CO.lagged(df, 8, 20, 30, block)._jdf.queryExecution().toString().lower()


def test_parts_of_chains_and_rings(spark):
    links = [(i, i + 1) for i in range(9)] + [(20, 21), (21, 22), (22, 20), (30, 31), (5, 5)]
    got = {x.entity: x.part for x in linkage.parts(spark.createDataFrame(links, "a int, b int"), Stages(spark)).collect()}
    assert got == {**dict.fromkeys(range(10), 0), 20: 20, 21: 20, 22: 20, 30: 30, 31: 30}


@pytest.mark.parametrize("cut", [0.35, 0.6, 0.95])
def test_ward_by_rounds_like_one_merge_at_a_time(spark, cut):
    r = np.random.default_rng(int(cut * 100))
    n = 24
    x = r.normal(size=(n, 3)) + 3 * r.integers(0, 3, (n, 1))
    d = np.abs(x[:, None] - x[None]).sum(2)
    d = d / d.max()
    rows = [(f"n{i:02d}", f"n{j:02d}", float(d[i, j])) for i, j in itertools.combinations(range(n), 2)]
    got = {x.entity: x.cluster for x in linkage.ward(spark.createDataFrame(rows, "a string, b string, d double"), cut, Stages(spark)).collect()}
    label = CO._ward(d, cut)
    want = {}
    for k in np.unique(label):
        members = [f"n{i:02d}" for i in np.flatnonzero(label == k)]
        if len(members) > 1:
            want |= dict.fromkeys(members, members[0])
    assert got == want


def test_ward_with_ties_and_missing_pairs(spark):
    rows = [("a", "b", 0.1), ("c", "d", 0.1), ("e", "f", 0.1), ("b", "c", 0.2), ("x", "y", 0.9)]
    stages = Stages(spark)
    df = spark.createDataFrame(rows, "a string, b string, d double")
    assert {x.entity: x.cluster for x in linkage.ward(df, 0.3, stages).collect()} == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e", "f": "e"}
    assert linkage.ward(df, 0.05, stages).count() == 0
    stages.clear()


def test_means_within_clusters(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("a", "c", None), ("b", "c", 0.3), ("a", "z", 1.0)], "a string, b string, r double")
    labels = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("z", 2)], "entity string, cluster int")
    got = {x.cluster: (x.size, x.avg_correlation) for x in CO.cluster_means(edges, labels).collect()}
    assert got[1] == (3, pytest.approx(0.4)) and got[2][0] == 1


def hops_of(links):
    """part to (nodes, mean hops), by searches from every node."""
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for s in near:
        far, edge = {s: 0}, [s]
        while edge:
            edge = [y for x in edge for y in near[x] if y not in far and not far.update({y: far[x] + 1})]
        out.setdefault(min(far), []).append((len(far), sum(far.values()), len(far) - 1))
    return {p: (v[0][0], sum(x[1] for x in v) / sum(x[2] for x in v)) for p, v in out.items()}


def test_paths_exactly_and_by_sketches(spark):
    r = np.random.default_rng(1)
    links = {(int(min(a, b)), int(max(a, b))) for a, b in r.integers(0, 260, (420, 2)) if a != b} | {(1000 + i, 1001 + i) for i in range(7)}
    net = spark.createDataFrame(sorted(links), "a int, b int")
    want = hops_of(links)
    exact = {x.part: (x.nodes, x.mean_hops, x.exact) for x in CO.part_paths(net, Stages(spark)).collect()}
    assert set(exact) == set(want)
    for p, (n, mean, sure) in exact.items():
        assert n == want[p][0] and mean == pytest.approx(want[p][1]) and sure
    rough = {x.part: (x.nodes, x.mean_hops, x.exact) for x in CO.part_paths(net, Stages(spark), small=10).collect()}
    large = max(want, key=lambda p: want[p][0])
    assert not rough[large][2] and rough[large][1] == pytest.approx(want[large][1], rel=0.05)
    assert rough[1000][1:] == (pytest.approx(3.0), True)


def test_centrality_converges(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    links = [("a", "b", 1.0), ("b", "c", 0.5), ("c", "d", 1.0), ("b", "d", 0.2), ("d", "e", 2.0)]
    got = {x.entity: x.centrality for x in CO.eigenvector_centrality(spark.createDataFrame(links, "a string, b string, weight double"), tolerance=1e-9).collect()}
    names = sorted(got)
    w = pd.DataFrame(0.0, names, names)
    for a, b, x in links:
        w.loc[a, b] = w.loc[b, a] = x
    values, vectors = np.linalg.eigh(w.to_numpy())
    top = np.abs(vectors[:, values.argmax()])
    assert [got[n] for n in names] == pytest.approx(top.tolist(), abs=1e-6)
