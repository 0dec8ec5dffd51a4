import random
import re

import numpy as np
import pytest

from seriesforge.llm import common as C
from seriesforge.llm import near_dedup as N


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def brute(rows, n):
    sets = {d: shingles(t, n) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["The", "of", "É", "and"]
    rows, i = [], 0
    for size in [1, 2, 3, 4, 5, 6, 8, 12, 30, 50, 60, 70, 80, 90, 120, 300, 700]:
        for _ in range(3):
            base = [r.choice(vocab) for _ in range(size)]
            for _ in range(r.randint(1, 12)):
                words = list(base)
                for _ in range(r.randint(0, max(1, size // 14))):
                    words[r.randrange(size)] = r.choice(vocab)
                rows.append((i, r.choice([" ", "\n", "\t "]).join(words)))
                i += r.randint(1, 3)
    return rows + [(i + 1, ""), (i + 2, None), (i + 3, " \n")]


@pytest.mark.parametrize("seed,n", [(1, 2), (2, 5)])
def test_against_brute_force(spark, seed, n):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, n).collect()}
    assert got == brute(rows, n)


@pytest.mark.parametrize("block", [256, 7])
def test_large_group_of_near_copies_and_a_chain(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    r = random.Random(8)
    base = [f"v{r.randint(0, 5000)}" for _ in range(200)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(r.randint(0, 14)):
            words[r.randrange(200)] = f"u{r.randint(0, 9999)}"
        rows.append((1000 - i, " ".join(words)))
    words = [f"c{i}" for i in range(200)]
    for i in range(25):  # each link of the chain is similar to the next alone
        rows.append((2000 + i, " ".join(words)))
        words = words[15:] + [f"d{i}_{j}" for j in range(15)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 2).collect()}
    want = brute(rows, 2)
    assert got == want and len({c for d, (_, c) in want.items() if d >= 2000}) == 1


def test_nulls_repeats_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(None, "a b c", 1), (None, "a b c", 2), (7, "a b c", 3), (7, "a b c", 3), (9, "A  B\tC", 4), (10, None, 5)], "doc_id long, text string, component_id int")
    got = sorted(map(tuple, N.near_duplicates(df, 2).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (None, 2, None, True), (7, 2, 7, True), (7, 2, 7, True), (9, 2, 7, False), (10, 0, 10, True)], key=str)
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_estimate_is_close():
    r = np.random.default_rng(3)
    common, own = r.integers(0, 2**63, 900, dtype=np.uint64), r.integers(0, 2**63, 200, dtype=np.uint64)
    a, b = np.sort(np.concatenate([common, own[:100]])), np.sort(np.concatenate([common, own[100:]]))
    x, y = (N.large_registers(np.zeros(len(s), np.int64), s, 1) for s in (a, b))
    assert abs(N.similarity(x, y, np.array([1000.0]), np.array([1000.0]))[0] - 900 / 1100) < 0.1
    assert N.compress(np.array([0, 1 << 63, (1 << 64) - 1], np.uint64)).tolist() == [53 << 10, 0, 1023]
    assert C.mix(np.array([1], np.uint64)).dtype == np.uint64


def test_no_join_sends_rows_through_the_driver(spark):
    """Many texts that share one line alone: they meet in buckets, are no copies, and each is dealt out to many blocks."""
    r = random.Random(4)
    line = " ".join(f"common{i}" for i in range(12))
    rows = [(i, f"{line}\n" + " ".join(f"w{r.randint(0, 10**6)}" for _ in range(14))) for i in range(300)]
    rows += [(1000 + i, f"{text} more") for i, (_, text) in enumerate(rows[:40])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in N.near_duplicates(df, 2).collect()}
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = store.executionsList(before, 1000)
    plans = [ran.apply(i).physicalPlanDescription() for i in range(ran.size())]
    assert got == brute(rows, 2) and len({c for _, c in got.values()}) == 300
    assert len(plans) > 10 and any("SortMergeJoin" in x for x in plans) and not [x for x in plans if "BroadcastExchange" in x]
