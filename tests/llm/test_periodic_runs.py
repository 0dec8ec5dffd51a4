import hashlib
import random
import zlib

import pytest

from seriesforge.llm import periodic_runs as R
from seriesforge.llm import queries as Q


def brute(words, power=4, least=6):
    """Every period, place by place."""
    n, stretches = len(words), {}
    for p in range(1, n // power + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, power * p):
                stretches.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in stretches.items())


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def corpus(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        k = r.choice([1, 2, 3, 5, 50])
        words = [f"w{r.randrange(k)}é" for _ in range(r.choice([0, 1, 5, 6, 7, 30, 80, 200]))]
        if r.random() < 0.5 and words:
            a = r.randrange(len(words))
            p = 1 + r.randrange(max(1, (len(words) - a) // 3))
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
        out.append(words * r.choice([1, 1, 1, 3, 5]))
    return out


@pytest.mark.parametrize(("power", "least"), [(4, 6), (2, 2), (3, 10)])
def test_runs_like_brute_force(power, least):
    texts = corpus(400, power)
    assert R.runs_of([[w.encode() for w in t] for t in texts], power, least) == [brute(t, power, least) for t in texts]


def test_pairs_in_chunks_and_deceiving_hashes(monkeypatch):
    texts = [[w.encode() for w in t] for t in corpus(60, 9)]
    want = [brute(t) for t in texts]
    monkeypatch.setattr(R, "CHUNK", 7)
    assert R.runs_of(texts) == want
    monkeypatch.setattr(R, "hash", lambda w: 5, raising=False)  # all words look alike
    assert R.runs_of(texts) == want


def test_nulls_blanks_long_texts_repeats_and_clashing_names(spark):
    long = "ab cd " * 150_000 + "end"
    rows = [(1, None), (2, ""), (3, " \n\t\x0b "), (4, long), (5, "a\x0ca\ra a\na\ta"), (5, "a\x0ca\ra a\na\ta"), (None, "x x " * 6)]
    df = spark.createDataFrame([(i, t, 7, "r", "k") for i, t in rows], "doc_id long, text string, n_words int, runs string, collapsed string")
    got = {}
    for x in R.periodic_runs(df, carry=["runs"]).collect():
        got.setdefault(x.doc_id, []).append((x.n_words, [tuple(y) for y in x.runs], x.collapsed, x.row.runs))
    assert got[1] == got[2] == got[3] == [(0, [], "", "r")]
    assert got[4] == [(300_001, [(0, 300_000, 2)], "ab cd end", "r")]
    assert got[5] == [(6, [(0, 6, 1)], "a", "r")] * 2
    assert got[None] == [(6, [(0, 6, 1)], "x x", "r")]
    assert R.periodic_runs(df.limit(0)).count() == 0


def test_query_like_brute_force(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, " ".join(t) if r.random() < 0.5 else "\n" + "  ".join(t) + " ") for i, t in enumerate(corpus(300, 5))] + [(5000, None), (5001, ""), (None, "a a a a a a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    turned = 0
    got = {x.doc_id: x for x in Q.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        words = (text or "").split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            turned += 1
        runs = brute(words)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        x = got[i]
        assert (x.n_runs, x.start, x.length, x.period) == (len(runs), *best)
        assert x.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert x.runs_sha256 == sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)) and x.collapsed_sha256 == sha(collapsed(words, runs))
    assert turned > 15
