import random
import re
import zlib
from collections import Counter

import pytest

from seriesforge.llm import queries as Q
from seriesforge.llm import spelling_variants as S


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if one_apart(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = [form, None, n, len(near), counts[form] if form else None]
    for w in out:
        r = w
        while out[r][0]:
            r = out[r][0]
        out[w][1] = r
    return {w: tuple(v) for w, v in out.items()}


def rows(df):
    found = df.collect()
    assert len({x.word for x in found}) == len(found)
    return {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in found}


def vocabulary(seed, size=250):
    """Words with many near ones, frequencies from 1 to 10000, and families that share a half."""
    r = random.Random(seed)
    stems = ["".join(r.choice("abé") for _ in range(r.choice([6, 7, 8, 9, 12]))) for _ in range(size // 8)] + ["aaaaaaa", "aaaaaaaa", "ababababab", "commonx", "commonyz"]
    words = set(stems)
    while len(words) < size:
        w = list(r.choice(stems))
        for _ in range(r.choice([1, 1, 2])):
            p, c = r.randrange(len(w)), r.choice("abéxyz")
            w[p : p + r.choice([0, 1])] = r.choice([[], [c], [c]])
        if len(w) >= 7:
            words.add("".join(w))
    return {w: r.choice([1, 2, 3, 20, 25, 300, 10_000]) for w in sorted(words) if len(w) >= 7}


@pytest.mark.parametrize(("limit", "shard"), [(20_000, 20_000), (6, 40), (2, 10)])
def test_near_words_like_brute_force(spark, limit, shard):
    counts = vocabulary(limit)
    want = {w: v for w, v in brute(counts).items() if v[3]}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {x.word: (x.n_near, x.best, x.best_n) for x in S.near_words(df, limit, shard).collect()}
    assert set(got) == set(want) and len(want) > 100
    for w, (near, best, n) in got.items():
        assert near == want[w][3] and n == counts[best]
        assert best == min((x for x in counts if one_apart(w, x)), key=lambda x: (-counts[x], x))


def test_a_half_that_all_words_share(spark):
    """Every word starts alike: one half holds them all and is cut until groups are small."""
    r = random.Random(8)
    counts = {"prefixprefix" + "".join(r.choice("ab") for _ in range(r.choice([5, 6, 7]))): r.choice([2, 30, 500]) for _ in range(150)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {x.word: x.n_near for x in S.near_words(df, 8, 30).collect()}
    assert got == {w: v[3] for w, v in brute(counts).items() if v[3]}


def test_chains_end_at_their_roots(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(17)] + [("x", "w3"), ("y", "z")]
    got = {x.word: x.root for x in S.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {w: "z" if w == "y" else "w17" for w, _ in links}


def planted(rows, slips=31):
    counts = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % slips == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def test_query_like_brute_force(spark, tmp_path):
    r = random.Random(5)
    vocab = list(vocabulary(11, 120)) + ["short", "ÀÉÎabcd", "ABCDEFG", "mixedÜber"]
    weights = [r.choice([1, 3, 60, 400]) for _ in vocab]
    docs = [(i, r.choice([" ", "\n", "-", "1", "—"]).join(r.choices(vocab, weights, k=r.choice([0, 5, 120])))) for i in range(120)]
    docs += [(500, None), (501, ""), (None, "commonxy commonxy"), (7, "commonxy repeated repeated"), (7, "commonxy repeated")]
    spark.createDataFrame([(i, t, 1, "f") for i, t in docs], "doc_id long, text string, n int, form string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(Q.op11_spelling_variants(spark, str(tmp_path)))
    want = brute(planted(docs))
    assert got == want
    assert any(v[0] for v in want.values())


def test_long_texts_flushes_and_empty_tables(spark, monkeypatch):
    docs = [(1, "Abcdefgh. " * 3000 + "ABCDEFGHÏ" * 300), (2, "Zabcdefg zabcdefg")]
    want = planted(docs)
    monkeypatch.setattr(S, "PART", 25)
    monkeypatch.setattr(S, "HELD", 1)
    import pyarrow as pa

    batch = pa.record_batch([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], names=["doc_id", "text"])
    counts = Counter()
    for part in S._count(7, 31, iter([batch])):
        for w, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
            counts[w] += n
    assert {w: n for w, n in counts.items() if n >= 2} == want
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.spelling_variants(none).count() == 0
