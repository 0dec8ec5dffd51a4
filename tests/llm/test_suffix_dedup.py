import hashlib
import random

import pytest
from pyspark.sql import Row

from seriesforge.llm import suffix_dedup as S


def brute(docs, length):
    """docs: {doc_id: bytes}; of each, a flag for each byte that goes."""
    seen, gone = set(), {}
    for doc in sorted(docs):
        text = docs[doc]
        flags = [False] * len(text)
        for i in range(len(text) - length + 1):
            w = text[i : i + length]
            if w in seen:
                flags[i : i + length] = [True] * length
            seen.add(w)
        gone[doc] = flags
    return gone


def test_ranks_are_those_of_sorted_suffixes():
    import numpy as np

    r = np.random.default_rng(3)
    for length in (1, 2, 3, 7, 8, 13, 16, 37):
        data = r.integers(97, 99, 300).astype(np.uint8)
        raw = data.tobytes()
        cut = [raw[i : i + length] for i in range(len(raw) - length + 1)]
        order = {w: i for i, w in enumerate(sorted(set(cut)))}
        got = S.suffix_ranks(data, length)[: len(cut)]
        assert [order[w] for w in cut] == np.unique(got, return_inverse=True)[1].tolist()


def test_what_a_task_has_seen(monkeypatch):
    import numpy as np

    monkeypatch.setattr(S, "SEEN", 40)
    seen, first, r = S._Seen(), {}, np.random.default_rng(1)
    for _ in range(60):
        keys = np.unique(r.integers(0, 30, 12).astype(np.uint64))
        doc, lo = r.integers(0, 50, len(keys)), r.integers(0, 9, len(keys))
        got = seen.earlier(keys, doc, lo)
        for k, d, x, g in zip(keys.tolist(), doc.tolist(), lo.tolist(), got.tolist(), strict=True):
            assert not g or first[k] < (d, x)
            assert g == (first.get(k, (d, x)) < (d, x))  # fewer keys than it remembers
            first[k] = min(first.get(k, (d, x)), (d, x))


def test_one_long_text(spark):
    """Ten megabytes in one document, of which the last half repeats the first."""
    half = " ".join(str(i * 7919) for i in range(600_000))
    got = S.suffix_dedup(spark.createDataFrame([(1, half + "|" + half)], "doc_id long, text string")).first()
    assert bytes(got.kept) == (half + "|").encode() and len(got.removed) == 1


def texts(seed, n=60):
    r = random.Random(seed)
    words = ["the", "of", "wá", "x", "stone", "river", "ö", "quick", "amber", "zz"]
    passages = [" ".join(r.choice(words) for _ in range(r.randint(5, 90))) for _ in range(8)]
    out = {}
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            parts.append(r.choice(passages) if r.random() < 0.5 else " ".join(r.choice(words) + str(r.randint(0, 999)) for _ in range(r.randint(1, 60))))
        out[i * 3] = " ".join(parts)
    out[1] = "a" * 700
    out[4] = "ab" * 400
    out[7] = "a" * 99
    out[10] = ""
    out[13] = "x\0" * 150
    return out


@pytest.mark.parametrize("seed,group,seen", [(1, 20_000, 1 << 19), (2, 3, 64), (3, 20_000, 64), (4, 1, 1 << 19)])
def test_against_brute_force(spark, monkeypatch, seed, group, seen):
    monkeypatch.setattr(S, "GROUP", group)
    monkeypatch.setattr(S, "SEEN", seen)
    docs = texts(seed)
    rows = list(docs.items())
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in S.suffix_dedup(df).collect()}
    want = brute({k: v.encode() for k, v in docs.items()}, 100)
    for doc, flags in want.items():
        raw = docs[doc].encode()
        kept = bytes(b for b, f in zip(raw, flags, strict=True) if not f)
        assert bytes(got[doc].kept) == kept, doc
        runs = sum(f and not (i and flags[i - 1]) for i, f in enumerate(flags))
        assert len(got[doc].removed) == runs
        assert sum(s.end - s.start for s in got[doc].removed) == sum(flags)


def test_windows_within_one_slice_and_across(spark):
    r = random.Random(4)
    base = "".join(r.choice("abcdefgh ") for _ in range(400))
    df = spark.createDataFrame([(1, base), (2, "zz" + base[50:350]), (3, base[100:199])], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in S.suffix_dedup(df).collect()}
    assert len(got[1].removed) == 0 and bytes(got[2].kept) == b"zz" and len(got[3].removed) == 0


def test_nulls_repeated_rows_empty_tables_and_clashing_names(spark):
    long = "the same passage of text, again and again, until it is longer than one hundred bytes, as it must be to be cut"
    df = spark.createDataFrame(
        [Row(doc_id=5, text=long, kept="k", removed=1, row="r", lo=9), Row(doc_id=5, text=long, kept="k", removed=1, row="r", lo=9), Row(doc_id=None, text=long, kept=None, removed=None, row=None, lo=None), Row(doc_id=9, text=long, kept="", removed=2, row="", lo=1), Row(doc_id=10, text=None, kept="", removed=2, row="", lo=1)],
        "doc_id long, text string, kept string, removed int, row string, lo int",
    )
    got = S.suffix_dedup(df, carry=["kept", "row"]).collect()
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    assert bytes(by[5].kept) == long.encode() and bytes(by[None].kept) == long.encode()
    assert bytes(by[9].kept) == b"" and by[9].n_bytes == len(long) and bytes(by[10].kept) == b"" and by[5].row.kept == "k"
    assert S.suffix_dedup(df.limit(0)).count() == 0


def test_query_digests(spark, tmp_path):
    from seriesforge.llm.queries import QUERIES

    docs = texts(5, 20)
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op1_suffix_dedup"](spark, str(tmp_path)).collect()}
    want = brute({k: v.encode() for k, v in docs.items()}, 100)
    for doc, flags in want.items():
        kept = bytes(b for b, f in zip(docs[doc].encode(), flags, strict=True) if not f)
        assert got[doc].kept_sha256 == hashlib.sha256(kept).hexdigest() and got[doc].n_removed == sum(flags)
