import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from seriesforge.llm import queries as Q
from seriesforge.llm import vector_packing as V

PATH = P.path("word_bpe_49k.json")


def pieces_of(text, size=4096):
    ids = np.array(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1], "<u4")
    return [(k, at, len(ids[at : at + size]), zlib.crc32(ids[at : at + size].tobytes())) for k, at in enumerate(range(0, len(ids), size))]


def check(rows, capacity):
    """The number of sequences; offsets have no gaps, no capacity is exceeded."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for rs in by.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity[0] and len(rs) <= capacity[1] and sum(r.length**2 for r in rs) <= capacity[2]
    return len(by)


def test_ids_like_the_library():
    r = random.Random(1)
    latin = [chr(c) for c in range(256)]
    any_ = latin + [chr(c) for c in range(0x250, 0x3FF)] + list("“”’—…日本語한글İıΣςſẞẖ̱̣̀​ ᠎﻿½Ⅷ٣²'") + ["'s", "'T", "'LL", "<|endoftext|>", "<|startoftext|>"]
    texts = ["".join(r.choice(a) for _ in range(r.randrange(40))) for a in (latin, any_) for _ in range(2000)]
    tokens, whole = V.WordTokens(PATH), Tokenizer.from_file(PATH)
    for text, ids in zip(texts, tokens.of(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(V, "PART", 10)
    text = "Été don't  <|endoftext|> " * 9 + "averylongwordwithoutanyblank" * 3
    assert b"".join(V.WordTokens(PATH).parts(text)) == np.array(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert [len(x) for x in V._cut(iter([b"abcd" * 3, b"", b"abcd" * 6]), 4)] == [16, 16, 4]


@pytest.mark.parametrize("rule", ["norm", "dot", None])
@pytest.mark.parametrize("capacity", [(64, 64, 4096), (64, 3, 4096), (64, 64, 1500), (64, 5, 2000)])
def test_every_capacity_holds(rule, capacity):
    r = np.random.default_rng(3)
    length = np.unique(r.integers(1, 38, 60))
    demand = r.integers(1, 200, len(length))
    plan = V.plan_sequences(length, demand, capacity, rule)
    met = np.zeros(len(length), np.int64)
    for n, what in plan:
        sizes = [int(length[k]) for k, times in what for _ in range(times)]
        assert n > 0 and sum(sizes) <= capacity[0] and len(sizes) <= capacity[1] and sum(x * x for x in sizes) <= capacity[2]
        for k, times in what:
            met[k] += n * times
    assert (met == demand).all()
    bound = max((length * demand).sum() / capacity[0], demand.sum() / capacity[1], (length**2 * demand).sum() / capacity[2])
    assert sum(n for n, _ in plan) <= bound * 1.25 + 2  # the bound looks at one capacity at a time


def sequential(lengths, capacity, rule):
    """Vector best-fit, piece by piece."""
    room = np.array(capacity)
    takes = [np.array([n, 1, n * n]) for n in sorted(lengths, reverse=True)]
    share = sum(takes) / room
    weight = share / share.sum() / room.astype(float) ** 2
    bins = []
    for t in takes:
        fits = [b for b in bins if (b >= t).all()]
        if not fits:
            bins.append(room - t)
            continue
        best = min(fits, key=lambda b: (weight * (b - t) ** 2).sum() if rule == "norm" else -(weight * t * b).sum())
        best -= t
    return len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [(100, 100, 10000), (100, 4, 10000), (100, 100, 2500)])
def test_groups_pack_like_single_pieces(rule, capacity):
    r = random.Random(7)
    lengths = [r.choice([3, 5, 8, 13, 20, 21, 33, 34, 50]) for _ in range(400)]
    k, n = np.unique(lengths, return_counts=True)
    assert abs(sum(m for m, _ in V.vector_best_fit(k, n, capacity, rule)) - sequential(lengths, capacity, rule)) <= 1


def test_too_long_pieces_and_unknown_rules_raise():
    with pytest.raises(ValueError, match="capacity"):
        V.vector_best_fit(np.array([5]), np.array([1]), (8, 8, 24))
    with pytest.raises(ValueError, match="rule"):
        V.vector_best_fit(np.array([5]), np.array([1]), (8, 8, 25), "first")


def test_query_like_the_library(spark, tmp_path):
    r = random.Random(2)
    words = ["alpha", "Gämma", "δ", "12", "\n\n", "don't", "<|endoftext|>", "!!!"]
    texts = ["", None, " ", "a  b\n\n c "] + [" ".join(r.choice(words) for _ in range(r.choice([3, 50, 900, 3000, 9000]))) for _ in range(150)]
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, length int, task int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op12_vector_packing(spark, str(tmp_path)).collect()
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append((x.piece, x.start, x.length, x.ids_crc32))
    assert {i: sorted(v) for i, v in by.items()} == {i: pieces_of(t) for i, t in enumerate(texts)}
    n = check(got, (4096, 4096, 4096**2))
    assert n <= sum(x.length for x in got) / 4096 * 1.05 + 2


def test_constraints_ties_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (3, None), (3, None), (4, "x " * 50)], "doc_id long, text string")
    rows = V.pack_best_fit(V.whole_pieces(df, PATH, size=20, with_ids=True), size=20, documents=2).collect()
    assert len(rows) == 7 and check(rows, (20, 2, 400)) == 5
    assert sorted(len(x.ids) // 4 for x in rows) == sorted(x.length for x in rows) == [1, 1, 4, 4, 11, 20, 20]
    assert V.pack_best_fit(V.whole_pieces(df.limit(0), PATH)).count() == 0
