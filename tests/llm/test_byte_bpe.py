import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesforge.llm import byte_bpe as B

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", None, " ", "\n\n  x", "Hello world's end, 12345!", "naïve Ñandú — ẞ 漢字かな😀😀", "a" * 5000, "ab" * 3000 + "é" * 500, "<|endoftext|> don't", "\x00\x01​　 end ", "x" * 64, "x" * 65, "thththth" * 8]


def test_like_tiktoken(spark, oracle):
    r = random.Random(3)
    texts = TEXTS + ["".join(chr(r.choice([r.randint(32, 126), r.randint(160, 900), r.randint(0x4E00, 0x4F00)])) for _ in range(r.randint(0, 200))) for _ in range(40)]
    df = spark.createDataFrame([(i if i != 3 else None, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: r for r in B.decode(B.encode(df, PATH, P.PATTERN, carry=["ids"]), PATH).collect()}
    for i, t in enumerate(texts):
        row = got[i if i != 3 else None]
        assert list(row.ids) == oracle.encode_ordinary(t or ""), t
        assert bytes(row.decoded) == (t or "").encode() and row.row.ids == "c"
    assert B.encode(df.limit(0), PATH, P.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=64))
def test_short_and_long_trees_agree(raw):
    v = B.vocabulary(PATH)
    assert v.merge_short([raw, b"q"])[0].tolist() == v.merge_long(raw).tolist()
    assert b"".join(v.spelled[i] for i in v.merge_long(raw)) == raw


def test_full_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(B, "CACHED", 3)
    v = B.Vocabulary(PATH)
    for words in ({"alpha", "beta"}, {"gamma", "delta", "alpha", "eps"}):
        v.learn(words)
        assert words <= set(v.cache)
