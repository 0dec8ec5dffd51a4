import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from seriesforge.llm import packing as K

PATH = P.path("byte_bpe_50k.json")


def check_rows(rows, texts, size=2048):
    t = Tokenizer.from_file(PATH)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size
    return len(by_seq)


def test_each_id_is_packed_once(spark):
    r = random.Random(1)
    words = ["alpha", " beta", "Gämma", "δ", "12", "\n\n", " ", "don't", "<|endoftext|>", "\x1c"]
    texts = ["", None, " ", "<|endoftext|>", "a  b\n\n c "] + [" ".join(r.choice(words) for _ in range(r.choice([3, 50, 900, 3000]))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, slot string, kind int").repartition(4)
    rows = K.pack(K.token_pieces(df, PATH)).collect()
    n = check_rows(rows, texts)
    used = sum(x.length for x in rows)
    assert n <= used / 2048 * 1.12 + 2


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (3, None), (3, None)], "doc_id long, text string")
    rows = K.pack(K.token_pieces(df, PATH)).collect()
    assert len(rows) == 4 and len({x.sequence_id for x in rows}) == 1
    check_offsets = sorted((x.offset, x.length) for x in rows)
    assert all(a[0] + a[1] == b[0] for a, b in zip(check_offsets, check_offsets[1:], strict=False)) and check_offsets[0][0] == 0
    assert K.pack(K.token_pieces(df.limit(0), PATH)).count() == 0


def test_patterns_meet_the_demand_near_the_bound():
    r = np.random.default_rng(5)
    width = np.unique(r.integers(1, 513, 300))
    demand = r.integers(1, 4000, len(width))
    plan = K.cutting_patterns(width, demand, 512)
    got = np.zeros(len(width), np.int64)
    for n, items in plan:
        assert width[items].sum() <= 512
        for i in items:
            got[i] += n
    assert (got == demand).all()
    assert sum(n for n, _ in plan) <= (width @ demand) / 512 * 1.12 + 5


def test_same_ids_as_whole_text_encoding():
    t, mine = Tokenizer.from_file(PATH), K._tokens(PATH)
    r = random.Random(2)
    texts = ["".join(chr(r.choice([32, 10, 9, r.randint(33, 126), r.randint(160, 1200), 0x3000, 0x1F600])) for _ in range(300)) for _ in range(60)]
    for text, got in zip(texts, mine.of(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_known_words_are_not_split_again():
    mine = K._Tokens(PATH)
    texts = ["It's one line, don't you know;\nand 'another' one.", "and one line, don't 'another' one."]
    first = mine.of(texts)

    def split(text):
        raise AssertionError(f"split again: {text}")

    mine.find = split
    assert mine.of(texts) == first


def test_white_space_of_all_kinds_around_words(monkeypatch):
    t = Tokenizer.from_file(PATH)
    r = random.Random(4)
    parts = [" ", "\n", "  ", "\n\n", " \n", "\n ", "\t", "\r\n", "\x1c", "\x85", "\xa0", " ", "　", "a", "word", "'s", "don't", "12", ".", "ÿ", "中文", "x" * 200, "<|endoftext|>"]
    texts = ["", " ", "\n", "\n\n", " a", "a ", "\na", "a\n", "a\n b", "a \nb", "a\n\nb", "a  b", "a   b", " 's", "a\t b", "a \t \tb", "a\xa0 \xa0b"]
    texts += ["".join(r.choice(parts) for _ in range(r.choice([2, 3, 5, 9, 40]))) for _ in range(4000)]
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    mine = K._Tokens(PATH)
    assert mine.of(texts) == want
    monkeypatch.setattr(K, "CACHED", 50)
    assert [ids for lo in range(0, len(texts), 10) for ids in mine.of(texts[lo : lo + 10])] == want
    assert len(mine.units) < 600 and len(mine.pieces) < 600
