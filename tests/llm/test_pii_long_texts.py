"""Very long texts and very many matches: whole results, in time that grows with the length."""

import time

from seriesforge.llm import pii as P

N = 100_000


def found(spark, texts):
    df = P.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return {r.doc_id: (r.spans, r.t) for r in df.select("doc_id", "spans", P.redacted(df).alias("t")).collect()}


def test_one_match_of_many_parts(spark):
    dots = "x@a" + ".a" * N
    (spans, text), (plain, _) = (found(spark, [dots, "." * N + "1" * N])[i] for i in (0, 1))
    assert [(s.kind, s.start, s.end) for s in spans] == [("email", 0, len(dots))] and text == "[EMAIL]" and not plain


def test_many_matches(spark):
    once = time.time()
    found(spark, ["a@b.cd "])
    t = time.time()
    made = found(spark, ["é joe@mail.example.com, " * N, "token=abcdefgh12345 a@b.cd " * 20_000])
    assert time.time() - t < 60 + 3 * (t - once)
    spans, text = made[0]
    assert len(spans) == N and [(s.start, s.end) for s in spans[:2]] == [(2, 22), (26, 46)] and (spans[-1].start, spans[-1].end) == (24 * N - 22, 24 * N - 2)
    assert text == "é [EMAIL], " * N
    spans, text = made[1]
    assert len(spans) == 40_000 and text == "[SECRET] [EMAIL] " * 20_000


def test_ten_megabytes(spark):
    body = "wörter ohne Zahlen und Zeichen " * 330_000
    spans, text = found(spark, [body + "10.0.0.1 " + body])[0]
    assert [(s.kind, s.start) for s in spans] == [("ip", len(body))] and text == body + "[IP] " + body
