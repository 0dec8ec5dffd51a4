import random

import corpus_pipeline as P
import pytest

from .test_near_dedup import brute as components
from .test_packing import check_rows
from .test_suffix_dedup import brute as repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(12)
    words = [f"{a}{b}" for a in ("al", "be", "cor", "dun", "es", "fil") for b in ("ta", "mo", "ri", "sen", "lo", "pu", "ge")]
    sentence = lambda n: " ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(n)).capitalize() + "."
    passage = sentence(70)
    rows = []
    for i in range(120):
        text = sentence(r.randint(20, 120))
        if i % 5 == 1:
            text = text + "\n" + passage
        if i % 6 == 2:
            text += " mail joe.x@mail.example.com or +1 (017) 555-7713"
        if i % 8 == 3 and rows:
            text = rows[r.randrange(len(rows))][1]
        if i % 10 == 4:
            text = " ".join("###".join(["", w.upper()]) + "!!" for w in text.split()[:9]) * 5
        rows.append((i, text))
    return rows + [(200, ""), (201, None)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    rows = corpus()
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], SCHEMA).repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 != 4), 0) for i, _ in rows if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, step in P.STAGES:
        docs = P.C.stage(step(spark, docs, d), name)
        out.append(docs)
    return out


def of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_quality_keeps_clean_documents(stages):
    kept = set(of(stages[0]))
    clean = {i for i, t in corpus() if t and "!!" not in t}
    assert len(clean & kept) >= 0.97 * len(clean)  # so small a sample leaves much of the rest in doubt
    assert stages[0].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_near_dedup_and_suffix_stages_like_brute_force(stages):
    before, after = of(stages[0]), of(stages[1])
    want = components(list(before.items()), 5)
    assert set(after) == {d for d, (_, c) in want.items() if c == d} and all(after[d] == before[d] for d in after)
    cut = of(stages[2])
    for doc, flags in repeats({d: (t or "").encode() for d, t in after.items()}, 100).items():
        assert cut[doc] == bytes(b for b, f in zip((after[doc] or "").encode(), flags, strict=True) if not f).decode("utf-8", "ignore")
    assert [r.n_chars for r in stages[2].collect()] == [len(r.text) for r in stages[2].collect()]


def test_personal_data_and_packing(stages):
    before, after = of(stages[2]), of(stages[3])
    assert all(after[d] == t.replace("joe.x@mail.example.com", "[EMAIL]").replace("+1 (017) 555-7713", "[PHONE]") for d, t in before.items())
    docs = sorted(after)
    rows = [r for r in stages[4].collect()]
    number = {d: i for i, d in enumerate(docs)}
    check_rows([type("R", (), {**r.asDict(), "doc_id": number[r.doc_id]}) for r in rows], [after[d] for d in docs])


def test_odd_tables(spark, tmp_path):
    d = str(tmp_path)
    long = "the very same words over and over again in a text that is long enough to be cut if it stood elsewhere too, yes"
    rows = [(None, long, None, None, None, 1), (None, long, None, None, None, 1), (5, long, "en", "s", 9, 2), (5, long, "en", "s", 9, 2), (6, None, None, None, None, 3)]
    spark.createDataFrame(rows, SCHEMA + ", row int").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, step in P.STAGES[:-1]:
        docs = step(spark, docs, d)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row"] and docs.count() == 5
    for _, step in P.STAGES:
        assert step(spark, spark.read.parquet(f"{d}/documents.parquet").limit(0), d).count() == 0
