import glob
import zlib

import numpy as np
import pytest

from seriesforge.llm import common as C
from seriesforge.llm import quality as Q
from seriesforge.llm.queries import QUERIES

DATA = "/root/testdata/sf0.1"


@pytest.mark.skipif(not glob.glob(f"{DATA}/documents.parquet"), reason="no test tables")
def test_held_out_accuracy(spark):
    got = QUERIES["op7_quality"](spark, DATA).toPandas()
    labels = C.table(spark, DATA, "labels").toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out, strict=True))
    x = got[got.held_out].merge(labels, on="doc_id")
    good, bad = x[x.quality == 1], x[x.quality == 0]
    rank = x.score.rank()
    auc = (rank[x.quality == 1].sum() - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad))
    print("auc", auc, "kept good", good.predicted.mean(), "rejected bad", 1 - bad.predicted.mean())
    assert auc > 0.97 and good.predicted.mean() > 0.98 and bad.predicted.mean() < 0.15


def test_labels_of_held_out_rows_are_not_read(spark):
    texts = [(i, f"A plain sentence with number {i} in it, and more words.") for i in range(60)] + [(100 + i, "BUY!! NOW!! " * (i + 3)) for i in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    marks = [(i, int(i < 100)) for i, _ in texts]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in marks]
    a, b = ({r.doc_id: r.score for r in Q.score_quality(docs, spark.createDataFrame(m, "doc_id long, quality int")).collect()} for m in (marks, turned))
    assert a == b


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (1, None, 2), (1, None, 2), (2, "x" * 50_000, 3), (3, "é\n\n", 4)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (3, 0)], "doc_id long, quality int")
    rows = Q.score_quality(docs, labels, carry=["score"]).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and sorted(r.row.score for r in rows) == [1, 2, 2, 3, 4]
    assert [r.score for r in Q.score_quality(docs, labels.limit(0)).collect()] == [0.5] * 5
    assert Q.score_quality(docs.limit(0), labels).count() == 0


def test_prior_from_positives_and_unlabelled_rows():
    r = np.random.default_rng(5)
    for share in (0.2, 0.5, 0.85):
        n = int(6000 * share)
        mixed = np.concatenate([r.normal(1, 1, (n, 4)), r.normal(-2, 1, (6000 - n, 4))])
        r.shuffle(mixed)
        assert abs(Q.class_prior(r.normal(1, 1, (3000, 4)), mixed) - share) < 0.06
    assert Q.class_prior(np.zeros((3, 4)), np.ones((50, 4))) == 0.5


def test_risk_like_plain_descent():
    """The fitted risk is as small as that of plain gradient steps on the same risk, over many more steps."""
    r = np.random.default_rng(2)
    p, u, prior = r.normal(1, 1, (400, 3)), np.concatenate([r.normal(1, 1, (300, 3)), r.normal(-1, 1, (300, 3))]), 0.5
    mean, scale = u.mean(0), u.std(0) + 1e-3
    x, y = (np.clip((z - mean) / scale, -8, 8) for z in (p, u))
    risk = lambda w, b: prior * np.logaddexp(0, -(x @ w + b)).mean() + max(0, np.logaddexp(0, y @ w + b).mean() - prior * np.logaddexp(0, x @ w + b).mean())
    w, b, sig = np.zeros(3), 0.0, lambda z: 1 / (1 + np.exp(-z))
    for _ in range(20_000):
        zx, zy = x @ w + b, y @ w + b
        g = [prior * (v.T @ (sig(zx) - 1)) / len(x) + q.T @ sig(zy) / len(y) - prior * (v.T @ sig(zx)) / len(x) for v, q in ((x, y), (np.ones(len(x)), np.ones(len(y))))]
        w, b = w - 0.05 * g[0], b - 0.05 * g[1]
    m = Q.fit(p, u, prior)
    assert risk(m.w, m.b) <= risk(w, b) + 1e-3


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "plain words, 1 and 2. " * 450_000), (2, "plain words")], "doc_id long, text string")
    rows = Q.score_quality(docs, spark.createDataFrame([(2, 1)], "doc_id long, quality int")).collect()
    assert len(rows) == 2 and all(0 <= r.score <= 1 for r in rows)


def test_risk_finds_negatives_in_unlabelled_text():
    r = np.random.default_rng(1)
    pos, neg = r.normal(1, 1, (3000, 4)), r.normal(-1.5, 1, (3000, 4))
    mixed = np.concatenate([pos[:2100], neg[:900]])
    m = Q.fit(r.normal(1, 1, (2000, 4)), mixed, 0.7)
    assert (m.score(pos) > 0.5).mean() > 0.93 and (m.score(neg) < 0.5).mean() > 0.93
