import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesforge.operators import lstm as L
from seriesforge.operators import markov as K
from seriesforge.operators import regimes as H
from seriesforge.operators import scans
from seriesforge.operators.regimes import GaussianHMM
from seriesforge.sources.store import Store


def one_by_one(b, step, first):
    n, k = b.shape
    alpha, beta, scale = np.empty((n, k)), np.ones((n, k)), np.empty(n)
    for t in range(n):
        a = (first if t == 0 else alpha[t - 1] @ step) * b[t]
        scale[t] = a.sum()
        alpha[t] = a / scale[t]
    for t in range(n - 2, -1, -1):
        beta[t] = step @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
    return alpha, beta, scale


def best_one_by_one(logs, step, first):
    best, back = first + logs[0], np.zeros(logs.shape, int)
    for t in range(1, len(logs)):
        total = best[:, None] + step
        back[t], best = total.argmax(0), total.max(0) + logs[t]
    path = [int(best.argmax())]
    for t in range(len(logs) - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return path[::-1]


@pytest.mark.parametrize("k", [1, 2, 4])
@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 400])
def test_scans_like_plain_recursions(n, k):
    r = np.random.default_rng(n * 10 + k)
    b, step, first = r.random((n, k)) + 1e-9, r.random((k, k)), r.random(k)
    step, first = step / step.sum(1, keepdims=True), first / first.sum()
    for got, want in zip(scans.passes(b, step, start=first), one_by_one(b, step, first), strict=True):
        assert np.allclose(got, want, rtol=1e-10, atol=1e-12)
    path, _ = scans.best_path(np.log(b), np.log(step), start=np.log(first))
    assert path.tolist() == best_one_by_one(np.log(b), np.log(step), np.log(first))


def switching(n, seed):
    r = np.random.default_rng(seed)
    s = np.cumsum(r.random(n) < 0.03) % 3
    return np.c_[r.normal(np.array([-1, 0, 2])[s], 0.6), r.normal(np.array([0, 1, -1])[s], 0.5)], s


@pytest.fixture(scope="module")
def rows(spark):
    out = []
    for e, n in (("a", 300), ("b", 900), ("few", 6)):
        x, s = switching(n, n)
        out += [(e, i, float(x[i, 0]), float(x[i, 1]), int(s[i])) for i in range(n)]
    return spark.createDataFrame(out, "entity string, idx long, u double, v double, state int").repartition(3).cache()


@pytest.fixture
def stage(spark, tmp_path):
    def write(df):
        path = f"{tmp_path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return write


def test_models_are_rows_that_decode_other_rows(spark, rows, tmp_path):
    store = Store(spark, str(tmp_path))
    store.save(K.fit(rows.where("idx < 240"), 3, 60, columns=["u", "v"]), "m", "v1", "hmm")
    models = store.load("m")
    assert {r.entity: r.n for r in models.collect()} == {"a": 240, "b": 240}
    out = K.decode(rows.where("idx >= 240"), models).toPandas()
    assert set(out["entity"]) == {"a", "b"} and out.groupby("entity")["idx"].min().eq(240).all()
    assert np.allclose([sum(p) for p in out["probabilities"]], 1)
    m = models.where("entity = 'b'").first().asDict()
    g = rows.where("entity = 'b' and idx >= 240").orderBy("idx").toPandas()
    x = (g[["u", "v"]].to_numpy() - np.array(m["centre"])) / np.array(m["scale"])
    hmm = K._model(m)
    mine = out[out["entity"] == "b"].sort_values("idx")
    assert mine["state"].tolist() == hmm.viterbi(x).tolist() and np.isclose(mine["log_likelihood"].iloc[0], hmm.score(x))
    wide = K.predict_proba(rows.where("idx >= 290"), models).groupBy("entity", "idx").agg(F.sum("probability").alias("p"), F.count("*").alias("n")).toPandas()
    assert np.allclose(wide["p"], 1) and (wide["n"] == 3).all()


def test_states_are_found_again(rows):
    """With labels or without, most rows of well parted states get their own."""
    labelled = K.fit_labelled(rows.where("entity <> 'few'"), ["u", "v"])
    got = K.decode(rows, labelled).join(rows.select("entity", "idx", F.col("state").alias("true")), ["entity", "idx"])
    assert got.agg(F.avg((F.col("state") == F.col("true")).cast("int"))).first()[0] > 0.95
    p = K.step_probabilities(labelled).groupBy("entity", "from_state").agg(F.sum("probability").alias("p")).toPandas()
    assert np.allclose(p["p"], 1) and len(p) == 6


@pytest.mark.parametrize("size", [1, 7, 100, 5000])
def test_blocks_decode_like_whole_series(rows, size):
    models = K.fit(rows.where("entity = 'a'"), 3, 30, columns=["u", "v"]).cache()
    a = K.decode(rows, models).toPandas()
    b = K.block_states(K.blocks(rows, size, ["u", "v"]), models).toPandas()
    j = a.merge(b, on=["entity", "idx"])
    assert len(a) == len(b) == len(j) == 300
    assert (j["state_x"] == j["state_y"]).all() and np.allclose(j["probability_x"], j["probability_y"], atol=1e-10)
    assert np.allclose(j["log_likelihood_x"], j["log_likelihood_y"], rtol=1e-12)


def test_a_long_series_in_several_tasks(spark):
    n = 100_000
    x, _ = switching(n, 3)
    model = GaussianHMM(3, 5).fit(x[:5000])
    df = spark.createDataFrame(pd.DataFrame({"entity": "z", "idx": np.arange(n), "u": x[:, 0], "v": x[:, 1]}))
    models = spark.createDataFrame(K._row("z", model, ["u", "v"], np.zeros(2), np.ones(2), 0.0, 1, n), f"entity string, {K.MODEL}")
    got = K.block_states(K.blocks(df, 12_500, ["u", "v"]), models).agg(F.first("log_likelihood"), F.count("*")).first()
    assert got[1] == n and abs(got[0] / model.score(x) - 1) < 1e-9


@pytest.mark.parametrize("covariance", H.COVARIANCES)
def test_fits_of_blocks_like_fits_of_whole_series(rows, stage, covariance):
    """Short enough that the starting means are drawn from the same rows."""
    one = rows.where("entity = 'a'")
    whole = K.fit(one, 3, 12, covariance, columns=["u", "v"], tolerance=-1e9).first()
    parts = K.fit_blocks(stage(K.blocks(one, 64, ["u", "v"])), stage, 3, 12, covariance, columns=["u", "v"], tolerance=-1e9).first()
    for c in ("first", "step", "mean", "cov"):
        assert np.allclose(K._nested(parts[c]), K._nested(whole[c]), rtol=1e-6, atol=1e-7), c
    assert parts["rounds"] == whole["rounds"] == 12 or parts["rounds"] == whole["rounds"]


def test_additional_features_take_part(spark):
    r = np.random.default_rng(0)
    df = spark.createDataFrame([("a", i, float(100 + r.normal()), float(50 + r.normal()), float(5 * (i // 60 % 2)), None) for i in range(240)], "entity string, idx long, close double, volume double, trend double, extra double").fillna(1.0)
    feats = H.features(df, ("trend", "extra"))
    assert {"trend", "extra"} <= set(feats.columns)
    models = K.fit(feats, 2, 100, columns=["ret", "trend"])
    out = K.decode(feats, models).toPandas().sort_values("idx")
    runs = (np.diff(out["state"]) != 0).sum()
    assert runs == 3 and models.first().columns == ["ret", "trend"]
    assert H.states(feats, 2, 50, additional=("trend",)).count() == 240


def test_networks_are_rows(spark, tmp_path):
    c = L.Config(length=5, hidden=4, layers=2, epochs=2, bidirectional=True)
    df = spark.createDataFrame([(e, i, float(np.sin(i / 3) + (e == "b"))) for e, n in (("a", 60), ("b", 80), ("short", 7)) for i in range(n)], "entity string, idx long, value double")
    store = Store(spark, str(tmp_path))
    store.save(L.fit(df, c), "n", "v1", "lstm")
    models = store.load("n")
    assert {r.entity: r.epoch for r in L.losses(models).groupBy("entity").agg(F.max("epoch").alias("epoch")).collect()} == {"a": 2, "b": 2}
    got = L.apply(df, models).toPandas().sort_values(["entity", "idx"])
    v = np.array([np.sin(i / 3) for i in range(60)])
    x, y, cut, mean, sd = L._windows(v, c)
    want = L.Net(c).fit(x[:cut], y[:cut], (x[cut:], y[cut:])).forward(x)[0] * sd + mean
    mine = got[got["entity"] == "a"]
    assert np.allclose(mine["predicted"], want) and mine["training"].sum() == cut
    new = L.apply(df.where("idx >= 40"), models).toPandas()
    assert set(new["entity"]) == {"a", "b"} and new["idx"].min() == 45
    assert np.allclose(new[new["entity"] == "a"].sort_values("idx")["predicted"], mine[mine["idx"] >= 45]["predicted"])
