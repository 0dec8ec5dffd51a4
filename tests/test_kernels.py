"""Kernels against brute force and known answers."""

import itertools
import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesforge.functions import special
from seriesforge.operators import changepoint as CP
from seriesforge.operators import correlation as CO
from seriesforge.operators import ensemble as E
from seriesforge.operators import lstm as L
from seriesforge.operators import matching as M
from seriesforge.operators import regimes as H
from seriesforge.operators import tuning as T
from seriesforge.operators import validate as V
from seriesforge.operators import wavelet as W


def shift(seed=42, parts=((0, 1, 50), (5, 1, 50))):
    r = np.random.default_rng(seed)
    return np.concatenate([r.normal(m, s, n) for m, s, n in parts])


def test_p_values():
    assert special.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert special.t_two_sided(0, 5) == pytest.approx(1)
    assert special.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-6)
    assert special.correlation_p(np.array([0.632, 1.0, 0.1]), np.array([10, 5, 2]))[:2] == pytest.approx([0.05, 0], abs=1e-3)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=8, max_size=13), st.sampled_from(["l2", "normal", "rbf"]), st.floats(0.5, 5))
def test_pelt_is_exact(values, model, penalty):
    x, least = np.array(values), 2
    cost = CP.Cost(x, model)

    def total(cuts):
        edges = [0, *cuts, len(x)]
        return sum(cost(a, b) for a, b in itertools.pairwise(edges)) + penalty * len(cuts)

    options = [c for k in range(len(x) // least) for c in itertools.combinations(range(1, len(x)), k) if all(b - a >= least for a, b in itertools.pairwise([0, *c, len(x)]))]
    got = CP.pelt(x, model, penalty, least)
    assert all(b - a >= least for a, b in itertools.pairwise([0, *got, len(x)]))
    assert total(got) == pytest.approx(min(map(total, options)), abs=1e-6)


def test_pelt_of_long_series_needs_no_matrix():
    x = shift(parts=((0, 1, 3000), (4, 1, 3000)))
    tracemalloc.start()
    cuts = CP.pelt(x, "rbf", 30.0, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(cuts) == 1 and abs(cuts[0] - 3000) <= 3 and peak < 20 << 20


def test_breaks_are_found():
    assert any(40 <= c <= 60 for c in CP.pelt(shift(), "l2", 10, 5))
    assert len(CP.pelt(shift(parts=((0, 1, 40), (5, 1, 40), (2, 1, 40))), "l2", 10, 5)) >= 2
    assert CP.pelt(np.random.default_rng(42).normal(size=100), "l2", 50, 5) == []
    assert any(40 <= c <= 60 for c in CP.binary_segmentation(shift(), 1.0, 5))
    assert CP.cusum(shift())


def test_p_values_side_by_side_are_those_of_one_by_one():
    t = np.array([0.0, -0.0, 1e-300, 1e-8, 0.3, 1, 2.5, -4, 37, 1e5, 1e160, 1e300, math.inf, -math.inf, math.nan])
    df = np.array([math.nan, -1, 0, 1e-9, 0.5, 1, 2, 3, 7.5, 100, 1e6, 1e12, 1e200, math.inf])
    t, df = (v.ravel() for v in np.meshgrid(t, df))
    want = np.array([special.t_two_sided(float(x), float(n)) for x, n in zip(t, df, strict=True)])
    assert special.t_two_sided_each(t, df) == pytest.approx(want, rel=1e-12, abs=0, nan_ok=True)
    assert not len(special.t_two_sided_each(np.zeros(0), np.zeros(0)))


def slow_dtw(a, b):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i, j in itertools.product(range(len(a)), range(len(b))):
        d[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return math.sqrt(d[-1, -1])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=3, max_size=9), st.lists(st.lists(st.floats(-3, 3), min_size=6, max_size=6), min_size=1, max_size=4))
def test_dtw_like_the_plain_table(a, many):
    a, many = np.array(a), np.array(many)
    want = np.array([slow_dtw(a, b) for b in many])
    assert M.dtw(a, many) == pytest.approx(want)
    limit = float(np.median(want)) + 1e-9
    got = M.dtw(a, many, limit)
    assert (got[want <= limit - 1e-6] == pytest.approx(want[want <= limit - 1e-6])) and M.normalise(np.ones((2, 4))).sum() == 0


def test_dtw_of_pairs_is_that_of_one_by_one():
    r = np.random.default_rng(9)
    one, many = r.normal(size=(40, 7)), r.normal(size=(40, 5))
    want = np.array([slow_dtw(a, b) for a, b in zip(one, many, strict=True)])
    assert M.dtw(one, many) == pytest.approx(want)
    limit = float(np.median(want)) + 1e-9
    got = M.dtw(one, many, limit)
    assert got[want <= limit] == pytest.approx(want[want <= limit]) and np.isinf(got).any() and (want[np.isinf(got)] > limit).all()


def test_hmm_separates_regimes_and_climbs():
    r = np.random.default_rng(42)
    x = np.concatenate([r.normal(0.02, 0.01, 120), r.normal(-0.015, 0.03, 120), r.normal(0.02, 0.01, 120)])[:, None]
    x = (x - x.mean()) / x.std()
    few, many = (H.GaussianHMM(2, n).fit(x) for n in (1, 60))
    assert many.score(x) >= few.score(x) and np.allclose(many.step.sum(1), 1)
    path = many.viterbi(x)
    assert (path[:120] == 1).mean() > 0.8 and (path[125:235] == 0).mean() > 0.7
    assert np.allclose(many.posteriors(x).sum(1), 1)


def test_kinds_of_covariance():
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal((0, 0), (1, 0.3), (150, 2)), r.normal((4, 2), (0.5, 1), (150, 2))])
    found = {}
    for kind in H.COVARIANCES:
        few, many = (H.GaussianHMM(2, n, covariance=kind).fit(x) for n in (1, 40))
        assert many.score(x) >= few.score(x) - 1e-6
        found[kind] = many.score(x)
        c = many.cov
        assert kind != "diag" or np.allclose(c * (1 - np.eye(2)), 0)
        assert kind != "spherical" or np.allclose(c, c[:, :1, :1] * np.eye(2))
        assert kind != "tied" or np.allclose(c[0], c[1])
    assert found["full"] >= max(found["spherical"], found["tied"]) - 1e-6
    with pytest.raises(ValueError):
        H.GaussianHMM(covariance="other")


def test_paths_of_any_length(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    net = spark.createDataFrame([(i, i + 1) for i in range(6)], "a int, b int")
    got = {(r.a, r.b): r.hops for r in CO.path_lengths(net).collect()}
    assert got == {(i, j): abs(i - j) for i in range(7) for j in range(7) if i != j}


def test_likelihood_like_the_sum_over_paths():
    x = np.array([[0.1], [1.2], [-0.4], [0.8]])
    m = H.GaussianHMM(2, 3).fit(x)
    dens = np.exp(H._log_density(x, m.mean, m.cov))
    paths = [m.first[p[0]] * dens[0, p[0]] * math.prod(m.step[a, b] * dens[t + 1, b] for t, (a, b) in enumerate(itertools.pairwise(p))) for p in itertools.product(range(2), repeat=4)]
    assert m.score(x) == pytest.approx(math.log(sum(paths)))
    best = max(itertools.product(range(2), repeat=4), key=lambda p: m.first[p[0]] * dens[0, p[0]] * math.prod(m.step[a, b] * dens[t + 1, b] for t, (a, b) in enumerate(itertools.pairwise(p))))
    assert m.viterbi(x).tolist() == list(best)


def test_wavelet_finds_the_period():
    t = np.arange(400)
    scales = np.arange(4, 64, dtype=float)
    c = W.transform(np.sin(2 * np.pi * t / 30), scales, "morlet") ** 2
    assert abs(scales[c[:, 100:300].mean(1).argmax()] / W.CENTRE["morlet"] - 30) < 4
    sampled = sum(np.sin(2 * np.pi * (t[200] + k) / 30) * W.mother("morlet", np.array(k / 10.0)) / math.sqrt(10) for k in range(-80, 81))
    near = W.transform(np.sin(2 * np.pi * t / 30), np.array([10.0]), "morlet")[0, 200:202]
    assert near.mean() == pytest.approx(sampled, rel=0.02)  # differences stand between two rows; at large scales they are near the samples


@pytest.mark.parametrize("scale", [1.0, 2.0, 2.5, 7.0])
def test_wavelet_is_integrated(scale):
    """Differences of the convolution with the tabulated integral, written out; samples of the wavelet would be off at small scales."""
    x = np.random.default_rng(0).normal(size=50)
    table = W.integral("mexican_hat")
    k = np.arange(int(16 * scale) + 1)
    g = table[np.floor(k * 4095 / (16 * scale)).astype(int)][::-1]
    full = -math.sqrt(scale) * np.diff(np.convolve(x, g))
    spare = (len(full) - len(x)) / 2
    want = full[math.floor(spare) : len(full) - math.ceil(spare)]
    assert np.allclose(W.transform(x, np.array([scale]), "mexican_hat")[0], want)
    assert abs(table[-1]) < 1e-3 and W.transform(np.ones(200), np.array([scale]), "mexican_hat")[0, 100] == pytest.approx(0, abs=1e-9)


def test_ridges_in_the_kernel_like_ridges_of_coefficients(spark):
    r = np.random.default_rng(4)
    x = np.sin(2 * np.pi * np.arange(300) / 20) + r.normal(size=300) * 0.3
    df, scales = frame(spark, a=x, b=r.normal(size=200).cumsum()), [2, 5, 16, 30]
    of = lambda d: sorted((x.entity, x.scale, x.start, x.end, x.duration, round(x.strength, 9), round(x.max_strength, 9), round(x.persistence, 9)) for x in d.collect())
    assert of(W.series_ridges(df, scales, least=0.05)) == of(W.ridges(W.power(df, scales), 0.05))


@pytest.mark.parametrize("layers, bidirectional, attention", [(1, False, True), (2, True, True), (3, False, False)])
def test_gradients_of_the_network(layers, bidirectional, attention):
    r = np.random.default_rng(1)
    net = L.Net(L.Config(hidden=3, layers=layers, bidirectional=bidirectional, attention=attention))
    x, y = r.normal(size=(5, 6)), r.normal(size=5)
    _, g = net.gradients(x, y)
    for name, a in net.p.items():
        flat = a.reshape(-1)
        for i in r.choice(flat.size, min(6, flat.size), replace=False):
            old = flat[i]
            flat[i] = old + 1e-5
            up = net.gradients(x, y)[0]
            flat[i] = old - 1e-5
            down = net.gradients(x, y)[0]
            flat[i] = old
            assert g[name].reshape(-1)[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_dropout_masks_reach_the_gradients():
    net = L.Net(L.Config(hidden=4, layers=2, dropout=0.5))
    r = np.random.default_rng(2)
    x, y = r.normal(size=(6, 5)), r.normal(size=6)
    again = lambda: net.gradients(x, y, np.random.default_rng(7))
    g = again()[1]["w00"]
    for i in range(0, g.size, 9):
        flat = net.p["w00"].reshape(-1)
        old = flat[i]
        flat[i] = old + 1e-5
        up = again()[0]
        flat[i] = old - 1e-5
        down = again()[0]
        flat[i] = old
        assert g.reshape(-1)[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_training_lowers_both_losses(spark):
    df = frame(spark, a=np.sin(np.arange(240) / 5), short=np.arange(12.0))
    h = L.train(df, L.Config(length=10, hidden=8, rate=1e-2, epochs=6)).orderBy("epoch").collect()
    assert {r.entity for r in h} == {"a"} and [r.epoch for r in h] == [1, 2, 3, 4, 5, 6]
    assert h[-1].train_loss < h[0].train_loss and h[-1].val_loss < h[0].val_loss
    assert L.validation_loss(np.arange(12.0), L.Config(length=10)) == np.inf


def test_objectives_take_another_metric(spark):
    x = np.sin(np.arange(300) / 6) + np.random.default_rng(0).normal(0, 0.1, 300)
    points = {"changepoint": (T.score_changepoint, {"penalty": 3.0, "min_segment": 5}), "hmm": (T.score_hmm, {"n_states": 2}), "fourier": (T.score_fourier, {"min_strength": 0.1, "min_confidence": 0.5}), "wavelet": (T.score_wavelet, {"n_scales": 32, "wavelet": 0}), "lstm": (T.score_lstm, {"hidden": 4, "layers": 1, "length": 10, "epochs": 1})}
    assert set(points) == set(T.SPACES)
    for score, p in points.values():
        assert np.isfinite(score(x, p)) and score(x, p, lambda result, data: len(data)) == 300
    found = T.search(frame(spark, a=x), T.SPACES["changepoint"], T.score_changepoint, 3, metric=lambda breaks, data: -len(breaks)).collect()
    assert sum(r.best for r in found) == 1 and min(r.score for r in found) == next(r.score for r in found if r.best)


def test_ridges_counted_like_the_query(spark):
    x = np.sin(np.arange(200) / 16)
    many = W.ridges(W.power(frame(spark, a=x), list(range(1, 129)), "morlet")).count()
    assert T.score_wavelet(x, {"n_scales": 128, "wavelet": 0}) == -many < 0


def test_matches_by_another_distance(spark):
    x = np.sin(np.arange(200) / 4)
    plain = lambda one, many, limit: np.sqrt(((many - one) ** 2).sum(1))
    got = M.find(frame(spark, a=x), 20, 20, 0.3, distance=plain).collect()
    warped = {r.start: r.distance for r in M.find(frame(spark, a=x), 20, 20, 0.3, top=999).collect()}
    assert got and all(warped[r.start] <= r.distance + 1e-9 for r in got)


def test_rules_on_pairs_shares_and_large_changes(spark):
    many = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    none = lambda kinds: many([], kinds)
    ens = many([("a", 12.0, 0.75, 0.9, 0.1), ("b", -2.0, 0.75, 0.9, 0.1)], "entity string, value double, confidence double, agreement double, anomaly double")
    pairs = many([("a", "b", -0.9, 0.001, 3), ("a", "c", 0.75, 0.01, 0), ("b", "c", 0.95, 0.2, 0), ("c", "d", 0.6, 0.0, 0)], "a string, b string, r double, p double, lag int")
    shares = many([("a", "x", 0.8), ("a", "y", 0.2), ("b", "x", 0.7)], "entity string, sector string, share double")
    cycles, now = "entity string, period_days double, strength double, frequency double, confidence double, category string", "entity string, state int, probability double"
    profiles, found = "entity string, state int, regime string, expected_duration double, volatility double", "entity string, similarity double, confidence double"
    out = E.insights(none(cycles), none(profiles), none(now), none(found), ens, pairs=pairs, shares=shares).collect()
    assert {(r.entity, r.type, r.severity, r.title) for r in out} == {
        ("a", "prediction", "high", "A large increase is predicted"),
        ("a", "correlation", "high", "Moves with b"),
        ("b", "correlation", "high", "Moves with a"),
        ("a", "correlation", "medium", "Moves with c"),
        ("c", "correlation", "medium", "Moves with a"),
        ("a", "sector", "medium", "Concentrated in x"),
    }
    assert {r.entity: r.evidence["lag"] for r in out if r.severity == "high" and r.type == "correlation"} == {"a": "3", "b": "-3"}


def test_ward_by_hand():
    d = np.array([[0, 0.1, 0.9, 0.95], [0.1, 0, 0.9, 0.9], [0.9, 0.9, 0, 0.2], [0.95, 0.9, 0.2, 0]])
    a = CO._ward(d, 0.5)
    assert a[0] == a[1] != a[2] == a[3] and len(set(CO._ward(d, 0.05))) == 4 and len(set(CO._ward(d, 9))) == 1


def test_adf_tells_walks_from_noise():
    r = np.random.default_rng(0)
    noise, walk = r.normal(size=400), r.normal(size=400).cumsum()
    (a, edge), (b, _) = V.adf(noise), V.adf(walk)
    assert a < edge < b


def test_trials():
    assert len(T.trials(T.SPACES["hmm"], 7)) == 7 and all(2 <= t["n_states"] <= 6 and isinstance(t["n_states"], int) for t in T.trials(T.SPACES["hmm"], 7))
    assert len(T.trials(T.SPACES["fourier"], 9, "grid")) == 9
    with pytest.raises(ValueError):
        T.trials(T.SPACES["hmm"], 3, "other")


def frame(spark, **series):
    rows = [(k, i, None if v is None else float(v)) for k, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["entity", "idx", "value"]).astype({"value": object}).where(lambda d: d.notna(), None).values.tolist(), "entity string, idx long, value double")


def test_cycles_of_known_series(spark):
    from seriesforge.operators import spectral as SP

    r, t = np.random.default_rng(42), np.linspace(0, 365, 365)
    c = SP.cycles(frame(spark, month=10 + 5 * np.sin(2 * np.pi * t / 30) + r.normal(size=365), flat=np.full(100, 5.0), short=r.normal(size=20))).collect()
    best = max((x for x in c if x.entity == "month"), key=lambda x: x.strength)
    assert 25 <= best.period_days <= 35 and best.category == "monthly" and best.confidence > 0.6
    assert {x.entity for x in c} == {"month"}


def test_repairs(spark):
    from seriesforge.operators import series as S

    df = frame(spark, a=[None, 1, None, None, 4, None], b=[float("inf"), 2, None, float("-inf"), 3, None], c=[None, None])
    got = {(r.entity, r.idx): r.value for r in S.interpolated(df.where("entity != 'b'")).collect()}
    assert [got["a", i] for i in range(6)] == [1, 1, 2, 3, 4, 4] and got["c", 0] is None
    got = {r.idx: r.value for r in S.filled(df.where("entity = 'b'")).collect()}
    assert [got[i] for i in range(6)] == [3, 2, 2, 2, 3, 3]


def test_stops_clamp_the_result_of_a_position(spark):
    from seriesforge.operators.backtest import stop_take

    rows = [("a", i, s, n) for i, (s, n) in enumerate([(1.0, -0.02), (1.0, -0.05), (1.0, 0.5), (-1.0, 0.03), (-1.0, 0.09), (-1.0, 0.01)])]
    got = sorted((r.idx, round(r.net, 9)) for r in stop_take(spark.createDataFrame(rows, "entity string, idx long, signal double, net double"), 0.05, 0.1).collect())
    assert [n for _, n in got] == [-0.02, -0.03, 0.0, 0.03, 0.07, 0.0]


def test_store_round_trip(spark, tmp_path):
    from seriesforge.sources.store import Runs, Store

    s, df = Store(spark, str(tmp_path / "m")), frame(spark, a=[1, 2, 3])
    for v in ("v1.0.0", "v1.0.1", "v1.1.0", "v2"):
        s.save(df, "cycles", v, metadata={"k": 1})
    assert s.latest("cycles") == "v2" and s.load("cycles", "v1.0.0").count() == 3 and s.list().count() == 4
    s.activate("cycles", "v1.0.1")
    assert s.latest("cycles") == "v1.0.1"
    assert len(s.cleanup("cycles", 2)) == 2 and s.list("model").count() == 2
    with pytest.raises(FileNotFoundError):
        s.load("nothing")
    name = s.list().first()["version"]
    df.limit(1).write.mode("append").parquet(f"{tmp_path}/m/cycles/{name}")
    with pytest.raises(ValueError):
        s.load("cycles", name)
    r = Runs(spark, str(tmp_path / "runs"))
    for k in (1, 3, 2):
        r.log("e", f"r{k}", {"k": k}, {"score": k})
    assert r.best("e", "score").first()["run"] == "r3" and r.best("e", "score", True).first()["run"] == "r1"
