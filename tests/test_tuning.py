import numpy as np
import pandas as pd
import pytest

from seriesforge.operators import tuning as T
from seriesforge.sources.staging import Stages

SPACE = {"x": (-5.0, 5.0), "k": (1, 8), "idle": (0.0, 1.0)}


def bowl(p):
    return (p["x"] - 2) ** 2 + abs(p["k"] - 3)


def run(n, seed):
    """The scores of a search that learns and of a random one."""
    r = np.random.default_rng(seed)
    known = T.trials(SPACE, 20, seed=seed)
    while len(known) < n:
        known += T.propose(known, np.array([bowl(p) for p in known]), SPACE, 10, r)
    return [bowl(p) for p in known], [bowl(p) for p in T.trials(SPACE, n, seed=seed + 1)]


def test_trials_learn():
    better = 0
    for seed in range(10):
        learned, drawn = run(80, seed)
        better += np.mean(learned[40:]) < np.mean(drawn[40:]) / 2
    assert better >= 9


def test_proposals_stay_within_their_ranges():
    known = T.trials(SPACE, 30)
    for p in T.propose(known, np.array([np.inf] * 5 + [1.0] * 25), SPACE, 50, np.random.default_rng(0)):
        assert -5 <= p["x"] <= 5 and 1 <= p["k"] <= 8 and p["k"] == int(p["k"]) and 0 <= p["idle"] <= 1


def test_a_density_integrates_to_one():
    x = np.linspace(-5, 5, 4001)
    at, width = T._parzen(np.array([-4.9, 0.0, 0.1, 4.0]), -5, 5)
    assert np.trapezoid(np.exp(T._log_density(x, at, width, -5, 5)), x) == pytest.approx(1, abs=1e-3)


def test_search_over_entities(spark):
    r = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame([(e, i, float(v)) for e in "ab" for i, v in enumerate(r.normal(size=40))], columns=["entity", "idx", "value"]))
    found = T.learned_search(df, SPACE, lambda x, p: bowl(p) + 0 * len(x), Stages(spark), n=60, first=20, batch=20).toPandas()
    assert len(found) == 120 and found.groupby("entity")["best"].sum().eq(1).all() and found.groupby("entity")["trial"].nunique().eq(60).all()
    late, early = found[found["trial"] >= 40]["score"].mean(), found[found["trial"] < 20]["score"].mean()
    assert late < early / 2
    best = found[found["best"]].set_index("entity")["score"]
    assert (best == found.groupby("entity")["score"].min()).all()
    weight = T.importance(spark.createDataFrame(found[["entity", "params", "score"]], "entity string, params map<string,double>, score double"), SPACE).toPandas()
    assert weight.groupby("entity")["importance"].sum().to_numpy() == pytest.approx(1)
    assert (weight[weight["parameter"] == "x"]["importance"] > 0.5).all()


def test_importance_of_nothing(spark):
    df = spark.createDataFrame([("a", {"x": 1.0}, 3.0), ("a", {"x": 4.0}, 3.0), ("a", {"x": 2.0}, float("inf"))], "entity string, params map<string,double>, score double")
    assert [r.importance for r in T.importance(df, {"x": (-5.0, 5.0)}).collect()] == [0.0]
