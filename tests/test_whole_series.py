"""Registered queries against brute force over whole series, on small tables of orders."""

import datetime

import numpy as np
import pytest

from seriesforge.operators import matching as M
from seriesforge.plans import all_queries

DAYS, MOTIF = 860, 720


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Two entities of 860 days: a level shift at day 780 of one, and day 720's month again as the last one of the other."""
    d, r = tmp_path_factory.mktemp("orders"), np.random.default_rng(3)
    x = {"shift": 100 + r.normal(0, 5, DAYS), "motif": 100 + r.normal(0, 5, DAYS)}
    x["shift"][780:] += 300
    x["motif"][-30:] = x["motif"][MOTIF : MOTIF + 30]
    day = datetime.date(1992, 1, 1)
    rows = [(k, day + datetime.timedelta(i), float(v)) for k, s in x.items() for i, v in enumerate(s)]
    spark.createDataFrame(rows, "o_orderpriority string, o_orderdate date, o_totalprice double").write.parquet(f"{d}/orders.parquet")
    return str(d), x


def run(spark, made, name):
    return all_queries()[0][name](spark, made[0]).collect()


def test_matches_are_those_of_the_last_window(spark, made):
    got = {(r.entity, r.rank): r for r in run(spark, made, "dtw_match")}
    for k, x in made[1].items():
        starts = np.arange(DAYS - 30 - 90)
        d = np.array([M.dtw(M.normalise(x[-30:]), M.normalise(x[s : s + 30])[None])[0] for s in starts])
        want = sorted(zip(d.round(9).tolist(), starts.tolist(), strict=True))[0]
        assert got[k, 1].start == want[1] and got[k, 1].distance == pytest.approx(want[0], abs=1e-6)
    assert got["motif", 1].start == MOTIF


def test_late_rows_take_part(spark, made):
    assert {(r.entity, r.idx) for r in run(spark, made, "scale_average")} == {(k, i) for k in made[1] for i in range(DAYS)}
    assert {(r.entity, r.idx) for r in run(spark, made, "lstm_predict")} == {(k, i) for k in made[1] for i in range(30, DAYS)}
    assert any(r.entity == "shift" and abs(r.idx - 780) <= 2 for r in run(spark, made, "cp_bootstrap"))
