"""Registered queries with all scales and lags, on a small table of orders."""

import datetime

import numpy as np

from seriesforge.plans import all_queries


def test_all_scales_and_a_lag_of_twenty_days(spark, tmp_path):
    x, day = np.random.default_rng(5).normal(100, 5, 220), datetime.date(1992, 1, 1)
    rows = [(k, day + datetime.timedelta(i), float(v)) for k, s in (("a", x[20:]), ("b", x[:-20])) for i, v in enumerate(s)]
    spark.createDataFrame(rows, "o_orderpriority string, o_orderdate date, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    run = lambda name: all_queries()[0][name](spark, str(tmp_path)).collect()
    assert [(r.a, r.b, r.lag) for r in run("corr_tested")] == [("a", "b", 20)]
    assert {r.scale for r in run("global_spectrum")} == set(range(1, 365))
