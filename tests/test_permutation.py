import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.operators import permutation as P


def order(entity, replica, n, seed=42):
    if replica == 0:
        return list(range(n))
    return sorted(range(n), key=lambda i: hashlib.md5(f"{seed}|{entity}|{replica}|{i}".encode()).hexdigest())


def statistic(metric, x, s):
    parts = [x[s == k] for k in np.unique(s)]
    if metric == "variance_ratio":
        return sum(len(p) * (p.mean() - x.mean()) ** 2 for p in parts) / len(x) / (sum(((p - p.mean()) ** 2).sum() for p in parts) / len(x) + 1e-10)
    if metric == "mean_difference":
        return max(np.abs(np.diff([p.mean() for p in parts])), default=0)
    return sum(-0.5 * len(p) * (np.log(2 * np.pi * (p.var() + 1e-12)) + 1) for p in parts)


def test_separation_like_shuffles_written_out(spark):
    r = np.random.default_rng(0)
    data = {"a": (r.normal(size=40), r.integers(0, 3, 40)), "b": (r.normal(size=30) + np.repeat([0, 2], 15), np.repeat([0, 1], 15)), "one": (r.normal(size=12), np.zeros(12, int))}
    df = spark.createDataFrame([(e, i * 2, float(v), int(s)) for e, (x, k) in data.items() for i, (v, s) in enumerate(zip(x, k, strict=True))], "entity string, idx long, ret double, state int")
    got = {(y.entity, y.metric): y for y in P.separation(df, n=30, metrics=P.METRICS).collect()}
    assert len(got) == 9
    for e, (x, s) in data.items():
        for metric in P.METRICS:
            null = np.array([statistic(metric, x[order(e, k, len(x))], s) for k in range(31)])
            y = got[(e, metric)]
            assert y.statistic == pytest.approx(null[0], abs=1e-9) and y.null_mean == pytest.approx(null[1:].mean(), abs=1e-9)
            if e != "one":
                assert y.p == pytest.approx((1 + (np.abs(null[1:]) >= abs(null[0])).sum()) / 31)
    assert got[("b", "variance_ratio")].p < 0.05 < got[("a", "variance_ratio")].p + 1
    with pytest.raises(ValueError, match="unknown"):
        P.separation(df, metrics=("other",))


def test_a_cycle_stands_out(spark):
    t = np.arange(120)
    x = np.sin(2 * np.pi * t / 12) + np.random.default_rng(1).normal(size=120) * 0.5
    df = spark.createDataFrame([("a", int(i), float(v)) for i, v in enumerate(x)], "entity string, idx long, value double")
    periods = spark.createDataFrame([("a", 12.0), ("a", 9.3)], "entity string, period_days double")
    got = {y.period_days: y for y in P.cycle_significance(df, periods, 40).collect()}
    z = x - np.polyval(np.polyfit(t, x, 1), t)
    null = [abs(z[order("a", k, 120)] @ np.exp(-2j * np.pi * t / 12)) * 2 / 120 for k in range(41)]
    assert got[12.0].p == pytest.approx(1 / 41) and got[9.3].p > 0.05
    assert got[12.0].strength == pytest.approx(null[0]) and got[12.0].null_p95 == pytest.approx(np.percentile(null[1:], 95))


def test_each_replica_has_each_row_once(spark):
    df = spark.createDataFrame([("a", i) for i in range(7)], "entity string, idx long")
    n = P.shuffled(df, 5).groupBy("replica").agg(F.count_distinct("place").alias("p"), F.count_distinct("idx").alias("i")).collect()
    assert len(n) == 6 and all(r.p == r.i == 7 for r in n)


def test_replicas_take_part_in_no_join(spark):
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(e, i, float(r.normal()), i % 3) for e in "ab" for i in range(60)], "entity string, idx long, ret double, state int")

    def final_plan(found):
        found.collect()
        return found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]

    parted = final_plan(P.separation(df, n=40))
    assert "Join" not in parted and "Broadcast" not in parted
    periods = df.select("entity", F.lit(7.0).alias("period_days")).distinct()
    cycles = final_plan(P.cycle_significance(df.withColumnRenamed("ret", "value"), periods, 40))
    assert cycles.rindex("explode(sequence(") < cycles.index("Join")  # a plan names what comes first last


def test_replicas_of_one_entity_are_dealt_out(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(20)], "entity string, idx long, v double").repartition("entity")
    where = P.shuffled(df, 200).select("replica", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(where) == 201 and len({x.task for x in where}) > 1
