import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesforge.functions import special, sql
from seriesforge.operators import matching
from seriesforge.plans import all_queries


@pytest.fixture
def registered(spark):
    sql.register(spark)
    return spark


def test_student_like_known_values(registered):
    rows = registered.sql("SELECT student_t_p(2.228D, 10D), student_t_sf(2.228D, 10D), student_t_sf(-2.228D, 10D), student_t_sf(0D, 3D), student_t_p(CAST(NULL AS double), 3D)").first()
    assert [round(x, 3) for x in rows[:4]] == [0.05, 0.025, 0.975, 0.5] and rows[4] is None


def test_rows_of_one_file_are_dealt_out_before_the_p_values(spark, tmp_path):
    """One file with one group of rows, a third of them with a missing key, a third with one key; some rows come twice, some lack values."""
    n = 6000
    part = pd.DataFrame({"p_partkey": pd.array([None if i % 3 == 0 else 7 if i % 3 == 1 else i for i in range(n)], "Int64"), "p_size": pd.array([None if i % 50 == 0 else i % 40 for i in range(n)], "Int32"), "p_retailprice": [math.nan if i % 70 == 0 else 900 + i % 977 * 1.5 for i in range(n)]})
    part = pd.concat([part, part[:500]])
    part.to_parquet(tmp_path / "part.parquet")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = all_queries()[0]["sql_student"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
        rows = df.toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    sizes = rows.groupby("task").size()
    assert len(sizes) == 4 and sizes.max() < 1.3 * sizes.mean()

    def one(key, size, price):
        if pd.isna(size) or math.isnan(price):
            return key, None, None
        t = (price - 1500) / 200
        p = special.t_two_sided(t, size + 2.0)
        return key, round(p, 6), round(p / 2 if t >= 0 else 1 - p / 2, 6)

    plain = lambda r: tuple(None if pd.isna(v) else v for v in r)
    got, want = (Counter(map(plain, x)) for x in (rows[["p_partkey", "p", "sf"]].itertuples(index=False), (one(*r) for r in part[["p_partkey", "p_size", "p_retailprice"]].itertuples(index=False))))
    assert got == want


def test_distance_of_shifted_and_missing_sequences(registered):
    text = "SELECT dtw_distance(array(1D, 2D, 3D, 2D), array(10D, 20D, 30D, 20D)), dtw_distance(array(1D), CAST(NULL AS array<double>)), dtw_distance(array(1D, NULL), array(1D, 2D)), dtw_distance(array(), array(1D))"
    same, *nothing = registered.sql(text).first()
    assert same == pytest.approx(0, abs=1e-9) and nothing == [None, None, None]


@pytest.mark.parametrize("elements", [1, 20, 1 << 17])
def test_distances_of_a_batch_are_those_of_its_pairs(monkeypatch, elements):
    r = np.random.default_rng(4)
    a = [r.normal(size=n) for n in (6, 6, 3, 6, 1, 6)] * 5
    b = [r.normal(size=n) for n in (4, 4, 4, 4, 2, 4)] * 5
    a[3], b[7], a[9], a[13], b[19] = None, None, np.array([]), np.array([1.0, None] + [2.0] * 4, object), np.ones(4)
    want = [matching.dtw(matching.normalise(x), matching.normalise(y)[None])[0] if x is not None and y is not None and len(x) and x.dtype == float else None for x, y in zip(a, b, strict=True)]
    calls = []
    dtw = matching.dtw
    monkeypatch.setattr(matching, "dtw", lambda x, y: calls.append(len(y)) or dtw(x, y))
    monkeypatch.setattr(sql, "ELEMENTS", elements)
    got = sql.dtw_distance(pd.Series(a), pd.Series(b, index=range(5, 35)))
    assert [None if math.isnan(x) else x for x in got] == want and got.isna().sum() == 4
    assert sum(calls) == 26 and (elements < 1 << 17 or len(calls) == 3)  # once for each pair of lengths
    assert sql.dtw_distance(pd.Series([None]), pd.Series([None])).isna().all() and not len(sql.dtw_distance(pd.Series([], dtype=object), pd.Series([], dtype=object)))


def test_table_functions_join_laterally(registered):
    df = registered.createDataFrame([("a", [float(i % 7 == 0) * 3 for i in range(140)]), ("b", [0.0] * 60 + [9.0] * 60), ("none", None), ("short", [1.0])], "entity string, x array<double>")
    cycles = registered.sql("SELECT s.entity, c.* FROM {df} s, LATERAL cycles(s.x, 0.1, 0.5) c", df=df).collect()
    assert any(r.entity == "a" and abs(r.period_days - 7) < 1e-9 for r in cycles)
    breaks = registered.sql("SELECT s.entity, c.idx, c.confidence FROM {df} s, LATERAL change_points(s.x, 'binseg', 'l2', 0.5D, 10, true) c WHERE s.entity = 'b'", df=df).collect()
    assert [(r.entity, r.idx) for r in breaks] == [("b", 60)]
    power = registered.sql("SELECT s.entity, count(*) n, max(p.n) m FROM {df} s, LATERAL periodogram(s.x) p GROUP BY 1", df=df).collect()
    assert {r.entity: (r.n, r.m) for r in power} == {"a": (70, 140), "b": (60, 120)}
    like = registered.sql("SELECT m.start, m.distance FROM {df} s, LATERAL matches(s.x, 14, 28, 0.9D) m WHERE s.entity = 'a'", df=df).collect()
    assert like and all(r.start % 7 == 0 and math.isclose(r.distance, 0, abs_tol=1e-6) for r in like if r.distance < 1e-6)


def test_missing_elements_are_named(registered):
    df = registered.createDataFrame([("a", [1.0, None, 2.0])], "entity string, x array<double>")
    with pytest.raises(Exception, match="null elements"):
        registered.sql("SELECT p.k FROM {df} s, LATERAL periodogram(s.x) p", df=df).collect()


def test_series_arrays_are_in_order(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in (3, 0, 2, 1)], "entity string, idx long, value double")
    assert sql.series_arrays(df).collect()[0].x == [0.0, 1.0, 2.0, 3.0]
