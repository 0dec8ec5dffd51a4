import math

import pytest

from seriesforge.functions import checks as C
from seriesforge.operators import validate as V

INF, NAN = float("inf"), float("nan")


def frame(spark, **series):
    from pyspark.sql import functions as F

    rows = [(e, i, None if v is None else float(v)) for e, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "entity string, idx long, value double").withColumn("ts", F.date_add(F.to_date(F.lit("2024-01-01")), F.col("idx").cast("int")))


def test_repair_fills_and_clips(spark):
    base = [1.0, 2.0, 3.0, 4.0] * 10
    df = frame(spark, a=[None, NAN, *base, INF, 7, -INF], many=[None] * 5 + base[:20], none=[INF] * 12, fine=base)
    got = {}
    for r in V.repaired(df).orderBy("entity", "idx").collect():
        got.setdefault(r.entity, []).append((r.value, r.was))
    assert [v for v, _ in got["a"]] == [1.0, 1.0, *base, 7.0, 7.0, 1.0]
    assert [w for _, w in got["a"]] == ["filled"] * 2 + [None] * 40 + ["clipped", None, "clipped"]
    assert got["many"][:5] == [(None, None)] * 5 and all(v == INF and w is None for v, w in got["none"]) and all(w is None for _, w in got["fine"])


def test_only_what_passes_goes_on(spark):
    base = [float(i % 5) for i in range(40)]
    df = frame(spark, holed=[*base, None], inf=[*base, INF], many=[None] * 10 + base, short=[1, 2], flat=[3] * 20, good=base)
    fixed = V.validated(df)
    assert {r.entity for r in fixed.select("entity").distinct().collect()} == {"holed", "inf", "good"}
    assert fixed.where("value IS NULL OR isnan(value) OR abs(value) = double('infinity')").count() == 0 and fixed.columns == df.columns or set(fixed.columns) == set(df.columns)
    assert {r.entity for r in V.validated(df, fix=False).select("entity").distinct().collect()} == {"good"}
    said = {r.entity: (r.issues, r.warnings) for r in V.series(df).collect()}
    assert said["holed"][1] == ["missing values filled"] and said["inf"][1] == ["infinite values clipped"] and said["many"][0] == ["too many missing values"]


def test_quick_validation_raises_with_names(spark):
    df = frame(spark, good=[float(i) for i in range(20)], short=[1, 2])
    assert V.quick(df.where("entity = 'good'")).first().is_valid
    with pytest.raises(V.ValidationError, match="short: too short"):
        V.quick(df)
    assert V.quick(df, raise_on_error=False).count() == 2


@C.parameters(k=C.whole(2, 10), penalty=C.number(0.0), share=C.probability(), method=C.one_of("a", "b"), other=C.whole())
def act(k, penalty=1.0, share=0.5, method="a", other=None):
    return k, penalty, share, method, other


@pytest.mark.parametrize(("args", "said"), [({"k": 1}, "k = 1"), ({"k": 2.0}, "whole"), ({"k": True}, "whole"), ({"k": 3, "penalty": -1}, "penalty"), ({"k": 3, "penalty": NAN}, "no number"), ({"k": 3, "penalty": INF}, "infinite"), ({"k": 3, "share": 1.1}, "share"), ({"k": 3, "method": "c"}, "none of 'a', 'b'"), ({"k": 3, "other": "x"}, "other")])
def test_wrong_parameters_are_named(args, said):
    with pytest.raises(C.ParameterError, match=said):
        act(**args)


def test_right_parameters_pass():
    assert act(2, 0, method="b") == (2, 0, 0.5, "b", None) and act(10, other=4)[4] == 4
    C.number(infinite=True)("x", math.inf)
    with pytest.raises(TypeError, match="no parameter"):
        C.parameters(z=C.whole())(act)
