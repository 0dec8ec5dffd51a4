"""What SQL text can call: `register(spark)` adds scalar functions and table functions to a session.

    register(spark)
    spark.sql("SELECT s.entity, p.k, p.power FROM {series} s, LATERAL periodogram(s.x) p", series=series_arrays(daily))

A series is an array of doubles in time order, one row for each entity (see
`series_arrays`); a table function makes rows of each. Both kinds take Arrow
batches. Null arrays, and arrays too short for what is asked, give null from
scalar functions and no rows from table functions; a null element is a ValueError
in table functions and gives null from scalar ones.

| function | result |
|-|-|
| `dtw_distance(array, array)` | distance by dynamic time warping of the two z-scored sequences |
| `student_t_sf(t, df)` | P(T > t) of Student's t |
| `student_t_p(t, df)` | P(abs(T) > abs(t)) |
| `periodogram(array)` | k, n, power: amplitude of each frequency k / n below n // 2, line removed |
| `cycles(array, min_strength, min_confidence)` | period_days, strength, confidence, frequency |
| `change_points(array, method, model, penalty, least, scaled)` | idx, confidence |
| `matches(array, window, horizon, threshold)` | start, distance, similarity of windows like the last one |
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..operators import changepoint, matching, spectral
from .special import t_two_sided_each

ENTITY = "entity"
#: Elements of the sequences that are compared side by side.
ELEMENTS = 1 << 17


def series_arrays(series: DataFrame) -> DataFrame:
    """entity and x, its values by idx: what the table functions take. One row an entity, as long as its days are many."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "value")))
    return series.groupBy(ENTITY).agg(F.transform(ordered, lambda r: r["value"]).alias("x"))


def _numbers(x: object) -> np.ndarray | None:
    """The array as numbers; null if it is null."""
    if x is None:
        return None
    out = np.array([np.nan if v is None else v for v in x], float)
    if np.isnan(out).any():
        raise ValueError("a series has null elements; interpolate it first")
    return out


def dtw_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Pairs of the same two lengths are compared side by side."""
    out = np.full(len(a), np.nan)
    sizes = pd.DataFrame([(0, 0) if x is None or y is None else (len(x), len(y)) for x, y in zip(a, b, strict=True)], columns=["a", "b"])
    for (n, m), places in sizes[sizes.all(axis=1)].groupby(["a", "b"]).groups.items():
        step = max(1, ELEMENTS // max(n, m))
        for lo in range(0, len(places), step):
            at = np.asarray(places[lo : lo + step])
            x, y = (np.array(z.iloc[at].tolist(), float) for z in (a, b))  # None becomes NaN
            known = ~(np.isnan(x).any(1) | np.isnan(y).any(1))
            out[at[known]] = matching.dtw(matching.normalise(x[known]), matching.normalise(y[known]))
    return pd.Series(out)


def student_t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided_each(t.to_numpy(float), df.to_numpy(float)), t.index)


def student_t_sf(t: pd.Series, df: pd.Series) -> pd.Series:
    half = student_t_p(t, df) / 2
    return half.where(t >= 0, 1 - half)


@udtf(returnType="k bigint, n bigint, power double", useArrow=True)
class Periodogram:
    def eval(self, x: object) -> Iterator[tuple[int, int, float]]:
        x = _numbers(x)
        if x is not None and len(x) > 1:
            power = spectral.amplitudes(spectral.straightened(x))
            yield from ((k, len(x), float(p)) for k, p in enumerate(power))


@udtf(returnType="period_days double, strength double, confidence double, frequency double", useArrow=True)
class Cycles:
    def eval(self, x: object, min_strength: float, min_confidence: float) -> Iterator[tuple[float, float, float, float]]:
        x = _numbers(x)
        if x is None or len(x) < 2:
            return
        n, power = len(x), spectral.amplitudes(spectral.straightened(x))
        for k in spectral.peak_places(power, float(min_strength), 0.5 * float(min_strength)):
            if k:
                confidence = spectral.confidence(float(power[k]), n / k, n)
                if confidence >= min_confidence:
                    yield n / k, float(power[k]), confidence, k / n


@udtf(returnType="idx bigint, confidence double", useArrow=True)
class ChangePoints:
    def eval(self, x: object, method: str = "pelt", model: str = "l2", penalty: float = 10.0, least: int = 5, scaled: bool = False) -> Iterator[tuple[int, float]]:
        x = _numbers(x)
        if x is not None and len(x):
            yield from changepoint.breaks_with_confidence(x, method, model, float(penalty), int(least), bool(scaled))


@udtf(returnType="start bigint, distance double, similarity double", useArrow=True)
class Matches:
    def eval(self, x: object, window: int = 30, horizon: int = 90, threshold: float = 0.7) -> Iterator[tuple[int, float, float]]:
        x = _numbers(x)
        if x is not None and len(x) > window + horizon:
            limit = 2 * (1 / threshold - 1)
            for start, d in matching.windows_like_last(x, int(window), int(horizon), limit):
                yield start, d, 1 / (1 + d / 2)


SCALAR = {"dtw_distance": dtw_distance, "student_t_sf": student_t_sf, "student_t_p": student_t_p}
TABLE = {"periodogram": Periodogram, "cycles": Cycles, "change_points": ChangePoints, "matches": Matches}


def register(spark: SparkSession) -> None:
    """Adds the functions above to this session; doing so again changes nothing."""
    for name, f in SCALAR.items():
        spark.udf.register(name, F.pandas_udf(f, "double"))
    for name, kind in TABLE.items():
        spark.udtf.register(name, kind)
