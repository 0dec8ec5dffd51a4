"""Similar windows of the past by dynamic time warping, and what followed them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from .series import KEY, by_time


def normalise(x: np.ndarray) -> np.ndarray:
    sd = x.std(-1, keepdims=True)
    return np.where(sd < 1e-8, 0.0, (x - x.mean(-1, keepdims=True)) / np.where(sd < 1e-8, 1, sd))


def dtw(one: np.ndarray, many: np.ndarray, limit: float = np.inf) -> np.ndarray:
    """Distances to each row of many, of one sequence or of a row for each: the root of the least sum of squared differences along a path. Rows whose every path passes `limit` are given up as infinite."""
    out = np.full(len(many), np.inf)
    live = np.arange(len(many))
    one, many = one.T, np.ascontiguousarray(many.T)  # places first: a step takes all sequences, side by side
    last = np.full((len(many) + 1, len(live)), np.inf)
    last[0] = 0.0
    for i in range(len(one)):
        cost = (many - one[i]) ** 2
        row = np.full((len(many) + 1, len(live)), np.inf)
        for j in range(len(many)):
            row[j + 1] = cost[j] + np.minimum(np.minimum(last[j + 1], last[j]), row[j])
        keep = row[1:].min(0) <= limit**2
        if not keep.all():
            live, row, many = live[keep], row[:, keep], many[:, keep]
            one = one[:, keep] if one.ndim > 1 else one
        last = row
        last[0] = np.inf
        if not len(live):
            return out
    out[live] = np.sqrt(last[-1])
    return out


def windows_like_last(x: np.ndarray, window: int, horizon: int, limit: float, distance: Callable[[np.ndarray, np.ndarray, float], np.ndarray] = dtw) -> list[tuple[int, float]]:
    """Start and distance of the windows, each with a full horizon after it, that are at most `limit` from the last one."""
    starts = np.arange(max(0, len(x) - window - horizon))
    found: list[tuple[int, float]] = []
    for lo in range(0, len(starts), 4096):
        part = starts[lo : lo + 4096]
        d = distance(normalise(x[-window:]), normalise(x[part[:, None] + np.arange(window)]), limit)
        found += [(int(s), float(v)) for s, v in zip(part, d, strict=True) if v <= limit]
    return found


def find(series: DataFrame, window: int = 30, horizon: int = 90, threshold: float = 0.7, max_distance: float | None = None, top: int = 10, distance: Callable[[np.ndarray, np.ndarray, float], np.ndarray] = dtw) -> DataFrame:
    """Of each entity the windows most like its last one, each with a full horizon after it: start, distance, similarity, confidence, rank.

    Entities shorter than a window, a horizon and one more window have none. `distance` takes a window, rows of windows
    and the limit beyond which a row doesn't count, and gives a number a row.
    """
    limit = min(2 * (1 / threshold - 1), max_distance if max_distance is not None else np.inf)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        found = windows_like_last(g.sort_values("idx")["value"].to_numpy(float), window, horizon, limit, distance)
        return pd.DataFrame([(g[KEY].iloc[0], s, d) for s, d in found], columns=[KEY, "start", "distance"])

    kind = series.schema[KEY].dataType.simpleString()
    m = series.select(KEY, "idx", "value").groupBy(KEY).applyInPandas(one, f"{KEY} {kind}, start long, distance double")
    m = m.withColumn("similarity", R.match_similarity(F.col("distance"))).where(F.col("similarity") >= threshold)
    m = m.withColumn("confidence", R.match_confidence(F.col("similarity"), F.col("distance"), window))
    return m.withColumn("rank", F.row_number().over(Window.partitionBy(KEY).orderBy(F.round("similarity", 9).desc(), "start"))).where(F.col("rank") <= top)


def outcomes(series: DataFrame, matches: DataFrame, window: int = 30, horizons: tuple[int, ...] = (30, 90), kind: str = "prices") -> DataFrame:
    """What followed each match: sum, mean, deviation, Sharpe ratio and worst fall of the returns of each horizon."""
    r: Column = F.col("value") if kind == "returns" else F.coalesce(F.col("value") / F.nullif(F.lag("value").over(by_time()), F.lit(0.0)) - 1, F.lit(0.0))
    rows = series.withColumn("r", r).select(KEY, "idx", "r")
    m = matches.select(KEY, "start", F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    j = m.withColumn("idx", F.explode(F.sequence(F.col("start") + window, F.col("start") + window + F.col("horizon") - 1))).join(rows, [KEY, "idx"])
    keys = [KEY, "start", "horizon"]
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("_c", F.exp(F.sum(F.ln(F.greatest(1 + F.col("r"), F.lit(1e-12)))).over(w))).withColumn("_m", F.max("_c").over(w))
    return j.groupBy(*keys).agg(F.sum("r").alias("total"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), F.coalesce(F.avg("r") / F.nullif(F.stddev_pop("r"), F.lit(0.0)), F.lit(0.0)).alias("sharpe"), F.min((F.col("_c") - F.col("_m")) / F.col("_m")).alias("max_drawdown"))


def predict(matches: DataFrame, outcomes_: DataFrame, horizon: int = 30) -> DataFrame:
    """The mean outcome by similarity, its confidence by the fixed formula and by mean similarity, and the number of matches."""
    j = matches.join(outcomes_.where(F.col("horizon") == horizon).select(KEY, "start", "total"), [KEY, "start"])
    n = F.count("*")
    a = j.groupBy(KEY).agg(n.alias("n"), (F.sum(F.col("total") * F.col("similarity")) / F.sum("similarity")).alias("predicted"), F.stddev_pop("total").alias("std"), F.avg("similarity").alias("mean_similarity"))
    steady = 0.3 * F.least(F.col("n") / 10, F.lit(1.0)) + 0.4 / (1 + F.col("std"))
    return a.select(KEY, "n", "predicted", (steady + 0.3 / F.col("n")).alias("confidence"), (steady + 0.3 * F.col("mean_similarity")).alias("confidence_by_similarity"))


def summary(matches: DataFrame, outcomes_: DataFrame, horizon: int = 30) -> DataFrame:
    """entity and text: how many matches there are, how like the best one is, and how many rose."""
    j = matches.join(outcomes_.where(F.col("horizon") == horizon).select(KEY, "start", "total"), [KEY, "start"])
    rose = 100.0 * F.sum((F.col("total") > 0).cast("int")) / F.count("*")
    text = F.format_string(f"%d matches, %.0f %% alike at best; within {horizon} rows %.0f %% of them rose", F.count("*"), 100 * F.max("similarity"), rose)
    return j.groupBy(KEY).agg(text.alias("text"))
