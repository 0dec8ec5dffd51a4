"""Structural breaks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import t_two_sided
from .series import KEY
from .spectral import hash_of


class Cost:
    """The cost of a segment [i, j): l2 and normal in constant time; rbf, a kernel with bandwidth 1 on values, by summing its rows."""

    def __init__(self, x: np.ndarray, model: str):
        self.model, self.x = model, x
        self.s, self.q = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(x * x)])

    def __call__(self, i, j):
        n = j - i
        if self.model == "rbf":
            part = self.x[i:j]
            return n - sum(np.exp(-0.5 * (part - v) ** 2).sum() for v in part) / n
        sse = np.maximum(self.q[j] - self.q[i] - (self.s[j] - self.s[i]) ** 2 / n, 0)
        return sse if self.model == "l2" else n * np.log(sse / n + 1e-10)


class _Running:
    """Kernel sums of [i, t) for all starts i while t grows by one: a number a start, no matrix."""

    def __init__(self, x: np.ndarray):
        self.x, self.sums, self.t = x, np.zeros(len(x)), 0

    def __call__(self, starts: np.ndarray, t: int, low: int) -> np.ndarray:
        """The costs of [starts, t); starts below `low` are asked for no more."""
        while self.t < t:
            near = np.exp(-0.5 * (self.x[low : self.t + 1] - self.x[self.t]) ** 2)
            self.sums[low : self.t + 1] += 2 * near[::-1].cumsum()[::-1] - near[-1]
            self.t += 1
        n = t - starts
        return n - self.sums[starts] / n


def pelt(x: np.ndarray, model: str = "l2", penalty: float = 10.0, least: int = 5) -> list[int]:
    """The breaks that minimise the sum of costs and penalties, exactly.

    A start that is beaten at t by one at t itself can't win any end from
    t + least on, since [t, end) must have `least` rows; it is kept until then.
    """
    n = len(x)
    if n < 2 * least:
        return []
    running = _Running(x) if model == "rbf" else None
    cost = None if running else Cost(x, model)
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    alive, until = np.array([0]), np.array([n + 1])
    for t in range(least, n + 1):
        k = int(np.searchsorted(alive, t - least, "right"))
        ready = alive[:k]
        total = best[ready] + (running(ready, t, int(alive[0])) if running else cost(ready, t))
        won = int(total.argmin())
        best[t], back[t] = total[won] + penalty, ready[won]
        until[:k][total > best[t]] = np.minimum(until[:k][total > best[t]], t + least)
        stays = until > t + 1
        alive, until = np.append(alive[stays], t), np.append(until[stays], n + 1)
    out, t = [], n
    while back[t] > 0:
        t = back[t]
        out.append(int(t))
    return out[::-1]


def binary_segmentation(x: np.ndarray, penalty: float = 10.0, least: int = 5, most: int = 10) -> list[int]:
    """First in, first out: a segment is split where its variance exceeds its parts' (weighted) by most, if by more than the penalty."""
    todo, out = [(0, len(x))], []
    while todo and len(out) < most:
        lo, hi = todo.pop(0)
        n = hi - lo
        if n < 2 * least:
            continue
        cost = Cost(x[lo:hi], "l2")
        at = np.arange(least, n - least)
        if not len(at):
            continue
        gain = cost(0, n) / n - (cost(np.zeros_like(at), at) + cost(at, np.full_like(at, n))) / n
        k = int(gain.argmax())
        if gain[k] > penalty:
            cut = lo + int(at[k])
            out.append(cut)
            todo += [(lo, cut), (cut, hi)]
    return sorted(out)


def cusum(x: np.ndarray, threshold: float = 5.0, least: int = 5) -> list[int]:
    """Alarms where a sum of z-scores, kept from below or above zero, passes the threshold; it starts anew at an alarm."""
    sd = x.std()
    z = (x - x.mean()) / (sd + 1e-10)
    up = down = 0.0
    out: list[int] = []
    for i, v in enumerate(z):
        up, down = max(0.0, up + v), min(0.0, down + v)
        if up > threshold or down < -threshold:
            if not out or i - out[-1] >= least:
                out.append(i)
            up = down = 0.0
    return out


METHODS = {"pelt", "binseg", "cusum"}


def _breaks(x: np.ndarray, method: str, model: str, penalty: float, least: int) -> list[int]:
    return pelt(x, model, penalty, least) if method == "pelt" else binary_segmentation(x, penalty, least) if method == "binseg" else cusum(x, 5.0, least)


def _p(x: np.ndarray, at: int, width: int = 10) -> float:
    a, b = x[max(0, at - width) : at], x[at : at + width]
    if len(a) < 2 or len(b) < 2:
        return 0.5
    df = len(a) + len(b) - 2
    pooled = (a.var(ddof=1) * (len(a) - 1) + b.var(ddof=1) * (len(b) - 1)) / df
    if pooled <= 0:
        return float(a.mean() == b.mean())
    return t_two_sided((a.mean() - b.mean()) / math.sqrt(pooled * (1 / len(a) + 1 / len(b))), df)


def _known(method: str, model: str) -> None:
    if method not in METHODS or model not in ("l2", "normal", "rbf"):
        raise ValueError(f"unknown method or model: {method}, {model}")


def breaks_with_confidence(x: np.ndarray, method: str = "pelt", model: str = "l2", penalty: float = 10.0, least: int = 5, scaled: bool = False) -> list[tuple[int, float]]:
    """The breaks of one series, each with 1 - p of a t-test of ten rows on either side."""
    _known(method, model)
    y = (x - x.mean()) / (x.std() + 1e-10) if scaled else x
    return [(c, 1 - _p(x, c)) for c in _breaks(y, method, model, penalty, least)]


def detect(series: DataFrame, method: str = "pelt", model: str = "l2", penalty: float = 10.0, least: int = 5, scaled: bool = False) -> DataFrame:
    """Breaks of each entity: idx of the first row after it, and confidence (1 - p of a t-test of ten rows on either side)."""
    _known(method, model)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx", ignore_index=True)
        found = breaks_with_confidence(g["value"].to_numpy(float), method, model, penalty, least, scaled)
        return g.iloc[[c for c, _ in found]][[KEY, "idx"]].assign(confidence=np.array([p for _, p in found], float))

    kind = series.schema[KEY].dataType.simpleString()
    return series.select(KEY, "idx", "value").groupBy(KEY).applyInPandas(one, f"{KEY} {kind}, idx long, confidence double")


def segments(series: DataFrame, breaks: DataFrame) -> DataFrame:
    """Each segment's start, end, length, mean, deviation, median, min, max and slope (0 if of one row)."""
    marked = series.join(breaks.select(KEY, "idx", F.lit(1).alias("_cut")), [KEY, "idx"], "left")
    seg = F.sum(F.coalesce("_cut", F.lit(0))).over(Window.partitionBy(KEY).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    g = marked.withColumn("segment", seg).groupBy(KEY, "segment")
    slope = F.coalesce(F.regr_slope("value", "idx"), F.lit(0.0))
    return g.agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("end"), F.count("*").alias("length"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.percentile("value", F.lit(0.5)).alias("median"), F.min("value").alias("min"), F.max("value").alias("max"), slope.alias("slope"))


def bootstrap(series: DataFrame, n: int = 50, method: str = "pelt", model: str = "l2", penalty: float = 10.0, least: int = 5, near: int = 2, seed: int = 42) -> DataFrame:
    """Of each break the share of n resampled series that have one within `near` rows: residuals are drawn anew within the segments, whose means stay."""

    def one(key, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx", ignore_index=True)
        x = g["value"].to_numpy(float)
        x = (x - x.mean()) / (x.std() + 1e-10)
        cuts = _breaks(x, method, model, penalty, least)
        r = np.random.default_rng([seed, hash_of(str(key[0])) % 2**32])
        hits = np.zeros(len(cuts))
        for _ in range(n if cuts else 0):
            y = np.concatenate([s.mean() + r.choice(s - s.mean(), len(s)) for s in np.split(x, cuts)])
            found = np.array(_breaks(y, method, model, penalty, least))
            hits += [bool(len(found)) and np.abs(found - c).min() <= near for c in cuts]
        return g.iloc[cuts][[KEY, "idx"]].assign(share=hits / n, consensus=hits / n > 0.5)

    kind = series.schema[KEY].dataType.simpleString()
    return series.select(KEY, "idx", "value").groupBy(KEY).applyInPandas(one, f"{KEY} {kind}, idx long, share double, consensus boolean")
