"""Cycles: spectra, peaks, confidence, decomposition, forecast."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from .series import KEY, by_time, detrended, interpolated


def amplitudes(x: np.ndarray) -> np.ndarray:
    """2 / N |X_k| of each frequency k / N below N // 2."""
    return np.abs(np.fft.rfft(x))[: len(x) // 2] * 2 / len(x)


def straightened(x: np.ndarray) -> np.ndarray:
    """Without its least-squares line."""
    t = np.arange(len(x)) - (len(x) - 1) / 2
    return x - x.mean() - t * ((t @ x) / max(float(t @ t), 1e-300))


def peak_places(p: np.ndarray, height: float, prominence: float) -> list[int]:
    """Strict local maxima (middles of plateaus) of at least this height and prominence."""
    edge = np.flatnonzero(np.diff(p)) + 1
    lo = np.concatenate([[0], edge])
    hi = np.concatenate([edge, [len(p)]]) - 1
    up = np.zeros(len(lo), bool)
    up[1:-1] = (p[lo[1:-1]] > p[hi[:-2]]) & (p[lo[1:-1]] > p[lo[2:]])
    found = []
    for i in ((lo + hi) // 2)[up]:
        if p[i] >= height:
            left, right = np.flatnonzero(p[:i] > p[i]), np.flatnonzero(p[i + 1 :] > p[i])
            a = p[(left[-1] + 1 if len(left) else 0) : i + 1].min()
            b = p[i : (i + 1 + right[0] if len(right) else len(p))].min()
            if p[i] - max(a, b) >= prominence:
                found.append(int(i))
    return found


def confidence(strength: float, period: float, n: int) -> float:
    """As the rule of that name has it, for numbers. Fixed values."""
    plausible = 0.3 if period < 3 else 0.5 if period > n / 2 else 1.0
    return 0.5 * min(strength, 1) + 0.3 * min(n / period / 3, 1) + 0.2 * plausible


def periodogram(series: DataFrame) -> DataFrame:
    """Amplitude 2 / N |X_k| of each frequency k / N below N // 2, by one FFT for each entity's detrended series."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values("idx")["value"].to_numpy(float)
        return pd.DataFrame({KEY: g[KEY].iloc[0], "k": np.arange(len(x) // 2), "n": len(x), "power": amplitudes(x)})

    kind = series.schema[KEY].dataType.simpleString()
    return detrended(interpolated(series)).select(KEY, "idx", "value").groupBy(KEY).applyInPandas(one, f"{KEY} {kind}, k long, n long, power double")


def peaks(spectrum: DataFrame, height: float, prominence: float) -> DataFrame:
    """Strict local maxima (middles of plateaus) of at least this height and prominence."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("k", ignore_index=True)
        return g.iloc[peak_places(g["power"].to_numpy(), height, prominence)]

    return spectrum.groupBy(KEY).applyInPandas(one, spectrum.schema)


def cycles(series: DataFrame, min_strength: float = 0.1, min_confidence: float = 0.6, sampling: str = "daily") -> DataFrame:
    """Dominant cycles of each entity with at least 30 rows: period, strength, confidence, frequency, category."""
    long = series.groupBy(KEY).agg(F.count("*").alias("rows")).where("rows >= 30").select(KEY)
    p = peaks(periodogram(series.join(long, KEY, "left_semi")), min_strength, 0.5 * min_strength).where("k > 0")
    period = F.col("n") / F.col("k")
    c = p.select(KEY, period.alias("period_days"), F.col("power").alias("strength"), R.cycle_confidence(F.col("power"), period, F.col("n")).alias("confidence"), (F.col("k") / F.col("n")).alias("frequency"))
    return c.where(F.col("confidence") >= min_confidence).withColumn("category", R.sampled_period_category(F.col("period_days"), sampling))


def top(cycles_: DataFrame, k: int = 10) -> DataFrame:
    w = Window.partitionBy(KEY).orderBy(F.desc("strength"), "frequency")
    return cycles_.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _lines(rows: DataFrame, order: str, line: Column) -> DataFrame:
    """entity and text: a line for each row, in order."""
    told = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), line.alias("_l"))))
    return rows.groupBy(KEY).agg(F.array_join(F.transform(told, lambda r: r["_l"]), "\n").alias("text"))


def summary(cycles_: DataFrame, k: int = 5) -> DataFrame:
    """entity and text: the strongest cycles, a line each."""
    line = F.format_string("%d. %s: %.1f days, strength %.3f, confidence %.0f %%", "rank", "category", "period_days", "strength", 100 * F.col("confidence"))
    return _lines(top(cycles_, k), "rank", line)


def decompose(series: DataFrame, period: int = 21) -> DataFrame:
    """Additive trend, seasonal and residual: a centred moving average (its ends by a line through the `period` nearest trend points), and centred means of each phase."""
    h = period // 2
    inner = F.avg("value").over(by_time().rowsBetween(-h, h))
    if period % 2 == 0:
        inner = (F.sum("value").over(by_time().rowsBetween(1 - h, h - 1)) + 0.5 * (F.lag("value", h).over(by_time()) + F.lead("value", h).over(by_time()))) / period
    whole = Window.partitionBy(KEY)
    df = series.withColumn("_n", F.count("*").over(whole))
    core = (F.col("idx") >= h) & (F.col("idx") < F.col("_n") - h)
    df = df.withColumn("_t", F.when(core, inner))
    x, y = F.col("idx").cast("double"), F.col("_t")
    for name, near in (("_a", F.col("idx") < h + period), ("_b", F.col("idx") >= F.col("_n") - h - period)):
        px, py = F.when(near & y.isNotNull(), x), F.when(near, y)
        df = df.withColumn(f"{name}s", F.covar_pop(px, py).over(whole) / F.nullif(F.var_pop(px).over(whole), F.lit(0.0))).withColumn(f"{name}i", F.avg(py).over(whole) - F.coalesce(F.col(f"{name}s"), F.lit(0.0)) * F.avg(px).over(whole))
    line = lambda n: F.col(f"{n}i") + F.coalesce(F.col(f"{n}s"), F.lit(0.0)) * x
    df = df.withColumn("trend", F.coalesce(y, F.when(F.col("idx") < h, line("_a")).otherwise(line("_b"))))
    phase = F.avg(F.col("value") - F.col("trend")).over(Window.partitionBy(KEY, F.col("idx") % period))
    df = df.withColumn("_p", phase)
    first = F.avg(F.when(F.col("idx") < period, F.col("_p"))).over(whole)
    df = df.withColumn("seasonal", F.col("_p") - first)
    return df.withColumn("residual", F.col("value") - F.col("trend") - F.col("seasonal")).select(KEY, "idx", "value", "trend", "seasonal", "residual")


def forecast(series: DataFrame, found: DataFrame, horizon: int = 30) -> DataFrame:
    """The mean plus the five strongest cycles, phase left out, and 1.96 deviations of what the past leaves: step, forecast, lower, upper."""
    best = top(found, 5).select(KEY, "strength", "frequency")
    mean = series.groupBy(KEY).agg(F.avg("value").alias("mean"))
    wave = lambda t: F.sum(F.col("strength") * F.sin(2 * math.pi * F.col("frequency") * F.col(t)))
    past = series.select(KEY, "idx", "value").join(best, KEY).groupBy(KEY, "idx").agg(F.first("value").alias("value"), wave("idx").alias("w")).join(mean, KEY)
    spread = past.groupBy(KEY).agg(F.stddev_pop(F.col("value") - F.col("mean") - F.col("w")).alias("sd"), F.max("idx").alias("last"))
    ahead = best.join(spread, KEY).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("at", F.col("last") + F.col("step"))
    f = ahead.groupBy(KEY, "step").agg(wave("at").alias("w"), F.first("sd").alias("sd")).join(mean, KEY).withColumn("forecast", F.col("mean") + F.col("w"))
    return f.select(KEY, "step", "forecast", (F.col("forecast") - 1.96 * F.col("sd")).alias("lower"), (F.col("forecast") + 1.96 * F.col("sd")).alias("upper"))


def quick_cycles(series: DataFrame) -> DataFrame:
    """The first five peaks by frequency with height 0.05, of those with periods between 5 and 200."""
    p = peaks(periodogram(series), 0.05, 0.0).where("k > 0").withColumn("i", F.row_number().over(Window.partitionBy(KEY).orderBy("k"))).where("i <= 5")
    period = F.col("n") / F.col("k")
    return p.where((period > 5) & (period < 200)).select(KEY, F.round(period, 1).alias("period"), F.round("power", 3).alias("strength"), R.quick_period_category(period).alias("category"))


def cycle_significance(series: DataFrame, periods: DataFrame, n: int = 200, method: str = "shuffle", seed: int = 42) -> DataFrame:
    """Of each (entity, period): how often a series without order reaches the strength of its own, among n random ones (shuffled, or with random phases): p, z, null mean and deviation, 95th percentile."""

    def one(key, g: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values("idx")["value"].to_numpy(float)
        r = np.random.default_rng([seed, abs(hash_of(str(key[0]))) % 2**32])
        t = np.arange(len(x))
        rows = []
        x = x - np.polyval(np.polyfit(t, x, 1), t) if len(x) > 2 else x
        if method == "shuffle":
            null = np.stack([r.permutation(x) for _ in range(n)]) if len(x) else np.zeros((n, 0))
        else:
            size = np.abs(np.fft.rfft(x))
            null = np.fft.irfft(size * np.exp(2j * np.pi * r.random((n, len(size)))), len(x), axis=1)
        for period in wanted["period_days"] if len(x) else []:
            wave = np.exp(-2j * np.pi * t / period) * 2 / len(x)
            own, others = abs(x @ wave), np.abs(null @ wave)
            sd = others.std()
            rows.append((key[0], period, own, (1 + (others >= own).sum()) / (n + 1), (own - others.mean()) / sd if sd > 0 else 0.0, others.mean(), sd, np.percentile(others, 95)))
        return pd.DataFrame(rows, columns=[KEY, "period_days", "strength", "p", "z", "null_mean", "null_std", "null_p95"])

    kind = series.schema[KEY].dataType.simpleString()
    return series.groupBy(KEY).cogroup(periods.groupBy(KEY)).applyInPandas(one, f"{KEY} {kind}, period_days double, strength double, p double, z double, null_mean double, null_std double, null_p95 double")


def hash_of(text: str) -> int:
    """A hash that doesn't change between processes."""
    out = 1469598103934665603
    for b in text.encode():
        out = (out ^ b) * 1099511628211 % 2**64
    return out


def multiple_tests(p: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Which p-values of an entity stay significant by Bonferroni and by Benjamini and Hochberg; the values themselves aren't changed."""
    whole = Window.partitionBy(KEY)
    m = F.count("*").over(whole)
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy("p", "period_days"))
    df = p.withColumns({"_m": m, "_r": rank})
    cut = F.max(F.when(F.col("p") <= alpha * F.col("_r") / F.col("_m"), F.col("p"))).over(whole)
    return df.withColumns({"bonferroni": F.col("p") <= alpha / F.col("_m"), "fdr": F.coalesce(F.col("p") <= cut, F.lit(False))}).drop("_m", "_r")
