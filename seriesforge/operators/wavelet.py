"""Cycles in time: continuous wavelet transform."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from .series import KEY

#: Scales of a full scan. Fixed values.
SCALES = list(range(1, 365))
#: Centre frequencies in cycles a scale. Fixed values.
CENTRE = {"morlet": 0.8125, "mexican_hat": 0.25, "ricker": 0.25, "paul": 0.8125}


#: Half the width of a wavelet's support, and points of its tabulated integral. Fixed values.
REACH, POINTS = 8, 4096


def mother(name: str, t: np.ndarray) -> np.ndarray:
    if name in ("mexican_hat", "ricker"):
        return 2 / (math.sqrt(3) * math.pi**0.25) * (1 - t * t) * np.exp(-t * t / 2)
    return np.exp(-t * t / 2) * np.cos(5 * t)


def integral(name: str) -> np.ndarray:
    """The running integral of the wavelet over its support, at equally far points."""
    t = np.linspace(-REACH, REACH, POINTS)
    return np.cumsum(mother(name, t)) * (2 * REACH / (POINTS - 1))


def filter_of(table: np.ndarray, scale: float) -> np.ndarray:
    """The integrated wavelet at this scale, one value a row of the series, as differences of neighbours: what a coefficient weighs the rows around it with.

    The values between two points of the table are those of the earlier one. Small scales, too, keep the wavelet's area,
    which samples of the wavelet itself would not.
    """
    k = np.arange(int(2 * REACH * scale) + 1)
    g = table[np.minimum(np.floor(k * (POINTS - 1) / (2 * REACH * scale)).astype(int), POINTS - 1)][::-1]
    return -math.sqrt(scale) * np.diff(g, prepend=0.0, append=0.0)


def transform(x: np.ndarray, scales: np.ndarray, name: str) -> np.ndarray:
    """Coefficients of each scale and place: -sqrt(scale) times the differences of the series' convolution with the integrated wavelet, through the FFT."""
    n, out, table = len(x), np.empty((len(scales), len(x))), integral(name)
    longest = len(filter_of(table, max(scales))) if len(scales) else 0
    size = 1 << (n + longest).bit_length()
    spectrum = np.fft.rfft(x, size)
    for i, s in enumerate(scales):
        h = filter_of(table, s)
        full = np.fft.irfft(spectrum * np.fft.rfft(h, size), size)
        first = (len(h) - 3) // 2 + 1
        out[i] = full[first : first + n]
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    return (x - x.mean()) / x.std() if x.std() > 1e-8 else np.zeros(len(x))


def power(series: DataFrame, scales: list[int], name: str = "morlet") -> DataFrame:
    """Long form: entity, scale, period, idx, coefficient, power, of the z-scored series (zeros if it is constant)."""
    if name not in CENTRE:
        raise ValueError(f"unknown wavelet: {name}")
    s = np.array(sorted(scales), float)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        x = g["value"].to_numpy(float)
        c = transform(_scaled(x), s, name)
        return pd.DataFrame({KEY: g[KEY].iloc[0], "scale": np.repeat(s, len(x)), "period": np.repeat(s / CENTRE[name], len(x)), "idx": np.tile(g["idx"].to_numpy(), len(s)), "coefficient": c.ravel(), "power": (c**2).ravel()})

    kind = series.schema[KEY].dataType.simpleString()
    return series.select(KEY, "idx", "value").groupBy(KEY).applyInPandas(one, f"{KEY} {kind}, scale double, period double, idx long, coefficient double, power double")


def global_spectrum(p: DataFrame) -> DataFrame:
    return p.groupBy(KEY, "scale", "period").agg(F.avg("power").alias("power"))


def scale_average(p: DataFrame) -> DataFrame:
    return p.groupBy(KEY, "idx").agg(F.avg("power").alias("power"))


def ridges(p: DataFrame, least: float = 0.1) -> DataFrame:
    """Runs of a scale above its median plus deviation that last at least this share of the series."""
    edge = p.groupBy(KEY, "scale").agg((F.percentile("power", F.lit(0.5)) + F.stddev_pop("power")).alias("edge"), F.count("*").alias("n"))
    j = p.join(edge, [KEY, "scale"])
    above = j.where(F.col("power") > F.col("edge"))
    run = F.col("idx") - F.row_number().over(Window.partitionBy(KEY, "scale").orderBy("idx"))
    g = above.withColumn("run", run).groupBy(KEY, "scale", "period", "run").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("end"), F.count("*").alias("duration"), F.avg("power").alias("strength"), F.max("power").alias("max_strength"), F.first("n").alias("n"))
    return g.where(F.col("duration") >= F.floor(least * F.col("n"))).withColumn("persistence", F.col("duration") / F.col("n")).drop("run", "n")


def series_ridges(series: DataFrame, scales: list[int] = SCALES, name: str = "morlet", least: float = 0.1) -> DataFrame:
    """`ridges` of `power`, found where the coefficients are made: a row for each ridge and none for each coefficient."""
    if name not in CENTRE:
        raise ValueError(f"unknown wavelet: {name}")
    s = np.array(sorted(scales), float)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        idx, x, rows = g["idx"].to_numpy(), g["value"].to_numpy(float), []
        n = len(x)
        for scale, p in zip(s, transform(_scaled(x), s, name) ** 2, strict=True):
            above = np.concatenate([[False], p > np.median(p) + p.std(), [False]])
            turns = np.flatnonzero(above[1:] != above[:-1])
            for lo, hi in zip(turns[::2], turns[1::2], strict=True):
                if hi - lo >= math.floor(least * n):
                    part = p[lo:hi]
                    rows.append((g[KEY].iloc[0], scale, scale / CENTRE[name], idx[lo], idx[hi - 1] + 1, hi - lo, part.mean(), part.max(), (hi - lo) / n))
        return pd.DataFrame(rows, columns=[KEY, "scale", "period", "start", "end", "duration", "strength", "max_strength", "persistence"])

    kind = series.schema[KEY].dataType.simpleString()
    return series.select(KEY, "idx", "value").groupBy(KEY).applyInPandas(one, f"{KEY} {kind}, scale double, period double, start long, end long, duration long, strength double, max_strength double, persistence double")


def dominant(ridges_: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy(KEY).orderBy(F.desc("strength"), "scale", "start")
    df = ridges_.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("category", R.wavelet_period_category(F.col("period")))
    return df.withColumn("text", F.format_string("%s cycle of %.1f days, rows %d to %d", "category", "period", "start", "end"))


def quick(series: DataFrame, name: str = "morlet", k: int = 5) -> DataFrame:
    """The strongest ridges over all scales of a full scan."""
    return dominant(series_ridges(series, SCALES, name), k)


def cone(idx: Column, n: Column, name: str = "morlet", dt: float = 1.0) -> Column:
    return F.least(idx, n - 1 - idx) * dt * (math.sqrt(2) if name == "morlet" else 1.0)


def significant(p: DataFrame, series: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Power against that of red noise with the series' lag-1 correlation; the quantile of chi-square with 2 degrees is -2 ln alpha."""
    lag = series.withColumn("_b", F.lag("value").over(Window.partitionBy(KEY).orderBy("idx")))
    a = lag.groupBy(KEY).agg(F.coalesce(F.corr("value", "_b"), F.lit(0.0)).alias("a"))
    j = p.join(a, KEY)
    edge = (1 - F.col("a") ** 2) / (1 + F.col("a") ** 2 - 2 * F.col("a") * F.cos(2 * math.pi / F.col("scale"))) * (-2 * math.log(alpha)) / 2
    return j.withColumn("significant", F.col("power") > edge).drop("a")


def compare(wavelet: DataFrame, fourier: DataFrame, near: float = 3.0) -> DataFrame:
    """Periods that both find (within `near`), those that one finds alone, and their agreement."""
    w, f = wavelet.select(KEY, F.col("period").alias("w")).distinct(), fourier.select(KEY, F.col("period_days").alias("f")).distinct()
    pairs = w.join(f, KEY).where(F.abs(F.col("w") - F.col("f")) < near)
    sides = w.groupBy(KEY).agg(F.count("*").alias("nw")).join(f.groupBy(KEY).agg(F.count("*").alias("nf")), KEY, "full")
    both = pairs.groupBy(KEY).agg(F.count("*").alias("overlaps"), F.count_distinct("w").alias("w"), F.count_distinct("f").alias("f"))
    z = lambda c: F.coalesce(c, F.lit(0))
    j = sides.join(both, KEY, "left").select(KEY, z("overlaps").alias("overlaps"), (z("nw") - z("w")).alias("wavelet_unique"), (z("nf") - z("f")).alias("fourier_unique"), (z("overlaps") / F.greatest(z("nw"), z("nf"), F.lit(1))).alias("agreement"))
    return j.withColumn("text", F.when(F.col("overlaps") >= 3, "strong agreement").when(F.col("overlaps") >= 1, "moderate agreement").otherwise("no agreement"))
