"""Data quality of series, returns and prices: one row for each entity, with issues, warnings and figures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import KEY, by_time


def _said(pairs: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*(F.when(when, F.lit(text)) for when, text in pairs)))


def series(df: DataFrame, min_length: int = 10, allow_nan: bool = False, allow_inf: bool = False, require_variance: bool = True, fix: bool = True) -> DataFrame:
    """Length, holes, infinities, variance; and of the times: repeats are an issue, disorder and gaps beyond five medians a warning. A share of holes under a tenth, and infinities beside finite values, are warnings if they will be repaired (fix), else issues."""
    v = F.col("value")
    hole = v.isNull() | F.isnan(v)
    finite = F.when(~hole & (F.abs(v) < float("inf")), v)
    gap = F.datediff("ts", F.lag("ts").over(by_time()))
    x = df.withColumns({"_gap": gap, "_hole": hole.cast("int"), "_inf": (F.abs(v) == float("inf")).cast("int"), "_v": finite})
    a = x.groupBy(KEY).agg(F.count("*").alias("n"), F.sum("_hole").alias("holes"), F.sum(F.coalesce("_inf", F.lit(0))).alias("infinite"), F.var_pop("_v").alias("variance"), F.sum((F.col("_gap") == 0).cast("int")).alias("repeats"), F.sum((F.col("_gap") < 0).cast("int")).alias("disorder"), F.percentile("_gap", F.lit(0.5)).alias("median_gap"), F.max("_gap").alias("longest_gap"))
    z = lambda c: F.coalesce(c, F.lit(0))
    few = (F.col("holes") < 0.1 * F.col("n")) & F.lit(fix)
    spared = (F.col("infinite") < F.col("n")) & F.lit(fix)
    issues = _said([(F.col("n") < min_length, "too short"), (F.lit(not allow_nan) & (F.col("holes") > 0) & ~few, "too many missing values"), (F.lit(not allow_inf) & (F.col("infinite") > 0) & ~spared, "infinite values"), (F.lit(require_variance) & (z("variance") < 1e-10), "no variance"), (z("repeats") > 0, "repeated times")])
    warnings = _said([(F.lit(not allow_nan) & (F.col("holes") > 0) & few, "missing values filled"), (F.lit(not allow_inf) & (F.col("infinite") > 0) & spared, "infinite values clipped"), (z("disorder") > 0, "times out of order"), (F.col("longest_gap") > 5 * F.col("median_gap"), "long gaps")])
    return a.select(KEY, (F.size(issues) == 0).alias("is_valid"), issues.alias("issues"), warnings.alias("warnings"), "n", "holes", "infinite", "variance", "longest_gap")


def adf(x: np.ndarray, lags: int | None = None) -> tuple[float, float]:
    """The augmented Dickey-Fuller statistic with a constant, and the 5 % critical value of its response surface. Fixed values."""
    n = len(x)
    lags = int(12 * (n / 100) ** 0.25) if lags is None else lags
    d = np.diff(x)
    if len(d) <= 2 * lags + 3:
        return float("nan"), float("nan")
    y = d[lags:]
    cols = [x[lags:-1], np.ones(len(y))] + [d[lags - k : len(d) - k] for k in range(1, lags + 1)]
    a = np.column_stack(cols)
    coef, *_ = np.linalg.lstsq(a, y, rcond=None)
    rest = y - a @ coef
    var = rest @ rest / max(1, len(y) - a.shape[1]) * np.linalg.pinv(a.T @ a)[0, 0]
    m = len(y)
    return float(coef[0] / np.sqrt(max(var, 1e-300))), -2.86154 - 2.8903 / m - 4.234 / m**2 - 40.04 / m**3


def returns(df: DataFrame, largest: float = 0.5) -> DataFrame:
    """At least 30; extremes, skewness beyond 3, excess kurtosis beyond 10 and, from 50 rows on, no sign of being stationary are warnings."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values("idx")["value"].dropna().to_numpy(float)
        stat, edge = adf(x) if len(x) >= 50 else (float("nan"), float("nan"))
        return pd.DataFrame({KEY: [g[KEY].iloc[0]], "adf": stat, "adf_5pct": edge})

    kind = df.schema[KEY].dataType.simpleString()
    unit = df.select(KEY, "idx", "value").groupBy(KEY).applyInPandas(one, f"{KEY} {kind}, adf double, adf_5pct double")
    v = F.col("value")
    a = df.groupBy(KEY).agg(F.count(v).alias("n"), F.sum((F.abs(v) > largest).cast("int")).alias("extremes"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis")).join(unit, KEY)
    issues = _said([(F.col("n") < 30, "fewer than 30 returns")])
    warnings = _said([(F.col("extremes") > 0, "extreme returns"), (F.abs("skew") > 3, "skewed"), (F.col("kurtosis") > 10, "heavy tails"), ((F.col("n") >= 50) & (F.col("adf") > F.col("adf_5pct")), "maybe not stationary")])
    return a.select(KEY, (F.size(issues) == 0).alias("is_valid"), issues.alias("issues"), warnings.alias("warnings"), "n", "extremes", "skew", "kurtosis", "adf")


def prices(df: DataFrame) -> DataFrame:
    """Values of 0 or less are an issue; over a tenth of days without change, and jumps over a half, warnings."""
    before = F.lag("value").over(Window.partitionBy(KEY).orderBy("idx"))
    x = df.withColumns({"_d": F.col("value") - before, "_j": F.abs(F.col("value") / F.nullif(before, F.lit(0.0)) - 1)})
    a = x.groupBy(KEY).agg(F.count("*").alias("n"), F.sum((F.col("value") <= 0).cast("int")).alias("negative"), F.avg((F.col("_d") == 0).cast("int")).alias("stale"), F.sum((F.col("_j") > 0.5).cast("int")).alias("jumps"))
    issues = _said([(F.col("negative") > 0, "prices of 0 or less")])
    warnings = _said([(F.col("stale") > 0.1, "stale prices"), (F.coalesce("jumps", F.lit(0)) > 0, "large jumps")])
    return a.select(KEY, (F.size(issues) == 0).alias("is_valid"), issues.alias("issues"), warnings.alias("warnings"), "n", "negative", "stale", F.coalesce("jumps", F.lit(0)).alias("jumps"))


def repaired(df: DataFrame, most: float = 0.1) -> DataFrame:
    """Series (entity, ts, idx, value) with `was`: holes take the value before them, at the start the one behind, where they are less than `most` of an entity's rows; then infinities take its greatest or least finite value. was: "filled", "clipped", or null."""
    v = F.col("value")
    hole, whole = v.isNull() | F.isnan(v), Window.partitionBy(KEY)
    known = F.when(~hole, v)
    before, ahead = by_time().rowsBetween(Window.unboundedPreceding, 0), by_time().rowsBetween(0, Window.unboundedFollowing)
    few = F.sum(hole.cast("int")).over(whole) < most * F.count("*").over(whole)
    filled = F.when(hole & few, F.coalesce(F.last(known, True).over(before), F.first(known, True).over(ahead))).otherwise(v)
    finite = F.when(~hole & (F.abs(v) < float("inf")), v)
    x = df.withColumns({"_hole": hole & few, "_v": filled, "_lo": F.min(finite).over(whole), "_hi": F.max(finite).over(whole)})
    big = (F.abs("_v") == float("inf")) & F.col("_hi").isNotNull()
    clipped = F.when(big, F.when(F.col("_v") > 0, F.col("_hi")).otherwise(F.col("_lo"))).otherwise(F.col("_v"))
    was = F.when(F.coalesce(F.abs("value") == float("inf"), F.lit(False)) & big, "clipped").when(F.col("_hole") & F.col("_v").isNotNull(), "filled")
    return x.withColumns({"was": was, "value": clipped}).drop("_hole", "_v", "_lo", "_hi")


def validated(df: DataFrame, fix: bool = True, **rules) -> DataFrame:
    """The rows of the entities that pass, repaired if fix says so; use as df.transform(validated)."""
    passed = series(df, fix=fix, **rules).where("is_valid").select(KEY)
    return (repaired(df).drop("was") if fix else df).join(passed, KEY, "left_semi")


class ValidationError(ValueError):
    """Series that don't pass."""


def quick(df: DataFrame, min_length: int = 10, raise_on_error: bool = True) -> DataFrame:
    """`series` with all else as it is; ValidationError, with the issues of the first ten entities, if one doesn't pass."""
    found = series(df, min_length)
    if raise_on_error:
        bad = found.where(~F.col("is_valid")).orderBy(KEY).select(KEY, "issues").limit(10).collect()
        if bad:
            raise ValidationError("; ".join(f"{r[0]}: {', '.join(r['issues'])}" for r in bad))
    return found
