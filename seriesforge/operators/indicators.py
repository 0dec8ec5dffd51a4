"""Features by window: indicators of price and volume, calendar features, risk curves."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import KEY, by_time


def frame(n: int) -> Window:
    return by_time().rowsBetween(1 - n, 0)


def full(agg: Column, of: Column, n: int) -> Column:
    """A rolling value once its window has n values."""
    return F.when(F.count(of).over(frame(n)) == n, agg.over(frame(n)))


def sma(x: Column, n: int) -> Column:
    return full(F.avg(x), x, n)


def volatility(x: Column, n: int = 20) -> Column:
    """Sample deviation of up to n rows; null for one."""
    return F.stddev_samp(x).over(frame(n))


def momentum(x: Column, n: int = 20) -> Column:
    return F.avg(x).over(frame(n))


def change(x: Column, n: int = 1) -> Column:
    return x - F.lag(x, n).over(by_time())


def returns(x: Column) -> Column:
    before = F.lag(x).over(by_time())
    return x / F.nullif(before, F.lit(0.0)) - 1


def with_rsi(df: DataFrame, column: str, n: int) -> DataFrame:
    """100 - 100 / (1 + mean gain / mean loss), simple means; the first row has no change."""
    d = F.coalesce(change(F.col(column)), F.lit(0.0))
    gain, loss = F.avg("_gain").over(frame(n)), F.avg("_loss").over(frame(n))
    value = F.when(loss == 0, F.when(gain > 0, 100.0)).otherwise(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))))
    made = df.withColumns({"_gain": F.greatest(d, F.lit(0.0)), "_loss": F.greatest(-d, F.lit(0.0))})
    return made.withColumn(f"rsi_{n}", F.when(F.count(F.lit(1)).over(frame(n)) == n, value)).drop("_gain", "_loss")


def bollinger(x: Column, n: int = 20, width: float = 2.0) -> dict[str, Column]:
    mid, sd = full(F.avg(x), x, n), full(F.stddev_samp(x), x, n)
    hi, lo = mid + width * sd, mid - width * sd
    return {"bb_middle": mid, "bb_upper": hi, "bb_lower": lo, "bb_width": (hi - lo) / F.nullif(mid, F.lit(0.0)), "price_to_bb": (x - lo) / F.nullif(hi - lo, F.lit(0.0))}


def with_atr(df: DataFrame, n: int = 14) -> DataFrame:
    before = F.lag("close").over(by_time())
    rng = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return df.withColumn("_tr", rng).withColumn(f"atr_{n}", full(F.avg("_tr"), F.col("_tr"), n)).drop("_tr")


def with_obv(df: DataFrame) -> DataFrame:
    step = F.coalesce(F.signum(change(F.col("close"))) * F.col("volume"), F.lit(0.0))
    return df.withColumn("_step", step).withColumn("obv", F.sum("_step").over(by_time().rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def ema(series: DataFrame, spans: dict[str, int], column: str = "value") -> DataFrame:
    """Exponential means e = a x + (1 - a) e', a = 2 / (span + 1), from the first value on: one fold over each entity's ordered values.

    An entity's values travel as one array, so this suits series, not event logs.
    """
    values = series.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("idx", F.col(column).alias("x")))).alias("xs"))
    start = F.array().cast("array<double>")

    def fold(a: float) -> Column:
        step = lambda acc, s: F.concat(acc, F.array(F.when(F.size(acc) == 0, s["x"]).otherwise(a * s["x"] + (1 - a) * F.element_at(acc, -1))))
        return F.aggregate("xs", start, step)

    made = values.select(KEY, "xs", *(fold(2 / (n + 1)).alias(c) for c, n in spans.items()))
    zipped = made.select(KEY, F.explode(F.arrays_zip("xs", *spans)).alias("r"))
    return zipped.select(KEY, F.col("r.xs.idx").alias("idx"), F.col("r.xs.x").alias(column), *(F.col(f"r.{c}").alias(c) for c in spans))


def macd(series: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    lines = ema(series, {"_fast": fast, "_slow": slow}).withColumn("macd", F.col("_fast") - F.col("_slow"))
    smooth = ema(lines.select(KEY, "idx", "macd"), {"macd_signal": signal}, "macd")
    return smooth.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))


def moments(x: Column, n: int) -> dict[str, Column]:
    """Sample-corrected rolling skewness and excess kurtosis of full windows."""
    c = F.count(x).over(frame(n)).cast("double")
    m1, m2, m3, m4 = (F.avg(F.pow(x, F.lit(k))).over(frame(n)) for k in (1, 2, 3, 4))
    v = m2 - m1 * m1
    third, fourth = m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1, m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1
    ok = (c == n) & (v > 1e-14)
    return {
        "skew": F.when(ok & (c > 2), F.sqrt(c * (c - 1)) / (c - 2) * third / F.pow(v, F.lit(1.5))),
        "kurtosis": F.when(ok & (c > 3), (c - 1) / ((c - 2) * (c - 3)) * ((c + 1) * fourth / (v * v) - 3 * (c - 1))),
    }


def trend(x: Column, n: int) -> Column:
    """Slope of the least-squares line over the last n rows."""
    i = F.col("idx").cast("double")
    return F.when(F.count(x).over(frame(n)) == n, F.covar_pop(i, x).over(frame(n)) / F.nullif(F.var_pop(i).over(frame(n)), F.lit(0.0)))


def rolling_beta(x: Column, market: Column, n: int) -> Column:
    return F.when(F.count(x).over(frame(n)) == n, F.covar_samp(x, market).over(frame(n)) / F.nullif(F.var_samp(market).over(frame(n)), F.lit(0.0)))


def forward_return(x: Column, n: int) -> Column:
    return F.lead(x, n).over(by_time()) / F.nullif(x, F.lit(0.0)) - 1


def skipped_momentum(x: Column, far: int = 252, near: int = 21) -> Column:
    return F.lag(x, near).over(by_time()) / F.nullif(F.lag(x, far).over(by_time()), F.lit(0.0)) - 1


def trades_last(days: int, ts: str = "ts") -> Column:
    """Events of the entity in the days up to this one's time, the far end left out."""
    w = Window.partitionBy(KEY).orderBy(F.unix_timestamp(F.col(ts).cast("timestamp"))).rangeBetween(-days * 86400 + 1, 0)
    return F.count("*").over(w)


def calendar(ts: Column) -> dict[str, Column]:
    """Features of a date; Monday is 0; phase counts years within four."""
    day = F.to_date(ts)
    dow, month, quarter, year = F.weekday(day), F.month(day), F.quarter(day), F.year(day)
    wave = lambda x, n: {"sin": F.sin(2 * math.pi * x / n), "cos": F.cos(2 * math.pi * x / n)}
    out = {"day_of_week": dow, "day_of_month": F.dayofmonth(day), "month": month, "quarter": quarter, "year": year}
    for name, x, n in (("dow", dow, 7), ("month", month, 12), ("quarter", quarter, 4), ("election", year % 4, 4)):
        out |= {f"{name}_{k}": v for k, v in wave(x, n).items()}
    return out | {
        "is_election_year": (year % 4 == 0).cast("int"),
        "election_phase": year % 4,
        "days_to_year_end": F.datediff(F.make_date(year, F.lit(12), F.lit(31)), day),
        "days_from_year_start": F.datediff(day, F.make_date(year, F.lit(1), F.lit(1))),
        "is_session": (month != 8).cast("int"),
    }


#: Month and day of fixed holidays, and of the ends of sessions. Fixed values.
HOLIDAYS = [(1, 1), (6, 19), (7, 4), (11, 11), (12, 25)]
SESSION_ENDS = [(7, 31), (12, 31)]


def days_to(day: Column, dates: list[tuple[int, int]]) -> Column:
    """Days to the next of these dates of the year, 0 on one."""
    year = F.year(day)
    at = lambda y, m, d: F.make_date(y, F.lit(m), F.lit(d))
    return F.datediff(F.least(*(F.when(at(year, m, d) >= day, at(year, m, d)).otherwise(at(year + 1, m, d)) for m, d in dates)), day)


def drawdown(curve: Column) -> Column:
    peak = F.max(curve).over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    return (curve - peak) / F.nullif(peak, F.lit(0.0))


def equity(r: Column) -> Column:
    """The product of 1 + r so far; r stays above -1."""
    return F.exp(F.sum(F.ln(1 + r)).over(by_time().rowsBetween(Window.unboundedPreceding, 0)))
