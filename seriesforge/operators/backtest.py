"""Walk-forward backtests."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import drawdown, returns
from .series import KEY, by_time, islands


@dataclass(frozen=True)
class Config:
    train: int = 252
    test: int = 63
    step: int = 21
    expanding: bool = True
    cost: float = 0.001
    slippage: float = 0.0005
    stop: float | None = None
    take: float | None = None
    risk_free: float = 0.02


def net_returns(df: DataFrame, cost: float, slippage: float) -> DataFrame:
    """net: yesterday's signal times today's return, less what the change of signal costs; 0 on the first row."""
    before = F.lag("signal").over(by_time())
    return df.withColumn("net", F.coalesce(before * F.col("r") - F.abs(F.col("signal") - before) * (cost + slippage), F.lit(0.0)))


def windows(prices: DataFrame, c: Config) -> DataFrame:
    """Of each row the test windows that it is in, as the number of the window: train rows [lo, hi), test rows [hi, hi + test)."""
    n = F.count("*").over(Window.partitionBy(KEY))
    first = F.greatest(F.lit(0), F.floor((F.col("idx") - c.train - c.test) / c.step) + 1)
    last = F.floor((F.col("idx") - c.train) / c.step)
    ok = lambda k: (c.train + k * c.step <= F.col("idx")) & (F.col("idx") < c.train + k * c.step + c.test) & (c.train + k * c.step + c.test <= F.col("_n"))
    return prices.withColumn("_n", n).withColumn("windows", F.when(last >= first, F.filter(F.sequence(first, last), ok)).otherwise(F.array().cast("array<bigint>")))


def last_window(prices: DataFrame, c: Config) -> DataFrame:
    """Test windows overlap and the last one to write a row wins; rows in none have no window."""
    return windows(prices, c).withColumn("window", F.array_max("windows")).drop("windows", "_n")


def ma_signals(prices: DataFrame, c: Config, fast: int = 20, slow: int = 50) -> DataFrame:
    """The moving-average strategy: 1 or -1 as the mean of the train rows' last `fast` closes is above that of the last `slow`, held over the test window."""
    w = lambda n: by_time().rowsBetween(1 - n, 0)
    marks = prices.select(KEY, (F.col("idx") + 1).alias("at"), F.when(F.avg("price").over(w(fast)) > F.avg("price").over(w(slow)), 1.0).otherwise(-1.0).alias("s"))
    placed = last_window(prices, c).withColumn("at", c.train + F.col("window") * c.step)
    return placed.join(marks, [KEY, "at"], "left").withColumn("signal", F.coalesce("s", F.lit(0.0))).drop("s", "at")


def walk_forward(prices: DataFrame, c: Config, strategy: Callable[[pd.DataFrame, pd.DataFrame], pd.Series]) -> DataFrame:
    """Any strategy, given train and test rows of one entity and window (idx, price) and returning a signal for each test row; errors and missing signals are 0, signals are clipped to [-1, 1]."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx", ignore_index=True)
        signal = pd.Series(0.0, frame.index)
        at = c.train
        while at + c.test <= len(frame):
            lo = 0 if c.expanding else at - c.train
            test = frame.iloc[at : at + c.test]
            try:
                made = pd.Series(strategy(frame.iloc[lo:at], test)).fillna(0.0).clip(-1, 1)
                signal.iloc[at : at + c.test] = made.to_numpy()
            except Exception:  # a strategy that fails leaves its window as it was
                pass
            at += c.step
        return frame.assign(signal=signal)

    return prices.select(KEY, "idx", "price").groupBy(KEY).applyInPandas(one, f"{KEY} {prices.schema[KEY].dataType.simpleString()}, idx long, price double, signal double")


def stop_take(df: DataFrame, stop: float | None, take: float | None) -> DataFrame:
    """Net returns with a position's loss cut at stop and its gain at take: a sum since the signal changed, one fold over each entity's ordered rows."""
    rows = df.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("idx", "signal", "net"))).alias("xs"))
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(0.0).alias("signal"), F.lit(False).alias("out"), F.array().cast("array<double>").alias("made"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["signal"] != acc["signal"]
        cum0 = F.when(fresh, 0.0).otherwise(acc["cum"])
        out0 = ~fresh & acc["out"]
        cum = cum0 + x["net"]
        lo = (cum <= -stop) if stop is not None else F.lit(False)
        hi = (cum >= take) if take is not None else F.lit(False)
        made = F.when(out0, 0.0).when(lo, F.lit(-(stop or 0.0)) - cum0).when(hi, F.lit(take or 0.0) - cum0).otherwise(x["net"])
        return F.struct(F.when(out0, cum0).otherwise(cum).alias("cum"), x["signal"].cast("double").alias("signal"), (out0 | lo | hi).alias("out"), F.concat(acc["made"], F.array(made)).alias("made"))

    made = rows.select(KEY, "xs", F.aggregate("xs", start, step)["made"].alias("made"))
    return made.select(KEY, F.explode(F.arrays_zip("xs", "made")).alias("z")).select(KEY, F.col("z.xs.idx").alias("idx"), F.col("z.xs.signal").alias("signal"), F.col("z.made").alias("net"))


def metrics(df: DataFrame, c: Config = Config()) -> DataFrame:
    """One row for each entity out of (idx, signal, net)."""
    x = df.withColumns({"_curve": F.exp(F.sum(F.ln(1 + F.greatest(F.col("net"), F.lit(-0.999999)))).over(by_time().rowsBetween(Window.unboundedPreceding, 0))), "_turn": F.coalesce((F.col("signal") != F.lag("signal").over(by_time())).cast("int"), F.lit(0))})
    x = x.withColumn("_dd", drawdown(F.col("_curve")))
    r, zero = F.col("net"), F.lit(0.0)
    up, down = F.sum(F.when(r > 0, r).otherwise(0.0)), -F.sum(F.when(r < 0, r).otherwise(0.0))
    a = x.groupBy(KEY).agg(
        F.count("*").alias("n"), (F.max_by("_curve", "idx") - 1).alias("total_return"), (F.stddev_samp(r) * math.sqrt(252)).alias("volatility"), (F.stddev_samp(F.when(r < 0, r)) * math.sqrt(252)).alias("_down"), (-F.min("_dd")).alias("max_drawdown"),
        F.sum("_turn").alias("trades"), F.sum((r > 0).cast("int")).alias("_wins"), F.avg((r > 0).cast("int")).alias("win_rate_daily"), up.alias("_up"), down.alias("_loss"), F.avg(F.when(r > 0, r)).alias("avg_win"), F.avg(F.when(r < 0, r)).alias("avg_loss"), F.percentile(r, F.lit(0.05)).alias("var_95"),
    )
    tail = x.join(a.select(KEY, "var_95"), KEY).where(r <= F.col("var_95")).groupBy(KEY).agg(F.avg(r).alias("cvar_95"))
    longest = islands(x, F.col("_dd") < 0).groupBy(KEY).agg(F.max("length").alias("longest_drawdown"))
    div = lambda p, q: F.coalesce(p / F.nullif(q, zero), zero)
    a = a.withColumn("annual_return", F.pow(1 + F.col("total_return"), 252 / F.col("n")) - 1)
    over = F.col("annual_return") - c.risk_free
    a = a.withColumns({"sharpe": div(over, F.col("volatility")), "sortino": div(over, F.col("_down")), "calmar": div(F.col("annual_return"), F.col("max_drawdown")), "win_rate": F.coalesce(F.col("_wins") / F.nullif(F.col("trades"), F.lit(0)), zero), "profit_factor": div(F.col("_up"), F.col("_loss"))})
    return a.drop("_down", "_wins", "_up", "_loss").join(tail, KEY, "left").join(longest, KEY, "left").withColumn("longest_drawdown", F.coalesce("longest_drawdown", F.lit(0)))


def run(prices: DataFrame, c: Config = Config(), strategy: Callable | None = None) -> DataFrame:
    """Signals and net returns of each row; the moving-average strategy unless another is given."""
    made = ma_signals(prices, c) if strategy is None else walk_forward(prices, c, strategy)
    net = net_returns(made.withColumn("r", returns(F.col("price"))), c.cost, c.slippage)
    if c.stop is not None or c.take is not None:
        net = stop_take(net, c.stop, c.take)
    return net.select(KEY, "idx", "signal", "net")


def monte_carlo(nets: DataFrame, n: int = 100, block: int = 21, seed: int = 7) -> DataFrame:
    """Total returns of n series that each entity's blocks of net returns make when drawn with replacement: mean, deviation, 5th and 95th percentile.

    Draw j of replica k takes the block that a hash of (entity, k, j, seed) names, so the result doesn't depend on partitions.
    """
    blocks = nets.withColumn("b", F.floor(F.col("idx") / block)).groupBy(KEY, "b").agg(F.sum(F.ln(1 + F.greatest(F.col("net"), F.lit(-0.999999)))).alias("g"))
    counts = blocks.groupBy(KEY).agg(F.count("*").alias("m"))
    draws = counts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    draws = draws.withColumn("b", F.pmod(F.xxhash64(KEY, "k", "j", F.lit(seed)), F.col("m")))
    totals = draws.join(blocks, [KEY, "b"]).groupBy(KEY, "k").agg((F.exp(F.sum("g")) - 1).alias("total"))
    return totals.groupBy(KEY).agg(F.avg("total").alias("mean"), F.stddev_pop("total").alias("std"), F.percentile("total", F.lit(0.05)).alias("p5"), F.percentile("total", F.lit(0.95)).alias("p95"))
