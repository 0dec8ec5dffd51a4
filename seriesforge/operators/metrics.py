"""Metrics of predictions and of returns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import KEY


def regression(df: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(y) - F.col(p)
    mse = F.avg(e * e)
    r2 = 1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))
    return df.agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(e)).alias("mae"), r2.alias("r2"), (F.avg(F.abs(e / (F.col(y) + 1e-8))) * 100).alias("mape"))


def classification(df: DataFrame, y: str, p: str) -> DataFrame:
    """Accuracy, and precision, recall and F1 weighted by class; a class never predicted counts 0."""
    cells = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).count()
    sides = cells.select(F.explode(F.array(F.struct(F.col("y").alias("c"), F.col("count").alias("ny"), F.lit(0).cast("long").alias("np")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("ny"), F.col("count").alias("np")))).alias("s"), F.when(F.col("y") == F.col("p"), F.col("count")).otherwise(0).alias("hit"))
    k = sides.groupBy("s.c").agg(F.sum("s.ny").alias("ny"), F.sum("s.np").alias("np"), (F.sum(F.when(F.col("s.ny") > 0, F.col("hit")).otherwise(0))).alias("tp"))
    zero = F.lit(0)
    pr, re = F.coalesce(F.col("tp") / F.nullif(F.col("np"), zero), F.lit(0.0)), F.coalesce(F.col("tp") / F.nullif(F.col("ny"), zero), F.lit(0.0))
    k = k.withColumns({"pr": pr, "re": re}).withColumn("f", F.coalesce(2 * F.col("pr") * F.col("re") / F.nullif(F.col("pr") + F.col("re"), F.lit(0.0)), F.lit(0.0)))
    n = F.sum("ny")
    return k.agg((F.sum("tp") / n).alias("accuracy"), *((F.sum(F.col(c) * F.col("ny")) / n).alias(name) for c, name in (("pr", "precision"), ("re", "recall"), ("f", "f1"))))


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the curve by ranks, from counts per score, so that no task sorts all rows."""
    c = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("neg"))
    slices = c.withColumn("b", F.floor(F.col("s")))
    whole = slices.groupBy("b").agg(F.sum("neg").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum("neg").over(Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    j = slices.withColumn("within", within).join(whole.select("b", "before"), "b")
    wins = F.sum(F.col("pos") * (F.col("before") + F.col("within") + F.col("neg") / 2))
    return j.agg((wins / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def trading(df: DataFrame, r: str = "r", risk_free: float = 0.0) -> DataFrame:
    """Of each entity's returns: Sharpe and Sortino by population deviation, win rate, profit factor."""
    x = F.col(r) - risk_free / 252
    down = F.stddev_pop(F.when(F.col(r) < 0, F.col(r)))
    year = math.sqrt(252)
    gain, loss = F.sum(F.when(F.col(r) > 0, F.col(r)).otherwise(0.0)), -F.sum(F.when(F.col(r) < 0, F.col(r)).otherwise(0.0))
    return df.groupBy(KEY).agg((F.avg(x) / (F.stddev_pop(x) + 1e-8) * year).alias("sharpe"), (F.avg(x) / (down + 1e-8) * year).alias("sortino"), F.avg(F.when(F.col(r) > 0, 1.0).otherwise(0.0)).alias("win_rate"), (gain / (loss + 1e-8)).alias("profit_factor"))


def drawdowns(df: DataFrame, r: str = "r") -> DataFrame:
    """Three measures of the worst fall: a, ratio on the product of 1 + r; b, absolute on the sum of r; c, ratio on 1 plus that sum."""
    w = Window.partitionBy(KEY).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    c = df.withColumns({"_p": F.exp(F.sum(F.ln(1 + F.col(r))).over(w)), "_s": F.sum(r).over(w)})
    c = c.withColumns({"_a": F.max("_p").over(w), "_b": F.max("_s").over(w)})
    return c.groupBy(KEY).agg(F.min((F.col("_p") - F.col("_a")) / F.col("_a")).alias("a"), F.max(F.col("_b") - F.col("_s")).alias("b"), F.max((F.col("_b") - F.col("_s")) / (F.abs(F.col("_b")) + 1e-8)).alias("c"))
