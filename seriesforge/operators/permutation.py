"""Tests by permutation, whose shuffles are rows: a replica orders an entity's rows by the md5 of (seed, entity, replica, row).

No random generator takes part, so any engine that has md5 repeats the shuffles,
and every statistic is an aggregate of the replica's rows. An entity and a replica
make a group of as many rows as the entity has. Only PARTS copies of the rows are
shuffled: a task makes the replicas of an entity and part where their groups are
formed. No replica takes part in a join, since an engine that judges a table by
what it shuffled would send such rows to all tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import KEY, detrended

METRICS = ("variance_ratio", "mean_difference", "log_likelihood")
#: So many groups of replicas are dealt out for each entity.
PARTS = 128


def shuffled(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Each row n + 1 times, with the place it takes in every replica; replica 0 is the order as it is. rows: entity, idx and others, idx counting from 0.

    The result is dealt out by entity and part (a number that follows from the replica): what groups by these two and more needs no shuffle.
    """
    parts = min(n + 1, PARTS)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number stays: these rows are few, their replicas are not
    dealt = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(tasks, KEY, "part")
    every = dealt.withColumn("replica", F.explode(F.sequence(F.col("part"), F.lit(n), F.lit(parts))))
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(KEY).cast("string"), F.col("replica").cast("string"), F.col("idx").cast("string")))
    order = Window.partitionBy(KEY, "part", "replica").orderBy(F.when(F.col("replica") > 0, drawn), "idx")
    return every.withColumn("place", F.row_number().over(order) - 1)


def _against_null(stats: DataFrame, keys: list[str], two_sided: bool = False) -> DataFrame:
    """Of (keys, replica, x) replica 0's value and how the others lie around it."""
    size = F.abs("x") if two_sided else F.col("x")
    own = F.max(F.when(F.col("replica") == 0, F.col("x"))).over(Window.partitionBy(*keys))
    df = stats.withColumn("own", own).withColumn("reached", size >= (F.abs("own") if two_sided else F.col("own"))).where("replica > 0")
    g = df.groupBy(*keys).agg(
        F.first("own").alias("own"),
        ((1 + F.sum(F.col("reached").cast("int"))) / (1 + F.count("*"))).alias("p"),
        F.avg("x").alias("null_mean"),
        F.stddev_pop("x").alias("null_std"),
        F.percentile("x", F.lit(0.95)).alias("null_p95"),
    )
    z = F.when(F.col("null_std") > 0, (F.col("own") - F.col("null_mean")) / F.col("null_std")).otherwise(0.0)
    return g.withColumn("z", z)


def _statistic(metric: str, m: Column) -> Column:
    """Of the states' counts, sums and sums of squares (an array of structs by state), and the mean of all."""
    states = F.col("states")
    total = F.aggregate(states, F.lit(0.0), lambda a, s: a + s["n"])
    add = lambda f: F.aggregate(states, F.lit(0.0), lambda a, s: a + f(s))
    if metric == "variance_ratio":
        between = add(lambda s: s["n"] * F.pow(s["s"] / s["n"] - m, 2.0))
        within = add(lambda s: s["q"] - s["s"] * s["s"] / s["n"])
        return (between / total) / (within / total + 1e-10)
    if metric == "mean_difference":
        means = F.transform(states, lambda s: s["s"] / s["n"])
        steps = F.transform(F.sequence(F.lit(1), F.size(means) - 1), lambda i: F.abs(F.get(means, i) - F.get(means, i - 1)))
        return F.when(F.size(means) < 2, 0.0).otherwise(F.array_max(steps))
    return add(lambda s: -0.5 * s["n"] * (F.ln(2 * math.pi * (F.greatest(s["q"] / s["n"] - F.pow(s["s"] / s["n"], 2.0), F.lit(0.0)) + 1e-12)) + 1))


def separation(rows: DataFrame, value: str = "ret", state: str = "state", n: int = 1000, metrics: tuple[str, ...] = ("variance_ratio",), seed: int = 42) -> DataFrame:
    """How well states part an entity's values, against n shuffles of the states: a row for each metric with the statistic, its two-sided p, and the null's mean and deviation.

    variance_ratio: between states over within; mean_difference: the largest one between neighbouring states;
    log_likelihood: of normal values, given the states.
    """
    if set(metrics) - set(METRICS):
        raise ValueError(f"unknown metrics: {sorted(set(metrics) - set(METRICS))}")
    number = (F.row_number().over(Window.partitionBy(KEY).orderBy("idx")) - 1).alias("idx")
    base = rows.select(KEY, number, F.col(value).cast("double").alias("v"), F.col(state).alias("state"))
    keys = [KEY, "part", "replica"]
    value_here = F.struct(F.col("place").alias("at"), F.col("v"), F.lit(None).cast(base.schema["state"].dataType).alias("state"))
    state_here = F.struct(F.col("idx").alias("at"), F.lit(None).cast("double").alias("v"), F.col("state"))
    moved = shuffled(base, n, seed).select(*keys, F.inline(F.array(value_here, state_here))).groupBy(*keys, "at").agg(F.max("v").alias("v"), F.max("state").alias("state"))
    per = moved.groupBy(*keys, "state").agg(F.count("*").cast("double").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    by = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("state", "n", "s", "q"))).alias("states"), (F.sum("s") / F.sum("n")).alias("m"))
    each = F.array(*(F.struct(F.lit(m).alias("metric"), _statistic(m, F.col("m")).alias("x")) for m in metrics))
    stats = by.select(KEY, "replica", F.inline(each))
    return _against_null(stats, [KEY, "metric"], True).select(KEY, "metric", F.col("own").alias("statistic"), "p", "null_mean", "null_std")


def cycle_significance(series: DataFrame, periods: DataFrame, n: int = 1000, seed: int = 42) -> DataFrame:
    """Of each (entity, period_days): the strength of that cycle in the detrended series, and how often n shuffles of it reach as much: strength, p, z, null_mean, null_std, null_p95."""
    x = detrended(series).select(KEY, "idx", F.col("value").alias("v"))
    wanted = periods.groupBy(KEY).agg(F.collect_set("period_days").alias("periods"))
    moved = shuffled(x.join(wanted, KEY), n, seed).select(KEY, "part", "replica", "place", "v", F.explode("periods").alias("period_days"))
    turn = 2 * math.pi * F.col("place") / F.col("period_days")
    sums = moved.groupBy(KEY, "part", "replica", "period_days").agg(F.sum(F.col("v") * F.cos(turn)).alias("c"), F.sum(F.col("v") * F.sin(turn)).alias("s"), F.count("*").alias("n"))
    stats = sums.select(KEY, "period_days", "replica", (2 / F.col("n") * F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s"))).alias("x"))
    return _against_null(stats, [KEY, "period_days"]).select(KEY, "period_days", F.col("own").alias("strength"), "p", "z", "null_mean", "null_std", "null_p95")
