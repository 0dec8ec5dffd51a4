"""Regular series out of events, and their repair.

A series is (entity, ts, idx, value): idx counts an entity's rows from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "entity"


def by_time(*columns: str) -> Window:
    return Window.partitionBy(KEY).orderBy(*(columns or ("idx",)))


def apart(df: DataFrame) -> DataFrame:
    """The same rows with columns of their own: for the second side of a cogroup, where both may come from one table."""
    return df.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(df.columns))).toDF(*df.columns)


def numbered(df: DataFrame, order: str = "ts") -> DataFrame:
    return df.withColumn("idx", (F.row_number().over(by_time(order)) - 1).cast("long"))


def daily(events: DataFrame, entity: Column, ts: Column, value: Column | None = None) -> DataFrame:
    """One row for each entity and calendar day between its first and last event: the sum of value, or the count; 0 where nothing happened."""
    total = F.count("*").cast("double") if value is None else F.sum("value")
    picked = events.select(entity.alias(KEY), F.to_date(ts).alias("ts"), *([] if value is None else [value.alias("value")])).where(F.col("ts").isNotNull())
    found = picked.groupBy(KEY, "ts").agg(total.alias("value"))
    spans = found.groupBy(KEY).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    calendar = spans.select(KEY, F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("ts"))
    return numbered(calendar.join(found, [KEY, "ts"], "left").withColumn("value", F.coalesce("value", F.lit(0.0))))


def interpolated(series: DataFrame) -> DataFrame:
    """Nulls and NaN by straight lines between neighbours in position; ends keep the nearest value; a series without values stays null."""
    v = F.when(~F.isnan("value"), F.col("value"))
    back, ahead = by_time().rowsBetween(Window.unboundedPreceding, 0), by_time().rowsBetween(0, Window.unboundedFollowing)
    at = F.when(v.isNotNull(), F.col("idx"))
    df = series.withColumns({"_v0": F.last(v, True).over(back), "_i0": F.last(at, True).over(back), "_v1": F.first(v, True).over(ahead), "_i1": F.first(at, True).over(ahead)})
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("idx") - F.col("_i0")) / F.nullif(F.col("_i1") - F.col("_i0"), F.lit(0))
    return df.withColumn("value", F.coalesce(v, line, "_v0", "_v1")).drop("_v0", "_i0", "_v1", "_i1")


def filled(series: DataFrame) -> DataFrame:
    """Infinities become the entity's largest and smallest finite value; nulls and NaN the value before, else the one after."""
    whole = Window.partitionBy(KEY)
    finite = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    v = F.when(F.col("value") == float("inf"), F.max(finite).over(whole)).when(F.col("value") == float("-inf"), F.min(finite).over(whole)).when(~F.isnan("value"), F.col("value"))
    df = series.withColumn("_v", v)
    before, after = F.last("_v", True).over(by_time().rowsBetween(Window.unboundedPreceding, 0)), F.first("_v", True).over(by_time().rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("value", F.coalesce(before, after)).drop("_v")


def detrended(series: DataFrame) -> DataFrame:
    """Residuals of each entity's least-squares line over idx."""
    whole = Window.partitionBy(KEY)
    x, y = F.col("idx").cast("double"), F.col("value")
    slope = F.coalesce(F.covar_pop(x, y).over(whole) / F.nullif(F.var_pop(x).over(whole), F.lit(0.0)), F.lit(0.0))
    return series.withColumns({"_s": slope, "_mx": F.avg(x).over(whole), "_my": F.avg(y).over(whole)}).withColumn("value", y - F.col("_my") - F.col("_s") * (x - F.col("_mx"))).drop("_s", "_mx", "_my")


def asof(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Left rows with the last values of right (entity, ts, columns) at or before them: one sort of both, no join."""
    l = left.withColumns({c: F.lit(None).cast(right.schema[c].dataType) for c in columns}).withColumn("_right", F.lit(0))
    r = right.select(KEY, "ts", *columns).withColumn("_right", F.lit(-1))
    w = Window.partitionBy(KEY).orderBy("ts", "_right").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True).withColumns({c: F.last(c, True).over(w) for c in columns})
    return both.where("_right = 0").drop("_right")


def asof_shared(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """As `asof`, where one series (ts, columns) holds for all entities: its last values are carried along the calendar of days, as many rows as there are days, and joined by day."""
    days = left.select(F.to_date("ts").alias("_day")).distinct().unionByName(right.select(F.to_date("ts").alias("_day"))).distinct()
    known = right.groupBy(F.to_date("ts").alias("_day")).agg(*(F.max_by(c, "ts").alias(c) for c in columns))
    w = Window.partitionBy(F.lit(0)).orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)  # days alone
    carried = days.join(known, "_day", "left").withColumns({c: F.last(c, True).over(w) for c in columns})
    return left.withColumn("_day", F.to_date("ts")).join(carried, "_day", "left").drop("_day")


def islands(df: DataFrame, flag: Column, order: str = "idx") -> DataFrame:
    """Runs of rows for which flag holds: entity, start, end (exclusive), length."""
    marked = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    run = F.col(order) - F.row_number().over(Window.partitionBy(KEY, "_f").orderBy(order))
    return marked.withColumn("_run", run).where("_f").groupBy(KEY, "_run").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end"), F.count("*").alias("length")).drop("_run")


def bursts(events: DataFrame, gap_days: int = 7, least: int = 3) -> DataFrame:
    """Runs of events of an entity at most gap_days (whole days, included) apart: start, end, n."""
    late = F.datediff("ts", F.lag("ts").over(by_time("ts"))) > gap_days
    run = F.sum(F.when(late, 1).otherwise(0)).over(by_time("ts").rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("_run", run).groupBy(KEY, "_run").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_run")
