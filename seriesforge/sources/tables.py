"""The engine's inputs out of the star schema: panels, market data and trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series as S


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query of a relational database; partitionColumn, bounds and numPartitions in options split the read."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Daily order value of each priority."""
    return S.daily(table(spark, d, "orders"), F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Daily order value of each market segment."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return S.daily(o.join(c, o.o_custkey == c.c_custkey), F.col("c_mktsegment"), F.col("o_orderdate"), F.col("o_totalprice"))


def nations(spark: SparkSession, d: str) -> DataFrame:
    """Daily order value of each nation."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    named = o.join(c, o.o_custkey == c.c_custkey).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return S.daily(named, F.col("n_name"), F.col("o_orderdate"), F.col("o_totalprice"))


def market(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars of each return flag: high, low, close (the mean price), volume."""
    p = F.col("l_extendedprice")
    bars = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("entity"), F.to_date("l_shipdate").alias("ts")).agg(F.max(p).alias("high"), F.min(p).alias("low"), F.avg(p).alias("close"), F.sum("l_quantity").alias("volume"))
    return S.numbered(bars)


def trades(spark: SparkSession, d: str) -> DataFrame:
    """Events as trades: entity (user), ts, kind, amount."""
    return table(spark, d, "events").select(F.col("user_id").alias("entity"), "ts", F.col("event_type").alias("kind"), F.col("value").alias("amount"), "event_id")


PANEL = """d AS (SELECT o_orderpriority AS entity, CAST(o_orderdate AS DATE) AS ts, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
 cal AS (SELECT entity, CAST(unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS DATE) AS ts FROM d GROUP BY entity),
 panel AS (SELECT c.entity, c.ts, coalesce(d.v, 0) AS value, row_number() OVER (PARTITION BY c.entity ORDER BY c.ts) - 1 AS idx FROM cal c LEFT JOIN d ON c.entity = d.entity AND c.ts = d.ts)"""
MARKET = """b AS (SELECT l_returnflag AS entity, CAST(l_shipdate AS DATE) AS ts, max(l_extendedprice) AS high, min(l_extendedprice) AS low, avg(l_extendedprice) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2),
 market AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts) - 1 AS idx FROM b)"""
TRADES = "trades AS (SELECT user_id AS entity, ts, event_type AS kind, value AS amount, event_id FROM events)"
