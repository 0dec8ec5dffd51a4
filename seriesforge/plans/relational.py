"""Scans, predicates, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import series as S
from ..sources.tables import MARKET, PANEL, TRADES, market, panel, table, trades
from .registry import query, rounded


@query(f"WITH {PANEL} SELECT entity, ts, idx, round(value, 4) AS value FROM panel")
def daily_counts(spark, d):
    return panel(spark, d).select("entity", "ts", "idx", F.round("value", 4).alias("value"))


@query("SELECT c_name AS name, n_name AS party, o_orderdate AS transaction_date, o_orderstatus AS transaction_type, round(o_totalprice, 6) AS amount FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def scan_trades(spark, d):
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.select(F.col("c_name").alias("name"), F.col("n_name").alias("party"), F.col("o_orderdate").alias("transaction_date"), F.col("o_orderstatus").alias("transaction_type"), F.round("o_totalprice", 6).alias("amount"))


@query("SELECT c_name AS name, o_orderdate AS transaction_date, o_totalprice AS amount FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name = 'Customer#000000007'")
def scan_trades_quick(spark, d):
    df = spark.sql("SELECT c_name AS name, o_orderdate AS transaction_date, o_totalprice AS amount FROM {o} JOIN {c} ON o_custkey = c_custkey WHERE c_name = :who", args={"who": "Customer#000000007"}, o=table(spark, d, "orders"), c=table(spark, d, "customer"))
    return df


@query("SELECT DISTINCT c_name AS name FROM customer JOIN orders ON o_custkey = c_custkey")
def scan_entities(spark, d):
    o, c = table(spark, d, "orders").select("o_custkey"), table(spark, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select(F.col("c_name").alias("name")).distinct()


@query("SELECT o_orderkey, round((o_totalprice * 0.5 + o_totalprice * 1.5) / 2, 4) AS amount FROM orders")
def mid_amount(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(R.mid_amount(F.col("o_totalprice") * 0.5, F.col("o_totalprice") * 1.5), 4).alias("amount"))


@query("SELECT user_id AS entity, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE user_id = 1 GROUP BY 1")
def filter_entity(spark, d):
    return trades(spark, d).where("entity = 1").groupBy("entity").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 4).alias("total"))


_BANDS = "CASE WHEN {x} BETWEEN 3 AND 7 THEN 'weekly' WHEN {x} BETWEEN 20 AND 31 THEN 'monthly' WHEN {x} BETWEEN 60 AND 95 THEN 'quarterly' WHEN {x} BETWEEN 240 AND 270 THEN 'annual'{e} ELSE 'other' END"
_ELECTION = " WHEN {x} BETWEEN 480 AND 1500 THEN 'election_cycle'"


def _bands(x: str, election: bool = True) -> str:
    return _BANDS.format(x=x, e=_ELECTION.format(x=x) if election else "")


@query(f"SELECT p_partkey, {_bands('p_retailprice')} AS category, {_bands('p_size * 5')} AS weekly, {_bands('p_size * 21')} AS monthly FROM part")
def categorize_period(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size")
    return p.select("p_partkey", R.period_category(F.col("p_retailprice")).alias("category"), R.sampled_period_category(size, "weekly").alias("weekly"), R.sampled_period_category(size, "monthly").alias("monthly"))


@query(f"SELECT p_partkey, {_bands('p_size', False)} AS category FROM part")
def categorize_period_wavelet(spark, d):
    return table(spark, d, "part").select("p_partkey", R.wavelet_period_category(F.col("p_size")).alias("category"))


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 5 AND 9 THEN 'Weekly' WHEN p_size BETWEEN 18 AND 31 THEN 'Monthly' WHEN p_size BETWEEN 55 AND 70 THEN 'Quarterly' ELSE 'Other' END AS category FROM part")
def categorize_period_quick(spark, d):
    return table(spark, d, "part").select("p_partkey", R.quick_period_category(F.col("p_size")).alias("category"))


_REGIME = "CASE WHEN {r} > 0.001 AND {v} < 0.025 THEN 'Bull Market' WHEN {r} < -0.001 AND {v} > 0.01 THEN 'Bear Market' WHEN {v} > 0.025 THEN 'High Volatility' ELSE 'Low Volatility' END"


@query(f"SELECT l_orderkey, l_linenumber, {_REGIME.format(r='(l_discount - 0.05) / 10', v='l_tax / 2')} AS regime FROM lineitem")
def classify_regime(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", R.regime_name((F.col("l_discount") - 0.05) / 10, F.col("l_tax") / 2).alias("regime"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.05 THEN 'No significant correlation' ELSE (CASE WHEN abs(l_discount * 10) > 0.7 THEN 'Strong' WHEN abs(l_discount * 10) > 0.4 THEN 'Moderate' ELSE 'Weak' END) || ' ' ||
 (CASE WHEN l_discount * 10 > 0 THEN 'positive' ELSE 'negative' END) || ' correlation, ' || (CASE WHEN l_linenumber - 3 = 0 THEN 'synchronized' WHEN l_linenumber > 3 THEN 'first leads by ' || (l_linenumber - 3) || ' days' ELSE 'second leads by ' || (3 - l_linenumber) || ' days' END) END AS text FROM lineitem"""
)
def interpret_corr(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", R.correlation_text(F.col("l_discount") * 10, F.col("l_tax"), F.col("l_linenumber") - 3).alias("text"))


SECTORS = {"click": "Technology", "view": "Technology", "purchase": "Finance", "signup": "Healthcare"}
_SECTOR_SQL = "s(kind, sector) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in SECTORS.items()) + ")"


def _sectors(spark):
    return spark.createDataFrame(list(SECTORS.items()), "kind string, sector string")  # a fixed, short table


@query(f"WITH {TRADES}, {_SECTOR_SQL} SELECT event_id, sector FROM trades LEFT JOIN s ON trades.kind = s.kind")
def sector_map(spark, d):
    return trades(spark, d).join(F.broadcast(_sectors(spark)), "kind", "left").select("event_id", "sector")


@query(f"WITH {TRADES}, {_SECTOR_SQL}, t AS (SELECT entity, count(*) AS total FROM trades GROUP BY 1) SELECT trades.entity, s.sector, count(*) / any_value(t.total) AS share FROM trades JOIN s ON trades.kind = s.kind JOIN t ON t.entity = trades.entity GROUP BY 1, 2")
def sector_preference(spark, d):
    mapped = trades(spark, d).join(F.broadcast(_sectors(spark)), "kind", "left").groupBy("entity", "sector").count()
    share = F.col("count") / F.sum("count").over(Window.partitionBy("entity"))
    return mapped.withColumn("share", share).where("sector is not null").select("entity", "sector", "share")


@query(
    f"""WITH {TRADES}, {_SECTOR_SQL}, r AS (SELECT entity, ts, sector, row_number() OVER (PARTITION BY entity ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY entity) AS n FROM trades LEFT JOIN s ON trades.kind = s.kind),
 w AS (SELECT r.*, k.k * 10 AS start FROM r, (SELECT unnest(range(0, 2000)) AS k) k WHERE i >= k.k * 10 AND i < k.k * 10 + 20 AND k.k * 10 < n - 20),
 c AS (SELECT entity, start, sector, count(*) AS c FROM w WHERE sector IS NOT NULL GROUP BY 1, 2, 3),
 m AS (SELECT entity, start, min(ts) AS first, max(ts) AS last, count(sector) AS known FROM w GROUP BY 1, 2)
 SELECT m.entity, m.start, m.first, m.last, arg_max(c.sector, c.c * 1000 - ascii(c.sector)) AS sector, max(c.c) / any_value(m.known) AS concentration FROM m JOIN c ON m.entity = c.entity AND m.start = c.start WHERE known >= 5 GROUP BY 1, 2, 3, 4"""
)
def sector_rotation(spark, d, window: int = 20, step: int = 10):
    """Row windows of an entity's trades; the sector most traded in each, ties to the first letter, and its share of those with a sector."""
    order = Window.partitionBy("entity").orderBy("ts", "event_id")
    t = trades(spark, d).join(F.broadcast(_sectors(spark)), "kind", "left").withColumns({"i": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy("entity"))})
    first = F.greatest(F.floor((F.col("i") - window) / step) + 1, F.lit(0)) * step
    starts = F.filter(F.sequence(first, F.greatest(first, F.floor(F.col("i") / step) * step), F.lit(step)), lambda s: (s <= F.col("i")) & (s < F.col("n") - window))
    w = t.withColumn("start", F.explode(starts))
    c = w.groupBy("entity", "start", "sector").agg(F.count("*").alias("c"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    known = F.col("sector").isNotNull()
    best = F.max(F.when(known, F.struct((F.col("c") * 1000 - F.ascii("sector")).alias("key"), "sector", "c")))
    out = c.groupBy("entity", "start").agg(F.min("a").alias("first"), F.max("b").alias("last"), best.alias("m"), F.sum(F.when(known, F.col("c")).otherwise(0)).alias("known")).where("known >= 5")
    return out.select("entity", "start", "first", "last", "m.sector", (F.col("m.c") / F.col("known")).alias("concentration"))


@query(f"WITH {TRADES}, c AS (SELECT entity, kind, count(*) AS n, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, kind) AS rank FROM trades GROUP BY 1, 2) SELECT entity, kind, n, CAST(rank AS INTEGER) AS rank FROM c WHERE rank <= 3")
def top_tickers(spark, d):
    c = trades(spark, d).groupBy("entity", "kind").agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("n"), "kind"))).where("rank <= 3")


@query(f"WITH {TRADES} SELECT entity, avg(CASE WHEN kind = 'purchase' THEN 1.0 ELSE 0.0 END) AS buy_ratio FROM trades GROUP BY 1")
def buy_sell_ratio(spark, d):
    return rounded(trades(spark, d).groupBy("entity").agg(F.avg(F.when(F.col("kind") == "purchase", 1.0).otherwise(0.0)).alias("buy_ratio")), 12)


@query(f"WITH {TRADES} SELECT entity, count(*) AS n, min(ts) AS first, max(ts) AS last, date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS days FROM trades GROUP BY 1")
def trade_summary(spark, d):
    return trades(spark, d).groupBy("entity").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.datediff(F.max("ts"), F.min("ts")).cast("long").alias("days"))


@query(
    f"""WITH {TRADES}, g AS (SELECT *, CASE WHEN date_diff('day', CAST(lag(ts) OVER w AS DATE), CAST(ts AS DATE)) > 1 THEN 1 ELSE 0 END AS late FROM trades WINDOW w AS (PARTITION BY entity ORDER BY ts)),
 r AS (SELECT *, sum(late) OVER (PARTITION BY entity ORDER BY ts) AS run FROM g) SELECT entity, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM r GROUP BY entity, run HAVING count(*) >= 3"""
)
def trade_bursts(spark, d):
    return S.bursts(trades(spark, d), gap_days=1, least=3)


@query(f"WITH {MARKET}, m AS (SELECT ts, sum(volume) AS macro FROM market WHERE entity = 'N' AND day(ts) % 3 = 0 GROUP BY 1) SELECT market.entity, market.ts, round(close, 6) AS close, round(m.macro, 4) AS macro FROM market ASOF LEFT JOIN m ON market.ts >= m.ts")
def macro_asof(spark, d):
    m = market(spark, d)
    macro = m.where("entity = 'N' and day(ts) % 3 = 0").select("ts", F.col("volume").alias("macro"))
    return S.asof_shared(m, macro, ["macro"]).select("entity", "ts", F.round("close", 6).alias("close"), F.round("macro", 4).alias("macro"))


@query(f"WITH {PANEL}, p AS (SELECT a.entity AS a, b.entity AS b, count(*) AS n, corr(a.value, b.value) AS r FROM panel a JOIN panel b ON a.ts = b.ts AND a.entity < b.entity GROUP BY 1, 2 HAVING count(*) >= 30) SELECT a, b, n, round(r, 6) AS r FROM p")
def corr_pearson(spark, d):
    x, y = panel(spark, d).select(F.col("entity").alias("a"), "ts", F.col("value").alias("x")), panel(spark, d).select(F.col("entity").alias("b"), "ts", F.col("value").alias("y"))
    return rounded(x.join(y, "ts").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r")).where("n >= 30"))


@query(f"WITH {PANEL} SELECT entity, avg(value) AS mean, median(value) AS median, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75 FROM panel GROUP BY 1")
def return_distribution(spark, d):
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    a = panel(spark, d).groupBy("entity").agg(F.avg("value").alias("mean"), q.alias("q"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return rounded(a.select("entity", "mean", F.col("q")[1].alias("median"), "std", "min", "max", F.col("q")[0].alias("p25"), F.col("q")[2].alias("p75")), 4)


@query(
    """WITH x AS (SELECT l_quantity AS y, l_quantity * (1 + l_discount - l_tax) AS p FROM lineitem) SELECT round(avg(pow(y - p, 2)), 6) AS mse, round(sqrt(avg(pow(y - p, 2))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae,
 round(1 - sum(pow(y - p, 2)) / sum(pow(y - (SELECT avg(y) FROM x), 2)), 6) AS r2, round(avg(abs((y - p) / (y + 1e-8))) * 100, 6) AS mape FROM x"""
)
def regression_metrics(spark, d):
    from ..operators.metrics import regression

    x = table(spark, d, "lineitem").select(F.col("l_quantity").alias("y"), (F.col("l_quantity") * (1 + F.col("l_discount") - F.col("l_tax"))).alias("p"))
    return rounded(regression(x, "y", "p"))


@query(
    """WITH x AS (SELECT quality AS y, toxic AS p FROM labels), k AS (SELECT unnest([0, 1]) AS c), m AS (SELECT c, count(*) FILTER (WHERE y = c AND p = c) AS tp, count(*) FILTER (WHERE p = c) AS np, count(*) FILTER (WHERE y = c) AS ny, count(*) AS n FROM x, k GROUP BY c),
 s AS (SELECT *, coalesce(tp / nullif(np, 0), 0) AS pr, coalesce(tp / nullif(ny, 0), 0) AS re FROM m) SELECT round(sum(tp) / any_value(n), 6) AS accuracy, round(sum(pr * ny) / any_value(n), 6) AS "precision", round(sum(re * ny) / any_value(n), 6) AS recall, round(sum(coalesce(2 * pr * re / nullif(pr + re, 0), 0) * ny) / any_value(n), 6) AS f1 FROM s"""
)
def classification_metrics(spark, d):
    from ..operators.metrics import classification

    return rounded(classification(table(spark, d, "labels"), "quality", "toxic"))


@query("WITH x AS (SELECT quality AS y, doc_id % 97 AS s FROM labels), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM x) SELECT round((sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 6) AS auc FROM r")
def auc(spark, d):
    from ..operators.metrics import auc as area

    return rounded(area(table(spark, d, "labels").select("quality", (F.col("doc_id") % 97).cast("double").alias("s")), "quality", "s"))


@query(f"WITH {TRADES} SELECT CAST(ts AS DATE) AS day, kind, count(*) AS n, count(DISTINCT entity) AS users, GROUPING_ID(CAST(ts AS DATE), kind) AS level FROM trades GROUP BY ROLLUP (CAST(ts AS DATE), kind)")
def rollup_counts(spark, d):
    t = trades(spark, d).withColumn("day", F.to_date("ts"))
    return t.rollup("day", "kind").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("users"), F.grouping_id().alias("level"))
