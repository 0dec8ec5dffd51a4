"""Smaller operators of the inventory, each as a query of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import backtest as B
from ..operators import changepoint as CP
from ..operators import correlation as CO
from ..operators import indicators as I
from ..operators import matching as M
from ..operators import series as S
from ..operators import wavelet as W
from ..sources.staging import Stages
from ..sources.store import Store
from ..sources.tables import MARKET, PANEL, TRADES, market, panel, table, trades
from . import sequences as Q
from .analytics import _shared
from .registry import query, rounded

_RET = "r AS (SELECT entity, idx, ts, close / nullif(lag(close) OVER (PARTITION BY entity ORDER BY idx), 0) - 1 AS r FROM market)"


def _returns(spark, d):
    return market(spark, d).withColumn("r", I.returns(F.col("close")))


@query(f"WITH {MARKET}, {_RET}, q AS (SELECT entity, quantile_cont(r, 0.05) AS v FROM r GROUP BY 1) SELECT q.entity, round(any_value(v), 6) AS var_95, round(avg(r), 6) AS cvar_95 FROM q JOIN r ON r.entity = q.entity AND r.r <= q.v GROUP BY 1")
def var_cvar(spark, d):
    r = _returns(spark, d).where("r is not null").select("entity", "r")
    q = r.groupBy("entity").agg(F.percentile("r", F.lit(0.05)).alias("v"))
    return rounded(r.join(q, "entity").where("r <= v").groupBy("entity").agg(F.first("v").alias("var_95"), F.avg("r").alias("cvar_95")))


@query(f"WITH {PANEL}, s AS (SELECT entity, idx, idx % 13 < 5 OR idx % 13 >= 8 AS held FROM panel), f AS (SELECT entity, idx, held, idx - row_number() OVER (PARTITION BY entity, held ORDER BY idx) AS run FROM s), g AS (SELECT entity, run, count(*) AS n FROM f WHERE held GROUP BY 1, 2) SELECT entity, round(avg(n), 6) AS mean_duration, count(*) AS trades FROM g GROUP BY 1")
def trade_duration(spark, d):
    held = (F.col("idx") % 13 < 5) | (F.col("idx") % 13 >= 8)
    return rounded(S.islands(panel(spark, d), held).groupBy("entity").agg(F.avg("length").alias("mean_duration"), F.count("*").alias("trades")))


@query("SELECT p_partkey AS a, p_size AS b, round(p_retailprice / 1000 - 1.5, 6) AS r FROM part WHERE abs(p_retailprice / 1000 - 1.5) >= 0.3 AND (p_partkey % 100) / 1000.0 < 0.05")
def significant_pairs(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").alias("a"), F.col("p_size").alias("b"), (F.col("p_retailprice") / 1000 - 1.5).alias("r"), (F.col("p_partkey") % 100 / 1000).alias("p"))
    return rounded(CO.significant(x, 0.3).drop("p"))


@query("WITH m AS (SELECT p_size AS entity, p_partkey AS start, 1 / (1 + p_retailprice / 2000) AS s, p_retailprice / 1000 AS t FROM part) SELECT entity, count(*) AS n, round(sum(t * s) / sum(s), 6) AS predicted, round(0.3 * least(count(*) / 10.0, 1) + 0.4 / (1 + stddev_pop(t)) + 0.3 / count(*), 6) AS confidence FROM m GROUP BY 1")
def weighted_outcome(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").alias("entity"), F.col("p_partkey").alias("start"), R.match_similarity(F.col("p_retailprice") / 1000).alias("similarity"), (F.col("p_retailprice") / 1000).alias("total"), F.lit(30).alias("horizon"))
    return rounded(M.predict(p.select("entity", "start", "similarity"), p.select("entity", "start", "total", "horizon")).select("entity", "n", "predicted", "confidence"))


@query("WITH x AS (SELECT p_size AS entity, (p_partkey % 50) + 0.5 AS w FROM part), y AS (SELECT p_size AS entity, (p_partkey * 7 % 50) + 0.25 AS f FROM part) SELECT DISTINCT x.entity, x.w AS w, y.f AS f FROM x JOIN y ON x.entity = y.entity AND abs(x.w - y.f) < 3")
def period_theta(spark, d):
    p = table(spark, d, "part")
    x, y = p.select(F.col("p_size").alias("entity"), (F.col("p_partkey") % 50 + 0.5).cast("double").alias("w")).distinct(), p.select(F.col("p_size").alias("entity"), (F.col("p_partkey") * 7 % 50 + 0.25).cast("double").alias("f")).distinct()
    near = x.withColumn("_b", F.explode(F.array(*(F.floor(F.col("w") / 3) + k for k in (-1, 0, 1)))))  # an equi-join on bands of width 3
    return near.join(y.withColumn("_b", F.floor(F.col("f") / 3)), ["entity", "_b"]).where(F.abs(F.col("w") - F.col("f")) < 3).select("entity", "w", "f")


@query(f"WITH {TRADES}, v AS (SELECT entity, CAST(ts AS DATE) AS day, count(*) AS n FROM trades GROUP BY 1, 2), a AS (SELECT CAST(ts AS DATE) AS day, sum(amount) AS total FROM trades WHERE kind = 'purchase' GROUP BY 1) SELECT v.entity, v.day, v.n, isodow(v.day) - 1 AS day_of_week, round(a.total, 4) AS bought FROM v LEFT JOIN a ON a.day = v.day")
def index_left_join(spark, d):
    t = trades(spark, d).withColumn("day", F.to_date("ts"))
    v, a = t.groupBy("entity", "day").agg(F.count("*").alias("n")), t.where("kind = 'purchase'").groupBy("day").agg(F.sum("amount").alias("total"))
    return v.join(a, "day", "left").select("entity", "day", "n", F.weekday("day").alias("day_of_week"), F.round("total", 4).alias("bought"))


def _days_to(dates) -> str:
    at = "make_date(year(day){y}, {m}, {d})"
    return "date_diff('day', day, least(" + ", ".join(f"CASE WHEN {at.format(y='', m=m, d=n)} >= day THEN {at.format(y='', m=m, d=n)} ELSE {at.format(y=' + 1', m=m, d=n)} END" for m, n in dates) + "))"


@query(f"WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders) SELECT o_orderkey, {_days_to(I.HOLIDAYS)} AS days_to_next_holiday, CAST({_days_to(I.HOLIDAYS)} = 1 AS INTEGER) AS is_pre_holiday, {_days_to(I.SESSION_ENDS)} AS days_to_session_end FROM x")
def holiday_features(spark, d):
    day = F.to_date("o_orderdate")
    h = I.days_to(day, I.HOLIDAYS)
    return table(spark, d, "orders").select("o_orderkey", h.cast("long").alias("days_to_next_holiday"), (h == 1).cast("int").alias("is_pre_holiday"), I.days_to(day, I.SESSION_ENDS).cast("long").alias("days_to_session_end"))


@query(f"WITH {MARKET}, f AS (SELECT entity, idx, ts, lead(close, 30) OVER (PARTITION BY entity ORDER BY idx) / close - 1 AS f FROM market), m AS (SELECT ts, avg(f) AS mf FROM f GROUP BY 1) SELECT f.entity, f.idx, round(f.f - m.mf, 6) AS excess FROM f JOIN m ON m.ts = f.ts")
def excess_returns(spark, d):
    f = market(spark, d).withColumn("f", I.forward_return(F.col("close"), 30))
    return rounded(f.join(f.groupBy("ts").agg(F.avg("f").alias("mf")), "ts").select("entity", "idx", (F.col("f") - F.col("mf")).alias("excess")))


@query("SELECT p_partkey, round(0.5 * least(p_retailprice / 2000, 1) + 0.3 * least(365.0 / p_size / 3, 1) + 0.2 * (CASE WHEN p_size < 3 THEN 0.3 WHEN p_size > 365 / 2.0 THEN 0.5 ELSE 1.0 END), 6) AS confidence FROM part")
def cycle_confidence(spark, d):
    return rounded(table(spark, d, "part").select("p_partkey", R.cycle_confidence(F.col("p_retailprice") / 2000, F.col("p_size"), F.lit(365.0)).alias("confidence")))


@query(f"WITH {TRADES} SELECT entity, arg_max(kind, ts) AS last_kind, max(ts) AS last FROM trades GROUP BY 1")
def latest(spark, d):
    return trades(spark, d).groupBy("entity").agg(F.max_by("kind", "ts").alias("last_kind"), F.max("ts").alias("last"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_quantity DESC, l_linenumber) AS priority FROM lineitem WHERE l_quantity >= 7")
def prioritise(spark, d):
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    w = Window.partitionBy("l_orderkey").orderBy(rank, F.desc("l_quantity"), "l_linenumber")
    return table(spark, d, "lineitem").where("l_quantity >= 7").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("priority"))


@query(f"WITH {PANEL}, g AS (SELECT entity, idx, CASE WHEN idx % 9 = 4 THEN NULL ELSE value END AS v FROM panel) SELECT entity, idx, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY entity ORDER BY idx), first_value(v IGNORE NULLS) OVER (PARTITION BY entity ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS value FROM g")
def fill_forward(spark, d):
    p = panel(spark, d).withColumn("value", F.when(F.col("idx") % 9 != 4, F.col("value")))
    return rounded(S.filled(p).select("entity", "idx", "value"), 4)


@query(Q.STOP_TAKE)
def stop_take(spark, d):
    p = market(spark, d).select("entity", "idx", F.col("close").alias("price"))
    return rounded(B.run(p, B.Config(stop=0.05, take=0.1)))


@query()
def global_spectrum(spark, d):
    return W.global_spectrum(W.power(panel(spark, d), W.SCALES, "mexican_hat"))


@query()
def scale_average(spark, d):
    return W.scale_average(W.power(panel(spark, d), W.SCALES))


@query(Q.PELT_NORMAL)
def cp_confidence(spark, d):
    prices = market(spark, d).select("entity", "idx", F.col("close").alias("value"))  # without runs of one value, whose variance is rounding error
    return rounded(CP.detect(prices, "pelt", "normal", penalty=10.0, least=20, scaled=True))


@query(f"WITH {PANEL} SELECT 'counts' AS name, v AS version, (SELECT count(DISTINCT entity) FROM panel) AS rows FROM (VALUES ('v2'), ('v3')) t(v)")
def list_models(spark, d):
    s = Store(spark, f"{_shared(spark)}/store-{uuid.uuid4().hex}")
    for v in ("v1", "v2", "v3"):
        s.save(panel(spark, d).groupBy("entity").count(), "counts", v)
    s.cleanup("counts", 2)
    return s.list().select("name", "version", "rows")


@query(Q.FEATURES)
def network_features(spark, d):
    """Each entity's degree and centrality, as features."""
    _shared(spark)
    net = CO.network(CO.edges(panel(spark, d)), 0.0).checkpoint()
    degree = net.select(F.explode(F.array("a", "b")).alias("entity")).groupBy("entity").agg(F.count("*").alias("degree"))
    return rounded(degree.join(CO.eigenvector_centrality(net, tolerance=1e-10), "entity"), 5)


@query(
    f"""WITH {PANEL}, v AS (SELECT entity, count(*) AS n, sum(value) AS total FROM panel GROUP BY 1)
 SELECT 'saved' AS step, 'v2' AS version, entity, round(2 * total, 2) AS total FROM v UNION ALL SELECT 'activated', 'v1', entity, round(total, 2) FROM v UNION ALL SELECT 'left', 'v1', entity, round(total, 2) FROM v"""
)
def model_registry(spark, d):
    """Rows that the store gives: of the latest of two versions, of the one made active then, and of what is left when the other one is deleted."""
    s = Store(spark, f"{_shared(spark)}/store-{uuid.uuid4().hex}")
    totals = panel(spark, d).groupBy("entity").agg(F.sum("value").alias("total"))
    s.save(totals, "totals", "v1")
    s.save(totals.withColumn("total", 2 * F.col("total")), "totals", "v2")
    given = lambda step: s.load("totals").select(F.lit(step).alias("step"), F.lit(s.latest("totals")).alias("version"), "entity", F.round("total", 2).alias("total"))
    out = Stages(spark)(given("saved"))  # its version is deleted below
    s.activate("totals", "v1")
    out = out.unionByName(given("activated"))
    s.delete("totals", "v2")
    return out.unionByName(given("left"))
