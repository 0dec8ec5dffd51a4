"""Window queries: indicators, calendar features, risk curves, runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import series as S
from ..sources.tables import MARKET, PANEL, TRADES, market, panel, trades
from .registry import query, rounded

W = "(PARTITION BY entity ORDER BY idx)"


def _w(n: int) -> str:
    return f"(PARTITION BY entity ORDER BY idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(agg: str, n: int, x: str = "close") -> str:
    return f"CASE WHEN count({x}) OVER {_w(n)} = {n} THEN {agg} OVER {_w(n)} END"


_RET = "r AS (SELECT entity, idx, ts, close, volume, high, low, close / nullif(lag(close) OVER (PARTITION BY entity ORDER BY idx), 0) - 1 AS r FROM market)"


def _returns(spark, d):
    return market(spark, d).withColumn("r", I.returns(F.col("close")))


@query(f"WITH {MARKET}, {_RET} SELECT entity, idx, round(stddev_samp(r) OVER {_w(20)}, 6) AS vol FROM r")
def roll_vol_20(spark, d):
    return rounded(_returns(spark, d).select("entity", "idx", I.volatility(F.col("r")).alias("vol")))


@query(f"WITH {MARKET}, {_RET} SELECT entity, idx, round(avg(r) OVER {_w(20)}, 6) AS momentum FROM r")
def roll_momentum_20(spark, d):
    return rounded(_returns(spark, d).select("entity", "idx", I.momentum(F.col("r")).alias("momentum")))


@query(f"WITH {MARKET}, {_RET} SELECT entity, idx, round(r, 6) AS ret, round(coalesce(stddev_samp(r) OVER {_w(20)}, 0), 6) AS vol, round(avg(r) OVER {_w(20)}, 6) AS momentum, round((volume - avg(volume) OVER (PARTITION BY entity)) / (stddev_pop(volume) OVER (PARTITION BY entity) + 1e-8), 6) AS volume_z FROM r")
def hmm_features(spark, d):
    whole = Window.partitionBy("entity")
    z = (F.col("volume") - F.avg("volume").over(whole)) / (F.stddev_pop("volume").over(whole) + 1e-8)
    return rounded(_returns(spark, d).select("entity", "idx", F.col("r").alias("ret"), F.coalesce(I.volatility(F.col("r")), F.lit(0.0)).alias("vol"), I.momentum(F.col("r")).alias("momentum"), z.alias("volume_z")))


@query(f"WITH {MARKET} SELECT entity, idx, " + ", ".join(f"round({_full('avg(close)', n)}, 4) AS sma_{n}" for n in (5, 10, 20, 50, 200)) + " FROM market")
def sma(spark, d):
    return rounded(market(spark, d).select("entity", "idx", *(I.sma(F.col("close"), n).alias(f"sma_{n}") for n in (5, 10, 20, 50, 200))), 4)


@query(f"WITH {MARKET} SELECT entity, idx, " + ", ".join(f"round(close / ({_full('avg(close)', n)}), 6) AS price_to_sma_{n}" for n in (20, 50, 200)) + f", CAST(coalesce(({_full('avg(close)', 50)}) > ({_full('avg(close)', 200)}), false) AS INTEGER) AS golden, CAST(coalesce(({_full('avg(close)', 20)}) > ({_full('avg(close)', 50)}), false) AS INTEGER) AS cross_20_50 FROM market")
def sma_cross(spark, d):
    c = F.col("close")
    m = market(spark, d).withColumns({f"s{n}": I.sma(c, n) for n in (20, 50, 200)})
    up = lambda a, b: F.coalesce((F.col(a) > F.col(b)).cast("int"), F.lit(0))
    return rounded(m.select("entity", "idx", *((c / F.col(f"s{n}")).alias(f"price_to_sma_{n}") for n in (20, 50, 200)), up("s50", "s200").alias("golden"), up("s20", "s50").alias("cross_20_50")))


_EMA = """{e} AS (SELECT entity, idx, value{cols0} FROM {src} WHERE idx = 0 UNION ALL SELECT p.entity, p.idx, p.value{cols} FROM {e} JOIN {src} p ON p.entity = {e}.entity AND p.idx = {e}.idx + 1)"""


def _ema_sql(src: str, spans: dict[str, int], e: str = "e") -> str:
    return _EMA.format(e=e, src=src, cols0="".join(f", CAST(value AS DOUBLE) AS {c}" for c in spans), cols="".join(f", {2 / (n + 1)!r} * p.value + {1 - 2 / (n + 1)!r} * {e}.{c}" for c, n in spans.items()))


_MV = "mv AS (SELECT entity, idx, close AS value FROM market)"


@query(f"WITH RECURSIVE {MARKET}, {_MV}, {_ema_sql('mv', {'ema_5': 5, 'ema_20': 20})} SELECT entity, idx, round(ema_5, 4) AS ema_5, round(ema_20, 4) AS ema_20 FROM e")
def ema(spark, d):
    m = market(spark, d).select("entity", "idx", F.col("close").alias("value"))
    return rounded(I.ema(m, {"ema_5": 5, "ema_20": 20}).drop("value"), 4)


@query(f"WITH RECURSIVE {MARKET}, {_MV}, {_ema_sql('mv', {'fast': 12, 'slow': 26})}, l AS (SELECT entity, idx, fast - slow AS value FROM e), {_ema_sql('l', {'sig': 9}, 'e2')} SELECT entity, idx, round(value, 4) AS macd, round(sig, 4) AS macd_signal, round(value - sig, 4) AS macd_histogram FROM e2")
def macd(spark, d):
    m = market(spark, d).select("entity", "idx", F.col("close").alias("value"))
    return rounded(I.macd(m), 4)


_GAIN = "g AS (SELECT entity, idx, coalesce(close - lag(close) OVER (PARTITION BY entity ORDER BY idx), 0) AS d FROM market), h AS (SELECT entity, idx, greatest(d, 0) AS gain, greatest(-d, 0) AS loss FROM g)"


@query(f"WITH {MARKET}, {_GAIN} SELECT entity, idx, " + ", ".join(f"round(CASE WHEN count(gain) OVER {_w(n)} = {n} THEN 100 - 100 / (1 + avg(gain) OVER {_w(n)} / nullif(avg(loss) OVER {_w(n)}, 0)) END, 4) AS rsi_{n}" for n in (14, 30)) + " FROM h")
def rsi(spark, d):
    m = I.with_rsi(I.with_rsi(market(spark, d), "close", 14), "close", 30)
    return rounded(m.select("entity", "idx", "rsi_14", "rsi_30"), 4)


@query(f"WITH {MARKET}, m AS (SELECT *, {_full('avg(close)', 20)} AS mid, {_full('stddev_samp(close)', 20)} AS sd FROM market) SELECT entity, idx, round(mid + 2 * sd, 4) AS bb_upper, round(mid - 2 * sd, 4) AS bb_lower, round(4 * sd / mid, 6) AS bb_width, round((close - mid + 2 * sd) / nullif(4 * sd, 0), 6) AS price_to_bb FROM m")
def bollinger(spark, d):
    b = I.bollinger(F.col("close"))
    m = market(spark, d).select("entity", "idx", *(b[k].alias(k) for k in ("bb_upper", "bb_lower", "bb_width", "price_to_bb")))
    return m.select("entity", "idx", F.round("bb_upper", 4).alias("bb_upper"), F.round("bb_lower", 4).alias("bb_lower"), F.round("bb_width", 6).alias("bb_width"), F.round("price_to_bb", 6).alias("price_to_bb"))


@query(f"WITH {MARKET}, t AS (SELECT entity, idx, greatest(high - low, abs(high - lag(close) OVER (PARTITION BY entity ORDER BY idx)), abs(low - lag(close) OVER (PARTITION BY entity ORDER BY idx))) AS tr FROM market) SELECT entity, idx, round({_full('avg(tr)', 14, 'tr')}, 4) AS atr_14 FROM t")
def atr_14(spark, d):
    return rounded(I.with_atr(market(spark, d)).select("entity", "idx", "atr_14"), 4)


@query(f"WITH {MARKET}, t AS (SELECT entity, idx, coalesce(sign(close - lag(close) OVER (PARTITION BY entity ORDER BY idx)) * volume, 0) AS s FROM market) SELECT entity, idx, sum(s) OVER (PARTITION BY entity ORDER BY idx) AS obv FROM t")
def obv(spark, d):
    return I.with_obv(market(spark, d)).select("entity", "idx", "obv")


@query(f"WITH {MARKET} SELECT entity, idx, " + ", ".join(f"round({_full('avg(volume)', n, 'volume')}, 4) AS volume_sma_{n}" for n in (5, 10, 20, 50)) + ", " + ", ".join(f"round(volume / ({_full('avg(volume)', n, 'volume')}), 6) AS volume_ratio_{n}" for n in (20, 50)) + f", round({_full('avg(close * volume)', 20, 'volume')}, 2) AS dollar_volume_20 FROM market")
def volume_features(spark, d):
    v = F.col("volume")
    m = market(spark, d)
    dollars = I.full(F.avg(F.col("close") * v), v, 20)
    return m.select("entity", "idx", *(F.round(I.sma(v, n), 4).alias(f"volume_sma_{n}") for n in (5, 10, 20, 50)), *(F.round(v / I.sma(v, n), 6).alias(f"volume_ratio_{n}") for n in (20, 50)), F.round(dollars, 2).alias("dollar_volume_20"))


@query(f"WITH {TRADES} SELECT event_id, " + ", ".join(f"count(*) OVER (PARTITION BY entity ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN {n * 86400 - 1} PRECEDING AND CURRENT ROW) AS n_{n}" for n in (7, 30, 90, 180)) + ", date_diff('day', CAST(min(ts) OVER (PARTITION BY entity) AS DATE), CAST(ts AS DATE)) AS days_since_first, date_diff('day', CAST(lag(ts) OVER (PARTITION BY entity ORDER BY ts, event_id) AS DATE), CAST(ts AS DATE)) AS days_since_last FROM trades")
def trades_last_nd(spark, d):
    t = trades(spark, d)
    first = F.datediff("ts", F.min("ts").over(Window.partitionBy("entity")))
    last = F.datediff("ts", F.lag("ts").over(Window.partitionBy("entity").orderBy("ts", "event_id")))
    return t.select("event_id", *(I.trades_last(n).alias(f"n_{n}") for n in (7, 30, 90, 180)), first.cast("long").alias("days_since_first"), last.cast("long").alias("days_since_last"))


@query(
    f"""WITH {TRADES}, t AS (SELECT event_id, CAST(ts AS DATE) AS day FROM trades) SELECT event_id, isodow(day) - 1 AS day_of_week, day(day) AS day_of_month, month(day) AS month, quarter(day) AS quarter, year(day) AS year,
 {", ".join(f"round({f}(2 * pi() * {x} / {n}), 9) AS {c}_{f}" for c, x, n in (("dow", "(isodow(day) - 1)", 7), ("month", "month(day)", 12), ("quarter", "quarter(day)", 4), ("election", "(year(day) % 4)", 4)) for f in ("sin", "cos"))},
 CAST(year(day) % 4 = 0 AS INTEGER) AS is_election_year, year(day) % 4 AS election_phase, date_diff('day', day, make_date(year(day), 12, 31)) AS days_to_year_end, date_diff('day', make_date(year(day), 1, 1), day) AS days_from_year_start, CAST(month(day) <> 8 AS INTEGER) AS is_session FROM t"""
)
def temporal_features(spark, d):
    return rounded(trades(spark, d).select("event_id", *(c.alias(n) for n, c in I.calendar(F.col("ts")).items())), 9)


@query(f"WITH {MARKET}, {_RET}, s AS (SELECT *, CASE WHEN close > avg(close) OVER {_w(20)} THEN 1 ELSE -1 END AS signal FROM r), t AS (SELECT entity, idx, coalesce(lag(signal) OVER {W} * r - abs(signal - lag(signal) OVER {W}) * 0.0015, 0) AS net FROM s) SELECT entity, idx, round(net, 6) AS net, round(exp(sum(ln(1 + greatest(net, -0.99))) OVER {W}), 6) AS curve FROM t")
def strategy_returns(spark, d):
    from ..operators.backtest import net_returns

    c = F.col("close")
    s = _returns(spark, d).withColumn("signal", F.when(c > F.avg(c).over(I.frame(20)), 1.0).otherwise(-1.0))
    n = net_returns(s, cost=0.001, slippage=0.0005)
    return rounded(n.select("entity", "idx", "net", I.equity(F.greatest(F.col("net"), F.lit(-0.99))).alias("curve")))


_CURVE = "c AS (SELECT entity, idx, 100 + sum(CASE WHEN idx % 7 < 4 THEN value ELSE -value END) OVER (PARTITION BY entity ORDER BY idx) / 1e6 AS e FROM panel), k AS (SELECT *, max(e) OVER (PARTITION BY entity ORDER BY idx) AS m FROM c)"


def _curve(spark, d):
    step = F.when(F.col("idx") % 7 < 4, F.col("value")).otherwise(-F.col("value"))
    return panel(spark, d).withColumn("e", 100 + F.sum(step).over(S.by_time().rowsBetween(Window.unboundedPreceding, 0)) / 1e6)


@query(f"WITH {PANEL}, {_CURVE} SELECT entity, idx, round((e - m) / m, 6) AS dd FROM k")
def drawdown(spark, d):
    return rounded(_curve(spark, d).select("entity", "idx", I.drawdown(F.col("e")).alias("dd")))


@query(f"WITH {PANEL}, {_CURVE}, f AS (SELECT *, idx - row_number() OVER (PARTITION BY entity, e < m ORDER BY idx) AS run FROM k) SELECT entity, max(n) AS longest FROM (SELECT entity, run, count(*) AS n FROM f WHERE e < m GROUP BY 1, 2) GROUP BY 1")
def dd_duration(spark, d):
    c = _curve(spark, d).withColumn("dd", I.drawdown(F.col("e")))
    return S.islands(c, F.col("dd") < 0).groupBy("entity").agg(F.max("length").alias("longest"))


@query(f"WITH {PANEL}, q AS (SELECT entity, quantile_cont(value, 0.5) AS med FROM panel GROUP BY 1), f AS (SELECT p.entity, p.idx, p.idx - row_number() OVER (PARTITION BY p.entity, value > med ORDER BY p.idx) AS run, value > med AS hit FROM panel p JOIN q ON p.entity = q.entity) SELECT entity, min(idx) AS start, max(idx) + 1 AS \"end\", count(*) AS length FROM f WHERE hit GROUP BY entity, run")
def mask_regions(spark, d):
    p = panel(spark, d)
    med = p.groupBy("entity").agg(F.percentile("value", F.lit(0.5)).alias("med"))
    return S.islands(p.join(med, "entity"), F.col("value") > F.col("med"))


@query(f"WITH {PANEL}, l AS (SELECT entity, value, lag(value) OVER (PARTITION BY entity ORDER BY idx) AS b FROM panel) SELECT entity, round(corr(value, b), 6) AS ar1 FROM l GROUP BY 1")
def ar1_lag(spark, d):
    l = panel(spark, d).withColumn("b", F.lag("value").over(S.by_time()))
    return rounded(l.groupBy("entity").agg(F.corr("value", "b").alias("ar1")))


@query(f"WITH {MARKET}, {_RET}, t AS (SELECT *, r AS x FROM r WHERE r IS NOT NULL) SELECT entity, round(avg(x) / (stddev_pop(x) + 1e-8) * sqrt(252), 6) AS sharpe, round(avg(x) / (stddev_pop(x) FILTER (WHERE x < 0) + 1e-8) * sqrt(252), 6) AS sortino, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(coalesce(sum(x) FILTER (WHERE x > 0), 0) / (-coalesce(sum(x) FILTER (WHERE x < 0), 0) + 1e-8), 6) AS profit_factor FROM t GROUP BY 1")
def trading_metrics(spark, d):
    from ..operators.metrics import trading

    return rounded(trading(_returns(spark, d).where("r is not null")))


@query(f"WITH {MARKET}, {_RET}, t AS (SELECT entity, idx, r / 100 AS r FROM r WHERE r IS NOT NULL), c AS (SELECT entity, idx, exp(sum(ln(1 + r)) OVER {W}) AS p, sum(r) OVER {W} AS s FROM t), k AS (SELECT *, max(p) OVER {W} AS a, max(s) OVER {W} AS b FROM c) SELECT entity, round(min((p - a) / a), 6) AS a, round(max(b - s), 6) AS b, round(max((b - s) / (abs(b) + 1e-8)), 4) AS c FROM k GROUP BY 1")
def max_drawdowns(spark, d):
    from ..operators.metrics import drawdowns

    x = drawdowns(_returns(spark, d).where("r is not null").withColumn("r", F.col("r") / 100))
    return x.select("entity", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("c", 4).alias("c"))


@query(
    f"""WITH {MARKET}, {_RET}, m AS (SELECT ts, avg(r) AS mr FROM r GROUP BY 1), j AS (SELECT r.*, m.mr FROM r JOIN m ON r.ts = m.ts) SELECT entity, idx, round(lead(close, 30) OVER {W} / close - 1, 6) AS fwd_30,
 round({_full('stddev_samp(r)', 30, 'r')}, 6) AS vol_30, round(lag(close, 21) OVER {W} / lag(close, 252) OVER {W} - 1, 6) AS momentum_252, round({_full('regr_slope(close, idx)', 20)}, 4) AS trend_20, round({_full('covar_samp(r, mr)', 60, 'r')} / nullif({_full('var_samp(mr)', 60, 'r')}, 0), 6) AS beta_60 FROM j"""
)
def placeholder_features(spark, d):
    """What the feature list names: forward return, volatility, momentum, trend and beta."""
    r, c = F.col("r"), F.col("close")
    x = _returns(spark, d)
    mkt = x.groupBy("ts").agg(F.avg("r").alias("mr"))
    j = x.join(mkt, "ts")
    out = j.select("entity", "idx", I.forward_return(c, 30).alias("fwd_30"), I.full(F.stddev_samp(r), r, 30).alias("vol_30"), I.skipped_momentum(c).alias("momentum_252"), I.trend(c, 20).alias("trend_20"), I.rolling_beta(r, F.col("mr"), 60).alias("beta_60"))
    return out.select("entity", "idx", *(F.round(k, 4 if k == "trend_20" else 6).alias(k) for k in ("fwd_30", "vol_30", "momentum_252", "trend_20", "beta_60")))


@query(f"WITH {MARKET}, {_RET}, m AS (SELECT entity, idx, count(r) OVER {_w(30)} AS n, skewness(r) OVER {_w(30)} AS s, kurtosis(r) OVER {_w(30)} AS k FROM r) SELECT entity, idx, round(CASE WHEN n = 30 THEN s END, 5) AS skew, round(CASE WHEN n = 30 THEN k END, 5) AS kurtosis FROM m")
def rolling_moments(spark, d):
    m = I.moments(F.col("r"), 30)
    return rounded(_returns(spark, d).select("entity", "idx", m["skew"].alias("skew"), m["kurtosis"].alias("kurtosis")), 5)


@query(f"WITH {PANEL}, g AS (SELECT entity, idx, ts, CASE WHEN idx % 5 IN (1, 2) OR idx < 2 THEN NULL ELSE value END AS v FROM panel), n AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN idx END) OVER (PARTITION BY entity ORDER BY idx) AS i0, min(CASE WHEN v IS NOT NULL THEN idx END) OVER (PARTITION BY entity ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1 FROM g) SELECT n.entity, n.idx, round(coalesce(n.v, a.v + (b.v - a.v) * (n.idx - n.i0) / nullif(n.i1 - n.i0, 0), a.v, b.v), 4) AS value FROM n LEFT JOIN g a ON a.entity = n.entity AND a.idx = n.i0 LEFT JOIN g b ON b.entity = n.entity AND b.idx = n.i1")
def interpolate_nan(spark, d):
    holes = F.when((F.col("idx") % 5).isin(1, 2) | (F.col("idx") < 2), None).otherwise(F.col("value"))
    return rounded(S.interpolated(panel(spark, d).withColumn("value", holes)).select("entity", "idx", "value"), 4)
