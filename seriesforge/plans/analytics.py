"""Analyses: cycles, regimes, matches, breaks, wavelets, correlation, ensembles, backtests, validation, stores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import backtest as B
from ..operators import changepoint as CP
from ..operators import correlation as CO
from ..operators import ensemble as E
from ..operators import lstm as L
from ..operators import matching as M
from ..operators import permutation as PT
from ..operators import regimes as H
from ..operators import series as S
from ..operators import spectral as SP
from ..operators import tuning as T
from ..operators import validate as V
from ..operators import wavelet as W
from ..sources.staging import Stages
from ..sources.store import Runs, Store, flattened
from ..sources.tables import MARKET, PANEL, market, nations, panel, segments, table
from . import sequences as Q
from .registry import query, rounded

SEGMENTS = """d AS (SELECT c_mktsegment AS entity, CAST(o_orderdate AS DATE) AS ts, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
 cal AS (SELECT entity, CAST(unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS DATE) AS ts FROM d GROUP BY entity),
 panel AS (SELECT c.entity, c.ts, coalesce(d.v, 0) / 1e5 AS value, row_number() OVER (PARTITION BY c.entity ORDER BY c.ts) - 1 AS idx FROM cal c LEFT JOIN d ON c.entity = d.entity AND c.ts = d.ts)"""
_DETREND = "g AS (SELECT entity, regr_slope(value, idx) AS s, avg(value) AS my, avg(idx) AS mx, count(*) AS n FROM panel GROUP BY 1), x AS (SELECT p.entity, p.idx, g.n, value - my - s * (idx - mx) AS v FROM panel p JOIN g ON p.entity = g.entity)"
_SPEC = "spec AS (SELECT entity, k, any_value(n) AS n, 2.0 / any_value(n) * sqrt(pow(sum(v * cos(2 * pi() * ((k * idx) % n) / n)), 2) + pow(sum(v * sin(2 * pi() * ((k * idx) % n) / n)), 2)) AS power FROM x, (SELECT unnest(range(0, 2000)) AS k) f WHERE k < n // 2 GROUP BY 1, 2)"
_PEAKS = """nb AS (SELECT *, lag(power) OVER w AS a, lead(power) OVER w AS b FROM spec WINDOW w AS (PARTITION BY entity ORDER BY k)), pk AS (SELECT entity, k, n, power FROM nb WHERE power > a AND power > b AND power >= 0.1),
 lr AS (SELECT pk.entity, pk.k, any_value(pk.n) AS n, any_value(pk.power) AS power, coalesce(max(q.k) FILTER (WHERE q.k < pk.k AND q.power > pk.power), -1) AS l, coalesce(min(q.k) FILTER (WHERE q.k > pk.k AND q.power > pk.power), 99999) AS r FROM pk JOIN spec q ON q.entity = pk.entity GROUP BY 1, 2),
 pm AS (SELECT lr.entity, lr.k, any_value(lr.n) AS n, any_value(lr.power) AS power, greatest(min(q.power) FILTER (WHERE q.k > l AND q.k <= lr.k), min(q.power) FILTER (WHERE q.k >= lr.k AND q.k < r)) AS base FROM lr JOIN spec q ON q.entity = lr.entity GROUP BY 1, 2),
 cy AS (SELECT entity, n * 1.0 / k AS period_days, power AS strength, k * 1.0 / n AS frequency, 0.5 * least(power, 1) + 0.3 * least(n * 1.0 / (n * 1.0 / k) / 3, 1) + 0.2 * (CASE WHEN n * 1.0 / k < 3 THEN 0.3 WHEN n * 1.0 / k > n / 2.0 THEN 0.5 ELSE 1.0 END) AS confidence FROM pm WHERE k > 0 AND power - base >= 0.05),
 cyc AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY strength DESC, frequency) AS rank FROM cy WHERE confidence >= 0.55)"""
_CAT = "CASE WHEN period_days BETWEEN 3 AND 7 THEN 'weekly' WHEN period_days BETWEEN 20 AND 31 THEN 'monthly' WHEN period_days BETWEEN 60 AND 95 THEN 'quarterly' WHEN period_days BETWEEN 240 AND 270 THEN 'annual' WHEN period_days BETWEEN 480 AND 1500 THEN 'election_cycle' ELSE 'other' END"

_QUICK = "CASE WHEN period BETWEEN 5 AND 9 THEN 'Weekly' WHEN period BETWEEN 18 AND 31 THEN 'Monthly' WHEN period BETWEEN 55 AND 70 THEN 'Quarterly' ELSE 'Other' END"


def _segments(spark, d):
    return segments(spark, d).withColumn("value", F.col("value") / 1e5)


def _cycles(spark, d):
    return SP.cycles(_segments(spark, d), 0.1, 0.55)


@query(f"WITH {SEGMENTS}, {_DETREND} SELECT entity, idx, round(v, 6) AS value FROM x")
def detrend(spark, d):
    return rounded(S.detrended(_segments(spark, d)).select("entity", "idx", "value"))


@query(f"WITH {SEGMENTS}, {_DETREND}, {_SPEC} SELECT entity, k, round(power, 6) AS power FROM spec")
def periodogram(spark, d):
    return rounded(SP.periodogram(_segments(spark, d)).select("entity", "k", "power"))


@query(f"WITH {SEGMENTS}, {_DETREND}, {_SPEC}, {_PEAKS} SELECT entity, round(period_days, 6) AS period_days, round(strength, 6) AS strength, round(confidence, 6) AS confidence, round(frequency, 9) AS frequency, {_CAT} AS category FROM cy WHERE confidence >= 0.55")
def detect_cycles(spark, d):
    c = _cycles(spark, d)
    return c.select("entity", F.round("period_days", 6).alias("period_days"), F.round("strength", 6).alias("strength"), F.round("confidence", 6).alias("confidence"), F.round("frequency", 9).alias("frequency"), "category")


@query(f"WITH {SEGMENTS}, {_DETREND}, {_SPEC}, {_PEAKS} SELECT entity, string_agg(printf('%d. %s: %.1f days, strength %.3f, confidence %.0f %%', rank, {_CAT}, period_days, strength, 100 * confidence), chr(10) ORDER BY rank) AS text FROM cyc WHERE rank <= 5 GROUP BY 1")
def cycle_summary(spark, d):
    return SP.summary(_cycles(spark, d))


@query(
    f"""WITH {MARKET}, th AS (SELECT entity, idx, volume, ntile(3) OVER (PARTITION BY entity ORDER BY volume, idx) - 1 AS state, coalesce(close / nullif(lag(close) OVER (PARTITION BY entity ORDER BY idx), 0) - 1, 0) AS ret FROM market),
 g AS (SELECT entity, state, avg(ret) AS m, stddev_pop(ret) AS s, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY entity) AS f FROM th GROUP BY 1, 2) SELECT entity, string_agg(printf('%d. return %.2f %%, volatility %.2f %%, %.1f %% of days', state, 100 * m, 100 * s, 100 * f), chr(10) ORDER BY state) AS text FROM g GROUP BY 1"""
)
def regime_summary(spark, d):
    """What is said of states that are given: the thirds of the days by volume."""
    third = (F.ntile(3).over(Window.partitionBy("entity").orderBy("volume", "idx")) - 1).cast("int")
    rows = H.features(market(spark, d)).drop("volume").join(market(spark, d).select("entity", "idx", "volume"), ["entity", "idx"])
    return H.summary(H.profiles(rows.withColumn("state", third).withColumn("transitions", F.array(F.lit(0.5), F.lit(0.5), F.lit(0.5)))))


@query(Q.MATCH_SUMMARY)
def match_summary(spark, d):
    s, m = panel(spark, d), _matches(spark, d)
    return M.summary(m, M.outcomes(s, m, horizons=(30,)))


@query(f"WITH {SEGMENTS}, {_DETREND}, {_SPEC}, {_PEAKS} SELECT entity, CAST(rank AS INTEGER) AS rank, round(period_days, 6) AS period_days, round(strength, 6) AS strength, round(confidence, 6) AS confidence, {_CAT} AS category FROM cyc WHERE rank <= 10")
def top_cycles(spark, d):
    return rounded(SP.top(_cycles(spark, d)).select("entity", "rank", "period_days", "strength", "confidence", "category"))


@query(
    f"""WITH {SEGMENTS}, {_DETREND}, {_SPEC}, {_PEAKS}, b AS (SELECT entity, strength, frequency FROM cyc WHERE rank <= 5), m AS (SELECT entity, avg(value) AS mean, max(idx) AS last FROM panel GROUP BY 1),
 w AS (SELECT p.entity, p.idx, any_value(p.value) AS value, sum(strength * sin(2 * pi() * frequency * p.idx)) AS w FROM panel p JOIN b ON b.entity = p.entity GROUP BY 1, 2), sd AS (SELECT w.entity, stddev_pop(value - mean - w) AS sd FROM w JOIN m ON m.entity = w.entity GROUP BY 1),
 f AS (SELECT b.entity, s.step, sum(strength * sin(2 * pi() * frequency * (m.last + s.step))) AS w FROM b JOIN m ON m.entity = b.entity, (SELECT unnest(range(1, 31)) AS step) s GROUP BY 1, 2)
 SELECT f.entity, CAST(f.step AS INTEGER) AS step, round(mean + w, 6) AS forecast, round(mean + w - 1.96 * sd, 6) AS lower, round(mean + w + 1.96 * sd, 6) AS upper FROM f JOIN m ON m.entity = f.entity JOIN sd ON sd.entity = f.entity"""
)
def cycle_forecast(spark, d):
    s = _segments(spark, d)
    return rounded(SP.forecast(s, SP.cycles(s, 0.1, 0.55)))


@query(
    f"""WITH {PANEL}, n AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n, CASE WHEN idx >= 10 AND idx < count(*) OVER (PARTITION BY entity) - 10 THEN avg(value) OVER (PARTITION BY entity ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) END AS t FROM panel),
 a AS (SELECT entity, regr_slope(t, idx) AS s, regr_intercept(t, idx) AS i FROM n WHERE t IS NOT NULL AND idx < 31 GROUP BY 1), b AS (SELECT entity, regr_slope(t, idx) AS s, regr_intercept(t, idx) AS i FROM n WHERE t IS NOT NULL AND idx >= n.n - 31 GROUP BY 1),
 tr AS (SELECT n.entity, n.idx, n.value, coalesce(t, CASE WHEN idx < 10 THEN a.i + a.s * idx ELSE b.i + b.s * idx END) AS trend FROM n JOIN a ON a.entity = n.entity JOIN b ON b.entity = n.entity),
 ph AS (SELECT entity, idx % 21 AS p, avg(value - trend) AS m FROM tr GROUP BY 1, 2), c AS (SELECT entity, avg(m) AS c FROM ph GROUP BY 1)
 SELECT tr.entity, tr.idx, round(trend, 3) AS trend, round(m - c, 3) AS seasonal, round(value - trend - m + c, 3) AS residual FROM tr JOIN ph ON ph.entity = tr.entity AND ph.p = tr.idx % 21 JOIN c ON c.entity = tr.entity"""
)
def seasonal_decompose(spark, d):
    return rounded(SP.decompose(panel(spark, d)).drop("value"), 3)


@query(f"WITH {SEGMENTS}, {_DETREND}, {_SPEC}, nb AS (SELECT *, lag(power) OVER w AS a, lead(power) OVER w AS b FROM spec WINDOW w AS (PARTITION BY entity ORDER BY k)), pk AS (SELECT entity, n * 1.0 / k AS period, power, row_number() OVER (PARTITION BY entity ORDER BY k) AS i FROM nb WHERE power > a AND power > b AND power >= 0.05 AND k > 0) SELECT entity, round(period, 1) AS period, round(power, 3) AS strength, {_QUICK} AS category FROM pk WHERE i <= 5 AND period > 5 AND period < 200")
def quick_fft(spark, d):
    return rounded(SP.quick_cycles(_segments(spark, d)))


_SHUFFLED = "SELECT entity, r AS replica, v, row_number() OVER (PARTITION BY entity, r ORDER BY CASE WHEN r > 0 THEN md5('42|' || entity || '|' || r || '|' || idx) END, idx) - 1 AS place FROM {source}, (SELECT unnest(range(0, 1001)) AS r)"
_NULL = "(1 + count(*) FILTER (WHERE {reached})) / (1.0 + count(*)) AS p, avg(x) AS null_mean, stddev_pop(x) AS null_std"


@query(
    f"""WITH {SEGMENTS}, {_DETREND}, {_SPEC}, {_PEAKS}, sh AS ({_SHUFFLED.format(source="x")}),
 st AS (SELECT sh.entity, period_days, replica, 2.0 / count(*) * sqrt(pow(sum(v * cos(2 * pi() * place / period_days)), 2) + pow(sum(v * sin(2 * pi() * place / period_days)), 2)) AS x FROM sh JOIN cyc ON cyc.entity = sh.entity AND cyc.rank <= 3 GROUP BY 1, 2, 3),
 ow AS (SELECT entity, period_days, x AS own FROM st WHERE replica = 0),
 nu AS (SELECT st.entity, st.period_days, any_value(own) AS own, {_NULL.format(reached="x >= own")}, quantile_cont(x, 0.95) AS null_p95 FROM st JOIN ow ON ow.entity = st.entity AND ow.period_days = st.period_days WHERE replica > 0 GROUP BY 1, 2)
 SELECT entity, round(period_days, 6) AS period_days, round(own, 6) AS strength, round(p, 6) AS p, round((own - null_mean) / null_std, 4) AS z, round(null_mean, 6) AS null_mean, round(null_std, 6) AS null_std, round(null_p95, 6) AS null_p95 FROM nu"""
)
def boot_cycle(spark, d):
    s = _segments(spark, d)
    found = PT.cycle_significance(s, SP.top(SP.cycles(s, 0.1, 0.55), 3), n=1000)
    return rounded(found.withColumn("z", F.round("z", 4)))


_PV = "p AS (SELECT p_size AS entity, p_partkey * 1.0 AS period_days, (p_partkey * 7919 % 1000) / 20000.0 AS p FROM part), r AS (SELECT *, count(*) OVER (PARTITION BY entity) AS m, row_number() OVER (PARTITION BY entity ORDER BY p, period_days) AS i FROM p)"


@query(f"WITH {_PV}, c AS (SELECT *, max(CASE WHEN p <= 0.05 * i / m THEN p END) OVER (PARTITION BY entity) AS cut FROM r) SELECT entity, period_days, p, p <= 0.05 / m AS bonferroni, coalesce(p <= cut, false) AS fdr FROM c")
def multi_test(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").alias("entity"), F.col("p_partkey").cast("double").alias("period_days"), (F.col("p_partkey") * 7919 % 1000 / 20000.0).alias("p"))
    return SP.multiple_tests(p)


def _states(spark, d):
    return H.states(H.features(market(spark, d)), 4, 1000)


@query()
def hmm_predict(spark, d):
    return _states(spark, d).drop("transitions")


@query()
def regime_profile(spark, d):
    return H.profiles(_states(spark, d))


@query()
def regime_transitions(spark, d):
    return H.transitions(_states(spark, d))


@query(f"WITH {PANEL}, s AS (SELECT idx, CAST(floor(value / 400000) AS INTEGER) AS state, entity FROM panel), e AS (SELECT min(n) AS n FROM (SELECT entity, count(*) AS n FROM s GROUP BY 1)), c AS (SELECT idx, state, count(*) AS c FROM s GROUP BY 1, 2), h AS (SELECT idx, max(c) * 1.0 / sum(c) AS share FROM c, e WHERE idx < e.n GROUP BY 1) SELECT round(avg(share), 6) AS average, max(share) AS highest, min(share) AS lowest FROM h")
def regime_sync(spark, d):
    return rounded(H.synchronization(panel(spark, d).withColumn("state", F.floor(F.col("value") / 400000).cast("int"))))


@query("SELECT p_partkey, round(1 / (1 - p_size / 100.0), 6) AS duration FROM part")
def expected_duration(spark, d):
    return rounded(table(spark, d, "part").select("p_partkey", R.expected_duration(F.col("p_size") / 100).alias("duration")))


@query()
def perm_regime(spark, d):
    return PT.separation(_states(spark, d), n=1000).select("entity", F.col("statistic").alias("variance_ratio"), "p")


_PARTED = f"""m AS (SELECT entity, idx, close AS v, ntile(3) OVER (PARTITION BY entity ORDER BY volume, idx) - 1 AS state FROM market), sh AS ({_SHUFFLED.format(source="m")}),
 pe AS (SELECT sh.entity, replica, m.state, count(*) AS n, sum(sh.v) AS s, sum(sh.v * sh.v) AS q FROM sh JOIN m ON m.entity = sh.entity AND m.idx = sh.place GROUP BY 1, 2, 3),
 me AS (SELECT *, s / n - lag(s / n) OVER (PARTITION BY entity, replica ORDER BY state) AS step, sum(s) OVER (PARTITION BY entity, replica) / sum(n) OVER (PARTITION BY entity, replica) AS mean FROM pe),
 st AS (SELECT entity, replica, 'variance_ratio' AS metric, (sum(n * pow(s / n - mean, 2)) / sum(n)) / (sum(q - s * s / n) / sum(n) + 1e-10) AS x FROM me GROUP BY 1, 2 UNION ALL SELECT entity, replica, 'mean_difference', max(abs(step)) FROM me GROUP BY 1, 2
  UNION ALL SELECT entity, replica, 'log_likelihood', sum(-0.5 * n * (ln(2 * pi() * (greatest(q / n - pow(s / n, 2), 0) + 1e-12)) + 1)) FROM me GROUP BY 1, 2),
 ow AS (SELECT entity, metric, x AS own FROM st WHERE replica = 0)"""


@query(
    f"""WITH {MARKET}, {_PARTED}, nu AS (SELECT st.entity, st.metric, any_value(own) AS own, {_NULL.format(reached="abs(x) >= abs(own)")} FROM st JOIN ow ON ow.entity = st.entity AND ow.metric = st.metric WHERE replica > 0 GROUP BY 1, 2)
 SELECT entity, metric, round(own, 5) AS statistic, round(p, 6) AS p, round(null_mean, 4) AS null_mean, round(null_std, 4) AS null_std FROM nu"""
)
def perm_separation(spark, d):
    """Do the thirds of the days by volume part their prices? By each statistic."""
    third = F.ntile(3).over(Window.partitionBy("entity").orderBy("volume", "idx")) - 1
    m = market(spark, d).withColumn("state", third)
    found = PT.separation(m, "close", n=1000, metrics=PT.METRICS)
    return rounded(found.select("entity", "metric", F.round("statistic", 5).alias("statistic"), "p", F.round("null_mean", 4).alias("null_mean"), F.round("null_std", 4).alias("null_std")))


@query()
def ts_cv(spark, d):
    return H.cross_validate(H.features(market(spark, d)), 4, 5)


def _matches(spark, d):
    return M.find(panel(spark, d), threshold=0.2)


@query(Q.DTW_MATCH)
def dtw_match(spark, d):
    return rounded(_matches(spark, d))


@query(Q.DTW_PREDICT)
def dtw_predict(spark, d):
    s, m = panel(spark, d), _matches(spark, d)
    return rounded(M.predict(m, M.outcomes(s, m)))


@query(Q.OUTCOME)
def outcome(spark, d):
    """What followed every match of whole series, over both horizons."""
    p = panel(spark, d)
    return rounded(M.outcomes(p, _matches(spark, d)).select("entity", "start", "horizon", "total", "mean", "std", "sharpe", "max_drawdown"))


@query("SELECT l_orderkey, l_linenumber, round(1 / (1 + l_tax * 10 / 2), 9) AS similarity FROM lineitem WHERE 1 / (1 + l_tax * 10 / 2) >= 0.8")
def filter_matches(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", R.match_similarity(F.col("l_tax") * 10).alias("similarity")).where("similarity >= 0.8")
    return rounded(x, 9)


@query(Q.PELT)
def pelt(spark, d):
    return rounded(CP.detect(panel(spark, d), "pelt", "l2", penalty=6.0, least=10, scaled=True))


@query(Q.BINSEG)
def binseg(spark, d):
    return rounded(CP.detect(panel(spark, d), "binseg", penalty=0.001, least=10, scaled=True))


@query(Q.CUSUM)
def cusum(spark, d):
    return rounded(CP.detect(panel(spark, d), "cusum"))


@query()
def cp_bootstrap(spark, d):
    return CP.bootstrap(panel(spark, d), n=100, method="binseg", penalty=0.001, least=10)


@query(f"WITH {PANEL} SELECT entity, idx // 300 AS segment, min(idx) AS start, max(idx) + 1 AS \"end\", count(*) AS length, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(median(value), 4) AS median, round(regr_slope(value, idx), 4) AS slope FROM panel GROUP BY 1, 2 HAVING count(*) > 1")
def segment_stats(spark, d):
    p = panel(spark, d)
    s = CP.segments(p, p.where("idx > 0 and idx % 300 = 0").select("entity", "idx")).where("length > 1")
    return rounded(s.select("entity", "segment", "start", "end", "length", "mean", "std", "median", "slope"), 4)


@query()
def wavelet_ridges(spark, d):
    return W.dominant(W.series_ridges(panel(spark, d), least=0.02))


_SMALL = [1, 2, 3, 4, 5, 8]
_CWT = f"""ti AS (SELECT unnest(range(0, 4096)) AS i), tv AS (SELECT i, -8 + 16.0 * i / 4095 AS t FROM ti), tb AS (SELECT i, sum(exp(-t * t / 2) * cos(5 * t)) OVER (ORDER BY i) * 16.0 / 4095 AS g FROM tv),
 ks AS (SELECT s, unnest(range(0, 16 * s + 1)) AS k FROM (SELECT unnest({_SMALL}) AS s)), gk AS (SELECT s, 16 * s - k AS u, g FROM ks JOIN tb ON tb.i = (k * 4095) // (16 * s)),
 fl AS (SELECT s, u, -sqrt(s) * sum(h) AS h FROM (SELECT s, u, g AS h FROM gk UNION ALL SELECT s, u + 1, -g FROM gk) GROUP BY 1, 2),
 zs AS (SELECT entity, idx, (value - avg(value) OVER (PARTITION BY entity)) / stddev_pop(value) OVER (PARTITION BY entity) AS z FROM panel), nn AS (SELECT entity, max(idx) AS last FROM panel GROUP BY 1),
 cf AS (SELECT zs.entity, s, idx + u - (16 * s + 2 - 3) // 2 - 1 AS t, sum(z * h) AS c FROM zs JOIN fl ON true JOIN nn ON nn.entity = zs.entity WHERE idx + u - (16 * s + 2 - 3) // 2 - 1 BETWEEN 0 AND last GROUP BY 1, 2, 3)"""


@query(f"WITH {PANEL}, {_CWT} SELECT entity, CAST(s AS DOUBLE) AS scale, round(s / 0.8125, 6) AS period, t AS idx, round(c, 6) AS coefficient FROM cf")
def cwt(spark, d):
    """Coefficients of small scales, where the integral matters most."""
    return rounded(W.power(panel(spark, d), _SMALL).select("entity", "scale", "period", "idx", "coefficient"))


@query(f"WITH {PANEL}, {_CWT} SELECT entity, CAST(s AS DOUBLE) AS scale, round(s / 0.8125, 6) AS period, round(avg(c * c), 6) AS power FROM cf GROUP BY entity, s")
def cwt_spectrum(spark, d):
    return rounded(W.global_spectrum(W.power(panel(spark, d), _SMALL)))


@query(f"WITH {PANEL}, {_CWT} SELECT entity, t AS idx, round(avg(c * c), 6) AS power FROM cf GROUP BY entity, t")
def cwt_scale_average(spark, d):
    return rounded(W.scale_average(W.power(panel(spark, d), _SMALL)))


@query(
    f"""WITH {PANEL}, {_CWT}, ls AS (SELECT entity, coalesce(corr(value, b), 0) AS a FROM (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY idx) AS b FROM panel) GROUP BY 1)
 SELECT cf.entity, CAST(s AS DOUBLE) AS scale, round(avg(CASE WHEN c * c > (1 - a * a) / (1 + a * a - 2 * a * cos(2 * pi() / s)) * (-2 * ln(0.05)) / 2 THEN 1.0 ELSE 0.0 END), 6) AS share FROM cf JOIN ls ON ls.entity = cf.entity GROUP BY cf.entity, s"""
)
def cwt_red_noise(spark, d):
    s = panel(spark, d)
    return rounded(W.significant(W.power(s, _SMALL), s).groupBy("entity", "scale").agg(F.avg(F.col("significant").cast("double")).alias("share")))


@query(
    f"""WITH {PANEL}, {_CWT}, ed AS (SELECT entity, s, quantile_cont(c * c, 0.5) + stddev_pop(c * c) AS edge, count(*) AS n FROM cf GROUP BY 1, 2), ab AS (SELECT cf.entity, cf.s, t, c * c AS p, n, t - row_number() OVER (PARTITION BY cf.entity, cf.s ORDER BY t) AS run FROM cf JOIN ed ON ed.entity = cf.entity AND ed.s = cf.s WHERE c * c > edge)
 SELECT entity, CAST(s AS DOUBLE) AS scale, min(t) AS start, max(t) + 1 AS "end", count(*) AS duration, round(avg(p), 6) AS strength, round(max(p), 6) AS max_strength, round(count(*) * 1.0 / any_value(n), 6) AS persistence FROM ab GROUP BY entity, s, run HAVING count(*) >= floor(0.002 * any_value(n))"""
)
def cwt_ridges(spark, d):
    """Ridges of small scales, found in the kernel."""
    return rounded(W.series_ridges(panel(spark, d), _SMALL, least=0.002).drop("period"))


@query()
def quick_wavelet(spark, d):
    """The lasting ridges of how far each priority's total runs ahead of its mean."""
    every = Window.partitionBy("entity")
    ahead = F.sum(F.col("value") - F.col("mean")).over(every.orderBy("idx"))
    return W.quick(panel(spark, d).withColumn("mean", F.avg("value").over(every)).withColumn("value", ahead), "mexican_hat")


@query()
def red_noise_sig(spark, d):
    s = panel(spark, d)
    return W.significant(W.power(s, W.SCALES), s).groupBy("entity", "scale").agg(F.avg(F.col("significant").cast("int")).alias("share"))


@query()
def compare_fourier(spark, d):
    s = _segments(spark, d)
    return W.compare(W.dominant(W.series_ridges(s, least=0.02)), SP.top(SP.cycles(s, 0.1, 0.55)))


@query(f"WITH {PANEL}, n AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM panel) SELECT entity, idx, round(least(idx, n - 1 - idx) * sqrt(2), 6) AS coi FROM n")
def coi(spark, d):
    n = F.count("*").over(Window.partitionBy("entity"))
    return rounded(panel(spark, d).withColumn("n", n).select("entity", "idx", W.cone(F.col("idx"), F.col("n")).alias("coi")))


_LAG = """pr AS (SELECT a.entity AS a, b.entity AS b, a.value AS x, b.value AS y, row_number() OVER (PARTITION BY a.entity, b.entity ORDER BY a.ts) AS i FROM panel a JOIN panel b ON a.ts = b.ts AND a.entity < b.entity),
 lg AS (SELECT p.a, p.b, l.lag, count(*) AS n, corr(p.x, q.y) AS r FROM pr p, (SELECT unnest(range(-30, 31)) AS lag) l JOIN pr q ON q.a = p.a AND q.b = p.b AND q.i = p.i + l.lag GROUP BY 1, 2, 3 HAVING count(*) >= 20),
 bs AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY round(abs(coalesce(r, 0)), 10) DESC, lag) AS k FROM lg)"""


@query(f"WITH {PANEL}, {_LAG} SELECT a, b, CAST(lag AS INTEGER) AS lag, n, round(r, 6) AS r FROM bs WHERE k = 1")
def lag_corr(spark, d):
    return rounded(CO.lagged(panel(spark, d), 30).select("a", "b", "lag", "n", "r"))


@query(Q.tested(_LAG))
def corr_tested(spark, d):
    return rounded(CO.tested(CO.lagged(panel(spark, d), 30)).select("a", "b", "lag", "n", "r", "p", "text"))


_EDGE = "ed AS (SELECT a.entity AS a, b.entity AS b, corr(a.value, b.value) AS r FROM panel a JOIN panel b ON a.ts = b.ts AND a.entity < b.entity GROUP BY 1, 2)"


@query(f"WITH {PANEL}, {_EDGE}, n AS (SELECT DISTINCT entity FROM panel), k AS (SELECT a, b, r FROM ed UNION ALL SELECT b, a, r FROM ed) SELECT x.entity AS a, y.entity AS b, round(CASE WHEN x.entity = y.entity THEN 1 ELSE coalesce(k.r, 0) END, 6) AS r FROM n x CROSS JOIN n y LEFT JOIN k ON k.a = x.entity AND k.b = y.entity")
def corr_matrix(spark, d):
    p = panel(spark, d)
    return rounded(CO.matrix(p, CO.edges(p)))


_NET = f"{_EDGE}, net AS (SELECT a, b FROM ed WHERE abs(r) >= 0.03)"


@query(f"WITH {PANEL}, {_NET} SELECT a, b FROM net")
def network_edges(spark, d):
    return CO.network(CO.edges(panel(spark, d)), 0.03).select("a", "b")


@query(
    f"""WITH {PANEL}, {_NET}, bo AS (SELECT a, b FROM net UNION ALL SELECT b, a FROM net), dg AS (SELECT a, count(*) AS k FROM bo GROUP BY 1), tr AS (SELECT x.a, x.b, y.b AS c FROM net x JOIN net y ON y.a = x.b JOIN net z ON z.a = x.a AND z.b = y.b),
 co AS (SELECT v, count(*) AS t FROM (SELECT unnest([a, b, c]) AS v FROM tr) GROUP BY 1), n AS (SELECT count(DISTINCT entity) AS n FROM panel)
 SELECT n.n AS nodes, (SELECT count(*) FROM net) AS edges, round((SELECT count(*) FROM net) * 2.0 / (n.n * (n.n - 1)), 6) AS density, round(coalesce((SELECT sum(coalesce(2.0 * t / nullif(k * (k - 1), 0), 0)) FROM dg LEFT JOIN co ON co.v = dg.a), 0) / n.n, 6) AS clustering FROM n"""
)
def network_metrics(spark, d):
    p = panel(spark, d)
    return rounded(CO.density_and_clustering(CO.network(CO.edges(p), 0.03), p.select("entity").distinct()))


@query(Q.clusters(PANEL, 0.02))
def clusters(spark, d):
    return rounded(CO.clusters(CO.edges(panel(spark, d)), Stages(spark), 0.02))


@query(Q.CENTRALITY)
def eigen_centrality(spark, d):
    _shared(spark)
    return rounded(CO.eigenvector_centrality(CO.network(CO.edges(panel(spark, d)), 0.0), tolerance=1e-10), 5)


@query(Q.PATHS)
def path_lengths(spark, d):
    _shared(spark)
    return CO.path_lengths(CO.network(CO.edges(panel(spark, d)), 0.0)).groupBy("hops").count()


#: Daily order value of each nation.
NATIONS = PANEL.replace("SELECT o_orderpriority AS entity", "SELECT n_name AS entity").replace("FROM orders GROUP", "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP")


@query(Q.clusters(NATIONS, 0.04))
def nation_clusters(spark, d):
    return rounded(CO.clusters(CO.edges(nations(spark, d)), Stages(spark), 0.04))


@query(Q.part_paths(NATIONS, 0.04))
def part_paths(spark, d):
    """Connected parts of the network of nations, and the mean number of hops within each."""
    return rounded(CO.part_paths(CO.network(CO.edges(nations(spark, d)), 0.04), Stages(spark)))


@query(
    f"""WITH {NATIONS}, lab AS (SELECT n_name AS entity, n_regionkey AS cluster FROM nation), {_EDGE} SELECT x.cluster, CAST(any_value(n) AS INTEGER) AS size, round(sum(coalesce(r, 0)) / (any_value(n) * (any_value(n) - 1) / 2.0), 6) AS avg_correlation
 FROM ed JOIN lab x ON x.entity = a JOIN lab y ON y.entity = b AND y.cluster = x.cluster JOIN (SELECT cluster, count(*) AS n FROM lab GROUP BY 1) s ON s.cluster = x.cluster GROUP BY x.cluster"""
)
def cluster_avg_corr(spark, d):
    """Mean correlation within clusters that are given: the nations of each region."""
    labels = table(spark, d, "nation").select(F.col("n_name").alias("entity"), F.col("n_regionkey").alias("cluster"))
    return rounded(CO.cluster_means(CO.edges(nations(spark, d)), labels))


@query("SELECT a.c_custkey AS a, b.c_custkey AS b, CASE WHEN a.c_mktsegment = b.c_mktsegment THEN 'party' WHEN a.c_nationkey = b.c_nationkey THEN 'state' ELSE 'unexplained' END AS reason FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1")
def coordinated(spark, d):
    c = table(spark, d, "customer")
    meta = c.select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("party"), F.col("c_nationkey").cast("string").alias("state"))
    pairs = c.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b")).join(c.select(F.col("c_custkey").alias("b")), "b", "left_semi")
    return CO.coordinated(pairs, meta).select("a", "b", "reason")


_VOTES = "v AS (SELECT p_size AS entity, CASE p_partkey % 3 WHEN 0 THEN 'fourier' WHEN 1 THEN 'hmm' ELSE 'dtw' END AS model, (p_retailprice - 1500) / 100 AS p, (p_partkey % 97 + 1) / 100.0 AS c FROM part), w AS (SELECT *, CASE model WHEN 'dtw' THEN 0.30 ELSE 0.35 END AS w FROM v)"


def _votes(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.col("p_size").alias("entity"), F.when(k % 3 == 0, "fourier").when(k % 3 == 1, "hmm").otherwise("dtw").alias("model"), ((F.col("p_retailprice") - 1500) / 100).alias("prediction"), ((k % 97 + 1) / 100).alias("confidence"))


@query(f"WITH {_VOTES} SELECT entity, count(*) AS models, round(sum(w * c * p) / sum(w * c), 6) AS value, round(sum(w * c) / sum(w), 6) AS confidence, round(CASE WHEN count(*) < 2 THEN 1 WHEN max(p) > 0 AND min(p) < 0 THEN 0.3 ELSE 1 / (1 + stddev_pop(p) / abs(avg(p))) END, 6) AS agreement FROM w GROUP BY 1")
def ensemble_vote(spark, d):
    return rounded(E.vote(_votes(spark, d)))


@query(
    f"""WITH {_VOTES}, h AS (SELECT v.model, v.p, v.c, row_number() OVER (PARTITION BY model ORDER BY p_partkey DESC) AS r FROM (SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN 'fourier' ELSE 'hmm' END AS model, (p_retailprice - 1500) / 100 AS p, (p_partkey % 97 + 1) / 100.0 AS c FROM part) v),
 e AS (SELECT model, avg(abs(p) * c) AS e FROM h WHERE r <= 100 GROUP BY 1), m AS (SELECT k.model, 1 / (1 + coalesce(e.e, 1)) AS raw FROM (SELECT unnest(['fourier', 'hmm', 'dtw']) AS model) k LEFT JOIN e ON e.model = k.model) SELECT model, round(raw / sum(raw) OVER (), 6) AS weight FROM m"""
)
def meta_weights(spark, d):
    k = F.col("p_partkey")
    h = table(spark, d, "part").select(F.when(k % 2 == 0, "fourier").otherwise("hmm").alias("model"), k.alias("seq"), ((F.col("p_retailprice") - 1500) / 100).alias("predicted"), F.lit(0.0).alias("actual"), ((k % 97 + 1) / 100).alias("confidence"))
    return rounded(E.meta_weights(h))


@query("SELECT l_orderkey, l_linenumber, round(least((CASE WHEN l_discount * 10 < 0.5 THEN 0.3 ELSE 0 END) + (CASE WHEN l_tax * 10 < 0.6 THEN 0.3 ELSE 0 END) + (CASE WHEN l_quantity / 10 > 3 OR l_quantity / 10 < 0.33 THEN 0.4 ELSE 0 END), 1), 6) AS anomaly, CASE WHEN l_quantity - 25 > 2 THEN 'trade_increase' WHEN l_quantity - 25 < -2 THEN 'trade_decrease' WHEN l_linenumber < 3 THEN 'regime_change' WHEN l_tax > 1.5 * l_discount THEN 'cycle_peak' ELSE 'anomaly' END AS type FROM lineitem")
def anomaly_score(spark, d):
    c = F.col
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", R.anomaly_score(c("l_discount") * 10, c("l_tax") * 10, c("l_quantity") / 10).alias("anomaly"), R.prediction_type(c("l_quantity") - 25, c("l_linenumber") + 4, c("l_tax"), c("l_discount")).alias("type")))


def _insights(spark, d):
    stage = Stages(spark)  # what several models read is made once
    p = stage(panel(spark, d))
    s = p.withColumn("value", F.col("value") / 1e5)
    bars = p.select("entity", "idx", F.col("value").alias("close"), F.col("value").alias("volume"))
    cy, st = stage(SP.cycles(s, 0.1, 0.55)), stage(H.states(H.features(bars.withColumn("close", F.col("close") + 1e6)), 4, 1000))
    pr, cu, ma = H.profiles(st), H.current(st), stage(M.find(s, threshold=0.2))
    pd_ = M.predict(ma, M.outcomes(s, ma, horizons=(30,)))
    fc = SP.forecast(s, cy)
    best = cy.groupBy("entity").agg(F.max("confidence").alias("confidence"))
    votes = E.fourier_vote(fc, best).unionByName(E.hmm_vote(cu, pr)).unionByName(E.dtw_vote(pd_))
    stay = cu.join(pr, ["entity", "state"]).select("entity", "expected_duration")
    ens = E.classify(E.vote(votes), s, stay, pd_.select("entity", F.col("confidence").alias("match_confidence")))
    pairs = CO.tested(CO.lagged(s)).select("a", "b", "r", "p", "lag")
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("entity"), F.col("o_orderstatus").alias("sector")).agg(F.count("*").alias("n"))
    shares = o.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("entity")))
    return ens, E.insights(cy, pr, cu, ma, ens, pairs=pairs, shares=shares)


@query()
def ensemble(spark, d):
    return _insights(spark, d)[0]


@query()
def insights(spark, d):
    return _insights(spark, d)[1].select("entity", "type", "severity", "title", "confidence", "priority")


@query()
def exec_summary(spark, d):
    return E.summary(_insights(spark, d)[1])


def _prices(spark, d):
    return market(spark, d).select("entity", "idx", F.col("close").alias("price"))


@query(
    f"""WITH {MARKET}, n AS (SELECT entity, idx, close, count(*) OVER (PARTITION BY entity) AS n FROM market), k AS (SELECT n.entity, n.idx, max(w.k) AS k FROM n, (SELECT unnest(range(0, 500)) AS k) w WHERE 252 + w.k * 21 <= n.idx AND n.idx < 252 + w.k * 21 + 63 AND 252 + w.k * 21 + 63 <= n.n GROUP BY 1, 2),
 a AS (SELECT entity, idx + 1 AS at, CASE WHEN avg(close) OVER (PARTITION BY entity ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > avg(close) OVER (PARTITION BY entity ORDER BY idx ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) THEN 1.0 ELSE -1.0 END AS s FROM market)
 SELECT n.entity, n.idx, coalesce(a.s, 0) AS signal FROM n LEFT JOIN k ON k.entity = n.entity AND k.idx = n.idx LEFT JOIN a ON a.entity = n.entity AND a.at = 252 + k.k * 21"""
)
def walk_forward(spark, d):
    return B.ma_signals(_prices(spark, d), B.Config()).select("entity", "idx", "signal")


def _ma(train, test):
    import numpy as np

    p = train["price"].to_numpy()
    return np.full(len(test), 1.0 if p[-20:].mean() > p[-50:].mean() else -1.0)


@query(Q.BACKTEST)
def backtest(spark, d):
    return rounded(B.metrics(B.run(_prices(spark, d))))


@query(Q.COMPARE)
def compare_strategies(spark, d):
    p = _prices(spark, d)
    return rounded(B.metrics(B.run(p)).withColumn("strategy", F.lit("ma")).unionByName(B.metrics(B.run(p, strategy=_ma)).withColumn("strategy", F.lit("callable"))).unionByName(B.metrics(B.run(p, B.Config(stop=0.05, take=0.1))).withColumn("strategy", F.lit("stopped"))))


@query()
def monte_carlo(spark, d):
    return B.monte_carlo(B.run(_prices(spark, d)), 1000)


@query(f"WITH {MARKET}, g AS (SELECT *, date_diff('day', lag(ts) OVER (PARTITION BY entity ORDER BY idx), ts) AS gap FROM market) SELECT entity, count(*) AS n, count(*) >= 10 AND var_pop(close) >= 1e-10 AS is_valid, max(gap) AS longest_gap FROM g GROUP BY 1")
def validate_series(spark, d):
    """Days with trades, which have gaps of their own."""
    return V.series(market(spark, d).withColumn("value", F.col("close"))).select("entity", "n", "is_valid", F.col("longest_gap").cast("long").alias("longest_gap"))


_HOLED = "ho AS (SELECT entity, ts, idx, CASE WHEN idx % 17 = 3 OR idx < 2 THEN NULL WHEN idx % 31 = 5 THEN 'NaN'::DOUBLE WHEN idx % 97 = 11 THEN 'Infinity'::DOUBLE WHEN idx % 101 = 12 THEN '-Infinity'::DOUBLE ELSE value END AS v FROM panel)"


def _holed(spark, d):
    """The panel with missing, odd and infinite values."""
    i, x = F.col("idx"), lambda v: F.lit(float(v))
    value = F.when((i % 17 == 3) | (i < 2), None).when(i % 31 == 5, x("nan")).when(i % 97 == 11, x("inf")).when(i % 101 == 12, x("-inf")).otherwise(F.col("value"))
    return panel(spark, d).withColumn("value", value)


@query(
    f"""WITH {PANEL}, {_HOLED}, fi AS (SELECT *, v IS NULL OR isnan(v) AS hole, CASE WHEN v IS NOT NULL AND NOT isnan(v) THEN v END AS k FROM ho),
 fl AS (SELECT *, coalesce(k, last_value(k IGNORE NULLS) OVER (PARTITION BY entity ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(k IGNORE NULLS) OVER (PARTITION BY entity ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS f,
  min(CASE WHEN isfinite(k) THEN k END) OVER (PARTITION BY entity) AS lo, max(CASE WHEN isfinite(k) THEN k END) OVER (PARTITION BY entity) AS hi FROM fi)
 SELECT entity, idx, round(CASE WHEN NOT isinf(f) THEN f WHEN f > 0 THEN hi ELSE lo END, 4) AS value, CASE WHEN hole THEN 'filled' WHEN isinf(v) THEN 'clipped' END AS was FROM fl"""
)
def validate_repaired(spark, d):
    """Series with holes and infinities, as `validated` hands them on."""
    return rounded(V.repaired(_holed(spark, d)).select("entity", "idx", "value", "was"), 4)


@query(f"WITH {PANEL}, {_HOLED} SELECT entity, count(*) AS n, count(*) FILTER (WHERE v IS NULL OR isnan(v)) AS holes, count(*) FILTER (WHERE isinf(v)) AS infinite, count(*) FILTER (WHERE v IS NULL OR isnan(v)) < 0.1 * count(*) AS is_valid FROM ho GROUP BY 1")
def quick_validate(spark, d):
    return V.quick(_holed(spark, d), raise_on_error=False).select("entity", "n", "holes", "infinite", "is_valid")


@query(f"WITH {PANEL}, g AS (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY idx) AS b FROM panel) SELECT entity, count(*) AS n, count(*) FILTER (WHERE value <= 0) AS negative, round(avg(CASE WHEN value - b = 0 THEN 1.0 WHEN b IS NULL THEN NULL ELSE 0.0 END), 6) AS stale, count(*) FILTER (WHERE abs(value / nullif(b, 0) - 1) > 0.5) AS jumps FROM g GROUP BY 1")
def validate_prices(spark, d):
    return rounded(V.prices(panel(spark, d)).select("entity", "n", "negative", "stale", "jumps"))


@query(Q.RETURNS)
def validate_returns(spark, d):
    from ..operators.indicators import returns

    return rounded(V.returns(market(spark, d).withColumn("value", returns(F.col("close")))).select("entity", "is_valid", "n", "extremes", "skew", "kurtosis"))


@query()
def unit_root(spark, d):
    """The statistic of the augmented Dickey-Fuller test, and all that is said of the returns."""
    from ..operators.indicators import returns

    return V.returns(market(spark, d).withColumn("value", returns(F.col("close")))).select("entity", "issues", "warnings", "adf")


@query()
def tune(spark, d):
    """A hundred trials each of the cheap detectors; the trials learn from each other."""
    s, stage = panel(spark, d), Stages(spark)
    runs = {"changepoint": T.score_changepoint, "fourier": T.score_fourier}
    found = [T.learned_search(s, T.SPACES[k], f, stage).select("entity", F.lit(k).alias("model"), "trial", "params", "score", "best") for k, f in runs.items()]
    return found[0].unionByName(found[1])


@query(
    """WITH t AS (SELECT p_brand AS entity, p_size AS size, (p_retailprice - 1000) / 1000 AS price, p_partkey % 5 AS kind, p_retailprice / 100 + CASE WHEN p_size > 25 THEN 3 ELSE 0 END AS score FROM part),
 l AS (SELECT entity, 'size' AS parameter, least(floor((size - 1) / 49.0 * 10), 9) AS bin, score FROM t UNION ALL SELECT entity, 'price', least(floor((price + 0.2) / 1.4 * 10), 9), score FROM t UNION ALL SELECT entity, 'kind', kind, score FROM t),
 m AS (SELECT entity, parameter, bin, avg(score) AS m, count(*) AS n FROM l GROUP BY 1, 2, 3), c AS (SELECT *, sum(m * n) OVER (PARTITION BY entity, parameter) / sum(n) OVER (PARTITION BY entity, parameter) AS c FROM m),
 v AS (SELECT entity, parameter, sum(n * pow(m - c, 2)) / sum(n) AS v FROM c GROUP BY 1, 2) SELECT entity, parameter, round(coalesce(v / nullif(sum(v) OVER (PARTITION BY entity), 0), 0), 6) AS importance FROM v"""
)
def tune_importance(spark, d):
    """What matters among trials that are given: the parts of each brand, scored by price and size."""
    part = table(spark, d, "part")
    size, price, kind = F.col("p_size").cast("double"), (F.col("p_retailprice") - 1000) / 1000, (F.col("p_partkey") % 5).cast("double")
    given = part.select(F.col("p_brand").alias("entity"), F.create_map(F.lit("size"), size, F.lit("price"), price.cast("double"), F.lit("kind"), kind).alias("params"), (F.col("p_retailprice") / 100 + F.when(size > 25, 3).otherwise(0)).alias("score"))
    return rounded(T.importance(given, {"size": (1, 50), "price": (-0.2, 1.2), "kind": (0, 4)}))


@query()
def tune_models(spark, d):
    """Searches over wavelets, regimes and small networks of few epochs."""
    s = panel(spark, d)
    small = {"hidden": (4, 8), "layers": (1, 2), "length": (10, 20), "log10_rate": (-3.0, -2.0), "epochs": (1, 2)}
    runs = {"wavelet": (T.SPACES["wavelet"], T.score_wavelet, 3), "hmm": (T.SPACES["hmm"], T.score_hmm, 3), "lstm": (small, T.score_lstm, 2)}
    found = [T.search(s, space, score, n).select("entity", F.lit(name).alias("model"), "trial", "params", "score", "best") for name, (space, score, n) in runs.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


_LSTM = L.Config(epochs=3, hidden=8, rate=1e-2, batch=64)


@query()
def lstm_train(spark, d):
    return L.train(panel(spark, d), _LSTM)


@query()
def lstm_predict(spark, d):
    return L.predict(panel(spark, d), _LSTM)


@query()
def lstm_anomaly(spark, d):
    return L.anomalies(L.predict(panel(spark, d), _LSTM), 1.0)


@query()
def lstm_attention(spark, d):
    return L.attention(L.predict(panel(spark, d), _LSTM))


@query(f"WITH {PANEL} SELECT entity, idx, round(value, 4) AS y, round(lag(value, 5) OVER (PARTITION BY entity ORDER BY idx), 4) AS x0 FROM panel QUALIFY row_number() OVER (PARTITION BY entity ORDER BY idx) > 5")
def lstm_dataset(spark, d):
    return L.dataset(panel(spark, d), 5).select("entity", "idx", F.round("y", 4).alias("y"), F.round(F.col("x")[0], 4).alias("x0"))


@query(f"WITH {PANEL}, a AS (SELECT entity, count(*) AS n, avg(value) AS mean FROM panel GROUP BY 1) SELECT entity, 'n' AS metric, CAST(n AS DOUBLE) AS value FROM a UNION ALL SELECT entity, 'mean', round(mean, 6) FROM a")
def cyclical_tracker(spark, d):
    return rounded(flattened(panel(spark, d).groupBy("entity").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "entity"))


def _shared(spark) -> str:
    """The folder that all executors share; only a local master may do without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = tempfile.mkdtemp(prefix="seriesforge-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


@query(f"WITH {SEGMENTS}, {_DETREND}, {_SPEC}, {_PEAKS} SELECT entity, CAST(rank AS INTEGER) AS rank, round(period_days, 6) AS period_days, round(strength, 6) AS strength, round(confidence, 6) AS confidence, {_CAT} AS category FROM cyc WHERE rank <= 3")
def sink_model(spark, d):
    s = Store(spark, f"{_shared(spark)}/store-{uuid.uuid4().hex}")
    s.save(SP.top(_cycles(spark, d)), "cycles", "v1.0.0", "fourier", {"min_strength": 0.1})
    s.save(SP.top(_cycles(spark, d), 3), "cycles", "v1.0.1", "fourier")
    return rounded(s.load("cycles").select("entity", "rank", "period_days", "strength", "confidence", "category"))


@query(
    f"""WITH {PANEL}, k AS (SELECT unnest([3, 7, 14, 30, 60]) AS k), e AS (SELECT entity, k, value, avg(value) OVER (PARTITION BY entity, k ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS w3, avg(value) OVER (PARTITION BY entity, k ORDER BY idx ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS w7,
 avg(value) OVER (PARTITION BY entity, k ORDER BY idx ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS w14, avg(value) OVER (PARTITION BY entity, k ORDER BY idx ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS w30, avg(value) OVER (PARTITION BY entity, k ORDER BY idx ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS w60 FROM panel, k),
 s AS (SELECT k, avg(abs(value - CASE k WHEN 3 THEN w3 WHEN 7 THEN w7 WHEN 14 THEN w14 WHEN 30 THEN w30 ELSE w60 END)) AS error FROM e GROUP BY k) SELECT 'window' || k AS run, round(error, 4) AS number FROM s ORDER BY error LIMIT 1"""
)
def tracker(spark, d):
    """Runs of a forecast by the mean of the last k days, logged with their error; the best of them."""
    r = Runs(spark, f"{_shared(spark)}/runs-{uuid.uuid4().hex}")
    for k in (3, 7, 14, 30, 60):
        mean = F.avg("value").over(Window.partitionBy("entity").orderBy("idx").rowsBetween(-k, -1))
        error = panel(spark, d).withColumn("mean", mean).agg(F.avg(F.abs(F.col("value") - F.col("mean")))).first()[0]
        r.log("forecast", f"window{k}", {"k": k}, {"error": error})
    return rounded(r.best("forecast", "error", ascending=True), 4)
