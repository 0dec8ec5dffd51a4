"""Queries written as SQL text, over the functions that `register` adds."""

from __future__ import annotations

from ..functions.sql import register
from ..sources.tables import table
from . import sequences as Q
from .analytics import _CAT, _DETREND, _PEAKS, _SPEC, SEGMENTS
from .registry import query, rounded

_SERIES = """spans AS (SELECT entity, explode(sequence(min(ts), max(ts), interval 1 day)) AS ts FROM daily GROUP BY entity),
 series AS (SELECT entity, transform(array_sort(collect_list(struct(ts, coalesce(v, 0) / {scale} AS value))), r -> r.value) AS x FROM spans LEFT JOIN daily USING (entity, ts) GROUP BY entity)"""
_BY_SEGMENT = "daily AS (SELECT c_mktsegment AS entity, to_date(o_orderdate) AS ts, sum(o_totalprice) AS v FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY 1, 2), " + _SERIES.replace("{scale}", "1e5")
_BY_PRIORITY = "daily AS (SELECT o_orderpriority AS entity, to_date(o_orderdate) AS ts, sum(o_totalprice) AS v FROM {orders} GROUP BY 1, 2), " + _SERIES.replace("{scale}", "1")


def _run(spark, d, text):
    register(spark)
    return rounded(spark.sql(text, **{t: table(spark, d, t) for t in ("orders", "customer", "part") if f"{{{t}}}" in text}))


@query(f"WITH {SEGMENTS}, {_DETREND}, {_SPEC} SELECT entity, k, round(power, 6) AS power FROM spec")
def sql_periodogram(spark, d):
    return _run(spark, d, f"WITH {_BY_SEGMENT} SELECT s.entity, p.k, p.power FROM series s, LATERAL periodogram(s.x) p")


@query(f"WITH {SEGMENTS}, {_DETREND}, {_SPEC}, {_PEAKS} SELECT entity, round(period_days, 6) AS period_days, round(strength, 6) AS strength, round(confidence, 6) AS confidence, {_CAT} AS category FROM cy WHERE confidence >= 0.55")
def sql_cycles(spark, d):
    return _run(spark, d, f"WITH {_BY_SEGMENT} SELECT s.entity, c.period_days, c.strength, c.confidence, {_CAT} AS category FROM series s, LATERAL cycles(s.x, 0.1, 0.55) c")


@query(Q.PELT)
def sql_change_points(spark, d):
    return _run(spark, d, f"WITH {_BY_PRIORITY} SELECT s.entity, c.idx, c.confidence FROM series s, LATERAL change_points(s.x, 'pelt', 'l2', 6.0D, 10, true) c")


@query(Q.DTW_DISTANCE)
def sql_matches(spark, d):
    """Windows like the last one, and the distance of the last two windows by the scalar function."""
    text = f"""WITH {_BY_PRIORITY} SELECT s.entity, m.start, m.similarity, m.distance,
      dtw_distance(slice(s.x, m.start + 1, 30), slice(s.x, size(s.x) - 29, 30)) AS again FROM series s, LATERAL matches(s.x, 30, 90, 0.2D) m"""
    return _run(spark, d, text)


_T = Q.t_confidence("t", "df")


@query(f"WITH v AS (SELECT p_partkey, (p_retailprice - 1500) / 200 AS t, p_size + 2.0 AS df FROM part), c AS (SELECT *, 1 - {_T} AS p FROM v) SELECT p_partkey, round(p, 6) AS p, round(CASE WHEN t >= 0 THEN p / 2 ELSE 1 - p / 2 END, 6) AS sf FROM c")
def sql_student(spark, d):
    """Rows are dealt out before the functions, since files may be read by few tasks; by all columns, since keys may repeat or be missing."""
    dealt = "(SELECT /*+ REPARTITION(p_partkey, t, df) */ * FROM v)"
    return _run(spark, d, f"WITH v AS (SELECT p_partkey, CAST((p_retailprice - 1500) / 200 AS double) AS t, CAST(p_size + 2 AS double) AS df FROM {{part}}) SELECT p_partkey, student_t_p(t, df) AS p, student_t_sf(t, df) AS sf FROM {dealt}")
