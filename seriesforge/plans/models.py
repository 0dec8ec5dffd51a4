"""Fitted models as rows: fitted on one part of the days, stored, applied to the rest."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lstm as L
from ..operators import markov as K
from ..operators import regimes as H
from ..sources.store import Store
from ..sources.tables import MARKET, market, panel
from .analytics import _LSTM, _shared
from .registry import query, rounded

_COLUMNS = H.COLUMNS
_W = "OVER (PARTITION BY entity ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_FEATS = f"""r0 AS (SELECT entity, idx, volume, coalesce(close / nullif(lag(close) OVER (PARTITION BY entity ORDER BY idx), 0) - 1, 0) AS ret, count(*) OVER (PARTITION BY entity) AS n FROM market),
 f AS (SELECT entity, idx, n, ret, coalesce(stddev_samp(ret) {_W}, 0) AS vol, avg(ret) {_W} AS momentum, (volume - avg(volume) OVER (PARTITION BY entity)) / (stddev_pop(volume) OVER (PARTITION BY entity) + 1e-8) AS volume_z FROM r0),
 tr AS (SELECT *, ntile(3) OVER (PARTITION BY entity ORDER BY round(ret, 9), idx) AS state FROM f WHERE idx < floor(0.8 * n))"""
_STEPS = """nx AS (SELECT entity, state AS i, lead(state) OVER (PARTITION BY entity ORDER BY idx) AS j FROM tr), cn AS (SELECT entity, i, j, count(*) AS c FROM nx WHERE j IS NOT NULL GROUP BY ALL),
 ow AS (SELECT DISTINCT entity, state FROM tr), sm AS (SELECT a.entity, a.state AS i, b.state AS j, coalesce(c, 0) + 1.0 AS c FROM ow a JOIN ow b ON a.entity = b.entity LEFT JOIN cn ON cn.entity = a.entity AND cn.i = a.state AND cn.j = b.state),
 sp AS (SELECT entity, i, j, c / sum(c) OVER (PARTITION BY entity, i) AS p FROM sm)"""
_SUM = " + ".join(f"pow(te.{c} - pa.m_{c}, 2) / pa.v_{c} + ln(pa.v_{c})" for c in _COLUMNS)
_DECODE = f"""{_STEPS}, st AS (SELECT entity, list(row ORDER BY i) AS step FROM (SELECT entity, i, list(p ORDER BY j) AS row FROM sp GROUP BY 1, 2) GROUP BY 1),
 pa AS (SELECT entity, state, count(*) AS c, {", ".join(f"avg({c}) AS m_{c}, var_pop({c}) + 1e-6 AS v_{c}" for c in _COLUMNS)} FROM tr GROUP BY 1, 2),
 fi AS (SELECT entity, list(c / total ORDER BY state) AS first FROM (SELECT entity, state, c, sum(c) OVER (PARTITION BY entity) AS total FROM pa) GROUP BY 1),
 te AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY idx) - 1 AS t FROM f WHERE idx >= floor(0.8 * n)),
 lo AS (SELECT te.entity, te.t, te.idx, list(-0.5 * ({_SUM}) - {len(_COLUMNS) / 2} * ln(2 * pi()) ORDER BY pa.state) AS l FROM te JOIN pa ON pa.entity = te.entity GROUP BY 1, 2, 3),
 lb AS MATERIALIZED (SELECT lo.entity, lo.t, lo.idx, l, list_max(l) AS top, list_transform(l, lambda x: exp(x - list_max(l))) AS b, step, first, max(lo.t) OVER (PARTITION BY lo.entity) AS last FROM lo JOIN st ON st.entity = lo.entity JOIN fi ON fi.entity = lo.entity),
 fw AS (SELECT entity, t, list_transform(u, lambda x: x / list_sum(u)) AS a, ln(list_sum(u)) + top AS ll FROM (SELECT *, list_transform(range(1, 4), lambda j: first[j] * b[j]) AS u FROM lb WHERE t = 0)
  UNION ALL SELECT entity, t, list_transform(u, lambda x: x / list_sum(u)), ll + ln(list_sum(u)) + top FROM (SELECT lb.entity, lb.t, ll, top, list_transform(range(1, 4), lambda j: (a[1] * step[1][j] + a[2] * step[2][j] + a[3] * step[3][j]) * b[j]) AS u FROM fw JOIN lb ON lb.entity = fw.entity AND lb.t = fw.t + 1)),
 bw AS (SELECT entity, t, [1.0, 1.0, 1.0]::DOUBLE[] AS e FROM lb WHERE t = last
  UNION ALL SELECT entity, t, list_transform(u, lambda x: x / list_sum(u)) FROM (SELECT bw.entity, bw.t - 1 AS t, list_transform(range(1, 4), lambda i: step[i][1] * b[1] * e[1] + step[i][2] * b[2] * e[2] + step[i][3] * b[3] * e[3]) AS u FROM bw JOIN lb ON lb.entity = bw.entity AND lb.t = bw.t WHERE bw.t > 0)),
 po AS (SELECT fw.entity, fw.t, list_transform(range(1, 4), lambda k: a[k] * e[k] / (a[1] * e[1] + a[2] * e[2] + a[3] * e[3])) AS post FROM fw JOIN bw ON bw.entity = fw.entity AND bw.t = fw.t),
 vi AS (SELECT entity, t, list_transform(range(1, 4), lambda j: ln(first[j] + 1e-300) + l[j]) AS d, [0, 0, 0]::BIGINT[] AS back FROM lb WHERE t = 0
  UNION ALL SELECT entity, t, list_transform(range(1, 4), lambda j: list_max(c[j]) + l[j]), list_transform(range(1, 4), lambda j: list_position(c[j], list_max(c[j]))::BIGINT) FROM
   (SELECT lb.entity, lb.t, l, list_transform(range(1, 4), lambda j: list_transform(range(1, 4), lambda i: d[i] + ln(step[i][j] + 1e-300))) AS c FROM vi JOIN lb ON lb.entity = vi.entity AND lb.t = vi.t + 1)),
 vm AS MATERIALIZED (SELECT * FROM vi),
 bt AS (SELECT vm.entity, vm.t, list_position(d, list_max(d))::BIGINT AS s FROM vm JOIN lb ON lb.entity = vm.entity AND lb.t = vm.t WHERE vm.t = lb.last
  UNION ALL SELECT bt.entity, bt.t - 1, back[s] FROM bt JOIN vm ON vm.entity = bt.entity AND vm.t = bt.t WHERE bt.t > 0)"""
HMM_DECODE = f"""WITH RECURSIVE {MARKET}, {_FEATS}, {_DECODE}
 SELECT lb.entity, lb.idx, CAST(s - 1 AS INTEGER) AS state, round(post[s], 6) AS probability, round(whole, 4) AS log_likelihood FROM lb JOIN bt ON bt.entity = lb.entity AND bt.t = lb.t JOIN po ON po.entity = lb.entity AND po.t = lb.t
 JOIN (SELECT fw.entity, ll AS whole FROM fw JOIN lb ON lb.entity = fw.entity AND lb.t = fw.t WHERE fw.t = last) w ON w.entity = lb.entity"""


def _parted(spark, d):
    """The features of the first four fifths of each entity's days, and those of the rest."""
    f = H.features(market(spark, d)).withColumn("cut", F.floor(0.8 * F.count("*").over(Window.partitionBy("entity"))))
    return f.where("idx < cut"), f.where("idx >= cut")


def _labelled(spark, d):
    """Models from the first days, whose states are the thirds of their returns; and the rest."""
    train, test = _parted(spark, d)
    third = F.ntile(3).over(Window.partitionBy("entity").orderBy(F.round("ret", 9), "idx")) - 1
    return K.fit_labelled(train.withColumn("state", third)), test


def _told(decoded):
    return rounded(decoded.select("entity", "idx", "state", "probability", F.round("log_likelihood", 4).alias("log_likelihood")))


@query(HMM_DECODE)
def hmm_decode(spark, d):
    """Models from labelled days, applied to later ones."""
    models, test = _labelled(spark, d)
    return _told(K.decode(test, models))


@query(HMM_DECODE)
def hmm_blocks(spark, d):
    """The same, with every series in blocks of 64 rows."""
    models, test = _labelled(spark, d)
    parts = K.blocks(test.withColumn("idx", F.col("idx") - F.col("cut")), 64)
    begin = test.groupBy("entity").agg(F.first("cut").alias("cut"))
    return _told(K.block_states(parts, models).join(begin, "entity").withColumn("idx", F.col("idx") + F.col("cut")))


@query(f"WITH {MARKET}, {_FEATS}, {_STEPS} SELECT entity, CAST(i - 1 AS INTEGER) AS from_state, CAST(j - 1 AS INTEGER) AS to_state, round(p, 6) AS probability FROM sp")
def hmm_steps(spark, d):
    return rounded(K.step_probabilities(_labelled(spark, d)[0]))


@query()
def hmm_holdout(spark, d):
    """Fitted by expectation maximisation to the first four fifths of the days, stored, loaded and applied to the rest: the posterior of every state."""
    train, test = _parted(spark, d)
    store = Store(spark, f"{_shared(spark)}/models-{uuid.uuid4().hex}")
    store.save(K.fit(train, 4, 1000), "regimes", "v1", "hmm", {"states": 4})
    return K.predict_proba(test, store.load("regimes"))


@query()
def lstm_stored(spark, d):
    """One fit, stored and loaded: losses, rows that stand out, and what the network looks at, from the same models."""
    s = panel(spark, d)
    store = Store(spark, f"{_shared(spark)}/models-{uuid.uuid4().hex}")
    store.save(L.fit(s, _LSTM), "networks", "v1", "lstm")
    models = store.load("networks")
    out = L.apply(s, models)
    last = L.losses(models).groupBy("entity").agg(F.max_by("val_loss", "epoch").alias("val_loss"))
    odd = L.anomalies(out, 1.0).groupBy("entity").agg(F.count("*").alias("anomalies"))
    return last.join(odd, "entity", "left").join(L.attention(out), "entity")
