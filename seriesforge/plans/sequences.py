"""SQL for analyses that run along a series: breaks, warping, positions and networks, by recursion over lists."""

from __future__ import annotations

from ..sources.tables import MARKET, PANEL


def t_confidence(t: str, df: str, points: int = 400) -> str:
    """1 - p of a two-sided t-test: the integral of cos(u)^(df - 1) up to atan(t / sqrt(df)), over that of the whole, by Simpson's rule."""

    def area(top: str) -> str:
        return f"(({top}) * list_sum(list_transform(range(0, {points + 1}), lambda k: (CASE WHEN k IN (0, {points}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(({top}) * k / {points}), ({df}) - 1))))"

    end = f"least(pi() / 2, 12 / sqrt({df}))"
    return f"({area(f'least(atan(abs({t}) / sqrt({df})), {end})')} / {area(end)})"


_SCALED = """sc AS (SELECT entity, idx, value, (value - avg(value) OVER e) / (stddev_pop(value) OVER e + 1e-10) AS x FROM panel WINDOW e AS (PARTITION BY entity)),
 pre AS (SELECT entity, idx, x, sum(x) OVER w AS s, sum(x * x) OVER w AS q FROM sc WINDOW w AS (PARTITION BY entity ORDER BY idx)),
 li AS (SELECT entity, count(*) AS n, list(x ORDER BY idx) AS x, list_prepend(0.0, list(s ORDER BY idx)) AS s, list_prepend(0.0, list(q ORDER BY idx)) AS q FROM pre GROUP BY 1)"""

_TESTED = f"""sides AS (SELECT c.entity, c.idx, count(*) FILTER (WHERE p.idx < c.idx) AS na, count(*) FILTER (WHERE p.idx >= c.idx) AS nb, avg(p.value) FILTER (WHERE p.idx < c.idx) AS ma, avg(p.value) FILTER (WHERE p.idx >= c.idx) AS mb,
 var_samp(p.value) FILTER (WHERE p.idx < c.idx) AS va, var_samp(p.value) FILTER (WHERE p.idx >= c.idx) AS vb FROM cuts c JOIN panel p ON p.entity = c.entity AND p.idx >= c.idx - 10 AND p.idx < c.idx + 10 GROUP BY 1, 2),
 stat AS (SELECT *, na + nb - 2.0 AS df, (va * (na - 1) + vb * (nb - 1)) / (na + nb - 2) AS pooled FROM sides)
 SELECT entity, idx, round(CASE WHEN na < 2 OR nb < 2 THEN 0.5 WHEN pooled <= 0 THEN CASE WHEN ma = mb THEN 0 ELSE 1 END ELSE {t_confidence("((ma - mb) / sqrt(pooled * (1.0 / na + 1.0 / nb)))", "df")} END, 6) AS confidence FROM stat"""


def _optimal(cost: str, penalty: float, least: int, source: str = PANEL) -> str:
    """All best segmentations of every prefix; cost over d (squares), m (rows)."""
    sse = "greatest(q[t + 2] - q[i + 1] - pow(s[t + 2] - s[i + 1], 2) / (t + 1 - i), 0)"
    one = cost.replace("SSE", sse).replace("ROWS", "(t + 1 - i)")
    return f"""WITH RECURSIVE {source}, {_SCALED},
 st AS (SELECT entity, 0 AS t, [-{penalty}::DOUBLE] AS best, [0::BIGINT] AS back FROM li WHERE n >= {2 * least}
  UNION ALL SELECT entity, t + 1, list_append(best, list_min(cand) + {penalty}), list_append(back, list_position(cand, list_min(cand)) - 1) FROM
   (SELECT st.entity, t, best, back, CASE WHEN t + 1 < {least} THEN ['Infinity'::DOUBLE] ELSE list_transform(range(0, t + 2 - {least}), lambda i: best[i + 1] + {one}) END AS cand FROM st JOIN li ON li.entity = st.entity WHERE t < n)),
 fin AS (SELECT st.entity, back, n FROM st JOIN li ON li.entity = st.entity AND t = n),
 bt AS (SELECT entity, back, back[n + 1] AS pos FROM fin UNION ALL SELECT entity, back, back[pos + 1] FROM bt WHERE pos > 0),
 cuts AS (SELECT entity, pos AS idx FROM bt WHERE pos > 0), {_TESTED}"""


PELT = _optimal("SSE", 6.0, 10)
PELT_NORMAL = _optimal("ROWS * ln(SSE / ROWS + 1e-10)", 10.0, 20, f"{MARKET}, panel AS (SELECT entity, idx, close AS value FROM market)")

_PART = "greatest(q[{j} + 1] - q[{i} + 1] - pow(s[{j} + 1] - s[{i} + 1], 2) / ({j} - {i}), 0)"
_GAIN = f"({_PART.format(i='lo', j='hi')} - {_PART.format(i='lo', j='(lo + a)')} - {_PART.format(i='(lo + a)', j='hi')}) / (hi - lo)"
BINSEG = f"""WITH RECURSIVE {PANEL}, {_SCALED},
 st AS (SELECT entity, [{{'lo': 0::BIGINT, 'hi': n}}] AS todo, []::BIGINT[] AS found FROM li
  UNION ALL SELECT entity, CASE WHEN g > 0.001 THEN rest || [{{'lo': lo, 'hi': cut}}, {{'lo': cut, 'hi': hi}}] ELSE rest END, CASE WHEN g > 0.001 THEN list_append(found, cut) ELSE found END FROM
   (SELECT entity, lo, hi, rest, found, list_max(gains) AS g, lo + 9 + list_position(gains, list_max(gains)) AS cut FROM
    (SELECT entity, lo, hi, rest, found, CASE WHEN hi - lo < 20 THEN []::DOUBLE[] ELSE list_transform(range(10, hi - lo - 10), lambda a: {_GAIN}) END AS gains FROM
     (SELECT st.entity, todo[1].lo AS lo, todo[1].hi AS hi, todo[2:] AS rest, found, s, q FROM st JOIN li ON li.entity = st.entity WHERE len(todo) > 0 AND len(found) < 10)))),
 last AS (SELECT entity, arg_max(found, len(found)) AS found FROM st GROUP BY 1),
 cuts AS (SELECT entity, unnest(found) AS idx FROM last), {_TESTED}"""

CUSUM = f"""WITH RECURSIVE {PANEL}, {_SCALED},
 st AS (SELECT entity, 0 AS i, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, []::BIGINT[] AS found FROM li
  UNION ALL SELECT entity, i + 1, CASE WHEN alarm THEN 0 ELSE u END, CASE WHEN alarm THEN 0 ELSE d END, CASE WHEN alarm AND (len(found) = 0 OR i - found[-1] >= 5) THEN list_append(found, i::BIGINT) ELSE found END FROM
   (SELECT *, u > 5 OR d < -5 AS alarm FROM (SELECT st.entity, i, found, greatest(0, up + x[i + 1]) AS u, least(0, down + x[i + 1]) AS d FROM st JOIN li ON li.entity = st.entity WHERE i < n))),
 cuts AS (SELECT st.entity, unnest(found) AS idx FROM st JOIN li ON li.entity = st.entity AND i = n), {_TESTED}"""

_MATCHES = """se AS (SELECT entity, list(value ORDER BY idx) AS x, count(*) AS n FROM panel GROUP BY 1),
 wi AS (SELECT entity, start, x[start + 1:start + 30] AS w FROM (SELECT entity, x, unnest(range(0, n - 120)) AS start FROM se) UNION ALL SELECT entity, -1, x[n - 29:n] FROM se WHERE n > 120),
 ce AS (SELECT entity, start, list_transform(w, lambda v: v - m) AS y FROM (SELECT *, list_avg(w) AS m FROM wi)),
 no AS (SELECT entity, start, list_transform(y, lambda v: CASE WHEN sd < 1e-8 THEN 0 ELSE v / sd END) AS z FROM (SELECT *, sqrt(list_avg(list_transform(y, lambda u: u * u))) AS sd FROM ce)),
 dg AS (SELECT b.entity, b.start, a.z AS a, b.z AS b, 0 AS d, list_transform(range(0, 30), lambda i: CASE WHEN i = 0 THEN pow(a.z[1] - b.z[1], 2) ELSE 'Infinity'::DOUBLE END) AS p1, list_transform(range(0, 30), lambda i: 'Infinity'::DOUBLE) AS p2 FROM no a JOIN no b ON a.entity = b.entity AND a.start = -1 AND b.start >= 0
  UNION ALL SELECT entity, start, a, b, d + 1, list_transform(range(0, 30), lambda i: CASE WHEN d + 1 - i BETWEEN 0 AND 29 THEN pow(a[i + 1] - b[d + 2 - i], 2) + least(p1[i + 1], CASE WHEN i > 0 THEN least(p1[i], p2[i]) ELSE 'Infinity'::DOUBLE END) ELSE 'Infinity'::DOUBLE END), p1 FROM dg WHERE d < 58),
 di AS (SELECT entity, start, sqrt(p1[30]) AS distance FROM dg WHERE d = 58),
 si AS (SELECT *, 1 / (1 + distance / 2) AS similarity FROM di WHERE 1 / (1 + distance / 2) >= 0.2),
 ma AS (SELECT *, 0.5 * similarity + 0.3 / (1 + distance) + 0.2 * 0.5 AS confidence, row_number() OVER (PARTITION BY entity ORDER BY round(similarity, 9) DESC, start) AS rank FROM si QUALIFY rank <= 10)"""
DTW_MATCH = f"WITH RECURSIVE {PANEL}, {_MATCHES} SELECT entity, start, round(distance, 6) AS distance, round(similarity, 6) AS similarity, round(confidence, 6) AS confidence, CAST(rank AS INTEGER) AS rank FROM ma"
DTW_DISTANCE = f"WITH RECURSIVE {PANEL}, {_MATCHES} SELECT entity, start, round(similarity, 6) AS similarity, round(distance, 6) AS distance, round(distance, 6) AS again FROM si"
DTW_PREDICT = f"""WITH RECURSIVE {PANEL}, {_MATCHES}, r AS (SELECT entity, idx, coalesce(value / nullif(lag(value) OVER (PARTITION BY entity ORDER BY idx), 0) - 1, 0) AS r FROM panel),
 o AS (SELECT ma.entity, ma.start, any_value(similarity) AS s, sum(r) AS total FROM ma JOIN r ON r.entity = ma.entity AND r.idx >= ma.start + 30 AND r.idx < ma.start + 60 GROUP BY 1, 2),
 g AS (SELECT entity, count(*) AS n, sum(total * s) / sum(s) AS predicted, 0.3 * least(count(*) / 10.0, 1) + 0.4 / (1 + stddev_pop(total)) AS steady, avg(s) AS sim FROM o GROUP BY 1)
 SELECT entity, n, round(predicted, 6) AS predicted, round(steady + 0.3 / n, 6) AS confidence, round(steady + 0.3 * sim, 6) AS confidence_by_similarity FROM g"""
MATCH_SUMMARY = f"""WITH RECURSIVE {PANEL}, {_MATCHES}, r AS (SELECT entity, idx, coalesce(value / nullif(lag(value) OVER (PARTITION BY entity ORDER BY idx), 0) - 1, 0) AS r FROM panel),
 o AS (SELECT ma.entity, ma.start, any_value(similarity) AS s, sum(r) AS total FROM ma JOIN r ON r.entity = ma.entity AND r.idx >= ma.start + 30 AND r.idx < ma.start + 60 GROUP BY 1, 2)
 SELECT entity, printf('%d matches, %.0f %% alike at best; within 30 rows %.0f %% of them rose', count(*), 100 * max(s), 100.0 * count(*) FILTER (WHERE total > 0) / count(*)) AS text FROM o GROUP BY 1"""
OUTCOME = f"""WITH RECURSIVE {PANEL}, {_MATCHES}, r AS (SELECT entity, idx, coalesce(value / nullif(lag(value) OVER (PARTITION BY entity ORDER BY idx), 0) - 1, 0) AS r FROM panel),
 j AS (SELECT ma.entity, ma.start, h.horizon, r.idx, r.r FROM ma CROSS JOIN (SELECT unnest([30, 90]) AS horizon) h JOIN r ON r.entity = ma.entity AND r.idx >= ma.start + 30 AND r.idx < ma.start + 30 + h.horizon),
 c AS (SELECT *, exp(sum(ln(greatest(1 + r, 1e-12))) OVER (PARTITION BY entity, start, horizon ORDER BY idx)) AS c FROM j), k AS (SELECT *, max(c) OVER (PARTITION BY entity, start, horizon ORDER BY idx) AS m FROM c)
 SELECT entity, start, CAST(horizon AS INTEGER) AS horizon, round(sum(r), 6) AS total, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS std, round(coalesce(avg(r) / nullif(stddev_pop(r), 0), 0), 6) AS sharpe, round(min((c - m) / m), 6) AS max_drawdown FROM k GROUP BY 1, 2, 3"""

_NETS = """nn AS (SELECT entity, idx, close, count(*) OVER (PARTITION BY entity) AS n FROM market), kk AS (SELECT nn.entity, nn.idx, max(w.k) AS k FROM nn, (SELECT unnest(range(0, 500)) AS k) w WHERE 252 + w.k * 21 <= nn.idx AND nn.idx < 252 + w.k * 21 + 63 AND 252 + w.k * 21 + 63 <= nn.n GROUP BY 1, 2),
 aa AS (SELECT entity, idx + 1 AS at, CASE WHEN avg(close) OVER (PARTITION BY entity ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > avg(close) OVER (PARTITION BY entity ORDER BY idx ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) THEN 1.0 ELSE -1.0 END AS s FROM market),
 sg AS (SELECT nn.entity, nn.idx, nn.close, CAST(coalesce(aa.s, 0) AS DOUBLE) AS signal FROM nn LEFT JOIN kk ON kk.entity = nn.entity AND kk.idx = nn.idx LEFT JOIN aa ON aa.entity = nn.entity AND aa.at = 252 + kk.k * 21),
 net AS (SELECT entity, idx, signal, coalesce(b * (close / nullif(c, 0) - 1) - abs(signal - b) * 0.0015, 0) AS net FROM (SELECT *, lag(signal) OVER w AS b, lag(close) OVER w AS c FROM sg WINDOW w AS (PARTITION BY entity ORDER BY idx)))"""
_STOPPED = """fold AS (SELECT entity, -1::BIGINT AS idx, 0.0::DOUBLE AS signal, 0.0::DOUBLE AS cum, false AS gone, 0.0::DOUBLE AS net FROM (SELECT DISTINCT entity FROM market)
  UNION ALL SELECT entity, idx, signal, CASE WHEN out0 THEN cum0 ELSE cum0 + net END, out0 OR cum0 + net <= -0.05 OR cum0 + net >= 0.1, CASE WHEN out0 THEN 0 WHEN cum0 + net <= -0.05 THEN -0.05 - cum0 WHEN cum0 + net >= 0.1 THEN 0.1 - cum0 ELSE net END FROM
   (SELECT net.entity, net.idx, net.signal, net.net, CASE WHEN net.signal <> fold.signal THEN 0 ELSE cum END AS cum0, net.signal = fold.signal AND gone AS out0 FROM fold JOIN net ON net.entity = fold.entity AND net.idx = fold.idx + 1)),
 stopped AS (SELECT entity, idx, signal, net FROM fold WHERE idx >= 0)"""
STOP_TAKE = f"WITH RECURSIVE {MARKET}, {_NETS}, {_STOPPED} SELECT entity, idx, signal, round(net, 6) AS net FROM stopped"


def _metrics(source: str, tag: str) -> str:
    """CTEs that end in m<tag>, the metrics of (entity, idx, signal, net)."""
    return f"""c{tag} AS (SELECT *, exp(sum(ln(1 + greatest(net, -0.999999))) OVER (PARTITION BY entity ORDER BY idx)) AS curve, CASE WHEN signal <> lag(signal) OVER (PARTITION BY entity ORDER BY idx) THEN 1 ELSE 0 END AS turn FROM {source}),
 d{tag} AS (SELECT *, curve / max(curve) OVER (PARTITION BY entity ORDER BY idx) - 1 AS dd FROM c{tag}),
 l{tag} AS (SELECT entity, max(k) AS longest FROM (SELECT entity, run, count(*) AS k FROM (SELECT entity, dd < 0 AS f, idx - row_number() OVER (PARTITION BY entity, dd < 0 ORDER BY idx) AS run FROM d{tag}) WHERE f GROUP BY 1, 2) GROUP BY 1),
 a{tag} AS (SELECT entity, count(*) AS n, arg_max(curve, idx) - 1 AS total_return, stddev_samp(net) * sqrt(252) AS volatility, stddev_samp(net) FILTER (WHERE net < 0) * sqrt(252) AS down, -min(dd) AS max_drawdown, sum(turn) AS trades, count(*) FILTER (WHERE net > 0) AS wins,
  coalesce(sum(net) FILTER (WHERE net > 0), 0) AS up, -coalesce(sum(net) FILTER (WHERE net < 0), 0) AS loss, avg(net) FILTER (WHERE net > 0) AS avg_win, avg(net) FILTER (WHERE net < 0) AS avg_loss, quantile_cont(net, 0.05) AS var_95 FROM d{tag} GROUP BY 1),
 t{tag} AS (SELECT d.entity, avg(net) AS cvar_95 FROM d{tag} d JOIN a{tag} a ON a.entity = d.entity AND d.net <= a.var_95 GROUP BY 1),
 y{tag} AS (SELECT *, pow(1 + total_return, 252.0 / n) - 1 AS annual_return FROM a{tag}),
 m{tag} AS (SELECT y.entity, n, round(total_return, 6) AS total_return, round(volatility, 6) AS volatility, round(max_drawdown, 6) AS max_drawdown, CAST(trades AS BIGINT) AS trades, round(wins * 1.0 / n, 6) AS win_rate_daily, round(avg_win, 6) AS avg_win, round(avg_loss, 6) AS avg_loss, round(var_95, 6) AS var_95, round(annual_return, 6) AS annual_return,
  round(coalesce((annual_return - 0.02) / nullif(volatility, 0), 0), 6) AS sharpe, round(coalesce((annual_return - 0.02) / nullif(down, 0), 0), 6) AS sortino, round(coalesce(annual_return / nullif(max_drawdown, 0), 0), 6) AS calmar, round(coalesce(wins * 1.0 / nullif(trades, 0), 0), 6) AS win_rate, round(coalesce(up / nullif(loss, 0), 0), 6) AS profit_factor,
  round(cvar_95, 6) AS cvar_95, coalesce(longest, 0) AS longest_drawdown FROM y{tag} y LEFT JOIN t{tag} t ON t.entity = y.entity LEFT JOIN l{tag} l ON l.entity = y.entity)"""


BACKTEST = f"WITH {MARKET}, {_NETS}, {_metrics('net', '1')} SELECT * FROM m1"
COMPARE = f"WITH RECURSIVE {MARKET}, {_NETS}, {_STOPPED}, {_metrics('net', '1')}, {_metrics('stopped', '2')} SELECT *, 'ma' AS strategy FROM m1 UNION ALL SELECT *, 'callable' FROM m1 UNION ALL SELECT *, 'stopped' FROM m2"

_EDGES = "ed AS (SELECT a.entity AS a, b.entity AS b, corr(a.value, b.value) AS r FROM panel a JOIN panel b ON a.ts = b.ts AND a.entity < b.entity GROUP BY 1, 2 HAVING count(*) >= 30), bo AS (SELECT a, b, abs(r) AS w FROM ed WHERE abs(r) >= 0 UNION ALL SELECT b, a, abs(r) FROM ed WHERE abs(r) >= 0)"
PATHS = f"WITH RECURSIVE {PANEL}, {_EDGES}, p AS (SELECT a, b, 1 AS h FROM bo UNION SELECT p.a, bo.b, h + 1 FROM p JOIN bo ON p.b = bo.a WHERE h < (SELECT count(DISTINCT a) FROM bo)), m AS (SELECT a, b, min(h) AS hops FROM p WHERE a <> b GROUP BY 1, 2) SELECT CAST(hops AS INTEGER) AS hops, count(*) AS count FROM m GROUP BY 1"


def _central() -> str:
    """CTEs that end in ce (entity, centrality): power iteration on lists, scaled each round, until no value changes by more than 1e-12."""
    return """nm AS (SELECT entity, row_number() OVER (ORDER BY entity) AS i FROM (SELECT DISTINCT a AS entity FROM bo)),
 ro AS (SELECT x.i, list(coalesce(bo.w, 0) ORDER BY y.i) AS w FROM nm x CROSS JOIN nm y LEFT JOIN bo ON bo.a = x.entity AND bo.b = y.entity GROUP BY 1),
 mx AS (SELECT list(w ORDER BY i) AS w, count(*) AS n, max(list_sum(w)) / 2 AS shift FROM ro),
 it AS (SELECT 0 AS k, list_transform(range(0, n), lambda i: 1.0::DOUBLE) AS x, 1.0::DOUBLE AS change FROM mx
  UNION ALL SELECT k + 1, z, list_max(list_transform(range(1, n + 1), lambda i: abs(z[i] - x[i]))) FROM
   (SELECT k, n, x, list_transform(y, lambda v: v / sqrt(list_sum(list_transform(y, lambda u: u * u)))) AS z FROM
    (SELECT k, n, x, list_transform(range(1, n + 1), lambda i: shift * x[i] + list_sum(list_transform(range(1, n + 1), lambda j: w[i][j] * x[j]))) AS y FROM it, mx WHERE change > 1e-12))),
 la AS (SELECT x FROM it ORDER BY k DESC LIMIT 1),
 ce AS (SELECT nm.entity, la.x[nm.i] AS centrality FROM nm, la)"""


CENTRALITY = f"WITH RECURSIVE {PANEL}, {_EDGES}, {_central()} SELECT entity, round(centrality, 5) AS centrality FROM ce"
FEATURES = f"WITH RECURSIVE {PANEL}, {_EDGES}, {_central()}, dg AS (SELECT a AS entity, count(*) AS degree FROM bo GROUP BY 1) SELECT ce.entity, degree, round(centrality, 5) AS centrality FROM ce JOIN dg ON dg.entity = ce.entity"


def part_paths(source: str, least: float) -> str:
    """Nodes and mean hops of each connected part, by widening walks."""
    return f"""WITH RECURSIVE {source}, ed AS (SELECT a.entity AS a, b.entity AS b, corr(a.value, b.value) AS r FROM panel a JOIN panel b ON a.ts = b.ts AND a.entity < b.entity GROUP BY 1, 2 HAVING count(*) >= 30),
 bo AS (SELECT a, b FROM ed WHERE abs(r) >= {least} UNION ALL SELECT b, a FROM ed WHERE abs(r) >= {least}),
 p AS (SELECT a, b, 1 AS h FROM bo UNION SELECT p.a, bo.b, h + 1 FROM p JOIN bo ON p.b = bo.a WHERE h < (SELECT count(DISTINCT a) FROM bo)),
 m AS (SELECT a, b, min(h) AS hops FROM p WHERE a <> b GROUP BY 1, 2), c AS (SELECT a, least(a, min(b)) AS part, avg(hops) AS mean, count(*) AS k FROM m GROUP BY a)
 SELECT part, count(*) AS nodes, round(sum(mean * k) / sum(k), 6) AS mean_hops, true AS exact FROM c GROUP BY part"""


def clusters(source: str, least: float) -> str:
    """Ward linkage on lists of distances, the nearest pair of clusters first."""
    key = "(CASE WHEN {0} < {1} THEN {0} || '|' || {1} ELSE {1} || '|' || {0} END)"
    uk, vk = key.format("u", "c.id"), key.format("v", "c.id")
    return f"""WITH RECURSIVE {source}, ed AS (SELECT a.entity AS a, b.entity AS b, coalesce(corr(a.value, b.value), 0) AS r FROM panel a JOIN panel b ON a.ts = b.ts AND a.entity < b.entity GROUP BY 1, 2 HAVING count(*) >= 30),
 nm AS (SELECT DISTINCT entity FROM panel),
 dd AS (SELECT x.entity AS u, y.entity AS v, pow(1 - abs(coalesce(r, 0)), 2) AS d2 FROM nm x JOIN nm y ON x.entity < y.entity LEFT JOIN ed ON ed.a = x.entity AND ed.b = y.entity),
 st AS (SELECT 0 AS k, (SELECT list({{'id': entity, 'n': 1::BIGINT}}) FROM nm) AS cs, (SELECT map(list(u || '|' || v), list(d2)) FROM dd) AS d, (SELECT list({{'entity': entity, 'cluster': entity}}) FROM nm) AS lab
  UNION ALL SELECT k + 1,
   list_filter(list_transform(cs, lambda c: CASE WHEN c.id = u THEN {{'id': u, 'n': nu + nv}} ELSE c END), lambda c: c.id <> v),
   map(list_transform(pairs, lambda p: p.key), list_transform(pairs, lambda p: p.d2)),
   list_transform(lab, lambda l: CASE WHEN l.cluster = v THEN {{'entity': l.entity, 'cluster': u}} ELSE l END) FROM
   (SELECT *, list_concat(list_transform(list_filter(map_entries(d), lambda e: NOT (split_part(e.key, '|', 1) IN (u, v) OR split_part(e.key, '|', 2) IN (u, v))), lambda e: {{'key': e.key, 'd2': e.value}}),
     list_transform(list_filter(cs, lambda c: c.id <> u AND c.id <> v), lambda c: {{'key': {uk}, 'd2': ((nu + c.n) * d[{uk}] + (nv + c.n) * d[{vk}] - c.n * g) / (nu + nv + c.n)}})) AS pairs FROM
    (SELECT k, cs, d, lab, g, (split_part(best, '|', 1)) AS u, (split_part(best, '|', 2)) AS v, list_filter(cs, lambda c: c.id = split_part(best, '|', 1))[1].n AS nu, list_filter(cs, lambda c: c.id = split_part(best, '|', 2))[1].n AS nv FROM
     (SELECT *, list_min(map_values(d)) AS g, list_min(list_transform(list_filter(map_entries(d), lambda e: e.value = list_min(map_values(d))), lambda e: e.key)) AS best FROM st WHERE len(cs) > 1) WHERE g <= pow(1 - {least}, 2)))),
 fin AS (SELECT unnest(lab) AS l FROM (SELECT lab FROM st ORDER BY k DESC LIMIT 1)), la AS (SELECT l.entity AS entity, l.cluster AS cluster FROM fin),
 sz AS (SELECT cluster, count(*) AS n FROM la GROUP BY 1 HAVING count(*) > 1),
 mr AS (SELECT x.cluster, sum(coalesce(r, 0)) AS r FROM la x JOIN la y ON x.cluster = y.cluster AND x.entity < y.entity LEFT JOIN ed ON ed.a = x.entity AND ed.b = y.entity GROUP BY 1)
 SELECT la.entity, la.cluster, CAST(n AS INTEGER) AS size, round(r / (n * (n - 1) / 2.0), 6) AS avg_correlation FROM la JOIN sz ON sz.cluster = la.cluster JOIN mr ON mr.cluster = la.cluster"""


RETURNS = f"""WITH {MARKET}, r AS (SELECT entity, close / nullif(lag(close) OVER (PARTITION BY entity ORDER BY idx), 0) - 1 AS v FROM market), m AS (SELECT entity, avg(v) AS m FROM r GROUP BY 1),
 c AS (SELECT r.entity, v, v - m AS d FROM r JOIN m ON m.entity = r.entity WHERE v IS NOT NULL), a AS (SELECT entity, count(*) AS n, count(*) FILTER (WHERE abs(v) > 0.5) AS extremes, avg(d * d) AS v2, avg(d * d * d) AS v3, avg(d * d * d * d) AS v4 FROM c GROUP BY 1)
 SELECT entity, n >= 30 AS is_valid, n, extremes, round(v3 / pow(v2, 1.5), 6) AS skew, round(v4 / (v2 * v2) - 3, 6) AS kurtosis FROM a"""


def tested(lag_ctes: str) -> str:
    """The best lags with p-values and words."""
    p = f"1 - {t_confidence('(r * sqrt((n - 2) / nullif(1 - r * r, 0)))', '(n - 2)')}"
    return f"""WITH {PANEL}, {lag_ctes}, f AS (SELECT a, b, CAST(lag AS INTEGER) AS lag, n, coalesce(r, 0) AS r FROM bs WHERE k = 1), g AS (SELECT *, coalesce({p}, 1) AS p FROM f)
 SELECT a, b, lag, n, round(r, 6) AS r, round(p, 6) AS p, CASE WHEN p > 0.05 THEN 'No significant correlation' ELSE concat(CASE WHEN abs(r) > 0.7 THEN 'Strong' WHEN abs(r) > 0.4 THEN 'Moderate' ELSE 'Weak' END, ' ', CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END, ' correlation, ', CASE WHEN lag = 0 THEN 'synchronized' WHEN lag > 0 THEN concat('first leads by ', lag, ' days') ELSE concat('second leads by ', abs(lag), ' days') END) END AS text FROM g"""
