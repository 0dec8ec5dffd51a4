"""Lagged correlation between series, groups and networks of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.special import correlation_p
from .linkage import Stage, parts, ward
from .series import KEY, apart


#: Series on either side of a block of pairs.
BLOCK = 128


def p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a Pearson correlation of n pairs."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(correlation_p(r.to_numpy(float), n.to_numpy(float)))

    return p(r, n)


def _blocks(series: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Each entity's days and values as arrays, in one of `parts` parts of about `size` entities; and the number of parts."""
    known = series.where(F.col("value").isNotNull() & ~F.isnan("value"))
    row = F.struct(F.unix_date(F.to_date("ts")).alias("day"), F.col("value").cast("double").alias("value"))
    entities = known.groupBy(KEY).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    parts = max(1, -(-known.select(KEY).distinct().count() // size))
    arrays = entities.select(KEY, F.transform("rows", lambda r: r["day"]).alias("days"), F.transform("rows", lambda r: r["value"]).alias("x"))
    return arrays.withColumn("part", F.pmod(F.xxhash64(KEY), F.lit(parts))), parts


def _dense(rows: pd.DataFrame, days: np.ndarray) -> np.ndarray:
    """A row for each entity, a column for each day; NaN where it has none."""
    out = np.full((len(rows), len(days)), np.nan)
    for i, (own, x) in enumerate(zip(rows["days"], rows["x"], strict=True)):
        out[i, np.searchsorted(days, own)] = x
    return out


def _all_lags(x: np.ndarray, y: np.ndarray, max_lag: int, least: int) -> np.ndarray:
    """Correlations of each row of x at t with each row of y at t + lag, for all lags that leave `least` places: (lags, rows of x, rows of y); NaN where there is none."""
    m = x.shape[1]
    x, y = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
    sums = [np.concatenate([np.zeros((len(z), 1)), np.cumsum(w, 1)], 1) for z in (x, y) for w in (z, z * z)]
    sx, sxx, sy, syy = sums
    out = np.full((2 * max_lag + 1, len(x), len(y)), np.nan)
    for lag in range(-max_lag, max_lag + 1):
        n = m - abs(lag)
        if n < max(least, 1):
            continue
        a, b = max(0, -lag), max(0, lag)
        part = lambda s, lo, n=n: s[:, lo + n] - s[:, lo]
        ax, axx, by, byy = part(sx, a), part(sxx, a), part(sy, b), part(syy, b)
        cov = x[:, a : a + n] @ y[:, b : b + n].T - ax[:, None] * by[None] / n
        va, vb = axx - ax * ax / n, byy - by * by / n
        flat_a, flat_b = va <= 1e-12 * np.maximum(axx, 1e-300), vb <= 1e-12 * np.maximum(byy, 1e-300)
        r = cov / np.sqrt(np.where(flat_a, 1, va)[:, None] * np.where(flat_b, 1, vb)[None])
        r[flat_a] = np.nan
        r[:, flat_b] = np.nan
        out[lag + max_lag] = np.clip(r, -1, 1)
    return out


def _pairs(max_lag: int, least: int, common: int):
    """Of two parts of entities the best lag of each pair a < b that has enough common days."""

    def one(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        if len(left) and len(right):
            days = np.unique(np.concatenate([*left["days"], *right["days"]]))
            xs, ys = _dense(left, days), _dense(right, days)
            xn, yn = left[KEY].to_numpy(), right[KEY].to_numpy()
            groups = []
            for z in (xs, ys):  # entities with the same days go together
                masks, which = np.unique(~np.isnan(z), axis=0, return_inverse=True)
                groups.append([(mask, np.flatnonzero(which.ravel() == k)) for k, mask in enumerate(masks)])
            for mx, i in groups[0]:
                for my, j in groups[1]:
                    both = mx & my
                    if both.sum() >= common:
                        found.append(_best(xs[i][:, both], ys[j][:, both], xn[i], yn[j], max_lag, least, key[0] == key[1]))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=["a", "b", "lag", "n", "r"])

    return one


def _best(x: np.ndarray, y: np.ndarray, xn: np.ndarray, yn: np.ndarray, max_lag: int, least: int, same: bool) -> pd.DataFrame:
    r = _all_lags(x, y, max_lag, least)
    later = xn[:, None] > yn[None]  # the pair is (y, x), and its lags run the other way
    r = np.where(later[None], r[::-1], r)
    size = np.round(np.abs(np.nan_to_num(r)), 10)
    enough = x.shape[1] - np.abs(np.arange(-max_lag, max_lag + 1)) >= least
    size[~enough] = -1
    at = size.argmax(0)  # the first of equal ones is the smallest lag
    i, j = np.nonzero((xn[:, None] != yn[None]) & (~later if same else True) & enough.any())
    lag = at[i, j] - max_lag
    swap = later[i, j]
    return pd.DataFrame({"a": np.where(swap, yn[j], xn[i]), "b": np.where(swap, xn[i], yn[j]), "lag": lag, "n": x.shape[1] - np.abs(lag), "r": r[at[i, j], i, j]})


def _correlated(series: DataFrame, max_lag: int, least: int, common: int, block: int) -> DataFrame:
    arrays, parts = _blocks(series, block)
    kind = series.schema[KEY].dataType.simpleString()
    own, last = F.col("part"), F.lit(parts - 1).cast("long")
    left = arrays.withColumns({"p": own, "q": F.explode(F.sequence(own, last))}).drop("part")
    right = apart(arrays).withColumns({"q": own, "p": F.explode(F.sequence(F.lit(0).cast("long"), own))}).drop("part")
    return left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(_pairs(max_lag, least, common), f"a {kind}, b {kind}, lag int, n long, r double")


def lagged(series: DataFrame, max_lag: int = 30, least: int = 20, common: int = 30, block: int = BLOCK) -> DataFrame:
    """Of each pair a < b with enough common days the lag in [-max_lag, max_lag] of the strongest correlation (ties to the smallest): r, lag, n. A positive lag: a leads.

    Positions are counted over the pair's common days. Two parts of `block` entities meet in one task, as matrices of
    entities by days; a lag of all their pairs is one product of shifted matrices. Rows without a value don't count.
    """
    return _correlated(series, max_lag, least, common, block).withColumn("r", F.coalesce(F.nanvl("r", F.lit(None)), F.lit(0.0)))


def tested(best: DataFrame, alpha: float = 0.05) -> DataFrame:
    df = best.withColumn("p", F.coalesce(p_value(F.col("r"), F.col("n")), F.lit(1.0)))
    return df.withColumn("text", R.correlation_text(F.col("r"), F.col("p"), F.col("lag"), alpha))


def edges(series: DataFrame, least: int = 30, block: int = BLOCK) -> DataFrame:
    """Correlation on common days of each pair a < b; null where one of the two doesn't vary."""
    found = _correlated(series, 0, least, least, block)
    return found.select("a", "b", "n", F.nanvl("r", F.lit(None).cast("double")).alias("r"))


def matrix(series: DataFrame, edges_: DataFrame) -> DataFrame:
    """The square matrix in long form: 1 on the diagonal, 0 where there is no correlation."""
    names = series.select(KEY).distinct()
    known = edges_.select("a", "b", "r").unionByName(edges_.select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    # the result has a row for each two names: so many parts of it by so many that a task makes about a million of them
    parts = max(1, -(-names.count() // 1000))
    part, each = F.pmod(F.xxhash64(KEY), F.lit(parts)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    left, right = (names.select(F.col(KEY).alias(own), part.alias(f"_{own}"), each.alias(f"_{other}")) for own, other in (("a", "b"), ("b", "a")))
    every = left.join(right, ["_a", "_b"]).drop("_a", "_b")
    return every.join(known, ["a", "b"], "left").withColumn("r", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce("r", F.lit(0.0))))


def significant(best: DataFrame, least: float = 0.6, alpha: float = 0.05) -> DataFrame:
    return best.where((F.abs("r") >= least) & (F.col("p") < alpha))


def coordinated(pairs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Pairs with the first reason that fits: family (last name), party, state, unexplained. metadata: entity, name, party, state."""
    a, b = (metadata.select(F.col(KEY).alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("name", "party", "state"))) for x in ("a", "b"))
    j = pairs.join(a, "a", "left").join(b, "b", "left")
    same = lambda f: F.coalesce(f("a") == f("b"), F.lit(False))
    reason = F.when(same(lambda x: R.last_name(F.col(f"name_{x}"))), "family").when(same(lambda x: F.col(f"party_{x}")), "party").when(same(lambda x: F.col(f"state_{x}")), "state").otherwise("unexplained")
    return j.withColumn("reason", reason).select(*pairs.columns, "reason")


def _ward(d: np.ndarray, cut: float) -> np.ndarray:
    """Cluster numbers by Ward linkage (Lance-Williams), one merge after another, cut at this height: for tests of `linkage.ward`."""
    n = len(d)
    d = d.copy() ** 2
    np.fill_diagonal(d, np.inf)
    size, label, live = np.ones(n), np.arange(n), np.ones(n, bool)
    while live.sum() > 1:
        i, j = divmod(int(d.argmin()), n)
        if np.sqrt(d[i, j]) > cut:
            break
        k = np.flatnonzero(live & (np.arange(n) != i) & (np.arange(n) != j))
        d[i, k] = d[k, i] = ((size[i] + size[k]) * d[i, k] + (size[j] + size[k]) * d[j, k] - size[k] * d[i, j]) / (size[i] + size[j] + size[k])
        size[i] += size[j]
        label[label == label[j]] = label[i]
        live[j] = False
        d[j, :] = d[:, j] = np.inf
    return np.unique(label, return_inverse=True)[1]


def clusters(edges_: DataFrame, stage: Stage, least: float = 0.5) -> DataFrame:
    """Ward clusters of 1 - |r|, cut at 1 - least, single ones left out: entity, cluster (its least entity), size, and the mean correlation within."""
    distance = 1 - F.abs(F.coalesce("r", F.lit(0.0)))
    labels = stage(ward(edges_.select("a", "b", distance.alias("d")), 1 - least, stage))
    return labels.join(cluster_means(edges_, labels), "cluster").select(KEY, "cluster", "size", "avg_correlation")


def cluster_means(edges_: DataFrame, labels: DataFrame) -> DataFrame:
    """Of each cluster of labels (entity, cluster) its size and the mean correlation of its pairs; a missing one is 0."""
    side = lambda x: labels.select(F.col(KEY).alias(x), F.col("cluster").alias(f"c{x}"))
    inside = edges_.join(side("a"), "a").join(side("b"), "b").where("ca = cb").groupBy(F.col("ca").alias("cluster")).agg(F.sum("r").alias("r"))
    sizes = labels.groupBy("cluster").agg(F.count("*").cast("int").alias("size"))
    pairs = F.col("size") * (F.col("size") - 1) / 2
    return sizes.join(inside, "cluster", "left").select("cluster", "size", (F.coalesce("r", F.lit(0.0)) / F.nullif(pairs, F.lit(0.0))).alias("avg_correlation"))


def network(edges_: DataFrame, least: float = 0.5) -> DataFrame:
    return edges_.where(F.abs("r") >= least).select("a", "b", F.abs("r").alias("weight"), F.col("r").alias("correlation"))


def density_and_clustering(net: DataFrame, entities: DataFrame) -> DataFrame:
    """Nodes, edges, density, and the mean over all nodes of closed pairs of neighbours; triangles by joins on a < b < c."""
    both = net.select("a", "b").unionByName(net.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count("*").alias("k"))
    e = net.select("a", "b")
    tri = e.join(e.toDF("b", "c"), "b").join(e.toDF("a", "c"), ["a", "c"])
    corners = tri.select(F.explode(F.array("a", "b", "c")).alias("a")).groupBy("a").agg(F.count("*").alias("t"))
    local = degree.join(corners, "a", "left").select(F.coalesce(2 * F.col("t") / F.nullif(F.col("k") * (F.col("k") - 1), F.lit(0)), F.lit(0.0)).alias("c"))
    nodes, links, total = entities.agg(F.count("*").alias("nodes")), net.agg(F.count("*").alias("edges")), local.agg(F.coalesce(F.sum("c"), F.lit(0.0)).alias("c"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    j = one(nodes).join(one(links), "_k").join(one(total), "_k")
    n = F.col("nodes")
    return j.select("nodes", "edges", F.coalesce(2 * F.col("edges") / F.nullif(n * (n - 1), F.lit(0)), F.lit(0.0)).alias("density"), F.coalesce(F.col("c") / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("clustering"))


def eigenvector_centrality(net: DataFrame, rounds: int = 1000, tolerance: float = 1e-6, every: int = 10) -> DataFrame:
    """By power iteration as joins. Every few rounds the values are scaled to a length of 1, a checkpoint cuts the plan, and the iteration ends when none changed by more than `tolerance` since the last time.

    Half the largest weighted degree is added to the diagonal, which leaves the vector as it is and keeps two-sided networks from swinging.
    """
    both = net.select("a", "b", "weight").unionByName(net.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).checkpoint()
    degree = both.groupBy("a").agg(F.sum("weight").alias("k")).agg(F.max("k")).first()[0]
    if degree is None:
        return both.select(F.col("a").alias(KEY), F.col("weight").alias("centrality"))
    shift = degree / 2 or 1.0
    v = known = both.select(F.col("a").alias(KEY)).distinct().withColumn("x", F.lit(1.0)).checkpoint()
    loops = known.select(F.col(KEY).alias("a"), F.col(KEY).alias("b"), F.lit(shift).alias("weight"))
    links = both.unionByName(loops).checkpoint()  # the shift as loops: a round reads the values once, so plans don't double
    for i in range(1, rounds + 1):
        y = links.join(v, links.b == v[KEY]).groupBy("a").agg(F.sum(F.col("weight") * F.col("x")).alias("y"))
        v = y.select(F.col("a").alias(KEY), (F.col("y") / (2 * shift)).alias("x"))
        if i % every == 0 or i == rounds:
            v = v.checkpoint()
            norm = v.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0]
            v = v.select(KEY, (F.col("x") / (norm or 1.0)).alias("x")).checkpoint()
            change = v.join(known.withColumnRenamed("x", "old"), KEY).agg(F.max(F.abs(F.col("x") - F.col("old")))).first()[0]
            if change < tolerance:
                break
            known = v
    return v.withColumnRenamed("x", "centrality")


def path_lengths(net: DataFrame) -> DataFrame:
    """Hops between each two linked nodes, by a join a hop until nothing is new."""
    both = net.select("a", "b").unionByName(net.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    seen = edge = both.withColumn("hops", F.lit(1))
    hops = 1
    while True:
        hops += 1
        step = edge.select("a", F.col("b").alias("m")).join(both.toDF("m", "b"), "m").where("a != b").select("a", "b").distinct().join(seen, ["a", "b"], "left_anti").withColumn("hops", F.lit(hops)).checkpoint()
        if step.isEmpty():
            return seen
        seen, edge = seen.unionByName(step).checkpoint(), step


def _sketched_means(both: DataFrame, part: DataFrame, stage: Stage, precision: int) -> DataFrame:
    """part and mean hops by neighbourhood functions: each node's sketch of what it reaches grows by a union with its neighbours' until no estimate changes."""
    own = part.select(F.col(KEY).alias("a"), "part")
    sketch = stage(own.groupBy("a", "part").agg(F.hll_sketch_agg(F.xxhash64("a"), precision).alias("s")).withColumn("reach", F.hll_sketch_estimate("s")))
    total = lambda df, hops: df.groupBy("part").agg(F.sum("reach").alias("reach")).withColumn("hops", F.lit(hops))
    hops, seen = 0, [stage(total(sketch, 0))]
    while True:
        hops += 1
        near = both.select("a", F.col("b").alias("m")).join(sketch.select(F.col("a").alias("m"), "s"), "m").select("a", "s")
        every = near.unionByName(sketch.select("a", "s")).groupBy("a").agg(F.hll_union_agg("s").alias("s"))
        now = stage(every.join(own, "a").select("a", "part", "s", F.hll_sketch_estimate("s").alias("reach")))
        grown = now.join(sketch.select("a", F.col("reach").alias("old")), "a").where("reach > old")
        if grown.isEmpty():
            break
        seen.append(stage(total(now, hops)))
        sketch = now
    all_ = seen[0]
    for s in seen[1:]:
        all_ = all_.unionByName(s)
    w = Window.partitionBy("part").orderBy("hops")
    new = all_.withColumn("new", F.col("reach") - F.lag("reach").over(w)).where("hops > 0")
    return new.groupBy("part").agg((F.sum(F.col("hops") * F.col("new")) / F.sum("new")).alias("mean_hops"))


def part_paths(net: DataFrame, stage: Stage, small: int = 1000, precision: int = 12) -> DataFrame:
    """Of each connected part its nodes and the mean number of hops between two of them: exactly for parts of up to `small` nodes, by sketches of 2 ** precision registers beyond (exact)."""
    links = stage(net.select("a", "b").distinct())
    part = stage(parts(links, stage))
    sizes = part.groupBy("part").agg(F.count("*").alias("nodes"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    of = lambda df: both.join(part.join(df.select("part"), "part", "left_semi").select(F.col(KEY).alias("a")), "a", "left_semi")
    few, many = stage(sizes.where(F.col("nodes") <= small)), stage(sizes.where(F.col("nodes") > small))
    out = few.join(_exact_means(of(few), part, stage), "part").withColumn("exact", F.lit(True))
    if not many.isEmpty():
        sketched = _sketched_means(of(many), part.join(many, "part", "left_semi"), stage, precision)
        out = out.unionByName(many.join(sketched, "part").withColumn("exact", F.lit(False)))
    return out.select("part", "nodes", "mean_hops", "exact")


def _exact_means(both: DataFrame, part: DataFrame, stage: Stage) -> DataFrame:
    """part and mean hops by a breadth-first search from every node; of each hop only the number of new pairs is kept, and the pairs of the last two hops."""
    both = stage(both)
    own = part.select(F.col(KEY).alias("a"), "part")
    last, before, hops, counts = both, own.select("a", F.col("a").alias("b")), 1, None
    while not last.isEmpty():
        c = last.join(own, "a").groupBy("part").agg(F.count("*").alias("n")).withColumn("hops", F.lit(hops))
        counts = c if counts is None else counts.unionByName(c)
        step = last.select("a", F.col("b").alias("m")).join(both.toDF("m", "b"), "m").select("a", "b").distinct()
        # a neighbour of a node at this distance is as far, one nearer or one farther
        new = stage(step.join(last, ["a", "b"], "left_anti").join(before, ["a", "b"], "left_anti"))
        before, last, hops = last, new, hops + 1
    if counts is None:
        return own.select("part", F.lit(0.0).alias("mean_hops")).limit(0)
    return counts.groupBy("part").agg((F.sum(F.col("hops") * F.col("n")) / F.sum("n")).alias("mean_hops"))
