"""Hidden regimes: a Gaussian hidden Markov model for each entity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from . import indicators as I
from . import scans
from .series import KEY


def features(market: DataFrame, additional: tuple[str, ...] = ()) -> DataFrame:
    """Returns, rolling volatility (0 on the first row) and momentum, and the z-scores of volume and of `additional` columns, from close and volume."""
    whole = Window.partitionBy(KEY)
    score = lambda c: (F.col(c) - F.avg(c).over(whole)) / (F.stddev_pop(c).over(whole) + 1e-8)
    z, more = score("volume"), [score(c).alias(c) for c in additional]
    df = market.withColumn("ret", F.coalesce(I.returns(F.col("close")), F.lit(0.0)))
    return df.select(KEY, "idx", "ret", F.coalesce(I.volatility(F.col("ret")), F.lit(0.0)).alias("vol"), I.momentum(F.col("ret")).alias("momentum"), z.alias("volume_z"), "volume", *more)


def _log_density(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(mean)))
    for k in range(len(mean)):
        low = np.linalg.cholesky(cov[k])
        z = np.linalg.solve(low, (x - mean[k]).T)
        out[:, k] = -0.5 * (z * z).sum(0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
    return out


COVARIANCES = ("full", "diag", "spherical", "tied")


class GaussianHMM:
    """Baum-Welch with scaled forward and backward passes, as parallel scans; states are ordered by the mean of the first feature.

    covariance: full or diagonal matrices, one variance a state (spherical), or one full matrix for all states (tied).
    """

    def __init__(self, n_states: int = 4, rounds: int = 100, tolerance: float = 1e-3, seed: int = 42, floor: float = 1e-3, covariance: str = "full"):
        if covariance not in COVARIANCES:
            raise ValueError(f"unknown covariance: {covariance}")
        self.k, self.rounds, self.tolerance, self.seed, self.floor, self.covariance = n_states, rounds, tolerance, seed, floor, covariance
        self.done = 0

    def _shaped(self, cov: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Full matrices as the chosen kind has them."""
        one = np.eye(cov.shape[1])
        if self.covariance == "diag":
            return cov * one
        if self.covariance == "spherical":
            return np.trace(cov, axis1=1, axis2=2)[:, None, None] / cov.shape[1] * one
        if self.covariance == "tied":
            return np.repeat(((weight / weight.sum())[:, None, None] * cov).sum(0)[None], self.k, 0)
        return cov

    def _start(self, x: np.ndarray) -> None:
        r = np.random.default_rng(self.seed)
        centre = [x[r.integers(len(x))]]
        for _ in range(1, self.k):  # far points are likelier
            d = np.min([((x - c) ** 2).sum(1) for c in centre], axis=0)
            centre.append(x[r.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[r.integers(len(x))])
        mean = np.array(centre)
        for _ in range(20):
            near = ((x[:, None, :] - mean[None]) ** 2).sum(2).argmin(1)
            mean = np.array([x[near == k].mean(0) if (near == k).any() else mean[k] for k in range(self.k)])
        self.mean = mean
        self.cov = np.stack([np.cov(x.T).reshape(x.shape[1], -1) + self.floor * np.eye(x.shape[1])] * self.k)
        self.first, self.step = np.full(self.k, 1 / self.k), np.full((self.k, self.k), 1 / self.k)

    def _passes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        logs = _log_density(x, self.mean, self.cov)
        top = logs.max(1, keepdims=True)
        b = np.exp(logs - top)
        alpha, beta, scale = scans.passes(b, self.step, start=self.first)
        return alpha, beta, b / scale[:, None], float(np.log(scale).sum() + top.sum())

    def fit(self, x: np.ndarray) -> GaussianHMM:
        self._start(x)
        before = -np.inf
        for self.done in range(1, self.rounds + 1):
            alpha, beta, b, now = self._passes(x)
            post = alpha * beta
            post /= post.sum(1, keepdims=True)
            pairs = self.step * (alpha[:-1].T @ (b[1:] * beta[1:]))
            weight = post.sum(0) + 1e-10
            self.first = post[0] / post[0].sum()
            self.step = (pairs + 1e-10) / (pairs + 1e-10).sum(1, keepdims=True)
            self.mean = post.T @ x / weight[:, None]
            for k in range(self.k):
                d = x - self.mean[k]
                self.cov[k] = (post[:, k, None] * d).T @ d / weight[k] + self.floor * np.eye(x.shape[1])
            self.cov = self._shaped(self.cov, weight)
            if now - before < self.tolerance:
                break
            before = now
        order = self.mean[:, 0].argsort(kind="stable")
        self.mean, self.cov, self.first, self.step = self.mean[order], self.cov[order], self.first[order], self.step[order][:, order]
        return self

    def score(self, x: np.ndarray) -> float:
        return self._passes(x)[3]

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        alpha, beta, _, _ = self._passes(x)
        post = alpha * beta
        return post / post.sum(1, keepdims=True)

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        logs = _log_density(x, self.mean, self.cov)
        return scans.best_path(logs, np.log(self.step + 1e-300), start=np.log(self.first + 1e-300))[0]


COLUMNS = ["ret", "vol", "momentum", "volume_z"]


def states(feats: DataFrame, n_states: int = 4, rounds: int = 100, covariance: str = "full", additional: tuple[str, ...] = ()) -> DataFrame:
    """Of each row its state by the likeliest path and that state's posterior; of each entity's last row also the transition matrix's row. Entities with under 10 rows a state are left out."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx", ignore_index=True)
        x = g[[*COLUMNS, *additional]].to_numpy(float)
        if len(x) < 10 * n_states:
            return pd.DataFrame(columns=["entity", "idx", "ret", "volume", "state", "probability", "transitions", "log_likelihood"])
        sd = x.std(0)
        x = (x - x.mean(0)) / np.where(sd < 1e-8, 1, sd)
        m = GaussianHMM(n_states, rounds, covariance=covariance).fit(x)
        path = m.viterbi(x)
        return g[[KEY, "idx", "ret", "volume"]].assign(state=path, probability=m.posteriors(x)[np.arange(len(x)), path], transitions=[m.step[s].tolist() for s in path], log_likelihood=m.score(x))

    kind = feats.schema[KEY].dataType.simpleString()
    return feats.groupBy(KEY).applyInPandas(one, f"{KEY} {kind}, idx long, ret double, volume double, state int, probability double, transitions array<double>, log_likelihood double")


def profiles(states_: DataFrame) -> DataFrame:
    """Of each state its mean return, deviation, mean volume, frequency, name and expected duration."""
    g = states_.groupBy(KEY, "state").agg(F.avg("ret").alias("mean_return"), F.stddev_pop("ret").alias("volatility"), F.avg("volume").alias("avg_volume"), F.count("*").alias("n"), F.first("transitions").alias("_t"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(KEY))
    stay = F.element_at("_t", F.col("state") + 1)
    return g.select(KEY, "state", "mean_return", "volatility", "avg_volume", "n", share.alias("frequency"), R.regime_name(F.col("mean_return"), F.col("volatility")).alias("regime"), R.expected_duration(stay).alias("expected_duration"))


def summary(profiles_: DataFrame) -> DataFrame:
    """entity and text: what each state is like, a line each."""
    pct = lambda c: 100 * F.col(c)
    line = F.format_string("%d. return %.2f %%, volatility %.2f %%, %.1f %% of days", "state", pct("mean_return"), pct("volatility"), pct("frequency"))
    told = F.array_sort(F.collect_list(F.struct("state", line.alias("line"))))
    return profiles_.groupBy(KEY).agg(F.array_join(F.transform(told, lambda r: r["line"]), "\n").alias("text"))


def transitions(states_: DataFrame) -> DataFrame:
    """The transition matrix in long form, keyed by state (names may repeat)."""
    rows = states_.groupBy(KEY, "state").agg(F.first("transitions").alias("t"))
    return rows.select(KEY, F.col("state").alias("from_state"), F.posexplode("t").alias("to_state", "probability"))


def current(states_: DataFrame) -> DataFrame:
    w = Window.partitionBy(KEY).orderBy(F.desc("idx"))
    return states_.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(KEY, "idx", "state", "probability")


def synchronization(states_: DataFrame) -> DataFrame:
    """Over the steps that all entities have: the share in the most frequent state, on average, at most and at least; 0 with under two entities."""
    ends = states_.groupBy(KEY).agg(F.count("*").alias("n"))
    span = ends.agg(F.min("n").alias("n"), F.count("*").alias("entities"))
    c = states_.groupBy("idx", "state").count().groupBy("idx").agg((F.max("count") / F.sum("count")).alias("share"))
    c = c.join(span, c.idx < span.n)
    pick = lambda x: F.when(F.first("entities") >= 2, x).otherwise(0.0)
    return c.agg(pick(F.avg("share")).alias("average"), pick(F.max("share")).alias("highest"), pick(F.min("share")).alias("lowest"))


def separation(rows: DataFrame, value: str = "ret", state: str = "state", n: int = 200, seed: int = 42) -> DataFrame:
    """Variance between states over variance within, and how often shuffled states reach it."""

    def ratio(x: np.ndarray, s: np.ndarray) -> float:
        parts = [x[s == k] for k in np.unique(s)]
        within = sum(len(p) * p.var() for p in parts) / len(x)
        return float(sum(len(p) * (p.mean() - x.mean()) ** 2 for p in parts) / len(x) / (within + 1e-10))

    def one(key, g: pd.DataFrame) -> pd.DataFrame:
        from .spectral import hash_of

        g = g.sort_values("idx")
        x, s = g[value].to_numpy(float), g[state].to_numpy()
        r = np.random.default_rng([seed, hash_of(str(key[0])) % 2**32])
        own = ratio(x, s)
        null = np.array([ratio(x, r.permutation(s)) for _ in range(n)])
        return pd.DataFrame({KEY: [key[0]], "variance_ratio": own, "p": (1 + (null >= own).sum()) / (n + 1)})

    kind = rows.schema[KEY].dataType.simpleString()
    return rows.select(KEY, "idx", value, state).groupBy(KEY).applyInPandas(one, f"{KEY} {kind}, variance_ratio double, p double")


def cross_validate(feats: DataFrame, n_states: int = 3, splits: int = 5, rounds: int = 100) -> DataFrame:
    """Expanding folds: log-likelihood a row of the fold after each training span, and 1 - Jensen-Shannon divergence (nats) of the state shares in the two."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        x = g[COLUMNS].to_numpy(float)
        x = (x - x.mean(0)) / np.where(x.std(0) < 1e-8, 1, x.std(0))
        size = len(x) // (splits + 1)
        rows = []
        for k in range(1, splits + 1):
            if size < 10 * n_states:
                break
            a, b = x[: k * size], x[k * size : (k + 1) * size]
            m = GaussianHMM(n_states, rounds).fit(a)
            p, q = (np.bincount(m.viterbi(y), minlength=n_states) / len(y) + 1e-10 for y in (a, b))
            mid = (p + q) / 2
            js = 0.5 * (p * np.log(p / mid)).sum() + 0.5 * (q * np.log(q / mid)).sum()
            rows.append((g[KEY].iloc[0], k, m.score(b) / len(b), 1 - js))
        return pd.DataFrame(rows, columns=[KEY, "fold", "log_likelihood", "consistency"])

    kind = feats.schema[KEY].dataType.simpleString()
    return feats.groupBy(KEY).applyInPandas(one, f"{KEY} {kind}, fold int, log_likelihood double, consistency double")
