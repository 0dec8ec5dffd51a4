"""Searches for parameters: trials are rows, scored in parallel for each entity."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .changepoint import pelt
from .lstm import Config, validation_loss
from .regimes import GaussianHMM
from .series import KEY
from .spectral import hash_of
from .wavelet import transform

#: Ranges of the search. Fixed values.
SPACES = {
    "fourier": {"min_strength": (0.05, 0.5), "min_confidence": (0.5, 0.95)},
    "hmm": {"n_states": (2, 6)},
    "changepoint": {"penalty": (0.5, 20.0), "min_segment": (5, 50)},
    "wavelet": {"n_scales": (32, 128), "wavelet": (0, 1)},
    "lstm": {"hidden": (16, 128), "layers": (1, 3), "dropout": (0.1, 0.5), "length": (10, 60), "log10_rate": (-4.0, -2.0), "attention": (0, 1)},
}
WAVELETS = ("morlet", "mexican_hat")

#: What a search may minimise instead: a function of the detector's result and the series.
Metric = Callable[[object, np.ndarray], float]


def trials(space: dict[str, tuple[float, float]], n: int = 20, sampler: str = "random", seed: int = 42) -> list[dict[str, float]]:
    """n random draws, or about n points of a grid; ranges of whole numbers give whole numbers."""
    draw = lambda lo, hi, u: round(lo + u * (hi - lo)) if isinstance(lo, int) else lo + u * (hi - lo)
    if sampler == "random":
        r = np.random.default_rng(seed)
        points = [[r.random() for _ in space] for _ in range(n)]
    elif sampler == "grid":
        side = max(2, int(round(n ** (1 / len(space)))))
        points = list(itertools.product(np.linspace(0, 1, side), repeat=len(space)))
    else:
        raise ValueError(f"unknown sampler: {sampler}")
    return [{k: draw(*space[k], float(u)) for k, u in zip(space, p, strict=True)} for p in points]


def score_changepoint(x: np.ndarray, p: dict, metric: Metric | None = None) -> float:
    """How far the number of breaks is from one in 75 rows; the result is the list of breaks."""
    z = (x - x.mean()) / (x.std() + 1e-10)
    found = pelt(z, "l2", p["penalty"], int(p["min_segment"]))
    return metric(found, x) if metric else abs(len(found) - len(x) / 75)


def score_hmm(x: np.ndarray, p: dict, metric: Metric | None = None) -> float:
    """The Bayesian information criterion; the result is the model."""
    k = int(p["n_states"])
    z = ((x - x.mean()) / (x.std() + 1e-10))[:, None]
    free = k * k - 1 + 2 * k
    model = GaussianHMM(k, 30).fit(z)
    return metric(model, x) if metric else free * np.log(len(z)) - 2 * model.score(z)


def score_fourier(x: np.ndarray, p: dict, metric: Metric | None = None) -> float:
    """Less the number of frequencies of enough strength times their mean share of it; the result is their strengths."""
    power = np.abs(np.fft.rfft(x - x.mean()))[1 : len(x) // 2] * 2 / len(x) / (x.std() + 1e-10)
    kept = power[power >= p["min_strength"]]
    sure = 0.5 * np.minimum(kept, 1) + 0.5
    if metric:
        return metric(kept[sure >= p["min_confidence"]], x)
    return -float((sure >= p["min_confidence"]).sum() * (sure.mean() if len(sure) else 0))


def score_wavelet(x: np.ndarray, p: dict, metric: Metric | None = None) -> float:
    """Less the number of ridges; the result is their (scale, start, end)."""
    z = (x - x.mean()) / x.std() if x.std() > 1e-8 else np.zeros(len(x))
    found = []
    for s in range(1, int(p["n_scales"]) + 1):
        power = transform(z, np.array([float(s)]), WAVELETS[int(p["wavelet"])])[0] ** 2
        above = np.concatenate([[False], power > np.median(power) + power.std(ddof=0), [False]])
        ends = np.flatnonzero(above[1:] != above[:-1]).reshape(-1, 2)
        found += [(s, int(a), int(b)) for a, b in ends if b - a >= int(0.1 * len(x))]
    return metric(found, x) if metric else -float(len(found))


def score_lstm(x: np.ndarray, p: dict, metric: Metric | None = None) -> float:
    """The loss on the held-out share, infinite for short series; the result is that loss. `epochs` may be among the parameters (else 30)."""
    whole = {k: int(p[k]) for k in ("hidden", "layers", "length") if k in p}
    c = Config(dropout=p.get("dropout", 0.2), rate=10 ** p.get("log10_rate", -3.0), attention=bool(p.get("attention", 1)), epochs=int(p.get("epochs", 30)), **whole)
    loss = validation_loss(x, c)
    return metric(loss, x) if metric else loss


def _series_values(series: DataFrame) -> DataFrame:
    return series.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda s: s["value"]).alias("values"))


def _scored(pairs: DataFrame, objective: Callable[..., float], metric: Metric | None) -> DataFrame:
    """Adds score to rows of (entity, trial, values, params), which are dealt out one by one; values go."""
    more = () if metric is None else (metric,)

    @F.pandas_udf("double")
    def run(values: pd.Series, params: pd.Series) -> pd.Series:
        return pd.Series([float(objective(np.asarray(v, float), dict(p), *more)) for v, p in zip(values, params, strict=True)])

    return pairs.repartition(KEY, "trial").select(KEY, "trial", "params", run("values", "params").alias("score"))


def _ranked(scored: DataFrame) -> DataFrame:
    return scored.withColumn("best", F.row_number().over(Window.partitionBy(KEY).orderBy("score", "trial")) == 1)


def search(series: DataFrame, space: dict, objective: Callable[..., float], n: int = 20, sampler: str = "random", seed: int = 42, metric: Metric | None = None) -> DataFrame:
    """The objective (less is better) of each trial for each entity: trial, params, score, best. A metric takes the place of the objective's own measure."""
    rows = [(i, {k: float(v) for k, v in p.items()}) for i, p in enumerate(trials(space, n, sampler, seed))]
    grid = series.sparkSession.createDataFrame(rows, "trial int, params map<string,double>")
    pairs = _series_values(series).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(len(rows) - 1)))).join(F.broadcast(grid), "trial")  # the grid is a list of n rows
    return _ranked(_scored(pairs, objective, metric))


def _parzen(points: np.ndarray, lo: float, hi: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres and widths of a density over [lo, hi]: a kernel at each point, as wide as its farther neighbour is away (within bounds), and a flat one at the middle."""
    middle, span = (lo + hi) / 2, hi - lo
    at = np.sort(np.append(points, middle))
    gaps = np.diff(np.concatenate([[lo], at, [hi]]))
    width = np.clip(np.maximum(gaps[:-1], gaps[1:]), span / min(100, 1 + len(at)), span)
    width[np.flatnonzero(at == middle)[0]] = span
    return at, width


def _log_density(x: np.ndarray, at: np.ndarray, width: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Of the mixture of normals cut off at the bounds."""
    phi = lambda z: np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z])
    inside = phi((hi - at) / width) - phi((lo - at) / width)
    z = (x[:, None] - at[None]) / width[None]
    return np.log((np.exp(-0.5 * z * z) / (width * math.sqrt(2 * math.pi) * np.maximum(inside, 1e-12))[None]).mean(1) + 1e-300)


def propose(known: list[dict[str, float]], scores: np.ndarray, space: dict, n: int, r: np.random.Generator, candidates: int = 24) -> list[dict[str, float]]:
    """n further points by tree-structured Parzen estimators: the best tenth of the known points (25 at most) and the others each give a density a parameter; of values drawn from the first, that with the greatest ratio to the second is taken."""
    order = np.argsort(np.where(np.isfinite(scores), scores, np.inf), kind="stable")
    good = order[: max(1, min(25, math.ceil(0.1 * len(order))))]
    rest = order[len(good) :]
    out: list[dict[str, float]] = []
    for _ in range(n):
        point = {}
        for name, (lo, hi) in space.items():
            whole = isinstance(lo, int)
            a, b = (lo - 0.5, hi + 0.5) if whole else (lo, hi)
            values = np.array([p[name] for p in known])
            at, width = _parzen(values[good], a, b)
            k = r.integers(len(at), size=candidates)
            x = r.normal(at[k], width[k])
            while ((x < a) | (x > b)).any():
                off = (x < a) | (x > b)
                x[off] = r.normal(at[k[off]], width[k[off]])
            if whole:
                x = np.clip(np.round(x), lo, hi)
            gain = _log_density(x, at, width, a, b) - _log_density(x, *_parzen(values[rest], a, b), a, b)
            point[name] = float(x[gain.argmax()])
        out.append(point)
    return out


def _further(space: dict, made: int, size: int, seed: int):
    """Of an entity's trials so far, `size` further ones."""

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("trial")
        r = np.random.default_rng([seed, made, hash_of(str(key[0])) % 2**32])
        points = propose([dict(p) for p in g["params"]], g["score"].to_numpy(float), space, size, r)
        return pd.DataFrame({KEY: key[0], "trial": range(made, made + size), "params": points})

    return one


def learned_search(
    series: DataFrame, space: dict, objective: Callable[..., float], stage: Callable[[DataFrame], DataFrame], n: int = 100, first: int = 20, batch: int = 20, seed: int = 42, metric: Metric | None = None
) -> DataFrame:
    """As `search`, but trials learn: after `first` random ones, rounds of `batch` are proposed for each entity from its scores so far. stage(df) writes the trials of a round and reads them again; they are few numbers a trial."""
    values = stage(_series_values(series))
    kind = f"{KEY} {series.schema[KEY].dataType.simpleString()}"
    start = [(i, {k: float(v) for k, v in p.items()}) for i, p in enumerate(trials(space, min(first, n), "random", seed))]
    grid = series.sparkSession.createDataFrame(start, "trial int, params map<string,double>")
    pairs = values.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(len(start) - 1)))).join(F.broadcast(grid), "trial")
    done = stage(_scored(pairs, objective, metric))
    made = len(start)
    while made < n:
        size = min(batch, n - made)
        new = done.groupBy(KEY).applyInPandas(_further(space, made, size, seed), f"{kind}, trial int, params map<string,double>")
        done = stage(done.unionByName(_scored(new.join(values, KEY), objective, metric)))
        made += size
    return _ranked(done)


def importance(scored: DataFrame, space: dict[str, tuple[float, float]], bins: int = 10) -> DataFrame:
    """How much each parameter alone explains of an entity's scores: the variance of the mean score of its bins (equal widths of its range; whole numbers have a bin each if they are few) as a share of that of all parameters.

    scored: entity, params, score; infinite scores don't count. The shares of an entity add up to 1, unless no parameter matters.
    """
    known = F.create_map(*(x for name, (lo, hi) in space.items() for x in (F.lit(name), F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), F.lit(isinstance(lo, int) and hi - lo < bins).alias("few")))))
    rows = scored.where(F.abs("score") < float("inf")).select(KEY, "score", F.explode("params").alias("parameter", "value")).withColumn("r", known[F.col("parameter")])
    place = F.least(F.floor((F.col("value") - F.col("r.lo")) / (F.col("r.hi") - F.col("r.lo")) * bins), F.lit(bins - 1))
    bin_ = F.when(F.col("r.few"), F.round("value").cast("long")).otherwise(place)
    means = rows.groupBy(KEY, "parameter", bin_.alias("bin")).agg(F.avg("score").alias("m"), F.count("*").alias("n"))
    w = Window.partitionBy(KEY, "parameter")
    centre = F.sum(F.col("m") * F.col("n")).over(w) / F.sum("n").over(w)
    spread = means.withColumn("d", F.col("n") * F.pow(F.col("m") - centre, F.lit(2.0))).groupBy(KEY, "parameter").agg((F.sum("d") / F.sum("n")).alias("v"))
    return spread.select(KEY, "parameter", F.coalesce(F.col("v") / F.nullif(F.sum("v").over(Window.partitionBy(KEY)), F.lit(0.0)), F.lit(0.0)).alias("importance"))
