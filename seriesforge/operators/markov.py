"""Hidden Markov models as rows: fitted once, stored, and applied to other rows of their entities.

A model is one row: entity, the columns it reads and how they are centred and
scaled, the start, step, mean and covariance of its states, what its fit gave,
and the rows it saw. `fit` makes models by expectation maximisation, one task an
entity; `fit_labelled` from states that are known, by aggregates alone. `decode`
joins rows and models by entity. Models are saved and verified by
`sources.store.Store` like any other rows.

A series too long for one task is cut into blocks of rows, each a row of a table
(`blocks`). A block's rows act on the chain as one k x k matrix. `block_states`
and `fit_blocks` take three steps: the matrix of every block, in parallel; what
enters and leaves each block, by a pass over an entity's matrices, which are as
many as its blocks; and each block's rows, again in parallel. Only numbers that
tell whether to go on reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scans
from .regimes import COLUMNS, GaussianHMM, _log_density
from .series import KEY, apart

MODEL = (
    "columns array<string>, centre array<double>, scale array<double>, first array<double>, step array<array<double>>, "
    "mean array<array<double>>, cov array<array<array<double>>>, log_likelihood double, rounds int, n long"
)
NAMES = [part.split()[0] for part in MODEL.replace(", ", ",").split(",")]
#: Rows of an entity that the starting means of `fit_blocks` are drawn from, at most.
START_ROWS = 10_000


def _kind(df: DataFrame) -> str:
    return f"{KEY} {df.schema[KEY].dataType.simpleString()}"


def _row(key: object, m: GaussianHMM, columns: list[str], centre: np.ndarray, scale: np.ndarray, likelihood: float, rounds: int, n: int) -> pd.DataFrame:
    one = [key, columns, centre.tolist(), scale.tolist(), m.first.tolist(), m.step.tolist(), m.mean.tolist(), m.cov.tolist(), likelihood, rounds, n]
    return pd.DataFrame([one], columns=[KEY, *NAMES])


def _nested(x: object) -> np.ndarray:
    return np.array([_nested(y) for y in x]) if len(x) and isinstance(x[0], list | np.ndarray) else np.array(x, float)


def _model(r: dict) -> GaussianHMM:
    """The model of a row."""
    m = GaussianHMM(len(r["first"]))
    m.first, m.step, m.mean, m.cov = (_nested(r[c]) for c in ("first", "step", "mean", "cov"))
    return m


def _scaling(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sd = x.std(0)
    return x.mean(0), np.where(sd < 1e-8, 1.0, sd)


def fit(feats: DataFrame, n_states: int = 4, rounds: int = 100, covariance: str = "full", columns: list[str] | None = None, tolerance: float = 1e-3) -> DataFrame:
    """A model of each entity with at least 10 rows a state, by expectation maximisation over its rows in order of idx."""
    names = columns or COLUMNS

    def one(g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values("idx")[names].to_numpy(float)
        if len(x) < 10 * n_states:
            return pd.DataFrame(columns=[KEY, *NAMES])
        centre, scale = _scaling(x)
        x = (x - centre) / scale
        m = GaussianHMM(n_states, rounds, tolerance, covariance=covariance).fit(x)
        return _row(g[KEY].iloc[0], m, names, centre, scale, m.score(x), m.done, len(x))

    return feats.select(KEY, "idx", *names).groupBy(KEY).applyInPandas(one, f"{_kind(feats)}, {MODEL}")


def fit_labelled(rows: DataFrame, columns: list[str] | None = None, state: str = "state", smoothing: float = 1.0, floor: float = 1e-6) -> DataFrame:
    """A model of each entity from rows whose state (0, 1, ...) is known: means and variances of the states, shares, and steps with `smoothing` added to each count. Columns are neither centred nor scaled."""
    names = columns or COLUMNS
    k = F.col(state)
    of = lambda f: F.array(*(f(c) for c in names))
    diagonal = [F.array(*((F.var_pop(c) + floor) if c == d else F.lit(0.0) for d in names)) for c in names]
    per = rows.groupBy(KEY, k.alias("state")).agg(F.count("*").alias("n"), of(F.avg).alias("mean"), F.array(*diagonal).alias("cov"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("state", c))), lambda r: r[c])
    base = per.groupBy(KEY).agg(in_order("mean").alias("mean"), in_order("cov").alias("cov"), in_order("n").alias("_n"), F.sum("n").alias("n"))
    total = F.aggregate("_n", F.lit(0).cast("long"), lambda a, b: a + b)
    base = base.withColumn("first", F.transform("_n", lambda n: n / total)).drop("_n")
    after = F.lead(state).over(Window.partitionBy(KEY).orderBy("idx"))
    pairs = rows.select(KEY, k.alias("i"), after.alias("j")).where("j is not null").groupBy(KEY, "i", "j").count()
    own = per.select(KEY, "state")
    every = own.select(KEY, F.col("state").alias("i")).join(own.select(KEY, F.col("state").alias("j")), KEY)  # k by k of an entity
    counted = every.join(pairs, [KEY, "i", "j"], "left").withColumn("c", F.coalesce("count", F.lit(0)) + smoothing)
    share = counted.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy(KEY, "i")))
    line = share.groupBy(KEY, "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "p"))), lambda r: r["p"]).alias("p"))
    step = line.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda r: r["p"]).alias("step"))
    made = base.join(step, KEY)
    fixed = {"columns": F.array(*map(F.lit, names)), "centre": F.array(*[F.lit(0.0)] * len(names)), "scale": F.array(*[F.lit(1.0)] * len(names)), "log_likelihood": F.lit(None).cast("double"), "rounds": F.lit(0)}
    return made.select(KEY, *(fixed.get(c, F.col(c)).alias(c) for c in NAMES))


def _applied(g: pd.DataFrame, r: dict) -> tuple[GaussianHMM, np.ndarray]:
    x = (g[list(r["columns"])].to_numpy(float) - np.array(r["centre"])) / np.array(r["scale"])
    return _model(r), x


DECODED = "state int, probability double, probabilities array<double>, log_likelihood double"


def decode(feats: DataFrame, models: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Of each row, in order of idx, its state on the likeliest path, that state's posterior, the posteriors of all states, and the log-likelihood of all its entity's rows.

    The rows may be other ones than those that a model was fitted to: the chain begins anew at the first. Entities without a model give no rows.
    """

    def one(g: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(g) or not len(m):
            return pd.DataFrame(columns=[KEY, "idx", *carry, "state", "probability", "probabilities", "log_likelihood"])
        g = g.sort_values("idx", ignore_index=True)
        model, x = _applied(g, m.iloc[0].to_dict())
        path, post = model.viterbi(x), model.posteriors(x)
        return g[[KEY, "idx", *carry]].assign(state=path, probability=post[np.arange(len(x)), path], probabilities=list(post), log_likelihood=model.score(x))

    kinds = "".join(f", {c} {feats.schema[c].dataType.simpleString()}" for c in carry)
    return feats.groupBy(KEY).cogroup(apart(models).groupBy(KEY)).applyInPandas(one, f"{_kind(feats)}, idx long{kinds}, {DECODED}")


def predict(feats: DataFrame, models: DataFrame) -> DataFrame:
    """entity, idx and state of rows, new ones included."""
    return decode(feats, models).select(KEY, "idx", "state")


def predict_proba(feats: DataFrame, models: DataFrame) -> DataFrame:
    """entity, idx, state and probability, a row for each state."""
    return decode(feats, models).select(KEY, "idx", F.posexplode("probabilities").alias("state", "probability"))


def step_probabilities(models: DataFrame) -> DataFrame:
    """The step matrices in long form."""
    lines = models.select(KEY, F.posexplode("step").alias("from_state", "p"))
    return lines.select(KEY, "from_state", F.posexplode("p").alias("to_state", "probability"))


def blocks(feats: DataFrame, size: int = 65_536, columns: list[str] | None = None) -> DataFrame:
    """entity, block, idx and x: the rows of each block in order of idx, which counts from 0."""
    names = columns or COLUMNS
    row = F.struct("idx", F.array(*(F.col(c).cast("double") for c in names)).alias("x"))
    made = feats.groupBy(KEY, F.floor(F.col("idx") / size).alias("block")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return made.select(KEY, "block", F.transform("rows", lambda r: r["idx"]).alias("idx"), F.transform("rows", lambda r: r["x"]).alias("x"))


def _likelihoods(r: object) -> tuple[GaussianHMM, np.ndarray, np.ndarray]:
    """A block's model, its scaled rows, and the log-densities of its rows."""
    m = _model(r._asdict())
    x = (np.stack(list(r.x)).astype(float) - np.array(r.centre)) / np.array(r.scale)
    return m, x, _log_density(x, m.mean, m.cov)


def _block_products(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        out = []
        for r in part.itertuples():
            m, _, logs = _likelihoods(r)
            b = np.exp(logs - logs.max(1, keepdims=True))
            best = scans.best_product(logs, np.log(m.step + 1e-300), r.block == 0)
            out.append((r.entity, r.block, scans.product(b, m.step, r.block == 0).tolist(), best.tolist(), m.first.tolist()))
        yield pd.DataFrame(out, columns=[KEY, "block", "product", "best", "first"])


def _carry(g: pd.DataFrame) -> pd.DataFrame:
    """What enters and leaves each block of an entity, and the best logarithms that enter it."""
    g = g.sort_values("block", ignore_index=True)
    first = np.array(g["first"].iloc[0])
    products = np.stack([_nested(x) for x in g["product"]])
    enter, leave = scans.carried(products, first)
    best = scans.best_carried(np.stack([_nested(x) for x in g["best"]]), np.log(first + 1e-300))
    return pd.DataFrame({KEY: g[KEY], "block": g["block"], "enter": enter.tolist(), "leave": leave.tolist(), "enter_best": best[:-1].tolist(), "end_best": best[1:].tolist(), "last": g.index == len(g) - 1})


def _with_carries(parts: DataFrame, models: DataFrame) -> DataFrame:
    """Blocks with their model and what enters and leaves them."""
    joined = parts.join(models, KEY)
    matrices = joined.mapInPandas(_block_products, f"{_kind(parts)}, block long, product array<array<double>>, best array<array<double>>, first array<double>")
    carries = matrices.groupBy(KEY).applyInPandas(_carry, f"{_kind(parts)}, block long, enter array<double>, leave array<double>, enter_best array<double>, end_best array<double>, last boolean")
    return joined.join(carries, [KEY, "block"])


def _block_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for r in part.itertuples():
            m, _, logs = _likelihoods(r)
            top = logs.max(1)
            begin = {"start": m.first} if r.block == 0 else {"enter": np.array(r.enter)}
            alpha, beta, scale = scans.passes(np.exp(logs - top[:, None]), m.step, leave=np.array(r.leave), **begin)
            post = alpha * beta
            post /= post.sum(1, keepdims=True)
            likelihood = float(np.log(scale).sum() + top.sum())
            begin = {"start": np.log(m.first + 1e-300)} if r.block == 0 else {"enter": np.array(r.enter_best)}
            step = np.log(m.step + 1e-300)
            paths, before = [], None
            for end in range(len(m.first)):  # the end state is known when the next block's path is
                path, before = scans.best_path(logs, step, end=end, **begin)
                paths.append(path)
            yield pd.DataFrame({KEY: [r.entity], "block": [r.block], "idx": [list(r.idx)], "post": [post.tolist()], "paths": [np.stack(paths, 1).tolist()], "before": [before.tolist()], "end": [int(np.argmax(r.end_best))], "log_likelihood": [likelihood]})


def _chain_ends(g: pd.DataFrame) -> pd.DataFrame:
    """From the last block back: the state in which each block's path ends."""
    g = g.sort_values("block", ignore_index=True)
    ends = [int(g["end"].iloc[-1])]
    for before in list(g["before"])[:0:-1]:
        ends.append(int(before[ends[-1]]))
    return pd.DataFrame({KEY: g[KEY], "block": g["block"], "ends": ends[::-1]})


def block_states(parts: DataFrame, models: DataFrame) -> DataFrame:
    """As `decode`, of blocks; the log-likelihood is that of the whole entity."""
    kind = _kind(parts)
    done = _with_carries(parts, models).mapInPandas(_block_rows, f"{kind}, block long, idx array<long>, post array<array<double>>, paths array<array<int>>, before array<int>, end int, log_likelihood double")
    ends = done.select(KEY, "block", "before", "end").groupBy(KEY).applyInPandas(_chain_ends, f"{kind}, block long, ends int")
    whole = done.groupBy(KEY).agg(F.sum("log_likelihood").alias("whole"))
    j = done.join(ends, [KEY, "block"]).join(whole, KEY)
    rows = j.select(KEY, "ends", "whole", F.explode(F.arrays_zip("idx", "post", "paths")).alias("r"))
    state = F.element_at("r.paths", F.col("ends") + 1)
    return rows.select(KEY, F.col("r.idx").alias("idx"), state.alias("state"), F.element_at("r.post", state + 1).alias("probability"), F.col("r.post").alias("probabilities"), F.col("whole").alias("log_likelihood"))


STATS = "entered array<double>, w array<double>, sx array<array<double>>, sxx array<array<array<double>>>, pairs array<array<double>>, log_likelihood double, size long"


def _block_sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a round of expectation maximisation needs to know of a block."""
    for part in parts:
        for r in part.itertuples():
            m, x, logs = _likelihoods(r)
            top = logs.max(1, keepdims=True)
            b = np.exp(logs - top)
            begin = {"start": m.first} if r.block == 0 else {"enter": np.array(r.enter)}
            alpha, beta, scale = scans.passes(b, m.step, leave=np.array(r.leave), **begin)
            post = alpha * beta
            post /= post.sum(1, keepdims=True)
            ahead = b / scale[:, None] * beta
            before = alpha[:-1] if r.block == 0 else np.concatenate([np.array(r.enter)[None], alpha[:-1]])
            pairs = m.step * (before.T @ (ahead[1:] if r.block == 0 else ahead))
            sxx = np.einsum("nk,ni,nj->kij", post, x, x)
            out = [r.entity, r.block, post[0].tolist(), post.sum(0).tolist(), (post.T @ x).tolist(), sxx.tolist(), pairs.tolist(), float(np.log(scale).sum() + top.sum()), len(x)]
            yield pd.DataFrame([out], columns=[KEY, "block", *(s.split()[0] for s in STATS.split(", "))])


def _maximised(covariance: str, floor: float, tolerance: float):
    """The next model of an entity from its blocks' sums and its model; rounds is negative once it has converged."""

    def one(g: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        r = old.iloc[0]
        if not len(g):
            return old
        total = lambda c: sum(_nested(x) for x in g[c])
        m = GaussianHMM(len(r["first"]), floor=floor, covariance=covariance)
        w, likelihood = total("w") + 1e-10, float(g["log_likelihood"].sum())
        m.first = np.array(g.sort_values("block")["entered"].iloc[0])
        pairs = total("pairs") + 1e-10
        m.step = pairs / pairs.sum(1, keepdims=True)
        m.mean = total("sx") / w[:, None]
        cov = total("sxx") / w[:, None, None] - np.einsum("ki,kj->kij", m.mean, m.mean) * ((w - 1e-10) / w)[:, None, None]
        m.cov = m._shaped(cov + floor * np.eye(cov.shape[1]), w)
        ended = likelihood - r["log_likelihood"] < tolerance
        rounds = abs(int(r["rounds"])) + 1
        return _row(r[KEY], m, list(r["columns"]), np.array(r["centre"]), np.array(r["scale"]), likelihood, -rounds if ended else rounds, int(g["size"].sum()))

    return one


def _begun(n_states: int, covariance: str, columns: list[str], floor: float):
    def one(key: tuple, rows: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        s = sums.iloc[0]
        centre, sd = np.array(s["centre"]), np.array(s["sd"])
        scale = np.where(sd < 1e-8, 1.0, sd)
        x = (np.stack(list(rows.sort_values("idx")["x"])).astype(float) - centre) / scale
        m = GaussianHMM(n_states, floor=floor, covariance=covariance)
        m._start(x)
        return _row(key[0], m, columns, centre, scale, -np.inf, 0, int(s["n"]))

    return one


def _in_order(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """States by the mean of their first feature."""
    for part in parts:
        rows = []
        for r in part.to_dict("records"):
            m = _model(r)
            k = m.mean[:, 0].argsort(kind="stable")
            rows.append(r | {"first": m.first[k].tolist(), "step": m.step[k][:, k].tolist(), "mean": m.mean[k].tolist(), "cov": m.cov[k].tolist(), "rounds": abs(r["rounds"])})
        yield pd.DataFrame(rows, columns=[KEY, *NAMES])


def fit_blocks(parts: DataFrame, stage, n_states: int = 4, rounds: int = 100, covariance: str = "full", columns: list[str] | None = None, tolerance: float = 1e-3, floor: float = 1e-3) -> DataFrame:
    """As `fit`, of blocks. stage(df) writes a table and reads it again; each round writes the models, a row an entity, and a row of sums a block.

    The log-likelihood is that before the last round. The starting means are drawn from every n-th row, so that there are at most START_ROWS of them.
    """
    names = columns or COLUMNS
    kind = _kind(parts)
    row = parts.select(KEY, F.explode(F.arrays_zip("idx", "x")).alias("r")).select(KEY, "r.idx", "r.x")
    of = lambda f: F.array(*(f(F.col("x")[i]) for i in range(len(names))))
    sums = row.groupBy(KEY).agg(F.count("*").alias("n"), of(F.avg).alias("centre"), of(F.stddev_pop).alias("sd"))
    sums = stage(sums)
    some = row.join(sums.select(KEY, F.ceil(F.col("n") / START_ROWS).alias("every")), KEY).where("idx % every = 0").select(KEY, "idx", "x")
    models = stage(some.groupBy(KEY).cogroup(sums.groupBy(KEY)).applyInPandas(_begun(n_states, covariance, names, floor), f"{kind}, {MODEL}"))
    for _ in range(rounds):
        going = models.where("rounds >= 0")
        stats = stage(_with_carries(parts, going).mapInPandas(_block_sums, f"{kind}, block long, {STATS}"))
        models = stage(stats.groupBy(KEY).cogroup(models.groupBy(KEY)).applyInPandas(_maximised(covariance, floor, tolerance), f"{kind}, {MODEL}"))
        if models.where("rounds >= 0").isEmpty():
            break
    return models.mapInPandas(_in_order, f"{kind}, {MODEL}")
