"""Sequence prediction by a recurrent network with attention, one small model for each entity."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import KEY, apart


@dataclass(frozen=True)
class Config:
    length: int = 30
    hidden: int = 64
    layers: int = 2
    dropout: float = 0.2
    attention: bool = True
    bidirectional: bool = False
    rate: float = 1e-3
    epochs: int = 50
    validation: float = 0.2
    batch: int = 32
    seed: int = 42


def dataset(series: DataFrame, length: int) -> DataFrame:
    """Each row with the `length` values before it as x, and its own as y."""
    w = Window.partitionBy(KEY).orderBy("idx").rowsBetween(-length, -1)
    return series.withColumns({"x": F.collect_list("value").over(w), "y": F.col("value")}).where(F.size("x") == length).select(KEY, "idx", "x", "y")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _cells(x: np.ndarray, w: np.ndarray, b: np.ndarray):
    """States of one layer of cells over x (rows, steps, inputs), and what its gradients need."""
    h = len(b) // 4
    s, m = np.zeros((len(x), h)), np.zeros((len(x), h))
    cache, states = [], []
    for t in range(x.shape[1]):
        z = np.concatenate([s, x[:, t]], 1)
        g = z @ w + b
        i, f, o, u = _sigmoid(g[:, :h]), _sigmoid(g[:, h : 2 * h]), _sigmoid(g[:, 2 * h : 3 * h]), np.tanh(g[:, 3 * h :])
        before, m = m, f * m + i * u
        tm = np.tanh(m)
        s = o * tm
        cache.append((z, i, f, o, u, before, tm))
        states.append(s)
    return np.stack(states, 1), cache


def _cells_back(dstates: np.ndarray, cache: list, w: np.ndarray):
    """Gradients of a layer's inputs, weights and offsets."""
    n, steps, h = dstates.shape
    ds, dm = np.zeros((n, h)), np.zeros((n, h))
    dx, dw, db = np.empty((n, steps, len(w) - h)), np.zeros_like(w), np.zeros(4 * h)
    for t in range(steps - 1, -1, -1):
        z, i, f, o, u, before, tm = cache[t]
        ds = ds + dstates[:, t]
        dm = dm + ds * o * (1 - tm * tm)
        dg = np.concatenate([dm * u * i * (1 - i), dm * before * f * (1 - f), ds * tm * o * (1 - o), dm * i * (1 - u * u)], 1)
        dw += z.T @ dg
        db += dg.sum(0)
        dz = dg @ w.T
        ds, dx[:, t], dm = dz[:, :h], dz[:, h:], dm * f
    return dx, dw, db


class Net:
    """Layers of long short-term memory cells, read forwards or both ways, with dropout between them in training, softmax attention over the last one's states (or its last state alone), and a linear output."""

    def __init__(self, c: Config):
        self.c = c
        self.history: list[tuple[float, float]] = []
        r = np.random.default_rng(c.seed)
        h, self.ways = c.hidden, 2 if c.bidirectional else 1
        self.p = {}
        inputs = 1
        for layer in range(c.layers):
            for way in range(self.ways):
                self.p[f"w{layer}{way}"] = r.normal(0, 1 / np.sqrt(h + inputs), (h + inputs, 4 * h))
                b = np.zeros(4 * h)
                b[h : 2 * h] = 1.0
                self.p[f"b{layer}{way}"] = b
            inputs = h * self.ways
        self.p |= {"a": r.normal(0, 0.1, inputs), "v": r.normal(0, 1 / np.sqrt(inputs), inputs), "o": np.zeros(1)}

    def forward(self, x: np.ndarray, drop: np.random.Generator | None = None):
        """Predictions, and (caches, masks, states, attention, context); dropout only where a generator is given."""
        seq, caches, masks = x[:, :, None], [], []
        for layer in range(self.c.layers):
            out = []
            for way in range(self.ways):
                states, cache = _cells(seq[:, ::-1] if way else seq, self.p[f"w{layer}{way}"], self.p[f"b{layer}{way}"])
                out.append(states[:, ::-1] if way else states)
                caches.append(cache)
            seq = np.concatenate(out, 2)
            if drop is not None and layer < self.c.layers - 1:
                masks.append((drop.random(seq.shape) >= self.c.dropout) / (1 - self.c.dropout))
                seq = seq * masks[-1]
        if self.c.attention:
            e = seq @ self.p["a"]
            e = np.exp(e - e.max(1, keepdims=True))
            att = e / e.sum(1, keepdims=True)
        else:
            att = np.zeros(seq.shape[:2])
            att[:, -1] = 1.0
        ctx = (att[:, :, None] * seq).sum(1)
        return ctx @ self.p["v"] + self.p["o"][0], (caches, masks, seq, att, ctx)

    def gradients(self, x: np.ndarray, y: np.ndarray, drop: np.random.Generator | None = None):
        out, (caches, masks, hs, att, ctx) = self.forward(x, drop)
        d = 2 * (out - y) / len(x)
        g = {"v": ctx.T @ d, "o": np.array([d.sum()]), "a": np.zeros_like(self.p["a"])}
        dctx = d[:, None] * self.p["v"]
        dseq = att[:, :, None] * dctx[:, None, :]
        if self.c.attention:
            datt = (hs * dctx[:, None, :]).sum(2)
            de = att * (datt - (att * datt).sum(1, keepdims=True))
            g["a"] = (de[:, :, None] * hs).sum((0, 1))
            dseq = dseq + de[:, :, None] * self.p["a"]
        h = self.c.hidden
        for layer in range(self.c.layers - 1, -1, -1):
            if layer < len(masks):
                dseq = dseq * masks[layer]
            down = 0.0
            for way in range(self.ways):
                part = dseq[:, :, way * h : (way + 1) * h]
                dx, g[f"w{layer}{way}"], g[f"b{layer}{way}"] = _cells_back(part[:, ::-1] if way else part, caches[layer * self.ways + way], self.p[f"w{layer}{way}"])
                down = down + (dx[:, ::-1] if way else dx)
            dseq = down
        return float(((out - y) ** 2).mean()), g

    def loss(self, x: np.ndarray, y: np.ndarray) -> float:
        """Mean squared error without dropout; nan without rows."""
        return float(((self.forward(x)[0] - y) ** 2).mean()) if len(x) else float("nan")

    def fit(self, x: np.ndarray, y: np.ndarray, held: tuple[np.ndarray, np.ndarray] | None = None) -> Net:
        """Adam over shuffled batches; with held-out rows, history has the losses of training and validation after each epoch."""
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        r, t = np.random.default_rng(self.c.seed), 0
        drop = np.random.default_rng(self.c.seed + 1) if self.c.dropout > 0 and self.c.layers > 1 else None
        for _ in range(self.c.epochs):
            order, losses = r.permutation(len(x)), []
            for lo in range(0, len(x), self.c.batch):
                t += 1
                loss, g = self.gradients(x[order[lo : lo + self.c.batch]], y[order[lo : lo + self.c.batch]], drop)
                losses.append(loss)
                for k in self.p:
                    d = np.clip(g[k], -5, 5)
                    m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                    self.p[k] -= self.c.rate * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
            if held is not None:
                self.history.append((float(np.mean(losses)), self.loss(*held)))
        return self


def _windows(v: np.ndarray, c: Config):
    """Windows and next values of the z-scored series, the end of the training share, mean and deviation."""
    sd = v.std() if v.std() > 1e-8 else 1.0
    z = (v - v.mean()) / sd
    x = np.lib.stride_tricks.sliding_window_view(z, c.length)[:-1]
    return x, z[c.length :], max(1, int(len(x) * (1 - c.validation))), v.mean(), sd


def validation_loss(v: np.ndarray, c: Config) -> float:
    """Loss of the held-out share of one series after training; infinite for series under twice `length`."""
    if len(v) < 2 * c.length:
        return float("inf")
    x, y, cut, _, _ = _windows(v, c)
    return Net(c).fit(x[:cut], y[:cut]).loss(x[cut:], y[cut:])


MODEL = "config string, weights array<struct<name:string,shape:array<int>,values:array<double>>>, mean double, sd double, history array<struct<train_loss:double,val_loss:double>>, n long"
NAMES = ["config", "weights", "mean", "sd", "history", "n"]


def fit(series: DataFrame, c: Config = Config()) -> DataFrame:
    """A model of each entity of at least twice `length` rows, as a row: settings, weights, the series' mean and deviation, losses after each epoch, and the rows seen. Store it like any other table."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        v = g.sort_values("idx")["value"].to_numpy(float)
        if len(v) < 2 * c.length:
            return pd.DataFrame(columns=[KEY, *NAMES])
        x, y, cut, mean, sd = _windows(v, c)
        net = Net(c).fit(x[:cut], y[:cut], (x[cut:], y[cut:]))
        history = [{"train_loss": a, "val_loss": b} for a, b in net.history]
        weights = [{"name": k, "shape": list(w.shape), "values": w.ravel().tolist()} for k, w in net.p.items()]
        return pd.DataFrame([[g[KEY].iloc[0], json.dumps(asdict(c)), weights, mean, sd, history, len(v)]], columns=[KEY, *NAMES])

    kind = series.schema[KEY].dataType.simpleString()
    return series.select(KEY, "idx", "value").groupBy(KEY).applyInPandas(one, f"{KEY} {kind}, {MODEL}")


def restored(row: dict) -> Net:
    """The network of a model's row."""
    net = Net(Config(**json.loads(row["config"])))
    net.p = {w["name"]: np.array(w["values"], float).reshape(w["shape"]) for w in row["weights"]}
    return net


def losses(models: DataFrame) -> DataFrame:
    """epoch (from 1), train_loss and val_loss of each model."""
    rows = models.select(KEY, F.posexplode("history").alias("epoch", "h"))
    return rows.select(KEY, (F.col("epoch") + 1).alias("epoch"), "h.train_loss", "h.val_loss")


def train(series: DataFrame, c: Config = Config()) -> DataFrame:
    """Of each entity the losses of training and validation after each epoch: epoch (from 1), train_loss, val_loss; entities under twice `length` are left out."""
    return losses(fit(series, c))


PREDICTED = "idx long, actual double, predicted double, training boolean, attention array<double>"


def apply(series: DataFrame, models: DataFrame) -> DataFrame:
    """Of each row after the first `length` its prediction by its entity's model, and attention. The rows may be other ones than the model was fitted to; `training` is whether a row's position was in the training share. Entities without a model, or too short, are left out."""

    def one(g: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        names = [KEY, "idx", "actual", "predicted", "training", "attention"]
        if not len(g) or not len(m):
            return pd.DataFrame(columns=names)
        row = m.iloc[0].to_dict()
        net = restored(row)
        c = net.c
        g = g.sort_values("idx")
        v = g["value"].to_numpy(float)
        if len(v) <= c.length:
            return pd.DataFrame(columns=names)
        x = np.lib.stride_tricks.sliding_window_view((v - row["mean"]) / row["sd"], c.length)[:-1]
        out, (_, _, _, att, _) = net.forward(x)
        cut = max(1, int((row["n"] - c.length) * (1 - c.validation)))
        return pd.DataFrame({KEY: g[KEY].iloc[0], "idx": g["idx"].to_numpy()[c.length :], "actual": v[c.length :], "predicted": out * row["sd"] + row["mean"], "training": np.arange(len(x)) < cut, "attention": list(att)})

    kind = series.schema[KEY].dataType.simpleString()
    return series.select(KEY, "idx", "value").groupBy(KEY).cogroup(apart(models).groupBy(KEY)).applyInPandas(one, f"{KEY} {kind}, {PREDICTED}")


def predict(series: DataFrame, c: Config = Config()) -> DataFrame:
    """`apply` of models fitted to the same series."""
    return apply(series, fit(series, c))


def anomalies(predicted: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Rows whose error passes the entity's mean by `threshold` deviations."""
    w = Window.partitionBy(KEY)
    e = F.abs(F.col("actual") - F.col("predicted"))
    df = predicted.withColumn("error", e)
    return df.withColumn("edge", F.avg("error").over(w) + threshold * F.stddev_pop("error").over(w)).where("error > edge").select(KEY, "idx", "error", "edge")


def attention(predicted: DataFrame) -> DataFrame:
    """Mean attention of each place in the window, its greatest place, and the entropy of the mean."""
    m = predicted.select(KEY, F.posexplode("attention").alias("place", "a")).groupBy(KEY, "place").agg(F.avg("a").alias("a"))
    return m.groupBy(KEY).agg(F.max_by("place", F.struct("a", "place")).alias("most"), F.sum(-F.col("a") * F.ln(F.col("a") + 1e-12)).alias("entropy"))
