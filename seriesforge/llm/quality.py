"""Quality classifier: positive-unlabelled learning.

Texts become vectors of features that no language sets apart: how often each
class of character follows each other class, how words and lines repeat, and
lengths. A linear model is fitted with the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

over trusted positives (label 1) and unlabelled text, with the logistic loss;
where the second term falls below zero its gradient is turned, so that the
model doesn't fit the sample beyond what the risk can be. Labels of 0 are used
nowhere. The class prior is estimated from positives and unlabelled text alone:
a model that tells the two apart is fitted to one half of each, and on the other
half the prior can't exceed, for any score, the share of unlabelled texts above
it over that of positives; the least such bound is taken, with a confidence
margin for both shares.

Only the fit uses samples: at most SAMPLE positives and SAMPLE unlabelled
texts, drawn evenly by a hash of doc_id. Features and scores cover all rows.

Null texts are empty and are scored, and texts of any length are read whole. Rows without positives to learn from score
0.5. Rows that repeat a doc_id are scored each; of several labels for one id
the least counts, null labels don't. A null doc_id has no label and isn't held
out. Other columns are ignored, or kept in the struct `row` if in `carry`.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .near_dedup import word_hashes

SAMPLE = 15_000
CLASSES = 14
DENSE = 10
SIZE = CLASSES * CLASSES + DENSE


@functools.cache
def _classes() -> np.ndarray:
    """A class for each byte: lower, upper, digit, space, line end, beyond ASCII, and kinds of punctuation."""
    out = np.full(256, 6, np.uint8)
    for i, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\f\v")):
        out[list(chars)] = i
    out[128:] = 5
    for i, chars in enumerate((b".,", b"!?", b"*#%$&@^~", b"|_=+/\\", b"\"'`", b"()[]{}<>", b":;-"), 7):
        out[list(chars)] = i
    return out


def features(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of SIZE features for each text."""
    n = len(starts) - 1
    size = np.diff(starts)
    row = np.repeat(np.arange(n), size)
    kind = _classes()[data].astype(np.int64)
    pair = kind[:-1] * CLASSES + kind[1:] if len(kind) else kind
    same = row[:-1] == row[1:]
    counts = np.bincount(row[:-1][same] * CLASSES * CLASSES + pair[same], minlength=n * CLASSES * CLASSES).reshape(n, -1)
    out = np.zeros((n, SIZE), np.float32)
    out[:, : CLASSES * CLASSES] = np.sqrt(counts / np.maximum(size - 1, 1)[:, None])

    text, word = word_hashes(data, starts)
    words = np.bincount(text, minlength=n)
    order = np.lexsort((word, text))
    t, w = text[order], word[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (w[1:] != w[:-1])
    first = np.flatnonzero(new)
    often = np.diff(np.append(first, len(t)))
    distinct = np.bincount(t[first], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, t[first], often)
    repeats = np.bincount(text[1:][(text[1:] == text[:-1]) & (word[1:] == word[:-1])], minlength=n)
    known = np.zeros(len(word), np.int64)
    known[order] = np.repeat(often, often)
    after = (text[1:] == text[:-1]) if len(text) else np.zeros(0, bool)
    bigram = (word[:-1] * np.uint64(31) + word[1:])[after] if len(word) else word
    owner = text[:-1][after] if len(text) else text
    bo = np.lexsort((bigram, owner))
    fresh = np.ones(len(bo), bool)
    fresh[1:] = (owner[bo][1:] != owner[bo][:-1]) | (bigram[bo][1:] != bigram[bo][:-1])
    pairs, distinct_pairs = np.bincount(owner, minlength=n), np.bincount(owner[bo][fresh], minlength=n)
    lines = np.bincount(row[kind == 4], minlength=n) + 1
    many = np.maximum(words, 1)
    out[:, CLASSES * CLASSES :] = np.stack(
        [
            np.log1p(words) / 5,
            np.minimum(size / many, 40) / 10,
            distinct / many,
            top / many,
            repeats / many,
            distinct_pairs / np.maximum(pairs, 1),
            np.log1p(words / lines) / 3,
            np.sqrt(np.bincount(text, weights=(known > 1), minlength=n) / many),
            (words == 0).astype(float),
            (words < 5).astype(float),
        ],
        1,
    )
    return out


@C.tidy
def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.slices(batches):
        x = features(*C.text_bytes(batch.column("text")))
        flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * SIZE), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
        yield pa.record_batch([batch.column("doc_id"), flat], names=["doc_id", "features"])


def _matrix(column: pa.Array) -> np.ndarray:
    data, _ = C.text_bytes(column)
    return data.view(np.float32).reshape(-1, SIZE)


class Model:
    """score = 1 / (1 + exp(-(w . (x - mean) / scale + b)))"""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, b: float):
        self.mean, self.scale, self.w, self.b = mean, scale, w, b

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.w + self.b
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, decay: float = 2e-4, beta: float = 0.0) -> Model:
    """Minimises the non-negative risk by Adam over the whole sample."""
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8).astype(np.float64) for x in (positive, unlabelled))
    w, b = np.zeros(p.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        zp, zu = p @ w + b, u @ w + b
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_pos = prior * np.append(p.T @ (sp - 1), (sp - 1).sum()) / len(p)
        g_neg = np.append(u.T @ su, su.sum()) / len(u) - prior * np.append(p.T @ sp, sp.sum()) / len(p)
        g = g_pos + g_neg if negative >= -beta else -g_neg
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (0.2 if t > 0.7 * steps else 1) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(mean, scale, w, float(b))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, sure: float = 0.05) -> float:
    """The share of positives in unlabelled rows, from rows of both kinds alone; 0.5 from too few of them."""
    halves = [(x[::2], x[1::2]) for x in (positive, unlabelled)]
    if any(len(h) < 5 for pair in halves for h in pair):
        return 0.5
    (p, p_rest), (u, u_rest) = halves
    model = fit(p, u, 0.5, steps=300)
    scores, above = model.score(p_rest), model.score(u_rest)
    margin = lambda n: np.sqrt(np.log(2 / sure) / (2 * n))
    edges = np.quantile(scores, np.linspace(0, 0.9, 91))  # a tenth of the positives at least
    hit = np.array([(scores >= e).mean() for e in edges])
    share = np.array([(above >= e).mean() for e in edges])
    bound = (share + margin(len(above))) / np.maximum(hit - margin(len(scores)), 1e-9)
    best = int(np.where(hit > 2 * margin(len(scores)), bound, np.inf).argmin())
    return float(np.clip(share[best] / hit[best], 0.01, 0.99))


@C.tidy
def _score(model: Model | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From stored features, or for rows that carry others, from the text itself."""
    for whole in batches:
        stored = "features" in whole.schema.names
        for batch in [whole] if stored else C.slices([whole]):
            x = _matrix(batch.column("features")) if stored else features(*C.text_bytes(batch.column("text")))
            score = model.score(x) if model else np.full(len(x), 0.5)
            rest = [n for n in ("doc_id", "row") if n in batch.schema.names]
            yield pa.record_batch([*(batch.column(n) for n in rest), pa.array(score.astype(np.float64))], names=[*rest, "score"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, carry: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold). Labels of held-out rows are never read."""
    df = C.with_text(docs, carry)
    kind = f", row {df.schema['row'].dataType.simpleString()}" if carry else ""
    made = C.stage(df.select("doc_id", "text").mapInArrow(_featurise, "doc_id long, features binary"), "features")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marks = marks.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ones = marks.where("quality = 1").count()
    model = None
    if ones:
        draw = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000))
        pick = lambda rows, total: rows.where(draw < 1_000_000 * min(1.0, SAMPLE / max(1, total))).limit(2 * SAMPLE).select("features").toArrow()
        known = made.where("doc_id is not null")
        positive = pick(known.join(marks.where("quality = 1").select("doc_id"), "doc_id", "left_semi"), ones)
        unlabelled = pick(known.where(~held_out(F.col("doc_id"))), known.count())
        if positive.num_rows and unlabelled.num_rows:
            p, u = (_matrix(t.column(0).combine_chunks()) for t in (positive, unlabelled))
            model = fit(p, u, class_prior(p, u))
    out = (df if carry else made).mapInArrow(functools.partial(_score, model), f"doc_id long{kind}, score double")
    cols = ["row"] if carry else []
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *cols)
