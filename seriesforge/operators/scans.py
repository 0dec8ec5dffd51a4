"""Forward, backward and best-path recursions of a Markov chain as parallel scans.

A step of the chain is a k x k matrix, and products of matrices can be grouped at
will. The rows are cut into about sqrt(n) lanes of sqrt(n) rows. One pass
multiplies the matrices of all lanes at once, one short pass over the lanes
gives what enters and leaves each of them, and one more pass fills in the rows.
The work is that of the plain recursion times k, in sqrt(n) array operations
instead of n. The same three passes over blocks of rows, each a row of a Spark
table, are in `markov`.

`b` has a row of k state likelihoods for each row, up to a factor a row. With
`start`, the chain begins at the first row with these probabilities; with
`enter`, they are the state probabilities of the row before.
"""

from __future__ import annotations

import math

import numpy as np


def _lanes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """b as (lanes, rows, k), its end filled up with ones, and which rows are real."""
    n, k = b.shape
    rows = max(1, math.isqrt(n - 1) + 1)
    lanes = -(-n // rows)
    out = np.ones((lanes * rows, k))
    out[:n] = b
    return out.reshape(lanes, rows, k), (np.arange(lanes * rows) < n).reshape(lanes, rows)


def _first(step: np.ndarray, started: bool, lanes: int) -> np.ndarray:
    """The step matrix into the first row of each lane: none where the chain begins."""
    out = np.repeat(step[None], lanes, 0)
    if started:
        out[0] = np.eye(len(step))
    return out


def product(b: np.ndarray, step: np.ndarray, started: bool) -> np.ndarray:
    """The matrix that takes what is before these rows to their last row, up to a factor."""
    total = np.eye(len(step))
    for m in _products(*_lanes(b), step, started):
        total = total @ m
        total /= total.max()
    return total


def _products(b: np.ndarray, real: np.ndarray, step: np.ndarray, started: bool) -> np.ndarray:
    p = np.repeat(np.eye(len(step))[None], len(b), 0)
    into = _first(step, started, len(b))
    for s in range(b.shape[1]):
        q = (p @ (into if s == 0 else step)) * b[:, s, None, :]
        q /= np.maximum(q.max((1, 2), keepdims=True), 1e-300)
        p = q if real[:, s].all() else np.where(real[:, s, None, None], q, p)
    return p


def carried(products: np.ndarray, start: np.ndarray, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Along parts with these products: the probabilities that enter each, and the scaled backward values that leave each (ones at the end, or `last`)."""
    n, k = products.shape[:2]
    enter, leave = np.empty((n + 1, k)), np.ones((n, k))
    enter[0] = start
    for i in range(n):
        a = enter[i] @ products[i]
        enter[i + 1] = a / max(a.sum(), 1e-300)
    if last is not None:
        leave[-1] = last
    for i in range(n - 1, 0, -1):
        q = products[i] @ leave[i]
        leave[i - 1] = q / max(float(enter[i] @ q), 1e-300)
    return enter[:-1], leave


def passes(b: np.ndarray, step: np.ndarray, start: np.ndarray | None = None, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """alpha (each row's sum is 1), beta and the scale of each row; sum(alpha * beta) is 1 in each row. leave: beta of the last row (ones if None)."""
    n, k = b.shape
    started = start is not None
    lanes, real = _lanes(b)
    into = _first(step, started, len(lanes))
    at, out = carried(_products(lanes, real, step, started), start if started else enter, leave)
    alpha, scale = np.empty_like(lanes), np.empty(lanes.shape[:2])
    a = at
    for s in range(lanes.shape[1]):
        a = ((a[:, None, :] @ into)[:, 0] if s == 0 else a @ step) * lanes[:, s]
        scale[:, s] = np.maximum(a.sum(1), 1e-300)
        a = a / scale[:, s, None]
        alpha[:, s] = a
    beta = np.empty_like(lanes)
    end = real.sum(1) - 1  # the last real row of each lane
    back = out
    for s in range(lanes.shape[1] - 1, -1, -1):
        if s < lanes.shape[1] - 1:
            back = np.where((s < end)[:, None], (lanes[:, s + 1] / scale[:, s + 1, None] * back) @ step.T, out)
        beta[:, s] = back
    flat = lambda x: x.reshape(-1, *x.shape[2:])[:n]
    return flat(alpha), flat(beta), flat(scale)


def best_product(logs: np.ndarray, step: np.ndarray, started: bool) -> np.ndarray:
    """As `product`, for the best path: sums and maxima of logarithms."""
    total = _best_first(len(step))
    for m in _best_products(*_lanes(logs), step, started):
        total = (total[:, :, None] + m[None]).max(1)
    return total


def _best_first(k: int) -> np.ndarray:
    return np.where(np.eye(k) > 0, 0.0, -np.inf)


def _best_products(logs: np.ndarray, real: np.ndarray, step: np.ndarray, started: bool) -> np.ndarray:
    k = len(step)
    p = np.repeat(_best_first(k)[None], len(logs), 0)
    for s in range(logs.shape[1]):
        q = (p[:, :, :, None] + step[None, None]).max(2)
        if s == 0 and started:
            q[0] = p[0]
        q = q + logs[:, s, None, :]
        p = q if real[:, s].all() else np.where(real[:, s, None, None], q, p)
    return p


def best_carried(products: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The best logarithms that enter each part, and behind the last one."""
    enter = np.empty((len(products) + 1, len(start)))
    enter[0] = start
    for i, m in enumerate(products):
        enter[i + 1] = (enter[i][:, None] + m).max(0)
    return enter


def best_path(logs: np.ndarray, step: np.ndarray, start: np.ndarray | None = None, enter: np.ndarray | None = None, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest states, which end in `end` (if None, where they are likeliest), and of each end state the state before the first row on its path.

    step, start and enter are logarithms.
    """
    n, k = logs.shape
    started = start is not None
    lanes, real = _lanes(logs)
    d = best_carried(_best_products(lanes, real, step, started), start if started else enter)
    last, d = d[-1], d[:-1]
    back = np.empty((*lanes.shape[:2], k), np.int32)
    own = np.broadcast_to(np.arange(k), (len(lanes), k))
    for s in range(lanes.shape[1]):
        total = d[:, :, None] + step[None]
        arg, top = total.argmax(1), total.max(1)
        if s == 0 and started:
            arg[0], top[0] = own[0], d[0]
        keep = real[:, s, None]
        back[:, s] = np.where(keep, arg, own)
        d = np.where(keep, top + lanes[:, s], d)
    paths = np.empty_like(back)
    now = own.copy()
    for s in range(lanes.shape[1] - 1, -1, -1):
        paths[:, s] = now
        now = np.take_along_axis(back[:, s], now, 1)
    ends = np.empty(len(lanes), int)
    before = np.arange(k)
    for lane in range(len(lanes) - 1, -1, -1):
        before = now[lane][before]
    ends[-1] = int(last.argmax()) if end is None else end
    for lane in range(len(lanes) - 1, 0, -1):
        ends[lane - 1] = now[lane, ends[lane]]
    path = paths[np.arange(len(lanes)), :, ends].reshape(-1)[:n]
    return path, before
