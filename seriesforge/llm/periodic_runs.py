"""Periodic runs of words, found on a harmonic grid.

A run is a stretch of words that repeats with a period of q words, is at least
`least_power` periods and `least_length` words long, and that no neighbouring
word extends; q is its smallest period.

1. A run of period p holds more than `step(p)` consecutive places i whose word
   stands p words later again, so one of them is a multiple of `step(p)`. The
   places i = 0, step, 2 step, ... of every p that fits make up the grid, n log n
   pairs (i, i + p) for n words. The pairs of all documents of a slice are laid
   out as flat arrays, `CHUNK` pairs at a time.
2. Pairs whose words differ go, as do those that differ from their neighbours on
   both sides. For the others one binary search, over all pairs at once, gives
   how far the texts at i and i + p agree to the right and to the left. It
   compares prefix hashes modulo two primes.
3. What is long enough is a run. Its words are compared as such; where a hash
   deceived, the document is searched again with numbers that stand for its
   words exactly and with other bases, until all runs hold.
4. A run is found at several grid points, and under multiples of its period;
   both find the same stretch (two periods that fit into it have their greatest
   common divisor as a period), so the least period of a stretch stays.

Words are maximal runs of bytes other than white space (x20, x09-x0D).
`collapsed` holds the words, joined by one space, without those that any run
contains after its first period.

Null and empty texts have no words and no runs. Rows that repeat a doc_id, and
null ids, pass one by one. Texts of any length are searched whole: the pairs are
dealt out in chunks, so memory grows with the words and not with the pairs.
Ties cannot arise, since runs are ordered by start, then period. Other columns
are ignored, or kept in the struct `row` if named in `carry`; an empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Two primes below 2**32, so that products of remainders fit 64 bits.
PRIMES = (4294967291, 4294967279)
#: Pairs of the grid that are looked at together.
CHUNK = 1 << 18
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class _Prefixes:
    """Prefix hashes of an array of numbers modulo the two primes."""

    def __init__(self, values: np.ndarray, seed: int):
        draw = np.random.default_rng(seed)
        self.sums, self.powers = [], []
        for prime in PRIMES:
            p = np.uint64(prime)
            base = int(draw.integers(1 << 20, prime - 1))
            power = np.ones(len(values) + 1, np.uint64)
            n = 1
            while n < len(power):
                more = power[n : 2 * n]
                more[:] = power[: len(more)] * np.uint64(pow(base, n, prime)) % p
                n *= 2
            sums = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(values % p * power[:-1] % p, out=sums[1:])
            self.sums.append(sums % p)
            self.powers.append(power)

    def same(self, i: np.ndarray, p: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether values[i : i + size] equal those p places later."""
        ok = np.ones(len(i), bool)
        for prime, sums, powers in zip(PRIMES, self.sums, self.powers, strict=True):
            m = np.uint64(prime)
            here = (sums[i + size] + m - sums[i]) % m * powers[p] % m
            ok &= here == (sums[i + p + size] + m - sums[i + p]) % m
        return ok

    def agree(self, i: np.ndarray, p: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """Of every pair (i, i + p) the number of places, at most `most`, that agree from there to the right, or before it to the left."""
        low, high = np.zeros_like(most), most.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_] + 1) >> 1
            at = i[open_] - mid if back else i[open_]
            ok = self.same(at, p[open_], mid)
            low[open_[ok]] = mid[ok]
            high[open_[~ok]] = mid[~ok] - 1
            open_ = open_[low[open_] < high[open_]]
        return low


def grid_runs(values: np.ndarray, sizes: np.ndarray, least_power: int, least_length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Runs of several sequences of numbers that stand one after another in `values`: sequence, start, length, period, in this order."""
    none = (np.zeros(0, np.int64),) * 4
    sizes = np.asarray(sizes, np.int64)
    most = np.where(sizes >= least_length, sizes // least_power, 0)
    if not most.sum():
        return none
    # a number of its own before, between and behind the sequences ends every agreement
    first = np.cumsum(sizes + 1) - sizes
    walls = np.ones(len(values) + len(sizes) + 1, bool)
    walls[np.repeat(first, sizes) + np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = False
    v = np.empty(len(walls), np.uint64)
    v[~walls] = values.view(np.uint64) if values.dtype.itemsize == 8 else values.astype(np.uint64)
    v[walls] = np.random.default_rng(seed + 1).integers(0, 2**63, int(walls.sum()), dtype=np.uint64)
    hashes = _Prefixes(v, seed)

    doc = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = np.maximum(least_length, least_power * period) - period
    points = np.where(sizes[doc] >= step + period, (sizes[doc] - period + step - 1) // step, 0)
    ends = np.cumsum(points)
    found = []
    for lo in range(0, int(ends[-1]), CHUNK):
        hi = min(lo + CHUNK, int(ends[-1]))
        a, b = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(ends, hi, "left")) + 1
        before = ends[a:b] - points[a:b]
        n = np.minimum(ends[a:b], hi) - np.maximum(before, lo)
        which = np.repeat(np.arange(a, b), n)
        i = first[doc[which]] + (np.arange(lo, hi) - (ends - points)[which]) * step[which]
        p = period[which]
        j = i + p
        keep = np.flatnonzero(v[i] == v[j])
        i, j, p, which = i[keep], j[keep], p[keep], which[keep]
        keep = np.flatnonzero((v[i + 1] == v[j + 1]) | (v[i - 1] == v[j - 1]) | (step[which] == 1))
        i, j, p, d = i[keep], j[keep], p[keep], doc[which[keep]]
        right = hashes.agree(i, p, first[d] + sizes[d] - j, False)
        left = hashes.agree(i, p, i - first[d], True)
        size = left + right + p
        keep = size >= np.maximum(least_length, least_power * p)
        found.append(np.stack([d, i - left - first[d], size, p])[:, keep])
        if sum(f.shape[1] for f in found) > CHUNK:
            found = [_least_periods(np.concatenate(found, axis=1))]
    return tuple(_least_periods(np.concatenate(found, axis=1)))


def _least_periods(found: np.ndarray) -> np.ndarray:
    """Of equal stretches the one of least period, by sequence, start and length; a start's stretches grow with their periods."""
    found = found[:, np.lexsort((found[3], found[2], found[1], found[0]))]
    new = np.ones(found.shape[1], bool)
    new[1:] = (found[:3, 1:] != found[:3, :-1]).any(0)
    found = found[:, new]
    return found[:, np.lexsort((found[3], found[1], found[0]))]


def _holds(words: list[bytes], start: int, size: int, period: int) -> bool:
    return words[start : start + size - period] == words[start + period : start + size]


def _again(words: list[bytes], least_power: int, least_length: int) -> list[tuple[int, int, int]]:
    """The runs of one document whose hashes deceived: numbers stand for words exactly, bases change until every run holds."""
    ids: dict[bytes, int] = {}
    values = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    for seed in itertools.count(1):
        _, start, size, period = grid_runs(values, np.array([len(words)]), least_power, least_length, seed)
        runs = list(zip(start.tolist(), size.tolist(), period.tolist(), strict=True))
        if all(_holds(words, *r) for r in runs):
            return runs
    raise AssertionError


def runs_of(texts: list[list[bytes]], least_power: int = 4, least_length: int = 6) -> list[list[tuple[int, int, int]]]:
    """Of each list of words its runs (start, length, period), by start, then period."""
    sizes = np.array([len(w) for w in texts], np.int64)
    values = np.fromiter((hash(w) for words in texts for w in words), np.int64, int(sizes.sum()))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for d, *run in zip(*(x.tolist() for x in grid_runs(values, sizes, least_power, least_length, 0)), strict=True):
        out[d].append(tuple(run))
    for d, runs in enumerate(out):
        if runs and not all(_holds(texts[d], *r) for r in runs):
            out[d] = _again(texts[d], least_power, least_length)
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    turns = np.zeros(len(words) + 1, np.int64)
    for start, size, period in runs:
        turns[start + period] += 1
        turns[start + size] -= 1
    keep = np.cumsum(turns[:-1]) == 0
    return b" ".join(itertools.compress(words, keep.tolist()))


@C.tidy
def _search(least_power: int, least_length: int, carry: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.slices(batches):
        data, starts = C.text_bytes(batch.column("text"))
        raw = data.tobytes()
        texts = [raw[a:b].split() for a, b in itertools.pairwise(starts.tolist())]
        found = runs_of(texts, least_power, least_length)
        ends = np.concatenate([[0], np.cumsum([len(r) for r in found])])
        flat = [r for runs in found for r in runs]
        run = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], fields=list(RUN))
        kept = [_collapsed(w, r) for w, r in zip(texts, found, strict=True)]
        cols = [batch.column("doc_id"), pa.array([len(w) for w in texts], pa.int64()), C.lists(run, ends), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.record_batch(cols + ([batch.column("row")] if carry else []), names=["doc_id", "n_words", "runs", "collapsed"] + ["row"] * carry)


def periodic_runs(docs: DataFrame, least_power: int = 4, least_length: int = 6, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, runs array<struct<start, length, period>> by start, then period, and the collapsed text."""
    if least_power < 2 or least_length < 2:
        raise ValueError("a run is at least two periods and two words long")
    df = C.with_text(docs, carry)
    kind = f", row {df.schema['row'].dataType.simpleString()}" if carry else ""
    return df.mapInArrow(functools.partial(_search, least_power, least_length, bool(carry)), f"doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string{kind}")


def longest(runs: Column) -> Column:
    """Of an array of runs the longest, of equally long ones the first, then that of least period: a struct, null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))
