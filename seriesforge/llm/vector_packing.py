"""Packing whole documents into sequences: vector best-fit under several capacities.

Only documents longer than a sequence are cut, into pieces of `size` ids, so
every other document stays in one piece. A sequence has three capacities: its
ids, its number of documents, and its cost of attention (the sum of the squared
lengths of its pieces). A piece is a vector of what it takes of each.

1. A piece's vector follows from its length, so a histogram of lengths (at most
   `size` numbers, however many rows there are) is all that reaches the driver.
2. Lengths are placed largest first. Of the open sequences that have room in
   every dimension, a piece goes to the one that best fits: by residual norm,
   the one whose weighted squared residual is least afterwards; by dot product,
   the one whose residual has the greatest weighted product with the piece.
   Weights are each dimension's share of demand, or given. Sequences with equal
   content are one group with a count, so the work depends on the lengths and not
   on the rows. If no rule is named, that with the fewest sequences is taken.
3. Each task numbers its rests within their lengths. Running counts of the tasks
   turn that into ranks without a sort; a table of rank ranges says which sequence
   and which place there a rank has. Full pieces have a sequence each.

Null texts are empty: one piece with the end id. Rows that repeat a doc_id, null
ids included, are packed each for itself. A text of any length is read in parts
cut at white space and gives its pieces one by one. Equal lengths are
interchangeable, so ties follow the tasks' order. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

CACHED = 400_000
#: Characters of a text that are split at once.
PART = 1 << 20
#: White space, letters and digits up to U+00FF after lower-casing, as the vocabulary's pattern splits them.
SPACE, LETTER, DIGIT = "\t-\r \x85\xa0", "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
LATIN = re.compile(f"[{LETTER}]+|[{DIGIT}]|'(?:s|t|re|ve|m|ll|d)|[^{SPACE}{LETTER}{DIGIT}]+")
ANY = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordTokens:
    """Ids by a vocabulary with word ends that drops white space; each distinct piece is encoded once in a worker, in a cache of bounded size."""

    def __init__(self, path: str):
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split_any = regex.compile(ANY).findall
        with open(path) as f:
            bare = json.load(f)
        bare |= {"normalizer": None, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(bare))  # for pieces of texts that are normal already
        end = bare["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in bare["model"]["vocab"].items() if t.endswith(end)]] = True
        self.cache: dict[str, bytes] = {}

    def _pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_any(self.tokenizer.normalizer.normalize_str(text))
        return LATIN.findall(text.lower())  # composed as they are

    def _learn(self, words: list[str]) -> None:
        """Encodes pieces together, a line each: the last token of a piece, and no other, is one that ends words."""
        ids = np.array(self.bare.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(cuts) != len(words) or cuts[-1] != 4 * len(ids):  # a piece that reads differently between others
            found = self.bare.encode(words, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            cuts = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(1, len(words) + 1)) * 4
        raw, ends = ids.tobytes(), [0, *cuts.tolist()]
        self.cache.update((w, raw[a:b]) for w, a, b in zip(words, ends[:-1], ends[1:], strict=True))

    def of(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids as little-endian 32-bit numbers."""
        odd = [any(s in t for s in self.special) for t in texts]
        found = [[] if o else self._pieces(t) for t, o in zip(texts, odd, strict=True)]
        words = set().union(*found)
        todo = list(words.difference(self.cache))
        if len(self.cache) + len(todo) > CACHED:  # what these texts need stays
            self.cache = {w: self.cache[w] for w in words if w in self.cache}
        for lo in range(0, len(todo), 5_000):
            self._learn(todo[lo : lo + 5_000])
        get = self.cache.__getitem__
        whole = lambda t: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        return [whole(t) if o else b"".join(map(get, ws)) for t, o, ws in zip(texts, odd, found, strict=True)]

    def parts(self, text: str) -> Iterator[bytes]:
        """The ids of a long text, part by part; parts end before a blank, which no piece and no special token holds."""
        at = 0
        while at < len(text):
            end = text.find(" ", at + PART)
            end = len(text) if end < 0 else end
            yield self.of([text[at:end]])[0]
            at = end


@functools.cache
def _tokens(path: str) -> WordTokens:
    return WordTokens(path)


def _cut(parts: Iterator[bytes], size: int) -> Iterator[bytes]:
    """Full pieces and what is left at the end."""
    held = b""
    for part in parts:
        held += part
        whole = len(held) // (4 * size)
        for k in range(whole):
            yield held[4 * k * size : 4 * (k + 1) * size]
        held = held[4 * whole * size :]
    if held:
        yield held


@C.tidy
def _pieces(path: str, end_id: int, size: int, with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens, end = _tokens(path), np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32()] + [pa.int64()] * 3 + [pa.binary()] * with_ids
    for batch in C.slices(batches, limit=3 << 20):
        texts = batch.column("text").to_pylist()
        short = tokens.of([t if len(t) <= PART else "" for t in texts])
        rows: list[tuple] = []
        for doc, text, ids in zip(batch.column("doc_id").to_pylist(), texts, short, strict=True):
            parts = iter([ids + end]) if len(text) <= PART else (p for source in (tokens.parts(text), (end,)) for p in source)
            for k, piece in enumerate(_cut(parts, size)):
                rows.append((doc, k, k * size, len(piece) // 4, zlib.crc32(piece), *([piece] if with_ids else [])))
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def whole_pieces(docs: DataFrame, path: str, end_id: int = 1, size: int = 4096, with_ids: bool = False) -> DataFrame:
    """Each document's ids, then end_id; only longer ones are cut, into pieces of `size`: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian 32-bit)."""
    return C.with_text(docs).mapInArrow(functools.partial(_pieces, path, end_id, size, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def vector_best_fit(
    length: np.ndarray, demand: np.ndarray, capacity: tuple[int, int, int], rule: str = "norm", weights: tuple[float, float, float] | None = None
) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns: how many sequences hold what, as (index of a length, times). capacity: ids, documents, cost of attention.

    Lengths go largest first. A group of equal sequences takes pieces as long as
    it is the best fit: by norm, a sequence that got a piece fits better than
    before and is filled on; by dot product, it fits worse, and the next of its
    group follows.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"no such rule: {rule}")
    length, demand = np.asarray(length, np.int64), np.asarray(demand, np.int64)
    room = np.array(capacity, np.int64)
    takes = np.stack([length, np.ones_like(length), length * length], axis=1)
    if (takes > room).any():
        raise ValueError("a piece exceeds a sequence's capacity")
    share = (takes * demand[:, None]).sum(0) / room if weights is None else np.array(weights, float)
    weight = share / max(share.sum(), 1e-300) / room.astype(float) ** 2
    left = np.zeros((0, 3), np.int64)  # residual of each group
    count = np.zeros(0, np.int64)
    items: list[list[tuple[int, int]]] = []
    done: list[tuple[int, list[tuple[int, int]]]] = []

    def add(residual: np.ndarray, n: int, what: list[tuple[int, int]]) -> None:
        nonlocal left, count
        if n:
            left, count = np.concatenate([left, residual[None]]), np.append(count, n)
            items.append(what)

    order = np.argsort(-length, kind="stable").tolist()
    for place, k in enumerate(order):
        need, todo = takes[k], int(demand[k])
        while todo:
            fits = np.flatnonzero((left >= need).all(1) & (count > 0))
            if not len(fits):
                per = int((room // need).min())
                add(room - need * per, todo // per, [(k, per)])
                add(room - need * (todo % per), 1 if todo % per else 0, [(k, todo % per)])
                break
            after = left[fits] - need
            score = (weight * after * after).sum(1) if rule == "norm" else -(weight * need * left[fits]).sum(1)
            best = int(fits[score.argmin()])
            per = int((left[best] // need).min()) if rule == "norm" else 1
            n, held, what = int(count[best]), left[best].copy(), items[best]
            filled = min(n, todo // per)
            rest = todo - filled * per if filled < n else 0
            rest = min(rest, per - 1) if filled < n else 0
            count[best] = 0
            add(held - need * per, filled, what + [(k, per)])
            add(held - need * rest, 1 if rest else 0, what + [(k, rest)])
            add(held, n - filled - (1 if rest else 0), what)
            todo -= filled * per + rest
        # sequences that have no room for the shortest piece still to come are done
        if place % 16 == 15 or place == len(order) - 1:
            coming = takes[order[place + 1 :]].min(0) if place + 1 < len(order) else room + 1
            closed = (left < coming).any(1)
            done += [(int(count[g]), items[g]) for g in np.flatnonzero(closed & (count > 0)).tolist()]
            keep = np.flatnonzero(~closed & (count > 0))
            left, count, items = left[keep], count[keep], [items[g] for g in keep.tolist()]
    return done


def plan_sequences(length: np.ndarray, demand: np.ndarray, capacity: tuple[int, int, int], rule: str | None = None, weights: tuple[float, float, float] | None = None) -> list[tuple[int, list[tuple[int, int]]]]:
    """The plan of this rule, or of the rule and weights (by demand, and by ids alone) that need the fewest sequences."""
    if not len(length):
        return []
    ways = [(rule, weights)] if rule else [("norm", weights), ("norm", (1.0, 0.0, 0.0)), ("dot", weights)]
    plans = [vector_best_fit(length, demand, capacity, r, w) for r, w in ways]
    return min(plans, key=lambda plan: sum(n for n, _ in plan))


@C.tidy
def _number(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and, within it, a running number of each length."""
    task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
    for batch in batches:
        length = batch.column("length").to_numpy()
        order = np.argsort(length, kind="stable")
        ordered = length[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
        runs = np.diff(np.append(first, len(ordered)))
        nth = np.empty(len(length), np.int64)
        nth[order] = np.arange(len(ordered)) - np.repeat(first, runs) + seen[ordered]
        seen += np.bincount(length, minlength=size + 1)
        yield pa.record_batch([*batch.columns, pa.array(np.full(len(length), task, np.int32)), pa.array(nth)], names=[*batch.schema.names, "task", "nth"])


@C.tidy
def _assign(ranges: dict[int, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length).tolist():
            rows = np.flatnonzero(length == n)
            first, base, per, at = ranges[n]
            k = np.searchsorted(first, rank[rows], "right") - 1
            x = rank[rows] - first[k]
            sequence[rows], offset[rows] = base[k] + x // per[k], at[k] + x % per[k] * n
        keep = [i for i, name in enumerate(batch.schema.names) if name != "rank"]
        yield pa.record_batch([*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)], names=[*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])


def pack_best_fit(
    pieces: DataFrame, size: int = 4096, documents: int | None = None, attention: int | None = None, rule: str | None = None, weights: tuple[float, float, float] | None = None
) -> DataFrame:
    """Adds sequence_id and offset to pieces (length and what else they have) so that no sequence exceeds a capacity.

    documents and attention (a sum of squared lengths) are as large as the ids
    allow if not given. rule: "norm", "dot", or the better of them.
    """
    capacity = (size, documents or size, attention or size * size)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    pieces = C.stage(pieces.mapInArrow(functools.partial(_number, size), f"{kinds}, task int, nth long"), "pieces")
    names = [c for c in pieces.columns if c not in ("task", "nth")]
    alone = size * size <= capacity[2]  # a full piece leaves no ids for others
    full = F.col("length") == size if alone else F.lit(False)
    rests = pieces.where(~full)
    counts = rests.groupBy("length", "task").agg(F.count("*").alias("n"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}

    length = np.array(sorted(totals), np.int64)
    plan = plan_sequences(length, np.array([totals[n] for n in length.tolist()], np.int64), capacity, rule, weights)
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    base, given = 0, [0] * len(length)
    for n, what in plan:
        at = 0
        for k, per in what:
            ranges.setdefault(int(length[k]), []).append((given[k], base, per, at))
            given[k] += n * per
            at += int(length[k]) * per
        base += n
    arrays = {n: np.array(r, np.int64).T for n, r in ranges.items()}

    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("length", "task", F.coalesce(earlier, F.lit(0)).alias("before"))
    ranked = rests.join(before, ["length", "task"]).select(*names, (F.col("before") + F.col("nth")).alias("rank"))
    placed = ranked.mapInArrow(functools.partial(_assign, arrays), f"{kinds}, sequence_id long, offset long")
    # any numbers that no other sequence has: below zero, by task and running number
    own = pieces.where(full).select(*names, (-1 - F.shiftleft(F.col("task").cast("long"), 36) - F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(own)
