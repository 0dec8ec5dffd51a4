"""Packing token sequences: cutting-stock column generation.

A document's ids are cut into pieces of `size`; the last, shorter one is its
rest. Whole pieces fill a sequence each. Rests are packed:

1. The rests' lengths are counted in classes of `UNIT` ids (a class is as wide
   as its longest member, so at most `size` / `UNIT` of them, however many rows
   there are). Only this histogram reaches the driver.
2. The linear program over patterns (multisets of classes that fit a sequence)
   starts from patterns of one class; patterns of a best-fit packing of the
   histogram are its first further columns. Its dual prices go to a knapsack
   dynamic program, whose best pattern enters the basis, until no pattern's
   price exceeds 1 or the bound shows that less than `GAP` is left to gain.
3. The patterns' uses are rounded down. What is left, a few pieces of each
   class, is packed largest first into the fullest sequence with room. Where
   rounding costs more than the program gained (tables of few documents), the
   best-fit packing stands.
4. Within a class documents are ranked, in two levels (256 buckets, then within
   a bucket), so that no task holds a class. A table of rank ranges, as long as
   there are slots in patterns, says which sequence and slot a rank goes to.

Null texts are empty: one piece with the end id. Repeated rows are packed each
for itself; null ids rank first. Other columns are ignored.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

UNIT = 4
GAP = 5e-4
BUCKETS = 256
ROUNDS = 3000
CACHED = 700_000
#: Characters of a unit of text that is kept.
LONGEST = 128
#: How the vocabulary's own tokenizer splits a text into pieces that are merged separately.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: How byte-level vocabularies spell bytes: printable ones of Latin-1 as they are, the others by characters from U+0100 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELT = dict(zip([*PRINTED, *(b for b in range(256) if b not in PRINTED)], [*PRINTED, *range(256, 512 - len(PRINTED))], strict=True))


class _Pieces(dict):
    """The ids of pieces, each merged by the vocabulary's model when it is first asked for."""

    def __init__(self, merged):
        self.merged = merged

    def __missing__(self, piece: str) -> bytes:
        ids = [t.id for t in self.merged(piece.encode().decode("latin-1").translate(SPELT))]
        self[piece] = made = struct.pack(f"<{len(ids)}I", *ids)
        return made


class _Units(dict):
    """The ids of units of text by those of their pieces. A unit follows a blank that isn't in it, or begins with a line end; other white space at its ends, where its pieces could depend on what is around it, is a KeyError, and so is great length."""

    def __init__(self, by_pieces):
        self.by_pieces = by_pieces

    def __missing__(self, unit: str) -> bytes:
        inner = unit[unit[:1] == "\n" :]
        if not 0 < len(inner) <= LONGEST or inner[0].isspace() or inner[-1].isspace():
            raise KeyError(unit)
        self[unit] = made = self.by_pieces(unit if unit[0] == "\n" else f" {unit}")
        return made


class _Tokens:
    """The ids of texts by a byte-level vocabulary; what was encoded once is kept in a worker, in caches of bounded size.

    Texts are cut before single blanks and line ends that stand between other
    characters: no piece of the vocabulary's pattern spans such a place, so a unit
    (a word with its punctuation) has the same ids everywhere. A text with other
    white space at such a place is split into pieces as a whole.
    """

    def __init__(self, path: str):
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find = regex.compile(SPLIT).findall
        self.pieces = _Pieces(self.tokenizer.model.tokenize)
        self.units = _Units(self._by_pieces)
        self.line_end = len(self.pieces["\n"])

    def _by_pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def _one(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        try:
            return b"".join(map(self.units.__getitem__, _cut(text)))[self.line_end :]
        except KeyError:
            return self._by_pieces(text)

    def of(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids as little-endian 32-bit numbers."""
        for cache, cut in ((self.units, _cut), (self.pieces, self.find)):
            if len(cache) > CACHED:  # what these texts need stays
                kept = {w: cache[w] for w in set().union(*map(cut, texts)) if w in cache}
                cache.clear()
                cache.update(kept)
        return [self._one(t) for t in texts]


def _cut(text: str) -> list[str]:
    """A text's units; a line end is put in front, so that the first is like others."""
    return f"\n{text}".replace("\n", " \n").split(" ")[1:]


@functools.cache
def _tokens(path: str) -> _Tokens:
    return _Tokens(path)


@C.tidy
def _pieces(path: str, end_id: int, size: int, with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens, end = _tokens(path), np.array([end_id], "<u4").tobytes()
    for batch in C.slices(batches, limit=3 << 20):  # larger slices, fewer words seen anew
        rows: list[tuple] = []
        for doc, ids in zip(batch.column("doc_id").to_pylist(), tokens.of(batch.column("text").to_pylist()), strict=True):
            ids += end
            total = len(ids) // 4
            for at in range(0, total, size):
                piece = ids[4 * at : 4 * (at + size)]
                rows.append((doc, at, len(piece) // 4, zlib.crc32(piece), total, *([piece] if with_ids else [])))
        kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def token_pieces(docs: DataFrame, path: str, end_id: int = 1, size: int = 2048, with_ids: bool = False) -> DataFrame:
    """Each document's ids, then end_id, cut into pieces of `size`: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids (little-endian 32-bit)."""
    return C.with_text(docs).mapInArrow(functools.partial(_pieces, path, end_id, size, with_ids), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def _knapsack(price: np.ndarray, width: np.ndarray, room: int) -> tuple[float, dict[int, int]]:
    """The multiset of items of greatest price that fits, each as often as one likes."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(width)
    price, wide = price[order], width[order]
    fit = np.searchsorted(wide, np.arange(room + 1), "right")
    for w in range(1, room + 1):
        best[w] = best[w - 1]
        if fit[w]:
            value = best[w - wide[: fit[w]]] + price[: fit[w]]
            k = int(value.argmax())
            if value[k] > best[w]:
                best[w], took[w] = value[k], k
    pattern: dict[int, int] = {}
    w = room
    while w > 0:
        if took[w] < 0:
            w -= 1
        else:
            pattern[int(order[took[w]])] = pattern.get(int(order[took[w]]), 0) + 1
            w -= int(wide[took[w]])
    return float(best[room]), pattern


def best_fit(width: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[int, list[int]]]:
    """Largest first, each into the fullest sequence with room: patterns and how often each is used. Equal items go together, so the work depends on the classes alone."""
    groups: dict[int, list[tuple[int, list[int]]]] = {}  # by room that is left
    for i in np.argsort(-width, kind="stable").tolist():
        w, left = int(width[i]), int(demand[i])
        while left:
            at = next((r for r in range(w, room) if groups.get(r)), room)
            n, items = groups[at].pop() if at < room else (left, [])
            per = at // w
            whole, rest = min(n, left // per), 0
            if whole < n and left % per:
                rest = left % per if whole == left // per else 0
            for count, k in ((whole, per), (1 if rest else 0, rest)):
                if count:
                    groups.setdefault(at - k * w, []).append((count, items + [i] * k))
            spare = n - whole - bool(rest)
            if spare and at < room:
                groups.setdefault(at, []).append((spare, items))
            left -= whole * per + rest
    return [x for found in groups.values() for x in found]


def cutting_patterns(width: np.ndarray, demand: np.ndarray, room: int, rounds: int = ROUNDS) -> list[tuple[int, list[int]]]:
    """Patterns (as lists of item indices) with the number of times each is used; together they meet the demand exactly."""
    m = len(width)
    if not m:
        return []
    left = demand.astype(np.int64).copy()
    plan: list[tuple[int, list[int]]] = []
    known = best_fit(width, demand, room)  # columns to begin with
    pool = np.stack([np.bincount(items, minlength=m) for _, items in known]).astype(float)
    patterns = [np.eye(m)[i] * (room // width[i]) for i in range(m)]
    inverse = np.diag(1.0 / (room // width))
    use = inverse @ demand
    for _ in range(rounds):
        price = inverse.sum(0)
        values = pool @ price
        column = pool[int(values.argmax())]
        if values.max() <= 1 + 1e-7:
            value, pattern = _knapsack(price, width, room)
            if value <= 1 + 1e-7 or use.sum() - (price @ demand) / value <= GAP * use.sum():
                break
            column = np.zeros(m)
            for i, k in pattern.items():
                column[i] = k
        way = inverse @ column
        ratio = np.where(way > 1e-9, use / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        use -= way * step
        use[out] = step
        inverse[out] /= way[out]
        others = np.flatnonzero(np.abs(way) > 1e-12)
        others = others[others != out]
        inverse[others] -= np.outer(way[others], inverse[out])
        patterns[out] = column
    for k in np.argsort(-use, kind="stable"):
        column = patterns[k].astype(np.int64)
        has = column > 0
        n = min(int(np.floor(use[k] + 1e-7)), int((left[has] // column[has]).min()))
        if n > 0:
            plan.append((n, [i for i in np.flatnonzero(has).tolist() for _ in range(int(column[i]))]))
            left -= n * column
    plan += best_fit(width, left, room)
    return plan if sum(n for n, _ in plan) <= sum(n for n, _ in known) else known


@C.tidy
def _assign(plan: dict[int, tuple[np.ndarray, ...]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kind, rank = (batch.column(x).to_numpy() for x in ("kind", "rank"))
        sequence, slot = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int32)
        for k in np.unique(kind):
            rows = kind == k
            first, base, slots = plan[int(k)]
            at = np.searchsorted(first, rank[rows], "right") - 1
            sequence[rows], slot[rows] = base[at] + rank[rows] - first[at], slots[at]
        keep = [i for i, n in enumerate(batch.schema.names) if n not in ("kind", "rank")]
        yield pa.record_batch([*(batch.column(i) for i in keep), pa.array(sequence), pa.array(slot)], names=[*(batch.schema.names[i] for i in keep), "sequence_id", "slot"])


def pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length and what else they have); no sequence holds more than `size` ids."""
    pieces = C.stage(
        pieces.withColumn("kind", F.when(F.col("length") == size, F.lit(0)).otherwise(F.ceil(F.col("length") / UNIT)).cast("int")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(BUCKETS)).cast("int")),
        "pieces",
    )
    counts = pieces.groupBy("kind", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("kind").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("before", F.coalesce(before, F.lit(0)))
    totals = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("count").alias("n")).collect()}

    kinds = np.array(sorted(k for k in totals if k), np.int64)
    plan = cutting_patterns(kinds, np.array([totals[k] for k in kinds.tolist()], np.int64), size // UNIT)
    ranges: dict[int, list[tuple[int, int, int]]] = {0: [(0, 0, 0)]}
    base, given = totals.get(0, 0), dict.fromkeys(totals, 0)
    for n, items in plan:
        for slot, i in enumerate(items):
            k = int(kinds[i])
            ranges.setdefault(k, []).append((given[k], base, slot))
            given[k] += n
        base += n
    arrays = {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in ranges.items()}

    within = F.row_number().over(Window.partitionBy("kind", "bucket").orderBy("doc_id", "start", "ids_crc32"))
    ranked = pieces.withColumn("within", within).join(counts.drop("count"), ["kind", "bucket"]).withColumn("rank", F.col("before") + F.col("within") - 1).drop("before", "within", "bucket")
    others = [c for c in ranked.columns if c not in ("kind", "rank")]
    kept = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in others)
    placed = ranked.select(*others, "kind", "rank").mapInArrow(functools.partial(_assign, arrays), f"{kept}, sequence_id long, slot int")
    earlier = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("offset", F.coalesce(earlier, F.lit(0)).cast("long")).drop("slot")
