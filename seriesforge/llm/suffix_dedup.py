"""Removal of repeated passages: prefix-free parsing and suffix order.

A byte goes if it lies in a string of `length` bytes that also starts earlier
in the corpus, where places are ordered by (doc_id, byte offset).

1. Parse. A rolling hash over K bytes runs along each text. Its minimum in the
   K-grams of each window of `length` bytes is that window's trigger, so equal
   windows have equal triggers at equal distances, wherever they stand. The
   consecutive windows that share one trigger form a phrase; the phrases of a
   text are its parse, and overlap by `length` - 1 bytes.
2. Dictionary. Phrases are shuffled by their trigger's hash and sorted by
   (trigger, phrase, place). Of equal phrases only the first place goes into
   the dictionary; every window of the others is a repeat.
3. Suffix array of the dictionary. A trigger that several distinct phrases share
   marks the edge of a repeated passage. Only these phrases' bytes are fetched.
   The suffixes of a trigger's phrases are ranked by prefix doubling (8, 16,
   32 ... bytes), up to `length` bytes since what follows cannot matter. Equal
   suffixes are put in corpus order by the parse, that is by the places of
   their phrases; all but the first are repeats. As phrases overlap by
   `length` - 1 bytes, each string of `length` bytes lies in one phrase, so two
   suffixes never tie beyond a phrase's end and the parse needs no suffix array
   of its own to break such ties.
4. The runs of repeated windows of a document are merged and cut from it.

Phrases are compared by two 64-bit hashes (of trigger and content), windows in
step 3 by their ranks, that is byte by byte. A task reports a phrase that it
has seen before at an earlier place (in a table of SEEN phrases) as a repeat
before the shuffle, so a passage that many documents share sends a few rows
from each task. A trigger with more than GROUP distinct phrases is dealt out by
window; its windows are sorted by Spark and compared as a stream, so no group
is held in memory.

Nulls and ties: a null text is empty, and texts may be of any length. Rows with a null doc_id take no part:
nothing is cut from them, and they make no other passage a repeat. Rows that
repeat a doc_id are one document: equal rows give equal results, and different
texts under one id share their cuts. Other columns are ignored, or kept in the
struct `row` if named in `carry`.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

K = 36
BASE = 0x9E3779B97F4A7C15
#: Distinct phrases of one trigger that are sorted together; beyond it they are dealt out by window.
GROUP = 8_000
#: Phrases that a task remembers, with their first places.
SEEN = 1 << 17
#: So many large triggers are sent to all tasks, at 12 bytes each; more are joined.
SENT = 200_000
#: Windows that are sorted at once in a task.
SORTED = 150_000


@functools.cache
def _bytes_table() -> np.ndarray:
    return C.table_of_words(7)


def _joined(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """Hashes of n + m bytes from hashes of n bytes and of the m bytes after them."""
    size = max(0, min(len(a), len(b) - n))
    return a[:size] * C.power(BASE, m) + b[n : n + size]


def rolling(data: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each size, the hash of the `size` bytes from each offset on."""
    doubled = {1: _bytes_table()[data]}
    while 2 * max(doubled) <= max(sizes):
        n = max(doubled)
        doubled[2 * n] = _joined(doubled[n], n, doubled[n], n)
    out = []
    for size in sizes:
        whole, done = None, 0
        for n in sorted(doubled, reverse=True):
            if size - done >= n:
                whole, done = (doubled[n], n) if whole is None else (_joined(whole, done, doubled[n], n), done + n)
        out.append(whole)
    return out


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        keys = np.minimum(keys[:-n], keys[n:]) if len(keys) > n else keys[:0]
        n *= 2
    rest = width - n
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest and len(keys) > rest else keys if not rest else keys[:0]


def phrases(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of each phrase: its document's row, first and last window, trigger hash and content hash."""
    k = min(K, max(1, length // 2))
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams, windows = rolling(data, (k, length))
    grams = C.mix(grams)
    low = np.uint64(0xFFFFFFFF)
    least = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - k + 1)[: len(windows)]
    trigger = (least & low).astype(np.int64)
    sizes = np.diff(starts)
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(windows)]
    inside = np.arange(len(windows)) + length <= starts[1:][row]
    edge = np.ones(len(windows), bool)
    edge[1:] = (trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(edge & inside)
    bounds = np.append(np.flatnonzero(edge | ~inside), len(windows))
    last = bounds[np.searchsorted(bounds, first, "right")] - 1
    content = C.mix(windows[first] * np.uint64(0x2545F4914F6CDD1D) + C.mix(windows[last]) + (last - first).astype(np.uint64))
    return row[first], first, last, grams[trigger[first]], content


def _runs(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins neighbouring window ranges of a document; they come in order."""
    if not len(row):
        return row, first, last
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (first[1:] > last[:-1] + 1)
    at = np.flatnonzero(new)
    return row[at], first[at], np.maximum.reduceat(last, at)


PARSED = pa.schema([("trigger", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("repeat", pa.bool_())])


class _Seen:
    """First places of phrases that a task met, by a hash of trigger and content; the oldest go when there are more than SEEN."""

    def __init__(self):
        self.key, self.doc, self.lo, self.age = (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
        self.now = 0

    def earlier(self, key: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Of distinct phrases (and their places in this slice) those known from an earlier place; the places are remembered."""
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        known = self.key[at] == key if len(self.key) else np.zeros(len(key), bool)
        d, x = (self.doc[at], self.lo[at]) if len(self.key) else (doc, lo)
        before = known & ((d < doc) | (d == doc) & (x < lo))
        first = known & ((doc < d) | (doc == d) & (lo < x))
        self.doc[at[first]], self.lo[at[first]], self.age[at[known]] = doc[first], lo[first], self.now
        parts = [np.concatenate(c) for c in zip((self.key, self.doc, self.lo, self.age), (key[~known], doc[~known], lo[~known], np.full(int((~known).sum()), self.now)), strict=True)]
        self.now += 1
        if len(parts[0]) > SEEN:
            young = np.argsort(-parts[3], kind="stable")[: SEEN // 2]
            parts = [p[young] for p in parts]
        order = np.argsort(parts[0], kind="stable")
        self.key, self.doc, self.lo, self.age = (p[order] for p in parts)
        return before


@C.tidy
def _parse(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = _Seen()
    for batch in C.slices(batches):
        if batch.column("doc_id").null_count:
            batch = batch.filter(batch.column("doc_id").is_valid())
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        data, starts = C.text_bytes(batch.column("text"))
        row, first, last, trigger, content = phrases(data, starts, length)
        order = np.lexsort((first - starts[row], ids[row], content, trigger))
        t, c = trigger[order], content[order]
        again = np.zeros(len(order), bool)
        again[1:] = (t[1:] == t[:-1]) & (c[1:] == c[:-1])
        # the same place of a repeated row is no earlier place
        r, f = row[order], first[order]
        same = np.zeros(len(order), bool)
        same[1:] = again[1:] & (ids[r[1:]] == ids[r[:-1]]) & (f[1:] - starts[r[1:]] == f[:-1] - starts[r[:-1]])
        repeat, copy = np.zeros(len(order), bool), np.zeros(len(order), bool)
        repeat[order], copy[order] = again, same
        fresh = np.flatnonzero(~repeat & ~copy)
        repeat[fresh] = seen.earlier(C.mix(trigger[fresh] * np.uint64(0x2545F4914F6CDD1D) + content[fresh]), ids[row[fresh]], first[fresh] - starts[row[fresh]])
        keep = ~repeat & ~copy
        gone = np.flatnonzero(repeat & ~copy)
        r, f, e = _runs(row[gone], first[gone], last[gone])
        key = C.mix(ids[r].astype(np.uint64) * np.uint64(31) + f.astype(np.uint64))
        yield pa.record_batch(
            [
                pa.array(np.concatenate([trigger[keep], key]).view(np.int64)),
                pa.array(np.concatenate([content[keep], key]).view(np.int64)),
                pa.array(np.concatenate([ids[row[keep]], ids[r]])),
                pa.array(np.concatenate([first[keep] - starts[row[keep]], f - starts[r]]).astype(np.int32)),
                pa.array(np.concatenate([last[keep] - first[keep], e - f]).astype(np.int32) + 1),
                pa.array(np.concatenate([np.zeros(int(keep.sum()), bool), np.ones(len(r), bool)])),
            ],
            schema=PARSED,
        )


FOUND = pa.schema([("doc_id", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("trigger", pa.int64())])


@C.tidy
def _dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (trigger, content, place), seen one batch after the other: repeats, and dictionary phrases that share a trigger."""
    held = None  # the first phrase of the trigger at hand, until a second one shows that it is shared
    last = (None, None, None, None)
    for batch in batches:
        t, c, d, lo, n, repeat = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        if not len(t):
            continue
        out = [(d[repeat], lo[repeat], n[repeat], None)]
        t, c, d, lo, n = t[~repeat], c[~repeat], d[~repeat], lo[~repeat], n[~repeat]
        if len(t):
            new_t, new_c, same = np.ones(len(t), bool), np.ones(len(t), bool), np.zeros(len(t), bool)
            new_t[1:] = t[1:] != t[:-1]
            new_c[1:] = new_t[1:] | (c[1:] != c[:-1])
            same[1:] = ~new_c[1:] & (d[1:] == d[:-1]) & (lo[1:] == lo[:-1])
            new_t[0] = t[0] != last[0]
            new_c[0] = new_t[0] or c[0] != last[1]
            same[0] = not new_c[0] and d[0] == last[2] and lo[0] == last[3]
            last = (t[-1], c[-1], d[-1], lo[-1])
            dup = ~new_c & ~same
            out.append((d[dup], lo[dup], n[dup], None))
            at = np.flatnonzero(new_c)
            if len(at):
                head = new_t[at]  # the first phrase of its trigger
                shared = ~head
                shared[:-1] |= head[:-1] & ~head[1:]
                if not head[0] and held is not None:
                    out.append(tuple(np.array([x]) for x in held))
                    held = None
                if head[-1]:
                    held = (d[at[-1]], lo[at[-1]], n[at[-1]], t[at[-1]])
                elif head.any():
                    held = None
                at = at[shared]
                out.append((d[at], lo[at], n[at], t[at]))
        for d, lo, n, t in out:
            if len(d):
                yield pa.record_batch([pa.array(d), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.nulls(len(d), pa.int64()) if t is None else pa.array(t)], schema=FOUND)


FETCHED = pa.schema([("alone", pa.bool_()), ("trigger", pa.int64()), ("salt", pa.int32()), ("doc_id", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("phrase", pa.binary())])


@C.tidy
def _fetch(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the phrases that a document has in the dictionary; of triggers that are dealt out, those of each window alone.

    Such windows that the task has sent from an earlier place are repeats; they go as runs without their bytes.
    """
    rows: list[tuple] = []
    sent: dict[bytes, tuple[int, int]] = {}
    size = 0

    def made() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FETCHED.types, strict=True)], schema=FETCHED)

    for batch in batches:
        wanted = batch.column("wanted").to_pylist()
        for doc, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), wanted, strict=True):
            raw = text.as_buffer().to_pybytes()
            for s in spans:
                whole = raw[s["lo"] : s["lo"] + s["n"] + length - 1]
                if len(whole) < length:
                    continue
                if not s["split"]:
                    rows.append((False, s["trigger"], 0, doc, s["lo"], s["n"], whole))
                    size += len(whole)
                    continue
                run = 0
                for i in range(len(whole) - length + 1):
                    w, place = whole[i : i + length], (doc, s["lo"] + i)
                    if sent.get(w, place) < place:
                        run += 1
                        continue
                    if len(sent) >= SEEN // 2:
                        sent.clear()
                    sent[w] = place
                    if run:
                        rows.append((True, s["trigger"], (31 * doc + s["lo"] + i) & 0x7FFFFFFF, doc, s["lo"] + i - run, run, b""))
                        run = 0
                    salt = int.from_bytes(hashlib.blake2b(w, digest_size=4).digest(), "little") & 0x7FFFFFFF
                    rows.append((True, s["trigger"], salt, *place, 1, w))
                    size += length
                    if size > 4 << 20:
                        yield made()
                        rows, size = [], 0
                if run:
                    at = s["lo"] + len(whole) - length + 1 - run
                    rows.append((True, s["trigger"], (31 * doc + at) & 0x7FFFFFFF, doc, at, run, b""))
                    size += 40
            if size > 4 << 20:
                yield made()
                rows, size = [], 0
    if rows:
        yield made()


SPANS = pa.schema([("doc_id", pa.int64()), ("lo", pa.int32()), ("n", pa.int32())])


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Of each place the rank of the `length` bytes from there on, equal for equal ones: a suffix array by prefix doubling, cut at `length`."""
    rank, n = data.astype(np.int64), 1
    if length >= 8 and len(data) >= 8:  # eight bytes are one number
        words = np.zeros(len(data) - 7, np.uint64)
        for i in range(8):
            words = (words << np.uint64(8)) | data[i : i + len(words)]
        rank, n = np.unique(words, return_inverse=True)[1], 8
    joined = lambda a, b: np.unique(a * (np.int64(b.max()) + 1) + b, return_inverse=True)[1]
    while 2 * n <= length and len(rank) > n:
        rank, n = joined(rank[: len(rank) - n], rank[n:]), 2 * n
    rest = length - n
    return joined(rank[: len(rank) - rest], rank[rest:]) if rest and len(rank) > rest else rank


def _suffix_order(length: int, held: pa.Table) -> pa.RecordBatch:
    """The windows of these phrases by rank, then corpus order; all but the first of equal ones are repeats."""
    held = held.combine_chunks()
    data, starts = C.text_bytes(held.column("phrase").combine_chunks() if isinstance(held.column("phrase"), pa.ChunkedArray) else held.column("phrase"))
    ids, lo = held.column("doc_id").to_numpy(), held.column("lo").to_numpy()
    n = np.diff(starts) - length + 1
    row = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    rank = suffix_ranks(data, length)[starts[row] + within]
    doc, place = ids[row], lo[row] + within
    order = np.lexsort((place, doc, rank))
    again = np.zeros(len(order), bool)
    again[1:] = rank[order][1:] == rank[order][:-1]
    same = np.zeros(len(order), bool)
    same[1:] = again[1:] & (doc[order][1:] == doc[order][:-1]) & (place[order][1:] == place[order][:-1])
    repeat = np.zeros(len(order), bool)
    repeat[order] = again & ~same
    hit = np.flatnonzero(repeat)
    r, f, e = _runs(row[hit], place[hit], place[hit])
    return pa.record_batch([pa.array(ids[r]), pa.array(f.astype(np.int32)), pa.array((e - f + 1).astype(np.int32))], schema=SPANS)


def _stream(length: int, batch: pa.RecordBatch, last: tuple | None) -> tuple[pa.RecordBatch, tuple | None]:
    """Windows alone, sorted by (trigger, salt, bytes, place): those equal to the one before are repeats, as are runs without bytes; the last window is handed on."""
    t, salt, doc, lo, n = (batch.column(c).to_numpy() for c in ("trigger", "salt", "doc_id", "lo", "n"))
    data, starts = C.text_bytes(batch.column("phrase"))
    window = np.diff(starts) > 0
    out = pa.record_batch([pa.array(doc[~window]), pa.array(lo[~window]), pa.array(n[~window])], schema=SPANS)
    if not window.any():
        return out, last
    t, salt, doc, lo, data = t[window], salt[window], doc[window], lo[window], data.reshape(-1, length)
    again, same = np.zeros(len(t), bool), np.zeros(len(t), bool)
    again[1:] = (t[1:] == t[:-1]) & (salt[1:] == salt[:-1]) & (data[1:] == data[:-1]).all(1)
    same[1:] = again[1:] & (doc[1:] == doc[:-1]) & (lo[1:] == lo[:-1])
    if last:
        again[0] = last[:3] == (int(t[0]), int(salt[0]), data[0].tobytes())
        same[0] = again[0] and last[3:] == (int(doc[0]), int(lo[0]))
    hit = again & ~same
    out = pa.Table.from_batches([out, pa.record_batch([pa.array(doc[hit]), pa.array(lo[hit]), pa.array(np.ones(int(hit.sum()), np.int32))], schema=SPANS)]).combine_chunks().to_batches()
    return out[0] if out else pa.RecordBatch.from_pylist([], schema=SPANS), (int(t[-1]), int(salt[-1]), data[-1].tobytes(), int(doc[-1]), int(lo[-1]))


@C.tidy
def _sorted_groups(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (alone, trigger, salt, phrase, place): whole groups are ranked together, many small ones at once; windows alone are a stream."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for whole in batches:
        if whole.num_rows == 0:
            continue
        n_groups = whole.num_rows - int(whole.column("alone").to_numpy(zero_copy_only=False).sum())
        if n_groups < whole.num_rows:
            if held and not n_groups:
                yield _suffix_order(length, pa.Table.from_batches(held))
                held, size = [], 0
            found, last = _stream(length, whole.slice(n_groups), last)
            yield found
        batch, lo = whole.slice(0, n_groups), 0
        if not n_groups:
            continue
        key = batch.column("trigger").to_numpy()
        _, starts = C.text_bytes(batch.column("phrase"))
        new = np.flatnonzero(key[1:] != key[:-1]) + 1
        if held and held[-1].column("trigger")[held[-1].num_rows - 1].as_py() != int(key[0]):
            new = np.concatenate([[0], new])
        for cut in new:
            size_now = size + int(starts[cut] - starts[lo]) - (cut - lo) * (length - 1)
            if size_now >= SORTED:
                if cut > lo:
                    held.append(batch.slice(lo, cut - lo))
                if held:
                    yield _suffix_order(length, pa.Table.from_batches(held))
                held, size, lo = [], 0, int(cut)
        held.append(batch.slice(lo))
        size += int(starts[-1] - starts[lo]) - (batch.num_rows - lo) * (length - 1)
    if held:
        yield _suffix_order(length, pa.Table.from_batches(held))


@C.tidy
def _cut(length: int, carried: bool, as_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    names = ["doc_id", "n_bytes", "kept", "removed"] + (["row"] if carried else [])
    for batch in C.slices(batches):
        data, starts = C.text_bytes(batch.column("text"))
        spans = batch.column("spans")
        counts = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = spans.flatten()
        row = np.repeat(np.arange(batch.num_rows), counts)
        lo = starts[row] + flat.field("lo").to_numpy(zero_copy_only=False).astype(np.int64)
        hi = np.minimum(lo + flat.field("n").to_numpy(zero_copy_only=False) + length - 1, starts[row + 1])
        lo = np.minimum(lo, hi)
        depth = np.bincount(lo, minlength=len(data) + 1) - np.bincount(hi, minlength=len(data) + 1)
        gone = np.cumsum(depth)[: len(data)] > 0
        kept = data[~gone]
        ends = starts - np.concatenate([[0], np.cumsum(gone)])[starts]
        owner = np.repeat(np.arange(batch.num_rows), np.diff(starts))
        begin = gone.copy()
        begin[1:] &= ~gone[:-1] | (owner[1:] != owner[:-1])
        end = gone.copy()
        end[:-1] &= ~gone[1:] | (owner[1:] != owner[:-1])
        b, e = np.flatnonzero(begin), np.flatnonzero(end)
        per = np.concatenate([[0], np.cumsum(np.bincount(owner[b], minlength=batch.num_rows))])
        runs = pa.StructArray.from_arrays([pa.array(b - starts[owner[b]]), pa.array(e + 1 - starts[owner[e]])], fields=list(span))
        whole = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(kept))])
        if as_text:
            whole = pa.array([b.decode("utf-8", "ignore") for b in whole.to_pylist()], pa.string())
        cols = [
            batch.column("doc_id"),
            pa.array(np.diff(starts)),
            whole,
            C.lists(runs, per),
        ]
        yield pa.record_batch(cols + ([batch.column("row")] if carried else []), names=names)


def suffix_dedup(docs: DataFrame, length: int = 100, carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """Cuts repeated passages of at least `length` bytes out of `text`.

    Returns doc_id, n_bytes long, kept binary (the bytes that stay), removed
    array<struct<start,end>> (maximal runs of bytes cut, end exclusive) and,
    with `carry`, `row` with those columns as they came. With as_text, kept is
    a string, without the characters that a cut split.
    """
    texts = C.with_text(docs)
    parsed = texts.mapInArrow(functools.partial(_parse, length), "trigger long, content long, doc_id long, lo int, n int, repeat boolean")
    found = parsed.repartition("trigger").sortWithinPartitions("trigger", "content", "doc_id", "lo").mapInArrow(_dictionary, "doc_id long, lo int, n int, trigger long")
    found = C.stage(found, "parse")

    # edges of repeated passages: phrases whose trigger others share
    edges = found.where("trigger is not null")
    large = C.stage(edges.groupBy("trigger").count().where(F.col("count") > GROUP).select("trigger", F.lit(True).alias("split")), "large")
    if large.count() <= SENT:  # few triggers are so common; a join would gather each in one task
        large = F.broadcast(large)
    edges = edges.join(large, "trigger", "left").select("doc_id", F.struct("lo", "n", "trigger", F.coalesce("split", F.lit(False)).alias("split")).alias("s"))
    wanted = edges.groupBy("doc_id").agg(F.collect_list("s").alias("wanted"))
    known = C.with_text(docs, carry).where("doc_id is not null").repartition("doc_id")
    fetched = known.select("doc_id", "text").join(wanted, "doc_id").mapInArrow(functools.partial(_fetch, length), "alone boolean, trigger long, salt int, doc_id long, lo int, n int, phrase binary")
    ordered = fetched.repartition("trigger", "salt").sortWithinPartitions("alone", "trigger", "salt", "phrase", "doc_id", "lo").mapInArrow(functools.partial(_sorted_groups, length), "doc_id long, lo int, n int")

    spans = found.where("trigger is null").select("doc_id", "lo", "n").unionByName(ordered).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
    joined = known.join(spans, "doc_id", "left")
    unknown = C.with_text(docs, carry).where("doc_id is null").withColumn("spans", F.lit(None).cast("array<struct<lo:int,n:int>>"))
    out = joined.select(*unknown.columns).unionByName(unknown)
    kind = f", row {out.schema['row'].dataType.simpleString()}" if carry else ""
    return out.mapInArrow(functools.partial(_cut, length, bool(carry), as_text), f"doc_id long, n_bytes long, kept {'string' if as_text else 'binary'}, removed array<struct<start:bigint,end:bigint>>{kind}")
