"""Near-duplicate documents: HyperMinHash registers, banding, exact confirmation.

A document's set holds the hashes of its distinct word shingles. Documents with
equal sets form a class, of which only the least doc_id goes on.

1. Registers. Hash functions deal the set into buckets, and each bucket keeps of
   its least hash the count of leading zeros and `MANTISSA` bits after them: 256
   registers of 16 bits. Sets of at least `LARGE_FROM` shingles use 8 functions
   of 32 buckets, sets of at most `SMALL_TO` use 256 functions of one bucket,
   and sets between have both, so that any two sets that can be linked have a
   kind in common.
2. Bands of 6 registers. Two sets with similarity 0.8 miss all 42 bands with a
   probability under 3e-6. Buckets of one document go.
3. Confirmation. Pairs whose registers, corrected for those that agree by
   collision, put the similarity clearly below the threshold are dropped (by
   over six standard deviations); the others are compared on their full sets.
   First each document is compared with two of its buckets' documents: the
   least, and the one whose buckets are fullest, which in a group of copies is
   the text they stem from. Most of a group is then one component.
   What is left are buckets with several components. Documents that such
   buckets connect form a family; its largest component is its main one, and
   each document outside the main one is compared with every other of the
   family. A family is dealt out in blocks of about BLOCK by BLOCK documents,
   whose registers are compared as matrices; no pairs are written but links
   that join components. So no link between components is missed, and a group
   of copies costs no more than its size times its strays.
4. Links are joined to components by shuffles of edges.

Words are separated by white space, and A-Z are lower-cased. Documents without
words are linked with none and kept. A null doc_id is linked with none: its
component is null and it is kept. Rows that repeat a doc_id are one document.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

BASE = 0xD6E8FEB86659FD93
UNBASE = pow(BASE, -1, 1 << 64)
MANTISSA = 10
REGISTERS, BINS, ROWS = 256, 32, 6
LARGE_FROM, SMALL_TO = 52, 80
EMPTY = np.uint16(0xFFFF)
#: How far below the threshold an estimate must lie for a pair not to be compared.
MARGIN = 0.2
#: Documents on either side of a block.
BLOCK = 256


@functools.cache
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    value = C.table_of_words(11)
    for b in range(65, 91):
        value[b] = value[b + 32]
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return value, space


_table: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """At least so many powers of BASE and of its inverse; a worker keeps those of a slice."""
    if _table and len(_table[0][0]) >= size:
        return _table[0]
    out = []
    for base in (BASE, UNBASE):
        p = np.ones(size, np.uint64)
        n = 1
        while n < size:
            p[n : 2 * n] = p[: min(n, size - n)] * C.power(base, n)
            n *= 2
        out.append(p)
    if size <= 2 * C.SLICE_BYTES:
        _table[:] = [(out[0], out[1])]
    return out[0], out[1]


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the hash of each word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value, space = _byte_tables()
    up, down = _powers(max(len(data), C.SLICE_BYTES))
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True  # words end with their document
    begin = inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]]))
    end = inside & (edge[1:] | np.concatenate([~inside[1:], [True]]))
    b, e = np.flatnonzero(begin), np.flatnonzero(end)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[data] * up[: len(data)])])
    return np.searchsorted(starts, b, "right") - 1, C.mix((total[e + 1] - total[b]) * down[b] + (e - b).astype(np.uint64))


def shingle_sets(data: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of n words of each row: rows, ascending, and hashes, ascending within a row."""
    row, word = word_hashes(data, starts)
    size = max(0, len(word) - n + 1)
    h = word[:size]
    for k in range(1, n):
        h = C.mix(h * np.uint64(0x9E3779B97F4A7C15) + word[k : k + size])
    whole = row[:size] == row[n - 1 :] if size else np.zeros(0, bool)
    counts = np.bincount(row, minlength=len(starts) - 1)
    first = np.cumsum(counts) - counts
    rows, hashes = [row[:size][whole]], [h[whole]]
    for few in range(1, n):  # fewer words: the whole sequence is one shingle
        at = np.flatnonzero(counts == few)
        if len(at):
            x = word[first[at]]
            for k in range(1, few):
                x = C.mix(x * np.uint64(0x9E3779B97F4A7C15) + word[first[at] + k])
            rows.append(at)
            hashes.append(C.mix(x + np.uint64(few)))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def compress(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of each least hash."""
    x = least >> np.uint64(11)
    e = np.frexp(x.astype(np.float64))[1].astype(np.int64)
    shift = np.maximum(e - 1, 0).astype(np.uint64)
    mantissa = ((x << np.uint64(MANTISSA)) >> shift) & np.uint64((1 << MANTISSA) - 1)
    return (((53 - e).astype(np.uint64) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


@functools.cache
def _functions(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def small_registers(row: np.ndarray, h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """256 functions of one bucket, for these rows (ascending, none of them empty)."""
    first = np.searchsorted(row, rows)
    out = np.empty((len(rows), REGISTERS), np.uint16)
    for lo in range(0, REGISTERS, 32):
        x = h[:, None] * _functions(REGISTERS, 1)[lo : lo + 32][None, :]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        out[:, lo : lo + 32] = compress(np.minimum.reduceat(x, first, axis=0))
    return out


def large_registers(row: np.ndarray, h: np.ndarray, n_rows: int) -> np.ndarray:
    """8 functions of 32 buckets, for all rows."""
    out = []
    for seed in _functions(REGISTERS // BINS, 2):
        x = C.mix(h ^ seed)
        least = np.full(n_rows * BINS, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, row * BINS + (x >> np.uint64(59)).astype(np.int64), x << np.uint64(5))
        out.append(np.where(least == np.iinfo(np.uint64).max, EMPTY, compress(least)).reshape(n_rows, BINS))
    return np.concatenate(out, 1)


SIGNED = "doc_id long, n_shingles long, k1 long, k2 long, small binary, large binary"


def _binaries(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """Row i of values as the binary of row rows[i]; null elsewhere."""
    at = np.full(n, -1)
    at[rows] = np.arange(len(rows))
    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * REGISTERS), len(rows), [None, pa.py_buffer(np.ascontiguousarray(values))])
    return flat.cast(pa.binary()).take(pa.array(at, mask=at < 0))


@C.tidy
def _sign(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.slices(batches):
        data, starts = C.text_bytes(batch.column("text"))
        row, h = shingle_sets(data, starts, n)
        size = np.bincount(row, minlength=batch.num_rows)
        m = batch.num_rows
        k1, k2 = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
        some = np.flatnonzero(size)
        if len(some):
            at = np.cumsum(size)[some] - size[some]
            k1[some] = np.add.reduceat(C.mix(h), at)
            k2[some] = np.bitwise_xor.reduceat(C.mix(h + np.uint64(0x1234567)), at)
        small, large = np.flatnonzero((size > 0) & (size <= SMALL_TO)), np.flatnonzero(size >= LARGE_FROM)
        pick = np.isin(row, small)
        few = small_registers(row[pick], h[pick], small) if len(small) else np.zeros((0, REGISTERS), np.uint16)
        pick = size[row] >= LARGE_FROM
        place = np.cumsum(size >= LARGE_FROM) - 1
        many = large_registers(place[row[pick]], h[pick], len(large)) if len(large) else np.zeros((0, REGISTERS), np.uint16)
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), _binaries(few, small, m), _binaries(many, large, m)],
            names=["doc_id", "n_shingles", "k1", "k2", "small", "large"],
        )


def _registers(column: pa.Array) -> np.ndarray:
    data, _ = C.text_bytes(column.drop_null())
    return data.view(np.uint16).reshape(-1, REGISTERS)


@C.tidy
def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = REGISTERS // ROWS
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for kind, name in enumerate(("small", "large")):
            column = batch.column(name)
            regs = _registers(column)[:, : count * ROWS].reshape(-1, count, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(count, dtype=np.uint64) * np.uint64(2) + np.uint64(kind), regs.shape[:2])
            for k in range(ROWS):
                key = C.mix(key * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, k])
            full = (regs != EMPTY).any(2)
            doc = np.broadcast_to(ids[column.is_valid().to_numpy(zero_copy_only=False)][:, None], full.shape)
            yield pa.record_batch([pa.array(key[full].view(np.int64)), pa.array(doc[full])], names=["band", "doc_id"])


def similarity(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Estimated from registers of sets of n and m shingles, without those that agree by collision.

    Where two buckets' least hashes differ, they still share a register if both
    fall in one cell, whose width is a fraction of 0.72 / 2**MANTISSA of the
    hash on average; for least hashes of n and m values that has the
    probability 0.72 / 2**MANTISSA * n * m / (n + m)**2.
    """
    used = (a != EMPTY) | (b != EMPTY)
    agree = ((a == b) & used).sum(1) / np.maximum(used.sum(1), 1)
    chance = 0.72 / 2**MANTISSA * n * m / (n + m) ** 2
    return (agree - chance) / (1 - chance)


@C.tidy
def _screen(least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        n, m = (batch.column(c).to_numpy().astype(float) for c in ("n", "m"))
        keep = np.zeros(batch.num_rows, bool)
        for kind in ("small", "large"):
            x, y = batch.column(f"{kind}_a"), batch.column(f"{kind}_b")
            both = (x.is_valid().to_numpy(zero_copy_only=False)) & (y.is_valid().to_numpy(zero_copy_only=False))
            if both.any():
                mask = pa.array(both)
                keep[both] |= similarity(_registers(x.filter(mask)), _registers(y.filter(mask)), n[both], m[both]) >= least
        yield pa.record_batch([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])


@C.tidy
def _sets(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.slices(batches):
        data, starts = C.text_bytes(batch.column("text"))
        row, h = shingle_sets(data, starts, n)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]) * 8
        yield pa.record_batch([batch.column("doc_id"), pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(h))])], names=["doc_id", "shingles"])


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


@C.tidy
def _confirm(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("shingles_a"), batch.column("shingles_b"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            common = _common(x, y)
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        mask = pa.array(keep, pa.bool_())
        yield pa.record_batch([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])


def _block(percent: int, held: pa.Table) -> list[tuple[int, int]]:
    """Links of a block's strays with its other documents, as far as they join components."""
    held = held.combine_chunks()
    column = lambda c: held.column(c).combine_chunks() if isinstance(held.column(c), pa.ChunkedArray) else held.column(c)
    stray = column("stray").to_numpy(zero_copy_only=False)
    ids, component, n = (column(c).to_numpy() for c in ("doc_id", "component", "n"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in column("shingles")]
    s, m = np.flatnonzero(stray), np.flatnonzero(~stray)
    if not len(s) or not len(m):
        return []
    best = np.full((len(s), len(m)), -1.0)
    for kind in ("small", "large"):
        known = column(kind).is_valid().to_numpy(zero_copy_only=False)
        regs = np.full((len(ids), REGISTERS), EMPTY, np.uint16)
        regs[known] = _registers(column(kind))
        ok = np.flatnonzero(known[m])
        for i in np.flatnonzero(known[s]):
            best[i, ok] = np.maximum(best[i, ok], similarity(regs[s[i]][None, :], regs[m[ok]], n[s[i]], n[m[ok]].astype(float)))
    sizes = 100 * np.minimum(n[s][:, None], n[m][None, :]) >= percent * np.maximum(n[s][:, None], n[m][None, :])
    best[~sizes | (component[s][:, None] == component[m][None, :])] = -1
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    links = []
    for i in range(len(s)):
        order = np.argsort(-best[i], kind="stable")
        for j in order[: int((best[i] >= percent / 100 - MARGIN).sum())]:
            p, q = root(int(component[s[i]])), root(int(component[m[j]]))
            if p != q:
                common = _common(sets[s[i]], sets[m[j]])
                if 100 * common >= percent * (len(sets[s[i]]) + len(sets[m[j]]) - common):
                    parent[max(p, q)] = min(p, q)
                    links.append((int(ids[s[i]]), int(ids[m[j]])))
    return links


@C.tidy
def _blocks(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block; one block at a time is held."""
    held: list[pa.RecordBatch] = []
    last = None

    def done() -> pa.RecordBatch:
        links = _block(percent, pa.Table.from_batches(held))
        return pa.record_batch([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(keys[lo])
            if held and key != last:
                yield done()
                held.clear()
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield done()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Links documents whose shingle sets have intersection / union of at least percent / 100.

    Returns doc_id, n_shingles long, component_id long (the least doc_id that
    links lead to) and kept boolean (doc_id = component_id).
    """
    texts = C.with_text(docs)
    signed = C.stage(texts.mapInArrow(functools.partial(_sign, shingle), SIGNED), "registers")
    known = signed.where("doc_id is not null and n_shingles > 0")
    classes = C.stage(known.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("leader"), F.count("*").alias("copies")), "classes")
    leaders = C.joined(known, classes.select(F.col("leader").alias("doc_id")), "doc_id", "left_semi")
    bands = leaders.select("doc_id", "small", "large").mapInArrow(_bands, "band long, doc_id long").repartition("band")
    buckets = bands.groupBy("band").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("band", "first")
    shared = C.stage(C.joined(bands, buckets, "band"), "buckets")

    registers = known.select("doc_id", F.col("n_shingles").alias("n"), "small", "large")
    sets = C.stage(C.joined(texts, shared.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(functools.partial(_sets, shingle), "doc_id long, shingles binary"), "sets")

    load = shared.groupBy("band").agg(F.count("*").alias("full"))
    central = C.joined(shared, load, "band").groupBy("doc_id").agg(F.sum("full").alias("weight"))
    weighed = C.stage(C.joined(shared, central, "doc_id"), "weighed")
    hubs = weighed.groupBy("band").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("neg"))).alias("hub"))
    met = C.joined(weighed, hubs, "band")
    hub = -F.max(F.when(-F.col("hub.neg") != F.col("doc_id"), F.col("hub")))["neg"]
    partners = met.groupBy("doc_id").agg(F.min("first").alias("x"), hub.alias("y")).select("doc_id", F.explode(F.array_distinct(F.array("x", "y"))).alias("z")).where("z is not null and z != doc_id")
    near = partners.select(F.least("doc_id", "z").alias("a"), F.greatest("doc_id", "z").alias("b")).distinct()
    a, b = (registers.toDF(x, n, f"small_{x}", f"large_{x}") for x, n in (("a", "n"), ("b", "m")))
    sized = C.joined(C.joined(near, a, "a"), b, "b").where(F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)"))
    likely = C.stage(sized.mapInArrow(functools.partial(_screen, percent / 100 - MARGIN), "a long, b long"), "likely")
    full = C.joined(C.joined(likely, sets.toDF("a", "shingles_a"), "a"), sets.toDF("b", "shingles_b"), "b")
    found = C.stage(full.mapInArrow(functools.partial(_confirm, percent), "a long, b long").distinct(), "links")
    joined = components(found)

    # families: documents of buckets that hold several components
    placed = C.joined(met.select("band", "doc_id", (-F.col("hub.neg")).alias("hub")), joined, "doc_id", "left").select("band", "doc_id", "hub", F.coalesce("component", "doc_id").alias("component"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    mixed = C.stage(C.joined(placed, mixed, "band").select("doc_id", "hub", "component").distinct(), "mixed")
    families = components(mixed.select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("component", "family")
    kin = C.joined(mixed.select("doc_id", "component").distinct(), families, "doc_id", "left").withColumn("family", F.coalesce("family", "doc_id"))
    kin = C.stage(kin, "kin")
    sizes = kin.groupBy("family", "component").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("strays")).where("strays > 0")
    parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    sizes = C.stage(sizes.select("family", "main", parts("all").alias("m"), parts("strays").alias("s")), "sizes")
    dealt = C.joined(C.joined(C.joined(kin, sizes, "family"), registers, "doc_id"), sets, "doc_id")
    chunk = lambda c, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col(c)).cast("int")
    every = lambda c, place: F.transform(F.sequence(F.lit(0), F.col(c) - 1), place)
    place = lambda sp, mp, stray: F.struct(sp.alias("sp"), mp.alias("mp"), F.lit(stray).alias("stray"))
    whole = every("s", lambda sp: place(sp, F.col("mo"), False))
    stray = F.when(F.col("component") != F.col("main"), every("m", lambda mp: place(F.col("so"), mp, True))).otherwise(F.array().cast("array<struct<sp: int, mp: int, stray: boolean>>"))
    # the last step before the shuffle: no copy takes part in a join
    copies = dealt.withColumns({"so": chunk("s", 1), "mo": chunk("m", 2)}).withColumn("at", F.explode(F.concat(whole, stray)))
    blocks = copies.select("family", "at.sp", "at.mp", "at.stray", "doc_id", "component", "n", "small", "large", "shingles")
    keys = ["family", "sp", "mp"]
    more = blocks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(functools.partial(_blocks, percent), "a long, b long")
    more = C.stage(more, "more")
    joined = components(found.unionByName(more)) if more.limit(1).count() else joined

    member = C.joined(classes, joined.withColumnRenamed("doc_id", "leader"), "leader", "left").select("k1", "k2", "n_shingles", F.coalesce("component", "leader").alias("component_id"))
    member = C.stage(member, "members")
    out = C.joined(signed.select("doc_id", "n_shingles", "k1", "k2"), member, ["k1", "k2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
