"""Byte-level BPE: encoding to ids and decoding back to bytes.

A text is split by the vocabulary's pattern. Within a piece every byte starts
as a token of its own. A segment tree over the byte positions holds, at each
leaf, the merge rank of the token that starts there with its right neighbour
(none: infinity), together with the position, so that the root is the leftmost
pair of least rank. A merge links the token to its next live neighbour and
updates three leaves and their paths to the root: its own, its left
neighbour's, and that of the token that went.

Short pieces of the same tree size are merged side by side: their trees are
rows of one numpy array and every round makes one merge in each row. Longer
pieces have a tree each. Distinct pieces are encoded once per worker, in a
cache of bounded size.

Null texts are empty, empty texts have no ids. Null and repeated doc_id values
pass through as they are; other columns are ignored, or kept in the struct
`row` if named in `carry`.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

#: Pieces of up to so many bytes share trees; longer ones have their own.
SHORT = 64
#: Distinct pieces in a worker's cache; a full one is emptied.
CACHED = 300_000
NEVER = np.int64(2**62)


class Vocabulary:
    """The ranks of a .tiktoken file, which are also the ids, and for each pair of ids the id of their concatenation."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.array(merged, np.int64)[order]
        self.pairs = dict(zip(keys.tolist(), merged, strict=True))
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        top = max(self.ranks.values()) + 1
        self.spelled = [b""] * top
        for token, rank in self.ranks.items():
            self.spelled[rank] = token
        self.sizes = np.array([len(t) for t in self.spelled], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.cache: dict[str, np.ndarray] = {}

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each pair of ids the rank of their merge, or -1."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def merge_short(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of pieces that fit one tree size."""
        width = 1 << max(1, (max(map(len, pieces)) - 1).bit_length())
        n = len(pieces)
        sizes = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        token = self.byte[raw]
        place = np.arange(width)
        after = np.broadcast_to(place + 1, (n, width)).copy()
        before = np.broadcast_to(place - 1, (n, width)).copy()
        rank = np.full((n, width), -1, np.int64)
        rank[:, :-1] = self.rank_of(token[:, :-1], token[:, 1:])
        rank[place[None, :] + 1 >= sizes[:, None]] = -1
        tree = np.full((n, 2 * width), NEVER, np.int64)
        tree[:, width:] = np.where(rank >= 0, (rank << 8) | place, NEVER)
        live = place[None, :] < sizes[:, None]
        at = width // 2
        while at:
            tree[:, at : 2 * at] = np.minimum(tree[:, 2 * at : 4 * at : 2], tree[:, 2 * at + 1 : 4 * at : 2])
            at //= 2
        row = np.flatnonzero(tree[:, 1] < NEVER)
        while len(row):
            root = tree[row, 1]
            i = root & 255
            j = after[row, i]
            k = after[row, j]
            token[row, i] = root >> 8
            after[row, i] = k
            inner = k < sizes[row]
            before[row[inner], k[inner]] = i[inner]
            live[row, j] = False
            h = before[row, i]
            new = np.full(len(row), NEVER, np.int64)
            got = self.rank_of(token[row[inner], i[inner]], token[row[inner], k[inner]])
            new[inner] = np.where(got >= 0, (got << 8) | i[inner], NEVER)
            tree[row, width + i] = new
            tree[row, width + j] = NEVER
            outer = h >= 0
            got = self.rank_of(token[row[outer], h[outer]], token[row[outer], i[outer]])
            tree[row[outer], width + h[outer]] = np.where(got >= 0, (got << 8) | h[outer], NEVER)
            for leaf, rows in ((i, row), (j, row), (h[outer], row[outer])):
                node = (leaf + width) >> 1
                while node.size and node[0]:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node >> 1
            row = row[tree[row, 1] < NEVER]
        flat = token[live].astype(np.int32)
        ends = np.cumsum(live.sum(1))
        return np.split(flat, ends[:-1])

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The ids of one piece of any length."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        token = array("i", (int(self.byte[b]) for b in piece))  # flat arrays: 36 bytes for each of the piece's, or a power of two above
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        never, pairs, shift = 1 << 62, self.pairs, 40
        tree = array("q", [never]) * (2 * width)

        def leaf(i: int) -> int:
            k = after[i]
            rank = pairs.get((token[i] << 32) | token[k]) if k < n else None
            return never if rank is None else (rank << shift) | i

        for i in range(n):
            tree[width + i] = leaf(i)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: int) -> None:
            at = width + i
            tree[at] = value
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                value = a if a < b else b
                if tree[at] == value:
                    break
                tree[at] = value
                at >>= 1

        while tree[1] < never:
            i, rank = tree[1] & ((1 << shift) - 1), tree[1] >> shift
            j = after[i]
            k = after[j]
            token[i], token[j], after[i] = rank, -1, k
            if k < n:
                before[k] = i
            put(j, never)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        out = np.frombuffer(token, np.int32)
        return out[out >= 0].copy()

    def learn(self, words: set[str]) -> None:
        """Encodes the words that are not in the cache."""
        todo = [w for w in words if w not in self.cache]
        if len(self.cache) + len(todo) > CACHED:
            self.cache.clear()
            todo = list(words)
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for w in todo:
            raw = w.encode()
            whole = self.ranks.get(raw)  # a piece that is a token needs no merges
            if whole is not None:
                self.cache[w] = np.array([whole], np.int32)
            elif len(raw) > SHORT:
                self.cache[w] = self.merge_long(raw)
            else:
                groups.setdefault((len(raw) - 1).bit_length(), []).append((w, raw))
        for group in groups.values():
            for lo in range(0, len(group), 20_000):
                part = group[lo : lo + 20_000]
                for (w, _), ids in zip(part, self.merge_short([raw for _, raw in part]), strict=True):
                    self.cache[w] = ids

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of these ids, and of each id where its bytes end."""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.flat[at], ends


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.cache
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern).findall


@C.tidy
def _encode(path: str, pattern: str, carry: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    v, find = vocabulary(path), _pattern(pattern)
    for batch in C.slices(batches):
        found = [find(t) for t in batch.column("text").to_pylist()]
        v.learn(set().union(*found))
        cache = v.cache
        parts = [np.concatenate([cache[w] for w in words]) if words else np.zeros(0, np.int32) for words in found]
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        cols = [batch.column("doc_id"), C.lists(pa.array(np.concatenate(parts)), starts)]
        yield pa.record_batch(cols + ([batch.column("row")] if carry else []), names=["doc_id", "ids"] + ["row"] * carry)


@C.tidy
def _decode(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path)
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            ids = part.column("ids")
            sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            data, ends = v.spell(ids.flatten().to_numpy(zero_copy_only=False))
            ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
            text = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.record_batch([part.column(i) for i in range(part.num_columns)] + [text], names=[*part.schema.names, "decoded"])


def encode(docs: DataFrame, path: str, pattern: str, carry: list[str] | None = None) -> DataFrame:
    """doc_id and ids array<int>: the text's tokens by the ranks in `path`, each match of `pattern` separately, without special tokens."""
    df = C.with_text(docs, carry)
    kind = f", row {df.schema['row'].dataType.simpleString()}" if carry else ""
    return df.mapInArrow(functools.partial(_encode, path, pattern, bool(carry)), f"doc_id long, ids array<int>{kind}")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The same rows with `decoded` binary, the bytes that `ids` spell; a null list spells nothing."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(functools.partial(_decode, path), f"{kinds}, decoded binary")
