"""Grouping spelling variants: automata over halves of words.

Two words are near if one inserted, deleted or replaced code point turns one
into the other. A word points to its near word of greatest count, if that is
frequent enough, and pointers are followed to the last word.

1. Words are counted per slice in Python, then by a grouped sum.
2. A word is cut into two halves. A word near it holds one of them unchanged:
   the first at its start, or the second at its end. The halves are written
   "end start" (one of them empty), and a word is scanned as "word word", so that
   the blank fixes the offset of every hit. Halves are dealt to shards by their
   hash, and each word goes to the shards of the halves that its near words, one
   longer, as long or one shorter, can have.
3. A shard builds one Aho-Corasick automaton over its halves and scans its words.
   A hit of compatible length is verified on what the half leaves over: equal
   but for one place, or equal once either side loses one code point. Of a word
   only the number of near words and the best one leave the shard. A pair that
   agrees in both halves counts for the first one.
4. A half that very many words share is cut further: what is left of its words
   is halved again, and so on until every group is below `limit` or its words
   differ in one code point. So no group grows with the corpus.
5. Pointers are joined to roots by doubling. Each step leads to a word at least
   `ratio` times as frequent, so chains are short.

Words are maximal runs of [A-Za-z\\u00C0-\\u00FF] with A-Z lower-cased. Null and
empty texts have none. Rows that repeat a doc_id count each for itself; a null
doc_id counts as an empty one in the hash that plants slips. Texts of any length
are read in parts. Ties between near words go to the first in code-point order.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

LETTERS = "a-zÀ-ÿ"
#: Distinct words that a task holds before it hands on their counts, and characters of text that it looks at together.
HELD, PART = 200_000, 1 << 20
#: Rows of a shard, about, and of one half that a shard takes.
SHARD, LIMIT = 20_000, 20_000
#: Below so many hot halves their list is sent to all tasks.
SENT = 50_000
MATCH = pa.schema([("word", pa.string()), ("near", pa.int64()), ("less", pa.int64()), ("other", pa.string())])


def _parts(text: str) -> Iterator[str]:
    """A text in parts that end outside words."""
    outside, at = re.compile(f"[^{LETTERS}]"), 0
    while at < len(text):
        end = outside.search(text, at + PART)
        stop = end.start() if end else len(text)
        yield text[at:stop]
        at = stop


@C.tidy
def _count(least: int, slips: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find = re.compile(f"[{LETTERS}]{{{least},}}").findall
    total: Counter[str] = Counter()

    def counts() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    for batch in C.slices(batches):
        data, starts = C.text_bytes(batch.column("text"))
        raw = data.tobytes().lower()  # of bytes only A-Z
        for doc, a, b in zip(batch.column("doc_id").to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            text = raw[a:b].decode()
            seed = zlib.crc32(b":" if doc is None else b"%d:" % doc)
            for part in [text] if len(text) <= PART else _parts(text):
                for word, n in Counter(find(part)).items():
                    if slips:
                        h = zlib.crc32(word.encode(), seed)
                        if h % slips == 0:
                            i = h % len(word)
                            word = word[:i] + word[i + 1 :]
                            if len(word) < least:
                                continue
                    total[word] += n
                if len(total) > HELD:
                    yield counts()
                    total.clear()
    yield counts()


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2, slips: int | None = None) -> DataFrame:
    """word and n: the words of at least so many code points that occur at least so often.

    slips plants errors: with h the crc32 of `<doc_id>:<word>`, a word whose h it divides loses its code point h % length.
    """
    counted = C.with_text(docs).mapInArrow(functools.partial(_count, least_length, slips), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _step(i: Column, j: Column, b: Column) -> Column:
    """Where a word goes that has i code points before and j behind an inner part of b: both halves of that part, or nowhere else if it can't be cut."""
    half = F.expr("0") + F.floor(b / 2).cast("int")
    pair = lambda x, y: F.struct(x.cast("int").alias("i"), y.cast("int").alias("j"))
    return F.when(b >= 2, F.array(pair(i + half, j), pair(i, j + b - half))).otherwise(F.array(pair(i, j)))


def _halved(rows: DataFrame) -> DataFrame:
    """Rows (word, n, i, j, own, cuts) one level down. own: the place is the word's own and not that of a near word; cuts: first halves that a pair must not share."""
    i, j = F.col("i"), F.col("j")
    b = F.length("word") - i - j
    rows = rows.withColumn("mine", _step(i, j, b))
    at = F.array_distinct(F.concat("mine", _step(i, j, b - 1), _step(i, j, b + 1)))
    down = rows.withColumn("at", F.explode(at))
    own = F.col("own") & F.array_contains("mine", F.col("at"))
    second = F.col("at.j") > j
    cut = F.struct(i.alias("lo"), (i + F.floor(b / 2)).cast("int").alias("hi"))
    return down.select(
        "word",
        "n",
        F.col("at.i").alias("i"),
        F.col("at.j").alias("j"),
        own.alias("own"),
        F.when(own & second, F.concat("cuts", F.array(cut))).when(own, F.col("cuts")).alias("cuts"),
        ((F.col("at.i") == i) & (F.col("at.j") == j)).alias("ended"),
    )


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.concat(F.right("word", F.col("j")), F.lit(" "), F.left("word", F.col("i"))))


def _dealt(words: DataFrame, limit: int) -> DataFrame:
    """The rows of all words, cut until no half has more than `limit` of them or nothing is left to cut."""
    rows = words.select("word", "n", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("own"), F.array().cast("array<struct<lo:int,hi:int>>").alias("cuts"))
    done: list[DataFrame] = []
    while True:
        rows = _keyed(_halved(rows))
        hot = rows.where("not ended").groupBy("key").count().where(F.col("count") > limit).select("key")
        hot = C.stage(hot, "hot")
        n = hot.count()
        if not n:
            done.append(rows)
            break
        hot = F.broadcast(hot) if n <= SENT else hot
        done.append(rows.where("ended").unionByName(rows.where("not ended").join(hot, "key", "left_anti")))
        rows = rows.where("not ended").join(hot, "key", "left_semi").drop("key", "ended")
        rows = C.stage(rows.groupBy("word", "i", "j").agg(F.first("n").alias("n"), F.max("own").alias("own"), F.max("cuts").alias("cuts")), "halves")
    return functools.reduce(DataFrame.unionByName, done)


class _Rest:
    """What one half leaves over of its words, ready to be asked for near ones."""

    def __init__(self, i: int, j: int):
        self.i, self.j = i, j
        self.words: list[tuple[str, int, list[tuple[int, int]]]] = []
        self.whole: dict[str, int] = {}
        self.holed: dict[str, list[int]] = {}
        self.short: dict[str, list[int]] = {}

    def index(self) -> None:
        for k, (word, _, _) in enumerate(self.words):
            rest = word[self.i : len(word) - self.j]
            self.whole[rest] = k
            less = None
            for p in range(len(rest)):
                head, tail = rest[:p], rest[p + 1 :]
                self.holed.setdefault(f"{head} {tail}", []).append(k)
                if p == 0 or rest[p] != rest[p - 1]:  # the same code point twice: the same string
                    less = head + tail
                    self.short.setdefault(less, []).append(k)

    def near(self, word: str) -> list[int]:
        """The words at a distance of one, each once."""
        if not self.whole:
            self.index()
        rest = word[self.i : len(word) - self.j]
        out = list(self.short.get(rest, ()))
        own = self.whole.get(rest)
        for p in range(len(rest)):
            head, tail = rest[:p], rest[p + 1 :]
            out += [k for k in self.holed.get(f"{head} {tail}", ()) if k != own]
            if p == 0 or rest[p] != rest[p - 1]:
                k = self.whole.get(head + tail)
                if k is not None:
                    out.append(k)
        return out


def _scan(table: pa.Table) -> pa.Table:
    """One shard: builds the automaton of its halves, scans its words and verifies the hits."""
    import ahocorasick

    halves = ahocorasick.Automaton()
    words = table.column("word").to_pylist()
    own = table.filter(table.column("own"))
    for word, n, i, j, cuts in zip(*(own.column(c).to_pylist() for c in ("word", "n", "i", "j", "cuts")), strict=True):
        key = f"{word[len(word) - j :]} {word[:i]}"
        rest = halves.get(key, None)
        if rest is None:
            rest = _Rest(i, j)
            halves.add_word(key, rest)
        rest.words.append((word, n, [(c["lo"], c["hi"]) for c in cuts]))
    out: list[tuple[str, int, int, str]] = []
    if len(halves):
        halves.make_automaton()
        for word in dict.fromkeys(words):
            found, best = 0, (0, "")
            for _, rest in halves.iter(f"{word} {word}"):
                if rest.i + rest.j > len(word) or (len(rest.words) == 1 and rest.words[0][0] == word):
                    continue
                for k in rest.near(word):
                    other, n, cuts = rest.words[k]
                    if cuts and any(word[lo:hi] == other[lo:hi] for lo, hi in cuts):
                        continue  # the pair counts where it shares the first half
                    found += 1
                    best = min(best, (-n, other))
            if found:
                out.append((word, found, *best))
    columns = zip(*out, strict=True) if out else [[]] * 4
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, MATCH, strict=True)], schema=MATCH)


def near_words(words: DataFrame, limit: int = LIMIT, shard: int = SHARD) -> DataFrame:
    """Of words (word, n; no word twice) those with near words: word, n_near, and the near word of greatest n (ties: the first) as best and best_n."""
    n = words.count()
    shards = max(1, -(-4 * n // shard))
    rows = _dealt(words, limit).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    mine = lambda c: F.when(F.col("own"), F.col(c)).alias(c)
    rows = rows.select("shard", "word", mine("n"), mine("i"), mine("j"), "own", mine("cuts"))
    found = rows.groupBy("shard").applyInArrow(_scan, "word string, near long, less long, other string")
    best = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", "other")).alias("best"))
    return best.select("word", "n_near", F.col("best.other").alias("best"), (-F.col("best.less")).alias("best_n"))


def roots(links: DataFrame) -> DataFrame:
    """Of links (word, form) that close no circle: word and root, the last word that following forms leads to."""
    known = C.stage(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not known.join(further, "root", "left_semi").limit(1).count():
            return known
        known = C.stage(known.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def spelling_variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, ratio: int = 10, slips: int | None = None, limit: int = LIMIT) -> DataFrame:
    """word, n, n_near, form (the near word it is a variant of, else null), form_n and root."""
    words = C.stage(word_counts(docs, least_length, least_count, slips), "words")
    joined = words.join(near_words(words, limit), "word", "left")
    counts = F.col("best_n") >= ratio * F.col("n")
    formed = C.stage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(counts, F.col("best")).alias("form"), F.when(counts, F.col("best_n")).alias("form_n")), "forms")
    last = roots(formed.where("form IS NOT NULL"))
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
