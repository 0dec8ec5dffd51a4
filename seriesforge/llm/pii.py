"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

Everything here is column expressions. A pattern's matches are read with
regexp_extract_all and the text between them with split; running sums of their
lengths give their places, in code points and bytes. No pattern recurses or
backtracks over a run, and no step looks at a text or an array once for each
match, so very long texts and very many matches cost no more than their length.

Base kinds count once their own check holds: email, ip (parts of at most 255),
card (14 to 19 digits, Luhn) and phone (10 to 15 digits). A pattern takes the
longest run that it can, and a run that fails is dropped whole. The patterns
below are written so that they find exactly these runs without trying each
place within a run again; card runs of other lengths aren't proposed at all.

Further kinds need a score of at least KEEP. A span's score is that of its kind
(a checksum included), raised by CONTEXT if one of its kind's words stands in
the NEAR code points before it: iban (mod 97; kept without context), card13
(13 digits, Luhn), national (a phone number without country code), and secret
(an assigned token, to its end; its own name is its context). Base spans carry
a score, too, but stay whatever it is. A further span that lies within a base
one is left out; one that reaches beyond it stays, since its rest is personal
data as well. Redaction covers all that overlapping spans cover.

Texts of any length, of any number of matches, are read whole. A null or empty
text has no spans; null and repeated doc_id values pass through. Other
columns are ignored, or kept in the struct `row` if named in `carry`.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "card13", "national", "secret")
KEEP, CONTEXT, NEAR = 0.5, 0.3, 40

_LOCAL = "[A-Za-z0-9._%+-]"
_RUN = r"(?<![0-9])(?<![0-9][\x20-])"
#: Pattern, a string without which there is no match, score, and context words of each kind.
PATTERNS = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.7, "mail|contact|write|address"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.5, "ip|host|server|address|client"),
    "card": (_RUN + r"[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])", None, 0.6, "card|credit|visa|pay|account"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|tel|call|mobile|fax"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None, 0.6, "iban|account|bank|transfer"),
    "card13": (_RUN + r"[0-9](?:[\x20-]?[0-9]){12}+(?![\x20-]?[0-9])", None, 0.3, "card|credit|visa|pay"),
    "national": (r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])", None, 0.3, "phone|tel|call|mobile|fax"),
    "secret": (r"(?i)(?<![a-z])(?:token|secret|password|passwd|api[_-]?key)\x20{0,3}[=:]\x20{0,3}[\"']?[a-z0-9_./+-]{12,}+[\"']?", None, 0.5, "key|auth|login"),
}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled, and 9 taken off what passes 9; the sum must end in 0."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5)))
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)).cast("long")) % 10 == 0


def _mod97(match: Column) -> Column:
    """The first four characters go last, letters stand for 10 to 35, and the number leaves 1."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))
    step = lambda a, c: F.when(c == "", a).when(F.ascii(c) < 58, (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: step(a, c).cast("int")) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind in ("card", "card13"):
        return _luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        return F.length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34) & _mod97(match)
    raise ValueError(f"no check for {kind}")


CHECKED = ("ip", "card", "phone", "iban", "card13")
#: A span with its places in code points and, for cutting, in bytes.
SPAN = "array<struct<start:bigint,kind:int,end:bigint,score:double,first_byte:bigint,end_byte:bigint>>"
#: Elements that a running value passes at a time.
RUN = 512
#: Matches before one that can reach into its context: none is shorter than four characters.
BEFORE = NEAR // 4


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once: an expression named in a lambda would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, merge, zero: int = 0) -> Column:
    """Of each place in an array of longs what merge makes of all values before it, and, as a last element, of all.

    An array grows by copying, so values pass in runs of RUN, and the runs'
    totals among themselves: the work is near linear in their number.
    """
    none = F.array().cast("array<bigint>")
    start = lambda at: F.struct(at.cast("long").alias("at"), none.alias("seen"))
    step = lambda acc, x: F.struct(merge(acc["at"], x).cast("long").alias("at"), F.concat(acc["seen"], F.array(acc["at"])).alias("seen"))
    last = lambda v: F.greatest(F.ceil(F.size(v) / RUN).cast("int") - 1, F.lit(0))
    runs = _let(values, lambda v: F.transform(F.sequence(F.lit(0), last(v)), lambda i: F.slice(v, i * RUN + 1, RUN)))
    total = lambda r: F.aggregate(r, F.lit(zero).cast("long"), lambda at, x: merge(at, x).cast("long"))
    within = lambda rs, ends: F.transform(rs, lambda r, i: F.aggregate(r, start(F.get(ends["seen"], i)), step)["seen"])
    return _let(runs, lambda rs: _let(F.aggregate(F.transform(rs, total), start(F.lit(zero)), step), lambda ends: F.concat(F.flatten(within(rs, ends)), F.array(ends["at"]))))


def _parts(kind: str, text: Column) -> Column:
    """The kind's matches m, each with the text p since the match before it; null if there are none."""
    pattern, must, _, _ = PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    seen = text.contains(must) if must else F.lit(True)
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("p"), matches.alias("m"))
    return F.when(seen & text.rlike(pattern), F.filter(pairs, lambda x: x["m"].isNotNull()))


def _spans(parts: Column, kind: Column) -> Column:
    """The matches of one kind (by number) with their places, score and text m."""
    flat = lambda size: F.flatten(F.transform(parts, lambda x: F.array(size(x["p"]).cast("long"), size(x["m"]).cast("long"))))
    add = lambda a, x: a + x
    tails = F.transform(parts, lambda x: F.right(F.concat(x["p"], x["m"]), F.lit(NEAR)))
    score, words = (F.element_at(F.array(*(F.lit(PATTERNS[k][i]) for k in KINDS)), kind + 1) for i in (2, 3))

    def near(tails: Column, x: Column, i: Column) -> Column:
        """The NEAR characters before a match."""
        back = F.slice(tails, F.greatest(i - BEFORE, F.lit(0)) + 1, F.least(i, F.lit(BEFORE)))
        return F.when(F.length(x["p"]) >= NEAR, F.right(x["p"], F.lit(NEAR))).otherwise(F.right(F.concat(F.array_join(back, ""), x["p"]), F.lit(NEAR)))

    at = lambda places, i, k: F.get(places, (2 * i + k).cast("int"))

    def span(w: Column, x: Column, i: Column) -> Column:
        context = F.regexp_like(near(w["tails"], x, i), F.concat(F.lit("(?i)(?:"), words, F.lit(")")))
        return F.struct(
            at(w["chars"], i, 1).alias("start"),
            kind.alias("kind"),
            at(w["chars"], i, 2).alias("end"),
            (score + F.when(context, CONTEXT).otherwise(0.0)).alias("score"),
            at(w["octets"], i, 1).alias("first_byte"),
            at(w["octets"], i, 2).alias("end_byte"),
            x["m"].alias("m"),
        )

    known = F.struct(parts.alias("parts"), tails.alias("tails"), *(_running(flat(size), add).alias(n) for n, size in (("chars", F.length), ("octets", F.octet_length))))
    return _let(known, lambda w: F.transform(w["parts"], lambda x, i: span(w, x, i)))


def _outside(others: Column, base: Column) -> Column:
    """The others that lie in no base span: in order of start, none before them, base first, ends as late."""
    ranked = lambda spans, other: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(other).alias("other"), s.alias("s")))
    ends = lambda merged: F.transform(merged, lambda x: F.when(x["other"] == 0, x["s"]["end"]).otherwise(F.lit(0).cast("long")))
    free = lambda x, reach, i: F.struct(((x["other"] == 1) & (F.get(reach, i) < x["s"]["end"])).alias("free"), x["s"].alias("s"))
    marked = _let(F.array_sort(F.concat(ranked(base, 0), ranked(others, 1))), lambda merged: _let(_running(ends(merged), F.greatest), lambda reach: F.transform(merged, lambda x, i: free(x, reach, i))))
    return F.transform(F.filter(marked, lambda x: x["free"]), lambda x: x["s"])


def find_pii(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id, text and spans array<struct<start,end,kind,score,first_byte,end_byte>>, by start, then kind; places in code points (and bytes), end exclusive."""
    df = C.with_text(docs, carry)
    text, has_digit = F.col("text"), F.col("text").rlike("[0-9]")
    found = {kind: _parts(kind, text) if kind in ("email", "secret") else F.when(has_digit, _parts(kind, text)) for kind in KINDS}
    known = F.filter(F.array(*(F.struct(parts.alias("parts"), F.lit(i).alias("kind")) for i, parts in enumerate(found.values()))), lambda x: x["parts"].isNotNull())
    df = df.withColumn("_parts", known)
    df = df.withColumn("_spans", F.flatten(F.transform("_parts", lambda x: _spans(x["parts"], x["kind"]))))
    checked = [k for k in KINDS if k in CHECKED]
    valid = lambda s: functools.reduce(lambda w, k: w.when(s["kind"] == KINDS.index(k), _valid(k, s["m"])), checked, F.when(F.lit(False), True)).otherwise(True)
    plain = F.transform(F.filter("_spans", valid), lambda s: F.struct(*(s[c].alias(c) for c in ("start", "kind", "end", "score", "first_byte", "end_byte"))))
    df = df.withColumn("_valid", F.when(F.size("_spans") > 0, plain).otherwise(F.array().cast(SPAN)).cast(SPAN))
    own = F.col("_valid")
    others = F.filter(own, lambda s: (s["kind"] >= len(BASE)) & (s["score"] >= KEEP))
    df = df.withColumns({"_base": F.filter(own, lambda s: s["kind"] < len(BASE)), "_others": others})
    free = F.when(F.size("_others") > 0, _outside(F.col("_others"), F.col("_base"))).otherwise(F.col("_others"))
    df = df.withColumn("_all", F.array_sort(F.concat("_base", free)))
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind")
    named = F.transform("_all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind(s), *(s[c].alias(c) for c in ("score", "first_byte", "end_byte"))))
    return df.select("doc_id", "text", named.alias("spans"), *(["row"] if carry else []))


def redacted(found: DataFrame) -> Column:
    """The text with each span's kind, in brackets and capitals, in its place; spans that overlap become the first one's."""
    text = F.col("text")
    between = lambda raw, lo, hi: F.substring(raw, (lo + 1).cast("int"), (hi - lo).cast("int")).cast("string")

    def part(w: Column, s: Column, i: Column) -> Column:
        lo = F.get(w["reach"], i)
        return F.when(s["first_byte"] >= lo, F.concat(between(w["raw"], lo, s["first_byte"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

    known = F.struct(text.cast("binary").alias("raw"), _running(F.transform("spans", lambda s: s["end_byte"]), F.greatest).alias("reach"))
    rest = lambda w: between(w["raw"], F.element_at(w["reach"], -1), F.octet_length(w["raw"]))
    done = _let(known, lambda w: F.concat(F.array_join(F.transform("spans", lambda s, i: part(w, s, i)), ""), rest(w)))
    return F.when(F.size("spans") > 0, done).otherwise(text)


def describe(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
