import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesforge.llm import license_scan as L
from seriesforge.llm.queries import QUERIES


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def language(template):
    """The word sequences of a template without replaceable regions."""
    parts = re.findall(r"\[([^\[\]]*)\]|([^\s\[\]]+)", template)
    choices = [[(), tuple(a.split())] if a else [(b,)] for a, b in parts]
    return {tuple(itertools.chain(*c)) for c in itertools.product(*choices)}


def test_query_like_brute_force(spark, tmp_path):
    r = random.Random(9)
    bits = ["MIT License", "the Apache-License", "GENERAL public\nlicense", "mit", "license", "general", "public", "élan", "Ünïted", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "licensed under the terms of the GNU General Public License, version 3", "x1", "_", "mitlicense", "MIT  licenses"]
    texts = ["", None, "License", " ".join(bits)] + [r.choice([" ", ", ", "\n"]).join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(120)]
    spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in QUERIES["op4_license_scan"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        places = [(k, label) for p, label in L.BASE.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        x = got[i]
        assert (x.n_words, x.n_base) == (len(w), len(places))
        assert x.first_word == (min(places)[0] if places else None) and x.last_word == (max(places)[0] if places else None)
        assert x.base_labels == ",".join(sorted({p[1] for p in places}))
        full = {label for label, template in L.TEMPLATES.items() if "{" not in template for s in language(template) if any(tuple(w[k : k + len(s)]) == s for k in range(len(w)))}
        assert {y for y in x.labels.split(",") if y} == full | {p[1] for p in places}
        assert 0 <= x.score <= 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9))
def test_automaton_like_the_language(seq):
    for template in ("a [ b ] c", "a [ b [ c ] ] a", "a b {2} c"):
        if "{" in template:
            ends = [n for n in range(len(seq) + 1) if re.fullmatch("ab.{0,2}c", "".join(seq[:n]))]
        elif "[ c ]" in template:
            ends = [n for n in range(len(seq) + 1) if re.fullmatch("a(b(c)?)?a", "".join(seq[:n]))]
        else:
            ends = [n for n in range(len(seq) + 1) if re.fullmatch("ab?c", "".join(seq[:n]))]
        assert L.Automaton(template).match(seq.__getitem__, 0, len(seq)) == (max(ends) if ends else None)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this toolkit and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_templates_need_all_mandatory_wording(spark):
    good, n = MIT, len(words(MIT))
    bad = [good.replace("without restriction", "with restriction"), good.replace("hereby ", ""), good[:-10], good.replace("TORT", "TORTS"), good.replace("substantial portions", "portions")]
    fine = [good, good.replace("portions of", "portions of"), good.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "ACME GMBH"), good.replace("permission notice shall", "permission notice (including the next paragraph) shall")]
    rows = [(i, t) for i, t in enumerate(fine)] + [(10 + i, t) for i, t in enumerate(bad)] + [(None, good), (None, good)]
    got = sorted((-1 if x.doc_id is None else x.doc_id, [(s.label, s.start) for s in x.spans]) for x in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, [("mit-full", 0)])] * 2 + [(i, [("mit-full", 0)]) for i in range(4)] + [(10 + i, []) for i in range(5)]
    row = L.scan_licenses(spark.createDataFrame([(1, "x " + good + " y")], "doc_id long, text string")).first()
    assert (row.spans[0].start, row.spans[0].end) == (1, n + 1)
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        L.Automaton("[ a ] b")


def test_every_template_matches_itself():
    for label, template in L.TEMPLATES.items():
        plain = re.sub(r"\{\d+\}", "zz", template.replace("[ ", "").replace(" ]", "")).split()
        assert L.Automaton(template).match(plain.__getitem__, 0, len(plain)) == len(plain), label
        least = re.sub(r"\{\d+\}", "", re.sub(r"\[[^\]]*\]", "", template)).split()
        assert L.Automaton(template).match(least.__getitem__, 0, len(least)) == len(least), label
        for k in (1, len(least) // 2):
            assert L.Automaton(template).match([*least[:k], "zz", "qq", *least[k + 1 :]].__getitem__, 0, len(least) + 1) is None or len(least) < 12


def test_very_long_texts(spark):
    text = "word " * 2_000_000 + MIT + " the mit license" * 100_000
    row = L.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_words == 2_000_000 + len(words(MIT)) + 300_000 and len(row.spans) == 100_001 and row.spans[0].start == 2_000_000
