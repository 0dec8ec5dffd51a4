import html
import itertools
import os
import re

import pytest

from seriesforge.llm import html_extract as H
from seriesforge.llm.queries import QUERIES


def page(title, paras, menu="Home", article=True, extra="", cut=False):
    body = "".join(f"<p>{p}</p>" for p in paras)
    core = f"<article><h1>{title}</h1>{body}{extra}</article>" if article else f"<div class=wrap><h1>{title}</h1>{body}{extra}</div>"
    return f"""<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href="/x">{menu}</a></li></ul></nav><!-- c <p>no</p> --><div class="ad">Buy!</div>{core}<div id="comments"><p>I agree</p></div><form><label>mail</label><input></form><aside><p>side</p></aside><div class="cookie-notice">We use</div><footer>&copy; x</footer>""" + ("" if cut else "</body></html>")


def test_markup_and_whitespace(spark, tmp_path):
    rows = [
        (1, "http://a.example/1", page("T&amp;t", ["one  <b>two</b>\n three&nbsp;x", "&lt;b&gt; é &#228;"])),
        (2, "http://a.example/2", page("T", ["<b>Sub<br>", "next"], cut=True).replace("</p>", "")),
        (3, "http://a.example/3", ""),
        (4, None, None),
        (None, "http://b.example/", page("N", ["q"], article=False)),
        (None, "http://b.example/", page("N", ["q"], article=False)),
        (7, "http://c.example/", "<p>unclosed <i>a < b <table><tr><td>x<td>y</table>" + "<div>" * 3000 + "deep"),
        (8, "http://c.example/2", "<div class='x>broken <p>text here</p>"),
    ]
    spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, host int").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op2_html_extract"](spark, str(tmp_path)).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert by[1].text == "T&t\n\none two three x\n\n<b> é ä" and by[1].n_chars == len(by[1].text)
    assert by[2].text == "T\n\nSub\n\nnext" and by[3].text == "" and by[4].text == "" and by[4].n_chars == 0
    assert by[None].text == "N\n\nq" and by[7].text.endswith("deep") and "text here" in by[8].text
    assert H.extract_text(spark.read.parquet(f"{tmp_path}/pages.parquet").limit(0)).count() == 0


def test_template_is_what_stays_the_same(spark, monkeypatch):
    rows = [(i, f"https://w.example/{i}", page(f"Title {i}", [f"text {i} {j}" for j in range(3 + i % 4)] + ["a line that pages share"] * (i % 3 == 0), article=i % 2 == 0, extra="<p class=b>Read our other pieces</p>")) for i in range(40)]
    rows += [(100 + i, "https://one.example/", page("Same", ["copy"])) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    want = {i: "\n\n".join([f"Title {i}", *(f"text {i} {j}" for j in range(3 + i % 4)), *(["a line that pages share"] * (i % 3 == 0))]) for i in range(40)} | {100 + i: "Same\n\ncopy" for i in range(30)}
    plain = {r.page_id: r.text for r in H.extract_text(df).collect()}
    assert {i: t for i, t in plain.items() if i >= 100 or i % 2 == 0} == {i: t for i, t in want.items() if i >= 100 or i % 2 == 0}
    monkeypatch.setattr(H, "BROADCAST", 0)  # joined by host instead of sent
    assert {r.page_id: r.text for r in H.extract_text(df).collect()} == plain


def soup(i, classes="a b c d"):
    """A page without a telling name: menu, teaser and imprint in plain divs, and a text that varies with i."""
    a, b, c, d = classes.split()
    paras = "".join(f"<p>paragraph {i} {j} says something of its own, at some length</p>" for j in range(2 + i % 3))
    return f"<html><body><div class={a}><div>Start</div><div>Contact us</div></div><div class={b}><h1>Story {i}</h1><div class={d}>Share this story with all your friends and family now</div>{paras}</div><div class={c}>All rights reserved by the publishing house</div></body></html>"


def test_alignment_finds_what_no_name_tells(spark, monkeypatch):
    rows = [(i, f"https://soup.example/{i}", soup(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = {i: "\n\n".join([f"Story {i}", *(f"paragraph {i} {j} says something of its own, at some length" for j in range(2 + i % 3))]) for i in range(30)}
    assert {r.page_id: r.text for r in H.extract_text(df).collect()} == want
    alone = df.where("page_id = 3")  # nothing to align with
    assert "Share this story" in H.extract_text(alone).first().text


def story(i):
    return f"<h1>Story number {i}</h1>" + "".join(f"<p>paragraph {i} {j} says something of its own, at some length</p>" for j in range(2 + i % 3))


def story_text(i):
    return "\n\n".join([f"Story number {i}", *(f"paragraph {i} {j} says something of its own, at some length" for j in range(2 + i % 3))])


def texts_of(spark, pages):
    df = spark.createDataFrame([(i, f"https://one.example/{i}", h) for i, h in pages.items()], "page_id long, url string, html string").repartition(3)
    return {r.page_id: r.text for r in H.extract_text(df).collect()}


def test_named_comments_within_the_article(spark):
    talk = lambda i: "".join(f"<p>I think {i} {k}</p>" for k in range(i % 5))
    pages = {i: f"<body><article>{story(i)}<section class='reader-comments'>{talk(i)}</section><div class='ad-slot'>Buy {i}</div><div class='social-share'>x{i}</div></article></body>" for i in range(40)}
    assert texts_of(spark, pages) == {i: story_text(i) for i in pages}


@pytest.mark.parametrize("tag", ["article", "div"])
def test_comments_without_names_are_records_whose_number_varies(spark, tag):
    """Author, then words, in elements that repeat within the story; single ones, too."""
    talk = lambda i: "".join(f"<div class=q><span>Reader {k}</span><p>I do not agree with story {i} at all, and here is why: {k}</p></div>" for k in range(i % 4))
    pages = {i: f"<body><div class=m>Start</div><{tag}>{story(i)}<div class=z>{talk(i)}</div></{tag}></body>" for i in range(12)}
    assert texts_of(spark, pages) == {i: story_text(i) for i in pages}


def test_comments_beside_the_story_without_names(spark):
    talk = lambda i: "".join(f"<p>opinion {i} {k} on what was said above, and rather a long one</p>" for k in range(1 + i % 4))
    pages = {i: f"<body><div class=w><div class=x>{story(i)}</div><div class=y>{talk(i)}</div></div></body>" for i in range(40)}
    assert texts_of(spark, pages) == {i: story_text(i) for i in pages}


@pytest.mark.parametrize("n", [3, 6, 9])
def test_few_pages_without_an_article(spark, n):
    pages = {i: f"<body><div class=a><div>Menu of the site</div><div>Contact</div></div><div class=b>{story(i)}</div><div class=c>Imprint of the publishing house</div></body>" for i in range(n)}
    assert texts_of(spark, pages) == {i: story_text(i) for i in pages}


def test_what_only_looks_like_records_stays(spark):
    """Sections with headings, lists with links, tables, and elements as many on every page."""
    parts = lambda i: "".join(f"<section><h3>Part {k}</h3><p>words {i} {k} of this part</p></section>" for k in range(1 + i % 3)) + "<ul>" + "".join(f"<li><a>link {k}</a> and <b>more {i}</b></li>" for k in range(2 + i % 2)) + "</ul>"
    fact = "<div class=f><span>Fact</span><div>the same number of these on all pages</div></div>"
    pages = {i: f"<body><article>{story(i)}{parts(i)}{fact}</article></body>" for i in range(9)}
    want = {i: "\n\n".join([story_text(i), *(x for k in range(1 + i % 3) for x in (f"Part {k}", f"words {i} {k} of this part")), *(f"link {k} and more {i}" for k in range(2 + i % 2)), "Fact", "the same number of these on all pages"]) for i in pages}
    assert {i: t.replace("Fact the", "Fact\n\nthe") for i, t in texts_of(spark, pages).items()} == want


def test_names_that_only_look_like_chrome(spark):
    rows = [
        ("<article class='post has-sidebar'><h1>T</h1><p>one</p></article><div>other</div>", "T\n\none"),
        ("<div class='site comments-open'><article><h1>T</h1><p>one</p><div class='post-comments'><p>I agree</p></div></article></div>", "T\n\none"),
        ("<main class='ad-free'><h1>T</h1><p>one</p></main><div class='sidebar'>x</div>", "T\n\none"),
        ("<article><div class='entry-header'><h1>T</h1></div><p>one</p><div class='social-links'>x</div></article>", "T\n\none"),
        ("<article><header><h1>T</h1></header><p>one</p><footer>x</footer></article><header><h1>Site</h1></header>", "T\n\none"),
        ("<div class='sidebar-box'><article><p>one</p></article></div>", "one"),
        ("<article>" + "<div>" * 210 + "<nav>menu</nav><p>one</p>" + "</div>" * 210 + "</article>", "one"),
    ]
    df = spark.createDataFrame([(i, f"http://h{i}.example/", f"<html><body>{h}</body></html>") for i, (h, _) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract_text(df).collect()}
    assert [got[i] for i in range(len(rows))] == [t for _, t in rows]


def test_near_copies_are_not_template(spark):
    """Copies with other menus and titles: their paragraphs stay, on hosts of little else and on others."""
    body = "".join(f"<p>the same long paragraph number {j} of the copied article</p>" for j in range(8))
    copies = [(i, "http://copy.example/", f"<body><nav>{i}</nav><article><h1>Title {i}</h1>{body}</article></body>") for i in range(25)]
    mixed = [(100 + i, "http://mixed.example/", f"<body><nav>{i}</nav><article><h1>Title {i}</h1>{body if i % 2 else f'<p>own text {i}</p>'}</article></body>") for i in range(40)]
    got = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(copies + mixed, "page_id long, url string, html string")).collect()}
    assert all(t.count("copied article") == 8 for i, t in got.items() if i < 100 or i % 2)
    assert got[100] == "Title 0\n\nown text 0"


def test_very_long_and_very_deep_pages(spark):
    many = "".join(f"<p>para {i}</p>" for i in range(20_000))
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    rows = [(1, "http://l.example/", f"<body><article>{many}</article></body>"), (2, "http://l.example/", f"<body><article>{many}<p>end</p></article></body>"), (3, "http://d.example/", deep), (4, "http://d.example/", deep + "x")]
    got = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].count("para") == 20_000 and got[2].endswith("\n\nend") and got[3] == "deep" and got[4].startswith("deep")


def test_halved_tables_match_like_whole_ones(monkeypatch):
    import random

    r = random.Random(2)
    tree = lambda: H.parse("<div>" + "".join(f"<{t}><i></i></{t}>" if r.random() < 0.5 else f"<{t}></{t}>" for t in r.choices(["p", "h2", "ul"], k=12)) + "</div>")
    for _ in range(40):
        a, b = tree(), tree()
        found = []
        for cells in (1 << 20, 20):
            monkeypatch.setattr(H, "CELLS", cells)
            H._weights.clear()
            for t in (a, b):
                H._shape(t)
            found.append(H.weight(a, b))
        assert found[0] == found[1]


def brute(a, b):
    if a.label != b.label:
        return 0
    x, y = ([k for k in n.kids if type(k) is H.Node] for n in (a, b))
    best = 0
    for n in range(min(len(x), len(y)) + 1):
        for i in itertools.combinations(x, n):
            for j in itertools.combinations(y, n):
                got = [brute(p, q) for p, q in zip(i, j, strict=True)]
                best = max(best, sum(got) if all(got) else 0)
    return 1 + best


def test_tree_matching_like_brute_force():
    trees = [H.parse(t) for t in ("<div><p>a<p>b<ul><li>x<li>y</ul></div>", "<div><ul><li>z</ul><p>c</div><div></div>", "<div><p>a<h2>t</h2><p>c<ul><li>1<li>2<li>3</ul></div>", "<p>q", "")]
    for t in trees:
        H._shape(t)
    for a in trees:
        for b in trees:
            assert H.weight(a, b) == brute(a, b)
            assert len(H.align(a, b, H.numbered(b))) == brute(a, b)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/pages.parquet"), reason="no test tables")
def test_query_like_a_plain_reading_of_the_article(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r.text for r in QUERIES["op2_html_extract"](spark, "/root/testdata/sf0.01").collect()}
    for r in rows:
        core = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", r.html, re.S)[1]
        core = re.sub(r"</?(h1|p|li|ul|div|blockquote)[^>]*>", "\0", core).replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub(r"<!--.*?-->|<[^>]+>", "", b)).split()) for b in core.split("\0"))
        assert got[r.page_id] == "\n\n".join(filter(None, blocks))
