"""Main text of web pages: wrapper induction over the pages of a host.

1. A host's page of least page_id (the shortest, then least, html among equal
   ids) is its reference; one row for each host, by aggregation.
2. Each page's DOM tree is aligned with its host's reference tree by simple
   tree matching: nodes match if their labels agree, children are matched in
   order, and the number of matched nodes is greatest. Every block of text of
   the page thus falls into a slot, the innermost reference node that a node
   around it matches.
3. Of each slot the texts are counted over all pages. A text that stays the
   same is template: at least CONSTANT of the host's pages in that branch of the
   body have it, and so many of them that the lower bound of that share
   (Wilson's, at two deviations) is over SURE; or, outside an article that the
   markup names, all of at least FEW pages have it. Pages whose main text is the
   same by their own tree count once. What varies is content. Elements made like
   a comment or teaser, at one place of the reference, are left out if their
   number varies from page to page, within the article too.
4. The wrapper of a host is the reference node that holds most of the varying
   text: from the body downwards, the child with most of it as long as that is
   MOST of the whole; or the only child with a heading that varies, if it has a
   third of the whole. Names break ties: varying text in what the markup calls an
   article or main part weighs NAMED times as much, in what it calls menu,
   footer, advert and the like NAMED times less. An article is not divided.
5. A page's text is what stands in the wrapper's node, without template, and
   without scripts, styles, forms and parts that the markup names as no article.
   A page that has nothing there, or whose own article element lies elsewhere,
   is read by its own tree: its article, else its main part, else where its
   text is. A template that would leave less than half of that isn't applied.

References are sent to all tasks if they are at most BROADCAST bytes, which is
checked; beyond that they are joined to the pages by host and one of SALTS
parts, as are the wrappers. Trees of any depth and lists of any length are
matched in full.

Null html is empty and has an empty text; a null url is a host of its own;
null and repeated page_id values pass through. Other columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CONSTANT, SURE, MOST, NAMED = 0.95, 0.7, 0.7, 4
#: Pages of different main text that must agree in all of a slot's text for it to be template, outside of articles that the markup names.
FEW = 3
BROADCAST = 16 << 20
SALTS = 64
#: Cells of a table of two child lists that is held at once; longer lists are halved, with the same result.
CELLS = 1 << 20

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|"
    r"<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|"
    r"<(?P<close2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)[^>]*>",
    re.S,
)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_END = {t: re.compile(rf"</{t}\s*>?", re.I) for t in ("script", "style", "title", "textarea", "noscript", "template", "svg", "iframe")}
_VOID = frozenset("br img hr input meta link area base col embed source track wbr param".split())
_BLOCK = frozenset("html body address article aside blockquote dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_DROPPED = frozenset("head nav footer aside form button select option input dialog menu script style title textarea noscript template svg iframe label".split())
_P_ENDS = _BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
_CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Elements that are known by their tag alone; of others the first class, without digits, is part of their label.
_PLAIN = frozenset("html body article main".split())
#: Words of class, id and role that name what isn't the article. Fixed values.
_NAMES = frozenset("nav navbar navigation menu topbar header masthead banner footer contentinfo sidebar complementary ad ads advert adverts advertisement advertising sponsored sponsor promo promotion cookie cookies notice notices consent gdpr comment comments disqus respond share sharing social related recommended breadcrumb breadcrumbs newsletter subscribe subscription login signup search popup modal widget pagination pager toolbar alert dialog adslot adsense adsbygoogle reactions replies responses discussion guestbook teaser teasers".split())
_MAIN = frozenset("main content article post entry story".split())
#: Words that may stand beside them in such a name. Fixed values.
_BESIDE = frozenset("site page global top bottom left right upper lower primary secondary box block area section wrapper wrap container list links bar text inner outer item items the reader readers user users visitor visitors thread threads slot unit posts button buttons email count feed panel zone col column row form more".split())


def _no_article(names: list[str]) -> bool:
    """Whether one of these names, as a whole, says that something isn't the article: has-sidebar and entry-header don't."""
    for name in names:
        words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
        said = words & _NAMES
        if said and words <= _NAMES | _BESIDE | _MAIN and not (words & _MAIN and said <= {"header", "banner", "masthead"}):
            return True
    return False


class Node:
    __slots__ = ("tag", "label", "main", "named", "kids", "drop", "shape")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.kids, self.shape = tag, [], -1
        names: list[str] = []
        hidden, first = False, ""
        if attrs:
            for key, *values in _ATTR.findall(attrs):
                value = "".join(values)
                key = key.lower()
                if key == "class" and value.split():
                    first = re.sub("[0-9]+", "", value.split()[0])
                if key == "hidden" or key == "aria-hidden" and value == "true":
                    hidden = True
                elif key != "aria-hidden":
                    names += value.split()
        self.label = tag if tag in _PLAIN else f"{tag}.{first}"
        self.main = tag in ("article", "main") or not _MAIN.isdisjoint(n.lower() for n in names)
        self.named = tag not in ("html", "body", "article", "main") and _no_article(names)
        self.drop = tag in _DROPPED or hidden


def parse(text: str) -> Node:
    """The DOM tree; unclosed elements end where HTML lets them. What is named as no article but holds the article isn't dropped."""
    root = Node("html")
    stack, at, opened = [root], 0, Counter()

    def close(i: int) -> None:
        for n in stack[i:]:
            opened[n.tag] -= 1
        del stack[i:]

    while True:
        m = _TAG.search(text, at)
        if m is None:
            if at < len(text):
                stack[-1].kids.append(text[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(text[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if m["close"] or m["close2"]:
            if opened[tag] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if stack[i].tag in ("article", "body", "table") and tag not in _BLOCK:
                        break
            continue
        if tag in _P_ENDS and opened["p"] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in _BLOCK:
                    break
        if tag in _CLOSES and any(opened[t] > 0 for t in _CLOSES[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in _CLOSES[tag]:
                    close(i)
                elif stack[i].tag in _SCOPE[tag]:
                    break
        if tag == "html" or tag == "body" and opened["body"] > 0:
            continue
        node = Node(tag, m["attrs"] or "")
        stack[-1].kids.append(node)
        if tag in _END:
            end = _END[tag].search(text, at)
            at = end.end() if end else len(text)
        elif tag not in _VOID and not (m["attrs"] or "").rstrip().endswith("/"):
            stack.append(node)
            opened[tag] += 1
    _settle(root)
    return root


def _settle(root: Node) -> None:
    """Drops what is named as no article, unless an article or main element stands below it."""
    todo, holds = [(root, False)], {}
    while todo:
        n, done = todo.pop()
        kids = [k for k in n.kids if type(k) is Node]
        if not done:
            todo.append((n, True))
            todo += [(k, False) for k in kids]
        else:
            holds[id(n)] = not n.drop and (n.tag in ("article", "main") or any(holds[id(k)] for k in kids))
            n.named = n.named and not holds[id(n)]
            n.drop = n.drop or n.named


def _shape(node: Node) -> int:
    """A number for the node's label and those below it, equal for equal trees."""
    todo = [(node, False)]
    while todo:
        n, done = todo.pop()
        if not done:
            todo.append((n, True))
            todo += [(k, False) for k in n.kids if type(k) is Node]
        else:
            n.shape = hash((n.label, *(k.shape for k in n.kids if type(k) is Node)))
    return node.shape


_weights: dict[tuple[int, int], int] = {}


def _row(x: Node, ys: list[Node], last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One more row of the table of best sums, and what x is worth with each of ys."""
    worth: dict[int, int] = {}
    for y in ys:
        if y.shape not in worth:
            worth[y.shape] = weight(x, y)
    w = np.array([worth[y.shape] for y in ys])
    row = np.zeros(len(ys) + 1, np.int64)
    np.maximum.accumulate(np.maximum(last[1:], np.where(w > 0, last[:-1] + w, 0)), out=row[1:])
    return row, w


def _matched(xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]]:
    """The pairs of greatest weight that keep the order; long lists are halved where the sums of both halves are greatest."""
    if not xs or not ys:
        return []
    if len(xs) == 1 or len(xs) * len(ys) <= CELLS:
        rows, worths = [np.zeros(len(ys) + 1, np.int64)], []
        for x in xs:
            row, w = _row(x, ys, rows[-1])
            rows.append(row)
            worths.append(w)
        i, j, out = len(xs), len(ys), []
        while i and j:
            if worths[i - 1][j - 1] and rows[i][j] == rows[i - 1][j - 1] + worths[i - 1][j - 1]:
                i, j = i - 1, j - 1
                out.append((xs[i], ys[j]))
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return out[::-1]
    mid = len(xs) // 2
    before = after = np.zeros(len(ys) + 1, np.int64)
    for x in xs[:mid]:
        before, _ = _row(x, ys, before)
    for x in reversed(xs[mid:]):
        after, _ = _row(x, ys[::-1], after)
    cut = int((before + after[::-1]).argmax())
    return _matched(xs[:mid], ys[:cut]) + _matched(xs[mid:], ys[cut:])


def weight(a: Node, b: Node) -> int:
    """The greatest number of nodes that a and b can match; 0 if they differ themselves."""
    if a.label != b.label:
        return 0
    key = (a.shape, b.shape)
    known = _weights.get(key)
    if known is None:
        known = 1
        for x, y in _pairs(a, b):
            known += weight(x, y)
        if len(_weights) > 200_000:
            _weights.clear()
        _weights[key] = known
    return known


def _pairs(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """The matched children of two matching nodes."""
    x, y = [k for k in a.kids if type(k) is Node], [k for k in b.kids if type(k) is Node]
    lo, hi, least = 0, 0, min(len(x), len(y))
    while lo < least and x[lo].shape == y[lo].shape:
        lo += 1
    while hi < least - lo and x[-1 - hi].shape == y[-1 - hi].shape:
        hi += 1
    ends = lambda k: (k[:lo], k[lo : len(k) - hi], k[len(k) - hi :])
    (head, xs, tail), (head2, ys, tail2) = ends(x), ends(y)
    return [*zip(head, head2, strict=True), *_matched(xs, ys), *zip(tail, tail2, strict=True)]


def align(page: Node, reference: Node, number: dict[int, int]) -> dict[int, int]:
    """Of the page's nodes (by id) the number of the reference node that each matches."""
    out, todo = {}, [(page, reference)] if page.label == reference.label else []
    while todo:
        a, b = todo.pop()
        out[id(a)] = number[id(b)]
        todo += _pairs(a, b)
    return out


def numbered(tree: Node) -> dict[int, int]:
    """The nodes' places in the order of the page, so that what is below a node follows it."""
    out, todo = {}, [tree]
    while todo:
        n = todo.pop()
        out[id(n)] = len(out)
        todo += [k for k in reversed(n.kids) if type(k) is Node]
    return out


def _walk(node: Node, inside: bool = False) -> Iterator[tuple[Node, str]]:
    """Blocks of text below a node, each with the element it stands in, without what markup names as no article."""
    buffer: list[str] = []
    todo: list = [(node, node, 0)]
    owner = node
    while todo:
        x, up, phase = todo.pop()
        if type(x) is str:
            buffer.append(x)
            continue
        block = x.tag in _BLOCK
        if block or x.drop and x is not node:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer = []
            if text:
                yield owner, text
        if phase:
            owner = up
            continue
        if x.drop and x is not node or x.tag == "header" and not (inside and any(type(k) is Node and k.tag in ("h1", "h2") for k in x.kids)):
            continue
        if x.tag in ("br", "hr"):
            buffer.append(" ")
        if block:
            todo.append((x, owner, 1))
            owner = x
        for k in reversed(x.kids):
            todo.append((k, owner, 0))
    text = " ".join(entities.unescape("".join(buffer)).split())
    if text:
        yield owner, text


def _find(tree: Node, test) -> list[Node]:
    """The outermost nodes that pass, without looking into dropped ones."""
    out, todo = [], [tree]
    while todo:
        n = todo.pop()
        if n.drop and n is not tree:
            continue
        if test(n):
            out.append(n)
        else:
            todo += [k for k in reversed(n.kids) if type(k) is Node]
    return out


def content(tree: Node) -> tuple[list[tuple[Node, str]], int]:
    """The blocks of a page's main part by its own tree alone, and what says so: 2 an article element, 1 a name, 0 where the text is."""
    for kind, test in ((2, lambda n: n.tag == "article"), (1, lambda n: n.main and n.tag not in ("html", "body"))):
        found = [list(_walk(n, True)) for n in _find(tree, test)]
        sizes = [sum(len(t) for _, t in blocks) for blocks in found]
        if any(sizes):
            return [x for blocks, n in zip(found, sizes, strict=True) if n >= max(sizes) / 4 for x in blocks], kind
    node = next(iter(_find(tree, lambda n: n.tag == "body")), tree)
    size, todo = Counter(), [(node, False)]
    for owner, text in _walk(node):
        size[id(owner)] += len(text)
    while todo:
        n, done = todo.pop()
        kids = [k for k in n.kids if type(k) is Node]
        if done:
            size[id(n)] += sum(size[id(k)] for k in kids)
        else:
            todo += [(n, True), *((k, False) for k in kids)]
    while True:  # down to where the text is
        kids = [k for k in node.kids if type(k) is Node and k.tag in _BLOCK and k.tag != "p" and not k.drop]
        best = max(kids, key=lambda k: size[id(k)], default=None)
        if best is None or size[id(best)] < MOST * size[id(node)] or not size[id(best)]:
            break
        node = best
    return list(_walk(node)), 0


def _everything(tree: Node) -> Iterator[tuple[Node, str, list[Node], bool, bool]]:
    """All blocks of text of the body, in page order, with their elements from the outside in, whether markup says that they are no article, and whether most of it is links."""
    buffer: list[str] = []
    path: list[Node] = [tree]
    dropped = links = linked = 0
    todo: list = [(k, 0) for k in reversed(tree.kids)]

    def block() -> Iterator[tuple]:
        nonlocal linked
        text = " ".join(entities.unescape("".join(buffer)).split())
        if text:
            yield path[-1], text, path, dropped > 0, linked > 0.6 * len(text)
        buffer.clear()
        linked = 0

    while todo:
        x, phase = todo.pop()
        if type(x) is str:
            buffer.append(x)
            linked += len(x.strip()) * (links > 0)
            continue
        if x.tag in _UNREAD:
            continue
        if x.tag in _BLOCK or x.drop:
            yield from block()
            if phase:
                path.pop()
                dropped -= _dropped(x, path)
                continue
            dropped += _dropped(x, path)
            path.append(x)
            todo.append((x, 1))
        elif x.tag == "a":
            links += -1 if phase else 1
            if phase:
                continue
            todo.append((x, 1))
        elif x.tag in ("br", "hr"):
            buffer.append(" ")
        todo += [(k, 0) for k in reversed(x.kids)]
    yield from block()


#: What a comment or teaser is made of: elements that repeat, parts that hold its text, and others that say who or when.
_REPEATED, _BODIES = frozenset("div section li article details".split()), frozenset("p div blockquote".split())
_SAYING = frozenset("span a b strong time cite small em i button img h4 h5 h6 div figure".split())


def _records(tree: Node) -> set[int]:
    """Elements made like a comment or teaser: without text or headings of their own, a short first part, and parts of at least two kinds, one for text and one that says who or when."""
    out: set[int] = set()
    todo = [tree]
    while todo:
        n = todo.pop()
        parts = [k for k in n.kids if type(k) is Node]
        todo += parts
        if n.tag in _REPEATED and len(parts) > 1 and not any(type(k) is str and k.strip() for k in n.kids):
            tags, labels = [k.tag for k in parts], {k.label for k in parts}
            two = len(labels) > 1 and not _BODIES.isdisjoint(tags) and not _SAYING.isdisjoint(tags)
            if two and {"h1", "h2", "h3", "table", "p"}.isdisjoint(tags[:1]) and {"h1", "h2", "h3"}.isdisjoint(tags) and _short(parts[0]):
                out.add(id(n))
    return out


def _short(node: Node, most: int = 60) -> bool:
    size, todo = 0, [node]
    while todo and size <= most:
        for k in todo.pop().kids:
            if type(k) is Node:
                todo.append(k)
            else:
                size += len(k.strip())
    return size <= most


#: Elements whose text isn't read at all.
_UNREAD = frozenset("head script style title textarea noscript template svg iframe".split())


def _dropped(x: Node, path: list[Node]) -> bool:
    """Named as no article, or a header that isn't an article's own with a heading."""
    inside = any(n.main for n in path) if x.tag == "header" else False
    return x.drop or x.tag == "header" and not (inside and any(type(k) is Node and k.tag in ("h1", "h2") for k in x.kids))


@functools.lru_cache(maxsize=256)
def _reference(html: str) -> tuple[Node, dict[int, int]]:
    tree = parse(html)
    _shape(tree)
    return tree, numbered(tree)


def _hash(text: str) -> int:
    """The same number as Spark's xxhash64."""
    h = xxhash.xxh64_intdigest(text, seed=42)
    return h - (1 << 64) if h >> 63 else h


BLOCK = pa.struct([("slot", pa.int32()), ("branch", pa.int32()), ("text", pa.string()), ("drop", pa.bool_()), ("own", pa.bool_()), ("linked", pa.bool_()), ("record", pa.int32()), ("head", pa.bool_())])
READ = "host string, page_id long, url string, page long, kind int, blocks array<struct<slot:int,branch:int,text:string,drop:boolean,own:boolean,linked:boolean,record:int,head:boolean>>"


def _blocks(tree: Node, slots: dict[int, int]) -> tuple[list[dict], int]:
    """The page's blocks with slot, branch (the slot of the body's child around them; -1: none) and kind of record (0: none; head: its first block), and what its own main part is (as in content)."""
    kept, kind = content(tree)
    own = Counter((id(o), t) for o, t in kept)
    out = []
    records, begun = _records(tree), set()
    for owner, text, path, drop, linked in _everything(tree):
        known = next((slots[id(n)] for n in reversed(path) if id(n) in slots), -1)
        body = next((i for i, n in enumerate(path[:3]) if n.tag == "body"), 0)
        branch = slots.get(id(path[body + 1]), -1) if len(path) > body + 1 else -1
        mine = own[id(owner), text] > 0
        own[id(owner), text] -= mine
        at = next((i for i, n in enumerate(path) if id(n) in records), -1)
        key, head = 0, False
        if at >= 0:  # its kind: where it hangs in the reference, and its label
            above = next((slots[id(n)] for n in reversed(path[:at]) if id(n) in slots), -1)
            key, head = _hash(f"{above} {path[at].label}") % (1 << 31) or 1, id(path[at]) not in begun
            begun.add(id(path[at]))
        out.append({"slot": known, "branch": branch, "text": text, "drop": drop, "own": mine, "linked": linked, "record": key, "head": head})
    return out, kind


@C.tidy
def _read(references: dict[str, str] | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(1 << 30)  # trees are as deep as pages make them
    for batch in batches:
        own = None if references is not None else batch.column("reference").to_pylist()
        rows: list[tuple] = []
        for i, (host, html) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)):
            tree = parse(html)
            _shape(tree)
            blocks, kind = _blocks(tree, align(tree, *_reference((own[i] if own else references.get(host)) or "")))
            rows.append((_hash("\n".join(b["text"] for b in blocks if b["own"])), kind, blocks))
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.record_batch([*(batch.column(c) for c in ("host", "page_id", "url")), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(BLOCK))], names=["host", "page_id", "url", "page", "kind", "blocks"])


def wrapper(tree: Node, mass: dict[int, float]) -> tuple[int, int, bool]:
    """The slots [lo, hi) of the node that holds most of the varying text, and whether it is an article or main part."""
    number = numbered(tree)
    nodes: list[tuple[Node, bool, bool]] = []
    todo = [(tree, False, False)]
    while todo:  # in the order of their numbers
        n, named, main = todo.pop()
        here = named or n.drop, main or n.main
        nodes.append((n, *here))
        todo += [(k, *here) for k in reversed(n.kids) if type(k) is Node]
    own = [mass.get(i, 0.0) * (1 / NAMED if named else NAMED if main else 1) for i, (_, named, main) in enumerate(nodes)]
    total = np.concatenate([[0.0], np.cumsum(own)])
    titles = np.concatenate([[0.0], np.cumsum([x if n.tag in ("h1", "h2") else 0.0 for x, (n, _, _) in zip(own, nodes, strict=True)])])
    end = {}
    for n, _, _ in reversed(nodes):
        end[id(n)] = max([number[id(n)] + 1, *(end[id(k)] for k in n.kids if type(k) is Node)])
    held = lambda n: total[end[id(n)]] - total[number[id(n)]]
    node = tree
    while node.tag not in ("article", "main"):
        kids = [k for k in node.kids if type(k) is Node and k.tag in _BLOCK and k.tag not in ("p", "ul", "ol")]
        best = max(kids, key=held, default=None)
        heading = any(type(k) is Node and k.tag in ("h1", "h2") and held(k) > 0 for k in node.kids)
        titled = [k for k in kids if titles[end[id(k)]] > titles[number[id(k)]]]
        if not heading and len(titled) == 1 and 3 * held(titled[0]) >= held(node):  # the one part with a heading, even where what stands beside it is long
            node = titled[0]
            continue
        if best is None or held(best) <= 0 or held(best) < MOST * held(node) or heading:
            break
        node = best
    return number[id(node)], end[id(node)], node.main


@C.tidy
def _wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(1 << 30)
    for batch in batches:
        made = []
        for html, slots in zip(batch.column("reference").to_pylist(), batch.column("slots").to_pylist(), strict=True):
            made.append(wrapper(parse(html), {s["slot"]: s["mass"] for s in slots or ()}))
        if made:
            cols = list(zip(*made, strict=True))
            yield pa.record_batch([batch.column("host"), batch.column("template"), batch.column("records"), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.bool_())], names=["host", "template", "records", "lo", "hi", "main"])


def _chosen(blocks: list[dict], kind: int, lo: int, hi: int, main: bool, template: set, records: set) -> list[dict]:
    inside = [b for b in blocks if lo <= b["slot"] < hi and not b["drop"] and (main or not b["linked"])]
    if not inside or kind == 2 and not any(b["own"] for b in inside):
        inside = [b for b in blocks if b["own"] and (kind or not b["linked"])]
    rest = [b for b in inside if b["record"] not in records]
    if any(len(b["text"]) >= 40 for b in rest):  # else the page is a list of records
        inside = rest
    varying = [b for b in inside if not template or (b["slot"], _hash(b["text"])) not in template]
    size = lambda some: sum(len(b["text"]) for b in some)
    return varying if 2 * size(varying) >= size(inside) else inside


@C.tidy
def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        columns = (batch.column(c).to_pylist() for c in ("blocks", "kind", "lo", "hi", "main", "template", "records"))
        for blocks, kind, lo, hi, main, template, records in zip(*columns, strict=True):
            known = {(t["slot"], t["words"]) for t in template or ()}
            texts.append("\n\n".join(b["text"] for b in _chosen(blocks, kind, lo or 0, hi or 0, bool(main), known, set(records or ()))))
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _by_host(pages: DataFrame, hosts: DataFrame, salt: list[str]) -> DataFrame:
    """A row of hosts beside each page; a large host's pages are dealt to SALTS parts."""
    dealt = pages.withColumn("salt", F.pmod(F.xxhash64(*salt), F.lit(SALTS)).cast("int"))
    copies = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, ["host", "salt"], "left").drop("salt")


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text: the blocks of the page's main text, white space made single, joined by two line breaks."""
    url = F.col("url").cast("string")
    host = F.coalesce(F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]*)", 1)), F.lit(""))
    df = pages.select(host.alias("host"), F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    first = df.groupBy("host").agg(F.min(F.struct("page_id", F.length("html").alias("n"), "html"))["html"].alias("reference"))
    size = first.agg(F.coalesce(F.sum(F.octet_length("reference") + 64), F.lit(0))).first()[0]
    references = {r["host"]: r["reference"] for r in first.collect()} if size <= BROADCAST else None
    aligned = df if references is not None else _by_host(df, first, ["page_id", "html"])
    read = C.stage(aligned.mapInArrow(functools.partial(_read, references), READ), "blocks")

    every = read.select("host", "page", "kind", F.explode("blocks").alias("b"))
    named = F.col("b.own") & (F.col("kind") == 2)
    # in one number: the text's length, whether some page has it in its own article, and whether some page has it outside of records
    mark = F.length("b.text").cast("long") * 4 + named.cast("long") * 2 + (F.col("b.record") == 0).cast("long")
    block = every.where("b.slot >= 0").select("host", "page", "b.slot", "b.branch", F.xxhash64("b.text").alias("words"), mark.alias("mark"))
    once = block.groupBy("host", "slot", "branch", "words", "page").agg(F.bit_or("mark").alias("mark"))
    texts = once.groupBy("host", "slot", "branch", "words").agg(F.count("*").alias("pages"), F.bit_or("mark").alias("mark"))
    texts = texts.select("host", "slot", "branch", "words", "pages", F.shiftright("mark", 2).alias("n"), (F.col("mark").bitwiseAND(2) > 0).alias("named"), (F.col("mark").bitwiseAND(1) == 0).alias("record"))
    reach = C.stage(block.select("host", "branch", "page").distinct().groupBy("host", "branch").agg(F.count("*").alias("all")), "reach")
    if reach.agg(F.coalesce(F.sum(F.octet_length("host") + 32), F.lit(0))).first()[0] <= BROADCAST:  # a join would gather a large host's texts
        reach = F.broadcast(reach)
    share, n = F.col("pages") / F.col("all"), F.col("all")
    sure = (share + 2 / n - 2 * F.sqrt(share * (1 - share) / n + 1 / (n * n))) / (1 + 4 / n)
    judged = texts.join(reach, ["host", "branch"]).withColumn("constant", (share >= CONSTANT) & (sure >= SURE) | (share >= 1) & (n >= FEW) & ~F.col("named"))
    slots = judged.groupBy("host", "slot").agg(F.sum(F.when(~F.col("constant") & ~F.col("record"), F.col("n") * F.col("pages")).otherwise(0)).cast("double").alias("mass"))
    slots = slots.groupBy("host").agg(F.collect_list(F.struct("slot", "mass")).alias("slots"))
    template = judged.where("constant").groupBy("host").agg(F.collect_list(F.struct("slot", "words")).alias("template"))
    # records whose number varies from page to page are comments or teasers
    counted = every.where("b.record <> 0").groupBy("host", "page", F.col("b.record").alias("record")).agg(F.sum(F.col("b.head").cast("int")).alias("c"))
    spread = counted.groupBy("host", "record").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("on"))
    pages_of = read.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("all"))
    listed = spread.join(pages_of, "host").where(f"hi > 1 AND all >= {FEW} AND (lo < hi OR on < all)")
    listed = listed.groupBy("host").agg(F.collect_list("record").alias("records"))
    kind = "array<struct<slot:int,words:bigint>>"
    known = first.join(slots, "host", "left").join(template, "host", "left").join(listed, "host", "left")
    wrappers = C.stage(known.mapInArrow(_wrap, f"host string, template {kind}, records array<int>, lo int, hi int, main boolean"), "wrappers")
    small = wrappers.agg(F.coalesce(F.sum(F.coalesce(F.size("template"), F.lit(0)) * 16 + F.coalesce(F.size("records"), F.lit(0)) * 8 + F.octet_length("host") + 64), F.lit(0))).first()[0] <= BROADCAST
    met = read.join(F.broadcast(wrappers), "host", "left") if small else _by_host(read, wrappers, ["page_id", "page"])
    return met.select("page_id", "url", "blocks", "kind", "lo", "hi", "main", "template", "records").mapInArrow(_write, "page_id long, url string, text string")
