"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is read tag by tag with a stack of open elements, as HTML's implied end tags have it, and cut to blocks of text at
block-level tags. A block's features are its words and link density and those of its neighbours, what it stands in (a
heading, an article, an element for furniture, one whose class, id or role has words that furniture often or sometimes
has), and whether the page has an article. No name decides alone: the tree is grown by Gini impurity from the labelled
blocks of the layouts below, and weighs names with the rest.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.shared import lean

#: Elements without content; elements whose content is no markup; elements whose content isn't text of the page.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
SILENT = frozenset("audio button canvas datalist math noscript object select svg template video".split())
#: Elements that begin and end blocks.
BLOCK = frozenset(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Block-level tags without an element of their own here.
PAGE = frozenset(("html", "head", "body"))
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset("aside dialog footer form header menu nav".split())
#: What a start tag ends if it is open, and what it is looked for through (None: through all but tables).
ENDS = {
    "li": (frozenset(["li"]), frozenset("address div p".split())), **dict.fromkeys(("dd", "dt"), (frozenset(("dd", "dt")), frozenset("address div p".split()))),
    **dict.fromkeys(("td", "th"), (frozenset(("td", "th")), None)), "tr": (frozenset(["tr"]), None), **dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset(("tbody", "thead", "tfoot", "caption")), None)),
}
#: End tags of other elements don't reach beyond these.
SCOPE = frozenset("caption table td th".split())
TABLE = frozenset("caption table tbody td tfoot th thead tr".split())
#: Words in class, id or role: of the page's layout; of what is put on pages; that content has as well.
LAYOUT = frozenset("banner contentinfo footer header masthead menu menubar nav navbar navigation sidebar toolbar topbar".split())
ADDED = frozenset(
    "ad ads advert advertisement adverts breadcrumb breadcrumbs comment comments consent cookie cookies disqus gdpr modal newsletter outbrain pager pagination popup promo promoted "
    "signup skip sponsor sponsored subscribe taboola".split()
)
MAYBE = frozenset("byline copyright disclaimer legal login meta notice recommended related replies reply share sharing social tags toc widget".split())
REMARK = frozenset("comment comments reply replies".split())

NAME = r"[a-zA-Z][^\s/>]*"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)({NAME})((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)({NAME})([^<>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)\b(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPACES = re.compile(r"\s+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}


@dataclass
class Block:
    text: str
    words: int
    density: float  # share of the words that are in links
    heading: bool
    article: bool
    furniture: bool
    layout: bool
    added: bool
    maybe: bool


def marks(tag: str, attributes: str) -> tuple[bool, bool, bool, bool, bool]:
    """Whether an element is for furniture or hidden, its words of LAYOUT, ADDED and MAYBE, and whether it is a reader's remark."""
    furniture = tag in FURNITURE
    said: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            said.update(re.split(r"[^a-z]+", re.sub("([a-z])([A-Z])", r"\1-\2", value).lower()))
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            furniture = True
    return furniture, not LAYOUT.isdisjoint(said), not ADDED.isdisjoint(said), not MAYBE.isdisjoint(said), not REMARK.isdisjoint(said)


@dataclass
class Tag:
    """A tag of the page, and the text between it and the next one."""

    name: str
    end: bool
    attributes: str
    empty: bool
    text: str
    closed: bool = False  # its end tag follows
    holds: str = ""  # of the page's first article, main and h1, those that stand in it


def tags(page: str) -> list[Tag]:
    """The page's tags in order; the first stands for the page itself. Comments, declarations and raw content are left out."""
    found, at = [Tag("", False, "", True, "")], 0
    while m := TOKEN.search(page, at):
        found[-1].text += html.unescape(page[at : m.start()])
        at = m.end()
        if name := (m[2] or m[5] or "").lower():
            end, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
            found.append(Tag(name, end, attributes, attributes.endswith("/"), ""))
            if name in RAW and not end:
                if close := RAW_END[name].search(page, at):
                    at = close.end()
                elif name not in ("textarea", "title"):  # those two end with their line
                    at = len(page)
                else:
                    at = page.find("<", at) if "<" in page[at:] else len(page)
        else:
            found.append(Tag("", False, "", True, ""))  # the texts on both sides are texts of their own
    found[-1].text += html.unescape(page[at:])
    return found


class Open:
    """The open block-level and silent elements."""

    def __init__(self) -> None:
        self.stack: list[Tag] = []
        self.count: Counter[str] = Counter()
        self.scopes: list[Counter[str]] = [Counter()]  # the same, within each open element of SCOPE

    def pop(self) -> Tag:
        tag = self.stack.pop()
        if tag.name in SCOPE:
            self.scopes.pop()
        self.count[tag.name] -= 1
        self.scopes[-1][tag.name] -= 1
        return tag

    def push(self, tag: Tag) -> None:
        self.stack.append(tag)
        self.count[tag.name] += 1
        self.scopes[-1][tag.name] += 1
        if tag.name in SCOPE:
            self.scopes.append(Counter())

    def implied(self, name: str) -> int:
        """How many elements a start tag ends."""
        size = len(self.stack)
        top = self.stack[-1].name if size else ""
        k = size - (top == "p" or top in HEADING and name in HEADING)
        if name in ENDS:
            those, through = ENDS[name]
            if any(self.count[x] for x in those):
                for i in range(k - 1, -1, -1):
                    if self.stack[i].name in those:
                        return size - i
                    if self.stack[i].name == "table" if through is None else self.stack[i].name not in through:
                        break
        return size - k

    def ended(self, name: str) -> int:
        """How many elements an end tag ends, its own the last; 0 if it has none."""
        if (self.count if name in TABLE else self.scopes[-1])[name]:
            return next(n for n, tag in enumerate(reversed(self.stack), 1) if tag.name == name)
        return 0


def matched(found: list[Tag]) -> None:
    """Sets closed and holds."""
    known, first = Open(), dict.fromkeys(("article", "main", "h1"), True)
    for tag in found:
        if tag.end:
            if n := known.ended(tag.name):
                for k in range(n):
                    known.pop().closed = k == n - 1
        elif tag.name in BLOCK or tag.name in SILENT and not tag.empty:
            if tag.name in BLOCK:
                for _ in range(known.implied(tag.name)):
                    known.pop()
            if first.get(tag.name) and not (tag.name == "article" and marks(tag.name, tag.attributes)[4]):
                first[tag.name] = False
                for t in known.stack:
                    t.holds += tag.name + " "
            if tag.name != "hr":
                known.push(tag)


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order."""
    found, seen, known = tags(page), [], Open()
    matched(found)
    pieces: list[tuple[str, bool]] = []
    state = [(False, False, False, False, False, False, False)]  # heading, article, furniture, layout, added, maybe, silent: of all that is open
    link = 0  # 1 + the number of elements that were open where the open link began

    def close() -> None:
        if pieces:
            text = SPACES.sub(" ", "".join(p for p, _ in pieces)).strip()
            if text:
                linked, n = len(" ".join(p for p, in_link in pieces if in_link).split()), len(text.split())
                seen.append(Block(text, n, min(1.0, linked / n), *state[-1][:6]))
            pieces.clear()

    def pop(n: int) -> None:
        nonlocal link
        for _ in range(n):
            known.pop()
            state.pop()
        if link > len(known.stack) + 1:
            link = 0

    for tag in found:
        block = tag.name in BLOCK or tag.name in PAGE
        if block:
            close()
            while known.stack and known.stack[-1].name in SILENT and not known.stack[-1].closed:
                pop(1)  # without an end tag, such an element ends here
        if tag.name == "br":
            pieces.append((" ", link > 0))
        elif tag.name == "a":
            link = 0 if tag.end else len(known.stack) + 1
        elif tag.end and (block or tag.name in SILENT):
            pop(known.ended(tag.name))
        elif tag.name in BLOCK or tag.name in SILENT and not tag.empty:
            if block:
                pop(known.implied(tag.name))
            if tag.name != "hr":
                heading, article, furniture, layout, added, maybe, silent = state[-1]
                f, la, ad, ma, remark = marks(tag.name, tag.attributes)
                if tag.name == "header" and (article or "h1" in tag.holds) or tag.name == "form" and tag.holds:
                    f = False
                if tag.name == "main" or tag.holds:
                    la = False
                if tag.name == "main" or tag.name == "article" and not remark or "main" in tag.holds or "article" in tag.holds:
                    la = ad = ma = False
                own = tag.name in ("article", "main") and not remark
                state.append((tag.name in HEADING, article or own, furniture or f, layout or la, added or ad, maybe or ma, silent or tag.name in SILENT))
                known.push(tag)
        if tag.text and not state[-1][6]:
            pieces.append((tag.text, link > 0))
    close()
    return seen


#: Features of a block, in the order of features().
FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "heading", "article", "furniture", "layout", "added", "maybe", "page has article", "most words")


def features(found: list[Block]) -> np.ndarray:
    has = any(b.article for b in found)
    most = max((b.words for b in found if b.density < 0.5 and not b.furniture), default=0)
    edge = Block("", 0, 0.0, *[False] * 6)
    rows = [
        (b.words, b.density, p.words, p.density, n.words, n.density, b.heading, b.article, b.furniture, b.layout, b.added, b.maybe, has, most)
        for p, b, n in zip([edge, *found][:-1], found, [*found, edge][1:], strict=True)
    ]
    return np.array(rows, np.float64).reshape(-1, len(FEATURES))


MENU = "<ul><li><a>w1</a><li><a>w2</a><li><a>w1</a></ul>"
#: Layouts of pages, wN standing for N words, and for each block in order 1 if it is main text.
LAYOUTS = (
    # an article, with menus, adverts and the like outside
    (f"<nav>{MENU}</nav><div class=ad>w7</div><article><h1>w8</h1><p>w8<br><p>w60<p>w45</p></article><footer>w9</footer>", "0000" "1111" "0"),
    (f"<nav>{MENU}</nav><div class=ad>w40</div><article><h1>w3</h1><p>w60<p>w3<p>w90<p>w12 <a>w9</a><ul><li>w1<li>w6<li><a>w2</a></ul></article><footer>w30 <a>w2</a></footer>", "0000" "11111111" "0"),
    (f"<header><a>w2</a>{MENU}</header><main><h1>w14</h1><p>w120<h2>w2</h2><p>w25 <a>w9</a><blockquote>w30</blockquote><pre>w40</pre><table><tr><td>w1<td>w4</table></main><aside><h3>w2</h3><p>w40</p></aside><footer>w8</footer>", "0000" "11111111" "00" "0"),
    (f"<div>w3</div><div>w15</div><article><p>w20<p>w2<p><a>w5</a><p>w300</article><p>w90<div>w6</div><div><a>w30</a> w3</div>", "00" "1111" "000"),
    (f"<a>w3</a><div><a>w1</a></div><p>w40<article><h2>w5</h2><p>w45</article><h3>w2</h3><p>w80<p>w60", "000" "11" "000"),
    (f"<article><p>w7</p></article><div>w8</div>", "1" "0"),
    (f"<nav>{MENU}</nav><article><h1>w5</h1><p>w60<ul><li><a>w4</a><li><a>w6</a><li><a>w2</a></ul></article><footer><a>w2</a></footer>", "000" "11111" "0"),
    (f"<main><p>w40<p><a>w8</a></main><div><a>w2</a> <a>w1</a></div>", "11" "0"),
    (f"<article><h2><a>w6</a></h2><p>w30<p><a>w3</a><p>w50<p>w5 <a>w9</a></article><div>w4 <a>w7</a></div>", "11111" "0"),
    (f"<form><div class=top><a>w2</a></div><article><h1>w4</h1><p>w50<p>w30</article></form>", "0" "111"),
    # furniture in an article
    (f"<article><header><h1>w6</h1></header><p>w60<aside>w40</aside><p>w45<div class=share><a>w1</a> <a>w1</a></div><div class=advert><p>w60</p></div><p>w4<form>w12 <p>w50</form><p>w9</article>", "11" "0" "1" "00" "1" "00" "1"),
    (f"<article><h1>w5</h1><p>w80<div class='newsletter'><p>w25</div><p>w30<section class=comments><h3>w1</h3><div><p>w5<p>w70</div></section></article><footer>w20</footer>", "11" "0" "1" "000" "0"),
    (f"<article><h1>w5</h1><p>w70<div class=related><h4>w2</h4><ul><li><a>w8</a><li><a>w9</a></ul></div><nav><a>w2</a></nav><footer>w6</footer></article>", "11" "000" "0" "0"),
    (f"<main><h1>w4</h1><p>w55<div class=social>w4</div><div class=tags><a>w1</a> <a>w2</a></div><div class=popup><h2>w4</h2><p>w15</div><p>w35</main>", "11" "0" "0" "00" "1"),
    (f"<article><h1>w4</h1><div class=toc>{MENU}</div><p>w40<div class=notice><p>w8</div><p>w50</article>", "1" "000" "1" "0" "1"),
    # names that content has as well
    (f"<div class=share><h2>w3</h2><p>w60</div>", "11"),
    (f"<nav>{MENU}</nav><div><h1>w4</h1><p>w70</p><div class=related><h2>w2</h2><p>w60<p>w45</div></div>", "000" "11" "111"),
    (f"<article><h1>w3</h1><p>w50<div class=related><h2>w2</h2><p>w80<p>w40</div><div class=legal><p>w60</div></article>", "11" "111" "1"),
    (f"<div class=notice><h1>w4</h1><p>w30<p>w40</div>", "111"),
    (f"<div class=meta>w4</div><h1>w5</h1><p>w60<div class=share>w4</div><div class=copyright>w8</div>", "0" "11" "0" "0"),
    (f"<h1>w5</h1><p>w60<p>w30<div class=recommended><p><a>w9</a><p><a>w7</a></div>", "111" "00"),
    # pages without an article
    (f"<div id=header><h1><a>w3</a></h1><p>w6</div><div id=nav>{MENU}</div><div><h2>w6</h2><p>w80<p>w3<blockquote>w20</blockquote><ul><li>w6<li>w9</ul><p>w50</div><div id=sidebar><h3>w2</h3>{MENU}<p>w30</div><div id=footer>w12</div>", "00" "000" "1111111" "00000" "0"),
    (f"<div><a>w1</a></div><div><a>w2</a> | <a>w1</a></div><h1>w1</h1><p>w60<p><a>w5</a><p>w50", "00" "11" "0" "1"),
    (f"{MENU}<h2>w1</h2><p>w60<p>w40<div class=cookie><p>w70</div>", "000" "111" "0"),
    (f"<table><tr><td><a>w1</a><br><a>w2</a><td><h2>w4</h2><p>w70<p>w40<p>w6<td class=ads>w12</table>", "0" "1111" "0"),
    (f"<div><a>w40</a></div><h2>w1</h2><p>w60 <a>w9</a><p>w7<p>w80<div><a>w3</a> <a>w4</a></div>", "0" "1111" "0"),
    (f"<div>w2</div><div><a>w1</a> <a>w1</a></div><div><h2>w6</h2>w70<br>w30<h3>w3</h3>w45</div><div>w5 <a>w3</a></div>", "00" "1111" "0"),
    (f"<p>w60<p>w45<p>w120<p><a>w2</a><p>w25<p>w18 <a>w2</a><p>w70", "111" "0" "111"),
    (f"<h1>w7</h1><p>w30 <a>w6</a><p>w16<p>w35<p>w9<p>w70<p>w5<p>w55<h2>w2</h2><p>w45", "1111111111"),
    (f"<div class=masthead><h1>w2</h1><p>w5</div><div class=navbar>{MENU}</div><p>w90<p>w25<div class=sidebar><p>w60<p>w3</div>", "10" "000" "11" "00"),
    (f"<div class=breadcrumbs><a>w1</a> w3</div><h1>w3</h1><p>w35<p>w50<div class=pagination><a>w1</a> <a>w1</a></div><div class=comments><p>w40<p>w6</div>", "0" "111" "0" "00"),
    (f"<div class=promo><h2>w4</h2><p>w20</div><h1>w6</h1><p>w45<p>w60<aside><p>w35</aside><form><p>w12</form><footer><p>w25</footer>", "00" "111" "0" "0" "0"),
    (f"<dl><dt>w2<dd>w30<dt>w1<dd>w25</dl><div><a>w6</a></div>", "1111" "0"),
    # short pages
    ("<h1>w1</h1><p>w7", "11"), ("<p>w7", "1"), ("<p>w17", "1"), ("w60", "1"), ("<h1>w4</h1><p>w12<p>w5", "111"), ("<h2>w2</h2><p>w4<p>w9<p>w3", "1111"), ("<div>w3</div>", "1"), ("<p>w1<p>w60", "11"),
    ("<div><a>w1</a> <a>w1</a></div><h1>w3</h1><p>w9", "0" "11"), (f"{MENU}<p>w8<p>w6", "000" "11"), ("<nav>w2</nav>", "0"), ("<footer>w30</footer>", "0"), (f"{MENU}", "000"), ("<h1>w3</h1><p>w10<p><a>w2</a><footer>w4</footer>", "11" "0" "0"),
    ("<div class=ad>w20</div><p>w12", "0" "1"), ("<h1>w5</h1><p>w15 <a>w4</a><p>w8<div class=comment><p>w9</div>", "111" "0"),
)


#: Each layout is taken with its longer texts at these lengths, so that no bound hangs on a number above.
LENGTHS = (0.4, 0.7, 1, 1.7, 3, 9)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the layouts' blocks."""
    x, y = [], []
    for page, said in LAYOUTS:
        for length in LENGTHS:
            size = lambda n: n if n < 12 else max(12, round(n * length))  # noqa: B023, E731
            found = blocks(re.sub(r"\bw(\d+)\b", lambda m: " ".join(["word"] * size(int(m[1]))), page))
            if len(found) != len(said):
                raise ValueError(f"{len(found)} blocks, {len(said)} labels: {page}")
            x.append(features(found))
            y += map(int, said)
    return np.concatenate(x), np.array(y, float)


#: A leaf of the tree has so many blocks.
LEAF = 5


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10) -> tuple | float:
    """(feature, bound, at most, above) or the share of main text."""
    if depth == 0 or y.min() == y.max():
        return float(y.mean())
    best: tuple[float, int, float] | None = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bound in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= bound
            if min(left.sum(), (~left).sum()) < LEAF:
                continue
            impure = sum(s.sum() * p.mean() * (1 - p.mean()) for s, p in ((left, y[left]), (~left, y[~left])))
            if best is None or impure < best[0] - 1e-12:
                best = impure, f, float(bound)
    if best is None:
        return float(y.mean())
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


def classify(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    left = x[:, tree[0]] <= tree[1]
    return np.where(left, classify(tree[2], x), classify(tree[3], x))


TREE = grow(*labelled())


def main_text(page: str) -> str:
    found = blocks(page)
    keep = classify(TREE, features(found)) >= 0.5
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars.

    A null or empty page, and one without main text, has text "". A reference without an end is decoded where HTML
    allows it and stays otherwise. Rows of equal page_id, and repeated rows, are extracted each by itself; a block whose
    leaf of the tree has as many of both kinds is main text. Pages of any length are read whole, one at a time: a worker
    holds a page's tags and blocks. An empty table gives an empty result. Columns other than page_id, url and html aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [main_text(p or "") for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_pydict({"page_id": part.column(0), "url": part.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
