"""Pages with known main text, and random pages against how they were built."""

from __future__ import annotations

import html
import random

import pytest

from folium.llm import html_text
from folium.llm.queries import op6_html_text
from tests.llm.conftest import prose

LONG = prose(60, 1)
PAGES = {
    "": "",
    "plain words only, without any markup but of some length, so that they are the text of this page": "plain words only, without any markup but of some length, so that they are the text of this page",
    f"<nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>x  <b>y</b>\n z<p>{LONG}</article><footer>&copy; me</footer>": f"A & B\nx y z\n{LONG}",
    f"<html><head><title>t</title><style>p{{}}</style></head><body><script>var t='</p><p>no';</script><div class='ad'>{LONG}</div><article><p>{LONG}</p></article></body>": LONG,
    f"<article><p>{LONG}</p><aside>{LONG}</aside><div class='x comments'><p>{LONG}</p></div><form><p>{LONG}</p></form><p>end</p></article>": f"{LONG}\nend",
    f"<article><header><h1>Title</h1></header><p>{LONG} &lt;b&gt; &am; &quot;q&quot; &#233;&eacute;</p><!-- <p>gone</p> -->": f'Title\n{LONG} <b> &am; "q" éé',
    f"<body><ul class=menu><li><a href=a>One</a><li><a href=b>Two</a></ul><h2>Head</h2><p>{LONG}</p><p>{prose(40, 2)}</p><div id='cookie-notice'>We use cookies {LONG}</div></body>": f"Head\n{LONG}\n{prose(40, 2)}",
    f"<article><p>{LONG}<br>{LONG}</p><p title=\"a > b\">q</p></article": f"{LONG} {LONG}\nq",
    f"<article><p>{LONG}</p><p>cut &amp": f"{LONG}\ncut &",
    "<article></article><nav>only this</nav>": "",
    f"<div><a href=/>Home</a></div><div><a href=/a>About us</a> | <a href=/b>More</a></div><h1>T</h1><p>{LONG}</p><p><a href=c>Read the next one</a></p><p>{LONG}</p>": f"T\n{LONG}\n{LONG}",
    f"<div>Site of things and more words</div><article><p>{LONG}</p></article><p>{LONG}</p>": LONG,
    f"<div><a href=x><div>{LONG}</div></a></div><h2>T</h2><p>{LONG}</p>": f"T\n{LONG}",
    f"<body class='has-sidebar fixed-header'><div class='main-content with-sidebar'><h1>T</h1><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div>": f"T\n{LONG}",
    f"<article><div class=entry-header><h1>T</h1></div><p class='advert'>{LONG}</p><p>{LONG}</p><section id=comments><article class=comment><p>{LONG}</p></article></section></article>": f"T\n{LONG}",
    f"<article><P CLASS=lead>{LONG}</P><SCRIPT>no": LONG,
    # tags that may be left out, custom elements, elements without an end
    f"<html><head><title>x</title><p>{LONG}</p></html>": LONG,
    f"<title>x</title><meta charset=utf-8><h1>T</h1><p>{LONG}": f"T\n{LONG}",
    f"<body><button-group><a href=x>x</a></button-group><p>{LONG}</p>": LONG,
    f"<svg-icon></svg-icon><p>{LONG}</p>": LONG,
    f"<svg/><p>{LONG} <svg class='i'/> and <svg><title>no</title><path></svg>more</p>": f"{LONG} and more",
    f"<div><button>Menu</div><p>{LONG}</p>": LONG,
    f"<button>Menu<p>{LONG}</p>": LONG,
    f"<p>{LONG}<select><option>a<option>b<p>{LONG}": f"{LONG}\n{LONG}",
    f"<ul class=menu><li><a href=a>One</a><li><a href=b>Two</a></ul><table><tr><td>{LONG}<td class=sidebar>{LONG}<tr><td>{LONG}</table>": f"{LONG}\n{LONG}",
    f"<article><p>{LONG}<ul><li class=share>Tell your friends<li>last</ul></article>": f"{LONG}\nlast",
    f"<article><p>a&am<b>p;</b> {LONG}</p></article>": f"a&amp; {LONG}",
    # names that don't decide alone
    f"<div class='share-price-report'><h2>Shares this week</h2><p>{LONG}</p></div>": f"Shares this week\n{LONG}",
    f"<h1>Paper</h1><p>{LONG}</p><div id='related-work'><h2>Related work</h2><p>{LONG}</p></div>": f"Paper\n{LONG}\nRelated work\n{LONG}",
    f"<form id=aspnet><div class=top><a href=/>Home</a></div><article><h1>T</h1><p>{LONG}</p></article></form>": f"T\n{LONG}",
    # pages without an article
    "<body><h1>Title</h1><p>Short news of seven words here now.</p></body>": "Title\nShort news of seven words here now.",
    f"<div id=header><a href=/>Site</a></div><div id=content><h2>Head</h2><p>{LONG}</p><p>Short.</p></div><div id=comments><p>{LONG}</p></div><div id=footer>Made by us</div>": f"Head\n{LONG}\nShort.",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert html_text.main_text(page) == PAGES[page]


def test_tree_learns_its_table():
    x, y = html_text.labelled()
    assert ((html_text.classify(html_text.TREE, x) >= 0.5) == y).mean() >= 0.99


def test_rows(spark):
    rows = [(1, "u", p) for p in PAGES] + [(None, None, None), (2, "u", f"<article>{'<p>word</p>' * 20_000}"), (3, "u", "<div>" * 5_000 + "x"), (4, "u", "<p '" * 2_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = html_text.extract(df).collect()
    assert [r.text for r in got[: len(PAGES)]] == list(PAGES.values()) and all(r.n_chars == len(r.text) for r in got)
    assert got[len(PAGES)].text == "" and got[len(PAGES) + 1].text.count("\n") == 19_999
    assert html_text.extract(df.limit(0)).collect() == []


WORDS = prose(20, 3).split()


def built(seed: int) -> tuple[str, str]:
    """A page and its main text: an article or main of paragraphs, headings and lists, with end tags left out at random,
    custom elements, silent elements and furniture in between and around."""
    r = random.Random(seed)
    known = ["été", "a<b", "x&y", '"q"', "word", *WORDS]
    said = lambda n: [r.choice(known) for _ in range(n)]
    shown = lambda words: r.choice([" ", "\n ", " \t", "<!-- <p> -->\u0020"]).join(r.choice([html.escape(w), f"<b>{html.escape(w)}</b>", f"<x-mark>{html.escape(w)}</x-mark>", html.escape(w)]) for w in words)
    menu = lambda: "<ul>" + "".join(f"<li><a href='/{k}'>{shown(said(r.randint(1, 3)))}</a>" + r.choice(["</li>", ""]) for k in range(r.randint(2, 5))) + "</ul>"
    inside = ["<script>var a = '</p><p>';</script>", "<svg class='i'/>", "<icon-set></icon-set>", "<button>Press</button>", "<div class='advert'><p>{}</p></div>", "<aside><p>{}</aside>", "<nav>{menu}</nav>", "<form><p>{}<input></form>", "<!-- <p>no</p> -->", "<section class='comments'><p>{}</p><p>{}</section>", "<style>p{{}}</style>"]
    around = ["<nav>{menu}</nav>", "<header>{menu}</header>", "<div class='cookie-notice'><p>{}</p></div>", "<div id=sidebar>{menu}<p>{}</div>", "<footer>{}</footer>", "<div class=ad>{}</div>"]
    put = lambda kinds: r.choice(kinds).replace("{menu}", menu()).replace("{}", shown(said(r.randint(3, 40)))).replace("{{}}", "{}")
    body, want = [], []
    for k in range(r.randint(2, 9)):
        words = said(r.randint(25, 60) if k == 1 else r.randint(2, 50))
        tag = "h1" if not k else r.choice(["p", "p", "p", "h2", "li", "blockquote"])
        body.append(f"<{tag}>{shown(words)}" + (r.choice(["", "</p>"]) if tag == "p" else "" if tag == "li" and r.random() < 0.5 else f"</{tag}>"))
        want.append(" ".join(words))
        if r.random() < 0.4:
            body.append(put(inside))
    main = r.choice(["article", "main"])
    page = "".join([r.choice(["", "<!DOCTYPE html><html>"]), r.choice(["", "<head><title>no</title></head>", "<title>no</title>"]), r.choice(["", "<body>"]), *[put(around) for _ in range(r.randint(0, 3))]])
    return page + f"<{main}>" + "".join(body) + f"</{main}>" + "".join(put(around) for _ in range(r.randint(0, 3))), "\n".join(want)


def test_built_pages(spark, tmp_path):
    made = [built(seed) for seed in range(400)]
    rows = [(k, f"u{k}", page) for k, (page, _) in enumerate(made)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in op6_html_text(spark, str(tmp_path)).collect()}
    wrong = [(made[k], got[k].text) for k in range(400) if got[k].text != made[k][1]]
    assert not wrong, (len(wrong), wrong[0])
    assert all(got[k].n_chars == len(made[k][1]) and got[k].url == f"u{k}" for k in got)


def test_time_is_linear_in_odd_markup():
    for odd in ("<div>" * 20_000, "<li>" * 20_000, "<div><td>" + "<section>" * 9_000 + "</div>" * 9_000, "<p a=\"" * 9_000, "<a" * 20_000, "<svg>" * 9_000, "<textarea>" * 9_000):
        html_text.main_text(odd)
