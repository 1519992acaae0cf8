"""Main text of pages by trees that learn from marked pages: fixtures that mark nothing, ablation, odd and long input."""

import random
import time

import numpy as np
import pytest

from netloom.llm import html_extract
from netloom.llm.boosting import Trees
from netloom.llm.html_tree import parse

COUNCIL = "The town council met on Monday to talk about the bridge, which has been closed since the spring. Engineers found cracks in two piers."
SHORT = "Repairs will take longer than was hoped, and cost more."
ONE = f"Bridge closed\n{COUNCIL}\n{SHORT}"
BODY = f"<h1>Bridge closed</h1><p>{COUNCIL}</p><p>{SHORT}</p>"
PAGES = {
    "marked": (f"<html><body><nav><a href=/>Home</a></nav><article>{BODY}</article><footer>foot</footer></body></html>", ONE),
    "wrapper named after what it lacks": (f"<html><body><div class='container has-sidebar'><div class=post>{BODY}</div><div class=sidebar><h3>Popular</h3><ul><li><a href=1>One thing</a><li><a href=2>Another</a></ul></div></div></body></html>", ONE),
    "headings named like clutter": (f"<html><body><nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav><div>{BODY}<h2 id=discussion>Discussion</h2><p>{COUNCIL}</p></div><footer>Imprint</footer></body></html>", f"{ONE}\nDiscussion\n{COUNCIL}"),
    "table layout": (f"<html><body><table><tr><td><a href=a>A</a><br><a href=b>B</a><br><a href=c>C</a></td><td>{BODY}</td></tr></table></body></html>", ONE),
    "fluent comments": (f"<html><body><div>{BODY}</div><div class=comments><div class=comment><p>{COUNCIL}</p></div><div class=comment><p>I cross it every day.</p></div></div></body></html>", ONE),
    "form and advert inside": (f"<html><body><main><h1>Bridge closed</h1><p>{COUNCIL}</p><div class=ad>Buy a boat now, cheap boats.</div><p>{SHORT}</p><form><label>Mail</label><input><button>Send</button></form></main></body></html>", ONE),
}


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["ta", "ro", "mi", "lu", "so", "den"]) for _ in range(rng.randint(1, 3)))
    said = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    page = lambda: f"<html><head><title>{said(3)}</title><style>p{{}}</style></head><body><nav><ul>" + "".join(f"<li><a href=x>{word()}</a></li>" for _ in range(5)) + f"</ul></nav><div class=ad>{said(9)}</div><article><h1>{said(5)}</h1>" + "".join(f"<p>{said(rng.randint(4, 60))}" for _ in range(rng.randint(1, 9))) + f"</article><footer>{said(8)}</footer></body></html>"
    return spark.createDataFrame([(i, None if i % 5 else f"u{i}", page()) for i in range(130)], "page_id long, url string, html string").cache()


@pytest.fixture(scope="module")
def trees(marked):
    return html_extract.fit(marked)


@pytest.mark.parametrize("name", PAGES)
def test_pages_by_hand(trees, name):
    page, text = PAGES[name]
    assert html_extract.main_text(page, trees) == text


def test_trees_decide(trees):
    """With silent trees every text changes: no list of words or tags says anything of its own."""
    silent = Trees(trees.features, trees.thresholds, trees.leaves * 0)
    assert all(html_extract.main_text(page, silent) != text for page, text in PAGES.values())


def test_text_and_markup(trees):
    hard = """<body><div class="cookie-notice">We use cookies</div><header><h2>Site</h2></header><main><article><h1>A&nbsp;title</h1><p>First <b>bold</b>
      text<br>on.</p><aside class=related>See also</aside><ul><li>one<li>two</ul><form><input>Subscribe</form></article>
      <section id="comments"><p>Nice post, thanks for it, really.</p></section></main><div class="sidebar"><p>Links</p></div><script>x("<p>")</script></body>"""
    assert html_extract.main_text(hard, trees) == "A title\nFirst bold text on.\none\ntwo"
    assert [html_extract.main_text(p, trees) for p in (None, "")] == ["", ""]
    assert all(isinstance(html_extract.main_text(p, trees), str) for p in ("<p", "<<>>", "</b>" * 9, "<div>" * 5000, "<article></article>"))
    keep = html_extract.decode([-1, 0, 1, 0], np.array([0.1, -1.0, 3.0, -2.0]))
    assert keep.tolist() == [True, True, True, False]


def test_rows_of_any_kind(spark, marked, trees):
    rows = [(1, "u", PAGES["marked"][0]), (1, "u", PAGES["marked"][0]), (None, None, PAGES["marked"][0]), (2, None, None), (3, "", "")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = [r.t for r in pages.select(html_extract.extracted(trees).alias("t")).collect()]
    assert got == [ONE, ONE, ONE, "", ""]
    assert html_extract.fit(marked.limit(0)).leaves.any() == False and pages.limit(0).select(html_extract.extracted(trees)).count() == 0  # noqa: E712


@pytest.mark.parametrize("page", ["<b>" * 60_000 + "</i>" * 60_000, "<div>" * 20_000 + "</section>" * 20_000, "<div>" + "<b>" * 30_000 + "<hr>" * 30_000, "<ul><li>" + "<div>" * 5000 + "<li>x" * 20_000, "<select>" + "<div>" * 20_000 + "<option></option>" * 20_000])
def test_parser_is_linear(page):
    began = time.time()
    parse(page)
    assert time.time() - began < 5


def test_parser_ends_what_it_should():
    shape = lambda x: x if isinstance(x, str) else (x.tag, *map(shape, x.content))
    assert shape(parse("<ul><li>a<b>b<li>c<ul><li>d</ul>e</ul>f")) == ("#root", ("ul", ("li", "a", ("b", "b")), ("li", "c", ("ul", ("li", "d")), "e")), "f")
    assert shape(parse("<p>a<i>b<div>c</i>d</div>e</p>f")) == ("#root", ("p", "a", ("i", "b")), ("div", "c", "d"), "e", "f")
    assert shape(parse("<table><tr><td>1<td>2<tr><td>3</table>")) == ("#root", ("table", ("tr", ("td", "1"), ("td", "2")), ("tr", ("td", "3"))))
