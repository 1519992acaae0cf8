"""Main text of web pages: boosted trees score every element, and a decoding over the tree picks what to keep.

The trees see an element's text density, links, depth, siblings, tag and the words of its attributes, and the same
of what is around it. They learn from pages that mark their article, and from those pages laid out anew: the article
in unmarked wrappers, among menus, notices, adverts, forms and comments made from the page's own words. No word or
tag decides anything by itself; decoding keeps the elements with the largest sum of margins such that whatever is
kept has its parent kept.
"""

from __future__ import annotations

import random
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm import boosting
from netloom.llm.common import table
from netloom.llm.html_tree import BLOCK, RAW, Node, parse

#: What the attribute words and tags of pages mean, as features and for pages that are laid out anew.
WORDS = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs pagination skip toolbar topbar toc",
    "edge": "header masthead banner footer copyright contentinfo disclaimer login signin register",
    "advert": "ad ads advert adverts advertisement advertising promo promoted promotion sponsor sponsored outbrain taboola",
    "notice": "cookie cookies consent gdpr notice popup modal alert newsletter subscribe subscription signup",
    "side": "sidebar related recommended widget widgets complementary rail share sharing social search form feedback",
    "comment": "comment comments commentlist disqus discussion reactions reply replies respond",
    "content": "article articlebody articles blogpost body content entry main maincontent post posts story text",
}
WORDS = {k: frozenset(v.split()) for k, v in WORDS.items()}
NEUTRAL = "wrap wrapper container row col page site inner outer grid box layout block region section module has no with left right top".split()
MARKS = frozenset("article main".split())
#: Pages that may be used for training: those first by a hash of their id; elements of each layout of one, evenly spread.
TRAIN_PAGES, TRAIN_ELEMENTS, LAYOUTS = 128, 64, 3
TAG_GROUPS = ("p", "div", "section", "article main", "ul ol", "li", "a", "h1", "h2 h3 h4 h5 h6", "table tbody tr td th", "blockquote", "pre", "span", "b i em strong", "nav menu", "header", "footer", "aside", "form fieldset legend label input select option button datalist search", "dialog")
_GROUP_OF = {t: k for k, g in enumerate(TAG_GROUPS) for t in g.split()}
#: Groups whose being above an element tells of it.
ABOVE = ("article main", "nav menu", "header", "footer", "aside", "form fieldset legend label input select option button datalist search", "a", "dialog")
N_FEATURES = 20 + 2 * len(WORDS) + len(TAG_GROUPS) + len(ABOVE)


@dataclass
class Flat:
    """A page's elements, parents before their children: parent of each, features."""

    nodes: list[Node]
    parents: list[int]
    features: np.ndarray


def flatten(root: Node) -> Flat:
    nodes, parents, depth, sibling = [root], [-1], [0], [(0, 1)]
    todo = [0]
    while todo:
        i = todo.pop()
        children = [c for c in nodes[i].content if isinstance(c, Node)]
        first = len(nodes)
        for k, c in enumerate(children):
            nodes.append(c)
            parents.append(i)
            depth.append(depth[i] + 1)
            sibling.append((k, len(children)))
        todo += range(len(nodes) - 1, first - 1, -1)
    n = len(nodes)
    pieces = [[t for t in x.content if isinstance(t, str)] if x.tag not in RAW else [] for x in nodes]
    own = np.array([sum(map(len, t)) for t in pieces], float)
    marks = np.array([sum(x.count(".") + x.count(",") for x in t) for t in pieces], float)
    group = np.array([_GROUP_OF.get(x.tag, len(TAG_GROUPS)) for x in nodes])
    tags = np.eye(len(TAG_GROUPS) + 1)[group][:, :-1]
    words = np.array([[not x.tokens.isdisjoint(w) for w in WORDS.values()] if x.tokens else [False] * len(WORDS) for x in nodes], float).reshape(n, len(WORDS))
    # sums over subtrees, from the last element on, and what is above, from the first on
    text, links, count, paras, content = own.tolist(), [0.0] * n, [1.0] * n, [0.0] * n, [0.0] * n
    marks = marks.tolist()
    is_content = ((words[:, -1] > 0) | (group == TAG_GROUPS.index("article main"))).tolist()
    is_link, is_para = (group == TAG_GROUPS.index("a")).tolist(), (group == 0).tolist()
    for i in range(n - 1, 0, -1):
        p = parents[i]
        links[p] += text[i] if is_link[i] else links[i]
        content[p] += text[i] if is_content[i] else content[i]
        text[p] += text[i]
        count[p] += count[i]
        marks[p] += marks[i]
        paras[p] += paras[i] + is_para[i]
    above = np.hstack([words, tags[:, [TAG_GROUPS.index(g) for g in ABOVE]]])
    carried = np.zeros_like(above)
    for i in range(1, n):
        carried[i] = np.maximum(carried[parents[i]], above[parents[i]])
    par = np.array(parents)
    par[0] = 0
    text, links, count, paras, marks, content = (np.array(x) for x in (text, links, count, paras, marks, content))
    total, density = max(text[0], 1), links / np.maximum(text, 1)
    position, siblings = np.array(sibling, float).T
    basic = [
        np.log1p(text), np.log1p(own), density, text / count, text / total, np.log1p(count), marks / np.maximum(text, 1), np.log1p(paras), np.array(depth, float), position, siblings, position / siblings,
        text / np.maximum(text[par], 1), np.array([x.attributes for x in nodes], float), np.array([len(x.tokens) for x in nodes], float), np.array([x.tag in BLOCK for x in nodes], float), content / total, density[par], text[par] / total, marks[par] / np.maximum(text[par], 1),
    ]
    return Flat(nodes, parents, np.hstack([np.stack(basic, axis=1), words, carried, tags]))


def is_marked(node: Node) -> bool:
    return node.tag in MARKS or "articlebody" in node.tokens


#: Elements that are no article text even where a page's mark encloses them, unless the page says otherwise.
_ASIDE = frozenset(t for g in ("nav menu", "footer", "aside", ABOVE[5], "dialog") for t in g.split())


def teacher(flat: Flat) -> np.ndarray | None:
    """1 for a marked article, what it holds and what holds it, 0 for all else; None if the page marks none."""
    y, inside = np.zeros(len(flat.nodes)), np.zeros(len(flat.nodes), bool)
    for i, (x, p) in enumerate(zip(flat.nodes, flat.parents)):
        inside[i] = is_marked(x) or (p >= 0 and inside[p])
        y[i] = inside[i] and (x.tag not in _ASIDE) and (p < 0 or y[p] or not inside[p])
    if not inside.any():
        return None
    holds = np.zeros(len(y), bool)
    for i in np.flatnonzero([is_marked(x) for x in flat.nodes]).tolist():
        while (i := flat.parents[i]) >= 0 and not holds[i]:
            holds[i] = True
    y[holds] = 1
    return y


def unmarked(node: Node) -> Node:
    """A copy in which nothing names the article."""
    content = [unmarked(c) if isinstance(c, Node) else c for c in node.content]
    return Node("div", frozenset(), 0, content) if is_marked(node) else Node(node.tag, node.tokens, node.attributes, content)


class Layout:
    """A page laid out anew from an article's elements and a stock of words. good has the elements of the article."""

    def __init__(self, article: list, words: list[str], seed: int):
        self.draw, self.words, self.article, self.good = random.Random(seed), words or ["text"], article, set()

    def _said(self, low: int, high: int) -> str:
        n, at = self.draw.randint(low, high), self.draw.randrange(len(self.words))
        return " ".join((self.words[at:] + self.words)[:n])

    def _named(self, kind: str, chance: float = 0.8) -> frozenset[str]:
        names = {self.draw.choice(sorted(WORDS[kind]))} if self.draw.random() < chance else set()
        return frozenset(names | {self.draw.choice(NEUTRAL) for _ in range(self.draw.randint(0, 2))})

    def _node(self, tag: str, content: list, tokens: frozenset[str] = frozenset(), good: bool = False) -> Node:
        x = Node(tag, tokens, len(tokens) > 0, content)
        if good:
            self.good.add(id(x))
        return x

    def _links(self) -> list:
        link = lambda: self._node("a", [self._said(1, 5)])
        links = [link() for _ in range(self.draw.randint(2, 9))]
        return [self._node("ul", [self._node("li", [x]) for x in links])] if self.draw.random() < 0.6 else links

    def clutter(self) -> Node:
        kind = self.draw.choice(("menu", "edge", "advert", "notice", "side", "side", "comment", "comment", "form", "edge"))
        one, chance = self.draw.choice, self.draw.random
        if kind == "menu":
            tag = one(("nav", "div", "ul", "menu", "header"))
            return self._node(tag, self._links(), self._named(kind, 0.5 if tag in ("nav", "menu") else 0.9))
        if kind == "edge":
            tag = one(("header", "footer", "div", "footer"))
            return self._node(tag, [self._node(one(("p", "h2", "span", "div")), [self._said(2, 25)]), *(self._links() if chance() < 0.5 else [])], self._named(kind, 0.3 if tag != "div" else 1))
        if kind == "advert":
            return self._node(one(("div", "aside", "section", "p")), [self._said(3, 40)] if chance() < 0.5 else [self._node("p", [self._said(3, 30)]) for _ in range(self.draw.randint(1, 3))], self._named(kind, 1))
        if kind == "notice":
            return self._node(one(("div", "section", "dialog", "aside", "p")), [self._said(4, 40), *([self._node("button", [self._said(1, 2)])] if chance() < 0.5 else [])], self._named(kind, 1))
        if kind == "form":
            inner = [self._node("label", [self._said(1, 4)]), self._node("input", []), *([self._node("p", [self._said(3, 20)])] if chance() < 0.4 else []), self._node("button", [self._said(1, 2)])]
            return self._node("form", inner, self._named(one(("side", "notice")), 0.4))
        if kind == "comment":
            said = lambda: self._node(one(("div", "li", "p", "article")), [self._node("p", [self._said(5, 60)])] if chance() < 0.6 else [self._said(5, 60)], self._named(kind, 0.6))
            heading = [self._node(one(("h2", "h3", "h4")), [self._said(1, 4)])] if chance() < 0.6 else []
            return self._node(one(("div", "section", "ol", "ul", "div")), [*heading, *(said() for _ in range(self.draw.randint(1, 6)))], self._named(kind, 1))
        tag = one(("aside", "div", "section", "div"))
        return self._node(tag, [self._node(one(("h2", "h3", "p")), [self._said(1, 5)]), *(self._links() if chance() < 0.6 else [self._node("p", [self._said(4, 30)])])], self._named(kind, 0.4 if tag == "aside" else 1))

    def _kept(self, x: Node) -> Node:
        odd = self.draw.choice(sorted(WORDS)) if self.draw.random() < 0.12 and x.tag in ("h1", "h2", "h3", "section", "p", "div") else None
        tokens = self._named(odd, 1) | {self.draw.choice(self.words).lower()[:12]} if odd and x.tag != "p" else x.tokens
        content = [self._kept(c) if isinstance(c, Node) else c for c in x.content]
        if x.tag == "p" and self.draw.random() < 0.3:
            at = self.draw.randint(0, len(content))
            content[at:at] = [" ", self._node(self.draw.choice(("b", "i", "em", "strong", "span", "a", "code")), [self._said(1, 4)], frozenset(), True), " "]
        return self._node(x.tag, content, tokens, True)

    def _shaped(self, x: Node) -> Node:
        """A paragraph of the article in another form: a list, a quotation, a table, a heading."""
        said = lambda low, high: self._node("li", [self._said(low, high)], frozenset(), True)
        form = self.draw.choice((0, 0, 0, 1, 2, 3, 4))
        if form == 0:
            return self._node(self.draw.choice(("ul", "ol")), [said(1, 12) for _ in range(self.draw.randint(2, 7))], frozenset(), True)
        if form == 1:
            return self._node("blockquote", [self._kept(x)], frozenset(), True)
        if form == 2:
            cells = lambda: [self._node(self.draw.choice(("td", "td", "th")), [self._said(1, 8)], frozenset(), True) for _ in range(3)]
            return self._node("table", [self._node("tr", cells(), frozenset(), True) for _ in range(self.draw.randint(1, 5))], frozenset(), True)
        if form == 3:
            return self._node("p", [self._said(4, 20), " ", self._node("a", [self._said(1, 4)], frozenset(), True), " ", self._said(2, 20)], frozenset(), True)
        return self._node(self.draw.choice(("h2", "h3", "pre")), [self._said(1, 8)], frozenset(), True)

    def page(self) -> Node:
        few = lambda most: [self.clutter() for _ in range(self.draw.randint(0, most))]
        body: list = []
        article = self.article
        if self.draw.random() < 0.3:  # a short one
            article = [self._node("h1", [self._said(1, 6)]), *(self._node("p", [self._said(1, 15)]) for _ in range(self.draw.randint(1, 4)))]
        for x in article:
            if self.draw.random() < 0.06:
                body.append(self.clutter())
            if isinstance(x, Node) and x.tag == "p" and self.draw.random() < 0.05:
                body.append(self._node(self.draw.choice(("h2", "h3")), [self._said(2, 6)], frozenset([self.draw.choice(self.words).lower()[:12], self.draw.choice(sorted(WORDS[self.draw.choice(sorted(WORDS))]))]), True))
            body.append(x if isinstance(x, str) else self._shaped(x) if x.tag == "p" and self.draw.random() < 0.25 else self._kept(x))
        shape = self.draw.random()
        if shape < 0.75:
            tag = self.draw.choice(("div", "div", "section", "article", "main", "td"))
            body = [self._node(tag, body, self._named("content", 0.5), True)]
        body = [*few(4), *body, *few(5)]
        for _ in range(self.draw.randint(0, 3)):
            named = frozenset(self._named(self.draw.choice(("side", "menu", "notice", "edge")), 0.25) | {self.draw.choice(NEUTRAL)})
            body = [*few(2), self._node(self.draw.choice(("div", "div", "section", "main")), body, named, True), *few(2)]
        page = self._node("html", [self._node("body", body, frozenset(), True)], frozenset(), True)
        return self._node("#root", [page], frozenset(), True)


def layouts(page: str | None, seed: int):
    """(tree, labels) of a page as it is, without its marks, and laid out anew; nothing for a page that marks none."""
    root = parse(page)
    flat = flatten(root)
    y = teacher(flat)
    if y is None:
        return
    yield flat, y
    yield flatten(unmarked(root)), y
    marked = next(i for i, x in enumerate(flat.nodes) if is_marked(x))
    own = [t for x in flat.nodes if x.tag not in RAW for t in x.content if isinstance(t, str)]
    for k in range(LAYOUTS):
        new = Layout(flat.nodes[marked].content, " ".join(own).split(), 1000 * seed + k)
        tree = flatten(new.page())
        yield tree, np.array([float(id(x) in new.good) for x in tree.nodes])


def decode(parents: list[int], margins: np.ndarray) -> np.ndarray:
    """The set of elements with the largest sum of margins in which every element's parent is in the set."""
    gain = margins.astype(float).copy()
    for i in range(len(parents) - 1, 0, -1):
        gain[parents[i]] += max(0.0, gain[i])
    keep = np.zeros(len(parents), bool)
    for i, p in enumerate(parents):
        keep[i] = (p < 0 or keep[p]) and gain[i] > 0
    return keep


def text_of(flat: Flat, keep: np.ndarray) -> str:
    """The kept elements' own text: one line for each block, in page order, white space turned to one space."""
    kept = {id(x) for x, k in zip(flat.nodes, keep) if k}
    blocks: list[list[str]] = [[]]
    todo: list = [flat.nodes[0]]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            blocks[-1].append(x)
        elif x is None:
            blocks.append([])
        elif x.tag == "br":
            blocks[-1].append(" ")
        elif id(x) in kept and x.tag not in RAW:  # the content of raw elements is code, not text
            block = x.tag in BLOCK
            todo += [None] * block + x.content[::-1] + [None] * block
        elif x.tag in BLOCK:
            blocks.append([])
    return "\n".join(filter(None, (" ".join("".join(b).split()) for b in blocks)))


def _training_rows(batches):
    for pdf in batches:
        for page in pdf.html:
            for flat, y in layouts(page, zlib.crc32((page or "").encode("utf-8"))):
                some = np.unique(np.linspace(0, len(y) - 1, min(len(y), TRAIN_ELEMENTS)).astype(int))
                yield pd.DataFrame({"n": [len(some)], "x": [flat.features[some].astype("<f4").tobytes()], "y": [y[some].astype("<f4").tobytes()]})


def fit(pages: DataFrame, train_pages: int = TRAIN_PAGES, id_col: str = "page_id", html_col: str = "html") -> boosting.Trees:
    """Trees from the layouts of at most train_pages pages, those first by a hash of their id. Each layout gives at
    most TRAIN_ELEMENTS elements, so what reaches the driver is bounded however long the pages are. Without any page
    that marks its article the trees say nothing and no text is found."""
    ids = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(train_pages)
    some = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).join(F.broadcast(ids), "id").dropDuplicates(["id"])
    rows = some.select("html").mapInPandas(_training_rows, "n int, x binary, y binary").collect()
    rows.sort(key=lambda r: (r["n"], bytes(r["x"])))  # the same sums whatever the partitions
    f32 = lambda k: np.concatenate([np.frombuffer(r[k], "<f4") for r in rows] or [np.zeros(0, "<f4")]).astype(float)
    return boosting.train(f32("x").reshape(-1, N_FEATURES), f32("y"))


def _text(flat: Flat, margins: np.ndarray) -> str:
    return text_of(flat, decode(flat.parents, margins))


def main_text(page: str | None, trees: boosting.Trees) -> str:
    flat = flatten(parse(page))
    return _text(flat, trees.margin(flat.features))


def extracted(trees: boosting.Trees, html_col: str = "html"):
    """A column of the main text of whole pages; empty for null and empty pages and pages without any."""

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(pages), 64):  # few trees in memory at a time
            flats = [flatten(parse(p)) for p in pages.iloc[at : at + 64]]
            ends = np.cumsum([len(f.nodes) for f in flats])
            margins = trees.margin(np.vstack([f.features for f in flats]))
            out += [_text(f, margins[end - len(f.nodes) : end]) for f, end in zip(flats, ends)]
        return pd.Series(out, dtype=object)

    return extract(F.col(html_col))


def op7_html(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages. Rows are told apart by nothing, so null urls and ids and
    repeated rows come through as they are; extra columns are not read; an empty table gives no rows."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", extracted(fit(pages)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
