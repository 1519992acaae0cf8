"""A page as a tree of elements: what the main-text model reads. Tolerates any input; nothing is fetched or run."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

#: Elements of HTML by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
HEAD = frozenset("head title meta link style script base noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends an open element of these kinds, unless one of the bounds lies between.
ENDS = {k: frozenset(v.split()) for k, v in {"li": "li", "dd": "dd dt", "dt": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "tbody": "tbody thead tr td th", "tfoot": "tbody thead tr td th", "option": "option"}.items()}
BOUND = frozenset("ul ol menu dir dl table select body html".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAMED = re.compile(r"[a-z]+|\d+")
#: Attributes whose words say what an element is for.
TOKEN_ATTRIBUTES = frozenset("class id role itemprop itemtype aria-label name".split())


@dataclass(slots=True)
class Node:
    tag: str
    tokens: frozenset[str] = frozenset()
    attributes: int = 0
    #: Children in page order: elements and pieces of text with their references decoded.
    content: list = field(default_factory=list)


def tokens_of(attributes: str) -> frozenset[str]:
    """Lower-case words of the naming attributes; words within names are cut at marks and capitals."""
    found: set[str] = set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() in TOKEN_ATTRIBUTES:
            found.update(_NAMED.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", html.unescape("".join(values))).lower()))
    return frozenset(found)


class _Open:
    """The open elements. Counts by name within the innermost block, and within the innermost list, table or body, tell
    whether a walk up the stack would find anything; as a walk that does ends elements, all walks together are linear."""

    def __init__(self, root: Node):
        self.stack, self.blocks, self.counts, self.all = [root], [0], {True: [Counter()], False: [Counter()]}, Counter()

    def push(self, node: Node) -> None:
        for kinds, counts in self.counts.items():
            counts[-1][node.tag] += 1
            if node.tag in (BLOCK if kinds else BOUND):
                counts.append(Counter())
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.all[node.tag] += 1
        self.stack.append(node)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.all[tag] -= 1
            if self.blocks[-1] == len(self.stack):
                self.blocks.pop()
            for kinds, counts in self.counts.items():
                if tag in (BLOCK if kinds else BOUND):
                    counts.pop()
                counts[-1][tag] -= 1

    def close(self, tag: str) -> None:
        """An end tag; an inline one closes nothing beyond its block, and one that closes nothing is dropped."""
        if tag in BLOCK:
            at = next(i for i in reversed(self.blocks) if self.stack[i].tag == tag) if self.all[tag] > 0 else 0
        else:
            at = next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].tag == tag) if self.counts[True][-1][tag] > 0 else 0
        if at:
            self.cut(at)

    def begin(self, tag: str) -> None:
        """What an opening tag ends before it opens."""
        if tag in BLOCK and tag != "option" and self.stack[self.blocks[-1]].tag == "p":  # a block ends an open paragraph
            self.cut(self.blocks[-1])
        while tag in ENDS and any(self.counts[False][-1][t] > 0 for t in ENDS[tag]):
            i = len(self.stack) - 1
            while self.stack[i].tag not in ENDS[tag]:
                i -= 1
            self.cut(i)
            if tag in ("li", "option", "dd", "dt", "td", "th"):
                break


def parse(page: str | None) -> Node:
    """The root, a Node "#root". End tags that close nothing are dropped, open elements end with their parent."""
    page = page or ""
    root = Node("#root")
    open_, at, n = _Open(root), 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None or m.start() > at:
            open_.stack[-1].content.append(html.unescape(page[at : m.start() if m else n]))
        if m is None:
            break
        at = m.end()
        closing, tag, attributes, end = (m[1], m[2], m[3], m[4]) if m[2] else (m[5], m[6], m[7], m[8])
        if m[0].startswith("<![CDATA["):
            open_.stack[-1].content.append(m[0][9:].removesuffix("]]>"))
        if not tag or not end:
            continue
        tag = tag.lower()
        if closing:
            open_.close(tag)
            continue
        open_.begin(tag)
        node = Node(tag, tokens_of(attributes) if "=" in attributes else frozenset(), attributes.count("="))
        open_.stack[-1].content.append(node)
        if tag in VOID or (attributes.endswith("/") and tag not in BLOCK and tag not in RAW):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            node.content.append(page[at : close.start() if close else n])
            at = close.end() if close else n
            continue
        open_.push(node)
    return root
