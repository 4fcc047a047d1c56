"""Block trees of web pages, and their features."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np

# Element names by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var".split()
)
UNSEEN = frozenset("script style template noscript head iframe svg canvas select datalist option textarea button".split())
#: Of these, what an author may have left open: the text after it is then part of the page.
LEFT_OPEN = frozenset("noscript svg canvas select datalist option button".split())
NESTED = frozenset(["svg"])
CLOSED_BY_BLOCK = "p"
CLOSED_BY_SIBLING = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th"}
LIST_ENDS = frozenset("ul ol dl table body".split())

# Words in class, id and role attributes, by what they say about an element.
HINTS = (
    "content article post entry story text body main maincontent articlebody",
    "nav navigation menu navbar breadcrumb breadcrumbs pagination pager toc tabs",
    "header masthead topbar banner top logo branding",
    "footer bottom copyright legal colophon",
    "sidebar side aside rail widget widgets column",
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion teaser outbrain",
    "cookie cookies consent notice notices alert popup modal overlay gdpr privacy warning disclaimer",
    "comment comments reply replies discussion disqus respond thread",
    "share social related recommended recommendations more trending popular tags follow",
    "form login signup subscribe newsletter search register contact",
)
TAGS = (
    "body article main section div p h1 h2 h3 h4 h5 h6 ul ol li nav header footer aside form table tr td th dl dt dd "
    "blockquote pre figure figcaption text"
).split()


@dataclass
class Page:
    """Nodes in page order; node 0 is the body. Text nodes are leaves and hold a block each."""

    tag: list[str] = field(default_factory=lambda: ["body"])
    parent: list[int] = field(default_factory=lambda: [-1])
    hints: list[frozenset[int]] = field(default_factory=lambda: [frozenset()])
    text: list[str] = field(default_factory=lambda: [""])
    linked: list[int] = field(default_factory=lambda: [0])
    keep: list[bool] = field(default_factory=lambda: [False])

    def add(self, tag: str, parent: int, hints: frozenset[int], text: str = "", linked: int = 0, keep: bool = False) -> int:
        for column, value in zip(
            (self.tag, self.parent, self.hints, self.text, self.linked, self.keep), (tag, parent, hints, text, linked, keep), strict=True
        ):
            column.append(value)
        return len(self.tag) - 1


_HINT_OF = {word: i for i, line in enumerate(HINTS) for word in line.split()}
_WORDS = re.compile(r"[a-z]+")


def _hints(attributes: list[tuple[str, str | None]]) -> frozenset[int]:
    said = " ".join(v or "" for k, v in attributes if k in ("class", "id", "role"))
    split = re.sub(r"([a-z])([A-Z])", r"\1 \2", said).lower()
    return frozenset(_HINT_OF[w] for w in _WORDS.findall(split) if w in _HINT_OF)


class _Ends:
    """Where elements of ``LEFT_OPEN`` begin and end in a page, to tell those that never end."""

    _TAG = re.compile(rf"<(/?)({'|'.join(sorted(LEFT_OPEN))})(?=[\s/>])", re.IGNORECASE)

    def __init__(self, html: str):
        self.begins, self.ends = defaultdict(list), defaultdict(list)
        for match in self._TAG.finditer(html):
            (self.ends if match[1] else self.begins)[match[2].lower()].append(match.start())

    def is_closed(self, tag: str, at: int) -> bool:
        """Whether the element that begins at ``at`` has an end before another of its kind begins (or at all, where kinds nest)."""
        end = bisect_left(self.ends[tag], at)
        if end == len(self.ends[tag]):
            return False
        following = bisect_left(self.begins[tag], at + 1)
        return tag in NESTED or following == len(self.begins[tag]) or self.ends[tag][end] < self.begins[tag][following]


class _Builder(HTMLParser):
    """Adds to a page as the markup is read. Inline elements only mark the text of their block.

    ``at`` holds the depths at which elements of a name are open, so that no tag costs more the deeper it stands.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.open: list[tuple[str, int, bool]] = [("body", 0, False)]  # element, its node, kept (in labelled pages)
        self.at: dict[str, list[int]] = defaultdict(list, body=[0])
        self.unseen: list[str] = []
        self.inside: list[str] = []  # elements open within the outermost unseen one
        self.links = 0
        self.block: list[str] = []
        self.linked = 0
        self.marked = _Ends(html)
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]

    def place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def end_block(self) -> None:
        text = " ".join("".join(self.block).split())
        if text:
            _, node, keep = self.open[-1]
            self.page.add("text", node, frozenset(), text, min(self.linked, len(text)), keep)
        self.block, self.linked = [], 0

    def close_to(self, depth: int) -> None:
        self.end_block()
        for name, _, _ in self.open[depth:]:
            self.at[name].pop()
        del self.open[depth:]
        self.links = 0

    def last(self, names: list[str] | frozenset[str]) -> int:
        """Depth of the innermost open element of these names, 0 for none below the body."""
        return max((self.at[name][-1] for name in names if self.at.get(name)), default=0)

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        if self.unseen and self.unseen[-1] == "head" and tag not in UNSEEN | VOID and tag not in ("title", "base"):
            self.unseen.pop()  # a head that was never closed ends with the first thing to be seen
        if tag in UNSEEN:
            if tag not in LEFT_OPEN or self.marked.is_closed(tag, self.place()):
                self.unseen.append(tag)
            return
        if self.unseen:
            if tag not in VOID:
                self.inside.append(tag)
            return
        if tag in ("br", "hr") or tag in VOID:
            self.block.append(" ")
            return
        if tag in ("html", "body"):
            return
        if tag in INLINE:
            self.links += tag == "a"
            return
        self.end_block()
        self.links = 0
        if depth := self.last(["p"]):
            self.close_to(depth)
        siblings = CLOSED_BY_SIBLING.get(tag, "").split()
        while siblings and (depth := self.last(siblings)) > self.last(LIST_ENDS):
            self.close_to(depth)
            if tag != "tr" or self.open[-1][0] not in siblings:
                break
        keep = self.open[-1][2]
        for name, value in attributes:
            keep = value == "1" if name == "x-keep" else keep
        node = self.page.add(tag, self.open[-1][1], _hints(attributes))
        self.at[tag].append(len(self.open))
        self.open.append((tag, node, keep))

    def handle_startendtag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        if tag in UNSEEN:
            return
        self.handle_starttag(tag, attributes)
        if tag not in VOID and tag in INLINE:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.unseen:
            del self.unseen[self.unseen.index(tag) :]
            if not self.unseen:
                self.inside.clear()
            return
        if self.unseen:
            if tag in self.inside[-64:]:
                while self.inside.pop() != tag:
                    pass
                return
            if not (set(self.unseen) <= LEFT_OPEN and self.at.get(tag)):
                return
            self.unseen.clear()  # the element around ends, and so does what was left open in it
            self.inside.clear()
        if tag in VOID:
            return
        if tag in INLINE:
            self.links = max(0, self.links - (tag == "a"))
            return
        if depth := self.last([tag]):
            self.close_to(depth)

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.block.append(data)
            if self.links:
                self.linked += len(data.strip())


def parse(html: str | None) -> Page:
    """The block tree of a page. Broken markup gives some tree, never an error; null gives an empty one.

    Takes time in proportion to the page, however deep it is nested.
    """
    builder = _Builder(html or "")
    builder.feed(html or "")
    builder.close()
    builder.end_block()
    return builder.page


def levels(depth: np.ndarray) -> list[np.ndarray]:
    """Numbers of the nodes of each depth, from 0 on."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []


def _bucket(value: np.ndarray, limits: tuple[float, ...]) -> np.ndarray:
    return np.searchsorted(np.array(limits), value, side="right")


LENGTHS, LINKS = (1, 5, 12, 30, 80), (0.05, 0.3, 0.6)
_SIZES = [1, len(TAGS) + 1, len(HINTS), len(HINTS), len(LENGTHS) + 1, len(LENGTHS) + 1, len(LINKS) + 1, len(LINKS) + 1, 2, 2]
N_FEATURES = sum(_SIZES)
_STARTS = np.concatenate(([0], np.cumsum(_SIZES)))[:-1]
N_EDGE = 5
_TAG = {tag: i for i, tag in enumerate(TAGS)}
_APART = frozenset("nav header footer aside form".split())
_MAIN = frozenset("article main".split())


@dataclass
class Forest:
    """Trees of many pages: parents, depths, page of each node, and features."""

    parent: np.ndarray
    depth: np.ndarray
    page: np.ndarray
    leaf: np.ndarray
    features: np.ndarray
    edge: np.ndarray
    keep: np.ndarray


def forest(pages: list[Page]) -> Forest:
    """Number the nodes of all pages and describe each by 0/1 features.

    A node's own features: a constant, its element, the words of its attributes, length and share of
    links of its text, whether it ends like a sentence, whether it is a text. An element counts
    the text of everything inside. Edges: a constant, whether the child is of a kind that stands apart, whether
    its attributes speak for or against content, and whether the parent is made for content.
    """
    sizes = [len(p.tag) for p in pages]
    base = np.concatenate(([0], np.cumsum(sizes)))
    n = int(base[-1])
    parent = np.concatenate([np.where(np.array(p.parent) >= 0, np.array(p.parent) + b, -1) for p, b in zip(pages, base, strict=False)] or [np.zeros(0, int)]).astype(np.int64)
    depth = np.zeros(n, np.int64)
    tags = [t for p in pages for t in p.tag]
    texts = [t for p in pages for t in p.text]
    hints = [h for p in pages for h in p.hints]
    leaf = np.array([t == "text" for t in tags], bool)
    for i, above in enumerate(parent.tolist()):  # a parent comes before its children
        if above >= 0:
            depth[i] = depth[above] + 1
    words = np.array([t.count(" ") + 1 if t else 0 for t in texts], float)
    chars = np.array([len(t) for t in texts], float)
    linked = np.array([x for p in pages for x in p.linked], float)
    kept = np.where(np.array([k for p in pages for k in p.keep], bool), chars, 0.0)
    whole = [words.copy(), chars.copy(), linked.copy(), kept]
    for at in levels(depth)[:0:-1]:
        for column in whole:
            np.add.at(column, parent[at], column[at])
    said = np.zeros((n, len(HINTS)), bool)
    for i, found in enumerate(hints):
        for h in found:
            said[i, h] = True
    above = np.where((parent >= 0)[:, None], said[np.maximum(parent, 0)], False)
    share = whole[2] / np.maximum(whole[1], 1)
    up_share = np.where(parent >= 0, share[np.maximum(parent, 0)], 0)
    features = np.zeros((n, N_FEATURES), np.float32)
    row = np.arange(n)
    one_hot = (
        (0, np.zeros(n, int)),
        (1, np.array([_TAG.get(t, len(TAGS)) for t in tags], int)),
        (4, _bucket(whole[0], LENGTHS)),
        (5, _bucket(np.where(parent >= 0, whole[0][np.maximum(parent, 0)], 0), LENGTHS)),
        (6, _bucket(share, LINKS)),
        (7, _bucket(up_share, LINKS)),
        (8, np.array([t[-1:] in ".!?…:\"”»" and t != "" for t in texts], int)),
        (9, leaf.astype(int)),
    )
    for block, value in one_hot:
        features[row, _STARTS[block] + value] = 1
    features[:, _STARTS[2] : _STARTS[2] + len(HINTS)] = said
    features[:, _STARTS[3] : _STARTS[3] + len(HINTS)] = above
    apart = np.array([t in _APART for t in tags], bool)
    main = np.array([t in _MAIN for t in tags], bool)
    within = np.where(parent >= 0, (main | said[:, 0])[np.maximum(parent, 0)], False)
    edge = np.stack([np.ones(n), apart, said[:, 0], said[:, 1:].any(1), within], axis=1).astype(np.float32)
    return Forest(parent, depth, np.repeat(np.arange(len(pages)), sizes), leaf, features, edge, 2 * whole[3] > whole[1])
