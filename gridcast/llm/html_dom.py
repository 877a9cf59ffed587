"""A small reader of HTML pages: block elements as a tree, and the text runs in them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import numpy as np

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|itemprop|data-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
TOKEN = re.compile(r"[a-z]+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Elements that hold no readable text, whatever a model says.
HIDDEN = frozenset("head script style noscript template iframe svg canvas audio video select datalist title textarea".split())
RAW = frozenset("script style textarea title iframe noscript".split())
#: What a head can hold; in pages without its end tag, which is optional, anything else ends it.
IN_HEAD = frozenset("head html base basefont bgsound link meta title noscript noframes style script template".split())
#: A start tag of these that ends with a slash has no content, nor has any inside the first two.
FOREIGN = ("svg", "math")
EMPTY = (HIDDEN - RAW - {"head"}) | set(FOREIGN)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table caption tbody thead tfoot "
    "tr td th ul".split()
)
#: A start tag closes an open element of these names (up to the named container).
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt", ("dl",)),
    "dd": ("dd", ("dl",)),
    "tr": ("tr", ("table",)),
    "td": ("td", ("tr", "table")),
    "th": ("th", ("tr", "table")),
}


@dataclass
class Page:
    """Block elements in page order; element 0 is the page itself."""

    tag: list[str] = field(default_factory=lambda: ["#page"])
    parent: list[int] = field(default_factory=lambda: [-1])
    tokens: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    label: list[int] = field(default_factory=lambda: [-1])
    runs: list[tuple[int, str]] = field(default_factory=list)  # (element, text without extra white space)
    links: list[int] = field(default_factory=lambda: [0])  # characters inside links, directly in the element
    controls: list[int] = field(default_factory=lambda: [0])  # inputs directly in the element


def _attributes(raw: str) -> tuple[tuple[str, ...], int]:
    tokens: list[str] = []
    label = -1
    for name, value in ATTRIBUTE.findall(raw):
        value = value.strip("\"'")
        if name.lower() == "data-label":
            label = int(value) if value in ("0", "1") else -1  # real pages use the name too
        else:
            tokens += TOKEN.findall(HUMP.sub(" ", value).lower())
    return tuple(tokens), label


class _Builder:
    def __init__(self, implied: bool) -> None:
        self.implied = implied  # whether content ends a head
        self.unended = False  # whether a head has no end tag
        self.page = Page()
        self.open: list[tuple[str, int]] = [("#page", 0)]  # (name, innermost block element)
        self.text: list[str] = []
        self.in_link = 0
        self.hidden = 0

    def end_head(self) -> None:
        if self.implied and self.open[-1][0] == "head":
            self.close("head")

    def is_empty(self, name: str, raw: str) -> bool:
        return raw.endswith("/") and (name in EMPTY or any(n in FOREIGN for n, _ in self.open))

    def add_text(self, text: str) -> None:
        if self.hidden and text.strip():
            self.end_head()
        if self.hidden or not text:
            return
        self.text.append(text)
        if self.in_link:
            self.page.links[self.open[-1][1]] += len(text.strip())

    def end_run(self) -> None:
        if self.text:
            run = " ".join(unescape("".join(self.text)).split())
            if run:
                self.page.runs.append((self.open[-1][1], run))
            self.text.clear()

    def start(self, name: str, raw: str) -> None:
        if name == "body" and any(n == "head" for n, _ in self.open):
            self.unended = True
            if self.implied:
                self.close("head")
        if name not in IN_HEAD:
            self.end_head()
        if self.is_empty(name, raw):
            return
        if name in BLOCK:
            self.end_run()
            if any(n == "p" for n, _ in self.open):
                self.close("p")
            if name in CLOSES:
                own, stops = CLOSES[name]
                for n, _ in reversed(self.open):
                    if n in stops:
                        break
                    if n == own:
                        self.close(own)
                        break
        if name == "br":
            self.add_text(" ")
        if name in VOID:
            if name == "input":
                self.page.controls[self.open[-1][1]] += 1
            return
        at = self.open[-1][1]
        if name in BLOCK and not self.hidden:
            page = self.page
            tokens, label = _attributes(raw) if "=" in raw else ((), -1)
            page.tag.append(name)
            page.parent.append(at)
            page.tokens.append(tokens)
            page.label.append(label)
            page.links.append(0)
            page.controls.append(0)
            at = len(page.tag) - 1
        elif name in ("select", "button", "textarea", "label"):
            self.page.controls[at] += 1
        self.hidden += name in HIDDEN
        self.in_link += name == "a"
        self.open.append((name, at))

    def close(self, name: str) -> None:
        if not any(n == name for n, _ in self.open):
            return
        if any(n in BLOCK for n, _ in self.open[next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == name) :]):
            self.end_run()
        while True:
            last, _ = self.open.pop()
            self.hidden -= last in HIDDEN
            self.unended |= last == "head" != name
            self.in_link -= last == "a"
            if last == name:
                return


def read(html: str) -> Page:
    """Elements and text runs of a page; broken markup is read as far as it goes."""
    builder = _build(html, False)
    return _build(html, True).page if builder.unended else builder.page


def _build(html: str, implied: bool) -> _Builder:
    builder, at = _Builder(implied), 0
    found = TAG.search(html)
    while found:
        builder.add_text(html[at : found.start()])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if name and (found[1] or found[4]):
            builder.close(name)
        elif name:
            raw = found[3] or found[6] or ""
            builder.start(name, raw)
            if name in RAW and not builder.is_empty(name, raw):  # its text is not markup
                end = re.compile(f"(?i)</{name}\\b").search(html, at)
                if not end:
                    at = len(html)
                    break
                if name not in HIDDEN:
                    builder.add_text(html[at : end.start()])
                at = end.start()
        found = TAG.search(html, at)
    builder.add_text(html[at:])
    builder.end_run()
    builder.unended |= any(n == "head" for n, _ in builder.open)
    return builder


GOOD = frozenset("article content post entry main body text story page blog news document prose".split())
BAD = {
    "nav": "nav navigation menu navbar breadcrumb breadcrumbs pagination pager toc topbar tabs skip".split(),
    "edge": "header footer masthead banner copyright colophon bottom legal logo site branding".split(),
    "side": "sidebar aside side rail widget related recommended popular trending teaser more tags tag archive".split(),
    "ad": "ad ads advert advertisement adverts sponsor sponsored promo promotion banner affiliate commercial".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay warning disclaimer privacy paywall".split(),
    "form": "form login signup signin register subscribe newsletter search contact".split(),
    "talk": "comment comments reply replies respond discussion disqus feedback thread reader share social".split(),
}
BAD_GROUP = {t: i for i, group in enumerate(BAD.values()) for t in group}
TAG_GROUPS = (
    ("article", "main"),
    ("p", "blockquote", "pre"),
    ("h1", "h2", "h3", "h4", "h5", "h6"),
    ("div", "section", "center"),
    ("ul", "ol", "menu", "dl", "dir"),
    ("li", "dt", "dd"),
    ("nav",),
    ("header", "hgroup"),
    ("footer", "address"),
    ("aside", "dialog"),
    ("form", "fieldset", "legend", "search"),
    ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"),
    ("figure", "figcaption", "details", "summary"),
    ("html", "body", "#page"),
)
TAG_GROUP = {t: i for i, group in enumerate(TAG_GROUPS) for t in group}
STOPS = re.compile(r"[.,;:!?]")


def features(page: Page) -> np.ndarray:
    """Columns of each element: own and inherited tags and attribute tokens, subtree, depth, siblings."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own = np.zeros((n, 4))  # characters, runs, stops, characters in links
    for at, run in page.runs:
        own[at] += (len(run), 1, len(STOPS.findall(run)), 0)
    own[:, 3] = np.minimum(page.links, own[:, 0])
    sums = np.concatenate([own, np.array(page.controls, float)[:, None], np.ones((n, 1))], 1)
    tree = sums.copy()
    group = np.array([TAG_GROUP.get(t, 3) for t in page.tag])
    bad, good = np.zeros((n, len(BAD))), np.zeros(n)
    for i, tokens in enumerate(page.tokens):
        for t in tokens:
            good[i] += t in GOOD
            if t in BAD_GROUP:
                bad[i, BAD_GROUP[t]] += 1
    tags = np.eye(len(TAG_GROUPS))[group]
    depth, above_tags, above_bad, above_good = np.zeros(n), np.zeros_like(tags), np.zeros_like(bad), np.zeros(n)
    index, siblings, likes = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n - 1, 0, -1):
        tree[parent[i]] += tree[i]
        siblings[parent[i]] += 1
    place = np.zeros(n)
    seen: dict[tuple[int, int], int] = {}
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        above_tags[i] = np.maximum(above_tags[p], tags[p])
        above_bad[i] = above_bad[p] + bad[p]
        above_good[i] = above_good[p] + good[p]
        index[i] = place[p]
        place[p] += 1
        key = (int(p), int(group[i]))
        seen[key] = seen.get(key, 0) + 1
    for i in range(1, n):
        likes[i] = seen[(int(parent[i]), int(group[i]))]
    brothers = np.where(parent >= 0, siblings[parent], 1)
    up = np.maximum(parent, 0)
    whole = max(tree[0, 0], 1)
    chars, elements = tree[:, 0], tree[:, 5]
    others = (tree[up, 0] - chars) / np.maximum(brothers - 1, 1)
    titles = np.zeros(n)
    for i in range(n - 1, 0, -1):
        titles[i] = max(titles[i], float(page.tag[i] == "h1"))
        titles[parent[i]] = max(titles[parent[i]], titles[i])
    return np.column_stack(
        [
            tags,
            tags[up],
            above_tags,
            bad,
            above_bad,
            good,
            above_good,
            depth,
            index,
            index / np.maximum(brothers, 1),
            brothers,
            likes / np.maximum(brothers, 1),
            np.log1p(chars),
            chars / whole,
            chars / elements,  # subtree density
            tree[:, 3] / np.maximum(chars, 1),
            tree[:, 2] / np.maximum(chars, 1),
            tree[:, 1],
            tree[:, 4],
            np.log1p(own[:, 0]),
            np.log1p(others),
            np.log1p(chars) - np.log1p(others),
            np.log1p(tree[up, 0]),
            tree[up, 3] / np.maximum(tree[up, 0], 1),
            titles,
            titles[up],
        ]
    )


def decode(page: Page, logits: np.ndarray) -> np.ndarray:
    """The likeliest choice of elements to keep in which every kept element has kept ancestors.

    Two sums over subtrees, from the leaves up: the best if the element is kept, and
    all dropped. A child is kept where that is better than dropping all below it.
    """
    keep, drop = -np.logaddexp(0, -logits), -np.logaddexp(0, logits)
    best, none = keep.copy(), drop.copy()
    for i in range(len(logits) - 1, 0, -1):
        p = page.parent[i]
        none[p] += none[i]
        best[p] += max(best[i], none[i])  # the children of i were added before
    kept = np.zeros(len(logits), bool)
    kept[0] = True
    for i in range(1, len(logits)):
        kept[i] = kept[page.parent[i]] and best[i] >= none[i]
    return kept


def text_of(page: Page, kept: np.ndarray) -> str:
    return "\n".join(run for at, run in page.runs if kept[at])
