"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed into its block elements and the runs of text between them
(the leaves). Every node gets features: tag, words of its class, id and role
(its own and its ancestors'), subtree text, link and tag densities, depth,
place among its siblings, share and place in the page. Boosted trees give
each node's probability of holding main text. Decoding picks the most likely
labelling in which a node that is left out has no descendant that is kept, so
an ancestor and its descendants never contradict each other: bottom-up, a
node's best kept and left-out scores follow from its children's; top-down, the
better is taken.

The trees are fitted when first needed, on PAGES pages made by rule
(``made_page``) whose main text is known; nothing is fetched or stored.

Text: character references are decoded, white space inside a block becomes
one space, blocks are trimmed and joined by one newline. Scripts, styles, head
metadata, templates, embedded frames and form controls never count as text.

A page in which the trees find nothing (bare text, one list) gives the text that
stands in no element or name of boilerplate and isn't mostly links.

Edge cases: null and empty html gives empty text; text outside any element is
a block of its own; a block ends a drawing it stands in; unclosed elements end with their parent, those that never
count as text too (an unclosed button, list of options or text field also at the
next block); rows that repeat are each returned; an empty table gives an empty result; extra columns of the
input are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES = 480
# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
#: Elements for phrases or options only: a block ends them.
FIELDS = frozenset("select textarea button datalist option optgroup".split())
#: Start tags that end a drawing they stand in, unless it has a part open that may hold HTML.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS_HTML = ("foreignobject", "desc", "title", "script", "style")
SKIP = frozenset("script style title template noscript noembed svg iframe object canvas audio video select textarea button datalist option optgroup".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt td th tr".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "head": frozenset(["body", "div", "p", "nav", "header", "main", "article", "section", "h1"]),
}
BLOCKS = CLOSED_BY["p"] - {"option"}
LISTS = frozenset("ul ol dl table body html div section article aside nav header footer main form blockquote".split())
GROUPS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs",
    "head": "header masthead top topbar branding logo",
    "foot": "footer foot bottom copyright colophon legal",
    "side": "sidebar side aside rail widget widgets related recommended recommendations popular trending more",
    "note": "cookie cookies consent notice notices banner alert gdpr privacy popup modal overlay toast",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense dfp",
    "talk": "comment comments reply replies discussion discuss disqus respond thread responses reader",
    "form": "form search subscribe newsletter signup login share sharing social follow contact",
    "main": "content article post entry main body story text page prose markdown",
}
#: Parts of longer names.
STEMS = {
    "nav": ("breadcrumb", "navig", "pagina"), "head": ("header", "masthead"), "foot": ("footer", "copyright"), "side": ("sidebar", "widget", "related", "trending"), "note": ("cookie", "consent", "notice", "popup"),
    "ad": ("advert", "sponsor", "promo", "banner"), "talk": ("comment", "discuss", "replies"), "form": ("newsletter", "subscri", "signup", "search"), "main": ("content", "article", "story"),
}
WORD_GROUP = {w: i for i, (_, ws) in reversed(list(enumerate(GROUPS.items()))) for w in ws.split()}
TAGS = "html body nav header footer aside main article section div p h1 h2 h3 h4 li ul ol table tr td form fieldset blockquote pre figure figcaption dl details address #text".split()
TAG_NO = {t: i for i, t in enumerate(TAGS)}
OUTER = ("nav", "header", "footer", "aside", "article", "main", "form")
STEM_GROUP = [(stem, list(GROUPS).index(g)) for g, stems in STEMS.items() for stem in stems]
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
_SPACES = re.compile(r"\s+")
_FIELD_END = re.compile("</textarea", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?]")


@dataclass
class Page:
    """Nodes in page order: a node's parent comes before it."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    groups: list[int] = field(default_factory=list)  # bits of GROUPS
    text: list[str] = field(default_factory=list)  # of leaves
    link: list[int] = field(default_factory=list)  # characters in links, of leaves
    gold: list[bool] = field(default_factory=list)  # of leaves, in made pages


@lru_cache(100_000)
def _groups(word: str) -> int:
    """Bits of the groups that a word of a name belongs to."""
    if word in WORD_GROUP:
        return 1 << WORD_GROUP[word]
    return next((1 << k for stem, k in STEM_GROUP if stem in word), 0)


CLOSES = {t: [other for other, by in CLOSED_BY.items() if t in by] for t in frozenset().union(*CLOSED_BY.values())}


class _Parser(HTMLParser):
    """Work per tag doesn't grow with the number of open elements, but for the tags that end them."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.field_ends = len(_FIELD_END.findall(html))  # of text fields, still to come
        self.page = Page()
        self.open: list[tuple[str, int, bool]] = []  # tag, node (-1 inline, -2 skipped), marked as main text
        self.names: Counter = Counter()  # of open elements
        self.blocks = [0]
        self.parts: list[str] = []
        self.links = self.skip = self.marked = 0
        self.link_chars = 0
        self._node("html", "", False)

    def _node(self, tag: str, names: str, gold: bool) -> int:
        p = self.page
        bits = 0
        for w in _SPLIT.split(names):
            if w:
                bits |= _groups(w.lower())
        p.tag.append(tag)
        p.parent.append(self.blocks[-1] if p.parent else -1)
        p.groups.append(bits)
        p.text.append("")
        p.link.append(0)
        p.gold.append(gold)
        return len(p.tag) - 1

    def _push(self, tag: str, node: int, gold: bool = False) -> None:
        self.open.append((tag, node, gold))
        self.names[tag] += 1
        self.marked += gold
        self.links += tag == "a" and node == -1
        self.skip += node == -2
        if node >= 0:
            self.blocks.append(node)

    def _drop(self, k: int, end: int | None = None) -> None:
        """Close the open elements from k to end."""
        for tag, node, gold in self.open[k:end]:
            self.names[tag] -= 1
            self.marked -= gold
            self.links -= tag == "a" and node == -1
            self.skip -= node == -2
            if node >= 0:
                self.blocks.pop()
        del self.open[k:end]

    def _flush(self) -> None:
        if self.parts:
            text = _SPACES.sub(" ", "".join(self.parts)).strip()
            if text:
                i = self._node("#text", "", self.marked > 0)
                self.page.text[i], self.page.link[i] = text, min(self.link_chars, len(text))
            self.parts.clear()
        self.link_chars = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skip and tag in BLOCKS and self.open[-1][0] in FIELDS:
            while self.open and self.open[-1][0] in FIELDS:
                self._drop(len(self.open) - 1)
        if self.skip and self.names["svg"] and tag in BREAKOUT and not any(self.names[x] for x in HOLDS_HTML):
            self._drop(max(k for k, x in enumerate(self.open) if x[0] == "svg"))
        if tag == "option" and self.open and self.open[-1][0] == tag:  # implied end
            self._drop(len(self.open) - 1)
        if tag in SKIP or self.skip:
            if tag not in VOID:
                self._push(tag, -2)
            if tag == "textarea" and self.field_ends:  # its tags are text
                self.set_cdata_mode(tag)
            return
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in INLINE:
            self._push(tag, -1)
            return
        self._flush()
        if tag in VOID:
            return
        if any(self.names[other] for other in CLOSES.get(tag, ())):  # implied ends
            for k in range(len(self.open) - 1, -1, -1):
                other = self.open[k][0]
                if tag in CLOSED_BY.get(other, ()):
                    self._drop(k)
                    break
                if other in LISTS:
                    break
        if tag in ("html", "body") and self.names[tag]:
            return
        named = dict(attrs)
        gold = "data-gold" in named
        names = " ".join(named.get(k) or "" for k in ("class", "id", "role", "itemprop", "aria-label"))
        self._push(tag, 0 if tag == "html" else self._node(tag, names, gold), gold)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "section", "article", "li"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.field_ends -= tag == "textarea"
        if not self.names[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            other, node, _ = self.open[k]
            if other == tag:
                if node == -1:
                    if not self.skip:
                        self._drop(k, k + 1)
                    return
                if node >= 0:
                    self._flush()
                self._drop(k)  # and all that is still open in it
                return
            if tag in INLINE and node >= 0 and other in LISTS:
                return

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)
            if self.links > 0:
                self.link_chars += len(_SPACES.sub(" ", data))


def parse(html: str | None) -> Page:
    p = _Parser(html or "")
    p.feed(html or "")
    p.close()
    p._flush()
    return p.page


def _below(values: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum over each node's subtree, which is the nodes up to its end."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[end] - total[:-1]


def features(pages: list[Page]) -> np.ndarray:
    """One row per node of all pages, one page after another."""
    if not pages:
        return np.zeros((0, 1), np.float32)
    n = sum(len(p.tag) for p in pages)
    parent, end, depth, index, kids, root = (np.zeros(n, np.int64) for _ in range(6))
    outer, above = np.zeros(n, np.int64), np.zeros(n, np.int64)
    outer_bit = {t: 1 << k for k, t in enumerate(OUTER)}
    at = 0
    for page in pages:
        m = len(page.tag)
        up = page.parent
        size, deep, place, many, out, over = [1] * m, [0] * m, [0] * m, [0] * m, [0] * m, [0] * m
        for i in range(1, m):
            q = up[i]
            deep[i] = deep[q] + 1
            place[i] = many[q]
            many[q] += 1
            out[i] = out[q] | outer_bit.get(page.tag[q], 0)
            over[i] = over[q] | page.groups[q]
        for i in range(m - 1, 0, -1):
            size[up[i]] += size[i]
        own = slice(at, at + m)
        parent[own] = up
        parent[at] = 0
        parent[own] += at
        end[own] = size
        depth[own], index[own], kids[own], outer[own], above[own], root[own] = deep, place, many, out, over, at
        at += m
    end += np.arange(n)
    tags = [t for p in pages for t in p.tag]
    number = np.array([TAG_NO.get(t, -1) for t in tags])
    groups = np.array([g for p in pages for g in p.groups])
    length = np.array([len(t) for p in pages for t in p.text])
    leaf = number == TAG_NO["#text"]
    marks = np.array([len(_PUNCTUATION.findall(t)) if t else 0 for p in pages for t in p.text])
    before = np.cumsum(length) - length
    before -= before[root]
    chars, links, leaves = _below(length, end), _below(np.array([x for p in pages for x in p.link]), end), _below(leaf, end)
    marks, paragraphs = _below(marks, end), _below(number == TAG_NO["p"], end)
    article = _below((number == TAG_NO["article"]) | (number == TAG_NO["main"]), end)
    nodes, some, total = end - np.arange(n), np.maximum(chars, 1), np.maximum(chars[root], 1)
    dense = np.column_stack([
        np.log1p(chars), np.log1p(chars / np.maximum(leaves, 1)), links / some, np.log(nodes), chars / nodes, depth, index / np.maximum(kids[parent], 1), kids[parent],
        chars / total, before / total, marks / some, links[parent] / some[parent], chars / some[parent], paragraphs[parent], paragraphs, (before + chars) / total,
        article > 0, article[root] > 0, number[parent], above > 0, links[root] / total, np.log1p(total), np.isin(number[parent], [TAG_NO[t] for t in ("p", "li", "h1", "h2", "h3", "blockquote")]),
    ])
    bits = [v[:, None] >> np.arange(k) & 1 for v, k in ((groups, len(GROUPS)), (above, len(GROUPS)), (outer, len(OUTER)))]
    return np.column_stack([dense, number[:, None] == np.arange(len(TAGS)), *bits]).astype(np.float32)


@dataclass
class Trees:
    """Complete trees: column and cut per inner node, value per leaf; a row goes right where it is above the cut."""

    depth: int
    column: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for c, t, v in zip(self.column, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, c[at]] > t[at])
            out += v[at - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 5, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Gradient boosting of logistic loss with histogram splits."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(m)]
    code = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]).astype(np.int64)
    p0 = float((y * weight).sum() / weight.sum())
    bias = float(np.log(p0 / (1 - p0)))
    margin = np.full(n, bias)
    inner, leaves = 2**depth - 1, 2**depth
    columns, limits, values = [], [], []
    base = np.arange(m) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = (y - p) * weight, p * (1 - p) * weight
        at = np.zeros(n, np.int64)
        column, limit = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for d in range(depth):
            first, width = 2**d - 1, 2**d
            slot = ((at - first)[:, None] * (m * bins) + base + code).reshape(-1)
            gs = np.bincount(slot, np.repeat(g, m), width * m * bins).reshape(width, m, bins)
            hs = np.bincount(slot, np.repeat(h, m), width * m * bins).reshape(width, m, bins)
            gl, hl = gs.cumsum(2)[:, :, :-1], hs.cumsum(2)[:, :, :-1]
            gt, ht = gs.sum(2)[:, :, None], hs.sum(2)[:, :, None]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < 1e-3) | (ht - hl < 1e-3)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins - 1)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    column[first + k], limit[first + k] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(n), column[at]] > limit[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        margin += value[leaf]
        columns.append(column)
        limits.append(limit)
        values.append(value)
    return Trees(depth, np.array(columns), np.array(limits), np.array(values), bias)


def decode(page: Page, margin: np.ndarray) -> np.ndarray:
    """Kept or not, per node: the most likely labelling in which every kept node's parent is kept, and every kept block holds a kept leaf."""
    n = len(page.tag)
    # log-likelihood of keeping against leaving out; long leaves count for more than short ones
    worth = margin * np.array([1 + np.log1p(len(t)) for t in page.text])
    gain = np.zeros(n)
    within = np.zeros(n)  # of a node's kept children
    best = np.full(n, -np.inf)
    for i in range(n - 1, -1, -1):
        if page.tag[i] == "#text":
            gain[i] = worth[i]
        else:
            gain[i] = worth[i] + (within[i] if within[i] > 0 else best[i])
        if i:
            p = page.parent[i]
            within[p] += max(gain[i], 0)
            best[p] = max(best[p], gain[i])
    keep = np.zeros(n, bool)
    keep[0] = gain[0] > 0
    for i in range(1, n):
        keep[i] = keep[page.parent[i]] and gain[i] > 0
    return keep


# --- pages made by rule ---------------------------------------------------

SYLLABLES = "ka lo mi ne ru sta ven tor il ath en ou bre chi dal por que und ier ment tion ing ed é ü ñ os la".split()


def _words(rng: random.Random, n: int) -> str:
    out = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for i in range(rng.randint(5, 14), n, rng.randint(6, 16)):
        out[i] += rng.choice([".", ".", ",", "?", "!"])
    return " ".join(out).capitalize() + rng.choice([".", ".", "."])


def _short(rng: random.Random, most: int = 4) -> str:
    return _words(rng, rng.randint(1, most)).rstrip(".")


def _links(rng: random.Random, n: int, wrap: str = "ul") -> str:
    items = [f'<a href="/{i}">{_short(rng, rng.choice([1, 1, 4]))}{rng.choice(["", "", "", ",", ".", "!", "***"])}</a>' for i in range(n)]
    if wrap == "ul":
        return "<ul>" + "".join(f"<li>{x}" + rng.choice(["</li>", ""]) for x in items) + "</ul>"
    return rng.choice([" ", " | ", ""]).join(items)


def _part(rng: random.Random, tag: str, names: list[str], body: str, plain: float) -> str:
    """A boilerplate block: by its own tag, by a div with telling names, or by a div that tells nothing."""
    u = rng.random()
    if u < 0.55:
        return f"<{tag}{_attrs(rng, names, 0.5)}>{body}</{tag}>"
    if u < 1 - plain:
        return f"<div{_attrs(rng, names, 1)}>{body}</div>"
    return f"<div{_attrs(rng, ['x' + str(rng.randint(1, 99)), 'box', 'row', 'c1', 'wrap'], 0.5)}>{body}</div>"


def _attrs(rng: random.Random, names: list[str], share: float) -> str:
    if rng.random() > share:
        return ""
    return f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}"'


def _comments(rng: random.Random) -> str:
    each = "".join(rng.choice(['<div class="comment">{}</div>', "<li>{}</li>", "<div>{}</div>", '<div class="reply"><b>{}</b></div>', '<article class="comment">{}</article>']).format(f"<p>{_words(rng, rng.randint(4, 60))}</p>") for _ in range(rng.randint(1, 6)))
    return rng.choice(['<section class="comments">{}</section>', '<div id="comments">{}</div>', '<section id="comments"><h2>Comments</h2>{}</section>', '<ol class="comment-list">{}</ol>', '<div class="comments-area">{}</div>', '<section class="reader-comments">{}</section>']).format(each)


def _body(rng: random.Random) -> str:
    """Main text: headings, paragraphs, lists, quotes, tables; some tags stay open."""
    out = []
    if rng.random() < 0.85:
        out.append(f"<h1>{_words(rng, rng.randint(1, 14))}</h1>")
        if rng.random() < 0.15:
            out[-1] = f"<header>{out[-1]}</header>"
    for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20])):
        u = rng.random()
        text = _words(rng, rng.choice([1, 2, 4, 8, 20, 40, 80, 160]))
        if u < 0.06:
            k = rng.randint(2, 4)
            out.append(f"<h{k}>{_short(rng, 8)}</h{k}>")
        elif u < 0.12:
            out.append("<ul>" + "".join(f"<li>{_words(rng, rng.randint(1, 20))}</li>" for _ in range(rng.randint(1, 6))) + "</ul>")
        elif u < 0.16:
            out.append(f"<blockquote>{rng.choice(['<p>', ''])}{text}</blockquote>")
        elif u < 0.19:
            out.append(f"<pre>{text}</pre>")
        elif u < 0.22:
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{_short(rng)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>")
        elif u < 0.25:
            out.append(f"<div><p>{text}</p></div>")
        elif u < 0.33:
            out.append(f"<p><b>{text}<br>")
        elif u < 0.4:
            out.append(f'<p>{text} <a href="/a">{_short(rng, 3)}</a> {_words(rng, rng.randint(1, 12))}</p>')
        else:
            out.append(f"<p>{text}" + rng.choice(["</p>", "</p>", ""]))
    return "".join(out)


def made_page(seed: int) -> str:
    """A page; its main text stands in the elements with data-gold, all else is boilerplate."""
    rng = random.Random(seed)
    plain = rng.choice([0.0, 0.1, 0.3])
    top, left, right, bottom = [], [], [], []
    chance = lambda p: rng.random() < p
    if chance(0.6):
        top.append(_part(rng, "header", ["header", "site-header", "masthead", "top-bar"], rng.choice([f"<h1>{_short(rng)}</h1>", f"<a href='/'>{_short(rng)}</a>", f"<p>{_words(rng, rng.randint(1, 20))}</p>", f"<div>{_short(rng)}</div>" + _links(rng, 4)]), plain))
    if chance(0.8):
        top.append(_part(rng, "nav", ["nav", "main-menu", "navbar", "breadcrumbs", "menu"], _links(rng, rng.randint(2, 12), rng.choice(["ul", "ul", "flat"])), plain))
    if chance(0.4):
        rng.choice([top, bottom]).append(_part(rng, "div", ["cookie-notice", "notice", "consent", "cookie-banner", "gdpr", "notice notice-info", "alert"], f"<p>{_words(rng, rng.randint(4, 40))}</p>" + rng.choice(["", "<button>Ok</button>", '<a href="/p">More</a>']), 0))
    if chance(0.6):
        rng.choice([top, left, right, bottom]).append(_part(rng, "div", ["ad", "ads", "advert", "sponsored", "promo", "ad-slot", "advertisement", "ad-banner", "adbanner"], rng.choice([_words(rng, rng.randint(2, 40)), f"<p>{_words(rng, rng.randint(2, 40))}</p>", _words(rng, 5) + "\n" + _words(rng, 9)]), 0))
    if chance(0.5):
        rng.choice([left, right]).append(_part(rng, "aside", ["sidebar", "widget", "related", "side-bar", "popular"], f"<h3>{_short(rng)}</h3>" * chance(0.6) + rng.choice([_links(rng, rng.randint(2, 10)), f"<p>{_words(rng, rng.randint(4, 60))}</p>", _links(rng, 3) + f"<p>{_words(rng, 20)}</p>"]), plain))
    if chance(0.35):
        rng.choice([top, right, bottom]).append(_part(rng, "form", ["search-form", "newsletter", "subscribe", "login"], f"<label>{_short(rng)}</label><input type=text>" + f"<p>{_words(rng, rng.randint(2, 25))}</p>" * chance(0.5) + "<button>Go</button>", 0))
    if chance(0.45):
        bottom.insert(0, _comments(rng))
    if chance(0.85):
        bottom.append(_part(rng, "footer", ["footer", "site-footer", "copyright"], rng.choice([f"&copy; {_words(rng, rng.randint(2, 30))}", f"<p>{_words(rng, rng.randint(4, 40))}</p>", _links(rng, 5) + f"<p>&copy; {_short(rng)}</p>", f"&copy; x.example &middot; {_words(rng, 8)}\n{_words(rng, 5)}"]), plain))
    kind = rng.choice(["article", "article", "article", "main", "named", "section", "plain"])
    tag = {"article": "article", "main": "main", "section": "section"}.get(kind, "div")
    attrs = _attrs(rng, ["content", "article-body", "post", "entry-content", "story", "main-content", "post-body", "maincontent", "text"], 1 if kind == "named" else 0.3) if kind != "plain" else ""
    text = _body(rng)
    cut = text.find("<p>", len(text) // 2)
    if chance(0.2) and cut > 0:  # boilerplate in the midst of the main text
        inner = rng.choice(['<div class="ad">{}</div>', '<aside class="related">{}</aside>', '<aside>{}</aside>', '<div class="newsletter"><form>{}</form></div>', '<div class="share">{}</div>']).format(_words(rng, rng.randint(2, 25)))
        if chance(0.3):
            inner = f'<nav class="toc">{_links(rng, 4)}</nav>'
        main = f"<{tag}{attrs}><div data-gold>{text[:cut]}</div>{inner}<div data-gold>{text[cut:]}</div></{tag}>"
    elif chance(0.15):
        main = f"<{tag}{attrs}><div data-gold>{text}</div>{_comments(rng)}</{tag}>"
    else:
        main = f"<{tag}{attrs} data-gold>{text}</{tag}>"
    if chance(0.2) and tag != "main":
        main = f"<main>{main}</main>"
    for _ in range(rng.choice([0, 0, 0, 1, 2])):
        main = f"<div{_attrs(rng, ['wrap', 'row', 'col', 'inner', 'center'], 0.7)}>{main}</div>"
    if chance(0.3):
        body = "".join(top) + f"<div{_attrs(rng, ['wrap', 'container', 'page', 'layout'], 0.7)}>" + "".join(left) + main + "".join(right) + "</div>" + "".join(bottom)
    else:
        body = "".join(top + left) + main + "".join(right + bottom)
    return f"<!DOCTYPE html><html><head><title>{_short(rng)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


@cache
def model(pages: int = PAGES) -> Trees:
    """The fitted trees; the same whenever and wherever they are fitted."""
    ys, ws, made = [], [], [parse(made_page(seed)) for seed in range(pages)]
    for page in made:
        n = len(page.tag)
        gold = np.array(page.gold) & np.array([t == "#text" for t in page.tag])
        for i in range(n - 1, 0, -1):
            gold[page.parent[i]] |= gold[i]
        ys.append(gold)
        ws.append(1 + np.log1p(np.array([len(t) for t in page.text])) / 4)
    return boost(features(made), np.concatenate(ys).astype(np.float64), np.concatenate(ws))


#: Elements and names of boilerplate.
_NOT_MAIN = ("nav", "header", "footer", "aside", "form")
_NAMED = sum(1 << i for i, g in enumerate(GROUPS) if g != "main")


def unmarked(page: Page) -> np.ndarray:
    """Leaves of a page that stand in no element or name of boilerplate and aren't mostly links."""
    bad = [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        bad[i] = bad[page.parent[i]] or page.tag[i] in _NOT_MAIN or bool(page.groups[i] & _NAMED)
    return np.array([bool(t) and not b and 2 * k <= len(t) for t, b, k in zip(page.text, bad, page.link, strict=True)], bool)


def main_texts(htmls: list[str | None], trees: Trees) -> list[str]:
    pages = [parse(h) for h in htmls]
    margins = trees.margin(features(pages))
    out, at = [], 0
    for p in pages:
        n = len(p.tag)
        keep = decode(p, margins[at : at + n])
        at += n
        if not any(t and k for t, k in zip(p.text, keep.tolist(), strict=True)):
            keep = unmarked(p)
        out.append("\n".join(t for t, k in zip(p.text, keep.tolist(), strict=True) if k and t))
    return out


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages."""
    shared = pages.sparkSession.sparkContext.broadcast(trees or model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                texts = main_texts(b.column("html").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
