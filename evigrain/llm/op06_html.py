"""Main text of web pages by gradient-boosted trees over DOM nodes.

* :func:`parse` builds a DOM in one pass over the page: comments, scripts,
  styles and other parts that are never text are left out; open elements are
  closed as browsers do for paragraphs, items and cells. Text beside block
  elements is a node of its own.
* :func:`features` describes each node: size, density and link share of its
  subtree, tokens of its tag, class, id and role (its own and its ancestors'),
  depth, and where it stands among its siblings.
* :class:`Boosted` (depth-limited regression trees on logistic loss, histogram
  splits) scores nodes. It is trained here, with a fixed seed, on pages that
  :func:`sample_page` makes up, whose nodes it labels as it writes them.
* :func:`decode` picks nodes under the rule that a node's ancestors are picked
  too. Of all such choices it finds the one with the largest sum of log odds,
  by one pass up the tree and one down; so no text is kept inside a dropped
  part, and no container is kept for nothing.

Defined cases: a null or empty page, or one without article text, gives the
empty text; broken markup is read as far as it goes; pages of any length are
read whole; every input row gives one row; an empty table gives an empty
result; input columns other than those kept are dropped, and one named as an
output column gives way to it.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, text_or_empty

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SKIPPED = frozenset("script style template noscript iframe object svg math head title textarea select button canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: A start tag of the first kind ends an open element of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An end tag or an implied end doesn't reach past these.
WALLS = frozenset("body article main section aside nav header footer table td th ul ol div form blockquote".split())
TOKEN = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: What tokens of tags and attributes speak of.
THEMES: dict[str, frozenset[str]] = {
    "nav": frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toolbar skip toc".split()),
    "head": frozenset("header masthead banner topbar logo branding".split()),
    "foot": frozenset("footer foot copyright colophon legal imprint contentinfo".split()),
    "side": frozenset("aside sidebar side rail widget related recommended trending popular more complementary".split()),
    "notice": frozenset("notice cookie cookies consent gdpr alert modal popup overlay message disclaimer toast".split()),
    "ad": frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner dfp".split()),
    "form": frozenset("form search login signup subscribe newsletter subscription register fieldset input".split()),
    "comment": frozenset("comment comments commentlist disqus discussion replies reply respond reviews".split()),
    "share": frozenset("share sharing social follow likes rating tags meta byline".split()),
    "main": frozenset("article main content post entry story body text prose hentry blog page".split()),
}
TAGS = "p h1 h2 h3 a ul ol li div section article main nav aside header footer form table td blockquote pre figure #text".split()
NAMES = [*(f"tag_{t}" for t in TAGS), *(f"own_{t}" for t in THEMES), *(f"above_{t}" for t in THEMES), *"chars words link_share punct mean_word depth children paragraphs blocks density index siblings same_tag sibling_share page_share start".split()]


class Node:
    __slots__ = ("tag", "parent", "themes", "text", "first", "children", "chars", "words", "linked", "punct", "paragraphs", "blocks", "nodes", "depth", "start")

    def __init__(self, tag: str, parent: int, themes: int, depth: int, start: int):
        self.tag, self.parent, self.themes, self.depth, self.start = tag, parent, themes, depth, start
        self.children: list[int] = []
        self.chars = self.words = self.linked = self.punct = self.paragraphs = self.blocks = self.nodes = 0


@functools.lru_cache(maxsize=4096)
def themes_in(tag: str, named: str) -> int:
    """A bit for each theme that a tag or the words of its names speak of."""
    words = {tag, *TOKEN.findall(CAMEL.sub(" ", named).lower())}
    return sum(1 << i for i, known in enumerate(THEMES.values()) if words & known)


def themes_of(tag: str, attributes: str) -> int:
    """Of the tag and its class, id and role, wherever they stand among its attributes."""
    return themes_in(tag, " ".join(m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)))


#: A tag from behind its <: quotes after = are closed before the >, if they are closed at all.
TAG_REST = re.compile(r"""(?:[^>="']++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+>""")


def tag_end(page: str, start: int) -> int:
    """Where the tag at ``start`` ends: its >, those in quotes aside."""
    found = TAG_REST.match(page, start + 1)
    return found.end() - 1 if found else -1


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(Nodes, in page order, and the texts, each with its node; -1 is a break)."""
    nodes = [Node("#root", -1, 0, 0, 0)]
    texts: list[tuple[int, str]] = []
    stack = [0]
    at, n = 0, len(page)

    def put(raw: str) -> None:
        if raw:
            texts.append((stack[-1], html.unescape(raw)))

    def close(depth: int) -> None:
        for k in stack[depth:]:
            if nodes[k].tag not in INLINE:
                texts.append((-1, " "))
        del stack[depth:]

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            put(page[at:])
            break
        after = page[lt + 1 : lt + 2]
        if not (after.isalpha() or after in ("/", "!", "?")) or not after:
            put(page[at : lt + 1])
            at = lt + 1
            continue
        put(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if after in "!?":
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        end = tag_end(page, lt)
        if end < 0:
            break
        body = page[lt + 1 : end]
        at = end + 1
        m = re.match(r"/?\s*([a-zA-Z][^\s/>]*)", body)
        if not m:
            continue
        tag = m[1].lower()
        if after == "/":
            for k in range(len(stack) - 1, 0, -1):
                other = nodes[stack[k]].tag
                if other == tag:
                    close(k)
                    break
                if (tag in INLINE or tag == "p" or tag in ENDS) and other in WALLS:
                    break
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                texts.append((-1, " "))
            continue
        if tag in SKIPPED:
            if not body.endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                if stop:
                    at = stop.end()
                elif tag not in ("head", "noscript", "button", "select"):
                    at = n
            continue
        if tag not in INLINE:
            ended = ENDS.get(tag) or {"p"}
            for k in range(len(stack) - 1, 0, -1):
                other = nodes[stack[k]].tag
                if other in ended:
                    close(k)
                    break
                if other in WALLS and other not in ended:
                    break
            texts.append((-1, " "))
        parent = stack[-1]
        nodes.append(Node(tag, parent, themes_of(tag, body[m.end() :]), nodes[parent].depth + 1, lt))
        nodes[parent].children.append(len(nodes) - 1)
        stack.append(len(nodes) - 1)
    return own_texts(nodes, texts)


def own_texts(nodes: list[Node], texts: list[tuple[int, str]]) -> tuple[list[Node], list[tuple[int, str]]]:
    """Give text that stands beside block elements a node of its own."""
    mixed = {i for i, v in enumerate(nodes) if any(nodes[c].tag not in INLINE for c in v.children)}
    out, made = [], -1
    for i, t in texts:
        if i in mixed and not t.isspace():
            if made < 0 or nodes[made].parent != i:
                v = nodes[i]
                nodes.append(Node("#text", i, 0, v.depth + 1, v.start))
                v.children.append(len(nodes) - 1)
                made = len(nodes) - 1
            out.append((made, t))
        else:
            made = -1 if i < 0 else made
            out.append((i, t))
    return nodes, out


def features(nodes: list[Node], texts: list[tuple[int, str]], size: int) -> np.ndarray:
    """A row for each node."""
    for i, t in texts:
        if i < 0:
            continue
        v = nodes[i]
        s = t.strip()
        if s:
            v.chars += len(s)
            v.words += s.count(" ") + 1
            v.punct += s.count(".") + s.count(",") + s.count("!") + s.count("?") + s.count(";")
            if v.tag == "a":
                v.linked += len(s)
    order = sorted(range(1, len(nodes)), key=lambda i: -nodes[i].depth)
    for i in order:
        v = nodes[i]
        if v.tag == "a":
            v.linked = v.chars
        p = nodes[v.parent]
        p.chars += v.chars
        p.words += v.words
        p.punct += v.punct
        p.linked += v.linked
        p.nodes += v.nodes + 1
        p.paragraphs += v.paragraphs + (v.tag == "p")
        p.blocks += v.blocks + (v.tag not in INLINE)
    total = max(1, nodes[0].chars)
    tags = {t: k for k, t in enumerate(TAGS)}
    n_tags, n_themes = len(TAGS), len(THEMES)
    out = np.zeros((len(nodes), len(NAMES)), np.float32)
    above = [0] * len(nodes)
    rest = n_tags + 2 * n_themes
    themes = np.zeros((len(nodes), 2), np.int64)
    numbers = []
    # where a node stands among its parent's children, and how many of them have its tag
    place = {c: k for v in nodes for k, c in enumerate(v.children)}
    alike = [Counter(nodes[c].tag for c in v.children) for v in nodes]
    for i in reversed(order):
        v = nodes[i]
        p = nodes[v.parent]
        above[i] = above[v.parent] | p.themes
    for i, v in enumerate(nodes):
        p = nodes[v.parent] if i else v
        k = tags.get(v.tag)
        if k is not None:
            out[i, k] = 1
        themes[i] = v.themes, above[i]
        index, same = (place[i], alike[v.parent][v.tag]) if i else (0, 0)
        chars = v.chars
        numbers.append((math.log1p(chars), math.log1p(v.words), v.linked / chars if chars else 0, v.punct / v.words if v.words else 0, chars / v.words if v.words else 0, v.depth, len(v.children), math.log1p(v.paragraphs), math.log1p(v.blocks), chars / (v.nodes + 1), index, len(p.children), same, chars / max(1, p.chars), chars / total, v.start / max(1, size)))
    bits = 1 << np.arange(n_themes)
    out[:, n_tags : n_tags + n_themes] = (themes[:, :1] & bits) > 0
    out[:, n_tags + n_themes : rest] = (themes[:, 1:] & bits) > 0
    out[:, rest:] = numbers
    return out


class Boosted:
    """Gradient-boosted trees for yes and no, grown by histograms of quantile bins."""

    def __init__(self, trees: int = 80, depth: int = 5, rate: float = 0.25, bins: int = 32, least: float = 5.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
        n, m = x.shape
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        score = np.full(n, self.base)
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature = np.zeros((self.trees, inner), np.int32)
        self.cut = np.full((self.trees, inner), np.inf, np.float32)
        self.leaf = np.zeros((self.trees, leaves), np.float32)
        width = self.bins + 1
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                for k in range(2**level):
                    rows = np.flatnonzero(at == k)
                    if not len(rows):
                        continue
                    flat = (binned[rows] + np.arange(m) * width).ravel()
                    gs = np.bincount(flat, np.repeat(g[rows], m), m * width).reshape(m, width).cumsum(1)
                    hs = np.bincount(flat, np.repeat(h[rows], m), m * width).reshape(m, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < self.least) | (ht - hs < self.least)] = 0
                    f, b = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[f, b] > 1e-6 and b < len(cuts[f]):
                        self.feature[t, first + k], self.cut[t, first + k] = f, cuts[f][b]
                right = x[np.arange(n), self.feature[t, first + at]] > self.cut[t, first + at]
                at = 2 * at + right
            gsum, hsum = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
            self.leaf[t] = self.rate * gsum / (hsum + 1)
            score += self.leaf[t][at]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                k = 2**level - 1 + at
                at = 2 * at + (x[rows, f[k]] > c[k])
            out += leaf[at]
        return out


def decode(parents: Sequence[int], depths: Sequence[int], odds: np.ndarray) -> np.ndarray:
    """The choice of nodes, closed under parents, with the largest sum of log odds; the root is free."""
    n = len(parents)
    best = np.array(odds, float)
    best[0] = 0
    order = sorted(range(1, n), key=lambda i: -depths[i])
    for i in order:
        if best[i] > 0:
            best[parents[i]] += best[i]
    picked = np.zeros(n, bool)
    picked[0] = True
    for i in reversed(order):
        picked[i] = picked[parents[i]] and best[i] > 0
    return picked


# Pages to learn from: (tag, class) of each kind of part. None of their words are those of any table.
BOILERPLATE = {
    "nav": [("nav", ""), ("div", "menu"), ("ul", "navigation"), ("div", "breadcrumbs"), ("nav", "navbar main-menu"), ("div", "pagination")],
    "head": [("header", ""), ("div", "masthead"), ("div", "site-header"), ("header", "page-header banner")],
    "foot": [("footer", ""), ("div", "footer"), ("div", "copyright"), ("footer", "site-footer legal")],
    "side": [("aside", ""), ("div", "sidebar"), ("div", "related-posts"), ("section", "widget"), ("aside", "trending")],
    "notice": [("div", "cookie-notice"), ("div", "notice"), ("section", "alert"), ("p", "disclaimer"), ("div", "modal popup")],
    "ad": [("div", "ad"), ("div", "ads"), ("div", "advertisement"), ("p", "sponsored"), ("section", "promo"), ("aside", "advert")],
    "form": [("form", ""), ("div", "newsletter"), ("form", "search-form"), ("div", "subscribe")],
    "comment": [("div", "comments"), ("section", "comments"), ("ol", "commentlist"), ("div", "discussion"), ("article", "comment"), ("div", "user-comments replies")],
    "share": [("div", "share"), ("div", "social-links"), ("ul", "tags")],
}
CONTENT = [("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "entry-content"), ("section", "story"), ("div", ""), ("div", "post"), ("div", "text")]


def sample_page(rnd: random.Random) -> str:
    """A made-up page; what is article text carries the mark \\x01."""
    vocabulary = ["".join(rnd.choice(("ba", "ko", "li", "mu", "ne", "ta", "ri", "so", "ve", "zu")) for _ in range(rnd.randint(1, 4))) for _ in range(60)]

    def prose(lo: int, hi: int, mark: str = "") -> str:
        words = [rnd.choice(vocabulary) + (rnd.choice(".,") if rnd.random() < 0.15 else "") for _ in range(rnd.randint(lo, hi))]
        if len(words) > 3 and rnd.random() < 0.3:
            k = rnd.randrange(len(words))
            words[k] = rnd.choice(('<a href="/x">{}</a>', "<b>{}</b>", "<em>{}</em>", "{}<br>")).format(words[k])
        return mark + " ".join(words)

    def part(kind: str) -> str:
        tag, name = rnd.choice(BOILERPLATE[kind])
        if kind in ("nav", "share") or kind in ("foot", "side", "head") and rnd.random() < 0.5:
            items = "".join(f'<li><a href="/{i}">{prose(1, 3)}</a></li>' for i in range(rnd.randint(2, 8)))
            inner = items if tag in ("ul", "ol") else f"<ul>{items}</ul>"
        elif kind == "comment":
            inner = "".join(rnd.choice(("<div>{}</div>", "<p>{}</p>", '<div class="comment"><p>{}</p></div>', "<li>{}</li>")).format(prose(3, 40)) for _ in range(rnd.randint(1, 5)))
        elif kind == "form":
            inner = f"<label>{prose(1, 6)}</label><input name=q>"
        else:
            inner = rnd.choice(("{}", "<p>{}</p>", "<div>{}</div>")).format(prose(1, 30))
        attr = rnd.choice((f' class="{name}"', f' id="{name.split()[0]}"')) if name else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def some(kinds: Sequence[str], share: float) -> str:
        return "".join(part(k) for k in rnd.sample(kinds, len(kinds)) if rnd.random() < share)

    tag, name = rnd.choice(CONTENT)
    blocks = [rnd.choice(("<h1>{}</h1>", "<h2>{}</h2>")).format(prose(1, 10, "\x01"))] if rnd.random() < 0.6 else []
    for _ in range(rnd.randint(1, 12)):
        kind = rnd.random()
        if kind < 0.75:
            blocks.append(f"<p>{prose(*((1, 4) if rnd.random() < 0.2 else (8, 90)), '\x01')}" + ("</p>" if rnd.random() < 0.9 else ""))
        elif kind < 0.82:
            blocks.append("<ul>" + "".join(f"<li>{prose(2, 15, '\x01')}</li>" for _ in range(rnd.choice((2, 3, 5, 60)))) + "</ul>")
        elif kind < 0.88:
            blocks.append(f"<blockquote><p>{prose(5, 40, '\x01')}</p></blockquote>")
        elif kind < 0.92:
            blocks.append(f"<h2>{prose(1, 6, '\x01')}</h2>")
        else:
            blocks.append(part(rnd.choice(("ad", "share", "side", "notice", "form"))))
    if rnd.random() < 0.2:
        blocks.append(part("comment"))
    attr = rnd.choice((f' class="{name}"', f' id="{name.split()[0]}"')) if name else ""
    # some articles have no element of their own, some lie deep
    content = "".join(blocks) if rnd.random() < 0.15 else f"<{tag}{attr}>{''.join(blocks)}</{tag}>"
    if rnd.random() < 0.12:
        depth = rnd.choice((3, 10, 40, 200))
        content = "<div>" * depth + content + "</div>" * depth
    for _ in range(rnd.choice((0, 0, 1, 2))):
        content = f"<div{rnd.choice(('', ' class=\"wrapper\"', ' id=\"page\"', ' class=\"container\"'))}>{some(['ad', 'nav', 'notice'], 0.2)}{content}{some(['side', 'comment'], 0.25)}</div>"
    # some pages begin or end with the article
    before, after = rnd.choice((0, 0.3, 0.6)), rnd.choice((0, 0.3, 0.6))
    return f"<html><body>{some(['head', 'nav', 'notice', 'ad', 'form'], before)}{content}{some(['comment', 'side', 'foot', 'share', 'ad'], after)}</body></html>"


@functools.lru_cache(maxsize=2)
def trained(pages: int = 900, seed: int = 7) -> Boosted:
    """The model: the same one in every run."""
    rnd = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        page = sample_page(rnd)
        nodes, texts = parse(page)
        keep = {i for i, t in texts if "\x01" in t}
        # a mark opens its block's text; inline parts of that block belong to it
        has = [i in keep for i in range(len(nodes))]
        for i, v in enumerate(nodes):
            if i and (v.tag in INLINE) and has[v.parent]:
                has[i] = True
        for i in sorted(range(1, len(nodes)), key=lambda i: -nodes[i].depth):
            if has[i]:
                has[nodes[i].parent] = True
        x = features(nodes, [(i, t.replace("\x01", "")) for i, t in texts], len(page))
        xs.append(x[1:])
        ys.append(np.array(has[1:], float))
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys))


def extract(pages: Sequence[str], model: Boosted) -> list[str]:
    """The main text of each page."""
    parsed = [parse(p) for p in pages]
    tables = [features(nodes, texts, len(p)) for (nodes, texts), p in zip(parsed, pages, strict=True)]
    if not tables:
        return []
    odds = model.log_odds(np.concatenate(tables))
    out, at = [], 0
    for nodes, texts in parsed:
        own = odds[at : at + len(nodes)].copy()
        # marks inside a line go with the line, unless they are links or speak of a theme
        own[[v.tag in INLINE and v.tag != "a" and not v.themes for v in nodes]] = 1e-6
        picked = decode([v.parent for v in nodes], [v.depth for v in nodes], own)
        at += len(nodes)
        picked[0] = False
        out.append(" ".join("".join(t for i, t in texts if i < 0 or picked[i]).split()))
    return out


def main_text(pages: DataFrame, *, html_column: str = "html", keep: Sequence[str] = ("page_id", "url"), model: Boosted | None = None) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def make():
        boosted = shared.value

        def work(values: list[str]) -> list[list]:
            texts = extract(values, boosted)
            return [texts, [len(t) for t in texts]]

        return work

    kept = [c for c in keep if c not in ("text", "n_chars")]
    rows = pages.select(*(F.col(f"`{c}`") for c in kept), text_or_empty(F.col(f"`{html_column}`")).alias("__html"))
    return add_columns(rows, "__html", [("text", T.StringType()), ("n_chars", T.LongType())], make, keep=kept)
