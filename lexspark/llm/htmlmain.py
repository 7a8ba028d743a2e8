"""Main text of HTML pages by gradient-boosted trees over DOM nodes.

One scan builds the tree (markup.py). Each element is described by its subtree's density
of text, links and punctuation, its tag, attribute tokens, depth, and how it compares with
its siblings. Boosted trees, trained here on generated pages of many layouts, score every
element; then a dynamic programme over the tree picks the most likely reading in which the
main text begins at an element, holds everything below it, and may leave out subtrees: an
ancestor and a descendant never contradict each other.

Scripts, styles, markup and form controls are never text, whatever the trees say.

One pass over the rows, no shuffle. Training takes a fixed number of generated pages. Time and
memory are linear in a page's length, whatever stands in it: what an end tag or a new element
closes is known from counts and places kept with each open element, never looked for.

Defined results: a null or empty html, or one without text, gives an empty text and
n_chars 0; broken markup is read as the HTML standard reads it as far as this tree goes
(unknown end tags are dropped, open elements end with the page, an unclosed tag or quote runs
to the end); rows are read one by one, so repeated rows give repeated results; columns other
than those named are not read; an empty table gives an empty result; a page of any length is
read whole. Of readings of equal weight the one that holds less is taken.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexspark.functions.layout import spread
from lexspark.llm.markup import attributes, scan
from lexspark.llm.words import sliced

SPACE = re.compile(r"\s+")
#: Elements by the part they play in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style textarea title noscript template iframe xmp noembed noframes svg math select option button object canvas audio video datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An element that starts ends an open one: (which, within the innermost of these). One slot of ``near`` each.
CLOSES = [
    ({"li"}, {"li"}, {"ul", "ol", "menu"}),
    ({"dt", "dd"}, {"dt", "dd"}, {"dl"}),
    ({"tr"}, {"tr"}, {"table"}),
    ({"td", "th"}, {"td", "th"}, {"tr", "table"}),
    ({"option"}, {"option"}, {"select"}),
]
PARAGRAPH_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
TAG_GROUPS = ["article main", "nav menu", "header", "footer", "aside", "form fieldset", "p blockquote pre", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "table tr td th tbody", "section", "div", "a", "body html", "figure figcaption"]
#: What class, id and role tokens often hold; each group is one feature.
TOKEN_GROUPS = [
    ("article", "content", "post", "entry", "story", "main", "body", "text"),
    ("nav", "menu", "breadcrumb", "crumbs", "toolbar", "tabs", "pagination", "pager"),
    ("head", "header", "masthead", "banner", "logo", "topbar"),
    ("foot", "footer", "copyright", "legal", "colophon"),
    ("side", "sidebar", "aside", "rail", "widget", "related", "recommended", "popular", "trending"),
    ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner-ad"),
    ("comment", "comments", "reply", "discussion", "disqus", "respond", "reader"),
    ("cookie", "consent", "notice", "alert", "gdpr", "popup", "modal", "newsletter", "subscribe", "signup"),
    ("share", "social", "follow", "tags", "author-bio", "byline", "meta"),
]
TOKEN_SPLIT = re.compile(r"[\s_\-:]+|(?<=[a-z])(?=[A-Z])")
GROUP_OF = {t: i for i, g in enumerate(TAG_GROUPS) for t in g.split()}
TOKEN_OF = {t: i for i, g in enumerate(TOKEN_GROUPS) for t in g}
CLOSED_BY = {t: i for i, (starts, _, _) in enumerate(CLOSES) for t in starts}
ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "sidebar", "main": "main"}
PARAGRAPHS = frozenset(("p", "blockquote", "pre"))


@dataclass
class Forest:
    """The elements of some pages as columns, in page order; each page's first element stands for the page."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)  # -1 of a page
    depth: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)  # last element of the subtree
    root: list[int] = field(default_factory=list)
    silent: list[bool] = field(default_factory=list)
    linked: list[bool] = field(default_factory=list)  # in a link
    prose: list[bool] = field(default_factory=list)  # in a paragraph, or an inline element of one
    tokens: list[tuple[int, int]] = field(default_factory=list)  # (element, token group)
    texts: list[str] = field(default_factory=list)
    owner: list[int] = field(default_factory=list)  # element of each text
    breaks: list[int] = field(default_factory=list)  # block edges before each text

    def element(self, tag: str, parent: int, root: int) -> int:
        me = len(self.tag)
        self.tag.append(tag)
        self.parent.append(parent)
        self.last.append(me)
        self.root.append(root if root >= 0 else me)
        top = parent < 0
        self.depth.append(0 if top else self.depth[parent] + 1)
        self.silent.append(tag in SILENT or (not top and self.silent[parent]))
        self.linked.append(tag == "a" or (not top and self.linked[parent]))
        self.prose.append(tag in PARAGRAPHS or (not top and tag in INLINE and self.prose[parent]))
        return me


def token_groups(source: str) -> set[int]:
    """Groups of the words in an element's class, id, role and itemprop."""
    out: set[str] = set()
    for name, value in attributes(source).items():
        if name in ("class", "id", "role", "itemprop"):
            out.update(t.lower() for t in TOKEN_SPLIT.split(value) if t)
            if name == "role":
                out.add(ROLES.get(value.lower(), ""))
    return {TOKEN_OF[t] for t in out if t in TOKEN_OF}


def parse(page: str, forest: Forest) -> None:
    """Add a page's elements and texts to a forest."""
    root = forest.element("#page", -1, -1)
    stack = [root]
    near = [(0,) * (len(CLOSES) + 1)]  # of each open element: place on the stack of what a start of each kind would close; the last: an open paragraph
    counts: dict[str, int] = {}
    edges = 0

    def close(k: int) -> None:
        nonlocal edges
        while len(stack) > k:
            x = stack.pop()
            near.pop()
            forest.last[x] = len(forest.tag) - 1
            counts[forest.tag[x]] -= 1
            edges += forest.tag[x] not in INLINE

    for text, tag, ends, source in scan(page):
        if text and not forest.silent[stack[-1]]:
            forest.texts.append(text)
            forest.owner.append(stack[-1])
            forest.breaks.append(edges)
        if not tag:
            continue
        if ends:
            if counts.get(tag):  # else it ends nothing
                k = len(stack) - 1
                while forest.tag[stack[k]] != tag:
                    k -= 1
                close(k)
            elif tag == "p":
                edges += 1
            continue
        if tag in PARAGRAPH_ENDS and near[-1][-1]:
            close(near[-1][-1])
        kind = CLOSED_BY.get(tag)
        if kind is not None and near[-1][kind]:
            close(near[-1][kind])
        me = forest.element(tag, stack[-1], root)
        edges += tag not in INLINE
        if "=" in source:
            forest.tokens.extend((me, g) for g in token_groups(source))
        if tag in VOID or (source.endswith("/") and tag in ("svg", "math")):
            continue
        place = len(stack)
        here = [place if tag in own else 0 if tag in until else before for (_, own, until), before in zip(CLOSES, near[-1], strict=False)]
        here.append(place if tag == "p" else near[-1][-1] if tag in INLINE else 0)
        stack.append(me)
        near.append(tuple(here))
        counts[tag] = counts.get(tag, 0) + 1
    close(1)
    forest.last[root] = len(forest.tag) - 1


N_FEATURES = 16 + len(TAG_GROUPS) + len(TOKEN_GROUPS)


def below_own(own: np.ndarray, last: np.ndarray) -> np.ndarray:
    """1 where an element has a mark itself, a half where only one above it has."""
    step = np.zeros((len(own) + 1, own.shape[1]))
    step[1:] += own
    np.subtract.at(step, last + 1, own)
    return np.maximum(own, 0.5 * (np.cumsum(step[:-1], axis=0) > 0.5))


def features(forest: Forest) -> np.ndarray:
    """One row an element."""
    n = len(forest.tag)
    parent, last, root, depth = (np.array(x) for x in (forest.parent, forest.last, forest.root, forest.depth))
    owner = np.array(forest.owner, np.int64)
    chars = [len(t.strip()) for t in forest.texts]
    words = [t.count(" ") + (c > 0) for t, c in zip(forest.texts, chars, strict=True)]
    stops = [t.count(".") + t.count(",") + t.count("!") + t.count("?") if c else 0 for t, c in zip(forest.texts, chars, strict=True)]
    own = np.zeros((n, 6))  # characters, words, stops, characters in links, elements, characters in paragraphs
    for i, x in enumerate((chars, words, stops)):
        own[:, i] = np.bincount(owner, weights=np.array(x, float), minlength=n) if len(owner) else 0
    own[:, 3] = own[:, 0] * np.array(forest.linked)
    own[:, 4] = 1
    own[:, 5] = own[:, 0] * np.array(forest.prose)
    group = np.array([GROUP_OF.get(t, -1) for t in forest.tag])
    groups = np.zeros((n, len(TAG_GROUPS)))
    groups[np.flatnonzero(group >= 0), group[group >= 0]] = 1
    tokens = np.zeros((n, len(TOKEN_GROUPS)))
    if forest.tokens:
        tokens[tuple(np.array(forest.tokens).T)] = 1
    total = np.concatenate([np.zeros((1, 6)), np.cumsum(own, axis=0)])
    below = total[last + 1] - total[:-1]
    whole = np.maximum(below[root], 1)
    size = np.maximum(below[:, 0], 1)
    inner = parent >= 0
    up = np.where(inner, parent, np.arange(n))
    siblings = np.bincount(up[inner], minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, up[inner], below[inner, 0])
    names = np.unique(forest.tag, return_inverse=True)[1]
    _, key, alike = np.unique(up * (names.max() + 1) + names, return_inverse=True, return_counts=True)
    mid = (total[:-1, 0] + total[last + 1, 0] - 2 * total[root, 0]) / 2 / whole[:, 0]
    above = np.maximum(below[up, 0], 1)
    groups[:, :7] = below_own(groups[:, :7], last)
    numbers = [np.log1p(below[:, 0]), below[:, 0] / whole[:, 0], below[:, 3] / size, below[:, 2] / np.maximum(below[:, 1], 1), below[:, 1] / np.maximum(below[:, 4], 1), below[:, 5] / size, own[:, 0] / size, np.log1p(below[:, 4]), depth, mid, np.log1p(siblings[up]), below[:, 0] / np.maximum(most[up], 1), alike[key] / np.maximum(siblings[up], 1), below[:, 0] / above, below[up, 3] / above, below[:, 5] / whole[:, 5]]
    return np.concatenate([np.stack(numbers, axis=1), groups, below_own(tokens, last)], axis=1)


@dataclass
class Boosted:
    """Trees of fixed depth as arrays: the feature and cut of each inner node, the value of each leaf."""

    base: float
    depth: int
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, shrink: float = 2.0, share_of_features: float = 0.5, seed: int = 7) -> Boosted:
    """Logistic gradient boosting with histogram splits; each tree sees a random share of the features."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    share = np.clip((y * weight).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(len(x), base)
    inner, leaves = 2**depth - 1, 2**depth
    features_, cuts_, values_ = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        f, c = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(x), np.int64)
        tried = rng.choice(x.shape[1], int(np.ceil(share_of_features * x.shape[1])), replace=False)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = at - first
            best = np.full(width, 1e-6)
            gs = np.bincount(local, weights=g, minlength=width)
            hs = np.bincount(local, weights=h, minlength=width)
            for j in tried:
                if not len(cuts[j]):
                    continue
                m = len(cuts[j]) + 1
                key = local * m + code[:, j]
                gl = np.bincount(key, weights=g, minlength=width * m).reshape(width, m).cumsum(axis=1)[:, :-1]
                hl = np.bincount(key, weights=h, minlength=width * m).reshape(width, m).cumsum(axis=1)[:, :-1]
                gain = gl**2 / (hl + shrink) + (gs[:, None] - gl) ** 2 / (hs[:, None] - hl + shrink) - (gs**2 / (hs + shrink))[:, None]
                k = gain.argmax(axis=1)
                better = gain[np.arange(width), k] > best
                best[better] = gain[np.arange(width), k][better]
                f[first : first + width][better] = j
                c[first : first + width][better] = cuts[j][k[better]]
            at = 2 * at + 1 + (x[np.arange(len(x)), f[at]] > c[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + shrink)
        score += value[leaf]
        features_.append(f)
        cuts_.append(c)
        values_.append(value)
    return Boosted(base, depth, np.array(features_), np.array(cuts_), np.array(values_))


class PageMaker:
    """Generated pages: text marked as main is wrapped between private-use characters, which the trainer reads back."""

    OPEN, SHUT = "\ue000", "\ue001"

    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        self.noise = ""
        letters = "etaoinshrdlucmfwypvbgkéüñ"
        self.words = ["".join(rng.choice(list(letters), rng.integers(2, 10))) for _ in range(400)]

    def pick(self, *options):
        return options[self.rng.integers(len(options))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def some(self, low: int, high: int) -> str:
        return " ".join(w + self.noise for w in self.rng.choice(self.words, self.rng.integers(low, high + 1)))

    def sentence(self) -> str:
        s = self.some(1, 22)
        return s[:1].upper() + s[1:] + self.pick(".", ".", ".", ".", "?", "!")

    def prose(self, low: int = 1, high: int = 8) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.integers(low, high + 1)))

    def main(self, s: str) -> str:
        return f"{self.OPEN}{s}{self.SHUT}"

    def link(self, s: str) -> str:
        return f'<a href="{self.pick("/", "#", "https://else.test/")}{len(s)}">{s}</a>'

    def links(self, low: int, high: int) -> str:
        found = [self.link(self.some(1, 2)) for _ in range(self.rng.integers(low, high + 1))]
        return self.pick(lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in found) + "</ul>", lambda: "<ul>" + "".join(f"<li>{x}" for x in found) + "</ul>", lambda: " | ".join(found), lambda: "".join(f"<span>{x}</span> " for x in found), lambda: "".join(f"<div>{x}</div>" for x in found))()

    def inline(self, s: str) -> str:
        """Main text with inline elements in it, now and then one that is never closed."""
        words = self.main(s).split(" ")
        if len(words) > 3 and self.chance(0.4):
            k = int(self.rng.integers(1, len(words) - 1))
            tag = self.pick("em", "strong", "i", "code", "span", "u", "small")
            words[k] = f"{self.SHUT}<{tag}>{self.main(words[k])}</{tag}>{self.OPEN}"
        if self.chance(0.06):
            return f"<{self.pick('i', 'em', 'strong', 'font')}>" + " ".join(words)
        if self.chance(0.12):
            return " ".join(words) + " " + self.link(self.main(self.some(1, 4))) + " " + self.main(self.prose(1, 2))
        return " ".join(words)

    def block(self) -> str:
        """One or a few blocks of main text."""
        text = lambda high=3: self.inline(self.prose(1, self.pick(1, high, 8)))
        items = lambda tag: "".join(f"<{tag}>{self.main(self.prose(1, 2))}" + (f"</{tag}>" if self.chance(0.8) else "") for _ in range(self.rng.integers(2, 6)))
        kinds = [
            (50, lambda: f"<p>{text()}</p>"),
            (6, lambda: f"<p>{text()}<p>{text()}"),
            (5, lambda: f"{text()}<br>{self.pick('', '<br>')}{text()}<br>"),
            (7, lambda: f"<h{self.pick(2, 3, 4)}>{self.main(self.some(2, 6))}</h{self.pick(2, 3, 4)}><p>{text()}</p>"),
            (5, lambda: f"<ul>{items('li')}</ul>"),
            (3, lambda: f"<ol>{items('li')}</ol>"),
            (2, lambda: f"<dl><dt>{self.main(self.some(1, 3))}<dd>{text()}</dl>"),
            (4, lambda: f"<blockquote>{self.pick('<p>', '')}{text()}</blockquote>"),
            (6, lambda: f"<div>{text()}</div>"),
            (3, lambda: f"<p>{self.main(self.prose(1, 2))}<div>{text()}</div>{self.main(self.prose(1, 2))}"),
            (3, lambda: f"<section><h3>{self.main(self.some(1, 4))}</h3><p>{text()}</p></section>"),
            (3, lambda: "<table>" + "".join(f"<tr><td>{self.main(self.some(1, 4))}<td>{self.main(self.some(1, 6))}" for _ in range(3)) + "</table>"),
            (2, lambda: f"<figure><img src=x><figcaption>{self.main(self.some(2, 9))}</figcaption></figure><p>{text()}</p>"),
            (2, lambda: f"<pre>{self.main(self.some(3, 12))}</pre>"),
            (2, lambda: f"<hr><p>{text()}</p>"),
        ]
        weights = np.array([w for w, _ in kinds], float)
        return kinds[self.rng.choice(len(kinds), p=weights / weights.sum())][1]()

    def advert(self) -> str:
        return f'<{(t := self.pick("div", "div", "aside", "section"))} class="{self.pick("ad", "advert", "ads", "sponsored", "promo", "ad-slot", "box ad", "adBanner")}">{self.pick("", "<b>" + self.some(1, 2) + "</b> ")}{self.prose(1, 4)}</{t}>'

    def notice(self) -> str:
        return f'<div {self.pick("class", "id")}="{self.pick("cookie-notice", "alert", "notice", "consent", "newsletter", "gdpr-popup", "subscribe")}"><p>{self.prose(1, 3)}</p>{self.pick("", "<button>ok</button>")}</div>'

    def comments(self) -> str:
        posts = "".join(f'<{(t := self.pick("div", "li", "article"))} class="{self.pick("comment", "reply", "item", "comment-body")}"><b>{self.some(1, 2)}</b><p>{self.prose(1, 4)}</p></{t}>' for _ in range(self.rng.integers(1, 5)))
        return self.pick(f'<section class="comments"><h3>{self.some(1, 2)}</h3>{posts}</section>', f'<div id="comments">{posts}</div>', f'<aside class="discussion">{posts}</aside>', f'<ol class="comment-list">{posts}</ol>')

    def sidebar(self) -> str:
        return self.pick('<aside class="sidebar">{}</aside>', '<div class="sidebar">{}</div>', "<aside>{}</aside>", '<div id="right-rail">{}</div>', '<div class="widget related">{}</div>').format(f"<h3>{self.some(1, 3)}</h3>{self.links(2, 8)}{self.pick('', '<p>' + self.prose(1, 4) + '</p>')}")

    def form(self) -> str:
        return f'<form {self.pick("", "class=signup", "id=search")}><label>{self.some(1, 3)}</label><input name=q><p>{self.prose(1, 1)}</p></form>'

    def menu(self) -> str:
        return self.pick("<nav>{}</nav>", '<div class="menu">{}</div>', "<header><nav>{}</nav></header>", "{}", '<div id="nav">{}</div>', '<div class="breadcrumbs">{}</div>', '<ul class="toolbar"><li>{}</ul>').format(self.links(3, 9))

    def footer(self) -> str:
        inner = self.pick(lambda: f"&copy; {self.some(1, 3)} &middot; {self.prose(1, 2)}", lambda: self.prose(1, 3), lambda: f"{self.links(2, 5)}<p>{self.some(3, 9)}</p>", lambda: f"<p>{self.prose(1, 1)}</p>{self.links(1, 4)}")()
        return self.pick("<footer>{}</footer>", "<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="foot">{}</div>', '<table class="footer"><tr><td>{}</table>').format(inner)

    def page(self) -> str:
        self.noise = self.pick("***", "&amp;&amp;", "!!", " |", "%%", "##", "$") if self.chance(0.25) else ""
        title = self.some(2, 9)
        parts = [self.block() for _ in range(self.rng.integers(1, 12))]
        if self.chance(0.85):
            parts.insert(0, f"<h1>{self.main(title)}</h1>")
        for make, p in ((self.advert, 0.25), (lambda: f'<div class="{self.pick("share", "social", "related", "tags")}">{self.links(2, 5)}</div>', 0.15), (self.notice, 0.1), (lambda: f"<aside>{self.prose(1, 3)}</aside>", 0.08)):
            if self.chance(p):
                parts.insert(int(self.rng.integers(1, len(parts) + 1)), make())
        if self.chance(0.1):
            parts.append(self.comments())
        box = self.pick("<article>{}</article>", "<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="main-content"><div><div>{}</div></div></div>', '<div class="post"><div class="entry">{}</div></div>', "<div>{}</div>", "<section>{}</section>", '<div role="main">{}</div>', "<table><tr><td>{}</table>", "<story-body>{}</story-body>", "{}").format("".join(parts))
        above = [make() for make, p in ((self.menu, 0.9), (lambda: f"<header><h1>{self.some(1, 4)}</h1><p>{self.some(2, 8)}</p></header>", 0.3), (self.advert, 0.45), (self.notice, 0.2), (self.form, 0.12), (self.sidebar, 0.15)) if self.chance(p)]
        below = [make() for make, p in ((self.comments, 0.3), (self.sidebar, 0.3), (self.advert, 0.2), (self.form, 0.1), (self.footer, 0.9)) if self.chance(p)]
        head = self.pick("", "<style>.x > p { color: red }</style>") + self.pick("", '<script>document.write("<div>" + x + "</div>")</script>')
        body = "".join(above) + box + "".join(below)
        if self.chance(0.25):
            body = f'<div class="{self.pick("wrap", "page", "container", "layout")}">{body}</div>'
        return f"<html><head><title>{title}</title>{head}</head><body>{body}</body></html>" if self.chance(0.9) else body


def labelled(page: str) -> tuple[Forest, np.ndarray]:
    """A generated page without its marks; for each element the main and the other characters of its subtree."""
    forest = Forest()
    parse(page, forest)
    own = np.zeros((len(forest.tag), 2))
    for i, (x, s) in enumerate(zip(forest.owner, forest.texts, strict=True)):
        forest.texts[i] = s.replace(PageMaker.OPEN, "").replace(PageMaker.SHUT, "")
        own[x, 0 if PageMaker.OPEN in s or PageMaker.SHUT in s else 1] += len(forest.texts[i].strip())
    total = np.concatenate([np.zeros((1, 2)), np.cumsum(own, axis=0)])
    return forest, total[np.array(forest.last) + 1] - total[:-1]


@lru_cache(1)
def trained(pages: int = 450, seed: int = 3) -> Boosted:
    """Trees fitted to generated pages."""
    maker = PageMaker(np.random.default_rng(seed))
    xs, ys, ws = [], [], []
    for _ in range(pages):
        forest, below = labelled(maker.page())
        text = below.sum(axis=1)
        keep = text > 0
        xs.append(features(forest)[keep])
        ys.append((below[:, 0] > below[:, 1])[keep])
        ws.append((np.abs(below[:, 0] - below[:, 1]) / np.maximum(text, 1) * np.log1p(text))[keep])
    return boost(np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(ws))


#: What it costs the reading to begin the main text, or to leave a subtree out of it.
BEGIN, LEAVE = 1.5, 2.0


def decode(forest: Forest, logit: np.ndarray) -> list[bool]:
    """Which elements' own text is main: the best reading in which states change outside > main > left out, downwards only."""
    n, parent = len(forest.tag), forest.parent
    size = np.bincount(np.array(forest.owner, np.int64), weights=np.array([len(t.strip()) for t in forest.texts], float), minlength=n) if forest.owner else np.zeros(n)
    gain = (np.clip(logit, -6, 6) * np.log1p(size)).tolist()
    # value of a subtree where its parent is outside or main, and where all of it is left out
    outside, inside, shut = ([0.0] * n for _ in range(3))
    begins, stays = [False] * n, [False] * n
    for i in range(n - 1, -1, -1):
        g, p = gain[i], parent[i]
        out, main, gone = outside[i] - g, inside[i] + g, shut[i] - g
        begins[i], stays[i] = main - BEGIN > out, main > gone - LEAVE
        if p >= 0:
            outside[p] += main - BEGIN if begins[i] else out
            inside[p] += main if stays[i] else gone - LEAVE
            shut[p] += gone
    state = [0] * n  # 0 outside, 1 main, 2 left out
    for i, p in enumerate(parent):
        above = state[p] if p >= 0 else 0
        state[i] = 2 if above == 2 else (1 if stays[i] else 2) if above == 1 else int(begins[i])
    return [x == 1 for x in state]


def main_texts(pages: list[str | None], model: Boosted) -> list[str]:
    """The main text of each page; the trees score all their elements at once."""
    forest, starts = Forest(), []
    for page in pages:
        starts.append(len(forest.tag))
        parse(page or "", forest)
    if not pages:
        return []
    chosen = decode(forest, model.score(features(forest)))
    out: list[list[tuple[int, str]]] = [[] for _ in pages]
    number = {x: i for i, x in enumerate(starts)}
    for x, text, edge in zip(forest.owner, forest.texts, forest.breaks, strict=True):
        if chosen[x]:
            out[number[forest.root[x]]].append((edge, text))
    return [joined(parts) for parts in out]


def joined(parts: list[tuple[int, str]]) -> str:
    """Texts in page order, those with a block's edge between them apart."""
    if not parts:
        return ""
    text = parts[0][1] + "".join(("\n" if a[0] != b[0] else "") + b[1] for a, b in pairwise(parts))
    return SPACE.sub(" ", text).strip()


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): text and n_chars."""
    model = pages.sparkSession.sparkContext.broadcast(trained())
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for part in sliced(batches, "html"):
            if part.num_rows:
                texts = main_texts(part.column("html").to_pylist(), model.value)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return spread(pages.select("page_id", "url", "html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
