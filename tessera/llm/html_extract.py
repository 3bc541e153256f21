"""Main text of web pages: the maximum-scoring run of words and tags.

A page is a sequence of words and tags. A word scores by where it stands (the elements
around it, their classes, ids and roles, and whether its block is mostly links), never
below 0; a tag scores below 0. One linear scan finds the contiguous run with the largest
sum. Of that run the blocks are taken whose own place speaks for main text, so an advert
or a form in the middle of an article goes and the rest stays in one piece.

The weights are fitted on labelled pages, by a ridge logistic regression of blocks on the
features of their place: pages with a known main text (``labelled``, at most ``PAGES``
of them) and pages that ``layouts`` writes by rule from common names of parts of a page.
A tag's score comes from how often it stands outside the main text. Features are at most
``FEATURES``, so the weights that each task gets are bounded.

Markup is read as browsers do where it matters: quoted ``>``, comments, raw elements,
elements that close others, end tags without a start. A page is one row and is read
once, whole; work and memory follow its length.

Defined results: null pages are empty; a page without main text gives an empty text;
plain text without tags is main text; character references without semicolon are decoded
where HTML does so; white space is what Unicode calls so; repeated rows are pages of
their own; other columns stay as they are, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, release

#: Labelled pages taken from a table, at most, and characters of a page and of its text.
PAGES, PAGE_CHARS = 200, 100_000
#: Features with a weight, at most.
FEATURES = 5000
#: Places remembered by a worker; beyond that it starts afresh.
PLACES = 50_000
#: The most that one word scores.
MOST = 4.0

# Fixed values of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style title textarea noscript iframe template svg math object select".split()
#: A start tag closes the nearest of these elements, unless one of those is nearer.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<raw>{'|'.join(RAW)})(?=[\s/>]).*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attributes>(?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:$|[\s=])|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_CAMEL, _PART = re.compile(r"(?<=[a-z])(?=[A-Z])"), re.compile(r"[a-z]+")


@dataclass
class Model:
    """Weights of the features of a place, scores of tags."""

    weights: dict[str, float]
    base: float
    tags: dict[str, float]
    other_tag: float

    def __post_init__(self) -> None:
        self.places: dict[tuple[int, str, str], int] = {}
        self.features: list[frozenset[str]] = [frozenset()]
        self.ids: dict[frozenset[str], int] = {frozenset(): 0}
        self.scores: list[float] = [self.base]

    def clear(self) -> None:
        if len(self.places) > PLACES:
            self.__post_init__()

    def inside(self, place: int, name: str, attributes: str) -> int:
        """The place inside an element that stands at ``place``."""
        key = (place, name, attributes)
        if key not in self.places:
            own = _features(name, attributes)
            if name in INLINE:
                own = {f for f in own if self.weights.get(f, 0.0) < -1 and not f.isalpha()}
            around = self.features[place]
            if name == "main":  # no name of a wrapper speaks against it
                around = frozenset(f for f in around if f.isalpha())
            found = around | own
            if found not in self.ids:
                self.ids[found] = len(self.features)
                self.features.append(found)
                self.scores.append(self.base + sum(self.weights.get(f, 0.0) for f in sorted(found)))
            self.places[key] = self.ids[found]
        return self.places[key]


def _features(name: str, attributes: str) -> set[str]:
    """Of one element: its name, and ``.part`` for each part of its class, id, role or item property."""
    out = {name}
    if attributes and name not in ("html", "body"):
        for m in _ATTRIBUTE.finditer(attributes):
            out.update("." + x for x in _PART.findall(_CAMEL.sub("-", m[2] or m[3] or m[4] or "").lower()))
        if _HIDDEN.search(attributes):
            out.add(".:hidden")
    return out


@dataclass
class Piece:
    """Text between two tags: its block, its place, whether in a link."""

    block: int
    place: int
    link: bool
    text: str
    words: int


@dataclass
class Page:
    """Tags by name and pieces, in order."""

    items: list[str | Piece] = field(default_factory=list)
    blocks: int = 0

    def pieces(self) -> Iterator[Piece]:
        return (x for x in self.items if isinstance(x, Piece))

    def linked(self) -> set[int]:
        """Blocks with more words inside links than outside."""
        more: Counter[int] = Counter()
        for p in self.pieces():
            more[p.block] += p.words if p.link else -p.words
        return {b for b, n in more.items() if n > 0}


def parse(source: str, model: Model) -> Page:
    model.clear()
    page, stack, opened, place, links = Page(), [], Counter(), 0, 0

    def text(raw: str) -> None:
        if raw:
            plain = html.unescape(raw) if "&" in raw else raw
            page.items.append(Piece(page.blocks, place, links > 0, plain, len(plain.split())))

    def close(name: str) -> None:
        nonlocal place, links
        while stack:
            top, before = stack.pop()
            opened[top] -= 1
            links -= top == "a"
            place = before
            if top == name:
                return

    end = source.rfind(">") + 1  # no tag goes beyond
    at = 0
    for m in _TOKEN.finditer(source, 0, end):
        text(source[at : m.start()])
        at = m.end()
        name = (m["name"] or m["raw"] or "").lower()
        if not name:
            continue  # a comment or declaration
        if name not in INLINE:
            page.blocks += 1
        page.items.append(name)
        if m["raw"]:
            continue
        if m["end"]:
            if opened[name]:
                close(name)
            continue
        if name not in INLINE and opened["p"]:
            close("p")
        if name in CLOSES:
            ends, walls = CLOSES[name]
            near = next((x for x, _ in reversed(stack) if x in ends or x in walls), None)
            if near in ends:
                close(near)
        if name in VOID:
            continue
        stack.append((name, place))
        opened[name] += 1
        links += name == "a"
        place = model.inside(place, name, m["attributes"] or "")
    text(source[at:])
    return page


def main_text(source: str | None, model: Model) -> str:
    """The main text of one page."""
    page = parse(source or "", model)
    linked, link = page.linked(), model.weights.get(":links", 0.0)
    best = total = 0.0
    start, span = 0, (0, 0)
    scores: list[float] = []
    for i, x in enumerate(page.items):
        if isinstance(x, Piece):
            scores.append(model.scores[x.place] + (link if x.block in linked else 0.0))
            total += min(max(scores[-1], 0.0), MOST) * x.words
        else:
            scores.append(0.0)
            total += model.tags.get(x, model.other_tag)
        if total < 0:
            total, start = 0.0, i + 1
        elif total >= best:
            best, span = total, (start, i + 1)
    out, block = [], -1
    for x, score in zip(page.items[slice(*span)], scores[slice(*span)], strict=True):
        if isinstance(x, Piece) and score > 0:
            out.append(x.text if x.block == block else " " + x.text)
            block = x.block
    return " ".join("".join(out).split())


#: Parts of a page, by elements and by names in classes and ids: fixed values.
MAIN = ["article", "main", "section.story", "div.content", "div#content", "div.entry-content", "div.post-body", "div.article-body", "div.article__text", "div.post", "div#main", "div.main-content", "div#articleBody", "div.story-body", "div.text", "div.body", "div.page-content", "div@main", "div@article", "td.content", "div.single", "div.entry"]
ASIDE = [
    "nav", "header", "footer", "aside", "form", "menu", "dialog", "div@navigation", "div@banner", "div@contentinfo", "div@complementary", "div@search", "div@alert", "div@dialog",
    "div.nav", "ul.menu", "div.navbar", "div#navigation", "div.topbar", "ul.breadcrumbs", "div.breadcrumb", "div.pagination", "div.pager", "div.toc", "div#header", "div.site-header", "div.page-header", "div.masthead", "div.footer", "div#footer", "div.site-footer", "div.copyright", "div.legal", "div.colophon",
    "div.sidebar", "div#sidebar", "div.side", "div.widget", "div.rail", "div.related", "div.related-posts", "div.recommended", "div.more-stories", "div.trending", "div.popular", "div.teaser", "div.tags",
    "div.ad", "div.ads", "div.advert", "div.advertisement", "div.adverts", "div.ad-slot", "div.banner", "div.sponsored", "div.sponsor", "div.promo", "div.promotion", "div.commercial", "div.affiliate", "div.outbrain", "div.taboola", "section.ad", "p.ad", "p.advert", "span.ad",
    "div.notice", "div.cookie-notice", "div.cookies", "div.cookie-banner", "div.consent", "div.gdpr", "div.alert", "div.warning", "div.message", "div.modal", "div.popup", "div.overlay", "div.paywall", "div.disclaimer", "div.toast", "div.announcement", "p.notice", "section.notice",
    "div.form", "div.login", "div.signup", "div.subscribe", "div.newsletter", "div.search", "div.contact-form", "div.share", "div.social", "div.sharing", "div.follow", "div.toolbar", "div.skip", "div.print",
    "div.comments", "section.comments", "section#comments", "div#comments", "ol.comment-list", "div.comment", "div.comment-body", "div.comment-content", "div.reader-comments", "div.responses", "div.replies", "div.reply", "div#disqus_thread", "div.discussion", "div.feedback", "ul.reactions", "article.comment",
    "div.footer-content", "div.sidebar-content", "div.header-content", "div.ad-content", "div.author-bio", "div.byline", "div.meta", "div[hidden]",
]
WRAPS = ["", "div", "div.wrapper", "div.container", "div#page", "div.row", "section", "div.layout", "div.site", "table"]


def _element(part: str, inner: str) -> str:
    name, kind, value = re.fullmatch(r"(\w+)([.#@\[]?)(.*?)\]?", part).groups()
    attribute = {"": "", ".": f' class="{value}"', "#": f' id="{value}"', "@": f' role="{value}"', "[": f" {value}"}[kind]
    return f"<{name}{attribute}>{inner}</{name}>"


def layouts() -> Iterator[tuple[str, str]]:
    """Labelled pages, written by rule: html and main text. Each part stands before, in and after a main text, in prose and in links."""
    word = (f"w{i}" for i in itertools.count())

    def prose(n: int) -> str:
        return " ".join(itertools.islice(word, n))

    for i, (main, aside) in enumerate(itertools.product(["", *MAIN], ["", *ASIDE])):
        if i % 3:
            continue  # each part still meets a third of the others
        kept: list[str] = []

        def own(n: int, keep: list[str] = kept) -> str:
            keep.append(prose(n))
            return keep[-1]

        def other(j: int, part: str) -> str:
            if not part:
                return ""
            links = "".join(f'<li><a href="/{x}">{prose(1)}</a></li>' for x in range(6))
            forms = (
                prose(12), f"<p>{prose(15)}</p><p>{prose(9)}</p>", f"<ul>{links}</ul>", f"<h3>{prose(3)}</h3><p>{prose(20)}</p>", f"<div><h4>{prose(2)}</h4><div>{prose(8)}</div></div>",
                f"<ol><li>{prose(9)}</li><li><p>{prose(7)}</p></li></ol>", f"<h2>{prose(3)}</h2><p>{prose(9)} <b>{prose(2)}</b></p>", f"<section><h3>{prose(2)}</h3><p>{prose(30)}</p></section>", f"<table><tr><td>{prose(3)}</td></tr></table>",
            )
            return _element(part, prose(12) if part[0] in "ps" and part[:3] != "sec" else forms[j % len(forms)])

        parts = [f"<h1>{own(5)}</h1>", f"<p>{own(40)}</p>", f'<p>{own(9)} <a href="/x">{own(2)}</a> <b>{own(3)}</b></p>']
        if i % 2:
            parts += [f"<h2>{own(3)}</h2>", f"<ul><li>{own(8)}</li><li>{own(6)}</li></ul>", f"<blockquote>{own(12)}</blockquote>"]
        if i % 4 == 0:
            parts += [f"<div>{own(20)}</div>", f"<table><tr><td>{own(4)}</td></tr></table>", f"<pre>{own(5)}</pre>", f"<figure><figcaption>{own(6)}</figcaption></figure>"]
        if i % 6 < 2:
            parts += [f"<h3>{own(4)}</h3>", f"<ol><li><p>{own(9)}</p></li></ol>", f"<section><h4>{own(2)}</h4><p>{own(11)}</p></section>", f"<dl><dt>{own(1)}</dt><dd>{own(7)}</dd></dl>"]
        if main and i % 6 > 2:
            parts += [f'<p><a href="/y">{own(4)}</a></p>', f'<ul><li><a href="/z">{own(2)}</a></li></ul>', f"<p>{own(1)}</p>"]
        middle = other(i + 1, aside) if i % 5 < 3 else ""
        inner = "".join([*parts[:2], middle, *parts[2:]])
        if main in ("article", "main") and i % 7 < 3:
            inner = _element(MAIN[3 + i % 6], inner)
        core = _element(main, inner) if main else inner
        if main != "main" and i % 11 < 2:
            core = _element("main", core)
        wrap = WRAPS[i % len(WRAPS)]
        page = other(i, aside) + core + other(i + 2, ASIDE[i % len(ASIDE)]) + other(i + 3, "footer")
        yield f"<html><head><title>{prose(3)}</title></head><body>{_element(wrap, page) if wrap else page}</body></html>", " ".join(kept)


def _labels(page: Page, text: str) -> list[bool] | None:
    """For each block with words, whether it is of ``text``; None if these pages and texts don't belong together."""
    whole, at, found, covered = " ".join(text.split()), 0, [], 0
    blocks = _blocks(page)
    for words in blocks.values():
        b = " ".join(words)
        # a heading may repeat how the text begins
        where = next((x for x in (at, 0) if whole.startswith(b, x) and (x or len(words) > 2 or at == 0 and b == whole)), None) if b else None
        found.append(where is not None)
        if where is not None:
            covered, at = max(covered, where + len(b)), where + len(b) + 1
    return found if whole and covered >= 0.8 * len(whole) else None


def _blocks(page: Page) -> dict[int, list[str]]:
    joined: dict[int, list[str]] = {}
    for p in page.pieces():
        joined.setdefault(p.block, []).append(p.text)
    return {b: words for b, t in joined.items() if (words := "".join(t).split())}


def fit(labelled: Iterable[tuple[str, str]], ridge: float = 0.03, rounds: int = 25) -> Model:
    """A model from pages with their main texts."""
    bare = Model({}, 0.0, {}, 0.0)
    examples: Counter[tuple[frozenset[str], bool]] = Counter()
    within, seen = Counter(), Counter()
    for source, text in labelled:
        page = parse(source, bare)
        labels = _labels(page, text)
        if labels is None:
            continue
        linked, good = page.linked(), {b for b, x in zip(_blocks(page), labels, strict=True) if x}
        place: dict[int, int] = {}
        for p in page.pieces():
            if p.words:
                place.setdefault(p.block, p.place)
        for b, x in place.items():
            examples[bare.features[x] | ({":links"} if b in linked else frozenset()), b in good] += 1
        low, high = min(good, default=1), max(good, default=0)
        block = 0
        for x in page.items:
            if isinstance(x, Piece):
                block = x.block
            else:
                seen[x] += 1
                within[x] += low <= block <= high
        bare.clear()
    names = Counter(f for (features, _), n in examples.items() for f in features)
    order = [f for f, _ in sorted(names.items(), key=lambda x: (-x[1], x[0]))[:FEATURES]]
    column = {f: i + 1 for i, f in enumerate(order)}
    rows = sorted(examples.items(), key=lambda x: (sorted(x[0][0]), x[0][1]))
    x = np.zeros((len(rows), len(order) + 1))
    x[:, 0] = 1
    for i, ((features, _), _) in enumerate(rows):
        x[i, [column[f] for f in features if f in column]] = 1
    y = np.array([label for (_, label), _ in rows], float)
    n = np.log1p([count for _, count in rows])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 0.01
    for _ in range(rounds):  # Newton's method
        p = 1 / (1 + np.exp(-x @ w))
        h = x.T @ (x * (n * np.maximum(p * (1 - p), 1e-4))[:, None]) + np.diag(penalty)
        w += np.linalg.solve(h, x.T @ (n * (y - p)) - penalty * w)
    outside = {t: (seen[t] - within[t] + 1) / (seen[t] + 2) for t in seen}
    return Model(dict(zip(order, map(float, w[1:]), strict=True)), float(w[0]), {t: -0.04 - 0.4 * s for t, s in outside.items()}, -0.3)


def labelled(pages: DataFrame, key: str, texts: DataFrame, text_key: str) -> list[tuple[str, str]]:
    """At most ``PAGES`` pages (those with the smallest hashes of ``key``) with the texts they were made of, none longer than ``PAGE_CHARS``."""
    short = pages.filter(F.col(key).isNotNull() & (F.length("html") <= PAGE_CHARS)).select(F.col(key).alias("k"), "html")
    some = short.orderBy(F.xxhash64("k"), "k", "html").limit(PAGES).collect()
    ids = sorted({r.k for r in some})
    known = texts.filter(F.col(text_key).isin(ids) & (F.length("text") <= PAGE_CHARS)).groupBy(F.col(text_key).alias("k")).agg(F.min("text").alias("text")).collect() if ids else []
    of = {r.k: r.text for r in known}
    return [(r.html, of[r.k]) for r in some if r.k in of]


def extract(pages: DataFrame, model: Model, out: str = "__main_text") -> DataFrame:
    """``pages`` with the main text of ``html`` in a column more, instead of ``html``."""
    rest = [c for c in pages.columns if c != "html"]
    plain = pages.toDF(*[f"column_{i}" if c != "html" else c for i, c in enumerate(pages.columns)])
    plain = plain.select(*[c for c in plain.columns if c != "html"], "html")
    schema = T.StructType(plain.schema.fields[:-1] + [T.StructField("html", T.StringType())])
    given = (model.weights, model.base, model.tags, model.other_tag)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*given)
        for b in batches:
            texts = pa.array([main_text(x.as_py(), own) for x in b.column(b.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], names=b.schema.names)
        release()

    return plain.mapInArrow(run, schema).toDF(*rest, fresh(pages, out))
