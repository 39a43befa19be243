"""Main text of web pages: boosted trees over nodes of the page, and a decoding that keeps subtrees consistent.

Each block element and each run of text gets log-odds of belonging to the article.  The decoding picks the nodes of the
greatest total under one rule: a node is kept only if the node above it is.  So a run inside a dropped menu is never
kept, and a wrapper is kept only for what it holds.

The trees are fitted here, on pages that ``training_pages`` writes with known articles: their number is a parameter,
and neither fitting nor decoding looks at the pages to be extracted beyond the one at hand.  What words in class and id
say is learnt from these pages too, as odds that trees weigh against the rest; names there are telling for the most part,
and made up or misleading else, so that a word the pages never had, or one that misleads, does not decide alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tidy
from tessera.llm.boost import Forest, fit_forest
from tessera.llm.htmltree import Page, features, parse, word_odds

#: Parts of articles are dropped at odds of less than two in three.
LEAN = 0.4
#: Words that names of any part of a page are made with, so that one word alone decides little.
OTHER_WORDS = (
    "body main text content entry post item list block box message tags teaser meta info header footer side menu top page story head inner comment wrapper "
    "section title note summary links social"
).split()
#: Words of the parts that are left out; articles are now and then named after them as well.
MISLEADING_WORDS = "notice alert ad advert promo share sidebar comment comments form footer related newsletter cookie popup modal teaser widget nav menu header social response".split()
_MARK = "\u0001"  # stands before each word of an article in training pages


class PageWriter:
    """Random pages: an article among menus, headers, sidebars, notices, adverts, forms, comments and footers."""

    def __init__(self, seed: int):
        self.random = np.random.default_rng(seed)

    def chance(self, p: float) -> bool:
        return bool(self.random.random() < p)

    def pick(self, *options):
        return options[int(self.random.integers(len(options)))]

    def words(self, low: int, high: int, mark: bool = False) -> str:
        n = int(self.random.integers(low, high + 1))
        letters = self.random.integers(97, 123, size=(n, 7))
        made = ["".join(map(chr, row[: 2 + row[0] % 6])) + ("." if row[6] < 99 else "," if row[6] < 101 else "") for row in letters.tolist()]
        made[0] = made[0].capitalize()
        return " ".join(_MARK * mark + w for w in made)

    def name(self, names: tuple[str, ...], misleading: float = 0.07) -> str:
        """One of the names for the most part; else a name that says nothing, or one that misleads."""
        said, r = self.pick(*names), self.random.random()
        if r < 0.88 - misleading:
            return said
        if r < 0.94 - misleading:
            return self.made_up()
        if r < 1 - misleading:
            return f"{self.made_up()}-{said}" if self.chance(0.5) else f"{said} {self.made_up()}"
        return f"{said.split('-')[0]}-{self.pick(*OTHER_WORDS)}" if self.chance(0.5) else f"{self.pick(*OTHER_WORDS)}-{said.split('-')[-1]}"

    def made_up(self) -> str:
        """Letters; any such word is rare, so nothing is learnt of it."""
        return "".join(map(chr, self.random.integers(97, 123, size=int(self.random.integers(2, 9))).tolist()))

    def element(self, tag: str, inner: str, names: tuple[str, ...] = (), named: float = 0.8, misleading: float = 0.07) -> str:
        attr = f' {self.pick("class", "id")}="{self.name(names, misleading)}"' if names and self.chance(named) else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def links(self, low: int, high: int) -> str:
        n = int(self.random.integers(low, high + 1))
        icon = lambda i: "<svg class=icon />" * (i % 4 == 3)
        items = [f'<a href="/{i}">{icon(i)}{self.words(1, 3)}</a>' for i in range(n)]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if self.chance(0.7) else " ".join(items)

    def boxed(self, semantic: str, names: tuple[str, ...], inner: str) -> str:
        """The semantic element with or without a telling name, or a plain box that has one."""
        if self.chance(0.5):
            return self.element(semantic, inner, names, 0.4)
        return self.element(self.pick("div", "section"), inner, names, 1.0)

    def menu(self) -> str:
        return self.boxed("nav", ("nav", "navbar", "main-menu", "menu", "breadcrumbs", "navigation"), self.links(1, 9))

    def header(self) -> str:
        inner = self.element(self.pick("div", "p", "h1", "a"), self.words(1, 6), ("logo", "brand", "site-title"), 0.3) + (self.menu() if self.chance(0.5) else "") + (self.search() if self.chance(0.2) else "")
        return self.boxed("header", ("header", "site-header", "masthead", "top-banner"), inner)

    def search(self) -> str:
        return self.element("form", f'<label>{self.words(1, 4)}</label><input name="q"><button>{self.words(1, 2)}</button>', ("search-form", "search", "login", "contact-form"), 0.5)

    def form(self) -> str:
        return self.element("form", self.element("p", self.words(3, 25)) + f"<label>{self.words(1, 3)}</label><input><button>{self.words(1, 2)}</button>", ("newsletter", "subscribe", "signup", "poll"), 0.5)

    def advert(self) -> str:
        body = self.words(2, 45)
        return self.element(self.pick("div", "div", "aside", "section"), self.element("p", body) if self.chance(0.4) else body, ("ad", "ads", "advert", "sponsored", "promo", "ad-banner", "advertisement"), 1.0)

    def notice(self) -> str:
        if self.chance(0.15):
            return self.element("noscript", self.words(4, 25))
        body = self.words(4, 50) + (f' <button>{self.words(1, 2)}</button>' if self.chance(0.5) else "")
        return self.element(self.pick("div", "section", "p"), self.element("p", body) if self.chance(0.5) else body, ("cookie-notice", "cookie-banner", "consent", "notice", "alert", "popup", "modal", "paywall-message", "gdpr"), 1.0)

    def sidebar(self) -> str:
        parts = [self.element("h3", self.words(1, 4)) + self.pick(self.links(1, 8), self.element("p", self.words(5, 40)), self.advert()) for _ in range(int(self.random.integers(1, 4)))]
        return self.boxed("aside", ("sidebar", "side-rail", "widget-area", "secondary"), "".join(parts))

    def related(self) -> str:
        cards = "".join(self.element(self.pick("div", "li", "article"), f'<a href="#">{self.words(3, 9)}</a>' + (self.element("p", self.words(5, 20)) if self.chance(0.3) else ""), ("teaser", "related-item")) for _ in range(int(self.random.integers(2, 6))))
        return self.element(self.pick("div", "section", "aside"), self.element("h3", self.words(1, 3)) + cards, ("related", "recommended", "related-posts", "trending"), 1.0)

    def comments(self) -> str:
        each = [self.element(self.pick("li", "div", "article"), (self.element("b", self.words(1, 2)) if self.chance(0.5) else "") + self.element("p", self.words(3, 70)), ("comment", "reply", "comment-body")) for _ in range(int(self.random.integers(1, 7)))]
        inner = (self.element("h2", self.words(1, 3)) if self.chance(0.7) else "") + self.element(self.pick("ul", "ol", "div"), "".join(each), ("comment-list", "commentlist")) + (self.form() if self.chance(0.4) else "")
        return self.element(self.pick("div", "section", "aside"), inner, ("comments", "comment-section", "discussion", "reader-comments", "responses"), 1.0)

    def share(self) -> str:
        return self.element("div", self.links(2, 5), ("share", "social-links", "share-bar"), 1.0)

    def footer(self) -> str:
        said = self.pick("&copy; ", "") + self.words(3, 40)
        return self.boxed("footer", ("footer", "site-footer", "copyright", "legal"), self.pick("", self.links(2, 7)) + self.pick(said, said, f"<p>{said}</p>", f"<div>{said}</div>"))

    def article(self) -> str:
        def block() -> str:
            text = self.words(*self.pick((1, 3), (2, 12), (8, 25), (15, 60), (40, 110), (60, 170)), mark=True)
            if self.chance(0.15):
                text = f'{text} <a href="#">{self.words(1, 4, True)}</a> {self.words(2, 20, True)}'
            if self.chance(0.15):
                text = f"<b>{text}" + self.pick("</b>", "<br>", "")
            return self.pick(
                *[f"<p>{text}</p>"] * 8, f"<p>{text}", f"<h2>{self.words(1, 8, True)}</h2>", f"<div>{text}</div>", f"<blockquote><p>{text}</p></blockquote>", f"<pre>{text}</pre>",
                "<ul>" + "".join(f"<li>{self.words(2, 20, True)}</li>" for _ in range(3)) + "</ul>",
                "<table>" + "".join(f"<tr><td>{self.words(1, 4, True)}</td><td>{self.words(1, 4, True)}</td></tr>" for _ in range(3)) + "</table>",
                f"<figure><img src=x><figcaption>{self.words(2, 12, True)}</figcaption></figure>", f"<noscript>{text}</noscript>",
            )

        parts = [f"<h1>{self.words(2, 12, True)}</h1>"] if self.chance(0.8) else []
        for _ in range(int(self.pick(0, 1, 1, 2, 4, 7, 12))):
            parts.append(block())
            if self.chance(0.06):
                parts.append(self.pick(self.advert, self.share, self.notice, self.form, self.related)())
        if not parts:
            parts.append(f"<p>{self.words(1, 40, True)}</p>")
        after = "".join(f() for f in (self.share, self.related, self.comments) if self.chance(0.12))
        inner = "".join(parts) + after
        if self.chance(0.14):
            return inner  # in no box of its own
        names = ("article", "content", "post", "entry-content", "story-body", "main-content", "article-body")
        plain = self.element(self.pick("div", "div", "section"), inner, names if self.chance(0.7) else (self.made_up(),), 0.9, 0.25)
        if len(parts) > 2 and self.chance(0.5):  # named after another part of pages, with what tells an article left
            other, second = self.pick(*MISLEADING_WORDS), self.pick(self.made_up(), *OTHER_WORDS, *MISLEADING_WORDS)
            plain = self.element(self.pick("div", "div", "section"), inner, (f"{other}-{second}", f"{second}-{other}"), 1.0, 0.0)
        return self.pick(*[self.element("article", inner, names, 0.3)] * 4, self.element("main", inner, names, 0.3), *[plain] * 4, self.element("main", self.element("article", inner), names, 0.3))

    def page(self) -> str:
        full = self.pick(1, 1, 1, 0.15)
        before = [f() for f, p in ((self.notice, 0.2), (self.header, 0.4), (self.menu, 0.7), (self.search, 0.15), (self.advert, 0.5), (self.sidebar, 0.15)) if self.chance(full * p)]
        after = [f() for f, p in ((self.advert, 0.25), (self.share, 0.2), (self.related, 0.25), (self.comments, 0.35), (self.sidebar, 0.35), (self.form, 0.2), (self.notice, 0.2)) if self.chance(full * p)]
        after.insert(len(after) - (len(after) > 0 and self.chance(0.2)), self.footer() if self.chance(0.75) else "")
        body = "".join(before) + (self.article() if self.chance(0.97) else "") + "".join(after)
        if self.chance(0.05):  # a page of one part, and no article
            body = self.pick(self.menu, self.menu, self.header, self.footer, self.sidebar, self.form, self.comments)()
        if self.chance(0.35):
            body = self.element("div", body, ("page", "wrapper", "container", "site", "layout"))
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title></head><body>{body}" + ("</body></html>" if self.chance(0.9) else "")


def training_pages(n: int, seed: int) -> tuple[list[Page], list[np.ndarray]]:
    """Parsed pages and, for each node, whether it holds text of the article."""
    writer, pages, labels = PageWriter(seed), [], []
    for _ in range(n):
        page = parse(writer.page())
        own = np.array([bool(t) and t.startswith(_MARK) for t in page.text])
        page.text = [t.replace(_MARK, "") if t else t for t in page.text]
        sums = np.concatenate(([0], np.cumsum(own)))
        pages.append(page)
        labels.append(sums[np.array(page.end)] - sums[:-1] > 0)
    return pages, labels


@dataclass(frozen=True)
class Extractor:
    """Trees, and what was learnt of attribute words."""

    forest: Forest
    odds: dict[str, float]


@lru_cache(maxsize=4)
def train_extractor(*, pages: int = 1800, trees: int = 60, depth: int = 6, seed: int = 11) -> Extractor:
    """Fitted once for each process and set of parameters."""
    made, labels = training_pages(pages, seed)
    odds = word_odds(made, labels)
    return Extractor(fit_forest(features(made, odds), np.concatenate(labels).astype(float), trees=trees, depth=depth), odds)


def decode(page: Page, margins: list[float], lean: float = 0.0) -> list[bool]:
    """Which nodes are kept: the set of the greatest sum of margins in which nothing is kept below what is dropped.

    ``lean`` is added to each margin: how much worse it is to drop a part of the article than to keep a part of the rest.
    """
    gain = [m + lean for m in margins]
    for i in range(len(gain) - 1, 0, -1):
        if gain[i] > 0:
            gain[page.parent[i]] += gain[i]
    kept = [True] * len(gain)
    for i in range(1, len(gain)):
        kept[i] = gain[i] > 0 and kept[page.parent[i]]
    return kept


def main_texts(sources: list[str | None], model: Extractor) -> list[str]:
    """The kept runs of each page, joined by one space in page order."""
    pages = [parse(s) for s in sources]
    if not pages:
        return []
    margins, out, at = model.forest.margins(features(pages, model.odds)).tolist(), [], 0
    for page in pages:
        kept = decode(page, margins[at : at + len(page.parent)], LEAN)
        at += len(page.parent)
        out.append(" ".join(t for t, k in zip(page.text, kept) if k and t))
    return out


def extract_main_text(pages: DataFrame, model: Extractor | None = None, *, together: int = 256, chars: int = 2_000_000) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``page_id, url, html``; other columns are ignored.

    Null or empty html, and html without an article, give an empty text.  Rows that share a page_id are each extracted.
    Whole pages are parsed, whatever their length.  An empty table gives an empty result.
    """
    broadcast = pages.sparkSession.sparkContext.broadcast(model or train_extractor())  # of a fixed size: trees, depth and words of training pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        for batch in batches:
            sources = batch.column(2).to_pylist()
            a = 0
            while a < len(sources):
                b, held = a, 0
                while b < len(sources) and b - a < together and (b == a or held < chars):
                    held += len(sources[b] or "")
                    b += 1
                texts = main_texts(sources[a:b], model)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
                a = b

    wanted = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return wanted.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
