"""Web pages as trees of block elements and text runs, with features for each node.

Inline elements are transparent: a run is the text between two block boundaries, references decoded and white space
turned into single spaces.  Scripts, styles and other elements without prose leave no node; without an end tag, those whose content
HTML takes as text reach to the end of the page, and of the others only the start tag goes.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np

#: Element names by kind, of the HTML standard.
KINDS: dict[str, str] = {
    "title": "h1",
    "heading": "h2 h3 h4 h5 h6 hgroup",
    "paragraph": "p",
    "item": "li dt dd",
    "list": "ul ol dl menu",
    "table": "table thead tbody tfoot tr td th caption",
    "box": "div section body html center noscript details summary dialog fieldset address",
    "article": "article",
    "main": "main",
    "nav": "nav",
    "aside": "aside",
    "footer": "footer",
    "header": "header",
    "form": "form label legend",
    "figure": "figure figcaption",
    "quote": "blockquote pre",
    "control": "button option",
}
#: What the contract leaves out wherever it stands: scripts, styles, parts of forms, and what is no page content.
_WITHOUT_PROSE = "script|style|template|iframe|textarea|select|title"
#: Those whose content HTML takes as text up to the end tag, or to the end of the page without one.
_TEXT_ONLY = frozenset("script style textarea title iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_KIND_OF = {tag: i for i, (kind, tags) in enumerate(KINDS.items()) for tag in tags.split()}
_RUN = len(KINDS)
MASK_BITS = _RUN + 1
#: For each element, which open elements a start tag ends, and which bound the search for them.
_ENDS = {
    **dict.fromkeys(("li",), (("li",), ("ul", "ol", "menu"))),
    **dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl",))),
    **dict.fromkeys(("td", "th"), (("td", "th"), ("tr", "table"))),
    **dict.fromkeys(("tr",), (("tr",), ("table",))),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (("thead", "tbody", "tfoot"), ("table",))),
    **dict.fromkeys(("option",), (("option",), ("select",))),
}
_MARKUP = re.compile(
    r"<!--.*?(?:-->|$)"
    rf"|<(?P<raw>{_WITHOUT_PROSE})(?=[\s/>])(?:(?P<raw_attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^>]*+(?:>|$))"
    r"|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|$)"
    r"|<(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|$)"
    r"|<[!?/][^>]*+(?:>|$)",
    re.DOTALL | re.IGNORECASE,
)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.IGNORECASE) for name in _WITHOUT_PROSE.split("|")}
_NAMES = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_known_attributes: dict[str, tuple[str, ...]] = {}


def attribute_words(attrs: str) -> tuple[str, ...]:
    """Words of class, id, role and itemprop, in small letters."""
    found = _known_attributes.get(attrs)
    if found is None:
        found = tuple(dict.fromkeys(w.lower() for value in _NAMES.findall(attrs) for w in _WORDS.findall(value))) if attrs else ()
        if len(_known_attributes) > 20_000:
            _known_attributes.clear()
        if len(attrs) < 500:
            _known_attributes[attrs] = found
    return found


@dataclass
class Page:
    """Nodes in document order; a node's subtree is ``[i, end[i])``."""

    parent: list[int] = field(default_factory=list)
    mask: list[int] = field(default_factory=list)
    above: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    place: list[int] = field(default_factory=list)
    kids: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    words: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)

    def add(self, parent: int, mask: int, text: str | None = None, linked: int = 0, words: tuple[str, ...] = ()) -> int:
        i = len(self.parent)
        top = parent < 0
        self.parent.append(parent)
        self.mask.append(mask)
        self.above.append(0 if top else self.above[parent] | self.mask[parent])
        self.depth.append(0 if top else self.depth[parent] + 1)
        self.end.append(i + 1)
        self.place.append(0 if top else self.kids[parent])
        if not top:
            self.kids[parent] += 1
        self.kids.append(0)
        self.linked.append(linked)
        self.words.append(words)
        self.text.append(text)
        return i


def parse(source: str | None) -> Page:
    page = Page()
    root = page.add(-1, 1 << _KIND_OF["div"])
    stack: list[tuple[str, int]] = [("", root)]  # open elements; -1 for inline ones
    block, buffer, linked, links = root, [], 0, 0

    def close_run() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                page.add(block, 1 << _RUN, text, min(linked, len(text)))
            buffer.clear()
        linked = 0

    def pop_to(at: int) -> None:
        nonlocal block, links
        close_run()
        for tag, node in stack[at:]:
            if tag == "a":
                links -= 1
            if node >= 0:
                page.end[node] = len(page.parent)
        del stack[at:]
        block = next(node for _, node in reversed(stack) if node >= 0)

    source, last = source or "", 0
    unended: set[str] = set()  # elements without prose that have no end tag from here on
    while m := _MARKUP.search(source, last):
        if m.start() > last:
            piece = source[last : m.start()]
            buffer.append(piece)
            if links:
                linked += len(piece)
        last = m.end()
        name = m["raw"]
        if name:
            name = name.lower()
            ended = None if name in unended else _RAW_END[name].search(source, last)
            if ended:
                last = ended.end()
            else:
                unended.add(name)
                if name in _TEXT_ONLY:
                    last = len(source)
            continue
        name = m["end"]
        if name:
            name = name.lower()
            inline = name not in _KIND_OF and "-" not in name
            for at in range(len(stack) - 1, 0, -1):
                tag, node = stack[at]
                if tag == name:
                    if inline:
                        links -= name == "a"
                        del stack[at]
                    else:
                        pop_to(at)
                    break
                if inline and node >= 0:
                    break
            continue
        name = m["tag"] or m["tag2"]
        if not name:
            continue
        name, attrs = name.lower(), m["attrs"] or m["attrs2"] or ""
        if name in _VOID:
            if name in ("br", "hr"):
                buffer.append(" ")
            continue
        kind = _KIND_OF.get(name)
        if kind is None and "-" not in name:
            if not attrs.endswith("/"):
                links += name == "a"
                stack.append((name, -1))
            continue
        close_run()
        ended, bounds = _ENDS.get(name, (("p",), ()))
        for at in range(len(stack) - 1, 0, -1):
            tag, node = stack[at]
            if tag in ended:
                pop_to(at)
                break
            if node >= 0 and (tag in bounds or not bounds):
                break
        block = page.add(block, 1 << (kind if kind is not None else _KIND_OF["div"]), words=attribute_words(attrs))
        stack.append((name, block))
    if last < len(source):
        buffer.append(source[last:])
    pop_to(1)
    close_run()
    page.end[root] = len(page.parent)
    return page


def word_odds(pages: list[Page], labels: list[np.ndarray], *, least: int = 8, prior: float = 4.0) -> dict[str, float]:
    """For each attribute word of ``least`` nodes or more, its log-odds of standing on a node that holds article text,
    against those of all nodes with such words; ``prior`` nodes of average odds draw rare words toward zero."""
    counts: dict[str, list[int]] = {}
    total = [0, 0]
    for page, own in zip(pages, labels):
        for words, yes in zip(page.words, own.tolist()):
            for w in words:
                counts.setdefault(w, [0, 0])[yes] += 1
                total[yes] += 1
    share = total[1] / max(1, sum(total))
    base = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
    return {w: float(np.log((y + prior * share) / (n + prior * (1 - share))) - base) for w, (n, y) in counts.items() if n + y >= least}


def _named(page: Page, odds: dict[str, float]) -> list[tuple[float, float, float, float]]:
    """For each node the least and greatest odds of its own words, and of those of all nodes above; 0 for unknown words."""
    made: list[tuple[float, float, float, float]] = []
    for words, parent in zip(page.words, page.parent):
        known = [odds.get(w, 0.0) for w in words]
        low, high = (min(known), max(known)) if known else (0.0, 0.0)
        if parent < 0:
            made.append((low, high, 0.0, 0.0))
        else:
            above = made[parent]
            made.append((low, high, min(above[0], above[2]), max(above[1], above[3])))
    return made


def features(pages: list[Page], odds: dict[str, float]) -> np.ndarray:
    """One row for each node of all pages, in order."""
    sizes = np.array([len(p.parent) for p in pages])
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    base = np.repeat(first, sizes)
    cat = lambda name: np.concatenate([np.array(getattr(p, name), np.int64) for p in pages])
    mask, above, depth, place, kids, linked = (cat(n) for n in ("mask", "above", "depth", "place", "kids", "linked"))
    parent, end = cat("parent"), cat("end") + base
    parent = np.where(parent < 0, np.arange(len(parent)), parent + base)
    texts = [t or "" for p in pages for t in p.text]
    chars = np.array([len(t) for t in texts], np.int64)
    words = np.array([t.count(" ") + 1 if t else 0 for t in texts], np.int64)
    marks = np.array([t.count(".") + t.count(",") if t else 0 for t in texts], np.int64)
    at = np.arange(len(mask))

    def below(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(values)))
        return sums[end] - sums[at]

    all_chars, all_words, all_marks, all_links = (below(x) for x in (chars, words, marks, linked))
    is_run, nodes = (mask >> _RUN) & 1, end - at
    runs, paragraphs, titles, headings = (below(x) for x in (is_run, *((mask >> _KIND_OF[t]) & 1 for t in ("p", "h1", "h2"))))
    whole = np.maximum(all_chars[base], 1)
    sums = np.concatenate(([0], np.cumsum(chars)))
    started = sums[at] - sums[base]
    ratio = lambda a, b: a / np.maximum(b, 1)
    bits = np.arange(MASK_BITS)
    seen = [below((mask >> _KIND_OF[t]) & 1) > 0 for t in ("article", "main", "nav", "form")]
    named = np.array([x for p in pages for x in _named(p, odds)], np.float32)
    parts = [
        named,
        named[parent, :2],
        (mask[:, None] >> bits) & 1,
        (above[:, None] >> bits) & 1,
        (mask[parent][:, None] >> bits) & 1,
        np.stack(seen, axis=1),
        np.stack([s[base] for s in seen[:2]], axis=1),
        np.stack([
            np.log1p(all_chars), np.log1p(all_words), ratio(all_links, all_chars), ratio(all_marks, all_words), ratio(all_chars, nodes), ratio(all_chars, runs),
            depth, place, kids[parent], ratio(place, kids[parent]), np.log1p(nodes), paragraphs, titles, headings, all_chars / whole, started / whole, np.log1p(all_chars[parent]),
            ratio(all_links[parent], all_chars[parent]), ratio(all_chars, all_chars[parent]), ratio(paragraphs, nodes),
            *(x for at in (parent, parent[parent]) for x in (all_chars[at] / whole, paragraphs[at], titles[at], headings[at], ratio(all_marks[at], all_words[at]))), ratio(all_links[parent[parent]], all_chars[parent[parent]]),
        ], axis=1),
    ]
    return np.concatenate([p.astype(np.float32) for p in parts], axis=1)
