import html as references
import re

import pytest

from tessera.llm import queries
from tessera.llm.extract import LEAN, decode, extract_main_text, main_texts, train_extractor, training_pages
from tessera.llm.htmltree import features, parse


@pytest.fixture(scope="module")
def forest():
    return train_extractor()


def runs(source):
    return [t for t in parse(source).text if t]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>a<p>b<b>c</b>d<br>e", ["a", "bcd e"]),
        ("<p><b>a<br><p>b</p>c", ["a", "b", "c"]),
        ("<script>var t='</p>';</script><style>p{}</style>x", ["x"]),
        ("<title>t</title><p title='a>b'>x &amp; y&nbsp;z &copy</p>", ["x & y z ©"]),
        ("a < b <!-- <p>c</p> --> d", ["a < b d"]),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>d", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<p a=\"x>unclosed</p><p>y", ["unclosed", "y"]),
        ("</div></p>a</b>", ["a"]),
        ("<script>never closed", []),
        ("<header>h</header><head>x</head>", ["h", "x"]),
        ("", []),
        (None, []),
    ],
)
def test_parsing(source, want):
    assert runs(source) == want


def test_trees_are_consistent():
    for page in training_pages(30, 5)[0]:
        for i, p in enumerate(page.parent):
            assert (p == -1) if i == 0 else (p < i < page.end[p] and page.end[i] <= page.end[p])


def test_nothing_is_kept_below_what_is_dropped():
    page = parse("<div><p>a</p><p>b</p></div><nav><p>c</p></nav>")
    by = {t: i for i, t in enumerate(page.text) if t}
    margins = [1.0] * len(page.parent)
    nav = page.parent[page.parent[by["c"]]]
    margins[nav] = -9.0
    margins[by["b"]] = -0.5
    kept = decode(page, margins)
    assert kept[by["a"]] and not kept[by["b"]] and not kept[nav] and not kept[by["c"]]


ARTICLE = "<h1>Title here</h1><p>First words, of some length, that tell what there is to be told about it.</p><p>Second words &amp; more of them, which go on for a while and then they end.</p>"
TEXT = "Title here First words, of some length, that tell what there is to be told about it. Second words & more of them, which go on for a while and then they end."


@pytest.mark.parametrize(
    "source",
    [
        f"<body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>About</a></li></ul></nav><article>{ARTICLE}</article><footer>&copy; someone</footer>",
        f"<header><div class=logo>Name</div></header><main>{ARTICLE}</main><section class='comments'><h2>Comments</h2><ul><li class=comment><p>I like this, it is very good indeed.</p></li></ul></section>",
        f"<div class='cookie-notice'><p>We use cookies on this site.</p><button>Yes</button></div><div class='content'>{ARTICLE}</div><aside class=sidebar><h3>More</h3><ul><li><a href=/>one</a></li></ul></aside>",
        f"<div class=ad>Buy this now, it is cheap.</div><article>{ARTICLE}<div class='advert'>Buy that too.</div></article><form><label>Mail</label><input><button>Send</button></form>",
    ],
)
def test_articles(forest, source):
    assert main_texts([source], forest) == [TEXT]


LINES = [f"Paragraph {w} has some words, of no great length, that say what there is to say." for w in "one two three four five six".split()]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<article><p>Yes it is so, they said.</p><p>More to come.</p></article><footer><div>Copyright 2020 Some Company. All rights reserved.</div></footer>", "Yes it is so, they said. More to come."),
        ("<article><p>Yes it is so, they said.</p></article><footer>Copyright 2020 Some Company</footer>", "Yes it is so, they said."),
        ("<body><h1>Title</h1>" + "".join(f"<p>{line}</p>" for line in LINES) + "</body>", " ".join(["Title", *LINES])),
        ("<article><h1>Title</h1><p>Some words to read here, now.</p><noscript>Kept as well.</noscript></article>", "Title Some words to read here, now. Kept as well."),
    ],
)
def test_short_articles_bare_bodies_and_noscript(forest, source, want):
    assert main_texts([source], forest) == [want]


@pytest.mark.parametrize("name", "notice-board comment-text sidebar-main promo-article news-alert share-text footer-story form-page entry-teaser".split())
def test_names_of_other_parts_do_not_drop_an_article(forest, name):
    inner = "<h1>Title here</h1>" + "".join(f"<p>{line}</p>" for line in LINES[:3])
    page = f'<nav><ul><li><a href=/>Home</a></li><li><a href=/b>About</a></li></ul></nav><div class="{name}">{inner}</div><footer>&copy; someone</footer>'
    assert main_texts([page], forest) == [" ".join(["Title here", *LINES[:3]])]


def test_written_pages_of_another_seed(forest):
    pages, labels = training_pages(300, 2024)
    margins, exact, at = forest.forest.margins(features(pages, forest.odds)).tolist(), 0, 0
    for page, own in zip(pages, labels):
        kept = decode(page, margins[at : at + len(page.parent)], LEAN)
        at += len(page.parent)
        exact += all(bool(k) == bool(o) for t, k, o in zip(page.text, kept, own) if t)
    print("exact of 300:", exact)
    assert exact >= 0.9 * len(pages)


def test_edges(spark, forest):
    rows = [(1, "u", None), (2, None, ""), (None, "v", f"<article>{ARTICLE}</article>"), (3, "w", "<nav><a href=/>x</a></nav>"), (4, "x", "<article>" + "<p>long words go here and here.</p>" * 20_000 + "</article>"), (4, "x", "<div>" * 3000 + "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")
    got = {(r.page_id, r.url): r for r in extract_main_text(df, forest).collect() if r.page_id != 4}
    assert (got[1, "u"].text, got[2, None].text, got[3, "w"].text, got[None, "v"].text) == ("", "", "", TEXT)
    long = [r for r in extract_main_text(df.where("page_id = 4"), forest).collect()]
    assert len(long) == 2 and max(r.n_chars for r in long) == 20_000 * len("long words go here and here. ") - 1
    assert extract_main_text(df.limit(0), forest).collect() == []


def test_query(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op9_main_text(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search("<article>(.*?)</article>", pages[r.page_id], re.DOTALL).group(1)
        inner = re.sub(r"</?b>", "", re.sub(r"<(?:/?(?:p|h1)|br)\b[^>]*>", " ", inner))
        assert r.text == " ".join(references.unescape(inner).split()) and r.n_chars == len(r.text)
