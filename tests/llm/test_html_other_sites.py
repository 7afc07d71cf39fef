"""Pages of other makes than the training pages, and pages that once came out empty."""

import html
import random

import pytest

from ferrule.llm import html_crf, queries

SF = "/root/testdata/sf0.001"
_WORDS = """the of and to in that was his with from her had they which were been their would when there river market
letter people morning council winter history machine language between children question mountain evening research
company theatre government station another however perhaps several together""".split()


class Site:
    """Templates with their own class names; ``main`` collects the text that is to come out."""

    def __init__(self, rng):
        self.r, self.main = rng, []

    def line(self, a, b):
        return " ".join(self.r.choice(_WORDS) for _ in range(self.r.randint(a, b)))

    def para(self, a=2, b=5):
        return " ".join(self.line(6, 20).capitalize() + "." for _ in range(self.r.randint(a, b)))

    def keep(self, text):
        self.main.append(text)
        return html.escape(text)

    def body(self, tag="p"):
        out = [f"<h1 class='headline'>{self.keep(self.line(3, 9).title())}</h1>"]
        for _ in range(self.r.randint(2, 7)):
            k = self.r.random()
            if k < 0.7:
                out.append(f"<{tag}>{self.keep(self.para())}</{tag}>")
            elif k < 0.8:
                out.append(f"<h2>{self.keep(self.line(2, 6).capitalize())}</h2>")
            elif k < 0.9:
                out.append("<ul>" + "".join(f"<li>{self.keep(self.para(1, 2))}</li>" for _ in range(3)) + "</ul>")
            else:
                out.append(f"<blockquote><p>{self.keep(self.para(1, 2))}</p></blockquote>")
        return "\n".join(out)

    def links(self, n=6):
        return "".join(f"<li class='item-{i}'><a href='/s/{i}'>{self.line(1, 2).title()}</a></li>" for i in range(n))


def blog(s):
    return f"""<body class="post-template-default single"><div id="page" class="hfeed"><header id="masthead" class="brand-bar"><a href="/">{s.line(1, 3)}</a><p class="tagline">{s.line(3, 7)}</p></header>
<nav class="primary-menu"><ul>{s.links()}</ul></nav><div class="layout"><main><article class="hentry"><div class="entry-body">{s.body()}</div></article>
<section class="commentlist"><h3>2 Comments</h3><ol><li><cite>{s.line(1, 2)}</cite><p>{s.para(1, 2)}</p></li><li><cite>{s.line(1, 2)}</cite><p>{s.para(1, 1)}</p></li></ol></section></main>
<aside class="widget-area"><h3>{s.line(1, 2)}</h3><ul>{s.links(4)}</ul></aside></div><footer class="colophon"><p>&copy; 2024 {s.line(1, 3)}. All rights reserved.</p></footer></div></body>"""


def news(s):
    return f"""<body><div class="cookie-banner"><p>We use cookies to improve this service.</p><button>Accept</button></div><div class="topbar-links"><ul>{s.links()}</ul></div>
<div class="l-content"><div class="c-article__body">{s.body()}</div><div class="sponsored-content"><p>{s.para(1, 2)}</p></div><div class="related-stories"><h4>Related</h4><ul>{s.links(5)}</ul></div></div>
<div class="footer-bottom"><p>Terms of use and privacy</p><ul>{s.links(3)}</ul></div></body>"""


def opaque(s):
    return f"""<body><nav class="css-1k2"><ul>{s.links(7)}</ul></nav><div class="css-9ab"><div class="css-x77">{s.body()}</div></div><form class="css-p0"><label>{s.line(1, 2)}</label><input><button>{s.line(1, 1)}</button></form>
<footer class="css-zz1"><p>&copy; {s.line(2, 4)}</p></footer></body>"""


def bare(s):
    return f"<html><body><ul class='menu'>{s.links(4)}</ul>{s.body()}<hr><footer>Copyright {s.line(2, 4)}</footer></body></html>"


def plain(s):
    return f"<html><body>{s.body()}</body></html>"


def wiki(s):
    return f"""<body><header role="banner"><h2><a href="/">{s.line(1, 2)}</a></h2></header><div role="navigation" class="side-navigation"><ul>{s.links(8)}</ul></div>
<div id="mw-content-text" role="main">{s.body()}</div><div id="ad-container"><p>{s.para(1, 2)}</p></div><footer role="contentinfo"><ul>{s.links(3)}</ul><p>{s.line(4, 8)}</p></footer></body>"""


SITES = [blog, news, opaque, bare, plain, wiki]


def scores(site, n=40):
    model = html_crf.default_model()
    hit = given = wanted = 0
    for seed in range(n):
        s = Site(random.Random(f"{site.__name__}{seed}"))
        page = site(s)
        got = [x for x in html_crf.main_text(page, model).split("\n\n") if x]
        left = list(s.main)
        for x in got:
            if x in left:
                left.remove(x)
                hit += 1
        given, wanted = given + len(got), wanted + len(s.main)
    return 2 * hit / (given + wanted)


@pytest.mark.parametrize("site", SITES, ids=lambda f: f.__name__)
def test_block_f1_on_unseen_markup(site):
    assert scores(site) >= 0.95


P = "The first paragraph tells a story, and it goes on for a while. It has sentences."


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<body><p>{P}</p><p>{P}</p><p>{P}</p></body>", [P, P, P]),
        (f"<main><div class='comment-free'><p>{P}</p><p>{P}</p></div></main>", [P, P]),
        (f"<article><h1>A head line</h1><p>{P}</p><object><p>{P}</p></object><canvas>{P}</canvas><noscript><p>{P}</p></noscript></article>", ["A head line", P, P, P, P]),
        (f"<article><p>{P}</p>" + "<div>" * 7000 + f"<p>{P}</p></article><div class='comments'><p>Nice one.</p></div>", [P, P]),
        ("<article></article>", []),
        ("<nav><a href=/>home</a></nav><footer>&copy; me</footer>", []),
    ],
)
def test_pages_by_hand(page, want):
    assert html_crf.main_text(page, html_crf.default_model()) == "\n\n".join(want)


def test_query_against_the_article_element(spark):
    """On the given pages the main text is the article element; blocks are cut by hand with a plain expression."""
    import re

    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.QUERIES["op3_html"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id].html or "", re.S)
        parts = re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", inside[1]) if inside else []
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", p))).split()) for p in parts]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_crf.extract_main_text(empty).count() == 0
