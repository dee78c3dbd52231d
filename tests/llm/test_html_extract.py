import itertools
import re
import time
from html import unescape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanwise.llm import html_extract as H
from spanwise.llm.common import table
from tests.llm.helpers import rows


def test_pages_against_their_article(spark, small):
    for r in rows(table(spark, small, "pages").join(H.extract_pages(table(spark, small, "pages")), ["page_id", "url"])):
        inside = re.search(r"<article>(.*)</article>", r["html"], re.DOTALL)[1]
        parts = [" ".join(unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split()) for p in re.split("</?(?:h1|p)>", inside)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


BOILERPLATE = """<html><head><title>T</title><style>x{}</style></head><body>
<header><div class="logo">Site</div><a href=/>Home</a></header><nav><a href=1>One</a> <a href=2>Two</a></nav>
<div class="cookie-notice">We use cookies.</div><div id="content"><h1>Title &amp; more</h1>
<p>First paragraph with <a href=x>a link</a> and a good deal of text, as articles have.<p>Second   paragraph&nbsp;here, unclosed; it is long enough too.
<div class="advert">Buy now!</div><ul><li>Item one of the list in the article.<li>Item two, which follows it closely.</ul>
<blockquote>Quoted text that belongs to the article itself.</blockquote></div>
<aside><p>Related stories that are long enough to look like an article's text, really.</p></aside>
<div class="comments"><p>A reader's comment, which is a whole sentence and more than that.</p></div>
<form><p>Subscribe to our newsletter, a sentence inside a form.</p><input></form>
<script>var a = "<p>not text</p>";</script><!-- <p>hidden</p> --><footer><p>All rights reserved by the owner of this page.</p></footer></body></html>"""


def test_boilerplate_goes_and_content_stays():
    assert H.main_text(BOILERPLATE).split("\n") == [
        "Title & more", "First paragraph with a link and a good deal of text, as articles have.", "Second paragraph here, unclosed; it is long enough too.",
        "Item one of the list in the article.", "Item two, which follows it closely.", "Quoted text that belongs to the article itself.",
    ]


STORY = "<h1>A title</h1><p>A first paragraph of the story, with a proper sentence in it.</p><p>A second one that is just as long, and a sentence too.</p>"
STORY_TEXT = ["A title", "A first paragraph of the story, with a proper sentence in it.", "A second one that is just as long, and a sentence too."]


def test_layout_names_do_not_take_the_article():
    for page in (
        f"<div class='container has-sidebar'><article>{STORY}</article></div>",
        f"<article class='post category-legal tag-social'>{STORY}</article>",
        f"<div class='content-sidebar-wrap'><main>{STORY}</main><div class='sidebar'><p>Words beside the story, a whole sentence of them.</p></div></div>",
        f"<form action=/x><nav><a href=1>One</a></nav><div id=main>{STORY}</div><div class=cookie-notice><p>We use cookies on every page of it.</p></div></form>",
        f"<div class='social-layout'>{STORY}</div>",
        f"<div class='banner-page'><article>{STORY}<div class='related-posts'><p>Another story.</p></div></article><div class='comments'><article class='comment-body'><p>{'A long comment of a reader. ' * 30}</p></article></div></div>",
    ):
        assert H.main_text(page).split("\n") == STORY_TEXT, page


def test_broken_markup_and_references():
    assert H.main_text("<article><p>Fish &amp; chips &lt;b&gt; &am &#233; &#x263A; &bogus;</p>") == "Fish & chips <b> &am é ☺ &bogus;"
    assert H.main_text("<main>a<br>b  c<p>d<b>e</b>f") == "a b c\ndef"
    assert H.main_text('<main>text <a href="un') == "text"
    assert H.main_text("<main>1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"
    for empty in (None, "", "   ", "<html></html>", "<script>x", "<!-- x", "<", "</p></p>"):
        assert H.main_text(empty) in ("", "<")


def brute(unary, arcs):
    def cost(keep):
        return sum(u for u, k in zip(unary, keep, strict=True) if u > 0 and not k) - sum(u for u, k in zip(unary, keep, strict=True) if u < 0 and k) + sum(c for a, b, c in arcs if keep[a] != keep[b])

    return min(map(cost, itertools.product([False, True], repeat=len(unary)))), cost


@settings(deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=8), st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7), st.integers(0, 4)), max_size=12))
def test_cut_is_minimal(unary, arcs):
    arcs = [(a % len(unary), b % len(unary), float(c)) for a, b, c in arcs if a % len(unary) != b % len(unary)]
    least, cost = brute(unary, arcs)
    assert abs(cost(H.minimum_cut([float(u) for u in unary], arcs)) - least) < 1e-9


def test_smoothing_takes_a_short_line_along():
    page = "<div><p>A long paragraph of the story, with a proper sentence in it.</p><p>Yes</p><p>Another long paragraph of the story, with a sentence.</p></div>"
    alone = H.evidence(*H.blocks_of("<div><p>Yes</p></div>")[0])
    assert alone < 0 and "Yes" in H.main_text(page).split("\n")


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "x", 1), (1, "u", None, "x", 1), (2, None, "", "y", 2), (3, "v", "<p>" * 3000 + "deep text in many open elements, and so on." + "<div>" * 3000, "z", 3), (None, "w", "<article>" + "word " * 50_000, None, None)], "page_id long, url string, html string, text string, n_chars long")
    got = rows(H.extract_pages(pages))
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["n_chars"] for r in got if r["page_id"] is None] == [249_999]
    assert H.extract_pages(pages.limit(0)).count() == 0


def test_deep_nesting_takes_time_in_proportion():
    n = 20_000
    for page, last in (("<article>" + "<b>x " * n, "x"), ("<div>" + "<b>" * n + "<p>some words</p> y " * 2000, "y"), ("<main>" + "<b>" * n + "</i>" * n + "<li>end</li>" * 2000, "end")):
        began = time.process_time()
        text = H.main_text(page)
        assert time.process_time() - began < 2 and (not text or text.split()[-1] == last)


def test_a_true_sidebar_inside_a_layout_name():
    page = f"<div class='has-sidebar'><article>{STORY}</article><div class='sidebar'><p>Words beside the story, a whole sentence of them.</p></div></div>"
    assert H.main_text(page).split("\n") == STORY_TEXT
    for wrap in ("<main class='no-sidebar'>{}</main>", "<div id='page' class='menu-open'><div>{}</div></div>", "<article class='post comments-open'>{}</article>"):
        assert H.main_text(wrap.format(STORY)).split("\n") == STORY_TEXT, wrap


ARTICLE = [f"The council met on the {i}th day and spoke at length of roads, schools and the new bridge over the river." for i in range(11)]
ASIDE = "Read how our partners save money every day with small changes at home and at work, and sign up for more of the same. "
WRAPPERS = [
    '<div class="login-layout">{}</div>', '<div class="header-and-body">{}</div>', '<div id="widget-main">{}</div>', "<form action='x'>{}</form>", '<div class="share-story">{}</div>', '<div class="content"><fieldset>{}</fieldset></div>',
    '<div id="sidebar-page"><div>{}</div></div>', '<div class="nav-wrapper"><div class="row">{}</div></div>', '<form id="aspnetForm"><div class="inner">{}</div></form>', '<div class="promo container"><div class="promo-main">{}</div></div>',
]
BODIES = ["".join(f"<p>{x}</p>" for x in ARTICLE), "<h1>Roads and schools</h1>" + "".join(f"<div>{x}</div>" for x in ARTICLE), "".join(f"<p>{x}</p>" for x in ARTICLE[:6]) + "<ul>" + "".join(f"<li>{x}</li>" for x in ARTICLE[6:]) + "</ul>"]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("body", BODIES)
def test_layouts_without_article_or_main(wrapper, body):
    """A name or a form around the whole page doesn't turn its text against what stands beside it."""
    page = "<body><nav><a href=1>Home</a><a href=2>News</a></nav>" + wrapper.format(body) + f"<div><p>{ASIDE * 2}</p></div><footer>All rights reserved.</footer></body>"
    if "share-story" in wrapper:
        page = page.replace("<div><p>Read how", '<div class="sidebar"><p>Read how')
    got = H.main_text(page).split("\n")
    assert [x for x in got if x != "Roads and schools"] == ARTICLE


def test_small_forms_and_named_blocks_still_go():
    text = "".join(f"<p>{x}</p>" for x in ARTICLE)
    for small in (f"<form><p>{ASIDE}</p></form>", f'<div class="sidebar-content"><p>{ASIDE * 3}</p></div>', f'<div class="comment-body"><p>{ASIDE * 3}</p></div>', f"<fieldset><p>{ASIDE}</p></fieldset>"):
        assert H.main_text(f"<body><div>{text}</div>{small}</body>").split("\n") == ARTICLE

