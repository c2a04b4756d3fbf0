"""Articles are not lost to class names, and the decoding is the best of all labellings."""

import itertools
import random

import numpy as np
import pytest

from tracemill.llm import pages

TITLE = "Bridge to open again"
PARAGRAPHS = [
    "The council met on Tuesday to decide on the new bridge over the river, which has been closed for two years now.",
    "Members of the public spoke for an hour, and most of them were in favour of the plan that the engineers had drawn.",
    "Work begins in spring. The old stones will be kept, and the road is to open again before the winter comes.",
]
ARTICLE = f"<h1>{TITLE}</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav>'
FOOT = '<footer>Copyright 2024 Town Gazette. <a href="/i">Imprint</a></footer>'
CLASSES = ["has-sidebar", "no-sidebar", "comments-open", "single single-post header-fixed", "home footer-dark", "category-ads", "more", "related-posts-on", "page-with-form", "comment-status-open", "single", "tag-news", "header-fixed ad-free"]
PLACES = {
    "html": '<html class="{c}"><body>{nav}<main>{art}</main>{foot}</body></html>',
    "body": '<html><body class="{c}">{nav}<article>{art}</article>{foot}</body></html>',
    "article": '<html><body>{nav}<article class="{c}">{art}</article>{foot}</body></html>',
    "wrapper": '<html><body><div class="{c}">{nav}<article>{art}</article>{foot}</div></body></html>',
    "content": '<html><body>{nav}<div id="content" class="{c}">{art}</div>{foot}</body></html>',
}


@pytest.fixture(scope="module")
def trees():
    return pages.fit()


@pytest.mark.parametrize("place", PLACES)
@pytest.mark.parametrize("names", CLASSES)
def test_page_state_in_class_names_loses_nothing(trees, place, names):
    source = PLACES[place].format(c=names, nav=NAV, art=ARTICLE, foot=FOOT)
    assert pages.extract([source], trees) == ["\n\n".join([TITLE, *PARAGRAPHS])]


def within(inner):
    return f"<html><body>{NAV}<article>{inner}</article>{FOOT}</body></html>"


A, B, C = PARAGRAPHS
INNER = {
    "a section named like a list of links": (within(f'<h1>{TITLE}</h1><p>{A}</p><section class="related-work"><h2>Earlier work</h2><p>{B}</p><p>{C}</p></section>'), [TITLE, A, "Earlier work", B, C]),
    "a part named like a notice": (within(f'<h1>{TITLE}</h1><p>{A}</p><div class="notice-board-story"><p>{B}</p><p>{C}</p></div>'), [TITLE, A, B, C]),
    "a paragraph that is one link": (within(f'<h1>{TITLE}</h1><p>{A}</p><p><a href="/x">{B}</a></p><p>{C}</p>'), [TITLE, A, B, C]),
    "a quotation beside code and a table": (within(f"<h1>{TITLE}</h1><p>{A}</p><pre>{B}</pre><blockquote>{C}</blockquote><table><tr><td>Length</td><td>120 m</td></tr></table>"), [TITLE, A, B, C, "Length", "120 m"]),
    "a first paragraph with links": (
        f'<html><body class="ltr ns-0 skin-vector action-view"><div id="page-base"></div><div id="content" role="main"><h1 id="firstHeading">{TITLE}</h1><div id="bodyContent"><div id="content-text"><p>{A.replace("council", "<a href=/c>council</a>").replace("bridge", "<a href=/b>bridge</a>")}</p><p>{B}</p><p>{C}</p></div></div></div>'
        '<div id="navigation"><ul><li><a href="/">Main page</a></li><li><a href="/r">Random</a></li></ul></div><div id="footer"><ul><li>This page was last edited on 3 May.</li></ul></div></body></html>',
        [TITLE, A, B, C],
    ),
    "an unmarked list of comments": (f"<html><body>{NAV}<article>{ARTICLE}</article><div><h3>3 comments</h3><ul><li>nice one</li><li>thanks for this</li><li>I doubt it</li></ul></div>{FOOT}</body></html>", [TITLE, A, B, C]),
}


@pytest.mark.parametrize("name", INNER)
def test_blocks_inside_articles(trees, name):
    source, want = INNER[name]
    assert pages.extract([source], trees)[0].split("\n\n") == want


def test_what_is_no_article_goes_still(trees):
    bad = "".join(f'<div class="{c}"><p>Buy now, for a short time only. {link}</p></div>' for c, link in (("ad", ""), ("sidebar", '<a href="/q">Read on</a>'), ("cookie-notice", "We use cookies."), ("comments", "I liked it."), ("newsletter", "")))
    assert pages.extract([f"<html><body>{NAV}<article>{ARTICLE}</article>{bad}{FOOT}</body></html>"], trees) == ["\n\n".join([TITLE, *PARAGRAPHS])]


def test_flags():
    assert set(pages._flags(' class="sidebar"')) == {4}  # the fourth group
    assert pages._STATE in pages._flags(' class="no-sidebar"') and not any(0 < f < pages._PARTLY for f in pages._flags(' class="no-sidebar comments-open"'))
    assert pages._PARTLY in pages._flags(' class="ad-slot"') and pages._PARTLY not in pages._flags(' class="ad ad-slot"')


def test_decoding_is_the_best_of_all_labellings():
    """Against every labelling of random trees of up to nine nodes in which no kept node has a dropped parent."""
    rng = random.Random(3)
    for _ in range(60):
        source, depth = "", 0
        for _ in range(rng.randint(1, 8)):
            while depth and rng.random() < 0.5:
                source, depth = source + "</div>", depth - 1
            source, depth = source + "<div>x", depth + 1
        page = pages.Page(source)
        n = len(page.tags)
        odds = np.array([rng.uniform(-3, 3) for _ in range(n)])
        keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        best = None
        for labels in itertools.product((True, False), repeat=n - 1):
            out = [True, *labels]
            if all(out[page.parents[i]] for i in range(1, n) if out[i]):
                total = sum(keep[i] if out[i] else drop[i] for i in range(1, n))
                if best is None or total > best[0] + 1e-12:
                    best = total, out
        assert pages.decode(page, odds) == best[1]


def test_trees_are_fitted_once():
    assert pages.fit() is pages.fit()
