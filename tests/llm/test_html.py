"""Wrapper induction: tree matching against brute force, template text, and hostile markup."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoloom.llm import html_text
from chronoloom.llm.html_text import Block, Shapes

TREES = st.recursive(st.sampled_from("ab").map(lambda x: (x, [])), lambda kids: st.tuples(st.sampled_from("ab"), st.lists(kids, max_size=4)), max_leaves=9)


def block(tree):
    made = Block(tree[0])
    made.items = [block(t) for t in tree[1]]
    return made


def brute_matching(a, b):
    """Nodes of the largest matching that keeps labels, parents and order, by trying everything."""
    if a[0] != b[0]:
        return 0

    def best(left, right):
        if not left or not right:
            return 0
        return max(best(left[1:], right), best(left, right[1:]), brute_matching(left[0], right[0]) + best(left[1:], right[1:]))

    return 1 + best(a[1], b[1])


@settings(max_examples=150, deadline=None)
@given(TREES, TREES, st.sampled_from([1, 4, 1 << 20]))
def test_matching_is_the_largest(a, b, cells):
    x, y, shapes, before = block(a), block(b), Shapes(), html_text.CELLS
    html_text.CELLS = cells
    try:
        shapes.number(x), shapes.number(y)
        pairs = list(html_text.matched(shapes, x, y))
    finally:
        html_text.CELLS = before
    assert len(pairs) == brute_matching(a, b)
    assert all(p.label == q.label for p, q in pairs) and len({id(p) for p, _ in pairs}) == len({id(q) for _, q in pairs}) == len(pairs)


def test_template_goes_and_every_slot_stays():
    """No class or tag of these pages tells what is content."""
    page = lambda i, more: (
        f"<html><body><div><div>Home</div><div>All stories</div></div><h1>Title {i}</h1><div><p>First {i} words.</p><p>Sign up now</p>"
        f"<p>Last words of {i}.</p></div><div>Written on day {i}</div>{more}<div>All rights reserved</div></body></html>"
    )
    pages = [page(i, "<div>A note of one page</div>" if i == 2 else "") for i in range(6)]
    wrapper = html_text.Wrapper(html_text.induce(pages))
    for i, p in enumerate(pages):
        want = [f"Title {i}", f"First {i} words.", f"Last words of {i}.", f"Written on day {i}"] + ["A note of one page"] * (i == 2)
        assert html_text.extract(p, wrapper).split("\n") == want
    assert html_text.extract("<p>Another page<p>Sign up now", wrapper) == "Another page\nSign up now"
    assert html_text.induce(pages[:2]) is None and html_text.induce([f"<p>{i}" for i in range(4)]) is None


def test_copies_among_references_are_no_template():
    copy = "<article><h1>Same story</h1>" + "".join(f"<p>Paragraph {i} of it.</p>" for i in range(20)) + "</article>"
    others = [f"<article><h1>Story {i}</h1><p>Only {i}.</p></article>" for i in range(4)]
    wrapper = html_text.Wrapper(html_text.induce([copy, copy + "<!-- a -->", copy.replace("graph 3 of", "graph three of"), *others]))
    assert not wrapper.constant and wrapper.parts
    assert html_text.extract(copy, wrapper).split("\n") == ["Same story", *[f"Paragraph {i} of it." for i in range(20)]]
    assert html_text.induce([copy, copy + "<!-- a -->", copy + "<!-- b -->"]) is None  # one page told three times


def test_odd_markup_keeps_what_it_says():
    take = lambda s: html_text.extract(s, None)
    assert take("a < b <i>c</i> &amp; d<br>e<script>x<p>y</script><p title='1 > 2'>f<p title=\"it's\">g") == "a < b c & d e\nf\ng"
    assert take("<div class='post-header'>out</div><article><div class='post-header'>Title</div><p>Body<div class='related'>no</div></article>") == "Title\nBody"
    assert take("<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>") == "one\ntwo\nx\ny"
    assert take("<p data-class='ad'>kept</p><p class='ad'>gone</p><main></main>") == "kept"
    assert take("") == "" and take("<!-- never ends <p>x") == "" and take("<script>x") == ""


def test_an_article_counts_where_it_holds_most_of_what_varies():
    take = lambda s: html_text.extract(s, None).split("\n")
    assert take("<div id=content>This is the main text</div><section><article>teaser</article></section>") == ["This is the main text", "teaser"]
    assert take("<div>by the way</div><article>The story that the page is about</article>") == ["The story that the page is about"]
    # The host decides: its articles are teasers, on one page with little other text as well; or the story, however short.
    teasers = [f"<div id=content>Main text number {i} of this host, at length</div><article>Teaser {i}</article>" for i in range(5)]
    wrapper = html_text.Wrapper(html_text.induce(teasers))
    assert wrapper.parts is False
    assert html_text.extract("<div id=content>Hm</div><article>A teaser at length</article>", wrapper) == "Hm\nA teaser at length"
    stories = [f"<p>Aside {i}</p><article>Story number {i} of this host, told at length</article>" for i in range(5)]
    wrapper = html_text.Wrapper(html_text.induce(stories))
    assert wrapper.parts is True
    assert html_text.extract("<p>An aside at length</p><article>Hm</article>", wrapper) == "Hm"
    assert html_text.extract("<p>No article</p>", wrapper) == "No article"


def test_template_text_outweighs_an_article_no_more():
    """What is equal on all pages is no text of the page when it is asked where most of its text stands."""
    rules = "House rules of this site, which are the same on every page and longer than any story of it. " * 3
    told = ["A dog ran home at noon.", "Rain fell over green hills.", "Bread costs more again.", "Nobody knew why she left.", "Two ships met in fog."]
    pages = [f"<div>{rules}</div><article><h1>Story {i}</h1><p>{t}</p></article>" for i, t in enumerate(told)]
    wrapper = html_text.Wrapper(html_text.induce([*pages, pages[0].replace("ran home", "ran away")]))
    assert wrapper.parts and [html_text.extract(p, wrapper) for p in pages] == [f"Story {i}\n{t}" for i, t in enumerate(told)]
    assert html_text.extract(f"<div>{rules}</div><p>No article</p>", wrapper) == "No article"


def test_class_words_of_a_subject_stay():
    take = lambda name: html_text.extract(f"<div class='{name}'>text</div><p>more", None) == "text\nmore"
    for name in ("navy", "social-science", "share-price", "promotion-law", "hidden-gems", "related-work", "header-less", "adobe", "cookie-recipes", "", "x y"):
        assert take(name), name
    for name in ("nav", "main-nav", "MainNav", "ad", "ad-300x250", "ad_a8", "related-posts", "reader-comments", "comments", "site-header", "x sidebar", "promo box", "share-buttons"):
        assert not take(name), name


def test_a_form_around_the_page_is_its_frame():
    take = lambda s: html_text.extract(s, None)
    assert take("<form><nav>Menu</nav><div><h1>Title</h1><p>Body<input><button>Go</button></div><footer>f</footer></form>") == "Title\nBody"
    assert take("<p>Body</p><form><p>Your mail<input></form>") == "Body"
    assert take("<div class=widget><article>The story</article></div><div class=widget>Weather</div>") == "The story"
    assert take("<div class=related><article>one</article><article>two</article></div><p>Body") == "Body"


@pytest.mark.parametrize("source", ["<a" * 100_000, "<a " * 100_000 + ">", '<a "' * 100_000 + ">", "<a \"><b '>" * 50_000, "<" * 100_000 + ">", "<!--" * 50_000, "<div>" * 5000 + "deep", "<b>" * 5000 + "<p>x" * 5000, "<div>" * 5000 + "</b>" * 50_000])
def test_hostile_markup_is_linear(source):
    began = time.process_time()
    html_text.extract(source, None)
    assert time.process_time() - began < 1


def test_deep_and_wide_pages_have_wrappers():
    deep = lambda i: "<div>" * 5000 + f"slot {i}<p>template</p>"
    wrapper = html_text.Wrapper(html_text.induce([deep(i) for i in range(4)]))
    assert html_text.extract(deep(9), wrapper) == "slot 9"
    began = time.process_time()
    wide = lambda i: "".join(f"<p>{i} {j}</p>" + "<ul><li>x</ul>" * (j % (i + 2) == 0) for j in range(1500))
    html_text.induce([wide(i) for i in range(4)])
    assert time.process_time() - began < 10


def test_long_lists_align_alike_in_halves():
    draw = np.random.default_rng(3)
    weights = draw.integers(0, 5, (6, 6)) * 71
    left, right = (np.stack([draw.integers(0, 6, n), draw.integers(0, 4, n)], 1) for n in (90, 70))
    total = lambda pairs: sum(weights[left[i, 0], right[j, 0]] + (left[i, 1] == right[j, 1] != 0) for i, j in pairs)
    whole = total(html_text.heaviest(weights, left, right))
    html_text.CELLS, before = 50, html_text.CELLS
    halves = html_text.heaviest(weights, left, right)
    html_text.CELLS = before
    assert total(halves) == whole and all(a < c and b < d for (a, b), (c, d) in zip(halves, halves[1:], strict=False))
