"""Labels of wrapper slots: copies are no evidence, constant groups and notices are template, depth costs nothing."""

import time

import pytest

from tessera.llm import extraction

PAGE = "page_id long, url string, html string"


def texts(spark, pages):
    rows = [(k, f"http://h.example/{k}", html) for k, html in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(rows, PAGE).repartition(3)).collect()}
    return [got[k] for k in range(len(pages))]


def story(k):
    return f"Story {k} tells of {'one thing' if k % 2 else 'another thing'} that happened {k} times, and of what came after it."


@pytest.mark.parametrize("copies", [1, 2, 3, 9])
def test_copies_are_no_evidence(spark, copies):
    six = [f'<div class="content"><p>{story(k)}</p></div>' for k in range(6)]
    quote = '<div class="content"><blockquote>A quote that stands alone.</blockquote></div>'
    assert texts(spark, six + [quote] * copies) == [story(k) for k in range(6)] + ["A quote that stands alone."] * copies


@pytest.mark.parametrize("n", [3, 8])
def test_constant_lists_beside_an_article(spark, n):
    offers = '<div class="x1"><ul class="q"><li>The first of two long and steady offers that outweighs everything else on a page of this host</li><li>The second of two long and steady offers, which says a bit more than the first one did, and then more</li></ul></div>'
    assert texts(spark, [f'{offers}<div class="x2"><p>{story(k)}</p></div>' for k in range(n)]) == [story(k) for k in range(n)]


def test_a_list_that_changes_stays(spark):
    pages = [f'<div class="x1"><ul class="q"><li>{story(k)}</li><li>The same in all of them.</li></ul></div>' for k in range(6)]
    assert texts(spark, pages) == [f"{story(k)}\n\nThe same in all of them." for k in range(6)]


@pytest.mark.parametrize("inner", ["article", "main"])
def test_notices_inside_an_article(spark, inner):
    notice = '<div class="k9">Get our letter each week, straight to you.</div>'
    pages = [f"<{inner}><h1>News</h1><p>{story(k)}</p>{notice}<p>{story(k + 50)}</p></{inner}>" for k in range(8)]
    assert texts(spark, pages) == [f"News\n\n{story(k)}\n\n{story(k + 50)}" for k in range(8)]


def test_copies_of_one_article_keep_all(spark):
    page = f"<article><h1>News</h1><p>{story(1)}</p><div class='k9'>A steady line.</div></article>"
    assert texts(spark, [page] * 6) == [f"News\n\n{story(1)}\n\nA steady line."] * 6


def test_labels_restated(spark):
    """Opaque names: a slot is template if it holds one text on all pages and there are three different ones; the body is what is left in the fullest element."""
    for n in range(1, 6):
        pages = [f'<div class="a1"><span class="z">Top line</span></div><div class="b2"><p>{story(k)}</p><p>{story(k + 9)}</p></div><div class="c3"><p>Below all</p></div>' for k in range(n)]
        body = [f"{story(k)}\n\n{story(k + 9)}" for k in range(n)]
        got = texts(spark, pages)
        assert got == body


def test_without_the_wrapper_it_is_another_result(spark, monkeypatch):
    pages = [f"<article><p>{story(k)}</p><div class='k9'>Get our letter.</div></article>" for k in range(5)]
    page = extraction.Page(pages[0])
    nodes, slots = extraction.collapse_with_slots(page.stream)
    known = extraction.Wrapper(nodes, [])
    assert "Get our letter." in known.text(page) and "Get our letter." not in texts(spark, pages)[0]


@pytest.mark.parametrize(("head", "tail"), [("<div>", "</div>"), ("<div class='c'><b>x</b>", "</div>"), ("<ul><li>", "</li></ul>"), ("<div>", "")])
def test_depth_takes_linear_time(head, tail):
    n = 1_000_000 // (len(head) + max(1, len(tail)))
    began = time.time()
    page = extraction.Page(head * n + "text" + tail * n)
    nodes, slots = extraction.collapse_with_slots(page.stream)
    assert sum(map(len, slots)) == len(page.slots) and extraction.parse(nodes, extraction.unrolled(nodes)) is not None
    assert time.time() - began < 15


def test_wide_pages_collapse():
    html = "<div><p>a</p><p>b</p></div>" * 20_000
    began = time.time()
    page = extraction.Page(html)
    nodes, slots = extraction.collapse_with_slots(page.stream)
    assert nodes == [["+", ["div", ["+", ["p", "#", "/p"]], "/div"]]] and len(slots[0]) == 40_000 and time.time() - began < 5
