"""Operator 8 on malformed pages: time, and which style rule wins."""

import time

import pytest

from tillcast.llm.op8_html_text import render


def timed(page, seconds):
    start = time.process_time()
    text = render(page)
    assert time.process_time() - start < seconds
    return text


@pytest.mark.parametrize("part", ["<a ", "<a b=c ", '<a b="c" ', "<a b='", "</a ", "< ", "<!x ", "<p title=\"x ", "<script "])
def test_a_megabyte_of_unclosed_tags_is_read_once(part):
    page = "<p>before</p>" + part * (1_000_000 // len(part))
    assert timed(page, 10).startswith("before")
    assert timed(page + "<b>after</b>", 10).startswith("before")


def test_text_after_a_tag_that_never_ends_is_kept():
    assert "seen" in render("<p>a</p><p title='x> <b>seen</b>") and "last" in render('<a b=">" "> last <i')


def test_large_spans_and_deep_rules():
    rows = "".join("<tr>" + "<td colspan=1000 rowspan=1000>x</td>" * 20 + "</tr>" for _ in range(100))
    assert timed(f"<table>{rows}</table>", 5).count("x") == 2000
    sheet = "a{" * 30_000 + "color:red" + "}" * 30_000
    assert timed(f"<style>{sheet}</style><p>shown</p>", 5) == "shown"


def test_columns_after_spans_stay_aligned():
    page = "<table><tr><td rowspan=2>aa</td><td>b</td><td>c</td></tr><tr><td colspan=2>dd</td></tr><tr><td>e</td><td>f</td><td>g</td></tr></table>"
    assert render(page).split("\n") == ["aa  b  c", "    dd", "e   f  g"]


@pytest.mark.parametrize(("style", "body", "seen"), [
    (".a{display:block}.b{display:none}", '<p class="b a">x</p>', False),
    (".b{display:none}.a{display:block}", '<p class="b a">x</p>', True),
    (".b{display:none}.a{display:block}", '<p class="a b">x</p>', True),
    ("p{display:none!important}", '<p style="display:block">x</p>', False),
    ("p{display:none!important}", '<p style="display:block !important">x</p>', True),
    ("#i{display:none}.a{display:block}", '<p class=a id=i>x</p>', False),
    (".a{display:none !important}#i{display:block}", '<p class=a id=i>x</p>', False),
    ("p.a{display:none}.a{display:block}", '<p class=a>x</p>', False),
    (".a{display:none;display:block}", '<p class=a>x</p>', True),
    (".a{.c{display:block}display:none}", '<p class=a>x</p>', False),
])
def test_the_cascade_goes_by_importance_specificity_and_order(style, body, seen):
    assert ("x" in render(f"<style>{style}</style>{body}<p>y</p>")) == seen
