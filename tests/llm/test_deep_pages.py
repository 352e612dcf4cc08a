"""Pages with many open, unclosed or broken tags: time and memory in step with their length."""

import time
import tracemalloc

import pytest

from typeahead.llm import tag_paths

N = 50_000
PAGES = {
    "open blocks": "<div><p>some text, here." * N,
    "open inline": "<b>x" * N,
    "open wrappers": "<div class=sidebar>x<section class=content>y" * (N // 2),
    "articles": "<article><h1>t</h1>x" * N,
    "no end": "<a " * N,
    "no end of quotes": '<a "' * N + ">",
    "odd quotes": "<a \"x' " * N + ">",
    "names": "<a" * N,
    "names and a quote": "<a" * N + ' " >',
    "closers": "<p>a" * N + "</i></b></div>" * N,
    "scripts": "<script>" * N + "</script " * N,
    "script ends": "<p>a<script>b</script >" * N,
    "comments": "<!-- " * N,
    "items": "<ul><li>" * N,
    "nested forms": "<form><main>" * N + "text" + "</main></form>" * N,
    "entities": "&amp" * N,
}


@pytest.mark.parametrize("name", PAGES)
def test_time_is_linear(name):
    began = time.process_time()
    tag_paths.main_text(PAGES[name])
    assert time.process_time() - began < 2 + 3  # a loaded machine's allowance


def test_memory_is_linear():
    tracemalloc.start()
    tag_paths.main_text(PAGES["open blocks"][:600_000])
    half = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    tag_paths.main_text(PAGES["open blocks"][:1_200_000])
    whole = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert whole < 3 * half


def test_broken_markup():
    for page, want in (('<p>a <b "c> d', 'a <b "c> d'), ("<p>x</p", "x</p"), ("a<!-- b", "a"), ("a < b <!-- c", "a < b"),
                       ("<b <!-- c", "<b"), ('<p title="1>2">y', "y"), ("<p>q</p foo=\">\">r", "q\n\nr"), ("</>z", "z")):
        assert tag_paths.main_text(page) == want, page
