"""The HTML scanner: what it reads, and that time is linear in what it can't."""

import time

import pytest
from lexspark.llm import htmlmain, markup, urlfilter

MB = 1 << 20


def test_scan():
    page = """x<!-- <a href=1> --> y<A HREF = "/a?b&amp;c" title='>' class=z>t</a><br/><script>if (a<b) "</p>"</script >z<a href=u href=v>w</a></><?php a ?><p class="q" ">r<1<!doctype html>"""
    assert markup.links(page) == ["/a?b&c", "u"]
    assert markup.plain_text(page)[0].split() == ["x", "y", "t", "z", "w", "r<1"]
    assert [t for _, t, ends, _ in markup.scan(page) if t and not ends] == ["a", "br", "script", "a", "p"]
    assert markup.attributes(""" a=1 B='2 "' c="&lt;" d e= f""") == {"a": "1", "b": '2 "', "c": "<", "d": "", "e": "f"}


@pytest.mark.parametrize(("page", "language"), [("<html lang=en-US>", "en"), ("<HTML LANG=' de '>", "de"), ("<html lang>", None), ("<!-- <html lang=fr> --><html lang=es>", "es"), ("", None), ("<html lang=english>", None)])
def test_declared_language(page, language):
    assert markup.plain_text(page)[1] == language


def test_what_is_never_closed_runs_to_the_end():
    for page in ("a<p class='b c <i>d</i>", "a<!-- b", "a<script>b</p>", "a<p b", "a<title>x</titl>"):
        assert markup.plain_text(page)[0].split() == ["a"]


BROKEN = {"quotes": '<a "', "opened": "<b>", "anchors": "<a ", "scripts": "<script>", "comments": "<!--", "values": "<a href='", "equals": "<a =", "ends": "</x>", "textarea": "<textarea>", "less": "<", "amp": "&am", "declared": "<!x ", "halfscript": "<script></script"}


@pytest.mark.parametrize("name", BROKEN)
def test_linear_time(name):
    page = BROKEN[name] * (2 * MB // len(BROKEN[name]))
    begun = time.perf_counter()
    markup.plain_text(page)
    markup.links(page)
    htmlmain.parse(page, htmlmain.Forest())
    assert time.perf_counter() - begun < 12


@pytest.mark.parametrize("page", ["<b>" * 100_000 + "</x>" * 100_000, "<p><button>" + "<b>" * 60_000 + "<div></div>" * 60_000, "<ul><li>" + "<div>" * 60_000 + "<li>" * 60_000, "<table><tr><td>" + "<i>" * 60_000 + "<td>" * 60_000])
def test_linear_trees(page):
    htmlmain.trained()
    begun = time.perf_counter()
    htmlmain.main_texts([page], htmlmain.trained())
    assert time.perf_counter() - begun < 20


def test_urlfilter_of_a_long_broken_page(spark):
    pages = [(1, "http://a.test/", '<a href="http://b.test/">x</a>' + "<a " * MB), (2, "http://b.test/", None)]
    out = urlfilter.host_links(spark.createDataFrame([(u, h, u[7:-1]) for _, u, h in pages], "url string, html string, host string")).collect()
    assert [(r["src"], r["dst"]) for r in out] == [("a.test", "b.test")]
