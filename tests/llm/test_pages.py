"""Pages against the standard library's parser, and hostile ones in linear time."""

import time
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow.parquet as pq
import pytest

from fieldloom.llm import warc


class Brute(HTMLParser):
    """Title, text and links by events of the parser of the standard library."""

    def __init__(self, base):
        super().__init__(convert_charrefs=True)
        self.base, self.out, self.title, self.links = base, [], [], []
        self.hidden, self.in_title = "", False

    def handle_starttag(self, tag, attrs):
        wanted = warc.LINKS.get(tag)
        found = [v for k, v in attrs if k == wanted and v is not None]
        if wanted and found:
            self.links.append({"path": f"{tag.upper()}@/{wanted}", "url": urljoin(self.base, found[0].strip())})
        if tag in ("script", "style", "template", "noscript") and not self.hidden:
            self.hidden = tag
            self.out.append(" ")
        if tag in warc.BLOCKS and not self.hidden:
            self.out.append("\n")
        if tag == "title":
            self.in_title = True

    def handle_endtag(self, tag):
        if tag == self.hidden:
            self.hidden = ""
        if tag in warc.BLOCKS and not self.hidden:
            self.out.append("\n")
        if tag == "title":
            self.in_title = False

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_comment(self, data):
        self.out.append(" ")

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)
            if self.in_title:
                self.title.append(data)


def brute(html, base):
    p = Brute(base)
    p.feed(html)
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.out).split("\n"))
    return " ".join("".join(p.title).split()), "\n".join(x for x in lines if x), p.links


def test_pages_equal_the_standard_parser():
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["url", "html"]).to_pylist()
    assert rows
    for r in rows:
        title, text, links = warc.page(r["html"], r["url"])
        assert (title, "\n".join(" ".join(x.split()) for x in text.split("\n")), links) == brute(r["html"], r["url"])


CASES = (
    "<p class='a>b'>x</p><a href=\"/q?a=1&amp;b=2\">y</a>",
    "<style>p{}</style>a<script>if (a<b) {'</p>'}</script>b<!-- <p> -->c",
    "<SCRIPT src=/s.js>x</SCRIPT ><title>T&lt;</title><ul><li>1<li>2</ul>",
    "a < b and 3 <4 <br/>c<img alt='x>y' src=i.png>",
    "<!DOCTYPE html><html><head></head><body>q<?php x ?>r</body></html>",
)


@pytest.mark.parametrize("html", CASES)
def test_cases(html):
    title, text, links = warc.page(html, "http://a.b/")
    assert (title, "\n".join(" ".join(x.split()) for x in text.split("\n")), links) == brute(html, "http://a.b/")


def test_what_is_never_closed():
    assert warc.page("a<script>b", "")[1] == "a" and warc.page("a<!-- b", "")[1] == "a"
    assert warc.page("a <b c", "")[1] == "a <b c" and warc.page("<p title=\"x>y</p>z", "")[1] == "y\nz"


HOSTILE = ("<script", "<!--", "<a ", "<a \"", "<a '\"", "<!", "<?", "<a href=", "<", "&", "<a x=\"><b", "</script ", "<p>", "<a " + "a" * 50, "a=\"'", "<style>", "<title>")


@pytest.mark.parametrize("piece", HOSTILE)
def test_hostile_pages_take_linear_time(piece):
    for end in ("", ">", "\" >", "' x"):
        html = piece * (1_000_000 // len(piece)) + end
        began = time.perf_counter()
        warc.page(html, "http://a.b/")
        assert time.perf_counter() - began < 20


def test_folded_headers_are_read_in_linear_time():
    began = time.perf_counter()
    found = warc.Headers.parse(["A: x", *[" y"] * 300_000, "B: z"])
    assert len(found["A"]) == 600_001 and found["B"] == "z" and time.perf_counter() - began < 10


def test_a_very_long_page():
    raw = warc.response("http://a.b/", "<p>" + "word " * 4_000_000 + "<a href=x>", "2024-01-01T00:00:00Z")
    (_, metadata), (headers, text) = warc.derive(raw)
    assert len(text) == 20_000_000 - 1 and b'"http://a.b/x"' in metadata and headers["WARC-Block-Digest"] == warc.digest(text)
