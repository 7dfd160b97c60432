from __future__ import annotations

import base64
import gzip
import hashlib
import html.parser
import json
import os
import random
import time

import pytest

from tessera.llm.warc import BLOCKS, derivatives, derive, page_facts, page_responses, page_text, read_records, read_warc, warc_record, write_warc

PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><meta name="d" content='x "y"'><style>p{}</style></head><body><!-- <a href="/no">n</a> -->
<h1>Top</h1><p>One <b>two</b>&nbsp;three<br>four</p><script>var t="</p><a href='/no'>";</script><a title="a > b" href="/rel?a=1&amp;b=2">link</a> <A HREF=http://o.org/x>o</A><a name=n>n</a>
<ul><li>i1</li><li>i2</li></ul> 1 < 2 and 3 <4</body></html>"""


def test_text_WHEN_page_is_usual_SHOULD_have_a_line_for_each_block():
    assert page_text(PAGE) == "Top\nOne two three\nfour\nlink on\ni1\ni2\n1 < 2 and 3 <4"


def test_facts_WHEN_page_is_usual_SHOULD_have_title_metas_and_absolute_links():
    facts = page_facts(PAGE, "https://h.com/d/p")
    assert facts["title"] == "A & B" and facts["links"] == ["https://h.com/rel?a=1&b=2", "http://o.org/x"] and facts["metas"] == [{"name": "d", "content": 'x "y"'}]
    assert page_facts(PAGE, "")["links"][0] == "/rel?a=1&b=2"


@pytest.mark.parametrize(("page", "text"), [("", ""), ("plain", "plain"), ("a<!-- open", "a"), ("a<script>x", "a"), ("a<b", "a<b"), ("<p>a<p>b", "a\nb"), ("x<td>y</td>z", "x\ny\nz"), ("<" * 3000, "<" * 3000), ("<a \"" * 3000, "<a \"" * 3000)])
def test_text_WHEN_markup_is_broken_SHOULD_read_on(page, text):
    assert page_text(page).replace(" ", "") == text.replace(" ", "")


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>t</title><body><p>hello</body>", "hello"), ("<head><meta charset=utf-8><!-- <body> --><script>'<p>'</script><title>t</title><p>hello", "hello"), ("<head><title>t</title>hello<p>you", "hello\nyou"),
        ("<head><title>t</title></head><body>a<head-line>b</head-line>c", "abc"), ("a<template-x>b</template-x>c", "abc"), ("a<svg-icon>b</svg-icon><script-x>c", "abc"), ("a<noscript>x</noscript>b<template>y</template>c", "abc"),
        ("a<svg/>b", "ab"), ("a<svg viewBox='0 > 0' />b<svg><text>x</text></svg>c", "abc"), ("a<svg><path d=x><p>b<svg><title>x</title></svg>c", "a\nbc"), ("a<svg><style>p{}<p></style><text>x", "a"),
    ],
)
def test_text_WHEN_end_tags_are_missing_SHOULD_not_go(page, text):
    assert page_text(page) == text


MALFORMED = [
    "<p>1 < 2 and 3 > 2 is true</p>", "<p>a <3 b> c < d > e</p>", "a <> b", "x <= y >= z", "<p class=a'b>it's</p>", "<p title=\"a > b\" x='c > d'>in</p>out", "<p <b>one</p>two", "<p a=\"1\"b='2'>x</p>", "<p a = 'x > y' >in</p>",
    "a</ q>b", "a</>b", "a<!doctype x>b", "a<?xml v='1'?>b", "a<!x>b", "a<p/>b<br/>c", "<a/b/c>t</a>", "<p ==a>t</p>", "<p a==b>t</p>", "<p a='b'/>t", "5<6 and <b>7</b>>8", "<P ID=x>up</P >", "a<b\"c>d</b>e", "<p " + "a=1 " * 1_100 + ">many</p>after", "<p " + "x " * 5_000 + ">names",
]


@pytest.mark.parametrize("page", MALFORMED)
def test_text_WHEN_page_is_malformed_SHOULD_be_that_of_the_standard_parser(page):
    plain = Plain()
    plain.feed(page)
    plain.close()
    assert by_lines(page_text(page)) == by_lines("".join(plain.parts))


def test_text_WHEN_made_of_random_markup_SHOULD_be_that_of_the_standard_parser():
    draw, parts = random.Random(7), ["<p>", "</p>", "<b a='1'>", "< ", "<3", "> ", "word ", "a&amp;b ", "<a href=\"x>y\">", "</ q>", "<!-- c > -->", "<!x>", "<?y?>", "it's ", "\"q\" ", "<br/>", "= ", "<li x = y>", "1 < 2 > 1 ", "<td a='\"'>"]
    for _ in range(3_000):
        page = "".join(draw.choices(parts, k=draw.randint(1, 12))) + "<p>end"
        plain = Plain()
        plain.feed(page)
        plain.close()
        assert by_lines(page_text(page)) == by_lines("".join(plain.parts)), page


def test_facts_WHEN_elements_are_custom_SHOULD_not_be_read_as_known_ones():
    facts = page_facts("<title-x>no</title-x><title>t</title><template-x><a href=/l>l</a></template-x><a-b href=/no>n</a-b>", "")
    assert facts["title"] == "t" and facts["links"] == ["/l"]


def test_text_WHEN_elements_stay_open_SHOULD_be_read_in_linear_time():
    assert page_text("<svg><desc>" * 30_000) == page_text("<head><title>" * 30_000) == page_text("<head>" * 30_000) == ""


def test_records_WHEN_derived_SHOULD_link_to_the_response():
    payload = PAGE.encode()
    rows = derive("<urn:uuid:1>", "https://h.com/", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nX-A: b: c\r\nSet-Cookie: 1\r\nSet-Cookie: 2", payload)
    sha = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert [r["record_type"] for r in rows] == ["metadata", "conversion"] and {r["refers_to"] for r in rows} == {"<urn:uuid:1>"} and {r["source_payload_digest"] for r in rows} == {sha}
    facts = json.loads(rows[0]["block"])
    assert facts["response"] == {"status": "HTTP/1.1 200 OK", "headers": [["X-A", "b: c"], ["Set-Cookie", "1"], ["Set-Cookie", "2"]]}
    for data in (b"".join(map(warc_record, rows)), b"".join(gzip.compress(warc_record(r)) for r in rows)):
        read = list(read_records(data))
        assert [b for _, b in read] == [r["block"] for r in rows]
        assert all(h["WARC-Refers-To"] == "<urn:uuid:1>" and h["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode() for h, b in read)
    assert derive("<urn:uuid:1>", "u", "d", "", payload)[0]["record_id"] == rows[0]["record_id"] != rows[1]["record_id"]


def test_rows_WHEN_odd_SHOULD_have_two_records_each(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", PAGE), (2, None, None), (None, "", ""), (3, "http://[bad", "<a href='//[x'>é</a>"), (1, "http://a.com/", PAGE)], "page_id long, url string, html string")
    out = derivatives(page_responses(pages, "2024-01-01T00:00:00Z"), keep=("page_id",))
    rows = out.collect()
    assert len(rows) == 10 and all(r.content_length == len(r.block) for r in rows) and len({r.record_id for r in rows}) == 8
    files = write_warc(out).collect()
    assert sum(f.n_records for f in files) == 10
    read = [x for f in files for x in read_records(open(f.file.removeprefix("file://"), "rb").read())]
    assert sorted(h["WARC-Record-ID"] for h, _ in read) == sorted(r.record_id for r in rows)
    assert derivatives(page_responses(pages.limit(0), "d")).count() == 0


class Plain(html.parser.HTMLParser):
    """Text, title, metas and links of a well-formed page by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.in_title, self.parts, self.title, self.metas, self.links = [], False, [], [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "template", "svg", "head"):
            self.hidden.append(tag)
        self.in_title = tag == "title"
        if tag in BLOCKS:
            self.parts.append("\n")
        own = {k: v or "" for k, v in attrs}
        if tag == "meta":
            self.metas.append(own)
        elif tag == "a" and "href" in own:
            self.links.append(own["href"])

    def handle_endtag(self, tag):
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()
        self.in_title = False
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self.parts.append(data.replace("\n", " ").replace("\r", " "))


def by_lines(text):
    return [" ".join(x.split()) for x in text.split("\n") if x.split()]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_pages_WHEN_read_by_the_standard_parser_SHOULD_have_the_same_text_title_and_links(spark):
    for page in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        plain = Plain()
        plain.feed(page.html)
        plain.close()
        facts = page_facts(page.html, "")
        assert by_lines(page_text(page.html)) == by_lines("".join(plain.parts)), page.page_id
        assert facts["title"] == " ".join("".join(plain.title).split()) and facts["links"] == plain.links and len(facts["metas"]) == len(plain.metas)


@pytest.mark.parametrize("part", ["<script ", "<title ", "<svg ", "<head ", "<a \"<a \"", "</script ", "<!-", "<a x='", "<a x=\"'", "<a =", "<a x= ", "<p a='\"' b=\"", "</", "<?", "x=\"", "< "])
@pytest.mark.parametrize("end", ["", ">", "/>", "'>"])
def test_pages_WHEN_hostile_SHOULD_take_linear_time(part, end):
    page, began = part * (1_000_000 // len(part)) + end, time.time()
    page_text(page)
    page_facts(page, "http://a.com/")
    assert time.time() - began < 10


def test_page_WHEN_ten_megabytes_of_open_tags_SHOULD_be_text_at_once():
    page, began = "<script " * 1_310_720, time.time()
    assert page_text(page) == page.strip() and time.time() - began < 2


def test_files_WHEN_headers_have_line_breaks_or_nulls_SHOULD_be_read_record_by_record(spark, tmp_path):
    rows = derive("<urn:uuid:9>", "http://a.com/x\r\nWARC-Type: evil\r\n\r\n", None, "", b"<p>t")
    response = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:9>\r\nContent-Length: 24\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody!\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(b"".join(map(warc_record, rows)))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(response) + b"".join(gzip.compress(warc_record(r)) for r in rows))
    got = read_warc(spark, [f"file://{tmp_path}/a.warc", f"file://{tmp_path}/b.warc.gz"])
    assert sorted(r.record_type for r in got.collect()) == ["conversion", "conversion", "metadata", "metadata", "response"]
    [own] = got.filter("record_type = 'response'").collect()
    assert own.http_headers == "HTTP/1.1 200 OK" and bytes(own.payload) == b"body!"
    assert {(r.target_uri, r.date) for r in got.filter("record_type <> 'response'").collect()} == {("http://a.com/x WARC-Type: evil", "")}
    assert derivatives(got.filter("record_type = 'response'")).count() == 2 and read_warc(spark, []).count() == 0
