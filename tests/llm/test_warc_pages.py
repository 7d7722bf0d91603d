"""WARC derivatives against an independent parser, hostile pages and odd headers."""

import json
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from lakework.llm import warc

SKIPPED = {"script", "style", "noscript", "template", "svg"}


class Plain(HTMLParser):
    """Text and links of a page by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.text, self.links, self.metas = 0, [], [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in SKIPPED
        attrs = dict(reversed(attrs))
        if tag in warc._LINKS and attrs.get(warc._LINKS[tag]) is not None:
            self.links.append(attrs[warc._LINKS[tag]])
        self.metas += tag == "meta"

    def handle_endtag(self, tag):
        self.depth -= tag in SKIPPED

    def handle_data(self, data):
        if not self.depth:
            self.text.append(data)


def test_all_pages_read_as_by_the_standard_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(pages) > 200
    for page in pages:
        plain = Plain()
        plain.feed(page["html"])
        plain.close()
        source = {"payload": page["html"], "record_id": "r", "target_uri": page["url"], "date": None, "http_headers": None}
        meta, text = (r["block"] for r in warc.derive(source))
        assert text.split() == "".join(plain.text).split() or "".join(text.split()) == "".join("".join(plain.text).split())
        found = json.loads(meta)["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]
        assert len(found["Links"]) == len(plain.links) and len(found["Metas"]) == plain.metas
        assert all(x["url"].endswith(link) or "?" in link or "." in link for x, link in zip(found["Links"], plain.links))


def test_short_ways_resolve_like_the_library():
    from urllib.parse import urljoin

    targets = ["http://h.org/d/e?q#f", "https://h.org", "http://h.org:80/x", "ftp://h.org/a", "http://[::1]/a", "//h.org/x", "", "HTTP://H.org/a", "http://h.org;x/y"]
    links = ["/a", "/a/b/", "/", "/a//b", "//c.org/x", "/a/../b", "/./a", "/a?b", "/a;b", "b", "", "#x", "/a b", "/ä", "/a.", "/.a", "/a/.", "mailto:x@y"]
    for target in targets:
        resolve = warc._resolver(target)
        for link in links:
            try:
                wanted = urljoin(target, link)
            except ValueError:
                wanted = link
            assert resolve(link) == wanted, (target, link)


def text_of(page):
    return warc.plain_text(warc.without_scripts(page))


def test_comments_that_close_at_once_and_loose_end_tags():
    assert text_of("<!-->x<p>y</p>") == "x\ny" and text_of("<!--->x<p>y</p>") == "x\ny"
    # What is left out leaves a space.
    assert text_of("a<!-- b --!>c") == "a c" and text_of("a<!-- b -> c -->d") == "a d" and text_of("a<!---->b") == "a b"
    assert text_of("<script>a</script b='1'>c</scripty>d") == "cd" and text_of("<style>p</style\n>x") == "x"
    assert text_of("<scripty>a</scripty>b") == "ab" and text_of("<script>a</scripty>b</script>c") == "c"
    assert warc.page_metadata("<titles>a</titles><title x='>'>b</title >c", None)["Title"] == "b"


HOSTILE = ["<title ", "<script ", "<!--", "<script>", "</script ", "<a href=", "<a href='", "<p \"", "<svg>", "&lt", "<title></title", "<!-- --", "< ", "<a/", "  \t"]


@pytest.mark.parametrize("piece", HOSTILE)
def test_work_grows_with_the_page(piece):
    def seconds(n):
        source = {"payload": piece * n, "record_id": "r", "target_uri": "http://h.org/", "date": None, "http_headers": None}
        best = 9e9
        for _ in range(3):
            start = time.perf_counter()
            warc.derive(source)
            best = min(best, time.perf_counter() - start)
        return best

    n = 400_000 // len(piece)
    assert seconds(4 * n) < 10 * seconds(n) + 0.02  # four times the page; sixteen times the work would be the square


def test_headers_that_repeat_and_break(spark):
    rows = [
        (1, "<urn:1>", "http://h.org/a\r\nWARC-Type: response\n", None, [("Set-Cookie", "a"), ("Set-Cookie", "b"), ("Server", "s")], "x", "h", 5),
        (2, "<urn:2>", "u", "2023-05-06T07:08:09Z", None, None, "h", 6), (2, "<urn:2>", "u", "2023-05-06T07:08:09Z", [], "", "h", 6),
    ]
    responses = spark.createDataFrame(
        rows, "k int, record_id string, target_uri string, date string, http_headers array<struct<name:string,value:string>>, payload string, headers string, content_length int"
    )
    out = warc.derive_records(responses, "k").orderBy("k", "warc_type").collect()
    assert len(out) == 6 and {r["headers"]["WARC-Date"] for r in out if r["k"] == 1} == {warc.DATE}
    assert {r["headers"]["WARC-Date"] for r in out if r["k"] == 2} == {"2023-05-06T07:08:09Z"}
    meta = next(r for r in out if r["k"] == 1 and r["warc_type"] == "metadata")
    assert json.loads(meta["block"])["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["Headers"] == {"Set-Cookie": ["a", "b"], "Server": "s"}
    head = warc.serialise(list(meta["headers"].items()), meta["block"].encode()).split(b"\r\n\r\n")[0].decode().split("\r\n")
    assert head[0] == "WARC/1.0" and len(head) == 1 + len(meta["headers"]) and "\n" not in "".join(head)
    assert meta["target_uri"] == rows[0][2]
    assert warc.derive_records(responses.withColumn("K_", F.lit(1)), "k", date="1999-01-01T00:00:00Z").where("headers['WARC-Date'] = '1999-01-01T00:00:00Z'").count() == 2


def test_every_record_of_the_query_has_a_date(spark, sf_dir):
    assert warc.op3_warc(spark, sf_dir).where("headers['WARC-Date'] IS NULL").isEmpty()
