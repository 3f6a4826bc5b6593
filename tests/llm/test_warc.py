import base64
import gzip
import hashlib
import json
from html.parser import HTMLParser

import pytest

from boxframe.llm import warc

PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><meta name=author content='A &amp; B'>
<title> A  title &amp; more </title><style>p{margin:0}</style><script src="/s.js">var t="</p>";</script></head>
<body><!-- no <p> here --><div>One<br>two &lt;three&gt;</div><a href="../x?a=1&amp;b=2">link</a> tail
<img src=i.png alt="a > b"><p>1 < 2 and 3 > 2</p><p title="q>r">last"""


class Reader(HTMLParser):
    def __init__(self):
        super().__init__()
        self.text, self.links, self.skip = [], [], 0

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        self.skip += tag in ("script", "style", "title")
        if tag == "a" and at.get("href"):
            self.links.append(at["href"])

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "http://a.example/d/e/f", PAGE), (2, None, PAGE), (3, "http://b.example/", None),
        (None, "x", ""), (4, "http://c.example/\r\nX: y", "<p" + "a" * 200_000), (1, "http://a.example/d/e/f", PAGE),
        (5, "http://[bad", '<a href="//[x">k</a>' + "<b>" * 50_000),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'own' as content", "'own' as headers"
    )


def test_page_is_read():
    page = warc.read_page(PAGE, "http://a.example/d/e/f")
    assert page["title"] == "A title & more"
    assert page["metas"] == [{"charset": "utf-8"}, {"name": "author", "content": "A & B"}]
    assert [link["url"] for link in page["links"]] == [
        "http://a.example/s.js", "http://a.example/d/x?a=1&b=2", "http://a.example/d/e/i.png",
    ]
    assert page["text"] == "One\ntwo <three>\nlink tail\n1 < 2 and 3 > 2\nlast"


def test_words_equal_a_plain_parser(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in rows:
        plain = Reader()
        plain.feed(r.html)
        page = warc.read_page(r.html, None)
        assert "".join(page["text"].split()) == "".join("".join(plain.text).split())
        assert [x["url"] for x in page["links"] if x["path"] == "a@href"] == plain.links


def test_records_refer_and_digest(pages):
    sources = {r.record_id: r for r in warc.responses(pages).collect()}
    made = warc.derivatives(warc.responses(pages)).collect()
    assert len(made) == 2 * 7 and len(sources) == 6
    for r in made:
        source = sources[r.refers_to]
        assert (r.page_id, r.target_uri, r.date) == (source.page_id, source.target_uri, source.date)
        sha = base64.b32encode(hashlib.sha1(bytes(r.content)).digest()).decode()
        assert r.block_digest == f"sha1:{sha}" and r.content_length == len(r.content)
        assert r.payload_digest == source.payload_digest
        assert "\nX: y" not in r.headers
        if r.record_type == "metadata":
            envelope = json.loads(bytes(r.content))["Envelope"]
            assert envelope["Block-Digest"] == source.block_digest
            assert envelope["WARC-Header-Metadata"]["WARC-Record-ID"] == r.refers_to
            assert envelope["Payload-Metadata"]["Digest-Matches"]
    assert len({r.record_id for r in made}) == 12


def test_round_trip_of_files(pages):
    records = warc.responses(pages).unionByName(warc.derivatives(warc.responses(pages)))
    members = [bytes(r.member) for r in warc.packed(records).collect()]
    rows = records.collect()
    parsed = list(warc.parse(gzip.decompress(b"".join(members))))
    assert [(f["WARC-Record-ID"], c) for f, c in parsed] == [(r.record_id, bytes(r.content)) for r in rows]
    for fields, content in parsed:
        assert warc.digest(content) == fields["WARC-Block-Digest"]


def test_empty_table(pages):
    assert warc.derivatives(warc.responses(pages.where("false"))).collect() == []
