import base64
import glob
import gzip
import hashlib
import html
import json

import pytest
from pyspark.sql import functions as F

from kerbline.llm import warc

PAGES = [
    (1, "http://a.example/x?y=1", '<!DOCTYPE html><html><head><title>Caf&eacute; &amp; <b>co</b></title><style>p{}</style><script>var t="</p>";</script></head>'
        '<body><!-- <a href="no"> --><h1>Head</h1><p>One&nbsp;two<br>three <i>it</i>alic</p><a href="/l?a=1&amp;b=2">link</a><IMG class="c" SRC=\'i.png\'><p>&#8364; &#x1F600; &bogus; &#0; &amp;lt;</p></body></html>'),
    (2, None, "plain < text > 3 & 4"),
    (3, "http://b.example", None),
    (4, "http://c.example", ""),
    (5, "http://d.example", "<p>open<script>never closed <p>gone"),
    (1, "http://a.example/x?y=1", "<p>again</p>"),
    (6, "http://é.example", "<p>" + "lang " * 30_000 + "</p>"),
    (7, "u", "a<br/>b<td>c</td>\r\n  d\t e"),
]


def sha1(data: str) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data.encode()).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


@pytest.fixture(scope="module")
def derived(pages):
    return warc.derive(warc.responses(pages, "2025-01-01T00:00:00Z"))


@pytest.fixture(scope="module")
def rows(derived):
    return sorted((r.asDict() for r in derived.collect()), key=lambda r: (r["page_id"], r["payload_digest"]))


def test_digests_and_links_between_records(rows):
    assert len(rows) == len(PAGES)
    payloads = {sha1(h or "") for _, _, h in PAGES}
    for r in rows:
        assert r["payload_digest"] in payloads
        assert r["metadata_digest"] == sha1(r["metadata"]) and r["text_digest"] == sha1(r["text"])
        assert r["metadata_length"] == len(r["metadata"].encode()) and r["text_length"] == len(r["text"].encode())
        assert r["metadata_refers_to"] == r["conversion_refers_to"] == r["response_id"] == json.loads(r["metadata"])["refers_to"]
        assert len({r["response_id"], r["metadata_id"], r["conversion_id"]}) == 3
    assert len({r["response_id"] for r in rows}) == len(PAGES)
    page = next(r for r in rows if r["page_id"] == 4)
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 0\r\n\r\n"
    assert page["block_digest"] == sha1(head)


def test_text_title_and_links(rows):
    page = next(r for r in rows if r["page_id"] == 1 and "Head" in r["text"])
    assert page["text"] == "Café & co\nHead\nOne two\nthree italic\nlink\n€ \U0001f600 &bogus; &#0; &lt;"
    data = json.loads(page["metadata"])
    assert data["title"] == "Café & <b>co</b>" and data["target_uri"] == "http://a.example/x?y=1"
    assert data["links"] == [{"path": "A@/href", "url": "/l?a=1&amp;b=2"}, {"path": "IMG@/src", "url": "i.png"}] and page["n_links"] == 2
    assert data["headers"][0] == {"name": "Content-Type", "value": "text/html; charset=utf-8"}
    of = {r["page_id"]: r for r in rows if r["page_id"] != 1}
    assert of[2]["text"] == "plain < text > 3 & 4" and of[2]["target_uri"] is None
    assert of[3]["text"] == of[4]["text"] == "" and of[3]["n_links"] == 0 and "title" not in json.loads(of[3]["metadata"])
    assert of[5]["text"] == "open" and of[7]["text"] == "a\nb\nc\nd e"
    assert of[6]["text"].count("lang") == 30_000


def test_named_references_agree_with_the_standard(spark):
    names = spark.createDataFrame([(n, f"<p>&{n};</p>") for n in warc.NAMED], "n string, h string")
    for r in names.select("n", warc.plain_text(F.col("h")).alias("t")).collect():
        assert r["t"] == html.unescape(f"&{r['n']};").replace("\xa0", " ").strip() or r["n"] in ("nbsp", "amp")


def test_records_read_back_from_files(derived, rows, tmp_path):
    warc.write(derived, f"{tmp_path}/w")
    found = {}
    for path in glob.glob(f"{tmp_path}/w/*.gz"):
        data = gzip.open(path).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            n = int(fields["Content-Length"])
            assert lines[0] == "WARC/1.0" and rest[n:n + 4] == b"\r\n\r\n"
            found[fields["WARC-Record-ID"]] = (fields, rest[:n].decode())
            data = rest[n + 4:]
    assert len(found) == 2 * len(rows)
    for r in rows:
        fields, body = found[r["conversion_id"]]
        assert body == r["text"] and fields["WARC-Type"] == "conversion" and fields["WARC-Refers-To"] == r["response_id"]
        assert fields["WARC-Block-Digest"] == sha1(body) and fields["WARC-Source-Payload-Digest"] == r["payload_digest"]
        assert fields.get("WARC-Target-URI") == r["target_uri"]
        assert found[r["metadata_id"]][1] == r["metadata"]


def test_empty_table_and_other_columns(spark, pages):
    assert warc.derive(warc.responses(pages.limit(0), "d")).count() == 0
    wide = pages.withColumn("text", F.lit(1)).withColumn("payload", F.lit(2))
    assert warc.derive(warc.responses(wide, "d")).count() == len(PAGES)
