import glob
import hashlib
import html
import re

import duckdb
import pandas as pd
import pytest

from twinsieve.llm import warc

DATE = "2024-01-01T00:00:00Z"
PAGES = [
    (1, "http://a/x", "<html><head><title>A &amp; B</title></head><body><h1>Hi</h1><p>One<br>two &lt;3 &#233;&#x1F600;&#0;&#xD800;</p><script>no()</script><!-- no --></body></html>"),
    (2, None, "plain"), (3, "http://b\r\nX-Bad: 1", None), (4, "u", ""), (4, "u", ""), (None, "v", "<p>unclosed <b>bold<p>next"),
    (5, "w", "<script>never closed"), (6, "y", "<!-- never closed"), (7, "z", "a < b &amp;lt; &nope; &#9999999; &#65;&#65;"), (8, "q", "x<a href=\"/l1\">t</a> <A class=k HREF=\"/l2\">u</A>"),
    (9, "r", "<p>" + "long & text " * 20_000 + "</p>"),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "'c' as title", "'c' as record_id", "'c' as text")


@pytest.fixture
def records(pages):
    return warc.derive(warc.responses_of_pages(pages, DATE), "page_id")


def parsed(record):
    head, _, block = record.partition("\r\n\r\n")
    first, *lines = head.split("\r\n")
    assert first == "WARC/1.1" and record.endswith("\r\n\r\n")
    return dict(x.split(": ", 1) for x in lines), block[:-4]


def test_records_are_linked_and_whole(records, pages):
    sources = {}
    for r in warc.responses_of_pages(pages, DATE).collect():
        sources[r.record_id] = r
    rows = records.collect()
    assert len(rows) == 2 * len(PAGES)
    conversions = {r.refers_to: r for r in rows if r.record_type == "conversion"}
    for r in rows:
        head, block = parsed(r.record)
        source = sources[r.refers_to]
        digest = "sha256:" + hashlib.sha256(block.encode()).hexdigest()
        assert head["WARC-Type"] == r.record_type and head["WARC-Record-ID"] == r.record_id and head["WARC-Refers-To"] == r.refers_to
        assert int(head["Content-Length"]) == r.content_length == len(block.encode())
        assert head["WARC-Block-Digest"] == r.block_digest == digest
        assert r.payload_digest == "sha256:" + hashlib.sha256(source.payload.encode()).hexdigest()
        assert head["WARC-Date"] == DATE and ("WARC-Target-URI" in head) == (r.target_uri is not None) and "X-Bad" not in head
        if r.record_type == "metadata":
            fields = [x.split(": ", 1) for x in block.split("\r\n") if x]
            named = dict(fields)
            assert named["conversion-id"] == conversions[r.refers_to].record_id and named["conversion-digest"] == conversions[r.refers_to].block_digest
            assert [v for k, v in fields if k == "http-header"] == source.http_header.strip().split("\r\n")
            assert named["source-payload-digest"] == r.payload_digest
            whole = source.http_header + "\r\n" + source.payload
            assert named["source-block-digest"] == "sha256:" + hashlib.sha256(whole.encode()).hexdigest()


def test_plain_text(records):
    texts = {r.page_id: parsed(r.record)[1] for r in records.collect() if r.record_type == "conversion"}
    assert texts[1] == "Hi\nOne\ntwo <3 é\U0001f600��"
    assert texts[2] == "plain" and texts[3] == texts[4] == texts[5] == texts[6] == ""
    assert texts[None] == "unclosed bold\nnext" and texts[7] == "a < b &lt; &nope; � AA" and texts[8] == "xt u"
    assert texts[9] == ("long & text " * 20_000).strip()


def test_titles_and_links(records):
    blocks = {r.page_id: parsed(r.record)[1] for r in records.collect() if r.record_type == "metadata"}
    assert blocks[1].startswith("title: A & B\r\n")
    assert re.findall("outlink: (.*)\r\n", blocks[8]) == ["/l1", "/l2"] and "outlinks: 2\r\n" in blocks[8]


def test_named_characters_are_right():
    assert all(html.unescape(f"&{name};").replace("\xa0", " ") == char for name, char in warc.NAMED.items())


def test_files_read_back(records, tmp_path):
    warc.write_warc(records.coalesce(2), str(tmp_path / "out"))
    written = "".join(open(f, encoding="utf-8", newline="").read() for f in glob.glob(str(tmp_path / "out/part-*")))
    assert len(written) == sum(len(r.record) for r in records.collect())
    assert sorted(re.findall("WARC-Record-ID: (.*)\r\n", written)) == sorted(r.record_id for r in records.collect())


def test_sql(spark, pages, sf):
    con = duckdb.connect()
    table = pd.concat([pages.select("page_id", "url", "html").toPandas().fillna({"page_id": -1}), spark.read.parquet(f"{sf}/pages.parquet").toPandas()])
    table["page_id"] = table["page_id"].astype("int64")
    table = table.astype(object).where(table.notna(), None).astype({"page_id": "int64"})
    con.register("pages", table)
    df = spark.createDataFrame(list(table.itertuples(index=False, name=None)), "page_id bigint, url string, html string")
    got = warc.page_derivatives(df, DATE)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({warc.page_derivatives_sql(DATE)})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_empty(spark):
    assert warc.page_derivatives(spark.createDataFrame([], "page_id bigint, url string, html string"), DATE).collect() == []
