import base64
import gzip
import hashlib

import pytest

from folioscope.llm.common import shared_dir
from folioscope.llm.warc import coalesced_ranges, read_records, record_bytes, round_trip, write_archives

PAGES = "page_id long, url string, html string, digest string, file string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def pages(spark):
    rows = [(5, "http://a.org/é", "<p>é</p>"), (3, "http://b.org/", "<p>é</p>"), (4, None, None), (6, "http://c.org/\r\nX: y", ""), (7, "http://d.org", "x" * 2_000_000), (8, "http://e.org", "same"), (8, "http://e.org", "same"), (None, "http://f.org", "same"), (None, None, "only")]
    return rows, spark.createDataFrame([(*r, "own", "own") for r in rows], PAGES)


def test_round_trip(spark):
    rows, df = pages(spark)
    got = sorted((tuple(r) for r in round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    want = []
    for page_id, _, html in rows:
        own = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(own, default=None)
        revisit = first is not None and page_id != first
        want.append((page_id, len((html or "").encode()), digest(html), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)


def test_selected_records_are_read_by_range(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.org", f"page {i} " + "z" * (i % 7)) for i in range(300)], "page_id long, url string, html string")
    index = write_archives(df.coalesce(1), shared_dir(spark))
    assert index.selectExpr("sum(length)").first()[0] == index.groupBy("file").agg({"length": "sum"}).selectExpr("sum(`sum(length)`)").first()[0]
    some = index.where("page_id % 3 = 0")
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in read_records(some).collect()}
    assert got == {i: f"page {i} " + "z" * (i % 7) for i in range(0, 300, 3)}
    assert coalesced_ranges(some).count() < 20


def test_least_revisit(spark):
    df = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "longer"), (4, "u", "longer")], "page_id long, url string, html string")
    index = write_archives(df, shared_dir(spark), least_revisit=4)
    assert {r["page_id"]: r["record_type"] for r in index.collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_record_format():
    raw = gzip.decompress(record_bytes(7, "http://x.org/", b"hi", digest("hi"), None, False)).decode()
    head, _, block = raw.partition("\r\n\r\n")
    assert head.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and "WARC-Target-URI: http://x.org/" in head
    assert block.endswith("\r\n\r\nhi\r\n\r\n") and f"Content-Length: {len(block) - 4}" in head


def test_damage_is_found():
    from folioscope.llm.warc import parse_record

    with pytest.raises(ValueError, match="damaged"):
        parse_record(record_bytes(1, "u", b"hi", digest("other"), None, False))


def test_empty_table(spark):
    assert round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_urls_keep_their_blanks(spark):
    pages = spark.createDataFrame([(1, "http://a/b  c\td\r\ne", "x")], "page_id long, url string, html string")
    assert round_trip(pages).first()["url"] == "http://a/b  c\td e"
