"""WARC runs with hostile URLs, merges in passes, digests of what was read."""

from __future__ import annotations

import base64
import hashlib
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colocus.llm import warc
from colocus.llm.common import saved, shared_folder

HOSTILE = ["http://[foo/bar", "http://a b/c d", "x\x0by\x0cz\x85", "http://a b/\r\nWARC-Type: x", "\x00", " ", "#", "//", "http://", "HTTP://U:P@Ex.org:443/Q?x=1#f", "é://ü/ß İ", "http://a/\x1c\x1d\x1e", "://", "?q", "http://h?q", "a" * 5000]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet=string.printable + "  \x85\x1c[]")))
def test_any_string_has_a_key_of_one_line(url):
    key = warc.url_key(url)
    assert len(f"{key} 1".splitlines()) == 1 and len(f"{key} 1".split()) == 2 or key == ""
    assert "\n" not in warc.one_line(url) and warc.url_key(url) == key


def test_keys():
    assert warc.url_key("http://User@www.Example.org:80/A b?C#d") == "org,example,www)/a%20b?c"
    assert warc.url_key("https://h:8080") == "h:8080)/" and warc.url_key("http://h?q") == "h)/?q"
    assert warc.url_key(None) == ")/" and warc.url_key("x") == ")x"


def pages_of(spark):
    urls = [*HOSTILE, None, "", *[f"http://h{i % 7}.example/p{i}" for i in range(150)]]
    rows = [(i if i % 11 else None, u, None if i % 5 == 0 else f"page {i % 40}", "x") for i, u in enumerate(urls)]
    rows += rows[20:30]  # repeated rows
    return spark.createDataFrame(rows, "page_id long, url string, html string, run string"), rows


@pytest.mark.parametrize("fan_in,rows_each", [(64, 1000), (64, 10), (3, 20), (2, 7)])
def test_hostile_urls_through_write_merge_and_read(spark, fan_in, rows_each, monkeypatch):
    monkeypatch.setattr(warc, "STRIDE", 4)
    pages, rows = pages_of(spark)
    folder = shared_folder(spark, "w")
    manifest = saved(warc.write_runs(pages.repartition(9), folder), f"{folder}/manifest")
    index = saved(warc.merge_index(manifest, f"{folder}/index", rows_each, fan_in), f"{folder}/merged")
    got = sorted(index.collect(), key=lambda r: (r.range, r.place))
    places = [(r.url_key, r.seconds, -1 if r.page_id is None else r.page_id) for r in got]
    assert len(got) == len(rows) and places == sorted(places)
    assert sorted(places) == sorted((warc.url_key(u) if u else "", i or 0, -1 if i is None else i) for i, u, _, _ in rows)
    back = warc.read_captures(index).collect()
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)

    def expected(i, u, h):
        b = (h or "").encode()
        revisit = (h or "") in first and first[h or ""] != i
        return (i, None if u is None else warc.one_line(u), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None)

    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=key) == sorted((expected(i, u, h) for i, u, h, _ in rows), key=key)
    assert all(r.payload == next((h or "") for i, _, h, _ in rows if i == r.page_id and len((h or "")) == r.payload_bytes).encode() for r in back if r.record_type == "response" and r.page_id is not None)


def test_no_pages(spark):
    folder = shared_folder(spark, "w")
    manifest = saved(warc.write_runs(pages_of(spark)[0].limit(0), folder), f"{folder}/manifest")
    assert warc.read_captures(warc.merge_index(manifest, f"{folder}/index")).count() == 0


def test_a_payload_that_changed_is_found(spark):
    record = warc.build_record(1, "http://a", "2020-01-01T00:00:00Z", b"payload", None, False)
    folder = shared_folder(spark, "w")
    pages = spark.createDataFrame([(1, "http://a", "payload")], "page_id long, url string, html string")
    manifest = saved(warc.write_runs(pages, folder), f"{folder}/manifest")
    index = saved(warc.merge_index(manifest, f"{folder}/index"), f"{folder}/merged")
    assert warc.read_captures(index).first().payload == b"payload"
    import zlib

    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    forged = z.compress(zlib.decompress(record, 31).replace(b"payload\r\n", b"paylord\r\n")) + z.flush()
    where = index.first().run
    warc.put_file(f"{where}.warc.gz", forged)
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="not what its headers say"):
        warc.read_captures(index.withColumn("length", F.lit(len(forged)).cast("long"))).collect()
