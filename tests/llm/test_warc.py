import gzip
import hashlib
import io
from collections import defaultdict

import pytest
from pyarrow import fs

from civicsift.llm import warc
from civicsift.session import materialise, scratch_path

SCHEMA = "page_id long, url string, html string, digest string, payload string, key string"


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>é</p>" * 400
    rows = [(n, f"https://h{n % 5}.example.com/p/{n}?q=1", f"<html>{n}</html>") for n in range(40)]
    rows += [(n, f"http://Copy.net/{n}", long) for n in range(100, 130)]
    rows += [(200, None, None), (201, "", ""), (202, "no scheme\r\nX: y", "\r\n\r\n"), (203, "http://same/", "s" * 1000),
             (204, "http://same/", "s" * 1000), (204, "http://same/", "s" * 1000), (None, "http://same/", "s" * 1000),
             (205, "http://same/", "s" * 999), (206, "http://same/", "s" * 999), (207, "http://x.org/", "z" * 300_000)]
    return spark.createDataFrame([(*row, "clash", "clash", None) for row in rows], SCHEMA).repartition(3)


def expected(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row.html or ""].append(row.page_id)
    out = []
    for html, ids in groups.items():
        payload = html.encode()
        response = max((i for i in ids if i is not None), default=None) if len(payload) >= 1000 else None
        for number in ids:
            revisit = response is not None and number is not None and number != response
            out.append((str(number), len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response",
                        str(response) if revisit else "None"))
    return sorted(out)


def test_archives_read_back_as_written(pages, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    monkeypatch.setattr(warc, "FILE_BYTES", 2_000)
    got = warc.archive_and_read(pages).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == expected(pages.collect())
    html = {r.page_id: r.html or "" for r in pages.collect()}
    assert all(r.payload.decode() == html[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)


def test_empty_table(pages):
    assert warc.archive_and_read(pages.limit(0)).collect() == []


def test_archives_are_readable_by_any_gzip_reader(pages, spark):
    folder = scratch_path(spark, "warc-test")
    resolved = warc.resolve_revisits(pages, "page_id", "url", "html")
    captures = materialise(warc.write_archives(resolved, folder), "captures").collect()
    store, at = warc._store(folder)
    records = 0
    for info in store.get_file_info(fs.FileSelector(at)):
        with store.open_input_file(info.path) as file:
            raw = gzip.decompress(file.read())
        records += raw.count(b"WARC/1.1\r\n")
        stream = io.BytesIO(raw)
        while line := stream.readline():
            assert line == b"WARC/1.1\r\n"
            length = 0
            while (field := stream.readline()) != b"\r\n":
                length = int(field.split(b":")[1]) if field.startswith(b"Content-Length") else length
            stream.read(length)
            assert stream.read(4) == b"\r\n\r\n"
    assert records == len(captures) == pages.count()


def test_keys_sort_hosts_by_their_end(spark):
    urls = ["https://Blog.Example.com/a?b#c", "", "x/y", "http://a.b", "http://a/ \t"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    keys = [r.key for r in rows.select(warc.url_key(rows["url"]).alias("key")).collect()]
    assert keys == ["com,example,blog)/a?b#c", ")", ")x/y", "b,a)", "a)/%20%20"]
