"""The archive converter against hand-made archives of both versions and a brute-force reading of its output."""

import collections
import gzip
import hashlib
import io

import pytest

from gridloom.llm import warc

V1 = b"1 0 crawler\nURL IP-address Archive-date Content-type Archive-length\n\n"
V2 = b"2 0 crawler\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n\n"


def arc1(url, date, mime, block):
    return b"%s 1.2.3.4 %s %s %d\n%s\n" % (url, date, mime, len(block), block)


def arc2(url, date, mime, block):
    return b"%s 1.2.3.4 %s %s 200 - - 0 a.arc %d\n%s\n" % (url, date, mime, len(block), block)


PAGE = b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\n<p>line\nhttp://fake.example/ 1.2.3.4 20000101000000 text/html 9\n\r\n\r\nmore</p>" + b"x" * 120
ONE = [
    arc1(b"filedesc://a.arc", b"20010203040506", b"text/plain", V1), arc1(b"http://a.example/with space", b"200102030405", b"text/html", PAGE), arc1(b"dns:a.example", b"20010203040506", b"text/dns", b"a.example IN A 1.2.3.4\n"),
    arc1(b"http://a.example/empty", b"20011399000000", b"text/html", b""), b"no header at all\nnor this\n", arc1(b"http://b.example/", b"20010203040507", b"text/html", PAGE.replace(b": 7", b": 3")),
]
TWO = [arc2(b"filedesc://b.arc", b"20010203040506", b"text/plain", V2), arc2(b"http://c.example/", b"20010203040506", b"text/html", b"HTTP/1.0 200 OK\r\n\r\nhello\n"), arc2(b"http://c.example/cut", b"20010203040506", b"text/html", PAGE)[:-40]]


def parse_warc(data):
    """Records of one file by their declared lengths."""
    f, out = io.BytesIO(data), []
    while line := f.readline():
        assert line == b"WARC/1.1\r\n"
        head = {}
        while (line := f.readline()) != b"\r\n":
            k, v = line.decode().rstrip("\r\n").split(": ", 1)
            head[k] = v
        block = f.read(int(head["Content-Length"]))
        assert f.read(4) == b"\r\n\r\n"
        out.append((head, block))
    return out


@pytest.fixture(scope="module")
def archives(tmp_path_factory):
    d = tmp_path_factory.mktemp("arc")
    (d / "one.arc.gz").write_bytes(b"".join(gzip.compress(r) for r in ONE))  # a member a record, as crawlers write them
    (d / "two.arc").write_bytes(b"".join(TWO))
    return str(d)


def test_header_lines_of_both_versions(spark, archives):
    got = {(r["archive"], r["url"]): r for r in warc.read_arc(spark, archives).collect()}
    assert len(got) == 9
    a, cut = got["one.arc.gz", "http://a.example/with space"], got["two.arc", "http://c.example/cut"]
    assert (a["version"], a["ip"], a["date"], bytes(a["head"]) + bytes(a["payload"]), a["problem"]) == (1, "1.2.3.4", "200102030405", PAGE, None)
    assert cut["problem"] == "short" and got["two.arc", "http://c.example/"]["version"] == 2 and bytes(got["two.arc", "http://c.example/"]["payload"]) == b"hello\n"
    junk = got["one.arc.gz", None]
    assert junk["problem"] == "header" and bytes(junk["payload"]) == b"no header at all\nnor this\n"
    whole = b"".join(ONE)
    assert all(whole[r["offset"] :].startswith((r["url"] or "no header").encode()) for r in got.values() if r["archive"] == "one.arc.gz")


def test_converted_records(spark, archives, tmp_path):
    warc.convert(spark, archives, str(tmp_path / "w"))
    found = [r for p in sorted((tmp_path / "w").glob("*.gz")) for r in parse_warc(gzip.decompress(p.read_bytes()))]
    by = {h.get("WARC-Target-URI", h.get("WARC-Filename")): (h, b) for h, b in found}
    assert len(found) == 8 and len({h["WARC-Record-ID"] for h, _ in found}) == 8
    for h, b in found:
        assert h["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(b).hexdigest()
    first, again = by["http://b.example/"], by["http://a.example/with space"]  # the smaller page id stays
    assert first[0]["WARC-Type"] == "response" and first[1] == PAGE.replace(b": 7", b": 3") and first[0]["WARC-Date"] == "2001-02-03T04:05:07Z"
    assert again[0]["WARC-Type"] == "revisit" and again[0]["WARC-Refers-To"] == first[0]["WARC-Record-ID"] and again[1] == b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\n"
    assert again[0]["WARC-Date"] == "2001-02-03T04:05:00Z" and again[0]["WARC-Payload-Digest"] == first[0]["WARC-Payload-Digest"]
    assert by["dns:a.example"][0]["WARC-Type"] == "resource" and by["dns:a.example"][0]["Content-Type"] == "text/dns"
    assert by["one.arc.gz"][0]["WARC-Type"] == "warcinfo" and by["one.arc.gz"][1] == V1
    assert by["http://a.example/empty"][0]["WARC-Date"] == "1970-01-01T00:00:00Z" and by["http://a.example/empty"][1] == b""
    assert by["http://c.example/cut"][0]["WARC-Truncated"] == "unspecified" and by["http://c.example/cut"][0]["WARC-Type"] == "response"
    read = {r["record_id"]: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert {(h["WARC-Record-ID"], b) for h, b in found} == {(k, bytes(r["head"]) + bytes(r["payload"])) for k, r in read.items()}


def test_pages_edge(spark):
    big = "<p>ä\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "y" * 100_000 + "</p>"
    rows = [
        (1, "http://a/ b\n", "z" * 100), (2, None, "z" * 100), (2, "http://c", "z" * 100), (3, "http://d", "z" * 99), (4, "http://e", "z" * 99), (5, "", None), (6, "http://f", ""), (None, "http://g", big), (9, "http://h", big),
        (8, "http://i", big), (None, "http://j", "é" * 50), (11, "http://k", "﻿\x00\n"), (-4, "http://l", "n" * 100),
    ]
    df = spark.createDataFrame([(*r, "clash", 7, "x") for r in rows], "page_id long, url string, html string, digest string, size int, type string")
    groups = collections.defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    want = []
    for h, ids in groups.items():
        b = h.encode()
        ids.sort(key=lambda i: (i is None, i))
        for k, i in enumerate(ids):
            again = k > 0 and len(b) >= 100
            want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    got = [tuple(r) for r in warc.archive_pages(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_many_copies_of_one_page(spark):
    df = spark.range(6000).selectExpr("id as page_id", "concat('http://h/', id) as url", "case when id % 3 = 0 then repeat('same ', 40) else concat(repeat('own ', 40), id) end as html")
    got = warc.archive_pages(df)
    assert got.where("record_type = 'revisit' and refers_to = 0").count() == 1999 and got.where("record_type = 'response'").count() == 4001


def test_against_sql(spark):
    import os

    import duckdb

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    assert sorted(map(tuple, warc.op11_warc(spark, sf).collect())) == sorted(c.sql(warc.OP11_SQL).fetchall())
