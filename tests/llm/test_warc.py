"""Archives against plain parsing, and the page query against SQL."""

import base64
import gzip
import hashlib

import pytest

from gridpanel.llm import warc
from gridpanel.llm.queries import ORACLES, QUERIES
from gridpanel.session import ship_package
from tests.conftest import SF

SCHEMA = "page_id long, url string, html string, digest string, part int"


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def by_hand(rows):
    first = {}
    for i, _, html, *_ in rows:
        first.setdefault(html or "", []).append(i)
    out = []
    for text, ids in first.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        for k, i in enumerate(sorted(ids, key=lambda x: (x is None, x or 0))):
            data = text.encode()
            out.append((i, len(data), b32(data), "response" if k == 0 else "revisit", None if k == 0 else keep))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [300, 64 << 20])
def test_pages_through_archives(spark, size):
    ship_package(spark)
    tricky = "WARC/1.0\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n\nfiledesc://x 1 2 3 4\n"
    texts = ["", None, tricky, "é😀" * 3, "x" * 3_000_000, "\r\n\r\n", "dup", "dup", "dup", "last\n"]
    rows = [(i, f"http://h/{i}", t, "own", 9) for i, t in enumerate(texts)]
    rows += [(3, None, "dup", "own", 9), (2, " \n ", "dup", "own", 9), (11, "no scheme é\x01", "z", "", 0), (None, "http://n", "z", "", 0), (None, "", "none", "", 0), (7, "http://h/7", "dup", "own", 9)]
    told = warc.through_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), archive_bytes=size)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r[n] for n in names) for r in told.collect()), key=repr) == by_hand(rows)
    urls = {r["page_id"]: r["url"] for r in told.where("page_id = 11 OR page_id = 1").collect()}
    assert urls == {11: "no%20scheme%20%C3%A9%01", 1: "http://h/1"}


def test_no_pages(spark):
    ship_package(spark)
    assert warc.through_archives(spark.createDataFrame([], SCHEMA)).count() == 0


V1 = b"1 0 Old\nURL IP-address Archive-date Content-type Archive-length\n"
V2 = b"2 0 Old\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"


def old(version, records):
    block, middle = (V1, b"") if version == 1 else (V2, b" 200 - - 0 old.arc")
    head = b"filedesc://old.arc 0.0.0.0 1999 text/plain" + middle + b" %d\n" % len(block) + block
    parts = [head, *[u + b" 10.0.0.1 " + d + b" " + m + (b" 200 - - 5 old.arc" if version == 2 else b"") + b" %d\n" % len(b) + b for u, d, m, b in records]]
    return parts


RECORDS = [
    (b"http://a/x y", b"20010203", b"text/html", b"HTTP/1.0 200 OK\nA: b\n\nbody\n"),
    (b"dns:a.org", b"19991231235958", b"text/dns", b"a.org 1 IN A 10.0.0.1"),
    (b"http://b/", b"200102030405", b"image/gif", b"HTTP/1.1 200 OK\r\n\r\n\xff\xfe\x00\r\n\r\nGIF"),
]


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("pack", ["plain", "whole", "members"])
def test_foreign_archives(version, pack):
    parts = [p + b"\n" for p in old(version, RECORDS)]
    data = {"plain": b"".join(parts), "whole": gzip.compress(b"".join(parts)), "members": b"".join(map(gzip.compress, parts))}[pack]
    records = list(warc.arc_records(data))
    assert [r[1] for r in records] == [version] * 4
    assert [r[0] for r in records] == [sum(map(len, parts[:i])) for i in range(4)]
    assert [r[2]["URL"] for r in records[1:]] == ["http://a/x y", "dns:a.org", "http://b/"]
    assert [r[3] for r in records[1:]] == [b for *_, b in RECORDS]
    made = b"".join(r + b"\r\n\r\n" for r in warc.converted("p/old.arc", data, {records[3][0]: {"id": "<urn:x>", "url": "http://a/", "date": "d"}}))
    back = list(warc.warc_records(made))
    assert [f["warc-type"] for f, _ in back] == ["warcinfo", "response", "resource", "revisit"]
    assert [f["warc-date"] for f, _ in back] == ["1999-01-01T00:00:00Z", "2001-02-03T00:00:00Z", "1999-12-31T23:59:58Z", "2001-02-03T04:05:00Z"]
    assert back[1][0]["warc-payload-digest"] == "sha1:" + b32(b"body\n") and back[2][0]["warc-block-digest"] == "sha1:" + b32(RECORDS[1][3])
    assert back[3][0]["warc-payload-digest"] == "sha1:" + b32(b"\xff\xfe\x00\r\n\r\nGIF") and back[3][1] == b"HTTP/1.1 200 OK\r\n\r\n"
    assert len({f["warc-record-id"] for f, _ in back}) == 4 and back[1][0]["warc-warcinfo-id"] == back[0][0]["warc-record-id"]


def test_bytes_that_are_no_text_survive_the_writer(spark, tmp_path):
    ship_package(spark)
    (tmp_path / "arc" / "archive=one").mkdir(parents=True)
    (tmp_path / "arc" / "archive=one" / "part-0.arc.gz").write_bytes(gzip.compress(b"".join(p + b"\n" for p in old(2, RECORDS))))
    folder = warc.convert(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc")
    told = {r["url"]: r for r in warc.read_warc(spark, folder).collect()}
    assert told["http://b/"]["payload_digest"] == b32(b"\xff\xfe\x00\r\n\r\nGIF") and told["http://b/"]["payload_bytes"] == 10
    (file,) = (tmp_path / "warc").rglob("part-*")
    assert gzip.decompress(file.read_bytes()).startswith(b"WARC/1.0\r\nWARC-Type: warcinfo\r\n")


def test_broken_archives_raise():
    whole = b"".join(p + b"\n" for p in old(1, RECORDS))
    with pytest.raises(ValueError, match="ends"):
        list(warc.arc_records(whole[:-8]))
    with pytest.raises(ValueError, match="version block"):
        list(warc.arc_records(whole[whole.index(b"http://a") :]))
    with pytest.raises(ValueError, match="unknown"):
        list(warc.arc_records(whole.replace(b"Archive-date", b"Some-date")))
    with pytest.raises(ValueError, match="no archive date"):
        warc.warc_date("19x9")


def test_query_equals_its_sql(spark, duck):
    df = QUERIES["op12_warc"](spark, SF)
    names = sorted(df.columns)
    left = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    pages = f"WITH pages AS (SELECT * FROM read_parquet('{SF}/pages.parquet')), "
    result = duck.execute(pages + ORACLES["op12_warc"].strip().removeprefix("WITH "))
    order = [[d[0] for d in result.description].index(n) for n in names]
    assert left == sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)
