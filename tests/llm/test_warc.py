from collections import defaultdict
from hashlib import sha1

import pytest

from roadweave.llm.warc import Record, WarcError, encode_archive, page_record, digest_value, read_archive, read_archives, write_archives


def expected(rows):
    tops = defaultdict(list)
    for i, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 1000 and i is not None:
            tops[raw].append(i)
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        top = max(tops.get(raw, []), default=None)
        refers = top if top is not None and top != i else None
        out.append((i, len(raw), sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def round_trip(spark, df, **more):
    folder, manifest = write_archives(df, **more)
    got = read_archives(spark, folder).collect()
    assert sum(r.records for r in manifest.collect()) == len(got)
    return got


def digests(got):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    got = round_trip(spark, pages, archive_bytes=200_000)
    assert digests(got) == expected(rows)
    html = {i: (u, h) for i, u, h in rows}
    for r in got:
        if r.record_type == "response":
            assert r.payload.decode() == html[r.page_id][1] and r.url == html[r.page_id][0]


def test_odd_rows(spark):
    big, other = "ß<p>" * 400, "x" * 999
    rows = [
        (1, "http://a/\r\nX: y", big), (2, None, big), (2, None, big), (None, "http://n/", big), (3, "http://b/", other), (4, "http://b/", other),
        (5, "", None), (6, "http://c/", ""), (7, "http://d/", "HTTP\r\n\r\n" * 300), (None, None, None), (8, "http://e/", "y" * 3_000_000),
    ]
    df = spark.createDataFrame([r + (1, "s") for r in rows], "page_id long, url string, html string, n long, digest string").repartition(3)
    got = round_trip(spark, df)
    assert digests(got) == expected(rows)
    only_null = spark.createDataFrame([(None, None, big), (None, None, big)], "page_id long, url string, html string")
    assert [r.record_type for r in round_trip(spark, only_null)] == ["response"] * 2
    assert round_trip(spark, df.limit(0)) == []


def archive(n=300):
    pages = [f"<html><body>page {i} {'common words ' * 20}{i * i}</body></html>".encode() for i in range(n)]
    return encode_archive([page_record(i, f"http://h/{i}", p, digest_value(p), None, "2024-01-01T00:00:00Z") for i, p in enumerate(pages)])


def test_archive_has_dictionary_and_one_frame_each():
    raw = archive()
    assert raw[:4] == b"\x5d\x2a\x4d\x18"
    records = list(read_archive(raw))
    assert len(records) == 300 and all(isinstance(r, Record) for r in records)
    plain = list(read_archive(archive(1)))
    assert len(plain) == 1 and isinstance(plain[0], Record)


def test_damage_is_found():
    raw = archive()
    good = [r.headers["warc-record-id"] for r in read_archive(raw)]
    for at in range(40, len(raw), 997):
        bad = bytearray(raw)
        bad[at] ^= 0x41
        found = list(read_archive(bytes(bad)))
        assert any(isinstance(r, WarcError) for r in found) or [r.headers["warc-record-id"] for r in found] == good
    assert isinstance(list(read_archive(raw[:-3]))[-1], WarcError)
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n"
    for body in (
        b"WARC/9\r\n\r\n", head + b"Content-Length: 3\r\n\r\nabcd\r\n\r\n", head + b"Content-Length: x\r\n\r\nabcd\r\n\r\n", head + b"\r\nabc\r\n\r\n",
        head + b"bad line\r\nContent-Length: 0\r\n\r\n\r\n\r\n", head + b"WARC-Block-Digest: " + digest_value(b"z").encode() + b"\r\nContent-Length: 1\r\n\r\na\r\n\r\n",
    ):
        assert isinstance(list(read_archive(encode_archive([body])))[0], WarcError)


def test_strict_and_lenient_reading(spark, tmp_path):
    raw = archive(20)
    (tmp_path / "x.warc.zst").write_bytes(raw[:-1] + bytes([raw[-1] ^ 1]))
    rows = read_archives(spark, str(tmp_path), strict=False).collect()
    assert len(rows) == 20 and sum(r.error is not None for r in rows) == 1
    with pytest.raises(Exception, match="frame"):
        read_archives(spark, str(tmp_path)).collect()
