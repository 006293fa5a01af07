import base64
import hashlib
import zlib
from collections import Counter

import pytest

from tallyweave.llm import common, warc


def pages(spark):
    big, small = "x" * 150, "y" * 99
    texts = [big, big, small, small, "", None, "é" * 50, "é" * 50, big, "<p>\r\n\r\nWARC/1.1\r\n\r\n" * 20]
    rows = [(k, f"http://a/{k}\r\nX: y", t) for k, t in enumerate(texts)] + [(None, None, big), (None, None, "only null" * 20), (None, "u", "only null" * 20), (1, "u", big)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS first")


def expected(rows):
    first = {}
    for i, _, t in rows:
        t = (t or "").encode()
        if len(t) >= 100 and i is not None:
            first[t] = min(first.get(t, i), i)
    out = Counter()
    for i, _, t in rows:
        t = (t or "").encode()
        revisit = t in first and i != first[t]
        out[(i, len(t), hashlib.sha256(t).hexdigest(), "revisit" if revisit else "response", first[t] if revisit else None)] += 1
    return out


def test_round_trip_by_ranges_of_any_size(spark):
    rows, df = pages(spark)
    files = warc.write(df.repartition(2), common.fresh_folder(spark, "warc"))
    for size in (1 << 20, 700, 101):
        got = warc.read(spark, files, size).collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(rows)
    payloads = Counter(bytes(r.payload).decode() for r in warc.read(spark, files, with_payload=True).collect() if r.payload is not None)
    assert payloads["é" * 50] == 1 and payloads[""] == 2
    assert all("%0D%0A" in r.url for r in got if r.page_id == 3)


def test_members_are_told_from_bytes_that_look_like_them(tmp_path):
    one = warc.record(1, "u", b"a" * 200, hashlib.sha256(b"a" * 200).hexdigest(), None, False)
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    other = press.compress(b"no record" * 50) + press.flush()
    path = tmp_path / "x.warc.gz"
    path.write_bytes(one + one)
    assert [len(list(warc.RangeReader(str(path), *r))) for r in ((0, 1), (1, len(one) + 1), (len(one) + 1, 2 * len(one)))] == [1, 1, 0]
    assert not warc._starts(other) and not warc._starts(b"\x1f\x8b\x08 junk") and warc._starts(one)


def member(headers, block):
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(head.encode() + block + b"\r\n\r\n") + press.flush()


def test_archives_of_other_writers(spark, tmp_path):
    body = b"<html>\r\n\r\nbody</html>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    records = [
        ({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:uuid:1>", "Content-Type": "application/warc-fields"}, b"software: x\r\n\r\nmore"),
        ({"WARC-Type": "request", "WARC-Record-ID": "<urn:uuid:2>", "Content-Type": "application/http; msgtype=request"}, b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        ({"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:3>", "WARC-Target-URI": "http://a/", "WARC-Payload-Digest": f"sha1:{sha1}", "Content-Type": "application/http; msgtype=response"}, http + body),
        ({"WARC-Type": "metadata", "WARC-Record-ID": "<urn:uuid:4>", "WARC-Refers-To": "<urn:uuid:3>"}, b""),
        ({"WARC-Type": "revisit", "WARC-Record-ID": "<urn:uuid:5>", "WARC-Refers-To": "<urn:uuid:3>", "WARC-Payload-Digest": f"sha1:{sha1}"}, b""),
        ({"WARC-Type": "resource", "WARC-Record-ID": "<urn:uuid:6>", "WARC-Payload-Digest": "blake3:zz", "Content-Type": "text/plain"}, b"x" * 5),
    ]
    path = tmp_path / "other.warc.gz"
    path.write_bytes(b"".join(member(*r) for r in records))
    for size in (1 << 20, 64):
        got = {r.record_id: r for r in warc.read(spark, [(f"file://{path}", path.stat().st_size)], size, with_payload=True).collect()}
        assert [got[f"<urn:uuid:{k}>"].record_type for k in range(1, 7)] == [h["WARC-Type"] for h, _ in records]
        assert bytes(got["<urn:uuid:3>"].payload) == body and got["<urn:uuid:3>"].payload_digest == hashlib.sha256(body).hexdigest()
        assert got["<urn:uuid:1>"].payload_bytes == 19 and got["<urn:uuid:2>"].payload_bytes == 0 and got["<urn:uuid:4>"].payload_bytes == 0
        assert got["<urn:uuid:5>"].refers_to_id == "<urn:uuid:3>" and got["<urn:uuid:5>"].payload is None and got["<urn:uuid:5>"].refers_to is None
    path.write_bytes(member({**records[2][0], "WARC-Payload-Digest": "sha1:" + "A" * 32}, http + body))
    with pytest.raises(Exception, match="isn't that of its digest"):
        warc.read(spark, [(f"file://{path}", path.stat().st_size)]).collect()


def test_many_repeated_payloads_are_marked_by_a_shuffle(spark, monkeypatch):
    rows, df = pages(spark)
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    got = warc.archived(df).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(rows)


def test_very_long_page(spark):
    text = "<p>long page é</p>\n" * 300_000
    df = spark.createDataFrame([(1, "u", text), (2, "u", text)], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived(df).collect()}
    assert got == {1: (len(text.encode()), "response", None), 2: (len(text.encode()), "revisit", 1)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(df).collect() == []
