import base64
import gzip
import hashlib

import pytest

from meridia.llm.warc import read_warc, write_warc


def test_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 200000
    rows = [(1, "http://a", "<p>x</p>\r\n\r\nWARC/1.0\r\n"), (2, "http://b", None), (3, None, ""), (4, "http://\r\nd", big), (5, "e", big), (6, "e", "solo"), (None, "n", big), (6, "e", "solo")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    path = f"file://{tmp_path}/w"
    write_warc(df, path)
    got = read_warc(spark, path).collect()
    assert len(got) == len(rows)
    by = {(r.record_id, r.record_type): r for r in got}
    one = by["<urn:record:1>", "response"]
    assert bytes(one.payload).decode() == rows[0][2] and one.payload_digest == base64.b32encode(hashlib.sha1(rows[0][2].encode()).digest()).decode()
    assert by["<urn:record:2>", "revisit"].refers_to == "<urn:record:3>" and by["<urn:record:3>", "response"].payload_bytes == 0
    for i in ("4", "null"):
        r = by[f"<urn:record:{i}>", "revisit"]
        assert r.refers_to == "<urn:record:5>" and r.payload_bytes == len(big.encode()) and r.payload_digest == by["<urn:record:5>", "response"].payload_digest
    assert by["<urn:record:4>", "revisit"].target_uri == "http://  d" and by["<urn:record:3>", "response"].target_uri is None
    assert sum(r.record_id == "<urn:record:6>" and r.record_type == "response" for r in got) == 2


def test_pushdown_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://{i % 7}", f"page {i % 50}") for i in range(100)], "page_id long, url string, html string")
    write_warc(df, f"file://{tmp_path}/w", least=7)
    all_ = read_warc(spark, f"file://{tmp_path}/w")
    some = all_.where("record_type = 'revisit' AND target_uri IN ('http://1', 'http://2')")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "revisit" not in plan.split("BatchScan")[0]  # the source takes the test, no filter is left above it
    assert some.count() == sum(i % 7 in (1, 2) and i < 50 and len(f"page {i % 50}") >= 7 for i in range(100))
    heads = read_warc(spark, f"file://{tmp_path}/w", payload=False).collect()
    assert len(heads) == 100 and all(r.payload is None and r.payload_bytes == len(f"page {int(r.record_id[12:-1]) % 50}") for r in heads)
    write_warc(df.limit(0), f"file://{tmp_path}/none")
    assert read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_damaged_archives_fail(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "abcdef")], "page_id long, url string, html string")
    write_warc(df.coalesce(1), f"file://{tmp_path}/w")
    (file,) = (p for p in (tmp_path / "w").iterdir() if p.name.startswith("part"))
    whole = file.read_bytes()
    for bad in (whole.replace(b"abcdef", b"abcdeg"), whole[:-8], whole[:60]):
        (tmp_path / "bad").mkdir(exist_ok=True)
        (tmp_path / "bad" / "x.warc").write_bytes(bad)
        with pytest.raises(Exception):
            read_warc(spark, f"file://{tmp_path}/bad").collect()


def test_archives_of_others(spark, tmp_path):
    body = "<p>é</p>".encode() * 50
    digest = base64.b32encode(hashlib.sha1(body).digest())
    zipped = gzip.compress(body)
    pieces = b"5\r\n" + zipped[:5] + b"\r\n" + b"%x;x=y\r\n" % (len(zipped) - 5) + zipped[5:] + b"\r\n0\r\n\r\n"
    blocks = [
        b"HTTP/1.1 200 OK\r\nserver: x\r\n\r\n" + body,
        b"HTTP/1.1 200 OK\r\nContent-encoding:gzip\r\nTRANSFER-ENCODING: chunked\r\n\r\n" + pieces,
        b"HTTP/1.1 200 OK\r\nContent-Encoding: br\r\n\r\n" + body,
    ]
    out = b""
    for i, block in enumerate(blocks):
        head = b"WARC/1.1\r\nwarc-type:response\r\nWARC-Record-ID:<urn:x:%d>\r\nwarc-target-uri: http://a/\r\n b\r\nWARC-Payload-Digest: SHA1:%s\r\nX-Same: 1\r\nX-Same: 2\r\nContent-length:%d\r\n\r\n"
        out += head % (i, digest, len(block)) + block + b"\r\n\r\n"
    out += b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Payload-Digest: md5:00ff\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(out)
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(out[: len(out) // 2]) + gzip.compress(out[len(out) // 2 :]))
    for name in ("x.warc", "y.warc.gz"):
        got = read_warc(spark, f"file://{tmp_path}/{name}").collect()
        assert [bytes(r.payload) for r in got] == [body] * 3 + [b"abc"] and [r.record_type for r in got] == ["response"] * 3 + ["metadata"]
        assert [r.record_id for r in got] == ["<urn:x:0>", "<urn:x:1>", "<urn:x:2>", None] and {r.target_uri for r in got[:3]} == {"http://a/ b"}
        assert got[0].payload_digest == digest.decode() and got[3].payload_digest == "md5:00ff" and got[0].headers["X-Same"] == "1"
    assert read_warc(spark, f"file://{tmp_path}/x.warc").where("record_id = '<urn:x:1>'").count() == 1
