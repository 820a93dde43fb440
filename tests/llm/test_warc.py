"""Archives: round trips, and what the reader salvages."""

import base64
import gzip
import hashlib
import time

import numpy as np
import pytest

from sieveworks.llm import queries, warc

PAGES = "page_id bigint, url string, html string"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_archives(spark, sf_dir, tmp_path):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    pages += [(10**6 + k, u, h) for k, (u, h) in enumerate([(None, None), ("http://x/ y\r\n", ""), ("u", "é" * 1000), ("u", "é" * 1000), ("v", "WARC/1.1\r\n\r\n"), ("w", "\x1f\x8b\x08"), ("z", "z" * 3_000_000)])]
    spark.createDataFrame(pages, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.after_gap) for r in queries.op1_warc_salvage(spark, str(tmp_path)).collect()}
    best = {}
    for i, _, h in pages:
        best[h or ""] = max(best.get(h or "", i), i)
    want = {}
    for i, _, h in pages:
        data, first = (h or "").encode(), best[h or ""]
        want[i] = (len(data), digest(data), "response" if first == i else "revisit", None if first == i else first, i % 50 == 0)
    assert got == want


def test_odd_tables(spark, tmp_path):
    rows = [(None, "same", 1, "a"), (1, "same", 2, "b"), (1, "same", 3, "c"), (2, None, 4, "d"), (None, "alone", 5, "e"), (3, "", 6, "f")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, payload int, problem string")
    warc.write_archives(pages, f"{tmp_path}/a", url_col=None, file_bytes=5)
    records = warc.read_archives(spark, f"{tmp_path}/a")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.with_revisits(records).collect()), key=str)
    want = [(None, 4, "revisit", 1), (1, 4, "response", None), (1, 4, "response", None), (2, 0, "revisit", 3), (None, 5, "response", None), (3, 0, "response", None)]
    assert got == sorted(want, key=str) and warc.gaps(records).count() == 0
    warc.write_archives(pages.limit(0), f"{tmp_path}/b", url_col=None)
    assert warc.with_revisits(warc.read_archives(spark, f"{tmp_path}/b")).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    records = [warc.record(k, "http://x", f"body {k}".encode() * 50) + b"\r\n\r\n" for k in range(6)]
    parts = [warc.member(r) for r in records] if packed else records
    data = bytearray(b"".join(parts))
    begins = np.cumsum([0] + [len(p) for p in parts])
    data[begins[2] + len(parts[2]) // 2] ^= 0xFF
    broken = bytes(data[: begins[4]]) + b"junk" + bytes(data[begins[4] :])[:-9]
    found = list(warc.salvage(broken))
    gaps = [(f.start, f.end) for f in found if f.problem]
    if packed:  # of the last member only its checksum is cut: the record is whole, its gap is still reported
        assert gzip.decompress(b"".join(parts)) == b"".join(records)
    names = [(f.headers or {}).get("warc-record-id") for f in found if not f.problem]
    assert names[:4] == [f"<urn:page:{k}>" for k in (0, 1, 3, 4)] and len(names) == 4 + packed
    assert gaps == [(begins[2], begins[3]), (begins[4], begins[4] + 4), (begins[5] + 4, len(broken))]


def http(body, extra=b"", said=None, kind="Payload", chunks=False):
    sent = b"".join(b"%x\r\n%s\r\n" % (len(body[k : k + 7]), body[k : k + 7]) for k in range(0, len(body), 7)) + b"0\r\n\r\n" if chunks else body
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + extra + b"\r\n" + sent
    value = digest(block if kind == "Block" else body) if said is None else said
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/http; msgtype=response\r\nWARC-%s-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind.encode(), value.encode(), len(block), block)


def test_http_records():
    data = http(b"<p>one</p>") + http(b"<p>two</p>", chunks=True) + http(b"<p>three</p>", kind="Block") + http(b"<p>four</p>", said="A" * 32) + http(b"<p>five</p>", said=hashlib.sha1(b"<p>five</p>").hexdigest())
    found = list(warc.salvage(data))
    assert [f.payload for f in found if not f.problem][::2] == [b"<p>one</p>", b"<p>three</p>"]
    assert [f.problem for f in found] == [None, None, None, "digest does not fit", None]


def test_records_inside_a_member():
    records = [warc.record(k, None, bytes([65 + k]) * 3000) + b"\r\n\r\n" for k in range(5)]
    one = warc.member(b"".join(records))
    assert [f.payload[:1] for f in warc.salvage(one)] == [b"A", b"B", b"C", b"D", b"E"]
    hurt = warc.member(records[0] + b"no record at all" + records[1][:-40] + records[2])
    found = list(warc.salvage(hurt))
    assert [(f.payload[:1], bool(f.problem)) for f in found] == [(b"A", False), (b"", True), (b"C", False)] and found[1].inner == (len(records[0]), len(records[0]) + 16 + len(records[1]) - 40)
    rng = np.random.default_rng(1)
    noise = [warc.record(k, None, rng.bytes(3000)) + b"\r\n\r\n" for k in range(5)]
    whole = warc.member(b"".join(noise))
    cut = list(warc.salvage(whole[: len(whole) * 7 // 10] + one))
    assert [f.headers is not None for f in cut] == [True] * 3 + [False] + [True] * 5 and cut[3].problem


def test_urls_of_any_length(spark, tmp_path):
    """A header's lines may be long, in the first record and behind a torn one."""
    rows = [(k, "http://a/" + "x" * n, f"<p>{k}</p>", k % 2 == 0) for k, n in enumerate((70_000, 65_535, 3_000_000, 10))]
    warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string, torn boolean").coalesce(1), f"{tmp_path}/long", torn_col="torn")
    got = {int(r.record_id): (r.target_uri, r.payload.decode(), r.gap_before) for r in warc.read_archives(spark, f"{tmp_path}/long").where("problem is null").collect()}
    assert got == {k: (url, html, torn) for k, url, html, torn in rows}


def test_false_version_lines_cost_linear_time():
    began = time.time()
    found = list(warc.salvage(b"WARC/1.0\r\n" * 1_000_000 + warc.record(1, None, b"x") + b"\r\n\r\n"))
    assert [bool(f.problem) for f in found] == [True, False] and time.time() - began < 20
    found = list(warc.salvage(b"WARC/1.0\r\nA: b\r\nContent-Length: 5\r\n\r\n" * 50_000))
    assert len(found) == 1 and time.time() - began < 30


def test_files_of_any_name(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "CC-0001.warc.gz").write_bytes(warc.member(http(b"body")) + b"junk")
    records = warc.read_archives(spark, f"{tmp_path}/x", glob="*.warc.gz")
    assert [(r.payload, r.gap_before) for r in records.where("problem is null").collect()] == [(bytearray(b"body"), False)]
    assert [(r.end - r.start, r.problem) for r in warc.gaps(records).collect()] == [(4, "no version line")]
