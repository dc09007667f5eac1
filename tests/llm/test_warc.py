import base64
import gzip
import hashlib
import os

import pytest

from textloom.llm import warc

ROWS = [(1, "http://a", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (3, None, None), (4, "http://d e", ""), (5, "http://e", "ü" * 50_000), (None, "http://n", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (6, "http://f", "\r\n\r\n")]


def test_round_trip(spark):
    out = warc.archive_pages(spark.createDataFrame(ROWS, "page_id bigint, url string, html string")).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    newest = {"<p>same</p>": 2, "": 4}
    want = []
    for page, _, html in ROWS:
        n = newest.get(html or "")
        revisit = n is not None and page != n
        want.append((page, len((html or "").encode()), digest(html), "revisit" if revisit else "response", n if revisit else None))
    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out))) == sorted(map(str, want))
    assert warc.archive_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 10**6])
def test_every_split_size_reads_each_record_once(tmp_path, size):
    """Payloads hold gzip magic themselves, stored without compression being of use."""
    magic = gzip.compress(b"WARC? no") + b"\x1f\x8b\x08\x00" * 30 + os.urandom(300)
    path = tmp_path / "x.warc.gz"
    records = [warc.record(k, f"http://x/{k}", magic * (k % 3) + bytes([k]), None, False) for k in range(12)]
    path.write_bytes(b"".join(records))
    found = []
    for start in range(0, path.stat().st_size, size):
        found += [(at, fields["WARC-Record-ID"]) for at, fields, _ in warc.read_range(str(path), start, start + size)]
    assert [x for _, x in found] == [f"<urn:x-page:{k}>" for k in range(12)]
    assert gzip.decompress(path.read_bytes()).count(b"WARC/1.1\r\n") == 12


def test_damage_is_an_error(tmp_path):
    path = tmp_path / "x.warc.gz"
    path.write_bytes(warc.record(1, None, b"x" * 500, None, False)[:-20])
    with pytest.raises(ValueError):
        list(warc.read_range(str(path), 0, 10**6))


def test_archives_of_other_writers(spark, tmp_path):
    def member(kind, content_type, block, **more):
        fields = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:6f1c2a5e-0000-4000-8000-00000000000a>", "Content-Type": content_type, "Content-Length": len(block)} | {k.replace("_", "-"): v for k, v in more.items()}
        return gzip.compress(b"WARC/1.0\r\n" + "".join(f"{k}:{v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n")

    http = "application/http; msgtype=response"
    path = tmp_path / "other.warc.gz"
    path.write_bytes(
        member("warcinfo", "application/warc-fields", b"software: x\r\n\r\nmore")
        + member("request", "application/http; msgtype=request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n")
        + member("response", http, b"HTTP/1.1 200 OK\r\n\r\nbody", WARC_Target_URI="http://a/")
        + member("revisit", http, b"HTTP/1.1 200 OK\r\n\r\n", WARC_Payload_Digest="sha1:ABC")
    )
    files = spark.createDataFrame([(str(path), path.stat().st_size)], "path string, size long")
    got = {r.record_type: (r.page_id, r.url, r.payload_digest, r.payload_bytes, r.payload and bytes(r.payload)) for r in warc.read_archives(files).collect()}
    info = b"software: x\r\n\r\nmore"
    assert got == {
        "warcinfo": (None, None, warc.digest_of(info), len(info), info),
        "request": (None, None, warc.digest_of(b""), 0, b""),
        "response": (None, "http://a/", warc.digest_of(b"body"), 4, b"body"),
        "revisit": (None, None, "ABC", None, None),
    }


@pytest.mark.parametrize("head, good", [
    (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: 5\r\n\r\nbody", True),
    (b"WARC/1.0\r\nwarc-type:a\r\nwarc-record-id:<x>\r\n folded\r\ncontent-length:0\r\n\r\n", True),
    (b"WARC/1.1 is what this text is about\r\n\r\n", False),
    (b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n", False),
    (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: many\r\n\r\n", False),
    (b"WARC/1.1\r\nWARC-Type: response\r\nno field\r\nWARC-Record-ID: <x>\r\nContent-Length: 5\r\n\r\n", False),
    (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: 5\r\n", False),
    (b"", False),
])
def test_headers_are_read_before_a_member_is_accepted(head, good):
    assert warc.is_record_header(head) is good


def test_members_that_only_look_like_records(tmp_path):
    """A payload that is itself a gzip member beginning with the version line is not taken for a record."""
    fake = gzip.compress(b"WARC/1.1\r\nthe rest is prose", mtime=0)
    path = tmp_path / "x.warc.gz"
    whole = b"".join(warc.record(k, None, fake, None, False) for k in range(4))
    path.write_bytes(fake + whole + fake)
    for size in (1, 50, 10**6):
        found = [fields["WARC-Record-ID"] for start in range(0, len(whole) + 2 * len(fake), size) for _, fields, _ in warc.read_range(str(path), start, start + size)]
        assert found == [f"<urn:x-page:{k}>" for k in range(4)]


def _letters(seed, n):
    import random

    return "".join(random.Random(seed).choices("abcdefghijklmnopqrstuvwxyz0123456789/-_", k=n))


@pytest.mark.parametrize("size", [200, 3000, 100_000, 10**7])
def test_headers_of_any_length_at_every_split_size(tmp_path, size):
    """Urls of 10 KB, 25 KB and 1 MB that hardly compress: every split that a record starts in finds it by search."""
    lengths = [9, 10_000, 25_000, 70_000, 1_000_000, 0]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(warc.record(k, _letters(k, n), b"body", None, False) for k, n in enumerate(lengths)))
    found = []
    for start in range(0, path.stat().st_size, size):
        found += [(fields["WARC-Record-ID"], len(fields.get("WARC-Target-URI", ""))) for _, fields, _ in warc.read_range(str(path), start, start + size)]
    assert found == [(f"<urn:x-page:{k}>", n) for k, n in enumerate(lengths)]


def test_long_urls_and_extra_columns_through_the_operator(spark):
    rows = [(k, _letters(k, n), f"<p>{k % 4}</p>", "x", 1, "mine") for k, n in enumerate([9, 10_000, 100_009, 1_000_000, 0, 25_000])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, newest string, record_type int, payload string")
    out = sorted(warc.archive_pages(pages).collect())
    assert [(r.page_id, r.url or "", r.record_type, r.refers_to) for r in out] == [(k, url, "revisit" if k < 2 else "response", k + 4 if k < 2 else None) for k, url, *_ in rows]


def test_a_record_whose_header_is_damaged_is_an_error(tmp_path):
    good = [warc.record(k, None, b"x", None, False) for k in range(3)]
    bad = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: many\r\n\r\nbody")
    path = tmp_path / "x.warc.gz"
    path.write_bytes(good[0] + bad + good[1])
    with pytest.raises(ValueError, match="can't be read"):
        list(warc.read_range(str(path), 0, 10**6))


def test_a_verdict_is_open_until_the_header_ends():
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: 5\r\n\r\n"
    assert [warc.header_verdict(head[:k]) for k in range(len(head))] == [None] * len(head) and warc.header_verdict(head) is True
    assert warc.header_verdict(b"WARC/2") is False and warc.header_verdict(b"WARC/1.1\r\nprose\r\nmore") is False
