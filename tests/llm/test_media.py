import hashlib
import os
import zlib

import pytest

from textloom.llm import media, mpeg


@pytest.mark.parametrize("n", [64, 128, 1408, 1417, 1472, 64 * 400])
def test_store_and_parse(n):
    payload = os.urandom(n // 2) + b"\xff\xfa\xe8\xc0" * (n // 8)
    stream = mpeg.parse(mpeg.store(payload))
    assert mpeg.payload_of(stream) == payload
    assert stream.table_frames == stream.frames and stream.table_bytes == len(mpeg.store(payload)) - mpeg._read_id3v2(mpeg.store(payload))[1]
    assert stream.bad_crc == stream.skipped == 0 and stream.checked_crc == stream.frames
    assert stream.seconds == stream.frames * 1152 / 32000


def test_damage():
    whole = bytearray(mpeg.store(os.urandom(64 * 200)))
    first = mpeg.parse(bytes(whole))
    whole[first.offsets[0] + 8] ^= 1  # side information
    assert mpeg.parse(bytes(whole)).bad_crc == 1
    cut = bytes(whole[: first.offsets[0]]) + b"junk" * 40 + bytes(whole[first.offsets[0] :]) + b"TAG".ljust(128, b"\0")
    again = mpeg.parse(cut)
    assert again.frames == first.frames and again.resyncs == 1 and again.skipped == 160 and again.id3v1
    with pytest.raises(ValueError):
        mpeg.payload_of(mpeg.parse(bytes(whole)))


def test_crc_of_the_format():
    assert mpeg.crc16(b"123456789") == 0xAEE7  # CRC-16 with polynomial 0x8005 from all ones, the high bit first


def test_headers():
    assert mpeg.frame_length(bytes([0xFF, 0xFB, 0x90, 0x00])) == 417
    assert mpeg.frame_length(bytes([0xFF, 0xFB, 0x92, 0x00])) == 418
    assert mpeg.frame_length(b"\xff\xfb\xf0\x00") == mpeg.frame_length(b"\xff\xe0\x90\x00") == mpeg.frame_length(b"RIFF") == 0


#: Bytes of one frame of other writers, by the format's own formulas: header, bytes, samples, Hz.
FOREIGN = {
    "MPEG-1 Layer I, 384 kbit/s, 48 kHz": (b"\xff\xff\xc4\x00", 384, 384, 48000),
    "MPEG-1 Layer II, 192 kbit/s, 44.1 kHz, padded": (b"\xff\xfd\xa2\x00", 627, 1152, 44100),
    "MPEG-1 Layer III, 128 kbit/s, 44.1 kHz": (b"\xff\xfb\x90\x00", 417, 1152, 44100),
    "MPEG-2 Layer III, 64 kbit/s, 22.05 kHz": (b"\xff\xf3\x80\x00", 208, 576, 22050),
    "MPEG-2 Layer II, 64 kbit/s, 24 kHz": (b"\xff\xf5\x84\x00", 384, 1152, 24000),
    "MPEG-2.5 Layer III, 32 kbit/s, 8 kHz, mono": (b"\xff\xe3\x48\xc0", 288, 576, 8000),
}


@pytest.mark.parametrize("name", FOREIGN)
def test_streams_of_other_writers(name):
    header, size, samples, rate = FOREIGN[name]
    frame = header + bytes(size - 4)
    stream = mpeg.parse(b"junk" + frame * 70 + frame[: size // 2])
    assert (stream.frames, stream.rate, stream.seconds) == (70, rate, 70 * samples / rate)
    assert stream.offsets == [4, 4 + 32 * size, 4 + 64 * size] and mpeg.payload_of(stream) is None


def test_a_rate_that_changes_counts_frame_by_frame():
    a, b = FOREIGN["MPEG-1 Layer III, 128 kbit/s, 44.1 kHz"], FOREIGN["MPEG-2 Layer III, 64 kbit/s, 22.05 kHz"]
    stream = mpeg.parse((a[0] + bytes(a[1] - 4)) * 10 + (b[0] + bytes(b[1] - 4)) * 4)
    assert stream.seconds == 10 * 1152 / 44100 + 4 * 576 / 22050 and stream.rate == 44100


def test_tables_of_other_encoders():
    """A LAME table with its delays, and the other common table."""
    frame = b"\xff\xfb\x90\x00" + bytes(413)
    lame = b"\xff\xfb\x90\x00" + bytes(32) + b"Xing" + (15).to_bytes(4) + (50).to_bytes(4) + (9999).to_bytes(4) + bytes(range(100)) + (7).to_bytes(4)
    lame += b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3)
    stream = mpeg.parse(lame.ljust(417, b"\0") + frame * 50)
    assert (stream.table, stream.table_frames, stream.table_bytes, stream.toc, stream.delay, stream.padding) == ("Xing", 50, 9999, bytes(range(100)), 576, 1000)
    assert stream.frames == 50 and stream.seconds == 50 * 1152 / 44100 - 1576 / 44100
    vbri = b"\xff\xfb\x90\x00" + bytes(32) + b"VBRI" + (1).to_bytes(2) + (1105).to_bytes(2) + (75).to_bytes(2) + (5000).to_bytes(4) + (12).to_bytes(4) + (3).to_bytes(2) + (1).to_bytes(2) + (2).to_bytes(2) + (4).to_bytes(2) + b"abcdef"
    stream = mpeg.parse(vbri.ljust(417, b"\0") + frame * 12)
    assert (stream.table, stream.table_frames, stream.table_bytes, stream.toc, stream.delay) == ("VBRI", 12, 5000, b"abcdef", 1105)
    assert stream.seconds == (12 * 1152 - 1105) / 44100


def test_payload_lies_in_the_frames():
    """Without the module's own parser: frames found by the format's rules hold the payload between side information and frame end."""
    payload = os.urandom(64 * 50)
    data = mpeg.store(payload)
    size = 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9])
    at, parts = size, []
    kbit = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
    while at < len(data):
        assert data[at] == 0xFF and data[at + 1] in (0xFA, 0xFB) and data[at + 2] >> 2 & 3 == 2
        length = 144 * kbit[data[at + 2] >> 4] // 32
        if data[at + 1] == 0xFA:
            crc = 0xFFFF
            for byte in data[at + 2 : at + 4] + data[at + 6 : at + 23]:
                for bit in range(7, -1, -1):
                    crc = crc << 1 & 0xFFFF ^ (0x8005 if (crc >> 15) ^ (byte >> bit & 1) else 0)
            assert crc == int.from_bytes(data[at + 4 : at + 6])
            parts.append(data[at + 23 : at + length])
        at += length
    assert at == len(data) and b"".join(parts)[: len(payload)] == payload


def test_any_media_in_the_column(spark):
    rows = [(1, 0, bytearray(b"\xff\xfb\x90\x00" + bytes(413)) * 3), (2, 0, None), (3, 0, bytearray(b"no audio"))]
    out = {r.doc_id: r for r in media.parse_media(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert out[1].payload_bytes is None and out[1].seconds == 3 * 1152 / 44100 and out[1].seek_offsets == [0]
    assert out[2].seconds == out[3].seconds == 0 and out[2].seek_offsets == []


def test_media_columns(documents):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x" * 64, "b"), (4, "é" * 33, "b"), (4, "é" * 33, "b"), (None, "z", None), (5, "long text " * 12_000, "c")]
    out = media.media_columns(documents(rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        raw = text.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = mpeg.store(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert media.media_columns(documents([])).count() == 0
