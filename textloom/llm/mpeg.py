"""MPEG audio streams: writing payload-carrying silent frames, and parsing any stream.

Facts of the public format: a frame starts with 11 set bits; its header gives version, layer,
bitrate, sampling rate and padding, and so its length and samples; an optional CRC-16 covers, in Layer III, the header's last two bytes
and the side information; ID3v2 stands before and ID3v1 after the frames; a first frame with "Xing", "Info" or "VBRI" has counts and a seek
table, and may tell how many samples the encoder put before and after the sound.
A Layer III frame whose granules declare no coded bits is silence, and all its main data is ancillary bytes: there
the payload goes, byte for byte. Frames of free format have no length in their header and count as no frames.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

#: Fixed values of the format: kbit/s by index for MPEG-1 Layers I, II and III, then for the other versions' Layer I and Layers II and III.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Hz by index for MPEG-1; MPEG-2 has half of them, MPEG-2.5 a quarter.
RATES = (44100, 48000, 32000)
MONO_SIDE = 17
XING_FRAMES, XING_BYTES, XING_TOC, XING_QUALITY = 1, 2, 4, 8
VBRI_AT = 36
SEEK_EVERY = 32


class Frame(NamedTuple):
    """What a header tells: bytes and samples of the frame, Hz, bytes of side information (Layer III), layer, and whether a CRC follows."""

    length: int
    samples: int
    rate: int
    side: int
    layer: int
    protected: bool


@lru_cache(maxsize=4096)
def frame_of(header: bytes) -> Frame | None:
    """The frame that these four bytes start, or None if they are no header."""
    if len(header) < 4 or header[0] != 0xFF or header[1] & 0xE0 != 0xE0:
        return None
    version, layer, bitrate, rate = header[1] >> 3 & 3, 4 - (header[1] >> 1 & 3), header[2] >> 4, header[2] >> 2 & 3
    if version == 1 or layer == 4 or not 0 < bitrate < 15 or rate == 3 or header[3] & 3 == 2:
        return None
    first = version == 3
    hertz = RATES[rate] // (1 if first else 2 if version == 2 else 4)
    bits = 1000 * BITRATES[(1, layer) if first else (2, min(layer, 2))][bitrate]
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    padding = header[2] >> 1 & 1
    length = (12 * bits // hertz + padding) * 4 if layer == 1 else samples // 8 * bits // hertz + padding
    mono = header[3] >> 6 == 3
    side = 0 if layer < 3 else (MONO_SIDE if mono else 32) if first else (9 if mono else 17)
    return Frame(length, samples, hertz, side, layer, not header[1] & 1)


def frame_length(header: bytes) -> int:
    """Bytes of the frame that this header starts, or 0 if it is none."""
    found = frame_of(bytes(header))
    return found.length if found else 0


def _byte_crc(high: int) -> int:
    crc = high << 8
    for _ in range(8):
        crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


_CRC_TABLE = [_byte_crc(k) for k in range(256)]


def crc16(data: bytes) -> int:
    """Polynomial x^16 + x^15 + x^2 + 1, from all ones, the high bit first."""
    crc = 0xFFFF
    for byte in data:
        crc = crc << 8 & 0xFFFF ^ _CRC_TABLE[crc >> 8 ^ byte]
    return crc


def _header(bitrate: int, protected: bool) -> bytes:
    return bytes([0xFF, 0xFA if protected else 0xFB, bitrate << 4 | RATES.index(32000) << 2, 0xC0])


def _sizes() -> dict[int, int]:
    """Payload bytes of a protected mono frame for each bitrate."""
    return {k: frame_length(_header(k, True)) - 6 - MONO_SIDE for k in range(1, 15)}


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _id3v2(fields: dict[str, str]) -> bytes:
    frames = b""
    for name, value in fields.items():
        body = b"\x03" + name.encode() + b"\0" + value.encode()
        frames += b"TXXX" + _synchsafe(len(body)) + b"\0\0" + body
    return b"ID3\x04\0\0" + _synchsafe(len(frames)) + frames


def store(payload: bytes) -> bytes:
    """An MPEG stream that carries ``payload``: full frames at 320 kbit/s, the last as small as fits."""
    sizes = _sizes()
    most, side = sizes[14], bytes(MONO_SIDE)
    heads = {k: (h := _header(k, True)) + struct.pack(">H", crc16(h[2:] + side)) + side for k in sizes}
    whole = len(payload) // most
    parts = []
    for k in range(whole):
        parts += (heads[14], payload[k * most : (k + 1) * most])
    if rest := payload[whole * most :]:
        k = min(k for k, n in sizes.items() if n >= len(rest))
        parts += (heads[k], rest, bytes(sizes[k] - len(rest)))
    audio = b"".join(parts)
    frames = whole + bool(rest)
    first = _header(1, False)
    size = frame_length(first)
    total = size + len(audio)
    longest = frame_length(_header(14, True))
    toc = bytes(min(255, (size + min(frames * k // 100 * longest, len(audio))) * 256 // total) for k in range(100))
    xing = first + side + b"Xing" + struct.pack(">III", XING_FRAMES | XING_BYTES | XING_TOC | XING_QUALITY, frames, total) + toc + struct.pack(">I", 0)
    tag = _id3v2({"payload_bytes": str(len(payload)), "payload_crc32": str(zlib.crc32(payload))})
    return tag + xing.ljust(size, b"\0") + audio


@dataclass
class Stream:
    frames: int = 0
    samples: Counter = field(default_factory=Counter)  # by Hz
    bad_crc: int = 0
    checked_crc: int = 0
    resyncs: int = 0
    skipped: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    id3v1: bool = False
    table: str | None = None
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""
    delay: int = 0
    padding: int = 0
    offsets: list[int] = field(default_factory=list)
    ancillary: list[bytes] = field(default_factory=list)

    @property
    def rate(self) -> int:
        """The Hz of most samples."""
        return max(self.samples, key=lambda r: (self.samples[r], r), default=0)

    @property
    def seconds(self) -> float:
        """The sound's exact duration: every frame at its own rate, less what the encoder says it put before and after."""
        extra = (self.delay + self.padding) / self.rate if self.frames else 0.0
        return max(0.0, sum(n / r for r, n in self.samples.items()) - extra)


def _read_id3v2(data: bytes) -> tuple[dict[str, str], int]:
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    number = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end, at, tags = min(len(data), 10 + number(data[6:10])), 10, {}
    while at + 10 <= end and data[at : at + 4].strip(b"\0"):
        size = number(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8])
        body = data[at + 10 : min(end, at + 10 + size)]
        name = data[at : at + 4].decode("latin-1")
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            tags[key] = value.rstrip("\0")
        at += 10 + size
    return tags, end


def _read_table(out: Stream, data: bytes, at: int, found: Frame) -> bool:
    """Whether the first frame is a table of a variable bitrate; its counts, seek table and encoder delays."""
    body = at + 4 + 2 * found.protected + found.side
    if found.layer == 3 and data[body : body + 4] in (b"Xing", b"Info"):
        out.table, flags, p = data[body : body + 4].decode(), int.from_bytes(data[body + 4 : body + 8]), body + 8
        if flags & XING_FRAMES:
            out.table_frames, p = int.from_bytes(data[p : p + 4]), p + 4
        if flags & XING_BYTES:
            out.table_bytes, p = int.from_bytes(data[p : p + 4]), p + 4
        if flags & XING_TOC:
            out.toc, p = data[p : p + 100], p + 100
        p += 4 * bool(flags & XING_QUALITY)
        if p + 24 <= at + found.length and data[p : p + 4] in (b"LAME", b"Lavc", b"Lavf"):
            delays = int.from_bytes(data[p + 21 : p + 24])
            out.delay, out.padding = delays >> 12, delays & 0xFFF
        return True
    if data[at + VBRI_AT : at + VBRI_AT + 4] == b"VBRI":
        p = at + VBRI_AT + 6
        out.table, out.delay = "VBRI", int.from_bytes(data[p : p + 2])
        out.table_bytes, out.table_frames = int.from_bytes(data[p + 4 : p + 8]), int.from_bytes(data[p + 8 : p + 12])
        entries, size = int.from_bytes(data[p + 12 : p + 14]), int.from_bytes(data[p + 16 : p + 18])
        out.toc = data[p + 20 : p + 20 + entries * size]
        return True
    return False


def parse(data: bytes, seek_every: int = SEEK_EVERY) -> Stream:
    """Read a stream: tags, the table of a variable bitrate, every frame, its CRC, and a byte offset for each 32nd frame.

    Where no frame starts, the next place is taken whose header is valid and that a second valid header or the
    end follows. A last frame that is cut off isn't counted.
    """
    out = Stream()
    out.tags, at = _read_id3v2(data)
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        out.id3v1, end = True, end - 128
    while at + 4 <= end:
        found = frame_of(data[at : at + 4])
        if not found or at + found.length > end:
            out.resyncs += 1
            start = at
            at += 1
            while (at := data.find(b"\xff", at, end)) >= 0:
                size = frame_length(data[at : at + 4])
                if size and (at + size == end or at + size < end and frame_length(data[at + size : at + size + 4])):
                    break
                at += 1
            at = end if at < 0 else at
            out.skipped += at - start
            continue
        if not out.frames and out.table is None and _read_table(out, data, at, found):
            at += found.length
            continue
        body = at + 4 + 2 * found.protected + found.side
        if found.protected and found.layer == 3:
            out.checked_crc += 1
            out.bad_crc += crc16(data[at + 2 : at + 4] + data[at + 6 : body]) != int.from_bytes(data[at + 4 : at + 6])
        if out.frames % seek_every == 0:
            out.offsets.append(at)
        out.frames += 1
        out.samples[found.rate] += found.samples
        out.ancillary.append(data[body : at + found.length])
        at += found.length
    return out


def payload_of(stream: Stream) -> bytes | None:
    """What ``store`` put in, checked against its length and CRC-32; None for a stream of another writer."""
    if "payload_bytes" not in stream.tags or "payload_crc32" not in stream.tags:
        return None
    payload = b"".join(stream.ancillary)[: int(stream.tags["payload_bytes"])]
    if zlib.crc32(payload) != int(stream.tags["payload_crc32"]) or stream.bad_crc or len(payload) != int(stream.tags["payload_bytes"]):
        raise ValueError("the stream is damaged")
    return payload
