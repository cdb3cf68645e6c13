"""MPEG audio columns: bytes carried losslessly in valid silent Layer III streams, and a parser for MPEG audio of any layer.

Writing: a payload (padded with bytes 255 to a positive multiple of UNIT = 576) becomes one stream: an ID3v2.3 tag, a first frame whose body is
a Xing table (frames, bytes, 100 seek points), then one CRC-protected 48 kHz mono frame for every 576 bytes. Their side information says that
no bit belongs to audio data, so a decoder plays silence and skips the payload as ancillary data. Frames are 224 kbit/s, 672 bytes long.

Reading: tags (ID3v2, ID3v1, APEv2) are stepped over; at each place a frame header must be plausible and, when the place follows damage, be
confirmed by the next header (resynchronisation); a Xing, Info or VBRI table is parsed; CRC-16 of Layers I and III is verified; durations are exact
fractions (samples over rate); seek offsets are the byte offsets of the frames.

Nulls: a null text is the empty one (one padded unit). Equal texts, as in repeated rows, give equal values. A text is one stream, however long. Empty tables give
empty results; key columns are passed on, columns other than the key and the text (or the media) aren't read, whatever their names. Not done: checksums of Layer II are
counted but not verified, and free-format frames count as damage.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

UNIT = 576
_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}  # by version bits: 1, 2, 2.5
_BIT = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_BIT[2, 3] = _BIT[2, 2]


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG 1, 2: MPEG 2, 0: MPEG 2.5
    layer: int
    protected: bool
    rate: int
    length: int  # bytes of the frame
    samples: int
    side: int  # bytes of Layer III side information
    crc_bytes: int  # bytes behind the CRC that it covers; -1: not known without decoding


def parse_header(b: bytes) -> Header | None:
    """The frame header in four bytes, or None where they can't be one (free format counts as none)."""
    if len(b) < 4 or b[0] != 255 or b[1] & 0xE0 != 0xE0:
        return None
    version, layer, bits, rate = b[1] >> 3 & 3, 4 - (b[1] >> 1 & 3), b[2] >> 4, b[2] >> 2 & 3
    if version == 1 or layer == 4 or bits in (0, 15) or rate == 3 or b[3] & 3 == 2:
        return None
    kbit, hz, pad, mono = _BIT[1 if version == 3 else 2, layer][bits - 1], _RATES[version][rate], b[2] >> 1 & 1, b[3] >> 6 == 3
    if layer == 1:
        length, samples = (12_000 * kbit // hz + pad) * 4, 384
    else:
        samples = 1152 if layer == 2 or version == 3 else 576
        length = samples * 125 * kbit // hz + pad
    side = 0 if layer < 3 else (17 if mono else 32) if version == 3 else (9 if mono else 17)
    bound = (b[3] >> 4 & 3) * 4 + 4 if b[3] >> 6 == 1 else 32
    covers = side if layer == 3 else (16 if mono else (bound + 32) // 2) if layer == 1 else -1
    return Header(version, layer, not b[1] & 1, hz, length, samples, side, covers)


def crc16(data: bytes) -> int:
    """MPEG's CRC: polynomial 0x8005, initial value 0xFFFF, most significant bit first."""
    crc = 0xFFFF
    for b in data:
        crc = (crc << 8 & 0xFFFF) ^ _CRC[crc >> 8 ^ b]
    return crc


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()
# MPEG 1 Layer III, protected, 224 kbit/s, 48 kHz, no padding, one channel; empty side information
_HEAD = bytes((0xFF, 0xFA, 0xC4, 0xC0))
_SIDE = bytes(17)
_PREFIX = _HEAD + struct.pack(">H", crc16(_HEAD[2:] + _SIDE)) + _SIDE
_FRAME = 672
_TITLE = b"\0payload\0"[1:]
_ID3 = b"ID3\3\0\0" + bytes((0, 0, 0, 10 + 1 + len(_TITLE))) + b"TIT2" + struct.pack(">IH", 1 + len(_TITLE), 0) + b"\0" + _TITLE


def pad(data: bytes) -> bytes:
    """data with bytes 255 behind it, up to a positive multiple of UNIT."""
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def encode(payload: bytes) -> bytes:
    """A stream that carries payload, a positive multiple of UNIT bytes."""
    n = len(payload) // UNIT
    if not n or n * UNIT != len(payload):
        raise ValueError("a payload is a positive multiple of 576 bytes")
    total = (n + 1) * _FRAME
    seek = bytes(min(255, 256 * (_FRAME + _FRAME * (n * i // 100)) // total) for i in range(100))
    xing = b"Xing" + struct.pack(">III", 7, n, total) + seek
    first = (_PREFIX + xing).ljust(_FRAME, b"\0")
    frames = np.zeros((n, _FRAME), np.uint8)
    frames[:, : len(_PREFIX)] = np.frombuffer(_PREFIX, np.uint8)
    frames[:, len(_PREFIX) : len(_PREFIX) + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    return _ID3 + first + frames.tobytes()


@dataclass
class Stream:
    """What is in a stream. offsets, lengths: of its audio frames; table: of the Xing, Info or VBRI frame, if there is one."""

    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    table: dict | None = None
    crc_good: int = 0
    crc_bad: int = 0
    crc_unchecked: int = 0
    skipped: int = 0  # bytes outside of tags and frames

    @property
    def duration(self) -> Fraction:
        return sum((Fraction(n, hz) for hz, n in self._samples().items()), Fraction(0))

    def _samples(self) -> dict[int, int]:
        out: dict[int, int] = {}
        for h in self.headers:
            out[h.rate] = out.get(h.rate, 0) + h.samples
        return out


def _tag(data: bytes, at: int) -> tuple[str, int] | None:
    """Name and length of the tag at a place."""
    if data[at : at + 3] == b"ID3" and len(data) >= at + 10 and max(data[at + 6 : at + 10]) < 128:
        n = data[at + 6] << 21 | data[at + 7] << 14 | data[at + 8] << 7 | data[at + 9]
        return f"ID3v2.{data[at + 3]}", 10 + n + 10 * bool(data[at + 5] & 16)
    if data[at : at + 8] == b"APETAGEX" and len(data) >= at + 32:
        size, flags = struct.unpack_from("<I", data, at + 12)[0], struct.unpack_from("<I", data, at + 20)[0]
        return "APEv2", 32 + size - 32 * (not flags >> 29 & 1) if flags >> 29 & 1 else 32
    if data[at : at + 3] == b"TAG" and len(data) - at == 128:
        return "ID3v1", 128
    return None


def _vbr(frame: bytes, h: Header) -> dict | None:
    """The table in a first frame: its kind, frames, bytes and seek points, as far as it has them."""
    at = 4 + 2 * h.protected + h.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, p, out = struct.unpack_from(">I", frame, at + 4)[0], at + 8, {"kind": frame[at : at + 4].decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit and p + 4 <= len(frame):
                out[name] = struct.unpack_from(">I", frame, p)[0]
                p += 4
        if flags & 4 and p + 100 <= len(frame):
            out["seek"] = list(frame[p : p + 100])
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames = struct.unpack_from(">II", frame, 46)
        n, scale, width, per = struct.unpack_from(">HHHH", frame, 54)
        entries = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(n)]
        return {"kind": "VBRI", "bytes": size, "frames": frames, "seek": entries, "frames_per_entry": per}
    return None


def parse(data: bytes) -> Stream:
    """Walk a stream from frame to frame, with resynchronisation after anything that is neither tag nor frame."""
    out, at, sure, headers, crcs = Stream(), 0, False, {}, {}
    end = len(data)
    while at < end:
        four = data[at : at + 4]
        h = headers[four] if four in headers else headers.setdefault(four, parse_header(four))
        if h and at + h.length <= end and not sure:
            after = at + h.length  # out of step: the next header or tag, or the end, must confirm this one
            nxt = parse_header(data[after : after + 4])
            if not (after == end or _tag(data, after) or nxt and (nxt.version, nxt.layer, nxt.rate) == (h.version, h.layer, h.rate)):
                h = None
        if h and at + h.length <= end:
            if h.protected:
                if h.crc_bytes < 0:
                    out.crc_unchecked += 1
                else:
                    covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.crc_bytes]
                    crc = crcs[covered] if covered in crcs else crcs.setdefault(covered, crc16(covered))
                    if crc == data[at + 4] << 8 | data[at + 5]:
                        out.crc_good += 1
                    else:
                        out.crc_bad += 1
            table = _vbr(data[at : at + h.length], h) if not out.offsets and out.table is None and h.layer == 3 else None
            if table:
                out.table = table
            else:
                out.offsets.append(at)
                out.headers.append(h)
            at += h.length
            sure = True
        elif tag := _tag(data, at):
            out.tags.append(tag[0])
            at += tag[1]
        else:
            sure = False
            skip = data.find(b"\xff", at + 1)
            tag_at = data.find(b"TAG", end - 128) if end - at > 128 else -1
            to = end if skip < 0 else skip
            if tag_at == end - 128 and tag_at < to:
                to = tag_at
            id3 = data.find(b"ID3", at + 1, to)
            to = to if id3 < 0 else id3
            out.skipped += to - at
            at = to
    return out


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The bytes that encode() put into the frames of a stream."""
    if not stream.offsets:
        return b""
    at = np.array(stream.offsets)[:, None] + np.arange(len(_PREFIX), len(_PREFIX) + UNIT)
    return np.frombuffer(data, np.uint8)[at].tobytes()


def feature(stream: Stream) -> str:
    """Frames, exact duration in seconds, rate, checksums, tags, the table's kind and a digest of the seek offsets."""
    seek = hashlib.md5(",".join(map(str, stream.offsets)).encode()).hexdigest()
    rates = "+".join(sorted({str(h.rate) for h in stream.headers}))
    table = stream.table or {"kind": "none"}
    return f"frames={len(stream.offsets)};duration={stream.duration};rate={rates};crc={stream.crc_good}/{stream.crc_bad}/{stream.crc_unchecked};tags={'+'.join(stream.tags)};table={table['kind']}:{table.get('frames', '')};skipped={stream.skipped};seek={seek}"


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (of the text in UTF-8) and media, the stream that carries it."""

    def rows(keys: list, texts: list) -> Iterator[tuple]:
        for k, t in zip(keys, texts):
            data = (t or "").encode("utf-8", "surrogatepass")
            yield k, len(data), encode(pad(data))

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, text), rows, f"`{key}` {kind}, n_bytes long, media binary")


def describe(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, frames, duration_num, duration_den (seconds as an exact fraction), frame_offsets, crc_bad, tags, table of streams in column media.

    Null media: no frames, duration 0. Works for any MPEG audio, not only for what store() writes.
    """

    def rows(keys: list, streams: list) -> Iterator[tuple]:
        for k, data in zip(keys, streams):
            s = parse(data or b"")
            yield k, len(s.offsets), s.duration.numerator, s.duration.denominator, s.offsets, s.crc_bad, s.tags, s.table and s.table["kind"]

    kind = media.schema[key].dataType.simpleString()
    return map_rows(media.select(key, "media"), rows, f"`{key}` {kind}, frames long, duration_num long, duration_den long, frame_offsets array<long>, crc_bad long, tags array<string>, vbr_table string")


def read_back(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """What store() stored, read from the stored bytes: payload size and digests, the stream's size and digest, its feature(), its exact duration and frame offsets."""

    def rows(keys: list, sizes: list, streams: list) -> Iterator[tuple]:
        for k, n, data in zip(keys, sizes, streams):
            s = parse(data)
            payload = payload_of(data, s)
            t = s.duration
            yield k, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(s), t.numerator, t.denominator, s.offsets

    kind = media.schema[key].dataType.simpleString()
    columns = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_num long, duration_den long, frame_offsets array<long>"
    return map_rows(media.select(key, F.col("n_bytes"), "media"), rows, f"`{key}` {kind}, {columns}")
