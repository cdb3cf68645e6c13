import hashlib
import struct
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ampliweave.llm import mpeg
from ampliweave.llm.queries import op7_mpeg_audio


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=3000) | st.lists(st.sampled_from([b"\xff\xfb\xb4\xc0", b"\xff" * 40, b"TAG", b"ID3\3\0\0\0\0\0\0"]), max_size=90).map(b"".join))
def test_round_trip(data):
    payload = mpeg.pad(data)
    assert len(payload) % 576 == 0 and len(payload) > 0 and payload[: len(data)] == data and set(payload[len(data) :]) <= {255}
    media = mpeg.encode(payload)
    s = mpeg.parse(media)
    assert mpeg.payload_of(media, s) == payload and s.crc_bad == s.skipped == 0 and s.crc_good == len(s.offsets) + 1
    assert s.table["frames"] == len(s.offsets) == len(payload) // 576 and s.duration == Fraction(1152 * len(s.offsets), 48000)


def test_crc_bit_by_bit():
    def slow(data):
        crc = 0xFFFF
        for b in data:
            for i in range(7, -1, -1):
                top = crc >> 15 ^ (b >> i & 1)
                crc = crc << 1 & 0xFFFF ^ (0x8005 if top else 0)
        return crc

    assert all(mpeg.crc16(bytes(range(i, i + 30))) == slow(bytes(range(i, i + 30))) for i in range(0, 200, 7))


@pytest.mark.parametrize(
    "four, want",
    [
        (b"\xff\xfb\x90\x00", (3, 3, 44100, 417, 1152)),  # 128 kbit/s, MPEG 1 Layer III
        (b"\xff\xfb\x92\x00", (3, 3, 44100, 418, 1152)),
        (b"\xff\xf3\x80\x00", (2, 3, 22050, 208, 576)),  # 64 kbit/s, MPEG 2 Layer III
        (b"\xff\xfd\x80\x00", (3, 2, 44100, 417, 1152)),
        (b"\xff\xff\x10\x00", (3, 1, 44100, 32, 384)),
    ],
)
def test_headers(four, want):
    h = mpeg.parse_header(four)
    assert (h.version, h.layer, h.rate, h.length, h.samples) == want


def test_damage_tags_and_tables():
    clean = mpeg.encode(bytes(range(256)) * 9)
    junk = b"\xff\xfb\x90\x00 no frame \xff\xe0"
    broken = clean[:20] + junk + clean[20:] + b"TAG" + bytes(125)
    s = mpeg.parse(junk + clean + b"TAG" + bytes(125))
    assert len(s.offsets) == 4 and s.skipped == len(junk) and s.tags == ["ID3v2.3", "ID3v1"]
    assert len(mpeg.parse(broken).offsets) >= 4
    flipped = bytearray(clean)
    flipped[mpeg.parse(clean).offsets[1] + 8] ^= 1
    assert mpeg.parse(bytes(flipped)).crc_bad == 1
    vbri = b"\xff\xfb\x90\x00" + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 8340, 20, 2, 1, 2, 10) + struct.pack(">HH", 4170, 4170)
    t = mpeg.parse(vbri.ljust(417, b"\0") + (b"\xff\xfb\x90\x00".ljust(417, b"\0")) * 20)
    assert t.table == {"kind": "VBRI", "bytes": 8340, "frames": 20, "seek": [4170, 4170], "frames_per_entry": 10} and len(t.offsets) == 20
    assert mpeg.parse(b"").offsets == [] and mpeg.parse(b"\xff").skipped == 1


def test_tables(spark):
    long = "ñ" * 300_000
    docs = spark.createDataFrame([(1, "a", "m"), (1, "a", "m"), (None, None, None), (2, "", ""), (3, long, "")], "doc_id long, text string, media string")
    got = {(r.doc_id): r for r in mpeg.read_back(mpeg.store(docs)).collect()}
    assert mpeg.read_back(mpeg.store(docs)).count() == 5 and mpeg.read_back(mpeg.store(docs.limit(0))).count() == 0
    want = mpeg.pad(long.encode())
    assert got[3].payload_sha256 == hashlib.sha256(want).hexdigest() and got[3].n_bytes == 600_000 and got[3].tail_crc32 == zlib.crc32(want[-32:])
    assert got[None].payload_bytes == 576 and got[None].feature == got[2].feature and got[2].n_bytes == 0
    d = mpeg.describe(mpeg.store(docs)).where("doc_id = 3").first()
    assert d.frames == len(want) // 576 and Fraction(d.duration_num, d.duration_den) == Fraction(d.frames * 1152, 48000)


def test_query_against_a_plain_version(spark, tmp_path):
    texts = [None, "", "a", "b" * 576, "c" * 577, "é😀 " * 900, "a", "\xff" * 40_000]
    spark.createDataFrame([(i if i != 3 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, feature string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(op7_mpeg_audio(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    tag = 10 + 10 + 1 + 8
    for r, t in zip(got, [texts[3], *texts[:3], *texts[4:]]):
        data = (t or "").encode()
        padded = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        frames = len(padded) // 576
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert r.frame_offsets == [tag + 672 * (1 + i) for i in range(frames)] and r.media_bytes == tag + 672 * (1 + frames)
        assert Fraction(r.duration_num, r.duration_den) == Fraction(1152 * frames, 48_000)
    assert len({r.feature for r in got if r.n_bytes == 1}) == 1 and len(got) == len(texts)
