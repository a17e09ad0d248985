"""Readers on files that are written here byte by byte, damaged ones included; reports, and frames as a stream."""

import http.server
import json
import random
import struct
import threading

import pytest
from pyspark.sql import functions as F

from framelake import reports
from framelake.functions.media import _MPEG
from framelake.operators import audit
from framelake.sources import ebml, es, files, media, ts
from framelake.streaming import frames as stream


def box(kind, *parts, wide=False):
    body = b"".join(parts)
    return (struct.pack(">I4sQ", 1, kind, len(body) + 16) if wide else struct.pack(">I4s", len(body) + 8, kind)) + body


def full(kind, flags, *parts, version=0):
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def u32(*values):
    return struct.pack(f">{len(values)}I", *values)


def mp4(fast=True):
    sizes = [100, 40, 60, 120, 30]

    def moov(base):
        entry = box(b"avc1", bytes(24), struct.pack(">HH", 640, 360), bytes(50))
        stbl = box(b"stbl", full(b"stsd", 0, u32(1), entry), full(b"stts", 0, u32(2, 4, 512, 1, 600)), full(b"ctts", 0, u32(2, 1, 1024, 4, 0xFFFFFF00)), full(b"stss", 0, u32(3, 1, 4, 99)),
                   full(b"stsc", 0, u32(2, 1, 2, 1, 2, 3, 1)), full(b"stsz", 0, u32(0, 5, *sizes)), full(b"stco", 0, u32(2, base, base + 1000)))
        mdia = box(b"mdia", full(b"mdhd", 0, u32(0, 0, 12800, 2648, 0)), full(b"hdlr", 0, u32(0), b"vide", bytes(12)), box(b"minf", stbl))
        return box(b"moov", full(b"mvhd", 0, bytes(96)), box(b"trak", full(b"tkhd", 0, u32(0, 0, 7), bytes(68)), mdia), box(b"mvex", full(b"trex", 0, u32(7, 1, 500, 77, 0x10000))))

    head = box(b"ftyp", b"isom", u32(0), b"isommp42")
    base = len(head) + len(moov(0)) + 8 if fast else len(head) + 16
    data = head + (moov(base) + box(b"mdat", bytes(1400)) if fast else box(b"mdat", bytes(1400), wide=True) + moov(base))

    def moof(offset):
        trun = full(b"trun", 0x205, u32(3), struct.pack(">i", offset), u32(0x2000000), u32(10, 20, 30))
        return box(b"moof", full(b"mfhd", 0, u32(1)), box(b"traf", full(b"tfhd", 0x20000, u32(7)), full(b"tfdt", 0, u32(9000)), trun))

    frag = moof(len(moof(0)) + 8)
    return data + frag + box(b"mdat", bytes(60)), base, len(data)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("media")


def rows(spark, folder, name, data):
    path = folder / name
    path.write_bytes(data)
    return spark.createDataFrame([(str(path),)], "path string")


def test_mp4(spark, folder):
    for fast in (True, False):
        data, base, end = mp4(fast)
        f = rows(spark, folder, f"a{fast}.mp4", data)
        s = media.samples(f).orderBy("i").collect()
        assert [(r.offset, r.size) for r in s[:5]] == [(base, 100), (base + 100, 40), (base + 1000, 60), (base + 1060, 120), (base + 1180, 30)]
        assert [r.dts for r in s[:5]] == [0, 512, 1024, 1536, 2048] and [r.duration for r in s[:5]] == [512] * 4 + [600] and [r.cto for r in s[:5]] == [1024] + [-256] * 4
        assert [r.key for r in s] == [True, False, False, True, False, True, False, False] and {r.timescale for r in s} == {12800}
        moof = s[5].offset - end
        assert [(r.offset - end - moof, r.size, r.dts, r.duration) for r in s[5:]] == [(0, 10, 9000, 500), (10, 20, 9500, 500), (30, 30, 10000, 500)]
        t = media.tracks(f).collect()
        assert [(r.format, r.track, r.kind, r.codec, r.width, r.height, r.timescale) for r in t] == [("isobmff", 7, "video", "avc1", 640, 360, 12800)]
        n = {r.type: r for r in media.nodes(f).collect()}
        assert (n["moov"].offset < n["mdat"].offset if fast else True) and n["stsz"].depth == 5 and all(not r.warnings for r in n.values())
        assert media.tree(media.nodes(f)).count() == len(media.nodes(f).collect())


def flv():
    def tag(kind, time, body):
        return struct.pack(">B", kind) + len(body).to_bytes(3, "big") + (time & 0xFFFFFF).to_bytes(3, "big") + bytes([time >> 24 & 255]) + bytes(3) + body + struct.pack(">I", len(body) + 11)

    name = lambda t: struct.pack(">H", len(t)) + t.encode()
    meta = b"\x02" + name("onMetaData") + b"\x08" + struct.pack(">I", 2) + name("width") + b"\0" + struct.pack(">d", 320) + name("height") + b"\0" + struct.pack(">d", 180) + b"\0\0\x09"
    video = lambda key, kind, cto, n: bytes([0x17 if key else 0x27, kind]) + cto.to_bytes(3, "big", signed=True) + bytes(n)
    good = [tag(18, 0, meta), tag(9, 0, video(True, 0, 0, 5)), tag(8, 0, b"\xaf\0ab"), tag(9, 0, video(True, 1, 80, 50)), tag(8, 10, b"\xaf\1abcd"), tag(9, 40, video(False, 1, 0, 20)), tag(9, 80, video(False, 1, -40, 30))]
    head = b"FLV\1\5" + struct.pack(">II", 9, 0)
    return head + b"".join(good[:5]) + b"\xee" * 37 + b"".join(good[5:])


def test_flv(spark, folder):
    f = rows(spark, folder, "a.flv", flv())
    s = media.samples(f).where("track = 1").orderBy("i").collect()
    assert [(r.size, r.dts, r.cto, r.key, r.duration) for r in s] == [(50, 0, 80, True, 40), (20, 40, 0, False, 40), (30, 80, -40, False, 40)]
    assert [(r.size, r.dts) for r in media.samples(f).where("track = 2").collect()] == [(4, 10)]
    assert {(r.kind, r.codec, r.width) for r in media.tracks(f).collect()} == {("video", "avc", 320), ("audio", "aac", None)}
    assert [r.size for r in media.nodes(f).where("type = 'lost'").collect()] == [37]


def section(table, ext, body, version=0):
    n = 5 + len(body) + 4
    s = bytes([table, 0xB0 | n >> 8, n & 255]) + struct.pack(">H", ext) + bytes([0xC1 | version << 1, 0, 0]) + body
    crc = 0xFFFFFFFF
    for b in s:
        crc = (crc << 8 & 0xFFFFFFFF) ^ int(_MPEG[crc >> 24 ^ b])
    return s + struct.pack(">I", crc)


def stamp(mark, t):
    return bytes([mark << 4 | t >> 29 & 14 | 1, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])


def transport(size=188):
    counters = {}

    def packet(pid, payload, start=False, access=False, pcr=None):
        c = counters.get(pid, 0)
        counters[pid] = (c + 1) % 16
        field = b""
        if access or pcr is not None or len(payload) < 184:
            flags = (0x40 if access else 0) | (0x10 if pcr is not None else 0)
            extra = struct.pack(">I", pcr >> 1) + bytes([(pcr & 1) << 7 | 0x7E, 0]) if pcr is not None else b""
            room = 184 - len(payload)
            field = bytes([room - 1]) + (bytes([flags]) + extra + b"\xff" * (room - 2 - len(extra)) if room > 1 else b"")
        return bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, (0x30 if field else 0x10) | c]) + field + payload

    pat, pmt = section(0, 1, struct.pack(">HH", 1, 0xE100)), section(2, 1, struct.pack(">HH", 0xE101, 0xF000) + struct.pack(">BHH", 0x1B, 0xE101, 0xF000))
    out = [packet(0, b"\0" + pat, True), packet(0x100, b"\0" + pmt, True)]
    for k in range(6):
        dts = ((1 << 33) - 7200 + 3600 * k) % (1 << 33)
        body = bytes([k]) * (300 + k)
        pes = b"\0\0\1\xe0" + struct.pack(">H", 13 + len(body)) + b"\x80\xc0\x0a" + stamp(3, (dts + 3600) % (1 << 33)) + stamp(1, dts) + body
        out.append(packet(0x101, pes[:150], True, access=k % 3 == 0, pcr=dts))
        out += [packet(0x101, pes[a : a + 184]) for a in range(150, len(pes), 184)]
        out.append(packet(0, b"\0" + pat, True))
    pad = {188: (b"", b""), 192: (b"\1\2\3\4", b""), 204: (b"", b"\0" * 16)}[size]
    return [pad[0] + p + pad[1] for p in out]


@pytest.mark.parametrize("size", [188, 192, 204])
def test_ts(spark, folder, size):
    packets = transport(size)
    f = rows(spark, folder, f"a{size}.ts", b"".join(packets[:10]) + b"\x55" * 77 + b"".join(packets[10:]))
    s = media.samples(f).orderBy("i").collect()
    assert [r.size for r in s] == [300 + k for k in range(6)] and [r.dts - s[0].dts for r in s] == [3600 * k for k in range(6)] and {r.cto for r in s} == {3600}
    assert [r.key for r in s] == [True, False, False, True, False, False] and [(r.kind, r.codec) for r in media.tracks(f).collect()] == [("video", "avc")]
    assert [r.size for r in media.nodes(f).collect()] == [77]
    p = media.ts_packets(f).collect()
    assert len(p) == len(packets) and sum(r.pcr is not None for r in p) == 6 and {r.ended for r in media.pes_packets(f).collect()} == {"whole"}
    found = ts.read(files.open_range(str(folder / f"a{size}.ts")))
    assert [x["table"] for x in found["sections"]] == [0, 2] and all(x["ok"] for x in found["sections"])


def test_wav_and_avi(spark, folder):
    chunk = lambda kind, body: kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    wav = chunk(b"RIFF", b"WAVE" + chunk(b"fmt ", struct.pack("<HHIIHH", 1, 2, 8000, 32000, 4, 16)) + chunk(b"odd ", b"abc") + chunk(b"data", bytes(8000)))
    f = rows(spark, folder, "a.wav", wav)
    s = media.samples(f).orderBy("i").collect()
    assert [(r.size, r.dts, r.duration) for r in s] == [(3200, 0, 800), (3200, 800, 800), (1600, 1600, 400)] and s[0].offset == wav.index(b"data") + 8
    strh = b"vids" + b"H264" + bytes(12) + struct.pack("<II", 1001, 30000) + bytes(16) + struct.pack("<I", 0)
    strl = b"strl" + chunk(b"strh", strh) + chunk(b"strf", struct.pack("<IiiHH", 40, 64, -48, 1, 24) + b"H264" + bytes(20))
    frames = [b"a" * 11, b"b" * 6, b"c" * 9]
    movi, index, at = b"movi", b"", 4
    for k, x in enumerate(frames):
        index += b"00dc" + struct.pack("<III", 0x10 if k == 0 else 0, at, len(x))
        movi += chunk(b"00dc", x)
        at += 8 + len(x) + (len(x) & 1)
    for with_index in (True, False):
        avi = chunk(b"RIFF", b"AVI " + chunk(b"LIST", b"hdrl" + chunk(b"LIST", strl)) + chunk(b"LIST", movi) + (chunk(b"idx1", index) if with_index else b""))
        f = rows(spark, folder, f"a{with_index}.avi", avi)
        s = media.samples(f).orderBy("i").collect()
        assert [(avi[r.offset : r.offset + r.size], r.dts) for r in s] == [(x, 1001 * k) for k, x in enumerate(frames)] and [r.key for r in s] == ([True, False, False] if with_index else [True] * 3)
        assert [(r.codec, r.timescale, r.width, r.height) for r in media.tracks(f).collect()] == [("H264", 30000, 64, 48)]


def element(ident, body, unknown=False):
    return bytes.fromhex(ident) + (b"\x01\xff\xff\xff\xff\xff\xff\xff" if unknown else struct.pack(">Q", len(body) | 1 << 56)) + body


def matroska(unknown=False, damage=b""):
    entry = element("ae", element("d7", b"\1") + element("83", b"\1") + element("86", b"V_VP9") + element("e0", element("b0", b"\2\0") + element("ba", b"\1\0")))
    sound = element("ae", element("d7", b"\2") + element("83", b"\2") + element("86", b"A_OPUS") + element("23e383", struct.pack(">I", 20_000_000)))
    block = lambda track, time, flags, body: bytes([0x80 | track]) + struct.pack(">hB", time, flags) + body
    c1 = element("e7", b"\0") + element("a3", block(1, 0, 0x80, b"k" * 30)) + element("a3", block(2, 0, 0x82, b"\2\3\4" + b"x" * 3 + b"y" * 4 + b"z" * 5)) + element("a0", element("a1", block(1, 40, 0, b"p" * 20)) + element("fb", b"\xff"))
    c2 = element("e7", b"\x64") + element("a3", block(1, 0, 0x80, b"k" * 10)) + element("a3", block(2, 0, 0x86, b"\2\x84\xbe" + b"a" * 4 + b"b" * 3 + b"c" * 6))
    segment = element("1549a966", element("2ad7b1", b"\x0f\x42\x40")) + element("1654ae6b", entry + sound) + element("1f43b675", c1, unknown) + damage + element("1f43b675", c2, unknown)
    return element("1a45dfa3", element("4282", b"webm")) + element("18538067", segment, unknown)


@pytest.mark.parametrize("unknown, damage", [(False, b""), (True, b""), (False, b"\0" * 33)])
def test_matroska(spark, folder, unknown, damage):
    data = matroska(unknown, damage)
    f = rows(spark, folder, f"a{unknown}{len(damage)}.webm", data)
    video = media.samples(f).where("track = 1").orderBy("i").collect()
    assert [(r.size, r.pts, r.key) for r in video] == [(30, 0, True), (20, 40, False), (10, 100, True)]
    sound = media.samples(f).where("track = 2").orderBy("i").collect()
    assert [data[r.offset : r.offset + r.size] for r in sound] == [b"xxx", b"yyyy", b"zzzzz", b"aaaa", b"bbb", b"cccccc"] and [r.pts for r in sound] == [0, 20, 40, 100, 120, 140]
    assert {(r.kind, r.codec, r.width) for r in media.tracks(f).collect()} == {("video", "V_VP9", 512), ("audio", "A_OPUS", None)}
    assert [r.size for r in media.nodes(f).where("type = 'damage'").collect()] == ([len(damage)] if damage else [])


def test_laces_and_numbers():
    assert ebml.vint(b"\x40\x02", 0) == (2, 2) and ebml.vint(b"\xff", 0) == (None, 1) and ebml.vint(b"\x1a\x45\xdf\xa3", 0, True)[0] == 0x1A45DFA3
    assert ebml.laces(b"\2" + b"ab" * 3, 0, 2) == [(1, 2), (3, 2), (5, 2)] and ebml.laces(b"\1\xff\1" + bytes(300), 0, 1) == [(3, 256), (259, 44)]
    assert es.leb128(b"\xe5\x8e\x26", 0) == (624485, 3)


def bits(*fields):
    text = ""
    for kind, value in fields:
        if kind == "ue":
            code = bin(value + 1)[2:]
            text += "0" * (len(code) - 1) + code
        else:
            text += format(value, f"0{kind}b")
    text += "1"
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


def test_h264(spark, folder):
    sps = b"\x67" + bits((8, 77), (8, 0), (8, 31), ("ue", 0), ("ue", 0), ("ue", 0), ("ue", 0), ("ue", 2), (1, 0), ("ue", 19), ("ue", 11), (1, 1), (1, 1), (1, 1), ("ue", 0), ("ue", 0), ("ue", 0), ("ue", 6), (1, 1), (1, 0), (1, 0), (1, 0), (1, 0), (1, 1), (32, 1), (32, 50), (1, 1))
    sps = sps.replace(b"\0\0\1", b"\0\0\3\1")
    got = es.avc_sps(sps)
    assert (got["profile"], got["level"], got["refs"], got["width"], got["height"], got["fps"]) == (77, 31, 2, 320, 180, 25.0)
    nal = lambda head, kind: b"\0\0\0\1" + bytes([head]) + bits(("ue", 0), ("ue", kind), (8, 0xAA)) + b"\x77" * 9
    data = b"\0\0\0\1" + sps + b"\0\0\0\1\x68\xce" + nal(0x65, 7) + nal(0x41, 5) + nal(0x01, 6) + nal(0x65, 7)
    f = rows(spark, folder, "a.h264", data)
    s = media.samples(f).orderBy("i").collect()
    assert [r.letter for r in s] == ["I", "P", "B", "I"] and [r.key for r in s] == [True, False, False, True] and [r.dts for r in s] == [0, 3600, 7200, 10800] and sum(r.size for r in s) == len(data)


def test_frame_types(spark, folder):
    cases = [
        ("vp9", b"\x82\x49\x83\x42", "I", True), ("vp9", b"\x86\x00\x00", "P", False), ("vp9", b"\x88", "=", False), ("vp8", b"\x10\0\0", "I", True), ("vp8", b"\x11\0\0", "P", False),
        ("av1", b"\x12\0\x0a\x01\0\x32\x02\x10\0", "I", True), ("av1", b"\x12\0\x32\x02\x30\0", "P", False), ("av1", b"\x1a\x01\x80", "=", False), ("mpeg2v", b"\0\0\1\xb3" + bytes(8) + b"\0\0\1\0\0\x08\0\0", "I", True), ("mpeg2v", b"\0\0\1\0\0\x18\0\0", "B", False),
        ("mpeg4v", b"\0\0\1\xb6\x50", "P", False), ("mpeg4v", b"\0\0\1\xb6\x10", "I", True), ("vp6", b"\x00", "I", True), ("vp6a", b"\0\0\0\x80", "P", False), ("h263s", b"\0\0\x84\0\2\0\0", "I", True), ("hevc", b"\0\0\0\4\x26\1\xaa\xaa", "I", True), ("avc", b"\0\0\0\4\x65\x88\x80\x10", "I", True), ("xyz", b"a", "?", False),
    ]
    for family, data, kind, rap in cases:
        got = es.classify(family, data, {}, 4 if family in ("avc", "hevc") else None)
        assert (got["kind"], got["rap"]) == (kind, rap), (family, got)
    f = rows(spark, folder, "types.h264", b"\0\0\0\1\x65" + bits(("ue", 0), ("ue", 7), (8, 1)) + bytes([9] * 9) + b"\0\0\0\1\x41" + bits(("ue", 0), ("ue", 5), (8, 1)) + bytes([9] * 9))
    assert [(r.letter, r.rap, r.ref) for r in media.frame_types(f).orderBy("i").collect()] == [("I", True, True), ("P", False, True)]


def test_audio(spark, folder):
    from framelake.sources import audio

    frame = lambda n: audio.adts_header(n, 44100, 2) + bytes([n % 251]) * n
    data = b"junk" + b"".join(frame(n) for n in (100, 250, 180, 90))
    framer, found, at = audio.Framer("aac"), [], 0
    for size in (50, 7, 300, 1, 1000):
        found += framer.feed(data[at : at + size], 5000 + at)
        at += size
    found += framer.finish()
    assert [(x.offset, x.size, x.samples, x.rate, x.channels) for x in found] == [(5004, 107, 1024, 44100, 2), (5111, 257, 1024, 44100, 2), (5368, 187, 1024, 44100, 2), (5555, 97, 1024, 44100, 2)] and framer.lost == 4
    assert audio.mpeg_audio(b"\xff\xfb\x90\x00", 0) == (417, 1152, 44100, 2) and audio.mpeg_audio(b"\xff\xf3\x40\xc0", 0) == (104, 576, 22050, 1) and audio.ac3(b"\x0b\x77\0\0\x14\x40\x43\0\0", 0) == (768, 1536, 48000, 2)
    assert audio.audio_specific_config(b"\x12\x10") == {"object_type": 2, "sample_rate": 44100, "channels": 2} and audio.audio_specific_config(bytes.fromhex("2b8a0800"))["extension"] == 5
    assert audio.opus_head(b"OpusHead\1\2\x38\1\x80\xbb\0\0\0\0\0") == {"channels": 2, "skip": 312, "sample_rate": 48000}
    assert audio.flac_info(b"fLaC\0\0\0\x22" + bytes(10) + (44100 << 44 | 1 << 41 | 15 << 36 | 1000).to_bytes(8, "big") + bytes(16)) == {"sample_rate": 44100, "channels": 2, "bits": 16, "samples": 1000}
    f = rows(spark, folder, "extract.flv", flv())
    got = media.extracted_audio(f, 2, 44100, 2).collect()[0].data
    assert bytes(got) == audio.adts_header(4, 44100, 2) + b"abcd"


def test_damaged_files_give_rows(spark, folder):
    rng = random.Random(20)
    paths = []
    for k, data in enumerate([mp4()[0], flv(), b"".join(transport()), matroska(), matroska(True)] * 6):
        data = bytearray(data[: rng.randrange(20, len(data))] if k % 2 else data)
        for _ in range(rng.randrange(1, 12)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        path = folder / f"fuzz{k}"
        path.write_bytes(bytes(data))
        paths.append((str(path),))
    paths.append((str(folder / "none"),))
    f = spark.createDataFrame(paths, "path string").repartition(4)
    s = media.samples(f)
    assert s.where("size < 0 or offset < 0").count() == 0 and media.nodes(f).count() > 0 and media.tracks(f).count() > 0
    assert "none" in {r.file.rsplit("/", 1)[1] for r in media.errors(f).collect()}


def test_listing_and_digests(spark, folder):
    import hashlib

    at = folder / "list"
    (at / ".hidden").mkdir(parents=True)
    (at / "sub").mkdir()
    for name in ("ep10.mp4", "ep9.mp4", "notes.txt", ".x.mp4", "sub/ep1.mkv"):
        (at / name).write_bytes(name.encode() * 100)
    name = lambda r: r.path.rsplit("/", 1)[1]
    assert [name(r) for r in files.listing(spark, str(at)).collect()] == ["ep9.mp4", "ep10.mp4"]
    assert {name(r) for r in files.listing(spark, str(at), recursive=True).collect()} == {"ep9.mp4", "ep10.mp4", "ep1.mkv"}
    path = str(at / "ep9.mp4")
    f = spark.createDataFrame([(path,)], "path string")
    got = media.range_digests(f, spark.createDataFrame([(path, 5, 50)], "path string, offset long, size long")).collect()
    assert got[0].sha256 == hashlib.sha256((b"ep9.mp4" * 100)[5:55]).hexdigest()


def test_http_ranges():
    data = bytes(range(256)) * 2000
    busy = [2]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/busy" and busy[0]:
                busy[0] -= 1
                self.send_response(503)
                self.end_headers()
                return
            span = self.headers.get("Range")
            if span and self.path != "/whole":
                a, b = (int(x) for x in span[6:].split("-"))
                body = data[a : b + 1]
                self.send_response(206)
                self.send_header("Content-Range", f"bytes {a}-{a + len(body) - 1}/{len(data)}")
            else:
                body = data
                self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            return

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    for path in ("/file", "/busy", "/whole"):
        source = files.HttpRange(f"http://127.0.0.1:{server.server_port}{path}", wait=0.01)
        assert source.size == len(data) and source.read(70_000, 300) == data[70_000:70_300] and source.read(len(data) - 5, 50) == data[-5:]
    server.shutdown()


def test_reports(spark):
    rows_ = [("a.mp4", 0, "even-size", "file", "Video", "fail", "critical", "h264", "7.4", "3x3", None, 12), ("a.mp4", 1, "codec", "file", "Video", "pass", None, "hlsAuth", "1.1", "avc", None, None), ("b.mp4", 0, "range", "file", "Colour", "warn", "warning", "h273", "x", "true", None, None)]
    checks = spark.createDataFrame(rows_, "entity string, place int, id string, scope string, category string, level string, severity string, spec string, clause string, value string, expected string, offset long")
    report = {r.entity: json.loads(r.json) for r in reports.json_report(reports.combined(checks.where("entity = 'a.mp4'"), checks.where("entity = 'b.mp4'"))).collect()}
    assert report["a.mp4"]["summary"]["n_fail"] == 1 and report["a.mp4"]["summary"]["compliance"] == 500 and [c["id"] for c in report["a.mp4"]["checks"]] == ["even-size", "codec"]
    text = {r.entity: r.text for r in reports.markdown(checks).collect()}["a.mp4"]
    assert text.splitlines()[0] == "## a.mp4" and text.index("even-size") < text.index("codec")
    log = json.loads(reports.sarif(checks).collect()[0].sarif)
    run = log["runs"][0]
    assert log["version"] == "2.1.0" and len(run["tool"]["driver"]["rules"]) == len(audit.ALL_RULES) and {(r["ruleId"], r["level"]) for r in run["results"]} == {("even-size", "error"), ("range", "warning")}
    assert [r["locations"][0]["physicalLocation"].get("region") for r in run["results"] if r["ruleId"] == "even-size"] == [{"byteOffset": 12}]
    assert reports.exit_code(checks) == 2 and reports.exit_code(checks.where("entity = 'b.mp4'")) == 1 and reports.exit_code(checks.where("level = 'pass'")) == 0
    assert reports.exit_code(checks, input_errors=1) == 3 and reports.exit_code(checks, decoder_missing=True) == 70


def test_streams(spark, tmp_path):
    schema = "track long, i long, size long, key boolean, t timestamp"
    for part in range(2):
        df = spark.range(part * 20, part * 20 + 20).select(F.lit(1).cast("long").alias("track"), F.col("id").alias("i"), F.lit(10).cast("long").alias("size"), (F.col("id") % 8 == 3).alias("key"), F.timestamp_seconds(F.col("id") * 2).alias("t"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, df, mode in (("gops", stream.gop_sessions(read()), "append"), ("slices", stream.slices(read(), "t", "10 seconds"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
    got = {(r.gop, r.first_i, r.frames, r.bytes, r.partial) for r in spark.table("gops").collect()}
    assert got == {(0, 0, 3, 30, True), (1, 3, 8, 80, False), (2, 11, 8, 80, False), (3, 19, 8, 80, False), (4, 27, 8, 80, False)}
    assert {r.bits for r in spark.table("slices").collect()} == {400} and spark.table("slices").count() == 8
