"""Scalar functions over tracks, codecs, encoder options, bytes, numbers and dates, as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType


def _first(*cases: tuple[Column, object]) -> Column:
    out = F
    for on, value in cases:
        out = out.when(on, value)
    return out


# tracks


def seconds(ticks: Column, *scales: Column) -> Column:
    """Ticks by the first time scale that is known; 0 counts as unknown, and without any it is 1."""
    return ticks / F.coalesce(*[F.nullif(s, F.lit(0)) for s in scales], F.lit(1))


def kind_rank(kind: Column) -> Column:
    """Video first, then audio, then the rest."""
    return F.when(kind == "video", 0).when(kind == "audio", 1).otherwise(2)


def bits_per_pixel(bitrate: Column, width: Column, height: Column, fps: Column) -> Column:
    """Bits spent on a pixel of a frame."""
    return F.try_divide(bitrate.cast("double"), width * height * fps)


def frame_size(props: Column) -> Column:
    """(width, height) from a track's properties, by the first of four that has them."""
    found = [F.regexp_extract_all(F.try_element_at(props, F.lit(k)), F.lit(r"(\d+)\s*[×x]\s*(\d+)"), 0) for k in ("coded size", "display size", "size", "resolution")]
    text = F.coalesce(*[F.try_element_at(f, F.lit(1)) for f in found])
    side = lambda k: F.regexp_extract(text, r"(\d+)\s*[×x]\s*(\d+)", k).try_cast("int")
    return F.when(text.isNotNull(), F.struct(side(1).alias("width"), side(2).alias("height")))


def fast_start(moov: Column, mdat: Column, fragmented: Column) -> Column:
    """Whether a file can play before all of it is there; null where it has no index."""
    return F.when(fragmented, True).when(moov.isNotNull() & mdat.isNotNull(), moov < mdat)


# codecs


def codec_family(fourcc: Column) -> Column:
    """(P11)"""
    families = [
        ("^(avc[1-4]|dva1|dvav)$", "avc"), ("^(hvc[1-3]|hev[1-3]|dvh1|dvhe|lhv1|lhe1)$", "hevc"), ("^(av01|dav1)$", "av1"), ("^vp09$", "vp9"), ("^vp08$", "vp8"), ("^mp4a$", "aac"),
        (r"^(\.mp3|mp3 )$", "mp3"), ("^ac-3$", "ac3"), ("^ec-3$", "eac3"), ("^(tx3g|text)$", "tx3g"), ("^tmcd$", "tmcd"), ("^[Oo]pus$", "opus"),
    ]
    return _first(*[(fourcc.rlike(p), name) for p, name in families])


def audio_codec(codec_string: Column, name: Column) -> Column:
    """One name for an audio codec, whatever the container calls it."""
    cs, n = F.coalesce(codec_string, F.lit("")), F.coalesce(name, F.lit(""))
    aac = F.regexp_extract(cs, r"^mp4a\.40\.(\d+)$", 1)
    return _first(
        (aac == "2", "AAC LC"), (aac == "5", "HE-AAC"), (aac == "29", "HE-AAC v2"), (aac != "", "AAC"), (n.rlike(r"\bAAC\b"), "AAC"), (n.rlike(r"Layer II\b"), "MP2"), (n.rlike(r"\bMP3\b|Layer III"), "MP3"),
        ((cs == "ec-3") | n.rlike("^E-AC-3"), "E-AC-3"), ((cs == "ac-3") | n.rlike("^AC-3"), "AC-3"), (cs.rlike("(?i)^opus$") | n.rlike("^Opus"), "Opus"), (cs.rlike("(?i)^flac$") | n.rlike("^FLAC"), "FLAC"),
        (cs.rlike("(?i)^vorbis$") | n.rlike("^Vorbis"), "Vorbis"), (n.rlike("^PCM"), "PCM"), (n != "", n),
    )


def video_codec(family: Column) -> Column:
    """(P12)"""
    names = {"avc": "H.264 / AVC", "hevc": "H.265 / HEVC", "av1": "AV1", "vp9": "VP9", "vp8": "VP8", "mpeg2v": "MPEG-2 Video", "mpeg4v": "MPEG-4 Part 2", "h263s": "Sorenson H.263", "vp6": "VP6", "vp6a": "VP6 with alpha"}
    return _first(*[(family == k, v) for k, v in names.items()])


def codec_facts(codec_string: Column) -> Column:
    """(family, profile, level, high_tier, depth) from a codec string of RFC 6381; null for others."""
    part = lambda p, k: F.nullif(F.regexp_extract(codec_string, p, k), F.lit(""))
    avc, hevc = r"(?i)^avc[1-4]\.([0-9a-f]{2})([0-9a-f]{2})([0-9a-f]{2})$", r"(?i)^(?:hvc1|hev1)\.[A-C]?(\d+)\.[0-9A-F]+\.([LH])(\d+)"
    av1, vp9 = r"^av01\.(\d)\.(\d\d)([MH])\.(\d\d)", r"^vp09\.(\d\d)\.(\d\d)\.(\d\d)"
    hexed = lambda k: F.conv(part(avc, k), 16, 10).cast("int")
    num = lambda p, k: part(p, k).try_cast("int")
    fact = lambda family, profile, level, high, depth: F.struct(F.lit(family).alias("family"), profile.alias("profile"), level.alias("level"), high.cast("boolean").alias("high_tier"), depth.cast("int").alias("depth"))
    none = F.lit(None)
    return _first(
        (codec_string.rlike(avc), fact("avc", hexed(1), hexed(3), none, none)), (codec_string.rlike(hevc), fact("hevc", num(hevc, 1), num(hevc, 3), F.upper(part(hevc, 2)) == "H", none)),
        (codec_string.rlike(av1), fact("av1", num(av1, 1), num(av1, 2), part(av1, 3) == "H", num(av1, 4))), (codec_string.rlike(vp9), fact("vp9", num(vp9, 1), num(vp9, 2), none, num(vp9, 3))),
    )


# Types and flags of frames.
UNKNOWN, I, P, B, S, REPEAT = range(6)  # noqa: E741
REF, NONREF, RAP, CLOSED, LEADING, SKIPPABLE, HIDDEN, RECOVERY = (1 << k for k in range(8))


def frame_letter(kind: Column, flags: Column) -> Column:
    """I, P (p where nothing refers to it), B (b where nothing does), S, = for a repeat, ? else (P10)."""
    on = lambda bit: flags.bitwiseAND(bit) != 0
    return F.when(kind == I, "I").when(kind == P, F.when(on(NONREF), "p").otherwise("P")).when(kind == B, F.when(on(REF), "B").otherwise("b")).when(kind == S, "S").when(kind == REPEAT, "=").otherwise("?")


# encoder options


def x264_options(text: Column) -> Column:
    """The options after ``options:`` as a map; an option without a value is 1, of equal names the last counts."""
    return _options(F.regexp_extract(text, r"(?s)options:\s*(.*)$", 1), off=False)


def x265_options(text: Column) -> Column:
    """As :func:`x264_options`, for the other encoder's way of writing: missing blanks and names of several words are
    mended, ``no-name`` is name=0, windows and zones are one option each (T10)."""
    s = F.regexp_extract(text, r"(?s)options:\s*(.*)$", 1)
    for wrong, right in (
        (r"(\S)(conformance-window-offsets)", "$1 $2"), (r"(\S)scc=(\d)", "$1 scc=$2"), (r"(^|\s)Level 0,1,2=(\S+)", "$1hme-search=$2"), (r"(^|\s)merange L0,L1,L2=(\S+)", "$1hme-range=$2"),
        (r"sar-width : sar-height=(\S+)", "sar-width:sar-height=$1"),
        (r"zones: start-frame=(\S+) end-frame=(\S+) qp=(\S+)", "zones=$1,$2,q=$3"), (r"zones: start-frame=(\S+) end-frame=(\S+) bitrate-factor=(\S+)", "zones=$1,$2,b=$3"),
        (r"display-window=(?!0(\s|$))\S* left=(\S+) top=(\S+) right=(\S+) bottom=(\S+)", "display-window=$2,$3,$4,$5"), (r"conformance-window-offsets right=(\S+) bottom=(\S+)", "conformance-window-offsets=right=$1\u0000bottom=$2"),
    ):
        s = F.regexp_replace(s, wrong, right)
    return _options(s, off=True)


def _options(text: Column, off: bool) -> Column:
    tokens = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
    key = lambda t: F.substring_index(t, "=", 1)
    has = lambda t: F.locate("=", t) > 1
    value = lambda t: F.translate(F.substring(t, F.locate("=", t) + 1, F.length(t)), "\u0000", " ")
    bare = lambda t: F.when(F.lit(off) & t.startswith("no-"), F.struct(F.substring(t, F.lit(4), F.length(t)).alias("key"), F.lit("0").alias("value"))).otherwise(F.struct(t.alias("key"), F.lit("1").alias("value")))
    pairs = F.transform(tokens, lambda t: F.when(has(t), F.struct(key(t).alias("key"), value(t).alias("value"))).otherwise(bare(t)))
    names = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    joined = lambda n: F.transform(F.filter(pairs, lambda p: p["key"] == n), lambda p: p["value"])
    one = lambda n: F.when(n == "zones", F.array_join(joined(n), "/")).otherwise(F.element_at(joined(n), -1))
    return F.map_from_arrays(names, F.transform(names, one))


def rate_control(encoder: Column, options: Column) -> Column:
    """(mode, crf, qp, bitrate, maxrate, bufsize) that the options of an encoder (x264, x265) say; null without any."""
    get = lambda k: F.try_element_at(options, F.lit(k))
    other = encoder == "x265"
    num = lambda a, b=None: F.when(other, get(b or a)).otherwise(get(a)).try_cast("double")
    rc, crf, qp, bitrate = get("rc"), num("crf"), num("qp"), num("bitrate")
    maxrate, bufsize = num("vbv_maxrate", "vbv-maxrate"), num("vbv_bufsize", "vbv-bufsize")
    lossless = other & (get("lossless") == "1")
    read = F.when(other, F.coalesce(get("stats-read").try_cast("double") > 0, F.lit(False))).otherwise(rc == "2pass")
    mode = (
        F.when(rc == "cqp", F.when(F.coalesce((qp == 0) | lossless, F.lit(False)), "lossless").otherwise("cqp")).when(F.coalesce(lossless, F.lit(False)), "lossless").when(read, "2pass")
        .when(rc == "crf", F.when((maxrate > 0) & (bufsize > 0), "capped-crf").otherwise("crf")).when(rc == "cbr", "cbr").otherwise("abr")
    )
    return F.when(rc.isNotNull(), F.struct(mode.alias("mode"), crf.alias("crf"), qp.alias("qp"), bitrate.alias("bitrate"), maxrate.alias("maxrate"), bufsize.alias("bufsize")))


# bytes


def read_uint(content: Column, at: Column, size: int, little: bool = False) -> Column:
    """The unsigned number of ``size`` bytes (7 at most) from place ``at`` (0-based) on; null beyond the end."""
    raw = F.substring(content, (at + 1).cast("int"), F.lit(size))
    digits = F.hex(raw)
    if little:
        digits = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])
    return F.when((F.octet_length(raw) == size) & (at >= 0), F.conv(digits, 16, 10).cast("long"))


def read_bits(content: Column, at: Column, size: int) -> Column:
    """The unsigned number of ``size`` bits (48 at most) from bit ``at`` on."""
    first = F.floor(at / 8)
    bits = F.lpad(F.conv(F.hex(F.substring(content, (first + 1).cast("int"), F.lit((size + 14) // 8))), 16, 2), (size + 14) // 8 * 8, "0")
    whole = F.octet_length(F.substring(content, (first + 1).cast("int"), F.lit((size + 14) // 8)))
    bits = F.when(whole == (size + 14) // 8, bits).otherwise(F.rpad(F.lpad(F.conv(F.hex(F.substring(content, (first + 1).cast("int"), whole)), 16, 2), whole * 8, F.lit("0")), F.lit((size + 14) // 8 * 8), F.lit("0")))
    return F.when((at >= 0) & (at + size <= F.octet_length(content) * 8), F.conv(F.substring(bits, (at % 8 + 1).cast("int"), F.lit(size)), 2, 10).cast("long"))


def crc32(content: Column) -> Column:
    """CRC-32 of IEEE 802.3."""
    return F.crc32(content)


def _mpeg_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        out.append(crc)
    return out


_MPEG = np.array(_mpeg_table(), np.uint64)


@F.pandas_udf(LongType())
def crc32_mpeg(content: pd.Series) -> pd.Series:
    """CRC-32/MPEG-2: not reflected, no final inversion (E7). Rows are taken together, byte by byte."""
    size = content.map(lambda b: -1 if b is None else len(b)).to_numpy()
    order = np.argsort(-size, kind="stable")
    crc = np.full(len(content), 0xFFFFFFFF, np.uint64)
    rows = [np.frombuffer(bytes(content.iloc[i] or b""), np.uint8) for i in order]
    longest = int(size.max()) if len(size) else 0
    live = np.searchsorted(-size[order], -np.arange(longest), "left") if longest > 0 else []
    for k in range(max(0, longest)):
        n = int(live[k])
        byte = np.fromiter((rows[i][k] for i in range(n)), np.uint64, n)
        crc[:n] = (crc[:n] << np.uint64(8) & np.uint64(0xFFFFFFFF)) ^ _MPEG[((crc[:n] >> np.uint64(24)) ^ byte).astype(np.int64)]
    out = pd.Series([None] * len(content), dtype="object")
    for i, value in zip(order, crc.tolist(), strict=True):
        out.iloc[i] = value if size[i] >= 0 else None
    return out.astype("Int64")


def search_pattern(text: str) -> bytes | None:
    """What a search box means: 0x.. or pairs of hex digits are bytes, the rest is text, quotes around it aside."""
    import re

    t = text.strip()
    bare = re.sub(r"\s+", "", re.sub(r"(?i)^0x", "", t))
    if (re.match(r"(?i)0x", t) or re.fullmatch(r"(?i)[0-9a-f]{2}(\s+[0-9a-f]{2})+", t)) and re.fullmatch(r"(?i)([0-9a-f]{2})+", bare):
        return bytes.fromhex(bare)
    return re.sub(r'^"(.*)"$', r"\1", t).encode() or None


def find_bytes(content: Column, pattern: bytes, start: int = 0) -> Column:
    """The first place of ``pattern`` at or after ``start``, else the first before it; null if there is none."""
    needle = F.lit(bytearray(pattern))
    place = lambda c: F.call_function("position", needle, c)
    later = place(F.substring(content, start + 1, 1 << 30))
    return F.when(later > 0, later - 1 + start).when(place(content) > 0, place(content) - 1).cast("long")


def unescaped(payload: Column) -> Column:
    """A NAL unit without emulation prevention: 00 00 03 becomes 00 00 (E4), as hex pairs that no byte edge confuses."""
    pairs = F.regexp_replace(F.hex(payload), "(..)", "$1 ")
    return F.unhex(F.replace(F.regexp_replace(pairs, "(?<=00 00 )03 ", ""), F.lit(" "), F.lit("")))


def fourcc(content: Column) -> Column:
    """Four bytes as text; 0xA9 is ©, bytes that can't be shown are \\xNN."""
    one = lambda k: F.hex(F.substring(content, k, 1))
    shown = lambda h: F.when((h >= "20") & (h < "7F"), F.decode(F.unhex(h), "US-ASCII")).when(h == "A9", "©").otherwise(F.concat(F.lit("\\x"), h))
    return F.concat(*[F.when(F.octet_length(content) >= k, shown(one(k))).otherwise("") for k in range(1, 5)])


def uuid(content: Column) -> Column:
    """Sixteen bytes as a UUID."""
    return F.regexp_replace(F.lower(F.hex(F.substring(content, 1, 16))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def guid(content: Column) -> Column:
    """Sixteen bytes as a GUID, whose first three fields are little-endian."""
    h = F.hex(content)
    turned = lambda a, n: F.concat(*[F.substring(h, a + 2 * k, 2) for k in reversed(range(n))])
    return F.concat_ws("-", turned(1, 4), turned(9, 2), turned(13, 2), F.substring(h, 17, 4), F.substring(h, 21, 12))


def text_of(content: Column, charset: str = "UTF-8") -> Column:
    """Bytes as text in a character set, up to the first zero byte."""
    return F.regexp_replace(F.decode(content, charset), "(?s)\u0000.*$", "")


# numbers, offsets and dates


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps; 92 are enough for any two longs."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0))).cast("long").alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["a"]


def aspect(width: Column, height: Column) -> Column:
    """``16:9`` where it reduces to 64 at most, else the ratio with three decimals."""
    g = gcd(width, height)
    a, b = (width / g).cast("long"), (height / g).cast("long")
    ratio = F.when((a <= 64) & (b <= 64), F.concat_ws(":", a, b)).otherwise(F.format_string("%.3f", width.cast("double") / height))
    return F.when((width > 0) & (height > 0), ratio)


def offset_of(text: Column, size: Column) -> Column:
    """A place in a file from what a reader types: 10, 0x1f, 1fh, 4k, 50%, -8 (from the end); kept inside the file."""
    s = F.regexp_replace(F.trim(text), r"[,_\s]", "")
    back, t = s.startswith("-"), F.regexp_replace(s, "^-", "")
    hexed = lambda x: F.conv(x, 16, 10).try_cast("double")
    unit = F.lower(F.regexp_extract(t, r"(?i)^\d+(?:\.\d+)?([kmg])i?b?$", 1))
    number = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)", 1).try_cast("double")
    value = _first(
        (t.rlike(r"^\d+(\.\d+)?%$"), F.floor(number / 100 * size)), (t.rlike("(?i)^0x[0-9a-f]+$"), hexed(F.substring(t, F.lit(3), F.length(t)))),
        (t.rlike(r"(?i)^\$?[0-9a-f]+h$"), hexed(F.regexp_replace(t, r"(?i)^\$|h$", ""))), (unit != "", F.floor(number * F.when(unit == "k", 1024).when(unit == "m", 1 << 20).otherwise(1 << 30))),
        (t.rlike(r"^\d+$"), number), (t.rlike("(?i)^[0-9a-f]+$"), hexed(t)),
    )
    value = F.when(back, size - value).otherwise(value)
    return F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(F.greatest(size - 1, F.lit(0)), value))).cast("long")


#: Whole seconds from 1970 that a timestamp's microseconds reach.
LAST_SECOND = (1 << 63) // 1_000_000 - 1


def _scaled(n: Column, units: list[str], base: int, digits: int) -> Column:
    out = F.lit(None).cast("string")
    for k, unit in reversed(list(enumerate(units, 1))):
        last = k == len(units)
        out = F.when(n < float(base ** (k + 1)), F.format_string(f"%.{digits}f {unit}", n / float(base**k))).otherwise(out if not last else F.format_string(f"%.{digits}f {unit}", n / float(base**k)))
    return out


def human_size(n: Column, units: str = "KMGT") -> Column:
    """32 B, 4.9 K, 106.6 M; what is beyond the last of ``units`` is told in it."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(_scaled(n, list(units), 1024, 1))


def human_bytes(n: Column) -> Column:
    """110.54 MB."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" bytes"))).otherwise(_scaled(n, ["KB", "MB", "GB", "TB"], 1024, 2))


def duration_text(s: Column) -> Column:
    """2:04:17.867, hours only where there are any."""
    return F.concat(F.when(s < 0, "-").otherwise(""), milliseconds_text(F.floor(F.abs(s) * 1000 + 0.5).cast("long")))


def milliseconds_text(ms: Column) -> Column:
    """The same of whole milliseconds, 0 or more, in whole numbers throughout: no double holds every one."""
    by = lambda n: F.call_function("div", ms, F.lit(n).cast("long"))
    h, m = by(3_600_000), by(60_000) % 60
    rest = F.format_string("%02d.%03d", by(1000) % 60, ms % 1000)
    return F.concat(F.when(h > 0, F.format_string("%d:%02d:", h, m)).otherwise(F.format_string("%d:", m)), rest)


def bitrate_text(bps: Column) -> Column:
    """2.50 Mb/s, 640.0 kb/s."""
    return F.when(bps >= 1e6, F.format_string("%.2f Mb/s", bps / 1e6)).when(bps >= 1e3, F.format_string("%.1f kb/s", bps / 1e3)).when(bps > 0, F.format_string("%d b/s", F.floor(bps + 0.5).cast("long")))


def unix_1904(s: Column) -> Column:
    """Seconds since 1970 of whole seconds since 1904; 0 is no date."""
    return F.when(s != 0, s.cast("long") - 2_082_844_800)


def date_1904(s: Column) -> Column:
    """Seconds since 1904; 0 is no date, nor is what no timestamp holds."""
    at = s - 2_082_844_800
    return F.when((s != 0) & (F.abs(at) <= LAST_SECOND), F.timestamp_seconds(at))


def date_2001(ns: Column) -> Column:
    """Nanoseconds since 2001."""
    return F.timestamp_micros(F.floor(ns / 1000).cast("long") + 978_307_200_000_000)


def date_mjd(content: Column) -> Column:
    """Five bytes: a Modified Julian Date of 16 bits, then hours, minutes and seconds as decimal digits; all ones are no date."""
    day = read_uint(content, F.lit(0), 2)
    two = lambda k: F.hex(F.substring(content, k, 1)).try_cast("int")
    return F.when(F.hex(content) != "FFFFFFFFFF", F.timestamp_seconds((day - 40_587) * 86_400 + two(3) * 3600 + two(4) * 60 + two(5)))


def hertz(text: Column) -> Column:
    """``44.1 kHz`` or ``48,000 Hz`` as a number."""
    p = r"(?i)^\s*([\d,]+(?:\.\d+)?)\s*(k?)Hz"
    n = F.regexp_replace(F.regexp_extract(text, p, 1), ",", "").try_cast("double")
    return F.when(n > 0, F.floor(n * F.when(F.regexp_extract(text, p, 2) != "", 1000).otherwise(1) + 0.5).cast("long"))


def channels(text: Column) -> Column:
    """``stereo``, ``5.1`` or ``2 channels`` as a number."""
    t = F.lower(F.trim(text))
    lfe = lambda k: F.regexp_extract(t, r"^(\d+)\.(\d)\b", k).try_cast("int")
    n = F.coalesce(F.nullif(F.regexp_extract(t, r"^(\d+)\s*(?:ch|channel)", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"^(\d+)$", 1), F.lit("")))
    return F.when(t.rlike(r"^mono\b"), 1).when(t.rlike(r"^stereo\b"), 2).when(t.rlike(r"^\d+\.\d\b"), lfe(1) + lfe(2)).otherwise(n.try_cast("int"))


def timecode(frame: Column, fps: int, drop: bool = False) -> Column:
    """HH:MM:SS:FF of a frame number; with ``drop`` at 30 or 60 a second, numbers are left out at each minute but every tenth."""
    f = frame.cast("long")
    if drop and fps in (30, 60):
        skip = fps // 15
        minute, ten = fps * 60 - skip, (fps * 60 - skip) * 10 + skip
        rest = f % ten
        f = f + F.floor(f / ten) * 9 * skip + F.when(rest > skip, F.floor((rest - skip) / minute) * skip).otherwise(0)
    s = F.floor(f / fps)
    mark = ";" if drop else ":"
    return F.format_string(f"%02d:%02d:%02d{mark}%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, f % fps)


def natural_key(name: Column) -> Column:
    """A key by which names sort with their numbers as numbers."""
    padded = F.regexp_replace(F.lower(name), r"(\d+)", "00000000000000000000$1")
    return F.regexp_replace(padded, r"0*(\d{20})(?!\d)", "$1")


# command lines


def shell_quoted(argument: Column) -> Column:
    """An argument as a shell takes it."""
    return F.when(argument.rlike("^[A-Za-z0-9_@%+=:,./-]+$"), argument).otherwise(F.concat(F.lit("'"), F.replace(argument, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def command_line(program: str, arguments: Column) -> Column:
    """A program with an array of arguments."""
    return F.concat_ws(" ", F.lit(program), F.transform(arguments, shell_quoted))


# pictures


def luma(rgba: np.ndarray) -> np.ndarray:
    """Luma of BT.601, limited range, of an array (height, width, 4) of bytes."""
    r, g, b = (rgba[..., k].astype(np.float64) for k in range(3))
    return np.floor(16 + (65.481 * r + 128.553 * g + 24.966 * b) / 255 + 0.5).astype(np.uint8)


def resized(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """A plane at another size: the mean of the area where it shrinks, between neighbours where it grows."""

    def weights(n: int, m: int) -> np.ndarray:
        out = np.zeros((m, n))
        scale = n / m
        for k in range(m):
            if scale >= 1:
                lo, hi = k * scale, (k + 1) * scale
                for i in range(int(lo), min(n, int(np.ceil(hi)))):
                    out[k, i] = min(hi, i + 1) - max(lo, i)
            else:
                at = np.clip((k + 0.5) * scale - 0.5, 0, n - 1)
                i = int(at)
                out[k, i] = 1 - (at - i)
                out[k, min(i + 1, n - 1)] += at - i
        return out / out.sum(axis=1, keepdims=True)

    return np.floor(weights(plane.shape[0], height) @ plane.astype(np.float64) @ weights(plane.shape[1], width).T + 0.5).astype(np.uint8)


def same_aspect(w1: Column, h1: Column, w2: Column, h2: Column, slack: float = 0.02) -> Column:
    """Whether two sizes have the same shape, rounding aside."""
    return F.abs(w1.cast("double") * h2 / (h1 * w2) - 1) < slack


def structural_similarity(a: np.ndarray, b: np.ndarray) -> float | None:
    """SSIM over windows of 8 x 8 at steps of 4, from sums of 4 x 4 blocks (A29); None below 8 x 8."""
    h, w = (n // 4 * 4 for n in a.shape)
    if h < 8 or w < 8:
        return None
    a, b = a[:h, :w].astype(np.int64), b[:h, :w].astype(np.int64)
    blocks = lambda x: x.reshape(h // 4, 4, w // 4, 4).sum(axis=(1, 3))
    windows = lambda x: x[:-1, :-1] + x[1:, :-1] + x[:-1, 1:] + x[1:, 1:]
    s1, s2, ss, s12 = (windows(blocks(x)).astype(np.float64) for x in (a, b, a * a + b * b, a * b))
    c1, c2 = np.floor(0.01**2 * 255**2 * 64 + 0.5), np.floor(0.03**2 * 255**2 * 64 * 63 + 0.5)
    spread, shared = ss * 64 - s1 * s1 - s2 * s2, s12 * 64 - s1 * s2
    return float(np.mean((2 * s1 * s2 + c1) * (2 * shared + c2) / ((s1 * s1 + s2 * s2 + c1) * (spread + c2))))


PICTURES = StructType([StructField(n, IntegerType() if n == "most" else DoubleType()) for n in ("mse", "psnr", "ssim", "most", "share")])


@F.pandas_udf(PICTURES)
def compare_pictures(width: pd.Series, height: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Two planes of bytes of one size: mean squared error, PSNR (null where equal), SSIM, the largest difference and the
    share of pixels that differ by more than 8 (A29)."""
    rows = []
    for w, h, x, y in zip(width, height, a, b, strict=True):
        if x is None or y is None or len(x) != w * h or len(y) != w * h or not len(x):
            rows.append((None,) * 5)
            continue
        p, q = (np.frombuffer(bytes(v), np.uint8).reshape(h, w) for v in (x, y))
        d = np.abs(p.astype(np.int64) - q)
        mse = float((d * d).mean())
        rows.append((mse, 10 * np.log10(255 * 255 / mse) if mse else None, structural_similarity(p, q), int(d.max()), float((d > 8).mean())))
    return pd.DataFrame(rows, columns=PICTURES.names)

