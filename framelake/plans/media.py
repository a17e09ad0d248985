"""Queries of scalar functions over names, codecs, options, bytes, numbers and dates, and of conversions, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import media, text
from ..operators import convert, stats
from ..operators.samples import read

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _pick(key: str, *values: str | None):
    """One of the values by ``key`` modulo their number."""
    out = F
    for k, v in enumerate(values):
        out = out.when(F.col(key) % len(values) == k, F.lit(v))
    return out


def _case(key: str, *values: str | None) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {'NULL' if v is None else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39)}" for k, v in enumerate(values)) + " END"


FOURCC = ("avc1", "hvc1", "dvhe", "av01", "vp09", "mp4a", "mp3 ", "ec-3", "tx3g", "Opus", "jpeg", None)
AUDIO = (("mp4a.40.2", "x"), ("mp4a.40.29", None), ("mp4a.40.7", None), (None, "MPEG-4 Audio (AAC)"), ("mp4a.69", "MPEG audio Layer II"), (None, "MP3 audio"), ("ec-3", None), (None, "AC-3 (ATSC)"), ("Opus", None), (None, "PCM 16 bit"), ("zzzz", None), (None, "Something"))
NAMES = ("AAC LC", "HE-AAC v2", "AAC", "AAC", "MP2", "MP3", "E-AC-3", "AC-3", "Opus", "PCM", None, "Something")
FAMILY = ("avc", "hevc", "hevc", "av1", "vp9", "aac", "mp3", "eac3", "tx3g", "opus", None, None)


@query(f"SELECT p_partkey AS id, {_case('p_partkey', *FAMILY)} AS family, {_case('p_partkey', *NAMES)} AS audio, {_case('p_partkey % 12', 'H.264 / AVC', 'H.265 / HEVC', 'H.265 / HEVC', 'AV1', 'VP9', *[None] * 7)} AS video FROM part")
def codec_names(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    fam = media.codec_family(_pick("id", *FOURCC))
    return p.select("id", fam.alias("family"), media.audio_codec(_pick("id", *[a for a, _ in AUDIO]), _pick("id", *[b for _, b in AUDIO])).alias("audio"), media.video_codec(fam).alias("video"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'avc' WHEN 1 THEN 'hevc' WHEN 2 THEN 'av1' WHEN 3 THEN 'vp9' END AS family, CASE p_partkey % 5 WHEN 0 THEN 64 + p_size WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN 2 END AS profile,
  CASE p_partkey % 5 WHEN 0 THEN 31 WHEN 1 THEN 60 + p_size WHEN 2 THEN 8 WHEN 3 THEN 41 END AS level, CASE p_partkey % 5 WHEN 1 THEN p_partkey % 2 = 0 WHEN 2 THEN p_partkey % 3 = 0 END AS high_tier, CASE p_partkey % 5 WHEN 2 THEN 10 WHEN 3 THEN 12 END AS depth FROM part""")
def codec_strings(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("id", F.col("p_partkey"))
    s = (
        F.when(F.col("id") % 5 == 0, F.concat(F.lit("avc1."), F.hex(F.col("p_size") + 64), F.lit("001F"))).when(F.col("id") % 5 == 1, F.format_string("hvc1.2.4.%s%d.B0", F.when(F.col("id") % 2 == 0, "H").otherwise("L"), F.col("p_size") + 60))
        .when(F.col("id") % 5 == 2, F.concat(F.lit("av01.0.08"), F.when(F.col("id") % 3 == 0, "H").otherwise("M"), F.lit(".10"))).when(F.col("id") % 5 == 3, "vp09.02.41.12").otherwise("mp4v.20.9")
    )
    return p.select("id", media.codec_facts(s).alias("c")).select("id", "c.*")


X264 = ("x264 - core 165 - options: cabac=1 ref=3 rc=crf crf=23.0 me=hex", "x264 - options: rc=crf crf=20 vbv_maxrate=3000 vbv_bufsize=6000 open_gop=0", "x264 - options: rc=2pass bitrate=900", "x264 - options: rc=cbr bitrate=500 vbv_maxrate=500 vbv_bufsize=500", "x264 - options: rc=cqp qp=0", "x264 - options: rc=cqp qp=21", "x264 - options: rc=abr bitrate=700", "no settings")
X264_MODES = ("crf", "capped-crf", "2pass", "cbr", "lossless", "cqp", "abr", None)
X265 = ("x265 - options: rc=crf crf=28.0 no-wpp keyint=250", "x265 - options: rc=crf crf=28 vbv-maxrate=900 vbv-bufsize=900 slicesconformance-window-offsets right=2 bottom=4", "x265 - options: rc=abr bitrate=900 stats-read=2", "x265 - options: rc=cqp qp=30 lossless=1", "x265 - options: rc=abr bitrate=1 zones: start-frame=0 end-frame=9 qp=30 zones: start-frame=20 end-frame=29 bitrate-factor=0.5", "x265 - options: rc=cqp qp=30 Level 0,1,2=1,2,3")
X265_MODES = ("crf", "capped-crf", "2pass", "lossless", "abr", "cqp")


@query(f"SELECT p_partkey AS id, {_case('p_partkey', *X264_MODES)} AS mode, CASE p_partkey % 8 WHEN 0 THEN 23 WHEN 1 THEN 20 END::DOUBLE AS crf, CASE p_partkey % 8 WHEN 1 THEN 3000 WHEN 3 THEN 500 END::DOUBLE AS maxrate, {_case('p_partkey', *X265_MODES)} AS mode5,"
       " CASE p_partkey % 6 WHEN 0 THEN 'wpp=0' WHEN 1 THEN 'conformance-window-offsets=right=2 bottom=4' WHEN 4 THEN 'zones=0,9,q=30/20,29,b=0.5' WHEN 5 THEN 'hme-search=1,2,3' END AS odd FROM part")
def encoder_options(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    a = p.withColumn("o", media.x264_options(_pick("id", *X264))).withColumn("o5", media.x265_options(_pick("id", *X265)))
    rc, rc5 = media.rate_control(F.lit("x264"), F.col("o")), media.rate_control(F.lit("x265"), F.col("o5"))
    odd = F.coalesce(*[F.when(F.try_element_at("o5", F.lit(k)).isNotNull(), F.concat(F.lit(f"{k}="), F.try_element_at("o5", F.lit(k)))) for k in ("wpp", "conformance-window-offsets", "zones", "hme-search")])
    return a.select("id", rc["mode"].alias("mode"), rc["crf"].alias("crf"), rc["maxrate"].alias("maxrate"), rc5["mode"].alias("mode5"), odd.alias("odd"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size * 2 WHEN 2 THEN p_size * 3 END AS width, CASE p_partkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 30 END AS height,
  CASE WHEN p_partkey % 7 = 0 THEN 'B' WHEN p_partkey % 7 = 1 THEN 'b' WHEN p_partkey % 7 = 2 THEN 'p' WHEN p_partkey % 7 = 3 THEN 'P' WHEN p_partkey % 7 = 4 THEN 'I' WHEN p_partkey % 7 = 5 THEN '=' ELSE '?' END AS letter,
  CASE WHEN p_size % 3 = 0 THEN 30000.0 / 1001 WHEN p_size % 3 = 1 THEN 25.0 ELSE 26.5 END::DOUBLE AS fps, round(p_retailprice * 1000 / (p_size * 20 * 25), 6)::DOUBLE AS bpp, CASE WHEN p_partkey % 3 = 0 THEN p_size / 90000.0 ELSE p_size / 1000.0 END::DOUBLE AS seconds FROM part""")
def track_facts(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("id", F.col("p_partkey"))
    k, size = F.col("id"), F.col("p_size")
    text_ = lambda n, h: F.concat(size * n, F.lit(" × "), F.lit(h))
    props = F.when(k % 4 == 0, F.create_map(F.lit("coded size"), text_(1, 10), F.lit("size"), F.lit("1x1"))).when(k % 4 == 1, F.create_map(F.lit("display size"), text_(2, 20))).when(k % 4 == 2, F.create_map(F.lit("resolution"), F.concat(size * 3, F.lit("x30")))).otherwise(F.create_map(F.lit("size"), F.lit("unknown")))
    kind = F.element_at(F.array(*[F.lit(x) for x in (media.B, media.B, media.P, media.P, media.I, media.REPEAT, media.UNKNOWN)]), (k % 7 + 1).cast("int"))
    flags = F.element_at(F.array(*[F.lit(x) for x in (media.REF, media.NONREF, media.NONREF, media.REF, media.RAP, 0, 0)]), (k % 7 + 1).cast("int"))
    fps = F.when(size % 3 == 0, 29.9699).when(size % 3 == 1, 25.001).otherwise(26.5)
    s = media.frame_size(props)
    return p.select(
        "id", s["width"].alias("width"), s["height"].alias("height"), media.frame_letter(kind, flags).alias("letter"), stats.snapped_rate(fps).alias("fps"),
        F.round(media.bits_per_pixel(F.col("p_retailprice") * 1000, size, F.lit(20), F.lit(25)), 6).alias("bpp"), media.seconds(size, F.when(k % 3 == 0, 90000).otherwise(0), F.lit(1000)).alias("seconds"),
    )


@query("""SELECT doc_id, (ascii(substr(t, 1, 1)) * 256 + ascii(substr(t, 2, 1)))::BIGINT AS be, (ascii(substr(t, 4, 1)) * 65536 + ascii(substr(t, 3, 1)) * 256 + ascii(substr(t, 2, 1)))::BIGINT AS le, (ascii(substr(t, 2, 1)) % 16 * 4 + ascii(substr(t, 3, 1)) // 64)::BIGINT AS bits, substr(t, 1, 4) AS code,
  strpos(substr(t, 9), 'e') + 7 AS later, sha256(t) AS digest FROM (SELECT doc_id, left(regexp_replace(text, '[^a-z]', '', 'g'), 60) || 'eeeeeeeeeee' AS t FROM documents)""")
def byte_reads(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.substring(F.regexp_replace("text", "[^a-z]", ""), 1, 60), F.lit("e" * 11)).cast("binary").alias("b"))
    b = F.col("b")
    return d.select(
        "doc_id", media.read_uint(b, F.lit(0), 2).alias("be"), media.read_uint(b, F.lit(1), 3, little=True).alias("le"), media.read_bits(b, F.lit(12), 6).alias("bits"), media.fourcc(b).alias("code"),
        media.find_bytes(b, media.search_pattern("0x65"), 8).alias("later"), F.sha2(b, 256).alias("digest"),
    )


@query("""WITH n AS (SELECT l_partkey AS a, l_suppkey * l_linenumber AS b, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem) SELECT DISTINCT a, b, gcd(a, b)::BIGINT AS g,
  CASE WHEN a > 0 AND a // gcd(a, b) <= 64 AND b // gcd(a, b) <= 64 THEN (a // gcd(a, b)) || ':' || (b // gcd(a, b)) END AS ratio, lpad((a // 3600 // 25)::VARCHAR, 2, '0') || ':' || lpad((a // 1500 % 60)::VARCHAR, 2, '0') || ':' || lpad((a // 25 % 60)::VARCHAR, 2, '0') || ':' || lpad((a % 25)::VARCHAR, 2, '0') AS code FROM n WHERE b > 0""")
def aspect_ratios(spark, sf_dir):
    n = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") * F.col("l_linenumber")).alias("b")).where("b > 0").distinct()
    ratio = media.aspect(F.col("a"), F.col("b"))
    return n.select("a", "b", media.gcd(F.col("a"), F.col("b")).alias("g"), F.when(ratio.contains(":"), ratio).alias("ratio"), media.timecode(F.col("a"), 25).alias("code"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN least(p_size, 9999) WHEN 1 THEN p_size * 16 + 15 WHEN 2 THEN p_size * 16 + 10 WHEN 3 THEN least(p_size * 1024, 9999) WHEN 4 THEN p_size * 100 WHEN 5 THEN 10000 - p_size WHEN 6 THEN NULL ELSE 4112 END::BIGINT AS at FROM part""")
def offset_input(spark, sf_dir):
    s = F.col("p_size")
    typed = (
        F.when(F.col("id") % 8 == 0, s.cast("string")).when(F.col("id") % 8 == 1, F.concat(F.lit("0x"), F.hex(s), F.lit("f"))).when(F.col("id") % 8 == 2, F.concat(F.hex(s), F.lit("a h"))).when(F.col("id") % 8 == 3, F.concat(s, F.lit(" KiB")))
        .when(F.col("id") % 8 == 4, F.concat(s, F.lit("%"))).when(F.col("id") % 8 == 5, F.concat(F.lit("-"), s)).when(F.col("id") % 8 == 6, "zoo").otherwise("1_010h")
    )
    return read(spark, sf_dir, "part").withColumn("id", F.col("p_partkey")).select("id", media.offset_of(typed, F.lit(10_000)).alias("at"))


@query("""SELECT o_orderkey AS id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f K', floor(n / 1024.0 * 10 + 0.5) / 10) WHEN n < 1073741824 THEN printf('%.1f M', floor(n / 1048576.0 * 10 + 0.5) / 10) ELSE printf('%.1f G', floor(n / 1073741824.0 * 10 + 0.5) / 10) END AS size,
  CASE WHEN n = 0 THEN NULL WHEN n < 1000 THEN n || ' b/s' WHEN n < 1000000 THEN printf('%.1f kb/s', floor(n / 1000.0 * 10 + 0.5) / 10) ELSE printf('%.2f Mb/s', floor(n / 1000000.0 * 100 + 0.5) / 100) END AS rate, CASE WHEN n > 0 THEN epoch(make_timestamp(1904, 1, 1, 0, 0, 0.0))::BIGINT + n END AS "at", CASE WHEN n >= 3600000 THEN (n // 3600000) || ':' || lpad((n // 60000 % 60)::VARCHAR, 2, '0') || ':' ELSE (n // 60000) || ':' END
  || lpad((n // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((n % 1000)::VARCHAR, 3, '0') AS length FROM (SELECT o_orderkey, (o_orderkey * o_orderkey * 37)::BIGINT AS n FROM orders)""")
def number_texts(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * F.col("o_orderkey") * 37).cast("long").alias("n"))
    n = F.col("n")
    return o.select("id", media.human_size(n, "KMG").alias("size"), media.bitrate_text(n.cast("double")).alias("rate"), media.unix_1904(n).alias("at"), media.milliseconds_text(n).alias("length"))


HZ = ("44.1 kHz", "48,000 Hz", "48000 / s", "8 kHz mono", "", None)
CH = ("2 channels: L R", "5.1", "Mono", "stereo (joint)", "7", None)


@query(f"SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 44100 WHEN 1 THEN 48000 WHEN 3 THEN 8000 END::BIGINT AS hz, CASE p_partkey % 6 WHEN 0 THEN 2 WHEN 1 THEN 6 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 7 END AS channels, 'clip' || lpad(p_partkey::VARCHAR, 20, '0') || 'a' || lpad(p_size::VARCHAR, 20, '0') || '.mp4' AS key,"
       " 'play ' || CASE WHEN p_size % 2 = 0 THEN '''a b''' ELSE 'x' || p_size END AS cmd FROM part")
def text_parsers(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("id", F.col("p_partkey"))
    arg = F.when(F.col("p_size") % 2 == 0, "a b").otherwise(F.concat(F.lit("x"), F.col("p_size")))
    key = media.natural_key(F.concat(F.lit("Clip"), F.col("id"), F.lit("a"), F.col("p_size"), F.lit(".mp4")))
    return p.select("id", media.hertz(_pick("id", *HZ)).alias("hz"), media.channels(_pick("id", *CH)).alias("channels"), F.regexp_replace(key, r"mp0{19}4$", "mp4").alias("key"), media.command_line("play", F.array(arg)).alias("cmd"))


URIS = ("seg.ts", "../up/seg.ts?x=1", "/abs/./seg.ts", "//other.example/s", "http://else.example/a", "a/b/../c.ts", "?only=query", "..")
RESOLVED = ("https://host.example/p/q/seg.ts", "https://host.example/p/up/seg.ts?x=1", "https://host.example/abs/seg.ts", "https://other.example/s", "http://else.example/a", "https://host.example/p/q/a/c.ts", "https://host.example/p/q/list.m3u8?only=query", "https://host.example/p/")


@query(f"SELECT p_partkey AS id, {_case('p_partkey', *RESOLVED)} AS url, CASE p_partkey % 4 WHEN 0 THEN 1080 WHEN 1 THEN 720 WHEN 2 THEN 360 END::INT AS height, {_case('p_partkey', 'movie one', 'movie one', 'clip', 'master')} AS stem, {_case('p_partkey', 'avc1.640028,mp4a.40.2', '', 'b')} AS codecs FROM part")
def names_and_urls(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    name = _pick("id", "movie-one_1920x1080_src-1080p.mp4", "Movie One 720P.mov", "clip.2160p.360p.x264.mkv", "master.mov")
    a = text.attributes(_pick("id", 'BANDWIDTH=1,CODECS="avc1.640028,mp4a.40.2",AUDIO="a"', 'CODECS="",BANDWIDTH=2', "CODECS=a,CODECS=b"))
    return p.select("id", text.resolve(_pick("id", *URIS), F.lit("https://host.example/p/q/list.m3u8?t=9")).alias("url"), text.label_height(name).alias("height"), text.stem(name).alias("stem"), F.try_element_at(a, F.lit("CODECS")).alias("codecs"))


HEADS = ("89504e470d0a1a0a", "000001b3aa", "0000000167", "494433", "fffb90", "fff150", "4f676753", "234558544d3355", "3c4d5044", "3c68746d6c", "efbbbf574542565454", "47494638", "504b0304", "00")
KINDS = ("png", "mpeg video", "annex b", "mp3 with id3", "mpeg audio", "mpeg audio", "ogg", "m3u8", "xml", None, "webvtt", "gif", "zip", None)


@query(f"SELECT p_partkey AS id, {_case('p_partkey', *KINDS)} AS kind FROM part")
def magic_identify(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).select("id", text.magic(F.unhex(_pick("id", *HEADS))).alias("kind"))


# conversions: each order as a source, and what became of it

PAIRS = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 19 > 0 THEN 1 ELSE 0 END AS s_videos, CASE WHEN o_orderkey % 23 > 0 THEN 1 ELSE 0 END AS t_videos, o_orderkey % 3 AS s_audios, o_orderkey % 3 - CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 3 > 0 THEN 1 ELSE 0 END AS t_audios,
  o_orderkey % 4 % 2 AS s_subs, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 4 % 2 END AS t_subs, o_orderkey % 2 = 0 AS video_copied, o_orderkey % 4 < 2 AS audio_copied,
  CAST(0 AS DOUBLE) AS s_video_start, CAST(o_orderkey % 8 AS DOUBLE) / 128 AS s_audio_start, CAST(0 AS DOUBLE) AS t_video_start, CAST(o_orderkey % 6 AS DOUBLE) / 64 AS t_audio_start, CAST(0 AS DOUBLE) AS s_video_edit, CAST(o_orderkey % 9 AS DOUBLE) / 256 AS s_audio_edit, CAST(0 AS DOUBLE) AS t_video_edit, CAST(0 AS DOUBLE) AS t_audio_edit,
  CASE WHEN o_orderkey % 2 = 0 THEN '5.1' ELSE 'stereo' END AS s_channels, 'stereo' AS t_channels, CASE o_orderkey % 3 WHEN 0 THEN 'BT.2020 PQ' WHEN 1 THEN 'BT.709' ELSE 'unspecified' END AS s_colour, CASE o_orderkey % 5 WHEN 0 THEN 'BT.2020 PQ' WHEN 1 THEN 'BT.709' WHEN 2 THEN 'Unspecified' END AS t_colour,
  CASE WHEN o_orderkey % 3 = 0 THEN 'm' END AS s_mastering, CASE WHEN o_orderkey % 2 = 0 THEN 'm' END AS t_mastering, CASE WHEN o_orderkey % 11 = 0 THEN '90' END AS s_rotation, CASE WHEN o_orderkey % 22 = 0 THEN '90' END AS t_rotation, 1920 AS s_width, 1080 AS s_height,
  CASE WHEN o_orderkey % 33 = 0 THEN 1080 ELSE 1920 END AS t_width, CASE WHEN o_orderkey % 33 = 0 THEN 1920 ELSE 1080 END AS t_height, o_orderkey % 100 + 100 AS s_size, o_orderkey % 90 + 100 AS t_size, CAST(1000 AS DOUBLE) AS s_bitrate, CAST(o_orderkey % 200 + 850 AS DOUBLE) AS t_bitrate,
  CASE WHEN o_orderkey % 2 = 0 THEN 'isobmff' ELSE 'matroska' END AS t_format, o_orderkey % 6 < 4 AS t_fast_start, o_orderkey % 5 AS t_gops, o_orderkey % 3 = 1 AS t_gop_fixed, o_orderkey % 13 % 2 AS t_open_gops FROM orders"""


@query(f"""WITH p AS ({PAIRS}), m AS (SELECT *, CASE WHEN s_videos = 0 AND t_videos = 0 THEN 'none' WHEN s_videos = 0 THEN 'added' WHEN t_videos = 0 THEN 'dropped' WHEN video_copied THEN 'copied' ELSE 'transcoded' END AS video_mode,
  CASE WHEN s_audios = 0 AND t_audios = 0 THEN 'none' WHEN s_audios = 0 THEN 'added' WHEN t_audios = 0 THEN 'dropped' WHEN audio_copied THEN 'copied' ELSE 'transcoded' END AS audio_mode, (t_audio_start - greatest(0, s_audio_start - s_audio_edit)) * 1000 AS shift_ms FROM p),
f AS (SELECT id, video_mode, audio_mode, shift_ms, s_audios, list_filter([CASE WHEN video_mode = 'dropped' THEN 'video-dropped' END, CASE WHEN audio_mode = 'dropped' THEN 'audio-dropped' END, CASE WHEN abs(shift_ms) >= 50 THEN 'sync-drift!' WHEN abs(shift_ms) >= 20 THEN 'sync-drift' END,
  CASE WHEN s_subs > 0 AND t_subs = 0 THEN 'subs-dropped' END, CASE WHEN s_audios > 1 AND t_audios < s_audios THEN 'audio-tracks-dropped' END, CASE WHEN s_colour <> 'unspecified' AND coalesce(t_colour, 'Unspecified') = 'Unspecified' THEN 'color-stripped' END,
  CASE WHEN s_mastering IS NOT NULL AND t_mastering IS NULL AND coalesce(t_colour, '') <> 'BT.709' THEN 'hdr-mastering-dropped' END, CASE WHEN s_rotation IS NOT NULL AND t_rotation IS NULL AND t_width = 1920 THEN 'rotation-lost' END,
  CASE WHEN video_mode = 'transcoded' AND NOT t_gop_fixed AND t_gops > 1 THEN 'variable-gop' END, CASE WHEN video_mode = 'transcoded' AND t_open_gops > 0 THEN 'open-gops' END, CASE WHEN t_format = 'isobmff' AND NOT t_fast_start THEN 'missing-faststart' END], lambda x: x IS NOT NULL) AS found,
  list_filter([CASE WHEN s_channels = '5.1' THEN 'downmixed' END, CASE WHEN s_colour = 'BT.2020 PQ' AND t_colour = 'BT.709' THEN 'tonemapped' END, CASE WHEN s_rotation IS NOT NULL AND t_rotation IS NULL AND t_width = 1080 THEN 'rotation-baked' END, CASE WHEN video_mode = 'transcoded' AND t_gop_fixed THEN 'fixed-gop' END,
  CASE WHEN t_format = 'isobmff' AND t_fast_start THEN 'fast-start' END, CASE WHEN (t_size - s_size)::DOUBLE / s_size <= -0.05 THEN 'smaller' END, CASE WHEN (t_bitrate - s_bitrate) / s_bitrate <= -0.05 THEN 'lower-bitrate' END], lambda x: x IS NOT NULL) AS notes FROM m)
SELECT id, video_mode, audio_mode, shift_ms, replace(array_to_string(found, ','), '!', '') AS findings, array_to_string(notes, ',') AS highlights,
  CASE WHEN list_has_any(found, ['video-dropped', 'audio-dropped', 'sync-drift!', 'color-stripped']) THEN 'regression' WHEN len(found) > 0 THEN 'warning' WHEN video_mode = 'copied' AND (audio_mode = 'copied' OR s_audios = 0) THEN 'clean-remux' ELSE 'clean-transcode' END AS verdict FROM f""")
def conversion_verdict(spark, sf_dir):
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    out = convert.conversions(spark.sql(PAIRS))
    return out.select("id", "video_mode", "audio_mode", "shift_ms", F.array_join(F.col("findings.id"), ",").alias("findings"), F.array_join("highlights", ",").alias("highlights"), "verdict")
