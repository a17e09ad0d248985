"""Every query but the training-data ones against its SQL, and goldens of the operators."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from framelake.functions import media, text
from framelake.operators import audit, gops, joins, ladder, order, rates
from framelake.plans import audit as audit_plans, media as media_plans, timeline, timing

TABLES = "nation region customer supplier part orders lineitem events documents embeddings pages conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


PLANS = [(plan, name) for plan in (timeline, timing, audit_plans, media_plans) for name in sorted(plan.QUERIES)]


@pytest.mark.parametrize("plan, name", PLANS, ids=[name for _, name in PLANS])
def test_sql(spark, con, sf_dir, plan, name):
    want = con.sql(plan.SQL[name])
    columns = sorted(want.columns)
    got = plan.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == columns
    rows = Counter(map(tuple, got.select(*[f"`{c}`" for c in columns]).collect()))
    assert rows and rows == Counter(want.select(*[f'"{c}"' for c in columns]).fetchall())


def track(spark, sizes, step=40_000, keys=None):
    rows = [(1, i, i * step, step, s, i * step, keys is None or i in keys, "I" if keys is None or i in keys else "P", 0) for i, s in enumerate(sizes)]
    return spark.createDataFrame(rows, "track long, i long, dts long, duration long, size long, pts long, key boolean, letter string, offset long")


def test_vbv(spark):
    calm = rates.vbv(track(spark, [20_000] * 250), 4_000_000, 8_000_000).collect()[0]
    assert calm.underflows == 0
    for chunk in (7, 512):
        hit = rates.vbv(track(spark, [20_000] * 100 + [1_500_000] + [20_000] * 100), 4_000_000, 8_000_000, chunk=chunk).collect()[0]
        assert hit.first_i == 100 and hit.underflows == 1
    assert rates.vbv(track(spark, [20_000] * 100 + [1_500_000] + [20_000] * 100), 4_000_000, 16_000_000, fill=1.0).collect()[0].underflows == 0


def test_windows(spark):
    s = track(spark, [1000] * 50)
    assert rates.peak_window(s, 1_000_000).collect()[0].peak_bits == 200_000
    assert rates.peak_window(track(spark, [1000] * 10), 1_000_000).collect()[0].peak_bits is None
    assert rates.buffer_needed(s, 200_000).collect()[0].buffer == 8000 * 1_000_000
    one = track(spark, [1000] * 10 + [50_000] + [1000] * 10)
    assert rates.run_bits(one).collect()[0].most_bits == (50_000 + 3000) * 8


def test_gops(spark):
    s = track(spark, [100] * 100, keys={0, 50})
    assert gops.gop_summary(s).collect()[0].asDict() == {"track": 1, "gops": 2, "min_frames": 50, "max_frames": 50, "sum_frames": 50, "max_ticks": 2_000_000, "fixed": True}
    late = track(spark, [100] * 10, keys={3})
    assert {(r.gop, r.frames, r.partial) for r in gops.gop_stats(late).collect()} == {(0, 3, True), (1, 7, False)}
    nulls = track(spark, [1, 2]).withColumn("key", F.lit(None).cast("boolean"))
    assert gops.gop_stats(nulls).count() == 2


def test_backwards_and_unwrap(spark):
    s = spark.createDataFrame([(1, i, t) for i, t in enumerate([0, 40, 80, 70, 160])], "track long, i long, dts long")
    assert [tuple(r) for r in order.dts_backwards(s).collect()] == [(1, 3, -10)]
    w = spark.createDataFrame([(1, i, t % 100) for i, t in enumerate([90, 110, 105, 150, 199, 210])], "track long, i long, w long")
    assert [r.unwrapped for r in order.unwrap(w, "w", 100).orderBy("i").collect()] == [90, 110, 105, 150, 199, 210]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s")).alias("x")).collect()[0].x


def test_names(spark):
    names = ["harbour_1440p.mkv", "Harbour-2160x1440-high.mp4", "harbour.final.v3.mp4", "harbour (master) 8000k.mov"]
    assert {one(spark, n, text.stem) for n in names} == {"harbour"}
    assert one(spark, "1080p.mp4", text.stem) == "1080p" and one(spark, "\u6e2f\u53e3.mov", text.stem) == "\u6e2f\u53e3"
    assert [one(spark, n, text.label_height) for n in ("a-2160p-480P.mp4", "b_540p", "c-360px.mov", "d.240p")] == [480, 540, None, None]
    line = 'BANDWIDTH=812000,CODECS="hvc1.2.4.L93,ec-3",NAME="a=b",RESOLUTION=960x540'
    assert one(spark, line, text.attributes) == {"BANDWIDTH": "812000", "CODECS": "hvc1.2.4.L93,ec-3", "NAME": "a=b", "RESOLUTION": "960x540"}
    assert one(spark, "http://cdn.invalid/v/list.m3u8?key=1&b=2", text.redact) == "http://cdn.invalid/v/list.m3u8?\u2026"


def test_playlist(spark):
    body = "#EXTM3U\n#EXT-X-MAP:URI=\"init.mp4\"\n#EXTINF:4.0,\n#EXT-X-BYTERANGE:1000@0\na.mp4\n#EXTINF:4.0,\n#EXT-X-BYTERANGE:1200\na.mp4\n#EXT-X-DISCONTINUITY\n#EXTINF:2.5,x\nb.mp4\n"
    p = spark.createDataFrame([("p", body)], "playlist string, text string")
    got = [(r.offset, r.length, r.duration, r["map"], r.discontinuity) for r in text.playlist_segments(p).orderBy("idx").collect()]
    assert got == [(0, 1000, 4.0, "init.mp4", False), (1000, 1200, 4.0, "init.mp4", False), (None, None, 2.5, "init.mp4", True)]
    assert p.select(text.playlist_version(F.col("text")).alias("v")).collect()[0].v == 6
    for body, version in (("#EXTINF:4,", 1), ('#EXT-X-KEY:METHOD=AES-128,URI="k",IV=0x1', 2), ("#EXTINF:4.5,", 3), ("#EXT-X-BYTERANGE:5", 4), ('#EXT-X-KEY:METHOD=SAMPLE-AES,KEYFORMAT="x"', 5), ("#EXT-X-I-FRAMES-ONLY\n#EXT-X-MAP:URI=\"i\"", 5)):
        assert one(spark, f"#EXTM3U\n{body}\n", text.playlist_version) == version, body


def test_multivariant_playlist(spark):
    body = '#EXTM3U\n#EXT-X-VERSION:4\n#EXT-X-STREAM-INF:BANDWIDTH=900000,RESOLUTION=640x360,CODECS="avc1.4d401e, mp4a.40.2",AUDIO="a"\nlow/x.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=3000000,AVERAGE-BANDWIDTH=2500000,FRAME-RATE=50\nv-1080p.m3u8?t=1\n#EXT-X-I-FRAME-STREAM-INF:BANDWIDTH=1,URI="i"\n'
    p = spark.createDataFrame([("m", body)], "playlist string, text string")
    got = [(r.variant, r.bandwidth, r.average_bandwidth, r.codecs, r.width, r.frame_rate, r.audio_group, r.label) for r in text.playlist_variants(p).orderBy("variant").collect()]
    assert got == [(0, 900000.0, None, ["avc1.4d401e", "mp4a.40.2"], 640, None, "a", "360p"), (1, 3000000.0, 2500000.0, None, None, 50.0, None, "1080p")]
    tags = text.playlist_tags(p).collect()[0]
    assert (tags.kind, tags.version, tags.variants, tags.iframe_playlists, tags.end_list) == ("master", 4, 2, 1, False)


def test_rules(spark):
    assert len(audit.ALL_RULES) == 71 == len({r.id for r in audit.ALL_RULES})
    assert [len(x) for x in (audit.FILE_RULES, audit.LADDER_RULES, audit.PLAYLIST_RULES)] == [48, 7, 16]
    rules = [r for r in audit.FILE_RULES if r.id in ("even-size", "av-sync", "track-durations", "codec", "loudness", "level-holds")]
    facts = spark.createDataFrame([("a", 1920, 1081, -95.0, 10.0, 10.25, 1, 1, "hevc", None, "4.1", False, False, 77)], "entity string, width int, height int, audio_late_ms double, video_seconds double, audio_seconds double, videos int, audios int, family string, loudness double, level_name string, unconstrained boolean, level_fits boolean, entry_offset long")
    facts = audit.with_profile(facts, audit.merged_profile({"loudness": {"integrated": -16}}))
    got = {r.id: (r.level, r.severity, r.spec, r.offset) for r in audit.evaluate(facts, rules, {"av-sync": "info"}).collect()}
    assert got == {
        "even-size": ("fail", "critical", "h264", None), "av-sync": ("fail", "info", "bt1359", None), "track-durations": ("warn", "warning", "hlsAuth", None), "codec": ("pass", None, "hlsAuth", None),
        "loudness": ("skip", None, "r128", None), "level-holds": ("fail", "critical", "h265", 77),
    }


def test_profiles():
    got = audit.merged_profile({"audio": {"codec": "AAC LC"}}, {"audio": {"channelsMax": 1}, "gop": 2})
    assert got["audio"] == {"codec": "AAC LC", "channelsMax": 1} and got["gop"] == 2 and got["fpsMax"] == 60
    for wrong in ({"gopp": 2}, {"audio": {"kodec": "x"}}, {"audio": 3}):
        with pytest.raises(ValueError):
            audit.merged_profile(wrong)
    assert audit.DEFAULT_PROFILE == {"peakRatio": 2, "fpsMax": 60, "segments": [2, 4, 5, 6, 10]}


def test_as_of_slack(spark):
    rows = spark.createDataFrame([(1, 3_033_333, 90), (1, 3_066_688, 91)], "track long, t long, frame long")
    probe = spark.createDataFrame([(1, 3_066_667), (1, 3_065_000), (1, 5)], "track long, t long")
    got = {r.t: r.frame for r in joins.as_of(probe, rows, "frame", slack=1000).collect()}
    assert got == {3_066_667: 91, 3_065_000: 90, 5: 90}


def test_pictures(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (24, 32)).astype(np.uint8)
    b = np.clip(a.astype(int) + rng.integers(-20, 21, a.shape), 0, 255).astype(np.uint8)
    total, n = 0.0, 0
    for y in range(0, 24 - 7, 4):
        for x in range(0, 32 - 7, 4):
            p, q = (v[y : y + 8, x : x + 8].astype(float) for v in (a, b))
            c1, c2 = 416 / 64, 235963 / (64 * 63)
            cov = ((p - p.mean()) * (q - q.mean())).sum() / 63
            total += (2 * p.mean() * q.mean() + c1 / 64) * (2 * cov + c2) / ((p.mean() ** 2 + q.mean() ** 2 + c1 / 64) * (p.var(ddof=1) + q.var(ddof=1) + c2))
            n += 1
    assert abs(media.structural_similarity(a, b) - total / n) < 1e-9 and media.structural_similarity(a, a) == 1.0
    df = spark.createDataFrame([(32, 24, bytearray(a.tobytes()), bytearray(b.tobytes())), (32, 24, None, bytearray(b.tobytes()))], "w int, h int, a binary, b binary")
    got = df.select(media.compare_pictures("w", "h", "a", "b").alias("c")).select("c.*").collect()
    d = np.abs(a.astype(int) - b)
    assert abs(got[0].mse - (d**2).mean()) < 1e-9 and got[0].most == d.max() and abs(got[0].share - (d > 8).mean()) < 1e-12 and got[1].mse is None
    assert (media.resized(np.full((6, 9), 50, np.uint8), 4, 20) == 50).all() and media.resized(np.array([[0, 100]], np.uint8), 1, 1)[0, 0] == 50
    assert media.luma(np.array([[[255, 255, 255, 255], [0, 0, 0, 255]]], np.uint8)).tolist() == [[235, 16]]


def test_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"123456789"),), (bytearray(b""),), (None,), (bytearray(range(256)),)], "b binary")
    got = [r.x for r in df.select(media.crc32_mpeg("b").alias("x")).collect()]

    def slow(data):
        crc = 0xFFFFFFFF
        for byte in data:
            for k in range(7, -1, -1):
                crc = ((crc << 1) ^ (0x04C11DB7 if (crc >> 31 ^ byte >> k) & 1 else 0)) & 0xFFFFFFFF
        return crc

    assert got == [0x0376E6E7, 0xFFFFFFFF, None, slow(range(256))]
    b = F.unhex(F.lit("000003010000030000030203"))
    row = spark.range(1).select(
        F.hex(media.unescaped(b)).alias("n"), media.read_bits(b, F.lit(20), 12).alias("bits"), media.uuid(F.unhex(F.lit("00112233445566778899AABBCCDDEEFF"))).alias("u"), media.guid(F.unhex(F.lit("00112233445566778899AABBCCDDEEFF"))).alias("g"),
        F.date_format(media.date_mjd(F.unhex(F.lit("C079124500"))), "yyyy-MM-dd HH:mm:ss").alias("d"), media.timecode(F.lit(17982), 30, drop=True).alias("t"), media.text_of(F.unhex(F.lit("4142004344"))).alias("s"),
        F.date_format(media.date_2001(F.lit(1_000_000_000)), "yyyy-MM-dd HH:mm:ss").alias("e"),
    ).collect()[0]
    assert tuple(row) == ("0000010000000002" + "03", 0x301, "00112233-4455-6677-8899-aabbccddeeff", "33221100-5544-7766-8899-AABBCCDDEEFF", "1993-10-13 12:45:00", "00:10:00;00", "AB", "2001-01-01 00:00:01")
    assert media.search_pattern("0x0001") == b"\0\x01" and media.search_pattern("de ad") == b"\xde\xad" and media.search_pattern('"de"') == b"de" and media.search_pattern(" ") is None


def test_package_zip(tmp_path):
    import subprocess
    import sys

    from framelake.session import package_zip

    at = package_zip(str(tmp_path / "p.zip"))
    code = f"import sys; sys.path = [p for p in sys.path if p and 'repo' not in p]; sys.path.insert(0, {at!r}); import framelake.sources.media as m; assert {at!r} in m.__file__"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_number_texts_of_large_keys(spark, con, tmp_path):
    """Times beyond any timestamp, sizes beyond T and milliseconds that doubles only just tell apart."""
    keys = [172_384, 500_000, 900_000, *range(8_990_000, 8_990_500), 15_000_001]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    own = duckdb.connect()
    own.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    got = media_plans.number_texts(spark, str(tmp_path)).select("id", "size", "rate", "at", "length").collect()
    assert Counter(map(tuple, got)) == Counter(own.sql(f"select id, size, rate, \"at\", length from ({media_plans.SQL['number_texts']})").fetchall())


def test_date_1904(spark):
    n = F.col("n")
    rows = spark.createDataFrame([(0,), (2_082_844_801,), (37 * 900_000**2,), (1 << 62,)], "n long")
    assert [tuple(r) for r in rows.select(F.unix_seconds(media.date_1904(n)), media.unix_1904(n)).collect()] == [(None, None), (1, 1), (None, 37 * 900_000**2 - 2_082_844_800), (None, (1 << 62) - 2_082_844_800)]
    assert [r[0] for r in spark.createDataFrame([(7457.867,), (-1.5,), (59.9996,)], "s double").select(media.duration_text(F.col("s"))).collect()] == ["2:04:17.867", "-0:01.500", "1:00.000"]


def shuffled(spark):
    """Rows that this session's stages have written for others."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_ladder_rules_move_each_rendition_once(spark, sf_dir):
    before = shuffled(spark)
    audit_plans.audit_ladder_rules(spark, sf_dir).collect()
    assert shuffled(spark) - before < 6 * spark.read.parquet(f"{sf_dir}/orders.parquet").count()


@pytest.mark.parametrize("chunk", [1, 40, 1 << 18])
def test_ladders_compared_as_their_rows_say(spark, monkeypatch, chunk):
    """The counts by ladder against the operators that give key frames and plans as rows: shuffled, repeated, missing and crowded keys."""
    rng = random.Random(chunk)
    rend, keys = [], []
    for n in range(40):
        for f in range(rng.randint(1, 5)):
            rend.append((f"l{n}", f"{n}-{f}", rng.choice([25.0, 50.0, 12.5, 0.0, None]) if n % 3 else 25.0, rng.choice([30_000_000, None]) if n % 4 == 0 else 30_000_000))
            if n % 9 == 8 and f == n % 2:
                continue
            step, near = rng.choice([2_000_000, 1_000_000, 30_000]) if n % 5 == 4 else 2_000_000, n % 2 * 42_000
            times = [k * step + rng.choice([0, 0, 0, near]) for k in range(15) if n % 3 or rng.random() < 0.95]
            times += rng.choices(times, k=2) if times and n % 6 == 1 else []
            rng.shuffle(times)
            keys += [(f"l{n}", f"{n}-{f}", t) for t in times]
    keys += [("l0", "other", 5), ("none", "x", 0)]
    rend = spark.createDataFrame(rend, "ladder string, file string, fps double, fin long")
    keys = spark.createDataFrame(keys, "ladder string, file string, t long")
    tolerance = rend.groupBy("ladder").agg(ladder.key_tolerance(F.col("fps")).alias("tol"), F.count("*").alias("renditions"))
    lengths = [4_000_000, 2_000_000, 15_000, 5_000_000]
    odd = dict(ladder.unmatched_keys(keys, tolerance).groupBy("ladder").count().collect())
    plans = ladder.segment_plans(rend, keys, tolerance, lengths).collect()
    bare = dict(rend.join(keys, ["ladder", "file"], "left_anti").groupBy("ladder").count().collect())
    monkeypatch.setattr(ladder, "CHUNK", chunk)
    got = {r.ladder: r for r in ladder.compared(rend, keys, lengths).collect()}
    assert set(got) == {f"l{n}" for n in range(40)}
    for name, r in got.items():
        mine = [p for p in plans if p.ladder == name]
        assert (r.unmatched, r.bare) == (odd.get(name, 0), bare.get(name, 0)), name
        assert (r.fitting, r.aligned_lengths) == (sorted(p.len / 1e6 for p in mine if p.aligned and p.long == 0), sum(p.aligned for p in mine)), name
    assert {bool(r.unmatched) for r in got.values()} == {len(r.fitting) > 0 for r in got.values()} == {True, False}
    assert ladder.compared(rend, keys.limit(0), lengths).where("unmatched + aligned_lengths = 0").count() == 40
