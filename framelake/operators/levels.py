"""Codec levels: tables, the lowest level that a stream fits, and whether a signalled one holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The level tables of four codecs. H.264 Table A-1: name, level_idc, macroblocks a second, macroblocks a
# frame, macroblocks of the picture buffer, bit rate and buffer (times the factor of the profile).
AVC = [
    ("1", 10, 1485, 99, 396, 64, 175),
    ("1b", 9, 1485, 99, 396, 128, 350),
    ("1.1", 11, 3000, 396, 900, 192, 500),
    ("1.2", 12, 6000, 396, 2376, 384, 1000),
    ("1.3", 13, 11880, 396, 2376, 768, 2000),
    ("2", 20, 11880, 396, 2376, 2000, 2000),
    ("2.1", 21, 19800, 792, 4752, 4000, 4000),
    ("2.2", 22, 20250, 1620, 8100, 4000, 4000),
    ("3", 30, 40500, 1620, 8100, 10000, 10000),
    ("3.1", 31, 108000, 3600, 18000, 14000, 14000),
    ("3.2", 32, 216000, 5120, 20480, 20000, 20000),
    ("4", 40, 245760, 8192, 32768, 20000, 25000),
    ("4.1", 41, 245760, 8192, 32768, 50000, 62500),
    ("4.2", 42, 522240, 8704, 34816, 50000, 62500),
    ("5", 50, 589824, 22080, 110400, 135000, 135000),
    ("5.1", 51, 983040, 36864, 184320, 240000, 240000),
    ("5.2", 52, 2073600, 36864, 184320, 240000, 240000),
    ("6", 60, 4177920, 139264, 696320, 240000, 240000),
    ("6.1", 61, 8355840, 139264, 696320, 480000, 480000),
    ("6.2", 62, 16711680, 139264, 696320, 800000, 800000),
]
#: H.264 Table A-2: factor of bit rate and buffer for the whole stream, by profile_idc.
AVC_FACTORS = {66: 1200, 77: 1200, 88: 1200, 100: 1500, 110: 3600, 122: 4800, 244: 4800, 44: 4800}
#: H.265 Tables A.8 and A.9: name, level_idc, luma samples a picture, buffer (main, high tier), luma samples a second, bit rate (main, high tier).
HEVC = [
    ("1", 30, 36864, 350, None, 552960, 128, None),
    ("2", 60, 122880, 1500, None, 3686400, 1500, None),
    ("2.1", 63, 245760, 3000, None, 7372800, 3000, None),
    ("3", 90, 552960, 6000, None, 16588800, 6000, None),
    ("3.1", 93, 983040, 10000, None, 33177600, 10000, None),
    ("4", 120, 2228224, 12000, 30000, 66846720, 12000, 30000),
    ("4.1", 123, 2228224, 20000, 50000, 133693440, 20000, 50000),
    ("5", 150, 8912896, 25000, 100000, 267386880, 25000, 100000),
    ("5.1", 153, 8912896, 40000, 160000, 534773760, 40000, 160000),
    ("5.2", 156, 8912896, 60000, 240000, 1069547520, 60000, 240000),
    ("6", 180, 35651584, 60000, 240000, 1069547520, 60000, 240000),
    ("6.1", 183, 35651584, 120000, 480000, 2139095040, 120000, 480000),
    ("6.2", 186, 35651584, 240000, 800000, 4278190080, 240000, 800000),
]
HEVC_FACTORS = {1: 1100, 2: 1100, 3: 1100}
#: AV1 Annex A.3: name, seq_level_idx, samples a picture, width, height, samples shown a second, Mbit/s (main, high tier).
AV1 = [
    ("2.0", 0, 147456, 2048, 1152, 4423680, 1.5, None),
    ("2.1", 1, 278784, 2816, 1584, 8363520, 3.0, None),
    ("3.0", 4, 665856, 4352, 2448, 19975680, 6.0, None),
    ("3.1", 5, 1065024, 5504, 3096, 31950720, 10.0, None),
    ("4.0", 8, 2359296, 6144, 3456, 70778880, 12.0, 30.0),
    ("4.1", 9, 2359296, 6144, 3456, 141557760, 20.0, 50.0),
    ("5.0", 12, 8912896, 8192, 4352, 267386880, 30.0, 100.0),
    ("5.1", 13, 8912896, 8192, 4352, 534773760, 40.0, 160.0),
    ("5.2", 14, 8912896, 8192, 4352, 1069547520, 60.0, 240.0),
    ("5.3", 15, 8912896, 8192, 4352, 1069547520, 60.0, 240.0),
    ("6.0", 16, 35651584, 16384, 8704, 1069547520, 60.0, 240.0),
    ("6.1", 17, 35651584, 16384, 8704, 2139095040, 100.0, 480.0),
    ("6.2", 18, 35651584, 16384, 8704, 4278190080, 160.0, 800.0),
    ("6.3", 19, 35651584, 16384, 8704, 4278190080, 160.0, 800.0),
]
AV1_FACTORS = {0: 1, 1: 2, 2: 3}
#: WebM project: name, ten times the level, luma samples a second, luma samples a picture, longest side, kbit/s, kbit in four frames.
VP9 = [
    ("1", 10, 829440, 36864, 512, 200, 400),
    ("1.1", 11, 2764800, 73728, 768, 800, 1000),
    ("2", 20, 4608000, 122880, 960, 1800, 1500),
    ("2.1", 21, 9216000, 245760, 1344, 3600, 2800),
    ("3", 30, 20736000, 552960, 2048, 7200, 6000),
    ("3.1", 31, 36864000, 983040, 2752, 12000, 10000),
    ("4", 40, 83558400, 2228224, 4160, 18000, 16000),
    ("4.1", 41, 160432128, 2228224, 4160, 30000, 18000),
    ("5", 50, 311951360, 8912896, 8384, 60000, 36000),
    ("5.1", 51, 588251136, 8912896, 8384, 120000, 46000),
    ("5.2", 52, 1176502272, 8912896, 8384, 180000, None),
    ("6", 60, 1176502272, 35651584, 16832, 180000, None),
    ("6.1", 61, 2353004544, 35651584, 16832, 240000, None),
    ("6.2", 62, 4706009088, 35651584, 16832, 480000, None),
]

_COLUMNS = {
    "avc": ("name idc rate size dpb br cpb", AVC),
    "hevc": ("name idc size cpb_main cpb_high rate br_main br_high", HEVC),
    "av1": ("name idc size width height rate br_main br_high", AV1),
    "vp9": ("name idc rate size side br cpb", VP9),
}


def _table(codec: str) -> Column:
    names, rows = _COLUMNS[codec]
    cast = lambda n, v: F.lit(v).cast("string" if n == "name" else "double").alias(n)
    return F.array(*[F.struct(*[cast(n, v) for n, v in zip(names.split(), row, strict=True)]) for row in rows])


def _factor(factors: dict[int, int]) -> str:
    return "case profile " + " ".join(f"when {k} then {v}" for k, v in factors.items()) + " end"


def _holds(value: str, most: str) -> str:
    """True where either side isn't known; limits allow for rounding by one part in 10**9."""
    return f"coalesce({value} <= ({most}) * (1 + 1e-9), true)"


#: Hard limits by codec, over the columns of a stream and a level ``l``. A buffer or a peak may be exceeded, these not.
LIMITS = {
    "avc": {
        "size": _holds("ceil(width / 16) * ceil(height / 16)", "l.size"),
        "side": _holds("greatest(ceil(width / 16), ceil(height / 16))", "floor(sqrt(8 * l.size))"),
        "rate": _holds("ceil(width / 16) * ceil(height / 16) * fps", "l.rate"),
        "dpb": _holds("greatest(refs, dpb)", "least(floor(l.dpb / (ceil(width / 16) * ceil(height / 16))), 16)"),
        "bitrate": _holds("bitrate", f"l.br * ({_factor(AVC_FACTORS)})"),
        "buffer": _holds("buffer_bits", f"l.cpb * ({_factor(AVC_FACTORS)})"),
    },
    "hevc": {
        "size": _holds("width * height", "l.size"),
        "side": _holds("greatest(width, height)", "floor(sqrt(8 * l.size))"),
        "rate": _holds("width * height * fps", "l.rate"),
        "dpb": _holds("dpb", "case when width * height <= l.size / 4 then 16 when width * height <= l.size / 2 then 12 when width * height <= l.size * 3 / 4 then 8 else 6 end"),
        "tier": f"not coalesce(high_tier and l.br_high is null and ({_factor(HEVC_FACTORS)}) is not null, false)",
        "bitrate": _holds("bitrate", f"if(high_tier, l.br_high, l.br_main) * ({_factor(HEVC_FACTORS)})"),
        "buffer": _holds("buffer_bits", f"if(high_tier, l.cpb_high, l.cpb_main) * ({_factor(HEVC_FACTORS)})"),
    },
    "av1": {
        "size": _holds("width * height", "l.size"),
        "width": _holds("width", "l.width"),
        "height": _holds("height", "l.height"),
        "rate": _holds("width * height * fps", "l.rate"),
        "bitrate": _holds("bitrate", f"if(coalesce(high_tier, false), coalesce(l.br_high, l.br_main), l.br_main) * 1000000 * coalesce({_factor(AV1_FACTORS)}, 1)"),
    },
    "vp9": {
        "size": _holds("width * height", "l.size"),
        "side": _holds("greatest(width, height)", "l.side"),
        "rate": _holds("width * height * fps", "l.rate"),
        "bitrate": _holds("bitrate", "l.br * 1000"),
        "buffer": _holds("run_bits", "l.cpb * 1000"),
    },
}
#: Columns of a stream that limits read; those that a table lacks are taken as unknown.
STREAM = {"width": "double", "height": "double", "fps": "double", "refs": "double", "dpb": "double", "bitrate": "double", "buffer_bits": "double", "run_bits": "double", "profile": "int", "high_tier": "boolean", "level_idc": "int", "low_rate_1b": "boolean"}


def check_levels(streams: DataFrame) -> DataFrame:
    """``streams`` (codec: avc, hevc, av1 or vp9, and what is known of STREAM) with ``level_name`` (signalled, null where
    unknown), ``level_fits`` (all its hard limits hold), ``broken`` (names of those that don't), ``lowest_level`` (the
    first of the codec's whose limits all hold, null if none) and ``unconstrained``.

    A pass over the rows: tables are literals, nothing is joined. ``low_rate_1b`` says that level_idc 11 means 1b.
    """
    own = [c for c in streams.columns]
    s = streams.withColumns({c: F.lit(None).cast(t) for c, t in STREAM.items() if c not in own})
    fits, names, lowest, broken = F.lit(None).cast("boolean"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for codec, limits in LIMITS.items():
        is_codec = F.col("codec") == codec
        s = s.withColumn("__t", _table(codec))
        wanted = "if(level_idc = 11 and coalesce(low_rate_1b, false) and profile in (66, 77, 88), 9, level_idc)" if codec == "avc" else "level_idc"
        row = f"try_element_at(filter(__t, l -> l.idc = {wanted}), 1)"
        every = " and ".join(limits.values())
        s = s.withColumn("__row", F.expr(row)).withColumn("__low", F.expr(f"try_element_at(filter(__t, l -> {every}), 1).name"))
        bad = "filter(array(" + ", ".join(f"if({cond.replace('l.', '__row.')}, null, '{name}')" for name, cond in limits.items()) + "), x -> x is not null)"
        s = s.withColumn("__bad", F.expr(bad))
        names = F.when(is_codec, F.col("__row.name")).otherwise(names)
        lowest = F.when(is_codec, F.col("__low")).otherwise(lowest)
        broken = F.when(is_codec & F.col("__row").isNotNull(), F.col("__bad")).otherwise(broken)
        s = s.withColumns({f"__name_{codec}": names, f"__lowest_{codec}": lowest, f"__broken_{codec}": broken})
        names, lowest, broken = (F.col(f"__{n}_{codec}") for n in ("name", "lowest", "broken"))
    free = ((F.col("codec") == "hevc") & (F.col("level_idc") == 255)) | ((F.col("codec") == "av1") & (F.col("level_idc") == 31))
    fits = F.when(broken.isNotNull(), F.size(broken) == 0)
    return s.select(*own, names.alias("level_name"), fits.alias("level_fits"), broken.alias("broken"), lowest.alias("lowest_level"), F.coalesce(free, F.lit(False)).alias("unconstrained"))
