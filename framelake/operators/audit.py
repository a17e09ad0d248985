"""Rules as data: each is a handful of SQL expressions over a table with one row of facts by entity.

All rules of a scope are evaluated in one pass: an array of structs is built by row and exploded, so nothing is
shuffled and nothing leaves the JVM. What a service expects (its profile) stands in the facts as ``ex_`` columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

LEVELS = ("fail", "warn", "info", "pass", "skip")  # worst first


@dataclass(frozen=True)
class Rule:
    """``level`` gives pass, info, warn or fail where ``applies`` holds (null emits nothing); where it doesn't and
    ``unmeasured`` holds, the rule is reported as skipped. ``spec`` and ``clause`` may be overridden by expressions."""

    id: str
    category: str
    severity: str
    spec: str
    clause: str
    applies: str
    level: str
    value: str = "null"
    expected: str = "null"
    offset: str = "null"
    unmeasured: str = "false"
    scope: str = "file"
    spec_of: str = "null"


def _yes(condition: str, other: str = "fail") -> str:
    return f"if({condition}, 'pass', '{other}')"


# Ids, scopes, categories, severities, sources, thresholds and lists of the rules.
SEGMENTS = (2, 4, 5, 6, 10)
SIZE_TIERS = (144, 240, 360, 480, 540, 720, 1080, 1440, 2160, 4320)
DEFAULT_PROFILE = {"peakRatio": 2, "fpsMax": 60, "segments": list(SEGMENTS)}
#: What a profile may hold: name -> SQL type, or the names below it.
PROFILE = {
    "peakRatio": "double", "fpsMax": "double", "fpsMin": "double", "gop": "double", "gopMax": "double", "segments": "array<double>",
    "audio": {"required": "boolean", "codec": "string", "sampleRate": "int", "channelsMax": "int", "minBitratePerChannel": "double"},
    "loudness": {"integrated": "double", "tolerance": "double", "truePeakMax": "double"},
    "colour": {"primaries": "int", "transfer": "int", "matrix": "int"},
    "overlay": {"severity": "map<string,string>", "levelCap": "array<struct<height:int,fpsMax:double,level:double>>"},
}

FILE_RULES = (
    Rule("fast-start", "Container", "critical", "practice", "index before media", "is_mp4 and moov is not null and mdat is not null and not fragmented", _yes("moov < mdat"), "moov", offset="moov"),
    Rule("interleaved", "Container", "warning", "practice", "chunks alternate", "drift is not null", _yes("drift <= 2", "warn"), "drift"),
    Rule("edit-list", "Container", "warning", "isobmff", "8.6.6", "edits > 1", "'warn'", "edits"),
    Rule("integrity", "Container", "critical", "isobmff", "sample tables", "is_mp4", _yes("bad_insights = 0"), "bad_insights", offset="bad_offset"),
    Rule("one-video-track", "Container", "critical", "practice", "one picture track", "true", "case videos when 1 then 'pass' when 0 then 'fail' else 'warn' end", "videos"),
    Rule("has-audio", "Container", "critical", "practice", "sound where required", "audios = 0", "if(coalesce(ex_audio_required, false), 'fail', 'info')"),
    Rule("track-durations", "Container", "warning", "hlsAuth", "8.3", "video_seconds > 0 and audio_seconds > 0", "case when abs(video_seconds - audio_seconds) <= 0.1 then 'pass' when abs(video_seconds - audio_seconds) <= 0.5 then 'warn' else 'fail' end", "round(abs(video_seconds - audio_seconds), 6)"),
    Rule("codec", "Video", "critical", "hlsAuth", "1.1", "videos > 0", _yes("coalesce(family in ('avc', 'hevc', 'av1'), false)"), "family"),
    Rule("profile", "Video", "critical", "hlsAuth", "1.3b, 1.4", "family = 'avc' and profile is not null", "case when profile = 100 then 'pass' when profile in (66, 77) then 'warn' else 'fail' end", "profile", offset="entry_offset"),
    Rule("level-holds", "Video", "critical", "h264", "Table A-1", "level_name is not null and not unconstrained", _yes("coalesce(level_fits, true)"), "level_name", offset="entry_offset", spec_of="case family when 'hevc' then 'h265' when 'av1' then 'av1' when 'vp9' then 'vp9' else 'h264' end"),
    Rule("level-minimal", "Video", "warning", "hlsAuth", "1.11", "level_name is not null and lowest_level is not null and not unconstrained", _yes("lowest_level = level_name", "warn"), "level_name", "lowest_level", "entry_offset"),
    Rule("level-policy", "Video", "critical", "practice", "cap by rendition", "ex_overlay_levelCap is not null and level_name is not null and height > 0 and fps > 0",
         "case when level_cap is null then null when try_cast(level_name as double) > level_cap then 'fail' else 'pass' end", "level_name", "level_cap", "entry_offset"),
    Rule("level-cap", "Video", "critical", "hlsAuth", "1.3b", "family = 'avc' and level_idc is not null", _yes("level_idc <= 52"), "level_idc / 10", "5.2", "entry_offset"),
    Rule("even-size", "Video", "critical", "h264", "7.4.2.1.1", "width > 0 and height > 0", _yes("width % 2 = 0 and height % 2 = 0"), "concat(width, 'x', height)"),
    Rule("square-pixels", "Video", "warning", "practice", "sample aspect 1:1", "sar_w is not null and sar_h is not null", _yes("sar_w = sar_h or sar_w = 0 or sar_h = 0", "warn"), "concat(sar_w, ':', sar_h)", offset="entry_offset"),
    Rule("fps-range", "Video", "critical", "hlsAuth", "1.19", "fps > 0", "case when fps > 60.01 then 'fail' when ex_fpsMax > 0 and fps > ex_fpsMax + 0.01 then 'warn' when ex_fpsMin > 0 and fps < ex_fpsMin then 'warn' else 'pass' end", "fps",
         "case when fps > 60.01 then 60 when ex_fpsMax > 0 and fps > ex_fpsMax + 0.01 then ex_fpsMax when ex_fpsMin > 0 and fps < ex_fpsMin then ex_fpsMin end"),
    Rule("fps-constant", "Video", "warning", "hlsAuth", "1.18, 8.14", "vfr is not null", _yes("not vfr", "warn"), "vfr"),
    Rule("gop-fixed", "Video", "warning", "hlsAuth", "7.4, 7.6", "gops >= 2", "case when odd_gops = 0 then 'pass' when odd_gops <= greatest(2, ceil(0.05 * counted_gops)) and odd_all_shorter then 'info' else 'warn' end", "odd_gops", offset="odd_offset"),
    Rule("gop-length", "Video", "warning", "hlsAuth", "1.13", "gops >= 2", "case when ex_gop > 0 then if(abs(gop_seconds - ex_gop) <= 0.05, 'pass', 'fail') when gop_seconds > 2.05 then 'warn' else 'pass' end", "gop_seconds", "case when ex_gop > 0 then ex_gop when gop_seconds > 2.05 then 2 end"),
    Rule("gop-max", "Video", "critical", "hlsAuth", "7.4, 7.7", "gops >= 2 and ex_gopMax > 0", _yes("gop_max_seconds <= ex_gopMax + 0.05"), "gop_max_seconds", "ex_gopMax"),
    Rule("closed-gop", "Video", "warning", "rfc8216", "3", "classified > 0 and gops >= 1", _yes("open_gops = 0", "warn"), "open_gops"),
    Rule("key-is-idr", "Video", "critical", "hlsAuth", "7.4", "classified > 0", _yes("keys_not_rap = 0"), "keys_not_rap"),
    Rule("b-frames", "Video", "critical", "h264", "A.2.1", "classified > 0 and max_b > 0", "if(family = 'avc' and profile = 66, 'fail', 'info')", "max_b"),
    Rule("peak-ratio", "Video", "warning", "hlsAuth", "1.30", "avg_rate > 0 and seconds >= 3", _yes("coalesce(segment_rate / avg_rate, second_ratio) <= ex_peakRatio", "warn"), "round(coalesce(segment_rate / avg_rate, second_ratio), 3)", "ex_peakRatio"),
    Rule("vbv", "Video", "warning", "practice", "capped rate", "rc_mode is not null", _yes("coalesce(maxrate > 0 and bufsize > 0, false)", "warn"), "maxrate", offset="sei_offset"),
    Rule("scenecut", "Video", "info", "practice", "fixed key frames", "scenecut is not null and ex_gop > 0", _yes("scenecut = 0", "info"), "scenecut", offset="sei_offset"),
    Rule("bits-per-pixel", "Video", "warning", "practice", "bits a pixel", "bpp > 0", "case when bpp >= if(family = 'hevc', 0.02, 0.03) then 'info' when rc_mode = 'crf' then 'info'"
         " when rc_mode = 'capped-crf' and not coalesce(maxrate > 0 and avg_rate >= 800 * maxrate, false) then 'info' else 'warn' end", "bpp"),
    Rule("colour-signalled", "Colour", "critical", "h273", "tables 2 to 4", "has_sps", _yes("coalesce(primaries <> 2 and transfer <> 2 and matrix <> 2, false)"), "concat_ws('/', primaries, transfer, matrix)", offset="entry_offset"),
    Rule("hdr-consistent", "Colour", "critical", "h273", "BT.2100", "transfer in (16, 18)", "if(primaries = 9 and matrix in (9, 10) and coalesce(depth, 8) >= 10, 'info', 'fail')", "concat_ws('/', primaries, transfer, matrix)", offset="entry_offset"),
    Rule("colour-consistent", "Colour", "critical", "h273", "primaries and matrix", "not transfer in (16, 18) and primaries <> 2 and matrix <> 2", _yes("(primaries = 9) = (matrix in (9, 10))"), "concat_ws('/', primaries, transfer, matrix)", offset="entry_offset"),
    Rule("colour-expected", "Colour", "warning", "hlsAuth", "1.21", "primaries is not null and coalesce(ex_colour_primaries, ex_colour_transfer, ex_colour_matrix) is not null",
         _yes("coalesce(ex_colour_primaries, primaries) <=> primaries and coalesce(ex_colour_transfer, transfer) <=> transfer and coalesce(ex_colour_matrix, matrix) <=> matrix"), "concat_ws('/', primaries, transfer, matrix)", offset="entry_offset"),
    Rule("range", "Colour", "warning", "h273", "full range flag", "full_range is not null", _yes("not full_range", "warn"), "full_range", offset="entry_offset"),
    Rule("depth", "Video", "critical", "hlsAuth", "1.3b", "family = 'avc' and depth > 0", _yes("depth <= 8"), "depth", offset="entry_offset"),
    Rule("brands", "Container", "info", "isobmff", "4.3", "is_mp4 and brands is not null", "case when exists(brands, b -> b in ('cmfc', 'cmf2')) and not fragmented then 'fail' when exists(brands, b -> trim(b) = 'qt') then 'info'"
         " when not exists(brands, b -> b rlike '^(iso[1-9m]|mp4[12]|cmf[c2])$') then 'warn' else 'info' end", "array_join(brands, ',')"),
    Rule("display-aspect", "Video", "warning", "isobmff", "8.3.2", "width > 0 and height > 0 and display_width > 0 and display_height > 0", _yes("abs(display_width / display_height - aspect) / aspect < 0.02 or abs(display_height / display_width - aspect) / aspect < 0.02", "warn"),
         "concat(display_width, 'x', display_height)", "concat(width, 'x', height)"),
    Rule("hdr-metadata", "Colour", "warning", "hlsAuth", "1.35", "transfer = 16 and has_entry_boxes", _yes("has_mdcv and has_clli", "warn"), offset="entry_offset"),
    Rule("fragments", "Container", "critical", "hlsAuth", "7.3", "moofs > 0", _yes("fragment_problems = 0"), "if(fragment_problems = 0, moofs, fragment_problems)"),
    Rule("vbv-holds", "Video", "critical", "h264", "Annex C", "maxrate > 0 and bufsize > 0 and frames > 1", _yes("underflows = 0"), "underflows"),
    Rule("audio-codec", "Audio", "warning", "hlsAuth", "2.2, 2.3, 2.5", "audios > 0", "case when ex_audio_codec is not null and not ex_audio_codec <=> audio_codec then 'fail' when coalesce(audio_codec like '%AAC%', false) then 'pass' else 'warn' end", "audio_codec", "ex_audio_codec"),
    Rule("audio-rate", "Audio", "warning", "practice", "44.1 or 48 kHz", "sample_rate > 0", "case when ex_audio_sampleRate > 0 then if(sample_rate = ex_audio_sampleRate, 'pass', 'fail') when sample_rate in (44100, 48000) then 'pass' else 'warn' end", "sample_rate", "ex_audio_sampleRate"),
    Rule("audio-channels", "Audio", "critical", "hlsAuth", "9.6", "channels > 0", "case when channels > 2 then 'fail' when channels > coalesce(ex_audio_channelsMax, 2) then 'warn' else 'pass' end", "channels", "coalesce(ex_audio_channelsMax, 2)"),
    Rule("audio-bitrate", "Audio", "warning", "practice", "2.9", "audio_bitrate > 0 and channels > 0", _yes("audio_bitrate / channels >= coalesce(ex_audio_minBitratePerChannel, 48000)", "warn"), "audio_bitrate / channels"),
    Rule("audio-priming", "Audio", "warning", "priming", "8.6.6", "audios > 0 and audio_codec like '%AAC%' and format in ('isobmff', 'matroska')", _yes("coalesce(priming_ms, 0) > 0", "warn"), "coalesce(priming_ms, 0)"),
    Rule("loudness", "Audio", "warning", "r128", "(h)", "loudness is not null", "case when ex_loudness_integrated is null then 'info' when abs(loudness - ex_loudness_integrated) <= coalesce(ex_loudness_tolerance, 1) then 'pass' else 'fail' end", "loudness", "ex_loudness_integrated", unmeasured="audios > 0"),
    Rule("true-peak", "Audio", "warning", "r128", "(m)", "true_peak is not null", _yes("true_peak <= coalesce(ex_loudness_truePeakMax, -1)"), "true_peak", "coalesce(ex_loudness_truePeakMax, -1)", unmeasured="audios > 0"),
    Rule("av-sync", "Audio", "critical", "bt1359", "detection and acceptance", "audio_late_ms is not null", "case when abs(audio_late_ms) <= 22 then 'pass' when audio_late_ms > 185 or audio_late_ms < -90 then 'fail' else 'warn' end", "audio_late_ms", unmeasured="audios > 0 and videos > 0"),
    Rule("quality", "Video", "warning", "practice", "like the source", "psnr is not null or ssim is not null or vmaf is not null", "if(coalesce(psnr < 30, false) or coalesce(ssim < 0.9, false) or coalesce(vmaf < 70, false), 'warn', 'info')", "coalesce(psnr, ssim, vmaf)", unmeasured="videos > 0"),
    Rule("decode-integrity", "Decoding", "critical", "practice", "all frames decode", "decode_errors is not null or decode_failed", "case when decode_failed then 'skip' when decode_errors = 0 then 'pass' else 'fail' end", "decode_errors", unmeasured="videos > 0 or audios > 0"),
)

LADDER_RULES = tuple(
    replace(r, scope="ladder")
    for r in (
        Rule("idr-aligned", "Ladder", "critical", "hlsAuth", "8.22, 7.4", "renditions >= 2 and all_have_keys", _yes("unmatched_keys = 0"), "unmatched_keys"),
        Rule("segment-lengths", "Ladder", "critical", "rfc8216", "4.3.3.1", "renditions >= 2 and all_have_keys", "case when size(fitting_lengths) > 0 then 'pass' when aligned_lengths > 0 then 'warn' else 'fail' end", "array_join(fitting_lengths, ',')"),
        Rule("frame-rates", "Ladder", "info", "hlsAuth", "1.31", "renditions >= 2", _yes("rates = 1", "info"), "rates"),
        Rule("same-audio", "Ladder", "warning", "rfc8216", "6.2.4", "with_audio > 0", _yes("audio_kinds = 1", "warn"), "audio_kinds"),
        Rule("bitrate-steps", "Ladder", "warning", "practice", "1.5 to 2 times", "rated >= 2", "case when steps_up > 0 then 'fail' when odd_steps > 0 then 'info' else 'pass' end", "odd_steps"),
        Rule("label-matches-size", "Ladder", "warning", "practice", "names", "labelled > 0", _yes("mislabelled = 0", "warn"), "mislabelled"),
        Rule("levels", "Ladder", "warning", "hlsAuth", "1.3a", "renditions >= 1", "if(avc_levels > 0 and avc_low_levels = 0, 'warn', 'info')", "avc_low_levels"),
    )
)

#: A presentation that can still change gets a warning where one on demand fails.
_VOD = "if(vod, 'fail', 'warn')"
PLAYLIST_RULES = tuple(
    replace(r, scope="playlist")
    for r in (
        Rule("hls-reachable", "Delivery", "critical", "rfc8216", "6.2.1", "playlists > 0", _yes("playlist_errors = 0 and segment_errors = 0"), "playlist_errors + segment_errors"),
        Rule("hls-bandwidth", "Delivery", "critical", "hlsAuth", "1.27", "has_master and peaked > 0", f"if(peaks_off = 0, 'pass', {_VOD})", "peaks_off"),
        Rule("hls-average-bandwidth", "Delivery", "critical", "hlsAuth", "9.14, 1.26", "has_master and variants > 0", f"case when no_average > 0 then 'fail' when averages_off = 0 then 'pass' else {_VOD} end", "if(no_average > 0, no_average, averages_off)"),
        Rule("hls-codecs", "Delivery", "critical", "hlsAuth", "9.1", "has_master and variants > 0", "case when no_codecs > 0 or codecs_other > 0 then 'fail' when codecs_close > 0 then 'warn' else 'pass' end", "if(no_codecs > 0, no_codecs, codecs_other)"),
        Rule("hls-resolution", "Delivery", "critical", "hlsAuth", "9.2", "has_master and pictures > 0", "case when no_resolution > 0 then 'fail' when resolutions_off > 0 then 'warn' else 'pass' end", "if(no_resolution > 0, no_resolution, resolutions_off)"),
        Rule("hls-frame-rate", "Delivery", "critical", "hlsAuth", "9.15", "has_master and pictures > 0", "case when no_frame_rate > 0 then 'fail' when frame_rates_off > 0 then 'warn' else 'pass' end", "if(no_frame_rate > 0, no_frame_rate, frame_rates_off)"),
        Rule("hls-segment-durations", "Delivery", "critical", "rfc8216", "4.3.3.1", "targeted > 0", _yes("segments_long = 0"), "segments_long"),
        Rule("hls-target-duration", "Delivery", "warning", "hlsAuth", "7.5", "with_target > 0", "case when targets_not_6 = 0 then 'pass' when ex_intended is not null and targets_not_intended = 0 then 'pass' else 'warn' end", "targets_not_6", "6"),
        Rule("hls-same-target", "Delivery", "critical", "rfc8216", "6.2.4", "plain >= 2", _yes("targets = 1"), "targets"),
        Rule("hls-aligned", "Delivery", "critical", "hlsAuth", "8.22", "variant_playlists >= 2", _yes("edges_off = 0"), "first_edge_off"),
        Rule("hls-same-duration", "Delivery", "critical", "hlsAuth", "8.3, 8.7", "plain >= 2", _yes("duration_spread <= 0.05"), "round(duration_spread, 6)"),
        Rule("hls-playlist-type", "Delivery", "critical", "hlsAuth", "8.6", "ended > 0", _yes("ended_not_vod = 0"), "ended_not_vod"),
        Rule("hls-iframes", "Delivery", "critical", "hlsAuth", "6.1", "has_master", _yes("iframe_playlists > 0"), "iframe_playlists"),
        Rule("hls-starts-idr", "Delivery", "critical", "hlsAuth", "7.4", "probed > 0", _yes("probes_not_key = 0"), "probes_not_key"),
        Rule("hls-independent", "Delivery", "warning", "hlsAuth", "9.11", "has_master and probed > 0 and probes_not_key = 0", _yes("independent", "warn")),
        Rule("hls-version", "Delivery", "critical", "rfc8216", "7", "parsed > 0 or has_master", _yes("versions_off = 0"), "versions_off"),
    )
)
ALL_RULES = FILE_RULES + LADDER_RULES + PLAYLIST_RULES


# profiles


def merged_profile(*layers: Mapping) -> dict:
    """Profiles laid over the default one, deeply; later ones win. A name that a profile can't hold is an error."""
    out: dict = {k: v for k, v in DEFAULT_PROFILE.items()}

    def lay(base: dict, layer: Mapping, known: Mapping, where: str) -> dict:
        for name, value in layer.items():
            if name not in known:
                raise ValueError(f"unknown expectation {where}{name}")
            if isinstance(known[name], Mapping):
                if not isinstance(value, Mapping):
                    raise ValueError(f"{where}{name} must be an object")
                base[name] = lay(dict(base.get(name, {})), value, known[name], f"{where}{name}.")
            else:
                base[name] = value
        return base

    for layer in layers:
        lay(out, layer, PROFILE, "")
    return out


def with_profile(facts: DataFrame, profile: Mapping) -> DataFrame:
    """``facts`` with a column ``ex_<name>`` for all that a profile can hold, and the cap of the level that it sets."""

    def literal(value, kind: str) -> Column:
        if value is None:
            return F.lit(None).cast(kind)
        if kind.startswith("array<struct"):
            rows = [F.struct(F.lit(e["height"]).cast("int").alias("height"), F.lit(e.get("fpsMax")).cast("double").alias("fpsMax"), F.lit(float(e["level"])).alias("level")) for e in value]
            return F.array(*rows).cast(kind)
        if kind.startswith("map"):
            return F.create_map(*[F.lit(x) for pair in value.items() for x in pair]).cast(kind)
        if kind.startswith("array"):
            return F.array(*[F.lit(x) for x in value]).cast(kind)
        return F.lit(value).cast(kind)

    columns = {}
    for name, kind in PROFILE.items():
        if isinstance(kind, Mapping):
            for inner, inner_kind in kind.items():
                columns[f"ex_{name}_{inner}"] = literal((profile.get(name) or {}).get(inner), inner_kind)
        else:
            columns[f"ex_{name}"] = literal(profile.get(name), kind)
    out = facts.withColumns(columns)
    if {"height", "fps"} <= set(facts.columns):
        fits = "filter(ex_overlay_levelCap, c -> height <= c.height and (c.fpsMax is null or fps <= c.fpsMax + 0.01))"
        out = out.withColumn("level_cap", F.expr(f"try_element_at({fits}, 1).level"))
    return out


# evaluation


def evaluate(facts: DataFrame, rules: Sequence[Rule], severity: Mapping[str, str] | None = None, entity: str = "entity") -> DataFrame:
    """(entity, place, id, scope, category, level, severity, spec, clause, value, expected, offset) in one pass over ``facts``.

    ``place`` is the rule's place in ``rules``. Only warnings and failures have a severity: what ``severity`` sets
    for the rule; else critical where a critical rule fails, info for an info rule, and warning for the rest.
    """
    over = severity or {}

    def row(k: int, r: Rule) -> Column:
        level = F.expr(f"case when coalesce({r.applies}, false) then {r.level} when coalesce({r.unmeasured}, false) then 'skip' end")
        own = F.lit(over[r.id]) if r.id in over else F.when((level == "fail") & F.lit(r.severity == "critical"), "critical").otherwise("info" if r.severity == "info" else "warning")
        text = {n: F.when(level != "skip", F.expr(f"cast({e} as string)")) for n, e in (("value", r.value), ("expected", r.expected))}
        return F.struct(
            F.lit(k).alias("place"), F.lit(r.id).alias("id"), F.lit(r.scope).alias("scope"), F.lit(r.category).alias("category"), level.alias("level"),
            F.when(level.isin("warn", "fail"), own).alias("severity"), F.coalesce(F.expr(r.spec_of).cast("string"), F.lit(r.spec)).alias("spec"), F.lit(r.clause).alias("clause"),
            text["value"].alias("value"), text["expected"].alias("expected"), F.expr(f"cast({r.offset} as bigint)").alias("offset"),
        )

    out = facts.select(F.col(entity).alias("entity"), F.explode(F.array(*[row(k, r) for k, r in enumerate(rules)])).alias("c"))
    return out.where("c.level is not null").select("entity", "c.*")


def replaced(checks: DataFrame, measured: DataFrame) -> DataFrame:
    """``checks`` with those that were skipped replaced by ``measured`` ones of the same entity and id."""
    keys = measured.select(F.col("entity").alias("e"), F.col("id").alias("k")).distinct()
    gone = (F.col("level") == "skip") & (F.col("entity") == F.col("e")) & (F.col("id") == F.col("k"))
    return checks.join(keys, gone, "left_anti").unionByName(measured)


def tally(checks: DataFrame, *by: str) -> DataFrame:
    """Counts by level and severity, and the share of passes among pass, warn and fail in thousandths (null without any)."""
    count = lambda c, v: F.count(F.when(F.col(c) == v, 1))
    n = [count("level", k).alias(f"n_{k}") for k in LEVELS] + [count("severity", k).alias(f"n_{k}") for k in ("critical", "warning")]
    judged = F.col("n_pass") + F.col("n_warn") + F.col("n_fail")
    return checks.groupBy(*by).agg(*n).withColumn("compliance", F.floor(F.try_divide(F.col("n_pass") * 1000, judged)))


def rank(level: str = "level") -> Column:
    """0 for the worst level."""
    return F.coalesce(*[F.when(F.col(level) == k, v) for v, k in enumerate(LEVELS)])


def matrix(checks: DataFrame, entities: Sequence) -> DataFrame:
    """Levels by rule (rows) and entity (columns), with the worst rank of the rule; worst rules first, then by id."""
    wide = checks.groupBy("id").pivot("entity", list(entities)).agg(F.min_by("level", rank()))
    worst = checks.groupBy("id").agg(F.min(rank()).alias("worst"))
    return wide.join(worst, "id").orderBy("worst", "id")


def register(rules: Sequence[Rule]) -> list[tuple]:
    """What the rules are, for a table of them: id, scope, category, severity, spec, clause."""
    return [(r.id, r.scope, r.category, r.severity, r.spec, r.clause) for r in rules]
