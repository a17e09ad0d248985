"""Playlists against the segments they list: measured rates, edges and codecs, and facts for the playlist rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

KEY = ["presentation", "playlist"]


def peak_segment_rate(segments: DataFrame, targets: DataFrame, by: list[str] = KEY) -> DataFrame:
    """(by, peak, start, count): the highest rate over runs of consecutive measured segments of 0.5 to 1.5 targets.

    ``segments`` have i, duration (seconds) and size (bytes, null where not measured), ``targets`` a target by
    playlist. A run can't pass a segment without size or duration. Of equal rates the first run counts.
    """
    measured = F.col("size").isNotNull() & (F.col("duration") > 0)
    own = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    s = segments.join(targets.select(*by, "target"), by).withColumn("island", F.sum((~measured).cast("int")).over(own)).where(measured)
    w = Window.partitionBy(*by, "island").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("t1", F.sum("duration").over(w)).withColumn("s1", F.sum("size").over(w))
    s = s.withColumn("t0", F.col("t1") - F.col("duration")).withColumn("s0", F.col("s1") - F.col("size"))
    # a run from a row on lasts at most 1.5 targets, so it ends in one of the cells of that width at or behind its start
    cell = lambda t: F.floor(F.col(t) / (1.5 * F.col("target")))
    ends = s.select(*by, "island", cell("t1").alias("cell"), F.col("i").alias("j"), F.col("t1").alias("e"), F.col("s1").alias("b"))
    runs = s.withColumn("cell", F.explode(F.array(cell("t0"), cell("t0") + 1))).join(ends, [*by, "island", "cell"]).where("j >= i")
    seconds = F.col("e") - F.col("t0")
    runs = runs.where((seconds >= 0.5 * F.col("target") - 1e-9) & (seconds <= 1.5 * F.col("target") + 1e-9))
    best = F.max(F.struct(((F.col("b") - F.col("s0")) * 8 / seconds).alias("rate"), (-F.col("i")).alias("i"), (-F.col("j")).alias("j")))
    best = runs.groupBy(*by).agg(best.alias("x"))
    return best.select(*by, F.col("x.rate").alias("peak"), (-F.col("x.i")).alias("start"), (F.col("x.i") - F.col("x.j") + 1).alias("count"))


def average_segment_rate(segments: DataFrame, by: list[str] = KEY) -> DataFrame:
    """(by, average): all bits of measured segments over their duration."""
    measured = segments.where("size is not null and duration > 0")
    return measured.groupBy(*by).agg((F.sum("size") * 8 / F.sum("duration")).alias("average"))


def segment_edges(segments: DataFrame, by: list[str] = KEY) -> DataFrame:
    """``segments`` with ``edge``, the time at which each ends."""
    up_to = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return segments.withColumn("edge", F.sum(F.coalesce("duration", F.lit(0.0))).over(up_to))


def misaligned(segments: DataFrame, variants: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(presentation, edges_off, first_edge_off): edges that differ from those of the first variant, by position, and
    variants with another number of segments; ``first_edge_off`` counts from 1."""
    e = segment_edges(segments).join(variants.select(*KEY), KEY).select(*KEY, "i", "edge")
    first = variants.groupBy("presentation").agg(F.min("playlist").alias("playlist"))
    ref = e.join(first, KEY).select("presentation", "i", F.col("edge").alias("of"))
    off = e.join(ref, ["presentation", "i"]).where(F.abs(F.col("edge") - F.col("of")) > tolerance).groupBy("presentation").agg(F.count("*").alias("off"), (F.min("i") + 1).alias("first_edge_off"))
    n = variants.select(*KEY).join(e.groupBy(*KEY).agg(F.count("*").alias("n")), KEY, "left").na.fill(0, ["n"])
    of = n.join(first, KEY).select("presentation", F.col("n").alias("of"))
    odd = n.join(of, "presentation").where("n <> of").groupBy("presentation").agg(F.count("*").alias("odd"))
    out = off.join(odd, "presentation", "full")
    return out.select("presentation", (F.coalesce("off", F.lit(0)) + F.coalesce("odd", F.lit(0))).alias("edges_off"), "first_edge_off")


def codec_rank(declared: Column, found: Column) -> Column:
    """0 where two codec strings are the same, 1 where only flags differ, 2 else."""
    d, f = F.lower(declared), F.lower(found)
    avc = r"^avc[13]\.([0-9a-f]{2})([0-9a-f]{2})([0-9a-f]{2})$"
    part = lambda x, k: F.regexp_extract(x, avc, k)
    both = d.rlike(avc) & f.rlike(avc)
    close = F.when(both, (part(d, 1) == part(f, 1)) & (part(d, 3) == part(f, 3))).otherwise(F.substring_index(d, ".", 2) == F.substring_index(f, ".", 2))
    return F.when(d == f, 0).when(close, 1).otherwise(2)


def best_codec_match(declared: Column, found: Column) -> Column:
    """The best :func:`codec_rank` of ``found`` among the array ``declared``; 2 where that is empty."""
    return F.coalesce(F.array_min(F.transform(declared, lambda d: codec_rank(d, found))), F.lit(2))


def facts(playlists: DataFrame, variants: DataFrame, segments: DataFrame, probes: DataFrame, masters: DataFrame) -> DataFrame:
    """One row by presentation.

    ``playlists``: presentation, playlist, role (variant, rendition, iframe), variant, audio_group, target, type,
    end_list, version, needs_version, program_id, allow_cache, sampled, error. ``variants``: presentation, variant,
    bandwidth, average_bandwidth, codecs, width, height, frame_rate, audio_group. ``segments``: presentation, playlist,
    i, duration, size, error. ``probes``: presentation, playlist, i, video_codec, audio_codec, width, height, fps,
    key_first. ``masters``: presentation, independent, version, needs_version, program_id, allow_cache, iframe_playlists.
    """
    c, n = F.col, lambda x: F.count(F.when(x, 1))
    media = playlists.where("error is null")
    plain = c("role") != "iframe"
    version = F.coalesce(c("version"), F.lit(1))
    old = (version < c("needs_version")) | (F.coalesce("program_id", F.lit(False)) & (version >= 6)) | (F.coalesce("allow_cache", F.lit(False)) & (version >= 7))
    every = playlists.groupBy("presentation").agg(F.count("*").alias("playlists"), F.count("error").alias("playlist_errors"))
    is_variant = c("role") == "variant"
    done = F.coalesce(c("type") == "VOD", F.lit(False)) | c("end_list")
    p = media.groupBy("presentation").agg(
        F.count("*").alias("parsed"), n(is_variant).alias("variant_playlists"), F.bool_and(F.when(is_variant, done)).alias("all_done"), n(plain).alias("plain"),
        F.count_distinct(F.when(plain, F.coalesce("target", F.lit(-1)))).alias("targets"), F.count("target").alias("with_target"), n(plain & (c("target") != 6)).alias("targets_not_6"),
        n(c("end_list")).alias("ended"), n(c("end_list") & ~F.coalesce(c("type") == "VOD", F.lit(False))).alias("ended_not_vod"), n(old).alias("old"),
    )
    listed = segments.join(media.select(*KEY, "role", "target"), KEY)
    long = (F.floor(c("duration") + 0.5) > c("target")) | (c("duration") > c("target") + 0.5)
    s = listed.groupBy("presentation").agg(F.count("error").alias("segment_errors"), n(long).alias("segments_long"), n(c("target").isNotNull()).alias("targeted"))
    length = media.where(plain).select(*KEY).join(listed.groupBy(*KEY).agg(F.sum("duration").alias("d")), KEY, "left").na.fill(0.0, ["d"])
    length = length.groupBy("presentation").agg((F.max("d") - F.min("d")).alias("duration_spread"))

    own = probes.join(media.select(*KEY), KEY)
    q = own.groupBy("presentation").agg(F.count("video_codec").alias("probed"), n(c("video_codec").isNotNull() & ~c("key_first")).alias("probes_not_key"))
    picture = own.where("video_codec is not null").groupBy(*KEY).agg(F.min_by(F.struct("width", "height", "fps"), "i").alias("v"))
    peaks = peak_segment_rate(segments, media).select(*KEY, "peak")
    audio = media.where("role = 'rendition'").join(peaks, KEY).groupBy("presentation", "audio_group").agg(F.max("peak").alias("audio_peak"))
    one = media.where(is_variant).select(*KEY, "variant", "sampled").join(variants, ["presentation", "variant"]).join(peaks, KEY, "left").join(average_segment_rate(segments), KEY, "left")
    one = one.join(picture, KEY, "left").join(audio, ["presentation", "audio_group"], "left").withColumn("peak", c("peak") + F.coalesce("audio_peak", F.lit(0.0)))
    found = own.select(*KEY, F.explode(F.array_distinct(F.array_compact(F.array("video_codec", "audio_codec")))).alias("found")).distinct()
    match = found.join(one.select(*KEY, "codecs"), KEY).where("codecs is not null").withColumn("m", best_codec_match(c("codecs"), c("found")))
    match = match.groupBy("presentation").agg(n(c("m") == 2).alias("codecs_other"), n(c("m") == 1).alias("codecs_close"))
    has = c("v").isNotNull()
    v = one.groupBy("presentation").agg(
        F.count("*").alias("variants"), n((c("bandwidth") > 0) & (c("peak") > 0)).alias("peaked"),
        n((c("peak") > c("bandwidth") * 1.1) | (~c("sampled") & (c("peak") < c("bandwidth") / 1.1))).alias("peaks_off"), n(c("average_bandwidth").isNull()).alias("no_average"),
        n(~c("sampled") & (F.abs(c("average") - c("average_bandwidth")) > c("average_bandwidth") * 0.1)).alias("averages_off"), n(F.coalesce(F.size("codecs"), F.lit(0)) <= 0).alias("no_codecs"),
        F.count("v").alias("pictures"), n(has & c("width").isNull()).alias("no_resolution"), n(has & ((c("width") != c("v.width")) | (c("height") != c("v.height")))).alias("resolutions_off"),
        n(has & c("frame_rate").isNull()).alias("no_frame_rate"), n(has & (c("v.fps") > 0) & (F.abs(c("v.fps") - c("frame_rate")) / c("v.fps") > 0.01)).alias("frame_rates_off"),
    )
    edges = misaligned(segments, media.where(is_variant))
    m = masters.select("presentation", F.lit(True).alias("master"), "independent", "iframe_playlists", old.alias("master_old"))
    out = every
    for t in (p, s, length, q, v, match, edges, m):
        out = out.join(t, "presentation", "left")
    counts = [x for x in out.columns if x not in ("presentation", "all_done", "duration_spread", "master", "independent", "master_old", "first_edge_off")]
    out = out.na.fill(0, counts).withColumns({
        "entity": c("presentation"), "has_master": F.coalesce("master", F.lit(False)), "vod": F.coalesce("all_done", F.lit(False)), "versions_off": c("old") + F.coalesce(c("master_old").cast("int"), F.lit(0)),
        "ex_intended": F.lit(None).cast("array<double>"), "targets_not_intended": F.lit(0),
    })
    return out


def with_intended(facts: DataFrame, playlists: DataFrame, lengths: list[float]) -> DataFrame:
    """``facts`` with the segment lengths that the service has chosen."""
    odd = (F.col("role") != "iframe") & F.col("target").isNotNull() & ~F.col("target").isin([float(x) for x in lengths])
    n = playlists.where("error is null").groupBy("presentation").agg(F.count(F.when(odd, 1)).alias("n_odd"))
    out = facts.drop("targets_not_intended").join(n, "presentation", "left")
    return out.withColumn("ex_intended", F.array(*[F.lit(float(x)) for x in lengths])).withColumn("targets_not_intended", F.coalesce("n_odd", F.lit(0))).drop("n_odd")
