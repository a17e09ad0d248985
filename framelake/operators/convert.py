"""What a conversion did to a file: tracks kept, lost or copied, shifts in time, and a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Findings and their severities.
FINDINGS = {
    "video-dropped": "critical", "audio-dropped": "critical", "sync-drift": "critical", "subs-dropped": "warning", "audio-tracks-dropped": "warning", "color-stripped": "critical",
    "hdr-mastering-dropped": "warning", "rotation-lost": "warning", "variable-gop": "warning", "open-gops": "warning", "missing-faststart": "warning",
}


def effective_start(start: Column, edit: Column) -> Column:
    """When a track's first frame is heard or seen, after what its first edit skips."""
    return F.when(edit > 0, F.greatest(F.lit(0.0), start - edit)).otherwise(start)


def skew(p: str) -> Column:
    """Seconds by which audio starts after video (P17); null where either is unknown."""
    c = lambda n: F.col(f"{p}{n}")
    return effective_start(c("audio_start"), F.coalesce(c("audio_edit"), F.lit(0.0))) - effective_start(c("video_start"), F.coalesce(c("video_edit"), F.lit(0.0)))


def conversions(pairs: DataFrame) -> DataFrame:
    """``pairs`` of a source (columns ``s_``) and what was made of it (``t_``) with video_mode, audio_mode, shift_ms,
    findings (id, severity), highlights and verdict (P18).

    Columns of either side: videos, audios, subs (numbers of tracks), video_start, audio_start, video_edit, audio_edit
    (seconds), channels, colour, mastering, rotation (texts or null), width, height, size, bitrate, format, fast_start,
    gops, gop_fixed, open_gops; of the pair: video_copied, audio_copied.
    """
    s, t = (lambda n: F.col(f"s_{n}")), (lambda n: F.col(f"t_{n}"))

    def mode(n: str, copied: str) -> Column:
        a, b = F.coalesce(s(n), F.lit(0)) > 0, F.coalesce(t(n), F.lit(0)) > 0
        return F.when(~a & ~b, "none").when(~a, "added").when(~b, "dropped").when(F.coalesce(F.col(copied), F.lit(False)), "copied").otherwise("transcoded")

    p = pairs.withColumns({"video_mode": mode("videos", "video_copied"), "audio_mode": mode("audios", "audio_copied"), "shift_ms": (skew("t_") - skew("s_")) * 1000})
    shift = F.abs("shift_ms")
    unset = lambda x: x.isNull() | x.rlike("(?i)unspecified")
    no = F.lit(False)
    made = F.col("video_mode") == "transcoded"
    baked = F.coalesce((s("width") == t("height")) & (s("height") == t("width")), no)
    stripped = ~unset(s("colour")) & unset(t("colour"))
    on = {
        "video-dropped": F.col("video_mode") == "dropped", "audio-dropped": F.col("audio_mode") == "dropped", "sync-drift": shift >= 20, "subs-dropped": (s("subs") > 0) & (F.coalesce(t("subs"), F.lit(0)) == 0),
        "audio-tracks-dropped": (s("audios") > 1) & (F.coalesce(t("audios"), F.lit(0)) < s("audios")), "color-stripped": stripped,
        "hdr-mastering-dropped": s("mastering").isNotNull() & t("mastering").isNull() & ~F.coalesce(t("colour").contains("BT.709"), no), "rotation-lost": s("rotation").isNotNull() & t("rotation").isNull() & ~baked,
        "variable-gop": made & ~t("gop_fixed") & (t("gops") > 1), "open-gops": made & (t("open_gops") > 0), "missing-faststart": (t("format") == "isobmff") & ~t("fast_start"),
    }
    found = []
    for name, severity in FINDINGS.items():
        own = F.when(shift >= 50, "critical").otherwise("warning") if name == "sync-drift" else F.lit(severity)
        found.append(F.when(F.coalesce(on[name], no), F.struct(F.lit(name).alias("id"), own.alias("severity"))))
    less = lambda n: F.coalesce((t(n) - s(n)) / s(n) <= -0.05, no)
    notes = {
        "downmixed": s("channels").rlike(r"5\.1|6\b") & t("channels").rlike(r"stereo|2\b"), "tonemapped": ~unset(s("colour")) & ~unset(t("colour")) & s("colour").rlike("(?i)BT.2020|PQ|HLG") & t("colour").rlike("(?i)BT.709"),
        "rotation-baked": s("rotation").isNotNull() & t("rotation").isNull() & baked, "fixed-gop": made & t("gop_fixed"), "fast-start": (t("format") == "isobmff") & t("fast_start"), "smaller": less("size"), "lower-bitrate": less("bitrate"),
    }
    p = p.withColumn("findings", F.array_compact(F.array(*found))).withColumn("highlights", F.array_compact(F.array(*[F.when(F.coalesce(c, no), n) for n, c in notes.items()])))
    critical, warned = F.exists("findings", lambda f: f["severity"] == "critical"), F.size("findings") > 0
    remux = (F.col("video_mode") == "copied") & ((F.col("audio_mode") == "copied") | (F.coalesce(s("audios"), F.lit(0)) == 0))
    verdict = F.when(critical, "regression").when(warned, "warning").when(remux, "clean-remux").otherwise("clean-transcode")
    return p.withColumn("verdict", verdict)
