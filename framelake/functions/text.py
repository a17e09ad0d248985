"""Scalar functions over names, URLs, playlists and bytes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# How some types of files begin, as hex, in the order in which they are tried.
MAGIC = [
    ("000001ba", "mpeg program stream"),
    ("000001b3", "mpeg video"),
    ("00000001", "annex b"),
    ("000001", "annex b"),
    ("4f676753", "ogg"),
    ("494433", "mp3 with id3"),
    ("ff[ef]", "mpeg audio"),
    ("fff[0189]", "adts"),
    ("664c6143", "flac"),
    ("63616666", "caf"),
    ("060e2b34", "mxf"),
    ("3026b2758e66cf11", "asf"),
    ("2e524d46", "realmedia"),
    ("234558544d3355", "m3u8"),
    ("3c3f786d6c|3c4d5044", "xml"),
    ("(efbbbf)?574542565454", "webvtt"),
    ("89504e47", "png"),
    ("ffd8ff", "jpeg"),
    ("47494638", "gif"),
    ("504b0304", "zip"),
    ("25504446", "pdf"),
]


def magic(content: Column) -> Column:
    """The type whose signature the bytes begin with, null where none does; the first in the list wins."""
    head = F.lower(F.hex(F.substring(content, 1, 16)))
    return F.coalesce(*[F.when(head.rlike(f"^({sign})"), kind) for sign, kind in MAGIC])


def redact(url: Column) -> Column:
    """A URL without its query."""
    return F.regexp_replace(url, r"\?.*", "?…")


#: An attribute by the grammar of RFC 8216 4.2: a name, then a quoted string or anything up to the next comma.
_ATTRIBUTE = r"(?<![A-Z0-9-])([A-Z0-9-]+)=(?:\"([^\"\r\n]*)\"|([^\",][^,]*)?)"


def attributes(line: Column) -> Column:
    """Attribute list ``A=1,B="x,y"`` as a map; commas in quotes stay, quotes go, of equal names the last counts."""
    part = lambda k: F.regexp_extract_all(line, F.lit(_ATTRIBUTE), k)
    pairs = F.arrays_zip(part(1).alias("name"), part(2).alias("quoted"), part(3).alias("plain"))
    entries = F.transform(pairs, lambda p: F.struct(p["name"].alias("key"), F.concat(F.coalesce(p["quoted"], F.lit("")), F.coalesce(p["plain"], F.lit(""))).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda f: f["key"] == e["key"]))
    return F.map_from_entries(last)


def label_height(name: Column) -> Column:
    """The last NNNp of a name without its extension that no letter follows, in either case."""
    found = F.regexp_extract_all(F.regexp_replace(name, r"\.\w+$", ""), F.lit(r"(?i)([0-9]{3,4})p(?![a-z])"), 1)
    return F.try_element_at(found, F.lit(-1)).cast("int")


# Words of a file name that tell versions of one content apart.
VERSION_WORDS = [
    r"\d{3,4}p?", r"\d{3,4}x\d{3,4}", r"\d+(\.\d+)?(k|m|g)b?(ps)?", "[48]k", "2k", "uhd", "fhd", "hd", "sd", "qhd", "low", "lo", "mid", "medium", "high", "hi",
    "src", "source", "orig", "original", "master", "mezz", "mezzanine", "out", "output", "converted", "encoded", "transcoded", "final", r"profile\d*", r"v\d+",
    "x26[45]", "h26[45]", "hevc", "avc", "av1", "vp9", r"\d+",
]


def stem(name: Column) -> Column:
    """Lower-cased words of a name without extension and version words; all words where none is left."""
    words = F.filter(F.split(F.lower(F.regexp_replace(name, r"\.[^.]{1,5}$", "")), r"[\s._\-+()\[\]]+"), lambda w: w != "")
    kept = F.filter(words, lambda w: ~w.rlike(f"^({'|'.join(VERSION_WORDS)})$"))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " ")


def resolve(uri: Column, base: Column) -> Column:
    """``uri`` as seen from the URL ``base`` (RFC 3986, without fragments)."""
    scheme, site = r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)"
    path = F.regexp_replace(F.regexp_replace(base, site, ""), r"[?#].*$", "")
    folder = F.concat(F.lit("/"), F.regexp_replace(path, r"^/|[^/]*$", ""))
    own = F.regexp_replace(uri, r"[?#].*$", "")
    query = F.substring(uri, F.length(own) + 1, F.length(uri))
    full = F.when(own == "", F.when(path == "", "/").otherwise(path)).when(own.startswith("/"), own).otherwise(F.concat(folder, own))
    steps = F.split(full, "/")
    # a folder, and the .. that leaves it, go; . goes
    kept = F.aggregate(
        F.slice(steps, 2, F.size(steps)), F.array().cast("array<string>"),
        lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))),
    )
    end = F.when(F.element_at(steps, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(uri.rlike(scheme), uri).when(uri.startswith("//"), F.concat(F.regexp_extract(base, scheme, 1), uri)).otherwise(F.concat(F.regexp_extract(base, site, 1), F.lit("/"), F.array_join(kept, "/"), end, query))


def mse(a: Column, b: Column) -> Column:
    """Mean squared difference of two arrays of numbers."""
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda t, x: t + x) / F.size(a)


def psnr(mse: Column, peak: float) -> Column:
    return F.when(mse > 0, 10 * F.log10(F.lit(peak * peak) / mse))


def playlist_segments(playlists: DataFrame) -> DataFrame:
    """Media playlists (playlist, text) as segments: idx, duration, offset, length, uri, map, discontinuity.

    EXTINF, BYTERANGE and DISCONTINUITY hold for the next URI, EXT-X-MAP from its line on; a byte range without
    offset begins where the one before of the same URI ended.
    """
    lines = playlists.select("playlist", F.posexplode(F.split("text", r"\r?\n")).alias("line", "s")).withColumn("s", F.trim("s")).where("s <> ''")
    is_uri = ~F.col("s").startswith("#")
    at = Window.partitionBy("playlist").orderBy("line")
    lines = lines.withColumn("seg", F.coalesce(F.sum(is_uri.cast("long")).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    tag = lambda name: F.when(F.col("s").startswith(f"#{name}:"), F.substring_index(F.col("s"), f"#{name}:", -1))
    lines = lines.withColumn("m", F.last(attributes(tag("EXT-X-MAP"))["URI"], ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    seg = lines.groupBy("playlist", "seg").agg(
        F.max_by(tag("EXTINF"), F.when(tag("EXTINF").isNotNull(), F.col("line"))).alias("inf"),
        F.max_by(tag("EXT-X-BYTERANGE"), F.when(tag("EXT-X-BYTERANGE").isNotNull(), F.col("line"))).alias("range"),
        F.max((F.col("s") == "#EXT-X-DISCONTINUITY").cast("int")).alias("disc"),
        F.max(F.when(is_uri, F.col("s"))).alias("uri"),
        F.max_by("m", "line").alias("map"),
    ).where("uri is not null")
    seg = seg.withColumn("length", F.try_element_at(F.split("range", "@"), F.lit(1)).cast("long")).withColumn("given", F.try_element_at(F.split("range", "@"), F.lit(2)).cast("long"))
    w = Window.partitionBy("playlist", "uri").orderBy("seg")
    seg = seg.withColumn("island", F.sum(F.col("given").isNotNull().cast("int")).over(w))
    run = Window.partitionBy("playlist", "uri", "island").orderBy("seg")
    before = F.coalesce(F.sum("length").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = F.when(F.col("length").isNotNull(), F.coalesce(F.first("given").over(run), F.lit(0)) + before)
    return seg.select("playlist", F.col("seg").alias("idx"), F.substring_index("inf", ",", 1).cast("double").alias("duration"), offset.alias("offset"), "length", "uri", "map", (F.col("disc") == 1).alias("discontinuity"))


def playlist_version(text: Column) -> Column:
    """Least protocol version for the features that a playlist uses (RFC 8216 section 7)."""
    has = lambda p: text.rlike(f"(?m)^\\s*#{p}")
    needs = [
        (has(r"EXT-X-KEY:(.*,)?IV="), 2), (has(r"EXTINF:[^,\r\n]*\."), 3), (has("EXT-X-BYTERANGE|EXT-X-I-FRAMES-ONLY".replace("|", r"|\s*#")), 4),
        (has(r"EXT-X-KEY:(.*,)?KEYFORMAT(VERSIONS)?="), 5), (has("EXT-X-MAP"), 5), (has("EXT-X-MAP") & ~has("EXT-X-I-FRAMES-ONLY"), 6),
    ]
    return F.greatest(F.lit(1), *[F.when(p, v).otherwise(1) for p, v in needs])


def playlist_tags(playlists: DataFrame) -> DataFrame:
    """Playlists (playlist, text) with what their tags say: kind, version, needs_version, target, sequence, type,
    end_list, iframes_only, independent, encrypted, program_id, allow_cache, and counts of variants and I-frame playlists."""
    t = F.col("text")
    tag = lambda name: F.nullif(F.regexp_extract(t, rf"(?m)^\s*#{name}:\s*([^\r\n]*?)\s*$", 1), F.lit(""))
    has = lambda p: t.rlike(rf"(?m)^\s*#{p}")
    count = lambda p: F.size(F.regexp_extract_all(t, F.lit(rf"(?m)^\s*#{p}"), 0))
    keys = F.regexp_extract_all(t, F.lit(r"(?m)^\s*#EXT-X-KEY:([^\r\n]*)"), 1)
    out = playlists.withColumns({
        "version": tag("EXT-X-VERSION").try_cast("int"), "needs_version": playlist_version(t), "target": tag("EXT-X-TARGETDURATION").try_cast("double"), "sequence": F.coalesce(tag("EXT-X-MEDIA-SEQUENCE").try_cast("long"), F.lit(0)),
        "type": tag("EXT-X-PLAYLIST-TYPE"), "end_list": has("EXT-X-ENDLIST"), "iframes_only": has("EXT-X-I-FRAMES-ONLY"), "independent": has("EXT-X-INDEPENDENT-SEGMENTS"), "allow_cache": has("EXT-X-ALLOW-CACHE"),
        "program_id": has(r"EXT-X-(I-FRAME-)?STREAM-INF:(.*,)?PROGRAM-ID="), "encrypted": F.exists(keys, lambda k: k.rlike("(^|,)METHOD=") & ~k.rlike("(^|,)METHOD=NONE(,|$)")),
        "variants": count("EXT-X-STREAM-INF:"), "iframe_playlists": count("EXT-X-I-FRAME-STREAM-INF:"),
    })
    return out.withColumn("kind", F.when((F.col("variants") > 0) | (F.col("iframe_playlists") > 0), "master").otherwise("media"))


def playlist_variants(playlists: DataFrame) -> DataFrame:
    """Multivariant playlists (playlist, text) as variants: variant (from 0), bandwidth, average_bandwidth, codecs, width, height,
    frame_rate, audio_group, uri, and the label that its rendition name, its height or its place gives."""
    lines = playlists.select("playlist", F.posexplode(F.split("text", r"\r?\n")).alias("line", "s")).withColumn("s", F.trim("s")).where("s <> '' and (s not like '#%' or s like '#EXT-X-STREAM-INF:%')")
    at = Window.partitionBy("playlist").orderBy("line")
    tag = F.lag("s").over(at)
    v = lines.withColumn("inf", tag).where("s not like '#%' and inf like '#%'").withColumn("a", attributes(F.substring_index("inf", "#EXT-X-STREAM-INF:", -1)))
    size = F.regexp_extract(F.col("a")["RESOLUTION"], r"^(\d+)x(\d+)$", 0)
    side = lambda k: F.regexp_extract(F.col("a")["RESOLUTION"], r"^(\d+)x(\d+)$", k).try_cast("int")
    v = v.withColumn("variant", (F.row_number().over(at) - 1).cast("long")).select(
        "playlist", "variant", F.col("a")["BANDWIDTH"].try_cast("double").alias("bandwidth"), F.col("a")["AVERAGE-BANDWIDTH"].try_cast("double").alias("average_bandwidth"),
        F.filter(F.transform(F.split(F.col("a")["CODECS"], ","), lambda c: F.trim(c)), lambda c: c != "").alias("codecs"), F.when(size != "", side(1)).alias("width"), F.when(size != "", side(2)).alias("height"),
        F.col("a")["FRAME-RATE"].try_cast("double").alias("frame_rate"), F.col("a")["AUDIO"].alias("audio_group"), F.col("s").alias("uri"),
    )
    path = F.regexp_replace("uri", r"[?#].*$", "")
    named = F.try_element_at(F.regexp_extract_all(path, F.lit(r"(?i)([0-9]{3,4})p(?![a-z])"), 1), F.lit(-1))
    label = F.coalesce(F.concat(named, F.lit("p")), F.concat(F.least("width", "height").cast("string"), F.lit("p")), F.concat(F.lit("variant "), F.col("variant") + 1))
    return v.withColumn("label", label)
