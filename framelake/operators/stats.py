"""Facts of tracks and streams: types, totals, rates, shares, identities, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .samples import UP_TO, by_track

# Frame rates that a measured one snaps to, and how near it must be.
RATES = (24000 / 1001, 24, 25, 30000 / 1001, 30, 48, 50, 60000 / 1001, 60, 100, 120000 / 1001, 120)
SNAP = 2e-4


def snapped_rate(fps: Column) -> Column:
    """The common frame rate within ``SNAP`` of ``fps``, the first in the list, else ``fps`` (P5)."""
    return F.coalesce(*[F.when(F.abs(fps - r) / r < SNAP, F.lit(float(r))) for r in RATES], fps)


def frame_types(samples: DataFrame) -> DataFrame:
    """By track and type of frame count, bytes, least and most (A3)."""
    return samples.groupBy("track", "letter").agg(F.count("*").alias("frames"), F.sum("size").alias("bytes"), F.min("size").alias("least"), F.max("size").alias("most"))


def track_stats(samples: DataFrame, second: int = 1_000_000) -> DataFrame:
    """By track frames, bytes, ticks, key frames, whether durations vary (the last one aside), whether all are key
    frames (a null key is one), bits a second and frames a second (A8, P4, P13)."""
    s = samples.withColumn("inner", F.col("i") < F.max("i").over(Window.partitionBy("track")))
    d = F.when(F.col("inner"), F.col("duration"))
    key = F.coalesce("key", F.lit(True))
    out = s.groupBy("track").agg(
        F.count("*").alias("frames"), F.sum("size").alias("bytes"), F.sum("duration").alias("ticks"), F.count(F.when(key, 1)).alias("keys"),
        F.coalesce(F.max(d) * 20 > F.min(d) * 21 + 20, F.lit(False)).alias("vfr"), F.bool_and(key).alias("all_key"), F.min("dts").alias("lo"), F.max(F.col("dts") + F.col("duration")).alias("hi"),
    )
    span = F.col("hi") - F.col("lo")
    return out.withColumn("bitrate", F.try_divide(F.col("bytes") * 8.0 * second, span)).withColumn("fps", F.try_divide(F.col("frames") * float(second), span)).drop("lo", "hi")


def jumpy_seconds(samples: DataFrame, back: int, most: int) -> DataFrame:
    """By track its ticks: the span of its times, or the sum of durations where times jump."""
    s = samples.withColumn("step", F.col("dts") - F.lag("dts").over(by_track("i")))
    out = s.groupBy("track").agg(F.count(F.when((F.col("step") < back) | (F.col("step") > most), 1)).alias("jumps"), F.sum("duration").alias("sum"), (F.max(F.col("dts") + F.col("duration")) - F.min("dts")).alias("span"))
    return out.select("track", "jumps", F.when(F.col("jumps") > 0, F.col("sum")).otherwise(F.col("span")).alias("ticks"))


def shares(rows: DataFrame, by: str, count: str = "packets") -> DataFrame:
    """By key its rows and their share of all, in percent."""
    n = rows.groupBy(by).agg(F.count("*").alias(count))
    total = n.agg(F.sum(count).alias("total")).first().total or 0  # one number
    return n.withColumn("share", F.try_divide(F.col(count) * 100.0, F.lit(total)))


def undescribed(used: DataFrame, described: DataFrame, by: str) -> DataFrame:
    """Keys with rows that no table describes."""
    return used.select(by).distinct().join(described.select(by).distinct().hint("merge"), by, "left_anti")


def error_counts(packets: DataFrame, by: str, flags: list[str]) -> DataFrame:
    """By key how many packets carry each flag."""
    return packets.groupBy(by).agg(*[F.count(F.when(F.col(f), 1)).alias(f) for f in flags])


def identities(tracks: DataFrame, by: str, order: list[str], size: str, also: list[str] | None = None) -> DataFrame:
    """Groups of tracks with the same sizes in the same order (and the same ``also``): sizes (SHA-256), n, least member."""
    also = also or []
    listed = F.sort_array(F.collect_list(F.struct(*order, F.col(size).alias("n"))))
    t = tracks.groupBy(by, *also).agg(listed.alias("a"))
    t = t.select(by, *also, F.sha2(F.array_join(F.transform("a", lambda x: x["n"].cast("string")), ",").cast("binary"), 256).alias("sizes"))
    return t.groupBy("sizes", *also).agg(F.count("*").alias("n"), F.min(by).alias("least"))


def expand_runs(runs: DataFrame, count: Column, name: str = "k") -> DataFrame:
    """``runs`` repeated ``count`` times, numbered from 0; none for a count of 0 or less."""
    return runs.withColumn(name, F.explode(F.when(count > 0, F.sequence(F.lit(0).cast("long"), count.cast("long") - 1))))


def sync_flags(samples: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """``samples`` with ``key``: whether their number stands in ``listed``; numbers that no sample has don't matter."""
    hit = listed.select(F.col(key).alias("__k")).distinct()
    return samples.join(hit.hint("merge"), samples[key] == F.col("__k"), "left").withColumn("key", F.col("__k").isNotNull()).drop("__k")


def median(values: DataFrame, by: str, value: str) -> DataFrame:
    """By key the middle value, of two the mean."""
    return values.groupBy(by).agg(F.median(value).alias("median"))


def totals(series: DataFrame) -> DataFrame:
    """Bits by slice over all tracks of a series (A1)."""
    return series.groupBy("slice").agg(F.sum("bits").alias("bits"))


def subtree_counts(nodes: DataFrame) -> DataFrame:
    """Descendants of each node (file, id, path: ids from the root to the node) (A24): one row by ancestor, then a sum."""
    above = nodes.select("file", F.explode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("id"))
    n = above.groupBy("file", "id").agg(F.count("*").alias("n"))
    return nodes.select("file", "id").join(n, ["file", "id"], "left").na.fill(0, ["n"])


def dominant(parts: DataFrame, by: list[str]) -> DataFrame:
    """By bucket the category with most bytes; of equal ones that which begins first (P19). ``parts``: by, category, offset, bytes."""
    c = parts.groupBy(*by, "category").agg(F.sum("bytes").alias("b"), F.min("offset").alias("o"))
    return c.groupBy(*by).agg(F.max(F.struct("b", (-F.col("o")).alias("o"), "category")).alias("x")).select(*by, F.col("x.category").alias("category"), F.col("x.b").alias("bytes"))


def gop_letters(samples: DataFrame) -> DataFrame:
    """By GOP the frames of each type as a map, and those that may be skipped (A4). Needs ``gop`` and, for the latter, ``skippable``."""
    skip = F.col("skippable") if "skippable" in samples.columns else F.lit(False)
    n = samples.withColumn("__s", skip).groupBy("track", "gop", "letter").agg(F.count("*").alias("n"), F.count(F.when(F.col("__s"), 1)).alias("s"))
    return n.groupBy("track", "gop").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("letter", "n")))).alias("letters"), F.sum("s").alias("skippable"))


def budgeted(gops: DataFrame, budget: int) -> DataFrame:
    """(track, gop): which GOPs to read within ``budget`` bytes by track (L7): the first two, then by halving strides.

    The stride order of a GOP is that of its number's bits reversed, so the choice is a running sum, not a search.
    """
    g = gops.withColumn("k", F.row_number().over(by_track("gop")) - 1)
    turned = F.conv(F.reverse(F.lpad(F.bin("k"), 63, "0")), 2, 10).cast("decimal(20,0)")
    g = g.withColumn("turn", F.when(F.col("k") < 2, F.col("k").cast("decimal(20,0)") - 2).otherwise(turned))
    used = F.sum("bytes").over(by_track("turn").rowsBetween(*UP_TO))
    return g.withColumn("used", used).where((F.col("used") <= budget) | (F.col("k") == 0)).select("track", "gop")


def segment_length(gop_seconds: Column, lengths: list[float]) -> Column:
    """The shortest of the expected segment lengths that a GOP fits in, else the GOP itself; the longest without a GOP."""
    fits = F.array_min(F.filter(F.array(*[F.lit(float(x)) for x in lengths]), lambda x: x >= gop_seconds - 0.05))
    return F.when(gop_seconds.isNull() | (gop_seconds == 0), float(max(lengths, default=6))).otherwise(F.coalesce(fits, gop_seconds))


def looked_up(rows: DataFrame, registry: DataFrame, code: str, category: str) -> DataFrame:
    """``rows`` with ``name`` from ``registry`` (code, category, name): that of their category, else the first of any."""
    own = registry.groupBy(code, category).agg(F.min("name").alias("__own"))
    other = registry.groupBy(code).agg(F.min_by("name", category).alias("__any"))
    out = rows.join(own, [code, category], "left").join(other, code, "left")
    return out.withColumn("name", F.coalesce("__own", "__any")).drop("__own", "__any")


def with_defaults(rows: DataFrame, defaults: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """``rows`` whose missing ``columns`` come from ``defaults``, and are 0 where those lack them too."""
    d = defaults.select(by, *[F.col(c).alias(f"__{c}") for c in columns])
    out = rows.join(d, by, "left")
    return out.withColumns({c: F.coalesce(c, f"__{c}", F.lit(0)) for c in columns}).drop(*[f"__{c}" for c in columns])


def referenced(tracks: DataFrame, references: DataFrame, by: str) -> DataFrame:
    """Tracks that some reference names."""
    return tracks.join(references.select(by).distinct(), by, "left_semi")
