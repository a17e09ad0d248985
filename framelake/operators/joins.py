"""Joins in time: as-of, nearest, interval, band. All are equi-joins or windows on the track, never all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _merged(left: DataFrame, right: DataFrame, value: Column, slack: int = 0) -> DataFrame:
    """Probes (track, t) and rows (track, t) in one table; a row comes before a probe of the same time, or of one that
    is up to ``slack`` earlier."""
    a = left.select("track", "t", F.lit(1).alias("side"), F.lit(None).cast("struct<t:bigint,v:bigint>").alias("r"))
    b = right.select("track", (F.col("t") - slack).alias("t"), F.lit(0).alias("side"), F.struct(F.col("t").cast("long").alias("t"), value.cast("long").alias("v")).alias("r"))
    return a.unionByName(b)


def as_of(left: DataFrame, right: DataFrame, value: str, slack: int = 0) -> DataFrame:
    """For each probe the last row at or before it, where times within ``slack`` are the same; before the first row, the first one."""
    w = Window.partitionBy("track").orderBy("t", "side", "r.v")
    back = F.last("r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    m = _merged(left, right, F.col(value), slack).withColumn("hit", F.coalesce(back, ahead)).where("side = 1")
    return m.select("track", "t", F.col("hit.v").alias(value), F.col("hit.t").alias("at"))


def nearest(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """For each probe the row nearest in time; of two as near the later one."""
    w = Window.partitionBy("track").orderBy("t", "side", "r.v")
    m = _merged(left, right, F.col(value)).withColumn("p", F.last("r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    m = m.withColumn("n", F.first("r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))).where("side = 1")
    later = F.col("p").isNull() | (F.col("n.t") - F.col("t") <= F.col("t") - F.col("p.t"))
    m = m.withColumn("hit", F.when(F.col("n").isNotNull() & later, F.col("n")).otherwise(F.col("p")))
    return m.select("track", "t", F.col("hit.v").alias(value), F.col("hit.t").alias("at"))


def interpolate(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """``value`` at each probe, in a straight line between the rows around it; null outside of them."""
    w = Window.partitionBy("track").orderBy("t", "side", "r.v")
    m = _merged(left, right, F.col(value)).withColumn("p", F.last("r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    m = m.withColumn("n", F.first("r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))).where("side = 1")
    slope = F.try_divide((F.col("n.v") - F.col("p.v")).cast("double"), F.col("n.t") - F.col("p.t"))
    return m.select("track", "t", F.round(F.col("p.v") + slope * (F.col("t") - F.col("p.t")), 3).alias(value))


def overlap(intervals: DataFrame, cell: int) -> DataFrame:
    """Ticks that each [lo, hi) has in each cell of a grid of ``cell`` ticks."""
    cells = F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))
    x = intervals.where("hi > lo").select("track", "i", "lo", "hi", F.explode(cells).alias("cell"))
    return x.withColumn("ticks", F.least(F.col("hi"), (F.col("cell") + 1) * cell) - F.greatest(F.col("lo"), F.col("cell") * cell)).select("track", "i", "cell", "ticks")


def band_pairs(a: DataFrame, b: DataFrame, tolerance: int) -> DataFrame:
    """Distinct (version, t, peer) where ``b``, another version, has a time within ``tolerance`` ticks.

    ``b`` is put into buckets as wide as the band and each row of ``a`` meets three of them. Times of one version
    and bucket are reduced to the least and the greatest first, which is all that the band needs at its edges;
    the middle bucket is wholly inside the band.
    """
    width = tolerance
    ends = b.groupBy(F.col("version").alias("peer"), F.floor(F.col("t") / width).alias("bucket")).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    probes = a.select("version", "t").distinct().withColumn("own", F.floor(F.col("t") / width))
    probes = probes.withColumn("bucket", F.explode(F.array(*[F.col("own") + k for k in (-1, 0, 1)])))
    near = ((F.col("bucket") < F.col("own")) & (F.col("t") - F.col("hi") <= tolerance)) | ((F.col("bucket") > F.col("own")) & (F.col("lo") - F.col("t") <= tolerance)) | (F.col("bucket") == F.col("own"))
    return probes.join(ends, "bucket").where((F.col("peer") != F.col("version")) & near).select("version", "t", "peer").distinct()


def key_alignment(keys: DataFrame, tolerance: int) -> DataFrame:
    """For each key (version, t) the number of other versions with a key within the band."""
    n = band_pairs(keys, keys, tolerance).groupBy("version", "t").agg(F.count("*").alias("peers"))
    return keys.select("version", "t").distinct().join(n, ["version", "t"], "left").na.fill(0, ["peers"])


def aligned_everywhere(keys: DataFrame, tolerance: int, reference: str) -> DataFrame:
    """By version its keys, those with one near in every other version, and the share of the reference's near one of its own, in thousandths."""
    pairs = band_pairs(keys, keys, tolerance)
    versions = keys.select("version").distinct().count()  # one number
    n = pairs.groupBy("version", "t").agg(F.count("*").alias("peers"), F.max((F.col("peer") == reference).cast("int")).alias("ref"))
    k = keys.select("version", "t").distinct().join(n, ["version", "t"], "left")
    out = k.groupBy("version").agg(F.count("*").alias("keys"), F.count(F.when(F.coalesce("peers", F.lit(0)) >= versions - 1, 1)).alias("everywhere"), F.sum(F.coalesce("ref", F.lit(0))).alias("near"))
    return out.select("version", "keys", "everywhere", F.when(F.col("version") == reference, 1000).otherwise(F.floor(F.col("near") * 1000 / F.col("keys"))).cast("long").alias("share"))


def missing_anywhere(keys: DataFrame, length: int, tolerance: int) -> DataFrame:
    """Boundaries at multiples of ``length`` at which some version that reaches them has no key within the band, with how many."""
    fit = segment_grid(keys, length, tolerance)
    return fit.groupBy("k").agg(F.count("*").alias("versions"), F.count(F.when(F.col("ok").isNull(), 1)).alias("missing")).where("missing > 0")


def segment_grid(keys: DataFrame, length: int, tolerance: int) -> DataFrame:
    """(version, k, ok): boundaries by version, ok null where no key is near."""
    ends = keys.groupBy("version").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    grid = ends.select("version", F.explode(F.sequence(F.ceil(F.col("lo") / length), F.floor(F.col("hi") / length))).alias("k"))
    near = keys.select("version", F.floor((F.col("t") + F.lit(length // 2)) / length).alias("k"), "t")
    near = near.where(F.abs(F.col("t") - F.col("k") * length) <= tolerance).select("version", "k").distinct().withColumn("ok", F.lit(1))
    return grid.join(near, ["version", "k"], "left")


def segment_fit(keys: DataFrame, length: int, tolerance: int) -> DataFrame:
    """By version the boundaries at multiples of ``length`` and those without a key within the band."""
    g = segment_grid(keys, length, tolerance)
    return g.groupBy("version").agg(F.count("*").alias("bounds"), F.count(F.when(F.col("ok").isNull(), 1)).alias("missing"), F.min(F.when(F.col("ok").isNull(), F.col("k"))).alias("first_missing"))


def same_frames(a: DataFrame, b: DataFrame) -> DataFrame:
    """By track whether both sides have the same sizes at the same positions; null when a side is missing."""
    j = a.select("track", "i", F.col("size").alias("x")).join(b.select("track", "i", F.col("size").alias("y")), ["track", "i"], "full")
    return j.groupBy("track").agg(F.count("x").alias("n_a"), F.count("y").alias("n_b"), F.min((F.col("x").eqNullSafe(F.col("y"))).cast("int")).alias("s")).select(
        "track", F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), F.col("s") == 1).alias("copied")
    )
