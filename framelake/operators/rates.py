"""Bit rates over time, peaks, and decoder buffers. Times are ticks of a microsecond; sums stay integers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from .samples import UP_TO, by_track

SECOND = 1_000_000


def bitrate_series(samples: DataFrame, bin: int) -> DataFrame:
    """Bits by track and slice of ``bin`` ticks from the first frame of all tracks; empty slices are 0.

    The span of all tracks is one row, which is read first; then bits are summed by (track, slice) before rows move,
    and a track's slices are filled in where they meet.
    """
    ends = samples.groupBy("track").agg(F.min_by("dts", "i").alias("lo"), F.max_by(F.col("dts") + F.col("duration"), "i").alias("hi"))
    span = ends.agg(F.min("lo").alias("start"), F.max("hi").alias("end")).first()
    start, end = span.start or 0, span.end or 0
    n = max(1, math.ceil((end - start) / bin - 1e-9))
    at = F.greatest(F.lit(0), F.least(F.floor((F.col("dts") - start) / bin), F.lit(n - 1))).cast("long")
    got = samples.groupBy("track", at.alias("slice")).agg((F.sum("size") * 8).alias("bits"))
    by = got.groupBy("track").agg(F.map_from_entries(F.collect_list(F.struct("slice", "bits"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long")))
    return by.select("track", F.posexplode(every).alias("slice", "bits")).withColumn("slice", F.col("slice").cast("long"))


def rate_stats(series: DataFrame) -> DataFrame:
    """Total, mean, first peak and variation by track; the last slice counts only in the mean."""
    w = Window.partitionBy("track")
    s = series.withColumn("inner", (F.col("slice") < F.max("slice").over(w)) | (F.max("slice").over(w) == 0))
    bits = F.when(F.col("inner"), F.col("bits"))
    best = F.max(F.when(F.col("inner"), F.struct("bits", (-F.col("slice")).alias("s"))))
    out = s.groupBy("track").agg(F.sum("bits").alias("total"), F.avg("bits").alias("mean"), best.alias("p"), F.stddev_pop(bits).alias("sd"), F.avg(bits).alias("m"))
    return out.select(
        "track", "total", F.round("mean", 4).alias("mean"), F.col("p.bits").alias("peak"), (-F.col("p.s")).alias("peak_at"),
        F.round(F.try_divide("sd", "m"), 6).alias("cv"), F.round(F.try_divide("p.bits", "mean"), 6).alias("ratio"),
    )


def rate_control(stats: DataFrame) -> DataFrame:
    """Constant, capped or variable, by variation and peak; too short to tell below six ``seconds``."""
    seconds = F.col("seconds") if "seconds" in stats.columns else F.lit(None).cast("double")
    kind = F.when(seconds < 6, "short").when((F.col("cv") < 0.1) & (F.col("ratio") < 1.2), "cbr").when(F.col("ratio") < 1.6, "capped").otherwise("vbr")
    return stats.select("track", kind.alias("guess"))


def peak_window(samples: DataFrame, width: int) -> DataFrame:
    """Most bits that start within ``width`` ticks from any frame; null for short tracks or single frames."""
    w = by_track("dts").rangeBetween(Window.currentRow, width - 1)
    s = samples.withColumn("b", F.sum(F.col("size") * 8).over(w))
    span = F.max(F.col("dts") + F.col("duration")) - F.min("dts")
    return s.groupBy("track").agg(F.when((F.count("*") > 1) & (span >= 0.999 * width), F.max("b")).alias("peak_bits"))


def run_bits(samples: DataFrame, frames: int = 4) -> DataFrame:
    s = samples.withColumn("b", F.sum(F.col("size") * 8).over(by_track("i").rowsBetween(1 - frames, 0)))
    return s.groupBy("track").agg(F.max("b").alias("most_bits"))


def buffer_needed(samples: DataFrame, rate: int) -> DataFrame:
    """Least buffer, in millionths of a bit, that a leaky bucket of ``rate`` bits a second needs: two running windows."""
    w = by_track("i").rowsBetween(*UP_TO)
    t = (F.col("dts") - F.first("dts").over(by_track("i"))) * rate
    s = samples.withColumn("t", t).withColumn("sum", F.sum(F.col("size") * 8 * SECOND).over(w))
    s = s.withColumn("low", F.min(F.col("sum") - F.col("size") * 8 * SECOND - F.col("t")).over(w))
    return s.groupBy("track").agg(F.max(F.col("sum") - F.col("t") - F.col("low")).alias("buffer"))


def _then(m, n):
    """The map that does ``m``, then ``n``: each adds ``a``, then keeps to [lo, hi]."""
    keep = lambda x: F.least(n["hi"], F.greatest(n["lo"], x + n["a"]))
    return F.struct((m["a"] + n["a"]).alias("a"), keep(m["lo"]).alias("lo"), keep(m["hi"]).alias("hi"))


def _vbv_chunks(samples: DataFrame, rate: int, size: int, fill: float, chunk: int, fan: int) -> DataFrame:
    """(track, chunk, f, level): frames of each chunk in order, and the level before the first of them.

    Chunks are dealt by (track, chunk), so a track's chunks lie in many tasks. Their maps are composed by groups of
    ``fan``, these by groups again, and the levels are carried down the same way; no list is longer than ``fan``
    but for the uppermost, which has one entry in chunk * fan * fan frames.
    """
    cap = F.lit(size * SECOND).cast("long")
    zero = F.lit(0).cast("long")
    whole = F.struct(zero.alias("a"), zero.alias("lo"), cap.alias("hi"))
    c = samples.groupBy("track", F.floor(F.col("i") / chunk).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("i", "dts", (F.col("size") * 8 * SECOND).alias("b")))).alias("f"))
    before = F.lag(F.element_at("f", -1)["dts"]).over(Window.partitionBy("track").orderBy("chunk"))
    c = c.withColumn("before", F.coalesce(before, F.col("f")[0]["dts"]))
    gap = lambda x, k: (x["dts"] - F.when(k == 0, F.col("before")).otherwise(F.col("f")[F.greatest(k - 1, F.lit(0))]["dts"])) * rate
    c = c.withColumn("f", F.transform("f", lambda x, k: F.struct(x["i"].alias("i"), gap(x, k).alias("g"), x["b"].alias("b"))))
    one = lambda x: F.struct((x["g"] - x["b"]).alias("a"), zero.alias("lo"), F.greatest(zero, cap - x["b"]).alias("hi"))
    maps = c.select("track", "chunk", F.aggregate("f", whole, lambda m, x: _then(m, one(x))).alias("m"))
    tables = [maps.withColumnRenamed("chunk", "k0")]
    for level in (1, 2):
        up = tables[-1].withColumn(f"k{level}", F.floor(F.col(f"k{level - 1}") / fan))
        listed = F.sort_array(F.collect_list(F.struct(F.col(f"k{level - 1}").alias("k"), "m"))).alias("ms")
        tables.append(up.groupBy("track", f"k{level}").agg(listed).withColumn("m", F.aggregate("ms", whole, lambda m, x: _then(m, x["m"]))))

    def carried(start, listed):
        """The level before each of ``listed``."""
        step = lambda acc, x: F.concat(acc, F.array(F.least(x["m"]["hi"], F.greatest(x["m"]["lo"], F.element_at(acc, -1) + x["m"]["a"]))))
        return F.aggregate(listed, F.array(start), step)

    top = tables[2].groupBy("track").agg(F.sort_array(F.collect_list(F.struct(F.col("k2").alias("k"), "m", "ms"))).alias("tops"))
    first = F.lit(int(size * SECOND * fill)).cast("long")
    levels = top.select("track", F.explode(F.arrays_zip(F.col("tops"), carried(first, "tops").alias("level"))).alias("z")).where("z.tops is not null")
    levels = levels.select("track", F.explode(F.arrays_zip(F.col("z.tops.ms").alias("of"), carried(F.col("z.level"), "z.tops.ms").alias("level"))).alias("y")).where("y.of is not null")
    groups = levels.select("track", F.col("y.of.k").alias("k1"), F.col("y.level").alias("level"))
    inner = tables[1].select("track", "k1", "ms").join(groups.hint("merge"), ["track", "k1"])
    starts = inner.select("track", F.explode(F.arrays_zip(F.col("ms").alias("of"), carried(F.col("level"), "ms").alias("level"))).alias("y")).where("y.of is not null")
    return c.drop("before").join(starts.select("track", F.col("y.of.k").alias("chunk"), F.col("y.level").alias("level")).hint("merge"), ["track", "chunk"])


def vbv(samples: DataFrame, rate: int, size: int, fill: float = 0.9, chunk: int = 512, fan: int = 256) -> DataFrame:
    """Decoder buffer of ``size`` bits filled at ``rate`` bits a second: underflows (more than half a bit short), the first
    one, the least level, the ticks that it is full, and underflows by frame in :func:`vbv_underflow_frames`.

    A frame maps the level by an addition between two limits, and such maps compose to one of their kind. Levels are
    millionths of a bit.
    """
    cap, zero, none = F.lit(size * SECOND).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("long")
    state = F.struct(F.col("level").alias("x"), zero.alias("n"), none.alias("first"), cap.alias("least"), zero.alias("full"))

    def play(m, f):
        filled = F.least(cap, m["x"] + f["g"])
        after = filled - f["b"]
        under = after < -SECOND // 2
        return F.struct(
            F.greatest(zero, after).alias("x"), (m["n"] + under.cast("long")).alias("n"), F.coalesce(m["first"], F.when(under, f["i"])).alias("first"), F.least(m["least"], after).alias("least"),
            (m["full"] + F.greatest(zero, m["x"] + f["g"] - cap)).alias("full"),
        )

    out = _vbv_chunks(samples, rate, size, fill, chunk, fan).select("track", F.aggregate("f", state, play).alias("r"))
    full = F.floor(F.sum("r.full") / rate)  # what didn't fit, as the time that it took to arrive
    return out.groupBy("track").agg(F.sum("r.n").alias("underflows"), F.min("r.first").alias("first_i"), F.min("r.least").alias("least"), full.alias("full_ticks"))


def vbv_underflow_frames(samples: DataFrame, rate: int, size: int, fill: float = 0.9, chunk: int = 512, fan: int = 256) -> DataFrame:
    """(track, i) of the frames at which the buffer of :func:`vbv` runs dry."""
    cap, zero = F.lit(size * SECOND).cast("long"), F.lit(0).cast("long")
    state = F.struct(F.col("level").alias("x"), F.array().cast("array<bigint>").alias("at"))

    def play(m, f):
        after = F.least(cap, m["x"] + f["g"]) - f["b"]
        return F.struct(F.greatest(zero, after).alias("x"), F.when(after < -SECOND // 2, F.concat(m["at"], F.array(f["i"]))).otherwise(m["at"]).alias("at"))

    out = _vbv_chunks(samples, rate, size, fill, chunk, fan).select("track", F.aggregate("f", state, play).alias("r"))
    return out.select("track", F.explode("r.at").alias("i"))


def packager_cuts(samples: DataFrame, length: int) -> DataFrame:
    """Key frames at which a packager cuts: the j-th cut is at the first key frame at or after j lengths that is unused.

    With f(i) key frames before i lengths, cut j is key frame j + max over i <= j of f(i) - i.
    """
    t = F.col("dts") - F.min("dts").over(Window.partitionBy("track"))
    keys = samples.withColumn("t", t).where("key").withColumn("k", F.row_number().over(by_track("i")) - 1).select("track", "k", "t")
    grid = keys.groupBy("track").agg(F.max("t").alias("end")).select("track", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("end") / length))).alias("j"))
    per = keys.groupBy("track", (F.floor(F.col("t") / length) + 1).alias("j")).agg(F.count("*").alias("n"))
    g = grid.join(per, ["track", "j"], "left").na.fill(0, ["n"])
    w = by_track("j").rowsBetween(*UP_TO)
    g = g.withColumn("f", F.sum("n").over(w)).withColumn("k", F.col("j") + F.max(F.col("f") - F.col("j")).over(w))
    return g.select("track", "j", "k").join(keys, ["track", "k"]).select("track", "j", "k", "t")
