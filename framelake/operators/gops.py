"""Groups of pictures: sessions that open at a key frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .order import display_order
from .samples import UP_TO, by_track


def gop_ids(samples: DataFrame) -> DataFrame:
    """Adds ``gop`` (0 for frames before the first key frame); a null key counts as a key frame."""
    key = F.coalesce(F.col("key"), F.lit(True)).cast("long")
    return samples.withColumn("gop", F.sum(key).over(by_track("i").rowsBetween(*UP_TO)))


def gop_stats(samples: DataFrame) -> DataFrame:
    return gop_ids(samples).groupBy("track", "gop").agg(
        F.count("*").alias("frames"),
        F.sum("size").alias("bytes"),
        F.min("i").alias("first_i"),
        F.sum("duration").alias("ticks"),
        (F.col("gop") == 0).alias("partial"),
    )


def gop_summary(samples: DataFrame) -> DataFrame:
    """By track; the last GOP counts only in ``gops`` and ``max_ticks``."""
    w = Window.partitionBy("track").orderBy(F.desc("gop"))
    g = gop_stats(samples).where("not partial").withColumn("full", F.row_number().over(w) > 1)
    full = lambda c: F.when(F.col("full"), F.col(c))
    return g.groupBy("track").agg(
        F.count("*").alias("gops"),
        F.min(full("frames")).alias("min_frames"),
        F.max(full("frames")).alias("max_frames"),
        F.sum(full("frames")).alias("sum_frames"),
        F.max("ticks").alias("max_ticks"),
        F.coalesce(F.min(full("frames")) == F.max(full("frames")), F.lit(False)).alias("fixed"),
    )


def usual_gop(samples: DataFrame) -> DataFrame:
    """The most frequent length (of equally frequent ones the larger) and the number of GOPs of other lengths."""
    lengths = gop_stats(samples).where("not partial").groupBy("track", "frames").agg(F.count("*").alias("n"))
    usual = lengths.groupBy("track").agg(F.max(F.struct("n", "frames")).alias("u"), F.sum("n").alias("gops"))
    return usual.select("track", F.col("u.frames").alias("usual"), F.col("u.n").alias("n_usual"), (F.col("gops") - F.col("u.n")).alias("odd"))


def gop_patterns(samples: DataFrame, most: int = 24, gops: int = 400) -> DataFrame:
    """Each track's most frequent string of first letters in display order over its first GOPs; the first seen wins ties."""
    s = gop_ids(display_order(samples)).where(F.col("gop").between(1, gops))
    w = Window.partitionBy("track", "gop").orderBy("rank")
    s = s.withColumn("at", F.row_number().over(w)).where(F.col("at") <= most)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.substring("letter", 1, 1).alias("c")))), lambda x: x["c"]), "")
    p = s.groupBy("track", "gop").agg(text.alias("pattern")).groupBy("track", "pattern").agg(F.count("*").alias("n"), F.min("gop").alias("first"))
    return p.groupBy("track").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "pattern")).alias("b")).select("track", F.col("b.pattern").alias("pattern"), F.col("b.n").alias("n"))


def leading_frames(samples: DataFrame) -> DataFrame:
    """By GOP the frames shown before its first one."""
    s = gop_ids(display_order(samples))
    first = F.first("rank").over(Window.partitionBy("track", "gop").orderBy("i"))
    return s.withColumn("lead", (F.col("rank") < first).cast("long")).groupBy("track", "gop").agg(F.sum("lead").alias("leading"))


def longest_run(samples: DataFrame, letter: str) -> DataFrame:
    """By track the longest run of frames of one type in display order."""
    s = display_order(samples).where(F.col("letter") == letter)
    s = s.withColumn("island", F.col("rank") - F.row_number().over(by_track("rank")))
    return s.groupBy("track", "island").agg(F.count("*").alias("n")).groupBy("track").agg(F.max("n").alias("longest"), F.sum("n").alias("frames"))
