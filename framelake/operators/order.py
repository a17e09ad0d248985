"""Decode and display order, and what is odd about timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .samples import UP_TO, by_track


def display_order(samples: DataFrame) -> DataFrame:
    """Adds ``rank`` in display order: by pts, then by decode index."""
    return samples.withColumn("rank", (F.row_number().over(by_track("pts", "i")) - 1).cast("long"))


def dts_backwards(samples: DataFrame, time: str = "dts") -> DataFrame:
    """Frames whose time is less than that of the frame before, with the step."""
    step = F.col(time) - F.lag(time).over(by_track("i"))
    return samples.withColumn("step", step).where("step < 0").select("track", "i", "step")


def pts_gaps(samples: DataFrame, least: int = 100_000) -> DataFrame:
    """Gaps in display order above ``least`` ticks and 2.5 average durations, in tracks of more than two frames."""
    whole = Window.partitionBy("track")
    s = samples.withColumn("gap", F.col("pts") - F.lag("pts").over(by_track("pts", "i")))
    s = s.withColumn("n", F.count("*").over(whole)).withColumn("total", F.sum("duration").over(whole))
    return s.where((F.col("n") > 2) & (F.col("gap") > least) & (F.col("gap") * 2 * F.col("n") > 5 * F.col("total"))).select("track", "i", "gap")


def duration_gaps(samples: DataFrame, slack: int = 35_000, first: int = 20_000) -> DataFrame:
    """Frames that start more than ``slack`` ticks after the frame before should end, among the first ones; for audio tracks."""
    end = F.lag(F.col("dts") + F.col("duration")).over(by_track("i"))
    return samples.withColumn("gap", F.col("dts") - end).where((F.col("i") < first) & (F.col("gap") > slack)).select("track", "i", "gap")


def anomalies(samples: DataFrame, least: int = 100_000, slack: int = 35_000, first: int = 20_000) -> DataFrame:
    """All oddities (track, i, kind, ticks) in one pass over one shuffle; ``audio``, where the table has it, says which
    tracks can be late."""
    whole = Window.partitionBy("track")
    audio = F.col("audio") if "audio" in samples.columns else F.lit(True)
    s = samples.select(
        "track", "i", "pts", F.lag("pts").over(by_track("i")).alias("before"), (F.col("dts") - F.lag(F.col("dts") + F.col("duration")).over(by_track("i"))).alias("late"),
        F.count("*").over(whole).alias("n"), F.sum("duration").over(whole).alias("total"), audio.alias("audio"),
    ).withColumn("gap", F.col("pts") - F.lag("pts").over(by_track("pts", "i")))
    one = lambda kind, on, ticks: F.when(on, F.struct(F.lit(kind).alias("kind"), ticks.alias("ticks")))
    found = F.array(
        one("backwards", F.col("pts") < F.col("before"), F.col("pts") - F.col("before")),
        one("gap", (F.col("n") > 2) & (F.col("gap") > least) & (F.col("gap") * 2 * F.col("n") > 5 * F.col("total")), F.col("gap")),
        one("late", F.col("audio") & (F.col("i") < first) & (F.col("late") > slack), F.col("late")),
    )
    return s.select("track", "i", F.explode(F.array_compact(found)).alias("x")).select("track", "i", "x.kind", "x.ticks")


def around(samples: DataFrame, at: int, n: int) -> DataFrame:
    """``n`` frames around position ``at`` in display order; the window slides to stay inside the track."""
    s = display_order(samples).withColumn("last", F.max("rank").over(Window.partitionBy("track")))
    lo = F.greatest(F.lit(0), F.least(F.lit(at - n // 2), F.col("last") - n + 1))
    return s.where((F.col("rank") >= lo) & (F.col("rank") < lo + n)).select("track", "rank", "i")


def unwrap(samples: DataFrame, wrapped: str, modulus: int) -> DataFrame:
    """Adds ``unwrapped``: each value is the one congruent to ``wrapped`` that is nearest to the value before."""
    step = F.col(wrapped) - F.lag(wrapped).over(by_track("i"))
    near = F.pmod(step + modulus // 2, F.lit(modulus)) - modulus // 2
    s = samples.withColumn("__d", F.coalesce(near, F.col(wrapped)))
    return s.withColumn("unwrapped", F.sum("__d").over(by_track("i").rowsBetween(*UP_TO))).drop("__d")


def derive_dts(samples: DataFrame) -> DataFrame:
    """Decode times from display times: sorted pts by position, moved back so that none is after its pts."""
    a = samples.select("track", "i", "pts", (F.row_number().over(by_track("i"))).alias("k"))
    b = samples.select("track", F.col("pts").alias("sorted"), F.row_number().over(by_track("pts", "i")).alias("k"))
    s = a.join(b, ["track", "k"])
    return s.withColumn("derived", F.col("sorted") - F.max(F.col("sorted") - F.col("pts")).over(Window.partitionBy("track"))).select("track", "i", "derived")


def coalesce_runs(samples: DataFrame, gap: int) -> DataFrame:
    """Byte runs of key frames, joined where at most ``gap`` bytes lie between."""
    end = F.lag(F.col("offset") + F.col("size")).over(by_track("i"))
    new = (F.col("offset") - end > gap) | end.isNull()
    s = samples.where("key").withColumn("__new", new.cast("long"))
    s = s.withColumn("run", F.sum("__new").over(by_track("i").rowsBetween(*UP_TO)))
    return s.groupBy("track", "run").agg(F.min("offset").alias("lo"), F.max(F.col("offset") + F.col("size")).alias("hi"), F.count("*").alias("frames"))
