"""Adapters that read the driver's tables as sample tables: one row per frame of a track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, in whatever zone the session is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column).cast("timestamp_ntz"))


def by_track(*order: str) -> Window:
    return Window.partitionBy("track").orderBy(*(order or ("i",)))


UP_TO = (Window.unboundedPreceding, Window.currentRow)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as samples: track, i, offset, dts, cto, pts, duration, size, key, letter."""
    e = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("track"),
        "event_id",
        micros("ts").alias("dts"),
        F.floor(F.col("value") * 100 + 0.5).cast("long").alias("size"),
        (F.col("event_type") == "signup").alias("key"),
        F.col("event_type").alias("letter"),
    )
    w = by_track("dts", "event_id")
    return e.select(
        "track",
        (F.row_number().over(w) - 1).cast("long").alias("i"),
        (F.sum("size").over(w.rowsBetween(*UP_TO)) - F.col("size")).alias("offset"),
        "dts",
        ((F.col("event_id") % 3) * 40_000_000_000).alias("cto"),
        F.coalesce(F.lead("dts").over(w) - F.col("dts"), F.lit(0)).alias("duration"),
        "size",
        "key",
        "letter",
    ).withColumn("pts", F.col("dts") + F.coalesce("cto", F.lit(0)))
