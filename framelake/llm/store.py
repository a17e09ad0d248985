"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset and all runs in one process, a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = getattr(shared_dir, "own", None)
        if at is None:
            at = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="framelake-")
    return at.rstrip("/")


def with_source(df: DataFrame, kept: list[str], text: str) -> DataFrame:
    """The columns ``kept`` and behind them ``text``, under a name that none of them has."""
    name = "__source"
    while name in kept:
        name += "_"
    return df.select(*[f"`{c}`" for c in kept], F.col(f"`{text}`").alias(name))


class Scratch:
    """Parquet tables of one operator run: they cut lineage and survive the loss of an executor.

    Files go when the driver ends, or earlier by :meth:`drop` for those that the result doesn't read, or by :func:`clean`.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.at = f"{shared_dir(spark)}/framelake-{uuid.uuid4().hex}"
        _made.append((spark, self.at))

    def table(self, df: DataFrame, name: str, by: str | None = None, codec: str | None = None, block: int | None = None) -> DataFrame:
        """``df`` written and read again; with ``by``, in a folder for each value of that column, with ``codec``, compressed by it.

        ``block`` bounds the bytes that are held at once, in writing as in reading, where single rows take megabytes
        (Parquet looks at the size of pages and row groups after 100 rows otherwise).
        """
        path = f"{self.at}/{name}"
        schema = df.schema
        writer = df.write.mode("overwrite")
        if codec:
            writer = writer.option("compression", codec)
        if block:
            writer = writer.options(**{"parquet.block.size": block, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1})
        if by:  # a file by value stays open in a task, so that rows aren't sorted
            key = "spark.sql.maxConcurrentOutputFileWriters"
            before = self.spark.conf.get(key, "0")
            self.spark.conf.set(key, "8")
            try:
                writer.partitionBy(by).parquet(path)
            finally:
                self.spark.conf.set(key, before)
        else:
            writer.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.at}/{name}")


def _delete(spark: SparkSession, at: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def clean() -> None:
    """Delete all intermediate tables: at the end of the driver, or when no result is going to be read again."""
    while _made:
        spark, at = _made.pop()
        try:
            _delete(spark, at)
        except Exception:  # the JVM may have gone first
            return
