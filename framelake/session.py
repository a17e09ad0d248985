"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: Bytes of a batch of rows for a Python worker, where the session doesn't say: rows of a scan can be long.
BATCH_BYTES = 16 << 20

_shipped: set[str] = set()


def package_zip(path: str) -> str:
    """The modules of this package as a zip that Python can import from."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "framelake")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, ROOT))
    return path


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package: from where the driver has it, and on a cluster from a zip that Spark sends.

    Batches for Python workers are bounded in bytes where the session leaves them unbounded.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, str((1 << 31) - 1), "2147483647b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = sc.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    one_process = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
    if not one_process and sc.applicationId not in _shipped:
        sc.addPyFile(package_zip(os.path.join(tempfile.mkdtemp(prefix="framelake-"), "framelake.zip")))
        _shipped.add(sc.applicationId)
    return spark


def local_session(cpus: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("framelake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
