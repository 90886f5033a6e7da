"""Session settings and the scratch folder used by multi-pass plans."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings; all are session-level, none needs a restart.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where a later operator could have reused the join's partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # Long lists of files are listed by this many tasks, not by one task for each file.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "200",
    # Generated methods beyond the JIT compiler's limit would run interpreted: split those stages.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set what the operators rely on: adaptive skew handling and compilable code."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_path(spark: SparkSession, label: str = "table") -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster the
    path has to be visible to every executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/millrace-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back.

    Later passes see exactly the same rows and values even when executors are
    lost, and each pass reads only the columns it needs.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, for sessions started without it."""
    package = os.path.dirname(os.path.abspath(__file__))
    if spark.conf.get("spark.millrace.shipped", "") != "yes":
        folder = tempfile.mkdtemp(prefix="millrace-py-")
        archive = shutil.make_archive(os.path.join(folder, "millrace"), "zip",
                                      os.path.dirname(package), os.path.basename(package))
        spark.sparkContext.addPyFile(archive)
        spark.conf.set("spark.millrace.shipped", "yes")
    return spark
