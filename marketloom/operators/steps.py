"""Steps of an iteration, written to the folder that driver and executors share.

``spark.checkpoint.dir`` names the folder. A written step cuts the lineage and survives
lost executors. Where the setting is unset, a session in one process uses a folder of
its own; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-steps-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df``, computed once. Files of its shuffles go when it is written, or they would stay until the driver collects its garbage."""
    spark = df.sparkSession
    path, before = f"{folder(spark)}/step-{uuid.uuid4().hex}", spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*steps: DataFrame) -> None:
    """Deletes the files of written steps that nothing reads any more."""
    for df in steps:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
