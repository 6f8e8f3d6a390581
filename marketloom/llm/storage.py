"""Materialised steps in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder. A step written there survives the
loss of executors and cuts lineage. Where it is unset, a session in one process
(tests, a laptop) uses a folder of its own; on a cluster that is an error, as
executors would not find each other's files.

Steps that only an operator reads are deleted by ``discard`` once the next step is
written. The last steps, from which a returned frame is read, stay until their
owner clears the folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULT = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = LOCAL_DEFAULT
    return named.rstrip("/")


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files of staged frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_staged_at", None)
        if path is not None:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
