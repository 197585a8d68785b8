"""Intermediate tables in the folder that the cluster shares: they cut lineage and survive lost executors."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; a folder of our own only where that is unset, on one machine."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not held:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        held = held.get() if held.isDefined() else None
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
        held = f"file:///tmp/checkpoints/{os.getpid()}"
        spark.sparkContext.setCheckpointDir(held)
    return held.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df below the shared folder and rereads it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/driftmerge-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._driftmerge_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes what materialize() wrote, once nothing reads it any more."""
    for df in frames:
        if path := getattr(df, "_driftmerge_path", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours in what the cluster shares."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows by path over as many tasks as the session's shuffles have.

    Work by the document isn't work by the byte: adaptive execution, which counts bytes, would put a small table in one task.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
