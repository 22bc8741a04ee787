"""The folder that driver and executors share, and scratch paths in it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where none is configured, a local session gets a temporary one; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-readlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str, keep: bool = False) -> str:
    """A path in the shared folder; what is there when the driver ends is deleted, unless it is to be kept."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if not keep:
        _MADE.append((spark, path))
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder whose every reader has been written elsewhere."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back what several branches of a plan need: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _discard_all() -> None:
    for spark, path in _MADE:
        try:
            if spark.sparkContext._jsc is not None:
                discard(spark, path)
        except Exception:  # noqa: BLE001  the session has ended: its scratch is left to the cluster's cleaner
            return
