"""Streams read from folders of files, how a table is played back as one, and how a stream is run to its end."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.sources.shared import discard, fresh_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTS = 5  # spans of arrival, and so micro-batches, that a table is played back in
ROWS = 200_000  # of a file, about


def file_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The files of a folder as a stream, so many a micro-batch, in the order in which they came."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def part_stream(spark: SparkSession, path: str, parts: int = PARTS) -> DataFrame:
    """What ``played_back`` wrote as a stream, all files of a part a micro-batch: in between, time would run ahead of rows that have arrived."""
    return file_stream(spark, path, max(1, (_files(spark, path) - 1) // parts))


def _files(spark: SparkSession, path: str) -> int:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sum(x.getPath().getName().endswith(".parquet") for x in fs.listStatus(at)) if fs.exists(at) else 0


def played_back(rows: DataFrame, time: str, delay: int, identity: str, ahead: int | None = None, parts: int = PARTS) -> str:
    """``rows`` as a folder of files that come one after the other, as from a source whose rows are up to ``delay`` seconds late.

    A row arrives ``delay`` seconds after its time at most, by a hash of ``identity``; the parts hold spans of
    arrival, each in as many files (of ROWS rows or so; empty ones fill up).  The last file holds one row of nulls whose time is ``ahead`` seconds after the newest (``delay`` if not
    given): it moves the watermark on, as any later row would.
    """
    spark = rows.sparkSession
    path = fresh_path(spark, "played-back")
    arrival = F.unix_micros(time) + F.pmod(F.xxhash64(identity), F.lit(max(1, delay * 1_000_000)))
    low, high, n = rows.select(arrival.alias("a")).agg(F.min("a"), F.max("a"), F.count("a")).first()
    if low is None:
        rows.write.parquet(path)
        return path
    part = F.floor((arrival - low) * parts / (high - low + 1)).cast("int")
    spread = fresh_path(spark, "played-parts")
    rows.withColumn("_part", part).write.partitionBy("_part").parquet(spread)
    files = -(-n // (parts * ROWS))
    for k in range(parts):  # one after the other, as the source takes files by their age
        spark.read.parquet(spread).where(F.col("_part") == k).select(*rows.columns).repartition(files).write.mode("append").parquet(path)
        for _ in range((k + 1) * files - _files(spark, path)):
            rows.limit(0).coalesce(1).write.mode("append").parquet(path)
    newest = rows.agg(F.max(time).alias("t")).select((F.col("t") + F.make_dt_interval(secs=F.lit(delay if ahead is None else ahead))).alias("t"))
    newest.select(*[F.col("t").alias(c) if c == time else F.lit(None).cast(kind).alias(c) for c, kind in rows.dtypes]).write.mode("append").parquet(path)
    discard(spark, spread)
    return path


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder of events as a stream, with ts as a timestamp (watermarks need one)."""
    path = os.path.join(sf_dir, "events.parquet")
    return file_stream(spark, path).withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> list[dict]:
    """Process what there is, batch by batch, then stop; the progress of each batch.

    State is kept in RocksDB, which operators with timers need.  ``checkpoint`` names a run that goes on where it
    stopped.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint or fresh_path(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return [dict(p) for p in query.recentProgress]
