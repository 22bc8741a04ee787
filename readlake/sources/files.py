"""Files as a source: their bytes, what they are by their first ones, and which of them are refused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.functions.files import decoded, file_format, reject_code
from readlake.params import UPLOAD_LIMIT_MB

TEXTS = ("txt", "markdown", "html")  # formats whose bytes are text


def file_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, size, format, reject_code, content: every file under a folder, judged.

    A file that is refused by its name or size is judged by the listing alone; only the bytes of others are read (the
    limit reaches the source, which skips larger files).  ``content`` is null for what is refused.  Files without a
    byte aren't listed at all, as Spark's sources leave them out.
    """
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name, size = F.element_at(F.split("path", "/"), -1), F.col("length")
    ext = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    listed = source.select("path", name.alias("name"), size.alias("size")).withColumn("ext", ext)
    refused = listed.withColumn("reject_code", reject_code(F.col("ext"), F.col("size"))).where("reject_code is not null")
    small = source.where((F.col("length") <= UPLOAD_LIMIT_MB * 1024 * 1024) & (F.col("length") > 0)).select("path", name.alias("name"), size.alias("size"), "content")
    read = small.withColumn("ext", ext).where(reject_code(F.col("ext"), F.col("size")).isNull())
    kind = file_format(F.hex(F.substring("content", 1, 4)), F.col("ext"), F.lit(""))
    good = read.withColumn("format", kind).withColumn("reject_code", F.when(F.col("format") == "unknown", "type"))
    columns = ["path", "name", "size", "format", "reject_code", "content"]
    none = {"format": F.lit(None).cast("string"), "content": F.lit(None).cast("binary")}
    return good.withColumn("content", F.when(F.col("reject_code").isNull(), F.col("content"))).select(*columns).unionByName(refused.withColumns(none).select(*columns))


def take_in(spark: SparkSession, folder: str, good: str, quarantine: str) -> None:
    """Files under ``folder`` to two sinks: accepted ones (by format, text decoded) and refused ones (by reason, without bytes)."""
    verdicts = file_verdicts(spark, folder)
    text = F.when(F.col("format").isin(*TEXTS), decoded(F.col("content")))
    kept = verdicts.where("reject_code is null").select("path", "name", "size", "format", text.alias("text"), F.when(~F.col("format").isin(*TEXTS), F.col("content")).alias("content"))
    kept.write.mode("append").partitionBy("format").parquet(good)
    verdicts.where("reject_code is not null").select("path", "name", "size", "reject_code").write.mode("append").partitionBy("reject_code").parquet(quarantine)
