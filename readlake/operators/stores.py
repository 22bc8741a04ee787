"""Whole stores: rows as JSON lines, appended to, exported and cleared, by Spark's own writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_rows(name: str, df: DataFrame) -> DataFrame:
    """store, json: each row as JSON text, nulls included."""
    return df.select(F.lit(name).alias("store"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def export_stores(stores: dict[str, DataFrame], path: str) -> None:
    """Every store as JSON lines under ``path``, a folder for each; written by many tasks, never as one text."""
    for name, df in stores.items():
        json_rows(name, df).write.mode("overwrite").partitionBy("store").option("compression", "none").text(f"{path}/{name}")


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows to a log."""
    df.write.mode("append").parquet(path)


def clear_stores(spark: SparkSession, paths: list[str]) -> None:
    """Every store left with its columns and no rows."""
    for path in paths:
        empty = spark.createDataFrame([], spark.read.parquet(path).schema)
        empty.write.mode("overwrite").parquet(path)
