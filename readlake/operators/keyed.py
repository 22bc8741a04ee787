"""Changes to keyed tables, as new DataFrames (write them to a new path, or as partition overwrites)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_by_key(base: DataFrame, delta: DataFrame, key: str, version: str) -> DataFrame:
    """Upsert: of the rows of a key that with the highest version stays.  One shuffle, combined map-side."""
    both = base.unionByName(delta)
    rest = [c for c in both.columns if c not in (key, version)]
    best = both.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in both.columns if c != key])


def patched(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Columns of ``patch`` that aren't null replace those of the row with the same key."""
    changed = [c for c in patch.columns if c != key]
    new = patch.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in changed])
    return base.join(new, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in base.columns])


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of deleted keys."""
    return {name: df.join(gone.select(key), key, "left_anti") for name, df in tables.items()}


def replaced_slice(base: DataFrame, new: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The slices that ``new`` has rows of, replaced; their ordinals start at 0."""
    kept = base.join(new.select(*keys).distinct(), keys, "left_anti")
    number = (F.row_number().over(W.partitionBy(*keys).orderBy(ordinal)) - 1).cast("int")
    return kept.unionByName(new.withColumn(ordinal, number))


def overwrite_slices(new: DataFrame, path: str, keys: list[str]) -> None:
    """On disk: the partitions that ``new`` has rows of are replaced; the files of all others aren't touched."""
    new.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
