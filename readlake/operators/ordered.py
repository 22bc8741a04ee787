"""Ordered operators on long histories: a key's rows are dealt by time bucket, and only one row per bucket
and key is ordered over the whole history, so that a key with very many rows is spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_island_start(df: DataFrame, key: str, time: str, order: list[str], gap: int, bucket: int) -> DataFrame:
    """Adds ``island``: the time at which the row's run of rows less than ``gap`` apart began."""
    rows = df.withColumn("_b", F.floor(F.col(time) / bucket))
    inside = W.partitionBy(key, "_b").orderBy(time, *order)
    over = W.partitionBy(key).orderBy("_b")
    ends = rows.groupBy(key, "_b").agg(F.max(time).alias("_end")).withColumn("_before", F.lag("_end").over(over)).drop("_end")
    prev = rows.withColumn("_prev", F.lag(time).over(inside)).join(ends, [key, "_b"])
    before: Column = F.coalesce("_prev", "_before")
    marked = prev.withColumn("_start", F.when(before.isNull() | (F.col(time) - before >= gap), F.col(time)))
    last = marked.groupBy(key, "_b").agg(F.max("_start").alias("_last"))
    carried = last.select(key, "_b", F.last("_last", ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    run = F.last("_start", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("_run", run).join(carried, [key, "_b"]).withColumn("island", F.coalesce("_run", "_carried")).select(*df.columns, "island")


def _blocked(df: DataFrame, keys: list[str], order: list[str], block: Column) -> tuple[DataFrame, W, W]:
    return df.withColumn("_b", block), W.partitionBy(*keys, "_b").orderBy(*order), W.partitionBy(*keys).orderBy("_b")


def with_running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], block: Column) -> DataFrame:
    """Adds running sums over a key's rows in ``order``, each row's own value included.

    In two levels: within blocks of rows, and over one row for each block.  ``block`` is a number that doesn't fall in
    ``order``; a block's rows are ordered in one task, never a key's.
    """
    rows, inside, over = _blocked(df.withColumns({f"_v_{name}": value for name, value in sums.items()}), keys, order, block)
    totals = rows.groupBy(*keys, "_b").agg(*[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums])
    before = totals.select(*keys, "_b", *[F.coalesce(F.sum(f"_t_{name}").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"_t_{name}") for name in sums])
    running = {name: F.sum(f"_v_{name}").over(inside.rowsBetween(W.unboundedPreceding, 0)) for name in sums}
    both = rows.withColumns(running).join(before, [*keys, "_b"])
    return both.select(*[c for c in df.columns if c not in sums], *[(F.coalesce(name, F.lit(0)) + F.col(f"_t_{name}")).alias(name) for name in sums])


def with_neighbour(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, block: Column, ahead: bool = False) -> DataFrame:
    """Adds ``name``, the value of the row before (or ``ahead``) in a key's order, null for the first; in two levels as above."""
    rows, inside, over = _blocked(df, keys, order, block)
    edge = (F.min_by if ahead else F.max_by)(value, F.struct(*order))
    shift = F.lead if ahead else F.lag
    edges = rows.groupBy(*keys, "_b").agg(edge.alias("_edge"), F.count(F.lit(1)).alias("_rows"))
    edges = edges.select(*keys, "_b", shift("_edge").over(over).alias("_edge"))
    place = F.row_number().over(inside.orderBy(*[F.desc(c) if ahead else F.asc(c) for c in order]))
    both = rows.withColumn("_near", shift(value).over(inside)).withColumn("_place", place).join(edges, [*keys, "_b"])
    return both.select(*df.columns, F.when(F.col("_place") == 1, F.col("_edge")).otherwise(F.col("_near")).alias(name))


def with_window_of(df: DataFrame, keys: list[str], at: str, width: int, aggregates: dict[str, Column]) -> DataFrame:
    """Adds aggregates over a key's rows whose ``at`` (a whole number) is up to ``width`` before the row's, or equal.

    Rows are dealt by spans of ``width``, and each is lent to the next span, which sees all that its rows' windows reach.
    """
    span = F.floor(F.col(at) / width)
    lent = df.withColumn("_span", F.explode(F.array(span, span + 1)))
    w = W.partitionBy(*keys, "_span").orderBy(at).rangeBetween(-width, 0)
    return lent.withColumns({name: a.over(w) for name, a in aggregates.items()}).where(F.col("_span") == span).drop("_span")
