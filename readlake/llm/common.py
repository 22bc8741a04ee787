"""What the training-data operators share."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.sources.shared import discard, fresh_path, materialize, shared_dir
from readlake.sources.tables import table

__all__ = ["HOT_SHARE", "ascii_lower", "discard", "fresh_path", "join_groups", "materialize", "shared_dir", "small", "table", "text_or_empty"]

#: Groups with at least this share of all rows are joined by broadcast, so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001


#: Bytes of batches after which a Python worker returns what it has freed.
RETURNED = 8 << 20


def release() -> None:
    """Return freed memory to the system: Spark keeps a Python worker for later tasks, and what it held at most would stay with it."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()  # trims the C library's heap, in which Python and tokenizers allocate


def small(batches, rows: int = 256, size: int = 4 << 20):
    """Arrow batches in slices of so many rows and about so many bytes of text, to bound what a task holds at a time.

    What earlier slices took is returned to the system after each RETURNED bytes and at the task's end.
    """
    seen = whole = 0
    for batch in batches:
        seen += batch.nbytes
        n = batch.num_rows
        weight = sum(
            (pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype("int64") for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)),
            start=0,
        )
        at = 0
        while at < n:
            stop = min(n, at + rows)
            if not isinstance(weight, int):
                stop = at + max(1, int((weight[at:stop].cumsum() <= size).sum()))
            yield batch.slice(at, stop - at)
            at = stop
        del batch, weight
        if seen >= RETURNED:
            release()
            whole, seen = whole + seen, 0
    if whole or seen >= RETURNED >> 3:
        release()


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; pure ASCII strings take the byte-wise path of lower()."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(
        F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left-join one row per group back to its rows without sending a hot key to one task.

    Groups holding at least HOT_SHARE of ``total`` rows (at most 1 / HOT_SHARE of them, whatever the
    input's size) are broadcast; the rest go through an ordinary shuffle join, where no key holds
    more than HOT_SHARE of the rows.
    """
    cut = max(2, int(total * HOT_SHARE))
    hot = groups.where(F.col(size) >= cut)
    cold = groups.where(F.col(size) < cut)
    named = [F.col(c).alias(f"_hot_{c}") for c in groups.columns]
    tagged = rows.join(F.broadcast(hot.select(*named)), rows[key] == F.col(f"_hot_{key}"), "left")
    extra = [c for c in groups.columns if c != key]
    found = tagged.where(F.col(f"_hot_{key}").isNotNull()).select(
        *[rows[c] for c in rows.columns], *[F.col(f"_hot_{c}").alias(c) for c in extra]
    )
    rest = tagged.where(F.col(f"_hot_{key}").isNull()).select(*[rows[c] for c in rows.columns])
    return found.unionByName(rest.join(cold, key, "left").select(*rows.columns, *extra))
