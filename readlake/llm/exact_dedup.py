"""Exact deduplication against a persistent digest index.

The index is bucketed and sorted by digest (``operators.runs``).  A delta is first reduced to one row per digest
(map-side), then merge-anti-joined with the index (the index side is read in its buckets, without a shuffle), and
what is new is appended.  A known digest that comes again is appended too, as a later row with the delta's
count and largest doc_id: ``read`` adds the rows of a digest up in their bucket, again without a shuffle, and runs
are merged when a level is full.  Classes are looked up in the index; the few digests that hold a large share of
the rows are looked up by broadcast.  A new index gets a bucket for every BUCKET_ROWS rows; one that is there
keeps its own number, which its commits hold, whatever the session's settings are.

The query brings the documents in two deltas, so that the second meets the digests of the first.

Cases: null text counts as empty; an empty table gives an empty index and result; repeated rows of one
doc_id share one verdict (``stage`` keeps one of them); a null doc_id never wins against a known one;
other columns are carried by ``stage`` and ignored by the query.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.llm.common import ascii_lower, discard, fresh_path, join_groups, materialize, table, text_or_empty
from readlake.operators.runs import SortedRuns

BUCKET_ROWS = 2_000_000
DELTAS = 2
COLUMNS = {"digest": "STRING", "keep_id": "BIGINT", "group_size": "BIGINT"}


def text_digest(text: str | Column = "text") -> Column:
    """SHA-256 (hex) of the text with A-Z lower-cased."""
    return F.sha2(ascii_lower(text_or_empty(text)).cast("binary"), 256)


class DigestIndex:
    """Rows (digest, keep_id, group_size) in runs bucketed and sorted by digest; a digest may have several, which add up.

    ``path`` finds an index again, in any session: its buckets, runs and deltas are kept beside its files.
    ``name`` begins the runs' names in the session's catalogue; ``rows`` is how many a new index is made for.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, name: str | None = None, rows: int = 0):
        self.spark = spark
        self.name = name or "digest_run"
        self.path = path or fresh_path(spark, "digest-index", keep=True)
        wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))
        self.runs = SortedRuns(spark, self.path, COLUMNS, ["digest"], {"keep_id": F.max, "group_size": F.sum}, wanted, self.name)

    @property
    def buckets(self) -> int:
        return self.runs.buckets

    def read(self) -> DataFrame:
        return self.runs.read()

    def append(self, delta: DataFrame, name: str | None = None) -> None:
        """Add the digests of ``delta`` (doc_id, digest) that the index lacks, and later rows for those that it has.

        A delta of a name that is in changes nothing, so that a job that failed on the way can be run again.
        """
        name = name or uuid.uuid4().hex
        if self.runs.holds(name):
            return
        groups = delta.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        if not self.runs.state["runs"]:
            self.runs.add(groups, name)
            return
        path = fresh_path(self.spark, "digest-groups")
        groups.write.parquet(path)
        groups = self.spark.read.parquet(path)
        fresh = self.runs.unseen(groups)
        again = groups.join(self.runs.read().select("digest").hint("merge"), "digest", "left_semi")
        self.runs.add(fresh.unionByName(again), name)
        discard(self.spark, path)

    def assign(self, delta: DataFrame, total: int) -> DataFrame:
        """``delta`` with the keep_id and group_size of each row's digest."""
        return join_groups(delta, self.read(), "digest", "group_size", total)

    def drop(self) -> None:
        """Forget the runs and delete their files."""
        self.runs.drop()


def digests(docs: DataFrame) -> DataFrame:
    return materialize(docs.select("doc_id", text_digest().alias("digest")), "digests")


def classes(docs: DataFrame, index: DigestIndex | None = None, deltas: int = 1, name: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The documents are appended to ``index`` in so many deltas, of a ``name`` if they may come again; without one,
    an index is made for them and dropped.
    """
    spark = docs.sparkSession
    rows = digests(docs)
    total = rows.count()
    own = index or DigestIndex(spark, rows=total)
    for k in range(deltas):
        own.append(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(deltas)) == k), f"{name}-{k}" if name else None)
    found = own.assign(rows, total)
    if index is None:
        found = materialize(found, "digest-classes")
        own.drop()
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), deltas=DELTAS)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that stay, one row each, with the columns they came with.  Texts are shuffled once, by one key."""
    key = lambda digest: F.concat_ws("/", digest, F.col("doc_id").cast("string")).alias("_key")
    stay = classes(docs).where("kept").select(key("text_sha256"))
    joined = docs.select(F.struct(*docs.columns).alias("row"), key(text_digest())).join(stay, "_key", "left_semi")
    return joined.dropDuplicates(["_key"]).select("row.*")


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
