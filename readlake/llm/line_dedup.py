"""Line deduplication over levelled sorted runs of line hashes.

1. Lines are cut and hashed once (128 bits of BLAKE2b of the stripped line with A-Z lower-cased); each row says
   whether it is the first of its key in its document.  They are written in batches.
2. A batch is reduced to one row a key (documents that hold it, largest doc_id).  Its keys are merge-anti-joined
   with the sorted runs of all batches before it, which tells new keys from known ones, and are added as a run of
   their own: new keys first seen there, known ones as counts to add.  Full levels are merged (``operators.runs``).
3. A key that enough documents hold loses all lines but those of the largest doc_id.  Lines meet their keys by a
   shuffle of hashes; the few keys that hold a large share of all lines are looked up by broadcast.
4. The positions lost by a document (a document's own lines, no more) meet its text, in the only shuffle of texts.

Cases: null and empty texts are one empty line; every row is a document, so repeated rows of one doc_id count
each and share their verdict; a null doc_id never wins against a known one, and where no holder has one, all keep
the line; an empty table gives an empty index and result; other columns are carried by ``deduplicated`` and
ignored by the query (but for ``n_lines``, ``n_dropped`` and ``kept_text``, which it sets).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.llm.common import HOT_SHARE, discard, fresh_path, materialize, small, table, text_or_empty
from readlake.operators.runs import SortedRuns

LEAST_CHARS = 20
LEAST_DOCUMENTS = 3
BATCHES = 5
BUCKET_ROWS = 4_000_000
BLANKS = b" \t\n\x0b\x0c\r"
COLUMNS = {"h1": "BIGINT", "h2": "BIGINT", "holders": "BIGINT", "last_id": "BIGINT", "fresh": "BOOLEAN"}


def _key(line: bytes) -> bytes | None:
    """The line's key, or None where it is too short; A-Z are the bytes that lower() changes."""
    key = line.strip(BLANKS).lower()
    if len(key) < LEAST_CHARS or len(key) < 4 * LEAST_CHARS and len(key.decode(errors="replace")) < LEAST_CHARS:
        return None
    return key


def _cut(batches):
    for batch in small(batches):
        rows, at, first, digests = [], [], [], []
        for row, text in enumerate(batch.column(2).to_pylist()):
            seen = set()
            for pos, line in enumerate(text.split(b"\n")):
                if (key := _key(line)) is not None:
                    digest = hashlib.blake2b(key, digest_size=16).digest()
                    rows.append(row)
                    at.append(pos)
                    first.append(digest not in seen)
                    seen.add(digest)
                    digests.append(digest)
        if rows:
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            taken = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(at, pa.int32()), pa.array(first), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                names=["doc_id", "mark", "pos", "first", "h1", "h2"],
            )


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, mark (of the text), pos, first, h1, h2: the lines long enough to have a key."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("mark"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(_cut, "doc_id long, mark long, pos int, first boolean, h1 long, h2 long")


class LineIndex:
    """Persistent counts of lines: how many documents hold a key, and the largest doc_id of them."""

    def __init__(self, spark: SparkSession, path: str | None = None, rows: int = 0):
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))
        self.path = path or fresh_path(spark, "line-index", keep=True)
        self.runs = SortedRuns(spark, self.path, COLUMNS, ["h1", "h2"], {"holders": F.sum, "last_id": F.max, "fresh": F.max}, buckets)

    def add(self, batch: DataFrame, name: str) -> None:
        """Count the lines of a batch (rows as of ``lines``); a batch of a name that is in changes nothing."""
        if self.runs.holds(name):
            return
        groups = batch.where("first").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("holders"), F.max("doc_id").alias("last_id"))
        if not self.runs.state["runs"]:
            self.runs.add(groups.withColumn("fresh", F.lit(True)), name)
            return
        spark = batch.sparkSession
        both, new = fresh_path(spark, "line-groups"), fresh_path(spark, "line-groups-new")
        groups.write.parquet(both)
        groups = spark.read.parquet(both)
        self.runs.unseen(groups).write.parquet(new)
        fresh = spark.read.parquet(new)
        again = groups.join(fresh.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self.runs.add(fresh.withColumn("fresh", F.lit(True)).unionByName(again.withColumn("fresh", F.lit(False))), name)
        discard(spark, both)
        discard(spark, new)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The lines of a batch that no batch before it held."""
        return self.runs.unseen(batch)

    def repeated(self) -> DataFrame:
        """h1, h2, holders, last_id of the keys that LEAST_DOCUMENTS or more documents hold."""
        return self.runs.read().where(F.col("holders") >= LEAST_DOCUMENTS).drop("fresh")

    def size(self) -> int:
        """Distinct keys, from the rows as they are: a key is fresh once."""
        return self.runs.rows().where("fresh").count()


def lost_lines(rows: DataFrame, repeated: DataFrame, total: int) -> DataFrame:
    """doc_id, mark, pos of the lines that go.  Keys of at least HOT_SHARE of all lines (1 / HOT_SHARE at most) are broadcast."""
    cut = max(LEAST_DOCUMENTS, int(total * HOT_SHARE))
    named = repeated.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("last_id").alias("_last"), "holders")
    keys = rows.select("doc_id", "mark", "pos", "h1", "h2")
    same = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    goes = ~F.col("doc_id").eqNullSafe(F.col("_last"))
    tagged = keys.join(F.broadcast(named.where(F.col("holders") >= cut)), same, "left")
    hot = tagged.where(F.col("_h1").isNotNull() & goes).select("doc_id", "mark", "pos")
    rest = tagged.where(F.col("_h1").isNull()).select(*keys.columns)
    return hot.unionByName(rest.join(named.where(F.col("holders") < cut), same).where(goes).select("doc_id", "mark", "pos"))


def deduplicated(docs: DataFrame, index: LineIndex | None = None, batches: int = 1, name: str = "batch") -> DataFrame:
    """``docs`` with kept_text, n_lines and n_dropped.

    Its lines are added to ``index`` in so many batches (named, so that a repeated call counts once) and judged by
    all that the index holds; without one, an index is made for them and dropped.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "lines")
    lines(docs).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(path)
    rows = spark.read.schema("doc_id long, mark long, pos int, first boolean, h1 long, h2 long, batch int").parquet(path)
    total = rows.count()
    own = index or LineIndex(spark, rows=total)
    for k in range(batches):
        own.add(rows.where(F.col("batch") == k), f"{name}-{k}")
    gone = lost_lines(rows, own.repeated(), total).groupBy("doc_id", "mark").agg(F.collect_list("pos").alias("_lost"))
    gone = materialize(gone, "lost-lines").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "_lost")
    discard(spark, path)
    if index is None:
        own.runs.drop()
    carried = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    left = docs.select(F.struct(*carried).alias("row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(text_or_empty()).alias("_text"))
    both = left.join(gone, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_mark")), "left")
    both = both.select("row", "_lost", F.split(text_or_empty(F.col("row.text")), "\n").alias("_lines"))
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_lost"), lambda k: F.element_at("_lines", k + 1))
    return both.select(
        "row.*",
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.array_size(F.array_distinct("_lost")), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_lost").isNull(), text_or_empty(F.col("row.text"))).otherwise(F.array_join(stay, "\n")).alias("kept_text"),
    )


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), batches=BATCHES)
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCUMENTS}
), m AS (SELECT k.doc_id, pos, line, last_id IS NOT NULL AND last_id <> k.doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
