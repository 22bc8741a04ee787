"""Reads the source tables, and the views derived from them by DataFrame expressions.

``VIEWS`` holds each view's definition in ANSI SQL, from which ``with_views`` builds the reference text
that queries are checked against.
"""

from __future__ import annotations

import os
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARE = 2 << 20  # bytes of the input's files, or of the texts in them, that one task is dealt
_BYTES: dict[tuple, int] = {}  # by files, their lengths and times
BOOK_SPAN = 1000  # doc_ids that one book of a source spans, so that a book doesn't grow with the corpus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads or, if that is more, of all strings in them: a file may hold a text once for many rows."""
    spark = df.sparkSession
    at, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    files = sorted(unquote(file) for file in df.inputFiles())
    found = [(path := at(file)).getFileSystem(conf).getFileStatus(path) for file in files]
    key = tuple((file, status.getLen(), status.getModificationTime()) for file, status in zip(files, found, strict=True))
    if files and key not in _BYTES:
        rows = spark.read.parquet(*files)
        texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")).cast("long"), F.lit(0)) for c, kind in rows.dtypes if kind == "string"]
        _BYTES[key] = max(sum(size for _, size, _ in key), rows.select(F.sum(sum(texts, F.lit(0)))).first()[0] or 0)
    return _BYTES.get(key, 0)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by its keys, over so many tasks that one's share doesn't grow with the input; what is grouped or joined by the keys stays in place."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(df) // SHARE)), *keys)


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, text: documents by line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(table(spark, sf_dir, "documents"))


def words(col: str) -> F.Column:
    return F.expr(f"filter(split({col}, '[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+'), w -> w <> '')")


def shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of a reading shelf."""
    d = table(spark, sf_dir, "documents")
    progress = ((F.col("doc_id") * 37) % 101).cast("double")
    created = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0)")
    return d.select(
        "doc_id",
        (F.col("doc_id") % 10).alias("user_id"),
        F.array_join(F.slice(words("text"), 1, 6), " ").alias("title"),
        F.col("source").alias("author"),
        F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("collection"),
        F.col("lang").alias("tag"),
        (F.col("doc_id") % 7 == 0).alias("favorite"),
        F.octet_length("text").cast("long").alias("byte_size"),
        F.size(words("text")).cast("long").alias("words"),
        progress.alias("progress"),
        created.alias("created_at"),
        F.when(progress > 0, F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast((doc_id * 37) % 101 as int), cast(doc_id as int), 0)")).alias("last_read_at"),
        F.when(F.col("doc_id") % 50 == 0, "error").otherwise("ready").alias("status"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a ledger of calls."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_id") % 4 == 0, "offline").otherwise("ok")
    return e.select(
        "event_id", "ts", "user_id", F.col("event_id") % 3, status, F.floor("value").cast("long"), F.floor(F.col("value") * 10).cast("long")
    ).toDF("event_id", "ts", "user_id", "bot", "status", "est_tokens", "latency_ms")


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as saved reading positions."""
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", (F.col("event_id") % 5).alias("doc_id"), F.least(F.lit(100.0), F.col("value")).alias("progress")
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs."""
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("user_id"),
        status.alias("status"),
        F.when(F.col("o_orderpriority").startswith("1"), 10).otherwise(0).alias("priority"),
        F.col("o_orderdate").alias("updated_at"),
    )


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, line_no, text, heading: a source's documents as chapters, a blank line after every line."""
    d = table(spark, sf_dir, "documents").select(
        F.concat_ws("-", "source", F.floor(F.col("doc_id") / BOOK_SPAN).cast("string")).alias("book_id"), "doc_id", "text"
    )
    # a book is ordered by its documents, of which it spans BOOK_SPAN at most; lines get their numbers from these
    w = W.partitionBy("book_id").orderBy("doc_id")
    parts = F.concat(F.array(F.concat(F.lit("Chapter "), F.col("chapter").cast("string"))), F.split("text", "\n"))
    rows = d.withColumn("chapter", F.row_number().over(w)).withColumn("n", 2 * (F.size(F.split("text", "\n")) + 1))
    rows = rows.withColumn("before", F.sum("n").over(w) - F.col("n")).select("book_id", "before", F.posexplode(parts).alias("part", "text"))
    both = rows.select("book_id", "before", "part", F.explode(F.array(F.lit(0), F.lit(1))).alias("blank"), "text")
    at = F.col("before") + 2 * F.col("part") + F.col("blank")
    return both.select("book_id", at.alias("line_no"), F.when(F.col("blank") == 1, "").otherwise(F.col("text")).alias("text"), ((F.col("part") == 0) & (F.col("blank") == 0)).alias("heading"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages_of(table(spark, sf_dir, "documents"))


def passages_of(docs: DataFrame) -> DataFrame:
    """doc_id, chapter_idx, local_idx, chunk_idx, text: a document's lines with a word, five to a chapter."""
    n = lines_of(docs).where(F.trim("text") != "")
    at = (F.row_number().over(W.partitionBy("doc_id").orderBy("line_no")) - 1).alias("chunk_idx")
    return n.select("doc_id", at, "text").select("doc_id", F.floor(F.col("chunk_idx") / 5).cast("int").alias("chapter_idx"), (F.col("chunk_idx") % 5).alias("local_idx"), "chunk_idx", "text")


_WORDS = "list_filter(regexp_split_to_array({0}, '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> '')"

VIEWS = {
    "lines": "SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INT AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents",
    "shelf": f"""SELECT doc_id, doc_id % 10 AS user_id, array_to_string({_WORDS.format("text")}[1:6], ' ') AS title, source AS author,
  CASE WHEN doc_id % 5 <> 0 THEN source END AS collection, lang AS tag, doc_id % 7 = 0 AS favorite, octet_length(encode(text)) AS byte_size,
  len({_WORDS.format("text")}) AS words, ((doc_id * 37) % 101)::DOUBLE AS progress, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at,
  CASE WHEN (doc_id * 37) % 101 > 0 THEN TIMESTAMP '2024-01-01' + to_minutes(doc_id) + to_hours((doc_id * 37) % 101) END AS last_read_at,
  CASE WHEN doc_id % 50 = 0 THEN 'error' ELSE 'ready' END AS status FROM documents""",
    "usage": """SELECT event_id, ts, user_id, event_id % 3 AS bot, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 4 = 0 THEN 'offline' ELSE 'ok' END AS status,
  floor(value)::BIGINT AS est_tokens, floor(value * 10)::BIGINT AS latency_ms FROM events""",
    "progress": "SELECT event_id, ts, user_id, event_id % 5 AS doc_id, least(100.0, value) AS progress FROM events",
    "jobs": """SELECT o_orderkey AS job_id, o_custkey AS user_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'done' END AS status,
  CASE WHEN o_orderpriority LIKE '1%' THEN 10 ELSE 0 END AS priority, o_orderdate AS updated_at FROM orders""",
    "books": f"""SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY chapter, part, blank) - 1 AS line_no, CASE WHEN blank = 1 THEN '' ELSE text END AS text, part = 0 AND blank = 0 AS heading
  FROM (SELECT book_id, chapter, unnest(range(len(parts))) AS part, unnest(parts) AS text FROM (
    SELECT book_id, chapter, list_concat(['Chapter ' || chapter], string_split(text, chr(10))) AS parts FROM (
      SELECT source || '-' || (doc_id // {BOOK_SPAN}) AS book_id, row_number() OVER (PARTITION BY source, doc_id // {BOOK_SPAN} ORDER BY doc_id) AS chapter, text FROM documents))), (VALUES (0), (1)) AS b(blank)""",
    "passages": """SELECT doc_id, (chunk_idx // 5)::INT AS chapter_idx, (chunk_idx % 5)::INT AS local_idx, chunk_idx, text FROM (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::INT AS chunk_idx, text FROM lines WHERE trim(text) <> '')""",
}


def with_views(sql: str, **more: str) -> str:
    """``sql`` with the views that it names, directly or through others, put before it."""
    known = VIEWS | more
    order: list[str] = []
    seen: set[str] = set()

    def need(text: str) -> None:
        for name in known:
            if name not in seen and re.search(rf"(FROM|JOIN) {name}\b", text):
                seen.add(name)
                need(known[name])
                order.append(name)

    need(sql)
    head = ",\n".join(f"{n} AS ({known[n]})" for n in order)
    if not order:
        return sql
    return f"WITH RECURSIVE {head}, {sql[15:]}" if sql.startswith("WITH RECURSIVE ") else f"WITH {head}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {head}\n{sql}"
