"""Search, retrieval and the assembly of context from passages and chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readlake.functions import text as T
from readlake.params import STOP_WORDS, sql_list
from readlake.plans import keywords, scalars
from readlake.sources.tables import passages, table, with_views

CHAT_KEPT, WHOLE_CONTEXT = 30, 11_000  # fixed values
NEEDLE, SNIPPET_BEFORE, SNIPPET_AFTER, HITS = "tion", 40, 60, 60  # fixed values but for the needle


def passage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first passages that hold the needle, with what stands around its first hit."""
    hit = F.instr(F.lower("text"), NEEDLE)
    p = passages(spark, sf_dir).withColumn("hit", hit).where("hit > 0")
    p = p.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy("chunk_idx"))).where(F.col("rank") <= HITS)
    start = F.greatest(F.lit(1), F.col("hit") - SNIPPET_BEFORE)
    return p.select("doc_id", "chunk_idx", F.substring("text", start, F.col("hit") + len(NEEDLE) + SNIPPET_AFTER - start).alias("snippet"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, doc_id, text: each question asked of a document of its number, going round all documents."""
    n = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))  # one row
    return scalars.asked(spark, sf_dir).crossJoin(F.broadcast(n)).select("conv_id", "turn", (F.col("conv_id") % F.col("n")).alias("doc_id"), "text")


def retrieve_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each question the passage of its document with most occurrences of its words."""
    q = questions(spark, sf_dir).select("conv_id", "turn", "doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word"))
    q = q.where((F.length("word") > 3) & ~F.col("word").isin(*STOP_WORDS))
    asked = q.select("doc_id").distinct()
    toks = passages(spark, sf_dir).join(asked, "doc_id", "left_semi").select("doc_id", "chunk_idx", F.explode_outer(T.tokens(F.col("text"))).alias("word")).where("word is not null")
    per = toks.groupBy("doc_id", "chunk_idx", "word").agg(F.count(F.lit(1)).alias("n"))
    s = q.join(per, ["doc_id", "word"]).groupBy("conv_id", "turn", "doc_id", "chunk_idx").agg(F.sum("n").alias("score"))
    return s.withColumn("r", F.row_number().over(W.partitionBy("conv_id", "turn").orderBy(F.desc("score"), "chunk_idx"))).where("r = 1").drop("r")


def source_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For a scene's words (here a chapter's last passage) the passage of the chapter that holds most of them."""
    p = passages(spark, sf_dir)
    scene = p.groupBy("doc_id", "chapter_idx").agg(F.max_by("text", "chunk_idx").alias("scene"))
    words = F.slice(F.array_distinct(F.filter(F.split(F.lower("scene"), "[^a-z0-9_]+"), lambda w: F.length(w) > 4)), 1, 24)
    j = p.join(scene.select("doc_id", "chapter_idx", words.alias("ws")), ["doc_id", "chapter_idx"])
    score = F.size(F.filter("ws", lambda w: F.contains(F.lower("text"), w))) - 0.01 * F.col("local_idx")
    return j.groupBy("doc_id", "chapter_idx").agg(F.max_by("chunk_idx", F.struct(F.round(score, 6), -F.col("local_idx"))).alias("chunk_idx"), F.round(F.max(score), 6).alias("score"))


def chapter_at_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapter that holds a chunk number; past the end it is the last one, from its start."""
    p = passages(spark, sf_dir)
    c = p.groupBy("doc_id", "chapter_idx").agg(F.min("chunk_idx").alias("start"), F.count(F.lit(1)).alias("len"))
    last = p.groupBy("doc_id").agg(F.max("chapter_idx").alias("last"))
    want = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit(0), F.col("doc_id") % 11, F.lit(9999))).alias("chunk"))
    hit = want.join(c, "doc_id").where("chunk >= start and chunk < start + len").select("doc_id", "chunk", "chapter_idx", (F.col("chunk") - F.col("start")).alias("local_idx"))
    out = want.distinct().join(last, "doc_id").join(hit.distinct(), ["doc_id", "chunk"], "left")
    return out.select("doc_id", "chunk", F.coalesce("chapter_idx", "last").alias("chapter_idx"), F.coalesce("local_idx", F.lit(0)).alias("local_idx"))


def bookmark_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks with the passage that they point to, if it is there."""
    b = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", ((F.col("doc_id") * 7) % 12).cast("int").alias("chunk_idx"), F.concat(F.lit("b"), F.col("doc_id")).alias("label"))
    return b.join(passages(spark, sf_dir).select("doc_id", "chunk_idx", "text"), ["doc_id", "chunk_idx"], "left")


def anchor_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a quote of 2 to 400 characters first stands in its passage."""
    p = passages(spark, sf_dir)
    q = p.select("doc_id", "chunk_idx", F.expr("substring(text, 11, doc_id % 30)").alias("quote"))
    at = F.instr("text", F.col("quote")) - 1
    return q.where(F.length("quote").between(2, 400)).join(p.select("doc_id", "chunk_idx", "text"), ["doc_id", "chunk_idx"]).select("doc_id", "chunk_idx", at.alias("start"), (at + F.length("quote")).alias("stop"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, chunk_idx, start, stop, color: some spans of each longer passage, overlapping ones among them."""
    spans = [(0, 20), (10, 30), (20, 33), (35, 50), (49, 60)]
    s = F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop")) for a, b in spans])).alias("s")
    return passages(spark, sf_dir).where("length(text) >= 60").select("doc_id", "chunk_idx", s).select("doc_id", "chunk_idx", "s.start", "s.stop", (F.col("s.start") % 4).alias("color"))


def annotation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of a passage by start, without those that begin before the last kept one ends."""
    per = annotations(spark, sf_dir).groupBy("doc_id", "chunk_idx").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "color"))).alias("ss"))
    kept = F.expr(
        """aggregate(ss, named_struct('end', -1, 'out', cast(array() as array<struct<start:int,stop:int,color:int>>)),
          (a, s) -> if(s.start < a.end, a, named_struct('end', s.stop, 'out', concat(a.out, array(s)))), a -> a.out)"""
    )
    return per.select("doc_id", "chunk_idx", F.explode(kept).alias("s")).select("doc_id", "chunk_idx", "s.start", "s.stop", "s.color")


def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chapter with the end of that before and the start of that after (fixed values: their lengths)."""
    w = W.partitionBy("doc_id").orderBy("chapter_idx")
    c = keywords.chapters(spark, sf_dir)
    c = c.select("doc_id", "chapter_idx", F.coalesce(F.right(F.lag("text").over(w), F.lit(1200)), F.lit("")).alias("before"), F.left("text", F.lit(7500)).alias("here"), F.coalesce(F.left(F.lead("text").over(w), F.lit(900)), F.lit("")).alias("after"))
    return c.select("doc_id", "chapter_idx", F.concat_ws("\n\n", "before", F.concat(F.lit("## Chapter "), F.col("chapter_idx") + 1), "here", "after").alias("context"), (F.length("here") == 7500).alias("full"))


def whole_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapters of a document under their titles, up to WHOLE_CONTEXT characters, and whether that cut them short."""
    part = F.concat(F.lit("## Chapter "), F.col("chapter_idx") + 1, F.lit("\n\n"), F.col("text"))
    c = keywords.chapters(spark, sf_dir).select("doc_id", F.struct("chapter_idx", part.alias("text")).alias("c"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x["text"]), "\n\n").alias("body")
    return c.groupBy("doc_id").agg(body).select("doc_id", F.left("body", F.lit(WHOLE_CONTEXT)).alias("context"), (F.length("body") > WHOLE_CONTEXT).alias("truncated"))


def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six turns before each user's turn, whole; a conversation's last CHAT_KEPT turns are all there are."""
    c = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant') and text <> ''")
    c = c.withColumn("back", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("back") <= CHAT_KEPT)
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-6, -1)
    h = c.select("conv_id", "turn", "role", F.collect_list(F.concat(F.col("role"), F.lit(": "), F.col("text"))).over(w).alias("turns"))
    return h.where("role = 'user'").select("conv_id", "turn", F.array_join("turns", "\n").alias("history"))


QUERIES = {f.__name__: f for f in (passage_search, retrieve_passage, source_passage, chapter_at_chunk, bookmark_text, anchor_quote, annotation_spans, context_pack, whole_context, chat_history)}
_ANN = "SELECT doc_id, chunk_idx, a AS start, b AS stop, a % 4 AS color FROM passages, (VALUES (0, 20), (10, 30), (20, 33), (35, 50), (49, 60)) AS s(a, b) WHERE length(text) >= 60"
_CH = "SELECT doc_id, chapter_idx, string_agg(text, chr(10) || chr(10) ORDER BY chunk_idx) AS text FROM passages GROUP BY doc_id, chapter_idx"
ORACLES = {
    "passage_search": with_views(
        f"""SELECT doc_id, chunk_idx, substring(text, greatest(1, hit - {SNIPPET_BEFORE}), hit + {len(NEEDLE) + SNIPPET_AFTER} - greatest(1, hit - {SNIPPET_BEFORE})) AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS r FROM (SELECT *, instr(lower(text), '{NEEDLE}') AS hit FROM passages) WHERE hit > 0) WHERE r <= {HITS}"""
    ),
    "retrieve_passage": with_views(
        f"""WITH q AS (SELECT DISTINCT conv_id, turn, doc_id, word FROM (SELECT conv_id, turn, conv_id % (SELECT count(*) FROM documents) AS doc_id, unnest({T.sql_tokens("text")}) AS word FROM asked) WHERE length(word) > 3 AND word NOT IN ({sql_list(STOP_WORDS)})),
t AS (SELECT doc_id, chunk_idx, unnest({T.sql_tokens("text")}) AS word FROM passages)
SELECT conv_id, turn, doc_id, chunk_idx, score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, chunk_idx) AS r FROM (SELECT conv_id, turn, doc_id, chunk_idx, count(*) AS score FROM q JOIN t USING (doc_id, word) GROUP BY ALL)) WHERE r = 1""",
        asked=scalars._ASKED,
    ),
    "source_passage": with_views(
        """SELECT doc_id, chapter_idx, arg_max(chunk_idx, score * 1000 - local_idx / 1000) AS chunk_idx, max(score) AS score FROM (SELECT doc_id, chapter_idx, chunk_idx, local_idx, round(len(list_filter(ws, lambda w: contains(lower(text), w))) - 0.01 * local_idx, 6)::DOUBLE AS score FROM passages JOIN (
SELECT doc_id, chapter_idx, list_filter(list_transform(range(len(k)), lambda i: CASE WHEN list_position(k, k[i + 1]) = i + 1 THEN k[i + 1] END), lambda x: x IS NOT NULL)[1:24] AS ws FROM (
SELECT doc_id, chapter_idx, list_filter(regexp_split_to_array(lower(arg_max(text, chunk_idx)), '[^a-z0-9_]+'), lambda w: length(w) > 4) AS k FROM passages GROUP BY doc_id, chapter_idx)) USING (doc_id, chapter_idx)) GROUP BY doc_id, chapter_idx"""
    ),
    "chapter_at_chunk": with_views(
        """SELECT doc_id, chunk, coalesce(c.chapter_idx, m) AS chapter_idx, coalesce(chunk - c.start, 0) AS local_idx FROM (SELECT DISTINCT doc_id, unnest([0, doc_id % 11, 9999]) AS chunk FROM documents) w JOIN (SELECT doc_id, max(chapter_idx) AS m FROM passages GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, chapter_idx, min(chunk_idx) AS start, count(*) AS n FROM passages GROUP BY ALL) c USING (doc_id) WHERE (c.chapter_idx IS NULL) OR (chunk >= c.start AND chunk < c.start + c.n)
UNION ALL SELECT doc_id, chunk, m, 0 FROM (SELECT DISTINCT doc_id, unnest([0, doc_id % 11, 9999]) AS chunk FROM documents) JOIN (SELECT doc_id, max(chapter_idx) AS m, count(*) AS n FROM passages GROUP BY doc_id) USING (doc_id) WHERE chunk >= n"""
    ),
    "bookmark_text": with_views("SELECT doc_id, chunk_idx, label, text FROM (SELECT doc_id, (doc_id * 7 % 12)::INT AS chunk_idx, 'b' || doc_id AS label FROM documents WHERE doc_id % 2 = 0) LEFT JOIN (SELECT doc_id, chunk_idx, text FROM passages) USING (doc_id, chunk_idx)"),
    "anchor_quote": with_views(
        "SELECT doc_id, chunk_idx, (instr(text, q) - 1)::INT AS start, (instr(text, q) - 1 + length(q))::INT AS stop FROM (SELECT doc_id, chunk_idx, text, substring(text, 11, doc_id % 30) AS q FROM passages) WHERE length(q) BETWEEN 2 AND 400"
    ),
    "annotation_spans": with_views(
        """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_idx ORDER BY start, stop) AS k FROM ann),
f AS (SELECT doc_id, chunk_idx, start, stop, color, k, stop AS last, true AS kept FROM o WHERE k = 1
UNION ALL SELECT o.doc_id, o.chunk_idx, o.start, o.stop, o.color, o.k, CASE WHEN o.start >= f.last THEN o.stop ELSE f.last END, o.start >= f.last FROM f JOIN o ON o.doc_id = f.doc_id AND o.chunk_idx = f.chunk_idx AND o.k = f.k + 1)
SELECT doc_id, chunk_idx, start, stop, color FROM f WHERE kept""", ann=_ANN
    ),
    "context_pack": with_views(
        """SELECT doc_id, chapter_idx, coalesce(right(lag(text) OVER w, 1200), '') || chr(10) || chr(10) || '## Chapter ' || (chapter_idx + 1) || chr(10) || chr(10) || text[1:7500] || chr(10) || chr(10) || coalesce(lead(text) OVER w, '')[1:900] AS context, length(text) >= 7500 AS full
FROM chap WINDOW w AS (PARTITION BY doc_id ORDER BY chapter_idx)""", chap=_CH
    ),
    "chat_history": f"""SELECT conv_id, turn, coalesce(h, '') AS history FROM (SELECT conv_id, turn, role, string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS h FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant') AND text <> '') WHERE back <= {CHAT_KEPT}) WHERE role = 'user'""",
    "whole_context": with_views(f"SELECT doc_id, body[1:{WHOLE_CONTEXT}] AS context, length(body) > {WHOLE_CONTEXT} AS truncated FROM (SELECT doc_id, string_agg('## Chapter ' || (chapter_idx + 1) || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY chapter_idx) AS body FROM chap GROUP BY doc_id)", chap=_CH),
}
