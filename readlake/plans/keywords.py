"""Tokens, term frequencies and what is drawn from them: keywords, vocabulary, sentences, summaries, names, themes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readlake.functions import text as T
from readlake.params import ARTICLES, NEVER_NAMES, SPEECH_VERBS, STOP_WORDS, sql_list
from readlake.sources.shared import materialize
from readlake.sources.tables import dealt, passages_of, table, with_views

KEYWORDS, SUMMARY, NAMES, THEMES, VOCABULARY = 12, 5, 6, 4, 7


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def with_sentences(docs: DataFrame) -> DataFrame:
    """doc_id, text and its sentences ``s``, worked out once for queries of several parts."""
    return materialize(dealt(docs, "doc_id").select("doc_id", "text", T.sentences(F.col("text")).alias("s")), "sentences")


def _sentences_of(docs: DataFrame) -> Column:
    return F.col("s") if "s" in docs.columns else T.sentences(F.col("text"))


def token_rows(docs: DataFrame) -> DataFrame:
    """doc_id, pos, word.

    Outer, as Spark else infers a filter on the array's size and works the expression out again for it (so below).
    """
    return docs.select("doc_id", F.posexplode_outer(T.tokens(F.col("text"))).alias("pos", "word")).where("pos is not null")


def term_freqs(docs: DataFrame) -> DataFrame:
    """doc_id, word, tf, first_pos of content words; texts are dealt once and their words counted where they are."""
    rows = token_rows(dealt(docs.select("doc_id", "text"), "doc_id")).where(T.is_content_word(F.col("word")))
    return rows.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("tf"), F.min("pos").alias("first_pos"))


def ranked(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def keyword_rows(docs: DataFrame, n: int = KEYWORDS) -> DataFrame:
    return ranked(term_freqs(docs), ["doc_id"], [F.desc("tf"), "first_pos"], n)


def sentence_arrays(docs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, s: the sentences of each text, in order.  Texts are dealt by their keys first, which later steps rely on."""
    keys = keys or ["doc_id"]
    held = docs.select(*keys, "s" if "s" in docs.columns else "text")
    return dealt(held, *keys).select(*keys, _sentences_of(held).alias("s"))


def sentence_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, idx, sentence."""
    return docs.select(key, F.posexplode_outer(T.sentences(F.col("text"))).alias("idx", "sentence")).where("idx is not null")


def position_bonus(idx: Column, n: Column) -> Column:
    return F.when(idx < 2, 0.4).when(idx < 4, 0.2).when(idx > n - 2, 0.15).otherwise(0.0)


def summaries(texts: DataFrame, keys: list[str], n: int) -> DataFrame:
    """keys, summary: the n best sentences (by their words' frequency within the key, length and place) in order.

    ``texts``: one row per key with its sentences ``s``, dealt by the keys: words are counted and weighed, and sentences
    ranked and looked up, where they are.
    """
    rows = texts.select(*keys, F.size("s").alias("n"), F.posexplode_outer("s").alias("idx", "sentence")).where("idx is not null")
    # a sentence without words that count has a row with none
    words = rows.select(*keys, "n", "idx", F.explode_outer(F.filter(T.tokens(F.col("sentence")), T.is_content_word)).alias("word"))
    words = words.withColumn("tf", F.count("word").over(W.partitionBy(*keys, "word")))
    dense = words.groupBy(*keys, "n", "idx").agg(F.sum("tf").alias("density"), F.count("word").alias("words"))
    score = F.round(F.col("density") / F.pow(F.col("words") + 3.0, F.lit(0.62)) + position_bonus(F.col("idx"), F.col("n")), 9)
    best = ranked(dense.withColumn("score", score), keys, [F.desc("score"), "idx"], n).groupBy(*keys).agg(F.sort_array(F.collect_list("idx")).alias("at"))
    return best.join(texts, keys).select(*keys, F.array_join(F.transform("at", lambda i: F.get("s", i)), " ").alias("summary"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document: how many, how many different, and the longest."""
    return token_rows(dealt(documents(spark, sf_dir), "doc_id")).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("word").alias("types"), F.max(F.length("word")).alias("longest")
    )


def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_freqs(documents(spark, sf_dir))


def top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's most frequent content words, the first to occur first among equals."""
    return keyword_rows(documents(spark, sf_dir)).select("doc_id", "rank", "word", "tf")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_rows(documents(spark, sf_dir))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(sentence_arrays(documents(spark, sf_dir)), ["doc_id"], SUMMARY)


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters_of(documents(spark, sf_dir))


def chapters_of(docs: DataFrame) -> DataFrame:
    """doc_id, chapter_idx, text of derived passages."""
    p = passages_of(docs).groupBy("doc_id", "chapter_idx").agg(F.sort_array(F.collect_list(F.struct("chunk_idx", "text"))).alias("ps"))
    return p.select("doc_id", "chapter_idx", F.array_join("ps.text", "\n\n").alias("text"))


def arc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for each chapter, and two for the whole document (chapter -1)."""
    c = chapters(spark, sf_dir)
    one = summaries(sentence_arrays(c, ["doc_id", "chapter_idx"]), ["doc_id", "chapter_idx"], 1)
    two = summaries(sentence_arrays(documents(spark, sf_dir)), ["doc_id"], 2)
    return one.unionByName(two.withColumn("chapter_idx", F.lit(-1)))


def themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first keywords with the best one of the sentences that contain them."""
    docs = documents(spark, sf_dir)
    kw = keyword_rows(docs, THEMES).select("doc_id", "word", "rank")
    held = F.filter("s", lambda x: F.contains(F.lower(x), F.col("word")))
    hits = dealt(sentence_arrays(docs).join(kw, "doc_id").select("doc_id", F.col("rank").alias("place"), held.alias("s")), "doc_id", "place")
    note = summaries(hits, ["doc_id", "place"], 1)
    return kw.join(note.withColumnRenamed("place", "rank"), ["doc_id", "rank"], "left").select("doc_id", "rank", T.capitalised(F.col("word")).alias("name"), F.coalesce("summary", F.lit("")).alias("note"))


def theme_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each of a document's first keywords: occurrences, chapters that hold it and the strongest one."""
    kw = keyword_rows(documents(spark, sf_dir), THEMES).select("doc_id", "word", "rank")
    c = chapters(spark, sf_dir).join(kw, "doc_id").withColumn("n", T.occurrences(F.lower("text"), F.col("word")))
    return c.groupBy("doc_id", "word").agg(
        F.sum("n").alias("hits"), F.count_if(F.col("n") > 0).alias("chapters"), F.min_by("chapter_idx", F.struct(-F.col("n"), "chapter_idx")).alias("strongest")
    )


def vocabulary_rows(docs: DataFrame, n: int = VOCABULARY) -> DataFrame:
    """doc_id, rank, term, context: long rare words, longest first, with the first sentence that holds each."""
    rare = ranked(term_freqs(docs).where("length(word) >= 7 and tf <= 4"), ["doc_id"], [F.desc(F.length("word")), "first_pos"], n).select("doc_id", "rank", F.col("word").alias("term"))
    held = F.filter("s", lambda x: F.contains(F.lower(x), F.col("term")))
    return rare.join(sentence_arrays(docs), "doc_id").select("doc_id", "rank", "term", F.coalesce(F.get(held, F.lit(0)), F.lit("")).alias("context"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary_rows(documents(spark, sf_dir))


CAPITAL = r"^[\"'“”‘’(\[]*[A-Z]"  # what a word begins with whose clean form may be a name
STRIP_LEFT, STRIP_RIGHT, NAME = r"^[\"'“”‘’(\[]+", r"[\"'“”’),.!?;:]+$", r"^[A-Z][\p{L}'’-]{1,20}$"


def capital_words(ws: Column) -> Column:
    """k, clean, prev, next of the words of a sentence that may be names; only these, and those beside them, are cleaned."""
    clean = lambda x: F.regexp_replace(F.regexp_replace(x, STRIP_LEFT, ""), STRIP_RIGHT, "")
    near = lambda k: F.lower(clean(F.get(ws, k)))
    beside = F.transform(ws, lambda c, k: F.when(c.rlike(CAPITAL), F.struct(k.alias("k"), clean(c).alias("clean"), near(k - 1).alias("prev"), near(k + 1).alias("next"))))
    return F.filter(beside, lambda x: x["clean"].rlike(NAME))


def beside_verb(prev: Column, following: Column) -> Column:
    return F.coalesce(prev.isin(*SPEECH_VERBS), F.lit(False)) | F.coalesce(following.isin(*SPEECH_VERBS), F.lit(False))


def may_be_name(clean: Column, prev: Column) -> Column:
    return ~clean.isin(*NEVER_NAMES) & ~F.coalesce(prev.isin(*ARTICLES), F.lit(False))


def name_rows(docs: DataFrame, n: int = NAMES) -> DataFrame:
    """doc_id, rank, name, note: capitalised words that aren't common ones, by weight (double beside a speech verb)."""
    base = dealt(docs, "doc_id").select("doc_id", "text", _sentences_of(docs).alias("s"))
    words = base.select("doc_id", F.posexplode_outer("s").alias("idx", "sentence")).where("idx is not null").select("doc_id", "idx", F.split("sentence", T.SPACES).alias("ws"))
    caps = words.select("doc_id", "idx", F.explode_outer(capital_words(F.col("ws"))).alias("x")).where("x is not null").select("doc_id", F.lower("x.clean").alias("lower"), "idx", "x.k", "x.clean", "x.prev", "x.next")
    every = base.select("doc_id", F.explode_outer(T.tokens(F.col("text"))).alias("lower")).where("lower is not null").groupBy("doc_id", "lower").agg(F.count(F.lit(1)).alias("every"))
    every = every.where("every > 1")  # what occurs once doesn't matter below, and isn't shuffled
    both = caps.join(every, ["doc_id", "lower"], "left").withColumn("caps", F.count(F.lit(1)).over(W.partitionBy("doc_id", "lower")))
    verb = beside_verb(F.col("prev"), F.col("next"))
    kept = both.where(~((F.coalesce("every", F.lit(0)) - F.col("caps") >= 1) & (F.col("caps") <= 1)))
    kept = kept.where(may_be_name(F.col("clean"), F.col("prev")))
    totals = kept.groupBy("doc_id", F.col("clean").alias("name")).agg(F.sum(F.when(verb, 2).otherwise(1)).alias("weight"), F.min(F.struct("idx", "k")).alias("first"))
    best = ranked(totals.where("weight >= 2"), ["doc_id"], [F.desc("weight"), "first.idx", "first.k"], n)
    return best.join(base.select("doc_id", "s"), "doc_id").select("doc_id", "rank", "name", "weight", F.get("s", F.col("first.idx")).alias("note"))


def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_rows(documents(spark, sf_dir))


def flashcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four words and three names of each document as front and back."""
    docs = documents(spark, sf_dir)
    v = vocabulary_rows(docs, 4).select("doc_id", F.lit("word").alias("kind"), "rank", F.col("term").alias("front"), F.col("context").alias("back"))
    c = name_rows(docs, 3).select("doc_id", F.lit("name").alias("kind"), "rank", F.col("name").alias("front"), F.col("note").alias("back"))
    return v.unionByName(c)


def _listed(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("rank", F.col(col).alias("v"))))["v"], "; ").alias(col))


def study_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary, keywords, words and names of each document in one row."""
    docs = with_sentences(documents(spark, sf_dir))
    out = docs.select("doc_id").join(summaries(sentence_arrays(docs), ["doc_id"], 3), "doc_id", "left")
    for part, col in ((keyword_rows(docs, 6), "word"), (vocabulary_rows(docs), "term"), (name_rows(docs), "name")):
        out = out.join(_listed(part, col), "doc_id", "left")
    return out.select("doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("summary", "word", "term", "name")])


_STOP = sql_list(STOP_WORDS)
_CONTENT = f"length(word) >= 3 AND word NOT IN ({_STOP})"
_V = {
    "toks": f"SELECT doc_id, unnest(range(len({T.sql_tokens('text')})))::INT AS pos, unnest({T.sql_tokens('text')}) AS word FROM documents",
    "tf": f"SELECT doc_id, word, count(*) AS tf, min(pos) AS first_pos FROM toks WHERE {_CONTENT} GROUP BY doc_id, word",
    "sents": f"SELECT doc_id, unnest(range(len(s)))::INT AS idx, unnest(s) AS sentence FROM (SELECT doc_id, {T.sql_sentences('text')} AS s FROM documents)",
    "chaps": "SELECT doc_id, chapter_idx, string_agg(text, chr(10) || chr(10) ORDER BY chunk_idx) AS text FROM passages GROUP BY doc_id, chapter_idx",
    "csents": f"SELECT doc_id, chapter_idx, unnest(range(len(s)))::INT AS idx, unnest(s) AS sentence FROM (SELECT doc_id, chapter_idx, {T.sql_sentences('text')} AS s FROM chaps)",
    "kw": "SELECT doc_id, word, tf, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, first_pos) AS rank FROM tf",
    "rare": "SELECT doc_id, word AS term, row_number() OVER (PARTITION BY doc_id ORDER BY length(word) DESC, first_pos) AS rank FROM tf WHERE length(word) >= 7 AND tf <= 4",
    "vocab": """SELECT r.doc_id, r.rank, r.term, coalesce((SELECT arg_min(sentence, idx) FROM sents s WHERE s.doc_id = r.doc_id AND contains(lower(sentence), r.term)), '') AS context FROM rare r WHERE r.rank <= 7""",
    "ntoks": "SELECT doc_id, idx, sentence, unnest(range(len(p))) AS k, regexp_replace(regexp_replace(unnest(p), '"
    + STRIP_LEFT.replace("'", "''")
    + "', ''), '"
    + STRIP_RIGHT.replace("'", "''")
    + "', '') AS clean FROM (SELECT *, regexp_split_to_array(sentence, '[ \\t\\n\\v\\f\\r]+') AS p FROM sents)",
    "near": "SELECT *, lower(lag(clean) OVER w) AS prev, lower(lead(clean) OVER w) AS next FROM ntoks WINDOW w AS (PARTITION BY doc_id, idx ORDER BY k)",
    "caps": f"SELECT *, lower(clean) AS low FROM near WHERE regexp_matches(clean, '{NAME.replace(chr(39), chr(39) * 2)}')",
    "common": "SELECT doc_id, low FROM (SELECT doc_id, low, count(*) AS c FROM caps GROUP BY ALL) LEFT JOIN (SELECT doc_id, word AS low, count(*) AS every FROM toks GROUP BY ALL) USING (doc_id, low) WHERE coalesce(every, 0) - c >= 1 AND c <= 1",
    "named": f"""SELECT doc_id, clean AS name, sum(CASE WHEN prev IN ({sql_list(SPEECH_VERBS)}) OR next IN ({sql_list(SPEECH_VERBS)}) THEN 2 ELSE 1 END)::BIGINT AS weight, min(idx * 100000 + k) AS first, arg_min(sentence, idx * 100000 + k) AS note
FROM caps WHERE clean NOT IN ({sql_list(NEVER_NAMES)}) AND coalesce(prev NOT IN ({sql_list(ARTICLES)}), true) AND (doc_id, low) NOT IN (SELECT (doc_id, low) FROM common) GROUP BY doc_id, clean""",
    "names": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, first) AS rank FROM named WHERE weight >= 2) WHERE rank <= 6",
}


def sql_summary(source: str, keys: str, n: int) -> str:
    """The summaries of rows (keys, idx, sentence) of a view."""
    join = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""(SELECT {keys}, string_agg(sentence, ' ' ORDER BY idx) AS summary FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, idx) AS r FROM (
    SELECT {", ".join("s." + k.strip() for k in keys.split(","))}, s.idx, s.sentence, round(coalesce(density, 0) / pow(coalesce(words, 0) + 3.0, 0.62)
      + CASE WHEN s.idx < 2 THEN 0.4 WHEN s.idx < 4 THEN 0.2 WHEN s.idx > n - 2 THEN 0.15 ELSE 0 END, 9) AS score
    FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}) s LEFT JOIN (
      WITH w AS (SELECT {keys}, idx, unnest({T.sql_tokens("sentence")}) AS word FROM {source}), c AS (SELECT * FROM w WHERE {_CONTENT})
      SELECT {", ".join("a." + k.strip() for k in keys.split(","))}, a.idx, sum(tf) AS density, count(*) AS words FROM c a JOIN (SELECT {keys}, word, count(*) AS tf FROM c GROUP BY ALL) b ON {join} AND a.word = b.word GROUP BY ALL
    ) d ON {" AND ".join(f"s.{k.strip()} = d.{k.strip()}" for k in keys.split(","))} AND s.idx = d.idx)) WHERE r <= {n} GROUP BY {keys})"""


QUERIES = {
    f.__name__: f
    for f in (tokens, term_freq, top_keywords, sentences, summary, arc_summary, themes, theme_distribution, vocabulary, characters, flashcards, study_set)
}
_HITS = """(SELECT doc_id, rank AS place, (row_number() OVER (PARTITION BY doc_id, rank ORDER BY idx) - 1)::INT AS idx, sentence FROM sents JOIN kw USING (doc_id) WHERE rank <= 4 AND contains(lower(sentence), word))"""
_V["hits"] = _HITS[1:-1]
ORACLES = {
    "tokens": with_views("SELECT doc_id, count(*) AS n, count(DISTINCT word) AS types, max(length(word))::INT AS longest FROM toks GROUP BY doc_id", **_V),
    "term_freq": with_views("SELECT doc_id, word, tf, first_pos FROM tf", **_V),
    "top_keywords": with_views("SELECT doc_id, rank, word, tf FROM kw WHERE rank <= 12", **_V),
    "sentences": with_views("SELECT doc_id, idx, sentence FROM sents", **_V),
    "summary": with_views(f"SELECT doc_id, summary FROM {sql_summary('sents', 'doc_id', SUMMARY)}", **_V),
    "arc_summary": with_views(
        f"SELECT doc_id, chapter_idx, summary FROM {sql_summary('csents', 'doc_id, chapter_idx', 1)} UNION ALL SELECT doc_id, -1, summary FROM {sql_summary('sents', 'doc_id', 2)}", **_V
    ),
    "themes": with_views(
        f"""SELECT k.doc_id, k.rank, upper(word[1]) || lower(word[2:]) AS name, coalesce(summary, '') AS note FROM kw k LEFT JOIN {sql_summary("hits", "doc_id, place", 1)} n ON k.doc_id = n.doc_id AND k.rank = n.place WHERE k.rank <= 4""", **_V
    ),
    "theme_distribution": with_views(
        """SELECT doc_id, word, sum(n)::BIGINT AS hits, count(*) FILTER (n > 0) AS chapters, arg_min(chapter_idx, -n * 100000 + chapter_idx) AS strongest FROM (
SELECT doc_id, word, chapter_idx, (length(text) - length(replace(lower(text), word, ''))) // length(word) AS n FROM chaps JOIN kw USING (doc_id) WHERE rank <= 4) GROUP BY doc_id, word""", **_V
    ),
    "vocabulary": with_views("SELECT doc_id, rank, term, context FROM vocab", **_V),
    "characters": with_views("SELECT doc_id, rank, name, weight, note FROM names", **_V),
    "flashcards": with_views("SELECT doc_id, 'word' AS kind, rank, term AS front, context AS back FROM vocab WHERE rank <= 4 UNION ALL SELECT doc_id, 'name', rank, name, note FROM names WHERE rank <= 3", **_V),
    "study_set": with_views(
        f"""SELECT d.doc_id, coalesce(summary, '') AS summary, coalesce(k.v, '') AS word, coalesce(t.v, '') AS term, coalesce(c.v, '') AS name FROM documents d
LEFT JOIN {sql_summary("sents", "doc_id", 3)} s ON s.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, string_agg(word, '; ' ORDER BY rank) AS v FROM kw WHERE rank <= 6 GROUP BY doc_id) k ON k.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, string_agg(term, '; ' ORDER BY rank) AS v FROM vocab GROUP BY doc_id) t ON t.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, string_agg(name, '; ' ORDER BY rank) AS v FROM names GROUP BY doc_id) c ON c.doc_id = d.doc_id""", **_V
    ),
}
