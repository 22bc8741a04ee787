"""Study material: scenes, titles, quizzes and a document's analysis."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readlake.functions import text as T
from readlake.params import ROMAN, STOP_WORDS, sql_list
from readlake.plans import keywords as K
from readlake.plans import scalars
from readlake.sources.tables import dealt, table, with_views

QUIZ = 6
SUBTITLES = ("beginning", "rise", "middle", "fall", "close")


CAST, LEAST_QUOTE, LONGEST_QUOTE = 4, 6, 180  # names of a scene; characters of a quote
NOBODY = ("A reader", "A room")  # who plays where a chapter names nobody


CHAPTER = ["doc_id", "chapter_idx"]


def chapter_scenes(c: DataFrame) -> DataFrame:
    """doc_id, chapter_idx, scene, name: what a chapter's scenes say in one row of it, and in others what may name somebody, by weight.

    Sentences are cut once: the capitalised words are counted as rows of their own, the first of which takes the scenes along.
    A name counts double beside a speech verb, and has to be met twice or to speak; ``once`` is a word capitalised but once.
    """
    quotes = F.transform(F.regexp_extract_all("text", F.lit(f'[“"]([^”"\\n]{{{LEAST_QUOTE},{LONGEST_QUOTE}}})[”"]'), F.lit(1)), lambda q: F.trim(q))  # (a bare trim would take the index as what to trim)
    scenes = F.greatest(F.lit(2), F.least(F.lit(5), F.ceil(F.length("text") / 2500))).cast("int")
    c = c.select(*CHAPTER, quotes.alias("quotes"), scenes.alias("scenes"), T.sentences(F.col("text")).alias("s"), scalars.cue_hits(F.lower("text")).alias("hits"))
    c = c.withColumn("n", F.least(F.size("s"), 12 * F.col("scenes")))
    c = c.withColumn("size", F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("scenes")).cast("int")))
    slices = F.filter(F.expr("transform(sequence(0, scenes - 1), i -> slice(s, i * size + 1, least(size, greatest(0, n - i * size))))"), lambda p: F.size(p) > 0)
    word = lambda i, x: F.struct(i.alias("idx"), x["k"].alias("k"), x["clean"].alias("clean"), F.when(K.may_be_name(x["clean"], x["prev"]), F.when(K.beside_verb(x["prev"], x["next"]), 2).otherwise(1)).alias("weight"))
    caps = F.transform("s", lambda sentence, i: F.get(F.transform(F.array(F.split(sentence, T.SPACES)), lambda ws: F.transform(K.capital_words(ws), lambda x: word(i, x))), F.lit(0)))
    c = c.withColumn("slices", slices).withColumn("caps", F.flatten(caps))
    middle = F.get("slices", F.floor(F.size("slices") / 2).cast("int"))
    c = c.withColumn("middle", scalars.cue_hits(F.lower(F.array_join(middle, " "))))
    whole, own = (F.concat_ws(" / ", *scalars.mood_of(F.col(hits))) for hits in ("hits", "middle"))
    closing = lambda p: F.when(F.size(p) > 2, F.element_at(p, -1)).otherwise("")
    parts = F.transform("slices", lambda p: F.struct(F.size(p).alias("sentences"), F.element_at(p, 1).alias("opening"), closing(p).alias("closing")))
    c = c.select(*CHAPTER, F.struct("quotes", whole.alias("whole"), own.alias("own"), parts.alias("parts")).alias("scene"), "caps")
    c = c.select(*CHAPTER, "scene", F.posexplode_outer("caps").alias("pos", "x"))
    at = F.when(F.col("x.weight").isNotNull(), F.shiftleft(F.col("x.idx").cast("long"), 32) + F.col("x.k"))
    c = c.select(*CHAPTER, F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("scene")).alias("scene"), F.lower("x.clean").alias("lower"), F.col("x.clean").alias("name"), "x.weight", at.alias("at"))
    c = c.groupBy(*CHAPTER, "lower", "name").agg(F.first("scene", True).alias("scene"), F.count("name").alias("n"), F.sum("weight").alias("weight"), F.min("at").alias("at"))
    c = c.withColumn("once", F.sum("n").over(W.partitionBy(*CHAPTER, "lower")) == 1).where("weight >= 2 or scene is not null")
    return c.select(*CHAPTER, "scene", F.when(F.col("weight") >= 2, F.struct(-F.col("weight"), "at", "name", "once")).alias("name"))


def chapter_words(c: DataFrame) -> DataFrame:
    """doc_id, chapter_idx, first, word, tf, pos: the words that a chapter says more than once, and its first that counts.

    A word that is said once is the keyword only if it is the first of all, so that few words are left to choose from.
    """
    c = c.select(*CHAPTER, T.tokens(F.col("text")).alias("t"))
    first = F.coalesce(*[F.get(F.filter(t, T.is_content_word), F.lit(0)) for t in (F.slice("t", 1, 32), F.col("t"))])
    c = c.select(*CHAPTER, first.alias("first"), "t").select(*CHAPTER, "first", F.posexplode_outer("t").alias("pos", "word"))  # (beside a generator all else is worked out for each of its rows)
    return c.groupBy(*CHAPTER, "first", "word").agg(F.count("word").alias("tf"), F.min("pos").alias("pos")).where("tf > 1 or word = first")


def scene_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chapter's first sentences in two to five equal slices, with title, mood, cast, a quote, opening and closing sentence.

    The mood and the cast are the chapter's, but for the middle scene: it has its own mood, and the first two names.
    Quotes go round; a chapter with none has none. Texts are dealt once by their documents, and all else is worked out
    where they are; documents without an id are in no row of the SQL.
    """
    c = K.chapters_of(dealt(K.documents(spark, sf_dir).where("doc_id is not null"), "doc_id"))
    # both are held by documents, and so is their union: a join by chapters would shuffle them again
    c = chapter_scenes(c).unionByName(chapter_words(c), allowMissingColumns=True)
    often = F.when(F.col("tf") > 1, F.col("word"))
    best = F.max_by("word", F.when(T.is_content_word(often), F.struct("tf", -F.col("pos"))))
    seed = F.coalesce(best, F.first("first", True))
    c = c.groupBy(*CHAPTER).agg(F.first("scene", True).alias("scene"), F.sort_array(F.collect_list("name")).alias("names"), seed.alias("seed"), F.collect_list(often).alias("often"))
    # a word that is capitalised but once, and in small letters elsewhere, is no name
    named = F.filter("names", lambda x: ~(x["once"] & F.array_contains("often", F.lower(x["name"]))))
    c = c.select(*CHAPTER, "scene.*", "seed", F.slice(named, 1, CAST)["name"].alias("names"))
    rows = c.select("*", F.size("parts").alias("count"), F.posexplode_outer("parts").alias("ordinal", "part")).where("ordinal is not null")
    middle, names = F.col("ordinal") == F.floor(F.col("count") / 2), F.when(F.size("names") > 0, F.col("names"))
    cast = F.coalesce(names, F.array(*map(F.lit, NOBODY)))
    title = F.concat(F.coalesce(F.concat(F.lit("The "), T.capitalised(F.col("seed"))), F.lit("Chapter")), F.lit(" — "), F.element_at(F.array(*map(F.lit, SUBTITLES)), F.col("ordinal") + 1))
    quote = F.when(F.size("quotes") > 0, F.get("quotes", F.col("ordinal") % F.size("quotes")))
    speaker = F.when(quote.isNotNull() & names.isNotNull(), F.get("names", F.col("ordinal") % F.size("names")))
    return rows.select(
        *CHAPTER, "ordinal", title.alias("title"), "part.sentences", "part.opening", "part.closing", F.when(middle, F.col("own")).otherwise(F.col("whole")).alias("mood"),
        F.array_join(F.when(middle, F.slice(cast, 1, 2)).otherwise(cast), "; ").alias("cast"), quote.alias("quote"), speaker.alias("speaker"),
    )


def dedupe_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second and later titles of a document that say the same get a roman number."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.capitalised(F.col("role")).alias("title"))
    n = F.row_number().over(W.partitionBy("conv_id", F.lower(F.trim("title"))).orderBy("turn"))
    base = F.trim(F.regexp_replace("title", " +— +[IVXLC]+$", ""))
    return t.withColumn("n", n).select("conv_id", "turn", F.when(F.col("n") > 1, F.concat(base, F.lit(" — "), T.roman(F.col("n")))).otherwise(F.col("title")).alias("title"))


def cloze_quiz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to QUIZ gapped sentences of each document: the word left out, and three words of like length beside it.

    A word is asked for once: sentences are folded in order, each taking its first candidate not yet used.
    Distractors are words occurring 2 to 12 times with lengths within two of the answer's, in the order of a
    hash, so that runs agree.  Answers meet the words of their own bands of length only, and each keeps its first
    three on the way to the shuffle.
    """
    docs = K.documents(spark, sf_dir)
    sents = K.sentence_rows(docs).where((F.size(T.tokens(F.col("sentence"))) >= 6) & (F.length("sentence") < 280))
    words = F.split("sentence", T.SPACES)
    cand = sents.select("doc_id", "idx", "sentence", F.size(words).alias("n"), F.posexplode(words).alias("k", "raw")).where("k > 0 and k < n - 1")
    cand = cand.withColumn("clean", F.regexp_replace(F.lower("raw"), "[^a-z']", "")).where((F.length("clean") >= 5) & ~F.col("clean").isin(*STOP_WORDS))
    tf = K.term_freqs(docs)
    cand = cand.join(tf.select("doc_id", F.col("word").alias("clean")), ["doc_id", "clean"], "left_semi")
    per = cand.groupBy("doc_id", "idx").agg(F.sort_array(F.collect_list(F.struct("k", "clean")))["clean"].alias("cs"))
    per = per.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "cs"))).alias("ss"))
    fold = F.expr(
        """aggregate(ss, named_struct('used', cast(array() as array<string>), 'out', cast(array() as array<struct<idx:int,clean:string>>)),
          (a, s) -> named_struct('used', concat(a.used, slice(array_except(s.cs, a.used), 1, 1)),
             'out', concat(a.out, transform(slice(array_except(s.cs, a.used), 1, 1), c -> named_struct('idx', s.idx, 'clean', c)))), a -> a.out)"""
    )
    asked = per.select("doc_id", F.explode(fold).alias("q")).select("doc_id", "q.idx", F.col("q.clean").alias("answer"))
    pool = tf.where("tf between 2 and 12").select("doc_id", "word", F.length("word").alias("band"))
    bands = asked.select("*", F.explode(F.sequence(F.length("answer") - 2, F.length("answer") + 2)).alias("band"))
    pairs = bands.join(pool, ["doc_id", "band"]).where(F.col("word") != F.col("answer"))
    order = F.row_number().over(W.partitionBy("doc_id", "idx").orderBy(F.md5(F.concat("word", F.lit("/"), "answer")), "word"))
    wrong = pairs.withColumn("r", order).where("r <= 3").groupBy("doc_id", "idx", "answer").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list(F.struct("r", "word")))["word"], "; ").alias("distractors"))
    full = wrong.where("n = 3").withColumn("ordinal", F.row_number().over(W.partitionBy("doc_id").orderBy("idx")))
    return full.where(F.col("ordinal") <= QUIZ).select("doc_id", "ordinal", "idx", "answer", "distractors")


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary, first theme, number of names and mood of each document."""
    docs = K.with_sentences(K.documents(spark, sf_dir))
    s = K.summaries(K.sentence_arrays(docs), ["doc_id"], 4)
    top = K.keyword_rows(docs, 1).select("doc_id", F.col("word").alias("theme"))
    names = K.name_rows(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("names"))
    m = scalars.mood_class(spark, sf_dir)
    out = docs.select("doc_id").join(s, "doc_id", "left").join(top, "doc_id", "left").join(names, "doc_id", "left").join(m, "doc_id")
    return out.select("doc_id", F.coalesce("summary", F.lit("")).alias("summary"), "theme", F.coalesce("names", F.lit(0)).alias("names"), "mood")


QUERIES = {f.__name__: f for f in (scene_slices, dedupe_titles, cloze_quiz, analysis)}
_M = scalars.ORACLES["mood_class"]


def _moods(source: str) -> str:
    """Rows of a view with text t and their mood, time and place in words."""
    return "SELECT *, mood || ' / ' || time || ' / ' || place AS said FROM (" + _M.replace("SELECT doc_id, CASE", "SELECT *, CASE", 1).replace("FROM (SELECT doc_id, lower(text) AS t FROM documents)", f"FROM {source}") + ")"


_BY_DOC = ("toks", "tf", "sents", "kw", "ntoks", "near", "caps", "common", "named", "names")
#: The views of words and names with a chapter in the place of a document.
_BY_CHAPTER = {"c_docs": "SELECT doc_id || '/' || chapter_idx AS doc_id, text FROM chaps"} | {
    f"c_{name}": re.sub(rf"\b(FROM|JOIN) ({'|'.join(_BY_DOC)})\b", r"\1 c_\2", K._V[name]).replace("FROM documents", "FROM c_docs").replace("rank <= 6", f"rank <= {CAST}") for name in _BY_DOC
}
_V = K._V | _BY_CHAPTER | {
    "slices": f"""SELECT doc_id, chapter_idx, ordinal, count(*) OVER (PARTITION BY doc_id, chapter_idx) AS many, part, lower(array_to_string(part, ' ')) AS t FROM (
SELECT doc_id, chapter_idx, i AS ordinal, s[i * size + 1 : i * size + least(size, greatest(0, n - i * size))] AS part FROM (SELECT *, unnest(range(scenes)) AS i FROM (SELECT *, greatest(1, ceil(n / scenes))::BIGINT AS size FROM (
SELECT *, least(len(s), 12 * scenes) AS n FROM (SELECT doc_id, chapter_idx, {T.sql_sentences("text")} AS s, greatest(2, least(5, ceil(length(text) / 2500)))::BIGINT AS scenes FROM chaps) WHERE len(s) > 0)))) WHERE len(part) > 0""",
    "lowered": "SELECT doc_id, chapter_idx, text, lower(text) AS t FROM chaps",
    "scene_moods": _moods("slices"),
    "chapter_moods": _moods("lowered"),
    "cands": f"""SELECT * FROM (SELECT doc_id, idx, k, regexp_replace(lower(raw), '[^a-z'']', '', 'g') AS clean FROM (SELECT doc_id, idx, unnest(range(len(w))) AS k, unnest(w) AS raw, len(w) AS n FROM (
SELECT doc_id, idx, regexp_split_to_array(sentence, '[ \\t\\n\\v\\f\\r]+') AS w FROM sents WHERE len({T.sql_tokens("sentence")}) >= 6 AND length(sentence) < 280)) WHERE k > 0 AND k < n - 1)
WHERE length(clean) >= 5 AND clean NOT IN ({sql_list(STOP_WORDS)}) AND (doc_id, clean) IN (SELECT (doc_id, word) FROM tf)""",
    "cansents": "SELECT doc_id, list(clean ORDER BY k) AS cs, idx, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS i FROM cands GROUP BY doc_id, idx",
}
ORACLES = {
    "scene_slices": with_views(
        f"""SELECT doc_id, chapter_idx, ordinal::INT AS ordinal, coalesce('The ' || upper(seed[1]) || seed[2:], 'Chapter') || ' — ' || [{sql_list(SUBTITLES)}][ordinal + 1] AS title, len(part)::INT AS sentences, part[1] AS opening,
CASE WHEN len(part) > 2 THEN part[-1] ELSE '' END AS closing, CASE WHEN ordinal = many // 2 THEN own ELSE whole END AS mood, array_to_string(CASE WHEN ordinal = many // 2 THEN players[1:2] ELSE players END, '; ') AS cast,
quotes[ordinal % nullif(len(quotes), 0) + 1] AS quote, CASE WHEN len(quotes) > 0 THEN names[ordinal % len(names) + 1] END AS speaker
FROM (SELECT m.*, m.said AS own, w.said AS whole, names, coalesce(names, [{sql_list(NOBODY)}]) AS players, k.word AS seed, list_transform(regexp_extract_all(w.text, '[“"]([^”"\n]{{{LEAST_QUOTE},{LONGEST_QUOTE}}})[”"]', 1), lambda q: trim(q)) AS quotes
  FROM scene_moods m JOIN chapter_moods w USING (doc_id, chapter_idx) LEFT JOIN (SELECT doc_id AS key, list(name ORDER BY rank) AS names FROM c_names GROUP BY doc_id) n ON n.key = m.doc_id || '/' || m.chapter_idx
  LEFT JOIN (SELECT doc_id AS key, word FROM c_kw WHERE rank = 1) k ON k.key = m.doc_id || '/' || m.chapter_idx)""", **_V
    ),
    "dedupe_titles": f"""SELECT conv_id, turn, CASE WHEN n > 1 THEN title || ' — ' || CASE WHEN n <= {len(ROMAN)} THEN [{sql_list(ROMAN)}][n] ELSE n::VARCHAR END ELSE title END AS title FROM (
SELECT conv_id, turn, upper(role[1]) || role[2:] AS title, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations)""",
    "cloze_quiz": with_views(
        f"""WITH RECURSIVE g AS (SELECT doc_id, i, idx, [cs[1]] AS used, cs[1] AS answer FROM cansents WHERE i = 1
UNION ALL SELECT c.doc_id, c.i, c.idx, CASE WHEN len(list_filter(c.cs, lambda x: NOT list_contains(g.used, x))) > 0 THEN list_append(g.used, list_filter(c.cs, lambda x: NOT list_contains(g.used, x))[1]) ELSE g.used END, list_filter(c.cs, lambda x: NOT list_contains(g.used, x))[1] FROM g JOIN cansents c ON c.doc_id = g.doc_id AND c.i = g.i + 1),
p AS (SELECT g.doc_id, idx, answer, word, row_number() OVER (PARTITION BY g.doc_id, idx ORDER BY md5(word || '/' || answer), word) AS r FROM g JOIN tf ON tf.doc_id = g.doc_id AND tf.tf BETWEEN 2 AND 12 AND word <> answer AND abs(length(word) - length(answer)) <= 2 WHERE answer IS NOT NULL)
SELECT doc_id, ordinal, idx, answer, distractors FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS ordinal FROM (SELECT doc_id, idx, answer, string_agg(word, '; ' ORDER BY r) AS distractors, count(*) AS n FROM p WHERE r <= 3 GROUP BY doc_id, idx, answer) WHERE n = 3) WHERE ordinal <= {QUIZ}""", **_V
    ),
    "analysis": with_views(
        f"""SELECT d.doc_id, coalesce(summary, '') AS summary, theme, coalesce(c.n, 0) AS names, mood FROM documents d LEFT JOIN {K.sql_summary("sents", "doc_id", 4)} s ON s.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, word AS theme FROM kw WHERE rank = 1) k ON k.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM names GROUP BY doc_id) c ON c.doc_id = d.doc_id JOIN ({_M}) m ON m.doc_id = d.doc_id""", **_V
    ),
}
