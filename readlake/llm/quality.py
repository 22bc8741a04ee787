"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

One pass measures every whole text.  A sketch is a set of (logarithmic bin, count) rows: bins are
summed, so sketches merge exactly (source -> language -> corpus), whatever the partitioning, and a
quantile is within ALPHA of its value.  A group's quartiles give its fences; a group of fewer than
MIN_GROUP documents uses its language's, then the corpus's.  Documents outside a fence are rejected.

A fence is Q3 + REACH * max(Q3 - Q1, least spread), and for word length also the lower one, so that a
homogeneous group doesn't reject on trifles.  Thresholds are joined back to the documents.

Cases: null or empty text has no words and fails the base rule; null language or source is a group of
its own; empty tables give empty results; repeated rows are measured and judged row by row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readlake.llm.common import join_groups, materialize, small, table

ALPHA = 0.01  # relative error of the sketches' quantiles
MIN_GROUP = 50  # smaller groups use the sketch of their language
REACH = 3.0  # fences lie so many spreads beyond the quartiles
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: Metric -> the least spread that its fences use.
METRICS = {"symbol_rate": 0.05, "dup_line_rate": 0.1, "repeat_rate": 0.1, "caps_rate": 0.1, "shout_rate": 0.1, "word_len": 1.0}
LOWER = ("word_len",)

_RAW = "doc_id long, text_hash long, grp string, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_caps long, n_shouts long"


def repeated_words(words: list) -> int:
    """Words that lie in a 3-word window found twice or more, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    size = len(ids)
    if size < 2_000_000:
        key = (a[:-2] * size + a[1:-1]) * size + a[2:]
    else:  # the product would pass 64 bits
        _, pair = np.unique(a[:-1] * size + a[1:], return_inverse=True)
        key = pair[:-1] * size + a[2:]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    found = np.isin(key, twice)
    cover = np.zeros(n, bool)
    cover[:-2] |= found
    cover[1:-1] |= found
    cover[2:] |= found
    return int(cover.sum())


def measure(text: str) -> tuple:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # splits at exactly the six ASCII white spaces
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(map(str.isupper, text.split())),
        text.count("!"),
    )


def _measured(batches):
    for batch in small(batches):
        cols = list(zip(*map(measure, (x or "" for x in batch.column("text").to_pylist())), strict=True)) or [[]] * 8
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), batch.column("grp"), batch.column("lang"), *[pa.array(c, pa.int64()) for c in cols]],
            names=["doc_id", "text_hash", "grp", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps", "n_shouts"],
        )


def measured(docs: DataFrame) -> DataFrame:
    """One row per row of docs: its counts and its metrics."""
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.to_json(F.struct(F.col("lang"), F.col("source"))).alias("grp"),
        F.coalesce(F.to_json(F.struct("lang")), F.lit("{}")).alias("lang"),
        F.col("text"),
    )
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return keyed.mapInArrow(_measured, _RAW).select(
        "*",
        per("n_symbols", "n_words").alias("symbol_rate"),
        per("n_dup_lines", "n_lines").alias("dup_line_rate"),
        per("n_repeat_words", "n_words").alias("repeat_rate"),
        per("n_caps", "n_words").alias("caps_rate"),
        per("n_shouts", "n_words").alias("shout_rate"),
        per("word_chars", "n_words").alias("word_len"),
    )


def _bin(value: Column) -> Column:
    """Logarithmic bin; values up to 1e-6 share the bin of 0."""
    return F.when(value <= 1e-6, F.lit(-10_000)).otherwise(F.ceil(F.log(value) / math.log((1 + ALPHA) / (1 - ALPHA))).cast("int"))


def _value(bin_: Column) -> Column:
    gamma = (1 + ALPHA) / (1 - ALPHA)
    return F.when(bin_ == -10_000, F.lit(0.0)).otherwise(2 * F.pow(F.lit(gamma), bin_.cast("double")) / (gamma + 1))


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, bin, n): a mergeable sketch for each group and metric, over documents with words."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), _bin(F.col(m)).alias("bin")) for m in METRICS])).alias("p")
    return rows.where("n_words > 0").select(*keys, pairs).groupBy(*keys, "p.metric", "p.bin").agg(F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: its documents and the fences of each metric.  Windows run over bins, not rows."""
    w = W.partitionBy(*keys, "metric")
    run = sketches.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("bin")))
    quart = run.groupBy(*keys, "metric").agg(_value(at(0.25)).alias("q1"), _value(at(0.75)).alias("q3"), F.max("total").alias("total"))
    floor = F.coalesce(*[F.when(F.col("metric") == m, F.lit(v)) for m, v in METRICS.items()])
    spread = REACH * F.greatest(F.col("q3") - F.col("q1"), floor)
    one = lambda m, x: F.max(F.when(F.col("metric") == m, x))
    return quart.groupBy(*keys).agg(
        F.max("total").alias("group_docs"),
        *[one(m, F.col("q3") + spread).alias(f"{m}_most") for m in METRICS],
        *[one(m, F.col("q1") - spread).alias(f"{m}_least") for m in LOWER],
    )


def judged(docs: DataFrame) -> DataFrame:
    """Every measured row with its thresholds and verdict."""
    rows = materialize(measured(docs), "quality")
    by_source = materialize(sketch(rows, ["grp", "lang"]), "quality-sketch")
    by_lang = merged(by_source, ["lang"])
    own = fences(by_source.drop("lang"), ["grp"])
    limits = [c for c in own.columns if c not in ("grp", "group_docs")]
    lang = fences(by_lang, ["lang"]).select("lang", F.col("group_docs").alias("lang_docs"), *[F.col(c).alias(f"lang_{c}") for c in limits])
    everything = fences(merged(by_lang, []), []).select(*[F.col(c).alias(f"all_{c}") for c in limits])
    groups = rows.groupBy("grp", "lang").agg(F.count(F.lit(1)).alias("group_rows"))
    # one row per group, one per language and a single one: small against the rows, joined by shuffle unless Spark finds them small
    chosen = (
        groups.join(own, "grp", "left")
        .join(lang, "lang", "left")
        .join(F.broadcast(everything), F.lit(True), "left")
        .select(
            "grp",
            "group_rows",
            *[
                F.when(F.col("group_docs") >= MIN_GROUP, F.col(c))
                .when(F.col("lang_docs") >= MIN_GROUP, F.col(f"lang_{c}"))
                .otherwise(F.col(f"all_{c}"))
                .alias(c)
                for c in limits
            ],
        )
    )
    full = join_groups(rows, materialize(chosen, "quality-fences"), "grp", "group_rows", rows.count())
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.lit(True)
    for m in METRICS:
        inside &= F.coalesce(F.col(m) <= F.col(f"{m}_most"), F.lit(True))
    for m in LOWER:
        inside &= F.coalesce(F.col(m) >= F.col(f"{m}_least"), F.lit(True))
    return full.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & inside)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose verdict is kept (rows of one doc_id with one text share it)."""
    good = judged(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    same = docs["doc_id"].eqNullSafe(good["_id"]) & (F.xxhash64(docs["text"]) == good["_hash"])
    return docs.join(good, same, "left_semi").select(*docs.columns)


_LOG_GAMMA = repr(math.log((1 + ALPHA) / (1 - ALPHA)))
_GAMMA = repr((1 + ALPHA) / (1 - ALPHA))
_SPLIT = "list_filter(regexp_split_to_array({0}, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')"


def _sql_fences(keys: str) -> str:
    """Documents and fences of each group and metric from the bins of ``b``."""
    by = f"PARTITION BY {keys + ', ' if keys else ''}metric"
    group = f"GROUP BY {keys + ', ' if keys else ''}metric"
    least = "CASE metric " + " ".join(f"WHEN '{m}' THEN {v!r}" for m, v in METRICS.items()) + " END"
    value = f"CASE WHEN {{0}} = -10000 THEN 0 ELSE 2 * pow({_GAMMA}::DOUBLE, {{0}}) / ({_GAMMA} + 1) END"
    return f"""(SELECT {keys + ", " if keys else ""}metric, total, q3 + {REACH} * greatest(q3 - q1, {least}) AS most, q1 - {REACH} * greatest(q3 - q1, {least}) AS least FROM (
      SELECT {keys + ", " if keys else ""}metric, max(total) AS total, {value.format("min(bin) FILTER (upto >= total * 0.25)")} AS q1, {value.format("min(bin) FILTER (upto >= total * 0.75)")} AS q3 FROM (
        SELECT *, sum(n) OVER ({by} ORDER BY bin) AS upto, sum(n) OVER ({by}) AS total FROM (SELECT {keys + ", " if keys else ""}metric, bin, count(*) AS n FROM b GROUP BY ALL)) {group}))"""


#: The same rules as SQL, for documents whose doc_id is unique and whose only white space is ASCII.
SQL = f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_SPLIT.format("coalesce(text, '')")} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\v\\f\\r]')) AS ls FROM documents),
tri AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS g FROM (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM w) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri WHERE g IS NOT NULL) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines, len(list_filter(ws, lambda x: x = upper(x) AND x <> lower(x))) AS n_caps, length(t) - length(replace(t, '!', '')) AS n_shouts
  FROM w LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, unnest([{", ".join(f"'{x}'" for x in METRICS)}]) AS metric,
  unnest([n_symbols / n_words, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END, n_repeat_words / n_words, n_caps / n_words, n_shouts / n_words, word_chars / n_words]::DOUBLE[]) AS value FROM m WHERE n_words > 0),
b AS (SELECT *, CASE WHEN value <= 1e-6 THEN -10000 ELSE ceil(ln(value) / {_LOG_GAMMA})::INT END AS bin FROM v),
bad AS (SELECT DISTINCT v.doc_id FROM v LEFT JOIN {_sql_fences("lang, source")} s ON v.lang IS NOT DISTINCT FROM s.lang AND v.source IS NOT DISTINCT FROM s.source AND v.metric = s.metric
  LEFT JOIN {_sql_fences("lang")} l ON v.lang IS NOT DISTINCT FROM l.lang AND v.metric = l.metric JOIN {_sql_fences("")} a ON v.metric = a.metric
  WHERE value > CASE WHEN s.total >= {MIN_GROUP} THEN s.most WHEN l.total >= {MIN_GROUP} THEN l.most ELSE a.most END
  OR (v.metric IN ({", ".join(f"'{x}'" for x in LOWER)}) AND value < CASE WHEN s.total >= {MIN_GROUP} THEN s.least WHEN l.total >= {MIN_GROUP} THEN l.least ELSE a.least END))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM m
"""
