"""The document shelf: scans, keyed changes, search and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readlake.operators.keyed import cascade, latest_by_key, patched, replaced_slice
from readlake.operators.stores import json_rows
from readlake.params import CODER_LOSS, CODERS, CONTEXT_CAP, FAMILIES, FINISHED, MAKERS, PROFILES, TINY, TINY_LOSS, WORDS_PER_MINUTE
from readlake.plans.retrieval import _ANN, annotations
from readlake.sources.tables import jobs, passages, shelf, table, usage, with_views

NEEDLE = "the"


def doc_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id = 42").select("doc_id", "lang", "source", "n_chars")


def predicate_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("lang = 'en' AND n_chars > 3000").select("doc_id", "source", "n_chars")


def owner_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each owner sees of a list of ids: their own rows; others' are refused."""
    d = shelf(spark, sf_dir).select("doc_id", "user_id")
    return d.where("doc_id % 13 = 0").select("doc_id", "user_id", F.when(F.col("user_id") == 3, "granted").otherwise("refused").alias("access"))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a later delta: the last write of each key wins, new keys are added."""
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(0).alias("version"))
    delta = base.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("U").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(1).alias("version"))
    new = base.where("o_orderkey % 100 = 1").select((F.col("o_orderkey") + 10_000_000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), "o_totalprice", F.lit(1).alias("version"))
    return latest_by_key(base, delta.unionByName(new), "o_orderkey", "version")


def patch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some columns of owned rows replaced; a patch's null leaves a column as it is."""
    base = shelf(spark, sf_dir).select("doc_id", "title", "collection", "favorite", F.col("created_at").alias("updated_at"))
    patch = base.where("doc_id % 4 = 0").select(
        "doc_id", F.lit("Shelved").alias("collection"), F.when(F.col("doc_id") % 8 == 0, F.lit(True)).alias("favorite"), F.expr("timestamp_ntz'2030-01-01 00:00:00'").alias("updated_at")
    )
    return patched(base, patch, "doc_id")


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left in each store after a set of documents is deleted: what belongs to them goes, ledgers, stories and caches stay."""
    gone = table(spark, sf_dir, "documents").where("doc_id % 10 = 3").select("doc_id")
    children = {
        "documents": table(spark, sf_dir, "documents").select("doc_id"),
        "passages": passages(spark, sf_dir).select("doc_id"),
        "bookmarks": table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id"),
        "annotations": annotations(spark, sf_dir).select("doc_id"),
        "scenes": passages(spark, sf_dir).select("doc_id", "chapter_idx").distinct(),
        "jobs": table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id")),
    }
    survivors = {"events": table(spark, sf_dir, "events"), "usage": usage(spark, sf_dir), "stories": table(spark, sf_dir, "conversations"), "cache": table(spark, sf_dir, "pages")}
    out = None
    for name, df in {**cascade(children, gone, "doc_id"), **survivors}.items():
        n = df.agg(F.lit(name).alias("store"), F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


def replace_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chapter's rows of every document replaced by new ones, numbered from 0."""
    base = passages(spark, sf_dir).select("doc_id", "chapter_idx", F.col("local_idx").alias("ordinal"), F.length("text").alias("size"))
    new = base.where("chapter_idx = 1 AND ordinal % 2 = 1").select("doc_id", "chapter_idx", "ordinal", (F.col("size") * 10).alias("size"))
    return replaced_slice(base, new, ["doc_id", "chapter_idx"], "ordinal")


#: The stores that an export holds, and their keys.
STORES = {
    "benchmark": "item_id,text", "conversations": "conv_id,role,text,turn", "customer": "c_acctbal,c_custkey,c_mktsegment,c_name,c_nationkey", "documents": "doc_id,lang,n_chars,source,text",
    "embeddings": "embedding,label,vec_id", "events": "event_id,event_type,props,ts,user_id,value", "labels": "doc_id,quality,toxic",
    "lineitem": "l_discount,l_extendedprice,l_linenumber,l_linestatus,l_orderkey,l_partkey,l_quantity,l_returnflag,l_shipdate,l_suppkey,l_tax", "nation": "n_name,n_nationkey,n_regionkey",
    "orders": "o_custkey,o_orderdate,o_orderkey,o_orderpriority,o_orderstatus,o_totalprice", "pages": "html,page_id,url", "part": "p_brand,p_name,p_partkey,p_retailprice,p_size,p_type",
    "region": "r_name,r_regionkey", "supplier": "s_acctbal,s_name,s_nationkey,s_suppkey",
}


def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every table as JSON text with the table's name (as written by ``write.text``), counted by key set."""
    out = None
    for name in STORES:
        rows = json_rows(name, table(spark, sf_dir, name))
        out = rows if out is None else out.unionByName(rows)
    keys = F.array_join(F.array_sort(F.json_object_keys("json")), ",")
    return out.groupBy("store", keys.alias("keys")).agg(F.count(F.lit(1)).alias("n"))


def export_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text: title, author and passages joined by blank lines."""
    p = passages(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_idx", "text"))).alias("ps"))
    s = shelf(spark, sf_dir).select("doc_id", "title", "author")
    return s.join(p, "doc_id").select("doc_id", F.concat_ws("\n\n", "title", "author", F.array_join(F.col("ps.text"), "\n\n")).alias("body"))


def append_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's passages with a chapter of its first two lines added, numbered on, and its new size."""
    p = passages(spark, sf_dir)
    last = p.groupBy("doc_id").agg(F.max("chapter_idx").alias("last"), F.max("chunk_idx").alias("end"))
    add = p.where("chunk_idx < 2").join(last, "doc_id").select(
        "doc_id", (F.col("last") + 1).alias("chapter_idx"), F.col("chunk_idx").alias("local_idx"), (F.col("end") + 1 + F.col("chunk_idx")).alias("chunk_idx"), "text"
    )
    both = p.unionByName(add)
    words = F.sum(F.size(F.expr("filter(split(text, '[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+'), w -> w <> '')")))
    return both.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("passages"), F.max("chapter_idx").alias("last_chapter"), words.alias("words"), (F.sum(F.length("text")) + 2 * (F.count(F.lit(1)) - 1)).alias("chars")
    )


def passes(needle: str = "", status: str = "all", favourites: bool = False, collection: str | None = None):
    """Whether a row of a shelf holds the needle in title, author, tag or collection and passes the other filters."""
    hit = F.lit(needle == "")
    for c in ("title", "author", "tag", "collection"):
        hit |= F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False))
    p = F.col("progress")
    arm = {"reading": (p > 0) & (p < FINISHED), "finished": p >= FINISHED, "unstarted": p == 0}.get(status, F.lit(True))
    own = (F.col("favorite") | F.lit(not favourites)) & (F.lit(True) if collection is None else F.coalesce(F.col("collection") == collection, F.lit(False)))
    return hit & arm & own


#: Filters that the query shows: name, needle, status, favourites only, collection.
FILTERS = (("reading", NEEDLE, "reading", False, None), ("finished", "", "finished", False, None), ("unstarted", "en", "unstarted", False, None), ("favourites", NEEDLE, "all", True, None), ("collection", "", "reading", True, "src1"))


def library_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What several filters of the shelf let through, each pinned and newest first: one scan and one sort for all."""
    names = F.array_compact(F.array(*[F.when(passes(*how), F.lit(name)) for name, *how in FILTERS]))
    rows = shelf(spark, sf_dir).withColumn("filter", F.explode(names))
    return rows.orderBy("filter", F.desc("favorite"), F.desc(F.coalesce("last_read_at", "created_at")), "doc_id").select("filter", "doc_id", "title", "progress", "favorite")


def metadata_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best documents for a needle; a hit in the title counts most."""
    score = F.lit(0.0)
    for c, weight in (("title", 4.0), ("author", 2.0), ("tag", 1.5), ("collection", 1.0)):
        score += F.when(F.contains(F.lower(c), F.lit("en")), weight).otherwise(0.0)
    return shelf(spark, sf_dir).withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(8).select("doc_id", "title", "score")


def shelf_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of the shelf in each order, favourites pinned; titles stand as in a dictionary, whatever their case and accents."""
    s, out = shelf(spark, sf_dir), None
    orders = {"recent": F.desc(F.coalesce("last_read_at", "created_at")), "title": F.asc(F.collate("title", "UNICODE")), "size": F.desc("byte_size"), "progress": F.desc("progress")}
    for name, key in orders.items():
        top = s.orderBy(F.desc("favorite"), key, "doc_id").limit(25).select("doc_id", "favorite", F.lit(name).alias("ordering"))
        out = top if out is None else out.unionByName(top)
    return out


def reading_rail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents: those being read (latest first), then unread (newest first), then finished."""
    section = F.when((F.col("progress") > 0) & (F.col("progress") < FINISHED), 0).when(F.col("progress") == 0, 1).otherwise(2)
    key = F.when(section == 0, F.col("last_read_at")).otherwise(F.col("created_at"))
    return shelf(spark, sf_dir).select("doc_id", section.alias("section"), key.alias("placed_at")).orderBy("section", F.desc("placed_at"), "doc_id").limit(10)


def top_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf(spark, sf_dir).orderBy(F.desc("progress"), "doc_id").limit(6).select("doc_id", "title", "progress")


def ordered_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks by place and the first of each document."""
    n = passages(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    b = n.where("doc_id % 2 = 0").select("doc_id", F.explode(F.array(*[((F.col("doc_id") * k) % F.col("n")).alias("c") for k in (7, 3, 5)])).alias("chunk_idx"))
    w = W.partitionBy("doc_id").orderBy("chunk_idx")
    return b.distinct().select("doc_id", "chunk_idx", F.row_number().over(w).alias("ordinal"))


def child_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What belongs to a document or user, in its order: scenes by chapter and place, stories and jobs latest first."""
    scenes = passages(spark, sf_dir).where("local_idx < 2").select("doc_id", F.concat_ws("/", "chapter_idx", "local_idx").alias("child"), F.struct(F.col("chapter_idx").cast("long").alias("a"), F.col("local_idx").cast("long").alias("b")).alias("place"))
    told = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
    stories = told.select((F.col("conv_id") % 50).alias("doc_id"), F.col("conv_id").cast("string").alias("child"), F.struct((-F.col("last")).alias("a"), F.col("conv_id").alias("b")).alias("place"))
    work = jobs(spark, sf_dir).select(F.col("user_id").alias("doc_id"), F.col("job_id").cast("string").alias("child"), F.struct((-F.unix_seconds(F.col("updated_at").cast("timestamp"))).alias("a"), F.col("job_id").alias("b")).alias("place"))
    each = None
    for kind, rows in (("scene", scenes), ("story", stories), ("job", work)):
        rows = rows.select(F.lit(kind).alias("kind"), F.col("doc_id").alias("parent"), "child", "place")
        each = rows if each is None else each.unionByName(rows)
    return each.withColumn("ordinal", F.row_number().over(W.partitionBy("kind", "parent").orderBy("place"))).select("kind", "parent", "child", "ordinal")


def distinct_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf(spark, sf_dir).where("collection is not null").select("collection").distinct()


def preference_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices in order of preference (own, then group's, then all), each once at its best rank."""
    s = shelf(spark, sf_dir)
    own = s.where("favorite").select(F.col("author").alias("choice"), F.lit(0).alias("rank"))
    group = s.where("progress > 50").select(F.col("author").alias("choice"), F.lit(1).alias("rank"))
    rest = s.select(F.col("author").alias("choice"), F.lit(2).alias("rank"))
    return own.unionByName(group).unionByName(rest).groupBy("choice").agg(F.min("rank").alias("rank"))


def library_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = F.col("words") * F.col("progress") / 100
    return shelf(spark, sf_dir).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("words").alias("words"),
        F.sum("byte_size").alias("bytes"),
        F.count_if(F.col("progress") >= FINISHED).alias("finished"),
        F.floor(F.sum(read) + 0.5).alias("words_read"),
        F.floor(F.sum(read) / WORDS_PER_MINUTE + 0.5).alias("minutes"),
    )


def minutes_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.floor((100 - F.col("progress")) / 100 * F.col("words") / WORDS_PER_MINUTE + 0.5)
    return shelf(spark, sf_dir).select("doc_id", F.greatest(F.lit(1), left).alias("minutes"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry, id, name, context, in_price: parts as rows of a model catalogue, a third of them free, some of users' own."""
    maker = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    own = F.concat(maker, F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_size"), F.lit("b"), F.when(F.col("p_partkey") % 15 == 3, "-coder").otherwise(""), F.when(F.col("p_partkey") % 3 == 0, ":free").otherwise(""))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("entry"), F.when(F.col("p_partkey") % 17 == 6, F.concat(F.lit("x:user/"), F.col("p_partkey"), F.lit(":free"))).otherwise(own).alias("id"),
        F.col("p_name").alias("name"), (F.col("p_size") * 4096).cast("long").alias("context"), (F.col("p_retailprice") / 1e9).alias("in_price"),
    )


def catalog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free entries that aren't a user's own, with prices for a million tokens."""
    return catalog(spark, sf_dir).where("id like '%:free' and not id like 'x:user/%'").select("entry", "id", "name", "context", F.round(F.col("in_price") * 1e6, 4).alias("in_per_m"))


def catalog_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The free entry that suits each profile best: by context, size, maker and family, less what coders and tiny ones lose."""
    c = catalog(spark, sf_dir).where("id like '%:free'")
    billions = F.coalesce(F.expr("try_cast(nullif(regexp_extract(id, '([0-9]+)b[:-]', 1), '') as double)"), F.lit(0.0))
    size = F.least(F.lit(10.0), billions / 5)
    coder = F.when(F.col("id").rlike(CODERS), CODER_LOSS).otherwise(0.0)
    maker = sum((F.when(F.col("id").rlike(p), bonus).otherwise(0.0) for p, bonus in MAKERS), F.lit(0.0))
    scores = []
    for profile, by_size, by_context in PROFILES:
        family = sum((F.when(F.contains("id", F.lit(part)), bonus).otherwise(0.0) for who, part, bonus in FAMILIES if who == profile), F.lit(0.0))
        score = size / 10 * by_size + F.least(F.lit(CONTEXT_CAP), F.col("context")) / CONTEXT_CAP * by_context + maker + family - coder
        if profile in TINY_LOSS:
            score -= F.when((billions > 0) & (billions < TINY), TINY_LOSS[profile]).otherwise(0.0)
        scores.append(F.struct(F.lit(profile).alias("profile"), F.round(score, 6).alias("score")))
    each = c.select("entry", "id", F.explode(F.array(*scores)).alias("s")).select("entry", "id", "s.profile", "s.score")
    # combined map-side: one row for each profile reaches the last task of each
    best = each.groupBy("profile").agg(F.max(F.struct("score", (-F.col("entry")).alias("first"), "id")).alias("b"))
    return best.select("profile", (-F.col("b.first")).alias("entry"), "b.id", "b.score")


_CAT = """SELECT p_partkey AS entry, CASE WHEN p_partkey % 17 = 6 THEN 'x:user/' || p_partkey || ':free' ELSE lower(replace(p_brand, '#', '-')) || '/' || replace(p_name, ' ', '-') || '-' || p_size || 'b' || CASE WHEN p_partkey % 15 = 3 THEN '-coder' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN ':free' ELSE '' END END AS id,
p_name AS name, (p_size * 4096)::BIGINT AS context, p_retailprice / 1e9 AS in_price FROM part"""
_MADE = " + ".join(f"CASE WHEN regexp_matches(id, '{p}') THEN {b!r} ELSE 0 END" for p, b in MAKERS)
_RANKS = " UNION ALL ".join(
    f"SELECT '{profile}' AS profile, entry, id, round(size / 10 * ({by_size!r}::DOUBLE) + least({CONTEXT_CAP}, context) / {CONTEXT_CAP} * {by_context!r}::DOUBLE + ({_MADE})::DOUBLE + ("
    + " + ".join(f"CASE WHEN contains(id, '{part}') THEN {bonus!r} ELSE 0 END" for who, part, bonus in FAMILIES if who == profile)
    + f")::DOUBLE - CASE WHEN regexp_matches(id, '{CODERS}') THEN {CODER_LOSS!r} ELSE 0 END::DOUBLE - CASE WHEN billions > 0 AND billions < {TINY} THEN {TINY_LOSS.get(profile, 0.0)!r} ELSE 0 END::DOUBLE, 6) AS score FROM free"
    for profile, by_size, by_context in PROFILES
)
_N = "len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> ''))"
QUERIES = {
    f.__name__: f
    for f in (
        doc_lookup, predicate_scan, owner_scan, upsert_latest, patch_rows, cascade_delete, replace_slice, export_json, export_text, append_chapter, library_filter,
        metadata_search, shelf_sort, reading_rail, top_progress, ordered_children, child_lists, distinct_collections, preference_chain, library_totals, minutes_left, catalog_filter, catalog_rank,
    )
}
ORACLES = {
    "doc_lookup": "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 42",
    "predicate_scan": "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars > 3000",
    "owner_scan": with_views("SELECT doc_id, user_id, CASE WHEN user_id = 3 THEN 'granted' ELSE 'refused' END AS access FROM shelf WHERE doc_id % 13 = 0"),
    "upsert_latest": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, o_totalprice + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS o_totalprice,
CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS version FROM orders UNION ALL SELECT o_orderkey + 10000000, 'N', o_totalprice, 1 FROM orders WHERE o_orderkey % 100 = 1""",
    "patch_rows": with_views("SELECT doc_id, title, CASE WHEN doc_id % 4 = 0 THEN 'Shelved' ELSE collection END AS collection, doc_id % 8 = 0 OR favorite AS favorite, CASE WHEN doc_id % 4 = 0 THEN TIMESTAMP '2030-01-01' ELSE created_at END AS updated_at FROM shelf"),
    "cascade_delete": with_views(
        """SELECT 'events' AS store, count(*) AS n FROM events UNION ALL SELECT 'documents', count(*) FROM documents WHERE doc_id % 10 <> 3
UNION ALL SELECT 'annotations', count(*) FROM ann WHERE doc_id % 10 <> 3 UNION ALL SELECT 'scenes', count(*) FROM (SELECT DISTINCT doc_id, chapter_idx FROM passages WHERE doc_id % 10 <> 3)
UNION ALL SELECT 'jobs', count(*) FROM orders WHERE o_custkey NOT IN (SELECT doc_id FROM documents WHERE doc_id % 10 = 3) UNION ALL SELECT 'usage', count(*) FROM usage UNION ALL SELECT 'stories', count(*) FROM conversations UNION ALL SELECT 'cache', count(*) FROM pages
UNION ALL SELECT 'passages', count(*) FROM passages WHERE doc_id % 10 <> 3 UNION ALL SELECT 'bookmarks', count(*) FROM documents WHERE doc_id % 2 = 0 AND doc_id % 10 <> 3""",
        ann=_ANN,
    ),
    "replace_slice": with_views(
        """SELECT doc_id, chapter_idx, local_idx AS ordinal, length(text)::INT AS size FROM passages WHERE (doc_id, chapter_idx) NOT IN (SELECT (doc_id, chapter_idx) FROM passages WHERE chapter_idx = 1 AND local_idx % 2 = 1)
UNION ALL SELECT doc_id, chapter_idx, (row_number() OVER (PARTITION BY doc_id, chapter_idx ORDER BY local_idx) - 1)::INT, (length(text) * 10)::INT FROM passages WHERE chapter_idx = 1 AND local_idx % 2 = 1"""
    ),
    "export_json": " UNION ALL ".join(f"SELECT '{n}' AS store, '{k}' AS keys, count(*) AS n FROM {n}" for n, k in STORES.items()),
    "export_text": with_views(
        """SELECT s.doc_id, title || chr(10) || chr(10) || author || chr(10) || chr(10) || p.body AS body FROM shelf s JOIN (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_idx) AS body FROM passages GROUP BY doc_id) p USING (doc_id)"""
    ),
    "append_chapter": with_views(
        f"""SELECT doc_id, count(*) AS passages, max(chapter_idx)::INT AS last_chapter, sum({_N})::BIGINT AS words, (sum(length(text)) + 2 * (count(*) - 1))::BIGINT AS chars FROM (
SELECT doc_id, chapter_idx, text FROM passages UNION ALL
SELECT doc_id, last + 1, text FROM passages JOIN (SELECT doc_id, max(chapter_idx) AS last FROM passages GROUP BY doc_id) USING (doc_id) WHERE chunk_idx < 2) GROUP BY doc_id"""
    ),
    "library_filter": with_views(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS filter, doc_id, title, progress, favorite FROM shelf WHERE {dict(reading=f"progress > 0 AND progress < {FINISHED}", finished=f"progress >= {FINISHED}", unstarted="progress = 0").get(status, "true")}
AND (contains(lower(title), '{needle}') OR contains(lower(author), '{needle}') OR contains(lower(tag), '{needle}') OR coalesce(contains(lower(collection), '{needle}'), false)) {"AND favorite" if fav else ""} {f"AND collection = '{coll}'" if coll else ""}"""
            for name, needle, status, fav, coll in FILTERS
        )
    ),
    "metadata_search": with_views(
        """SELECT doc_id, title, score FROM (SELECT *, (CASE WHEN contains(lower(title), 'en') THEN 4.0 ELSE 0 END + CASE WHEN contains(lower(author), 'en') THEN 2.0 ELSE 0 END + CASE WHEN contains(lower(tag), 'en') THEN 1.5 ELSE 0 END
+ CASE WHEN contains(lower(collection), 'en') THEN 1.0 ELSE 0 END)::DOUBLE AS score FROM shelf) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 8"""
    ),
    "shelf_sort": with_views(
        " UNION ALL ".join(
            f"(SELECT doc_id, favorite, '{n}' AS ordering FROM shelf ORDER BY favorite DESC, {k}, doc_id LIMIT 25)"
            for n, k in (("recent", "coalesce(last_read_at, created_at) DESC"), ("title", "title COLLATE de"), ("size", "byte_size DESC"), ("progress", "progress DESC"))
        )
    ),
    "reading_rail": with_views(
        f"""SELECT doc_id, section, CASE WHEN section = 0 THEN last_read_at ELSE created_at END AS placed_at FROM (SELECT *, CASE WHEN progress > 0 AND progress < {FINISHED} THEN 0 WHEN progress = 0 THEN 1 ELSE 2 END AS section FROM shelf)
ORDER BY section, placed_at DESC, doc_id LIMIT 10"""
    ),
    "top_progress": with_views("SELECT doc_id, title, progress FROM shelf ORDER BY progress DESC, doc_id LIMIT 6"),
    "ordered_children": with_views(
        """SELECT doc_id, chunk_idx, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS ordinal FROM (
SELECT DISTINCT doc_id, unnest([doc_id * 7 % n, doc_id * 3 % n, doc_id * 5 % n]) AS chunk_idx FROM (SELECT doc_id, count(*) AS n FROM passages WHERE doc_id % 2 = 0 GROUP BY doc_id))"""
    ),
    "child_lists": with_views(
        """SELECT kind, parent, child, row_number() OVER (PARTITION BY kind, parent ORDER BY a, b) AS ordinal FROM (
SELECT 'scene' AS kind, doc_id AS parent, chapter_idx || '/' || local_idx AS child, chapter_idx::BIGINT AS a, local_idx::BIGINT AS b FROM passages WHERE local_idx < 2
UNION ALL SELECT 'story', conv_id % 50, conv_id::VARCHAR, -max(turn), conv_id FROM conversations GROUP BY conv_id
UNION ALL SELECT 'job', user_id, job_id::VARCHAR, -floor(epoch(updated_at))::BIGINT, job_id FROM jobs)"""
    ),
    "distinct_collections": with_views("SELECT DISTINCT collection FROM shelf WHERE collection IS NOT NULL"),
    "preference_chain": with_views("SELECT author AS choice, min(CASE WHEN favorite THEN 0 WHEN progress > 50 THEN 1 ELSE 2 END) AS rank FROM shelf GROUP BY author"),
    "library_totals": with_views(
        f"""SELECT user_id, count(*) AS documents, sum(words)::BIGINT AS words, sum(byte_size)::BIGINT AS bytes, count(*) FILTER (progress >= {FINISHED}) AS finished,
floor(sum(words * progress / 100) + 0.5)::BIGINT AS words_read, floor(sum(words * progress / 100) / {WORDS_PER_MINUTE} + 0.5)::BIGINT AS minutes FROM shelf GROUP BY user_id"""
    ),
    "minutes_left": with_views(f"SELECT doc_id, greatest(1, floor((100 - progress) / 100 * words / {WORDS_PER_MINUTE} + 0.5)::BIGINT) AS minutes FROM shelf"),
    "catalog_filter": f"SELECT entry, id, name, context, round(in_price * 1e6, 4) AS in_per_m FROM ({_CAT}) WHERE id LIKE '%:free' AND NOT id LIKE 'x:user/%'",
    "catalog_rank": f"""WITH free AS (SELECT *, least(10.0, billions / 5) AS size FROM (SELECT *, coalesce(try_cast(nullif(regexp_extract(id, '([0-9]+)b[:-]', 1), '') AS DOUBLE), 0) AS billions FROM ({_CAT}) WHERE id LIKE '%:free'))
SELECT profile, entry, id, score FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY score DESC, entry) AS r FROM ({_RANKS})) WHERE r = 1""",
}
