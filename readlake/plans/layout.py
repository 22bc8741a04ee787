"""Headings, page numbers and breaks from rows that a document reader has extracted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readlake.functions import text as T
from readlake.plans import ingest
from readlake.sources.tables import lines, table, with_views

ROWS = 4  # rows of a derived page
ROW_CHARS = 70  # characters of a derived row
PAGE_NUMBER = "(?i)^((page)? *[0-9]{1,4} *|[ivxlcdm]{1,6})$"
SPINE = 400  # fixed value: spine items that a book uses


def layout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, row_idx, row_count, text, h, gap: lines, long ones broken, as rows of pages with font heights and gaps."""
    broken = lines(spark, sf_dir).where("trim(text) <> ''").select("doc_id", "line_no", F.posexplode(F.expr(f"transform(sequence(0, (length(text) - 1) div {ROW_CHARS}), i -> substring(text, i * {ROW_CHARS} + 1, {ROW_CHARS}))")).alias("piece", "text"))
    n = F.col("n")
    page, row = F.floor(n / ROWS) + 1, n % ROWS
    text = F.when((row == 0) & (page % 2 == 0), page.cast("string")).when((row == 3) & (page % 3 == 0), "iv").otherwise(F.col("text"))
    h = F.when(n % 9 == 4, 16.0).when(n % 9 == 7, 13.2).otherwise(10 + (F.length("text") % 3) * 0.3)
    gap = F.when(row == 0, 0).when(n % 7 == 3, 40).otherwise(12)
    at = F.row_number().over(W.partitionBy("doc_id").orderBy("line_no", "piece")) - 1
    r = broken.withColumn("n", at).select("doc_id", page.alias("page"), row.alias("row_idx"), F.trim(text).alias("text"), h.alias("h"), gap.alias("gap"))
    return r.withColumn("row_count", F.count(F.lit(1)).over(W.partitionBy("doc_id", "page")))


def without_page_numbers(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("text").rlike(PAGE_NUMBER) | ((F.col("row_idx") > 1) & (F.col("row_idx") < F.col("row_count") - 2)))


def layout_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_page_numbers(layout_rows(spark, sf_dir)).select("doc_id", "page", "row_idx", "text")


def upper_median(rows: DataFrame, value: str, key: str = "doc_id") -> DataFrame:
    """key, median: the value at floor(n / 2) of each key's sorted values."""
    w = W.partitionBy(key)
    r = rows.select(key, F.col(value).alias("v")).withColumn("k", F.row_number().over(w.orderBy("v"))).withColumn("n", F.count(F.lit(1)).over(w))
    return r.where(F.col("k") == F.floor(F.col("n") / 2) + 1).select(key, F.col("v").alias("median"))


def font_clusters(rows: DataFrame) -> DataFrame:
    """doc_id, body_h, heading_h: the commonest half-point height and the least height of headings."""
    b = rows.groupBy("doc_id", (F.floor(F.col("h") * 2 + 0.5) / 2).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("doc_id")
    b = b.withColumn("k", F.row_number().over(w.orderBy("b")) - 1).withColumn("kinds", F.count(F.lit(1)).over(w))
    at = F.when(F.col("kinds") >= 4, F.floor(F.col("kinds") * 0.75)).when(F.col("kinds") >= 2, F.col("kinds") - 1)
    c = b.groupBy("doc_id").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("body_h"), F.max(F.when(F.col("k") == at, F.col("b"))).alias("top"))
    heading = F.when(F.col("top") > F.col("body_h"), F.col("top")).otherwise(F.round(F.col("body_h") * 1.15, 6))
    return c.select("doc_id", "body_h", heading.alias("heading_h"))


def layout_font_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return font_clusters(without_page_numbers(layout_rows(spark, sf_dir)))


def looks_like_heading(t, h, threshold):
    words = F.size(F.split(t, " +"))
    letters = F.regexp_replace(t, "[^a-zA-Z]", "")
    capital = F.size(F.filter(F.split(t, " +"), lambda w: w.rlike("^[A-Z]")))
    fine = F.length(t).between(2, 80) & ~t.rlike("[.!?…]$") & ~t.rlike(PAGE_NUMBER)
    caps = (F.length(letters) >= 4) & (letters == F.upper(letters)) & (F.length(t) < 60) & (words <= 8) & ~t.rlike("[0-9]{3}")
    title = F.length(t).between(7, 59) & words.between(2, 8) & (capital / words >= 0.6)
    return fine & (((h >= threshold) & (words <= 12)) | caps | title)


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, toc: outline titles of some pages."""
    pages = layout_rows(spark, sf_dir).where("page % 3 = 1").groupBy("doc_id", "page").agg(F.min_by("text", "row_idx").alias("t"))
    return pages.select("doc_id", "page", F.when(F.col("page") % 2 == 1, F.substring("t", 1, 20)).otherwise(F.concat(F.lit("Part "), F.col("page"))).alias("toc"))


def layout_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as lines: which are headings, which titles of the outline are put before them, where text breaks."""
    rows = without_page_numbers(layout_rows(spark, sf_dir))
    joined = rows.join(font_clusters(rows), "doc_id").join(upper_median(rows, "h"), "doc_id").withColumnRenamed("median", "median_h")
    joined = joined.join(upper_median(rows.where("gap > 0"), "gap").withColumnRenamed("median", "median_gap"), "doc_id", "left").join(outline(spark, sf_dir), ["doc_id", "page"], "left")
    first = F.row_number().over(W.partitionBy("doc_id", "page").orderBy("row_idx")) == 1
    j = joined.withColumn("first", first).withColumn("like", looks_like_heading(F.col("text"), F.col("h"), F.col("heading_h")))
    bare = lambda c: F.substring(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", "")), 1, 24)
    a, b = bare("text"), bare("toc")
    same = (F.length(a) >= 3) & (F.length(b) >= 3) & (F.contains(a, b) | F.contains(b, a))
    starts = F.col("first") & F.col("toc").isNotNull()
    promoted = starts & F.coalesce(same | (F.col("h") >= F.col("heading_h")), F.lit(False))
    gap = F.col("gap") > F.greatest(F.coalesce("median_gap", F.lit(12)) * 2.5, F.col("median_h") * 2.4)
    return j.select(
        "doc_id", "page", "row_idx", "text", (F.col("like") | promoted).alias("heading"), F.when(starts & ~F.col("like") & ~promoted, F.col("toc")).alias("injected"),
        (gap | (F.col("first") & (F.col("page") > 1) & (F.col("like") | F.col("toc").isNotNull()))).alias("breaks"),
    )


def styled_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that their style, or being bold, short and large, or their words make headings."""
    n = F.col("line_no")
    style = F.when(n % 10 == 0, "Heading1").when(n % 10 == 5, "Quote").otherwise("Normal")
    r = lines(spark, sf_dir).where("trim(text) <> ''").select(
        "doc_id", "line_no", style.alias("style"), (n % 3 == 1).alias("bold"), F.when(n % 6 == 1, 15.0).otherwise(11.0).alias("size"), F.trim("text").alias("t")
    )
    r = r.join(upper_median(r, "size"), "doc_id")
    bold = F.col("bold") & (F.length("t") > 2) & (F.length("t") < 70) & (F.col("size") >= 1.25 * F.col("median"))
    return r.select("doc_id", "line_no", (F.col("style").isin("Heading1", "Heading2", "Heading3", "Title") | bold | T.is_heading(F.col("t"))).alias("heading"))


def slides_to_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides (a conversation's turns) as a heading with their number and title, and lines."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("slide"), F.posexplode(F.filter(F.transform(F.split("text", r"\. |\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("k", "item"))
    head = c.groupBy("conv_id", "slide").agg(F.min_by("item", "k").alias("title")).select("conv_id", "slide", F.lit(-1).alias("k"), F.concat(F.lit("Slide "), F.col("slide") + 1, F.lit(": "), "title").alias("text"), F.lit(True).alias("heading"))
    return head.unionByName(c.where("k > 0").select("conv_id", "slide", "k", F.col("item").alias("text"), F.lit(False).alias("heading")))


def spine_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a book's spine: text items in order, those with a real line, a heading made for those without."""
    pages = table(spark, sf_dir, "pages")
    # a book is a block of SPINE numbers, so that books grow in number with the pages; items are numbered without their text
    items = pages.select("page_id", F.floor(F.col("page_id") / SPINE).alias("book"), F.when(F.col("page_id") % 7 == 3, "text/css").otherwise("text/html").alias("kind"))
    items = items.withColumn("item", F.row_number().over(W.partitionBy("book").orderBy("page_id"))).where((F.col("item") <= SPINE) & F.col("kind").rlike("html|xml"))
    p = pages.join(items, "page_id").select("page_id", "book", "item", "url", "html")
    rows = ingest.html_line_rows(p.select("page_id", F.regexp_replace("html", "(?i)<(/?)h1(?=[ >])", F.when(F.col("page_id") % 4 == 0, "<$1h4").otherwise("<$1h1")).alias("html")))
    flags = rows.groupBy("page_id").agg(F.max(F.col("tag").isin("h1", "h2")).alias("has_head"), F.max(F.length("text") > 40).alias("has_text"))
    kept = p.join(flags.where("has_text"), "page_id").select("page_id", "book", "item", "url", "has_head")
    name = F.regexp_replace(F.regexp_extract("url", "([^/]+)$", 1), "[-_]", " ")
    made = kept.where("not has_head").select("book", "item", F.lit(-1).alias("line_no"), name.alias("text"), F.lit(True).alias("heading"))
    own = rows.join(kept, "page_id").select("book", "item", "line_no", "text", F.col("tag").isin("h1", "h2").alias("heading"))
    return made.unionByName(own)


QUERIES = {f.__name__: f for f in (layout_page_numbers, layout_font_clusters, layout_headings, styled_headings, slides_to_lines, spine_assemble)}
_LIKE = f"""length(text) BETWEEN 2 AND 80 AND NOT regexp_matches(text, '[.!?…]$') AND NOT regexp_matches(text, '{PAGE_NUMBER}') AND ((h >= heading_h AND words <= 12)
 OR (length(letters) >= 4 AND letters = upper(letters) AND length(text) < 60 AND words <= 8 AND NOT regexp_matches(text, '[0-9]{{3}}')) OR (length(text) BETWEEN 7 AND 59 AND words BETWEEN 2 AND 8 AND capital / words >= 0.6))"""
_V = {
    "lrows": f"""SELECT *, count(*) OVER (PARTITION BY doc_id, page) AS row_count FROM (SELECT doc_id, page, row_idx, trim(CASE WHEN row_idx = 0 AND page % 2 = 0 THEN page::VARCHAR WHEN row_idx = 3 AND page % 3 = 0 THEN 'iv' ELSE text END) AS text,
CASE WHEN n % 9 = 4 THEN 16.0::DOUBLE WHEN n % 9 = 7 THEN 13.2::DOUBLE ELSE 10 + (length(text) % 3) * 0.3::DOUBLE END AS h, CASE WHEN row_idx = 0 THEN 0 WHEN n % 7 = 3 THEN 40 ELSE 12 END AS gap
FROM (SELECT *, n // {ROWS} + 1 AS page, n % {ROWS} AS row_idx FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, piece) - 1 AS n FROM (
SELECT doc_id, line_no, unnest(range(k)) AS piece, unnest(list_transform(range(k), lambda i: text[i * {ROW_CHARS} + 1:i * {ROW_CHARS} + {ROW_CHARS}])) AS text FROM (SELECT *, (length(text) - 1) // {ROW_CHARS} + 1 AS k FROM lines WHERE trim(text) <> '')))))""",
    "prows": f"SELECT * FROM lrows WHERE NOT regexp_matches(text, '{PAGE_NUMBER}') OR (row_idx > 1 AND row_idx < row_count - 2)",
    "fonts": """SELECT doc_id, body_h, CASE WHEN top > body_h THEN top ELSE round(body_h * 1.15, 6) END AS heading_h FROM (SELECT doc_id, arg_max(b, n * 1000 - b) AS body_h, max(b) FILTER (k = CASE WHEN kinds >= 4 THEN floor(kinds * 0.75) WHEN kinds >= 2 THEN kinds - 1 END) AS top FROM (
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS kinds FROM (SELECT doc_id, floor(h * 2 + 0.5) / 2 AS b, count(*) AS n FROM prows GROUP BY ALL)) GROUP BY doc_id)""",
    "toc": "SELECT doc_id, page, CASE WHEN page % 2 = 1 THEN t[1:20] ELSE 'Part ' || page END AS toc FROM (SELECT doc_id, page, arg_min(text, row_idx) AS t FROM lrows WHERE page % 3 = 1 GROUP BY ALL)",
}
_MED = lambda v, src: f"(SELECT doc_id, list_sort(list({v}))[count(*) // 2 + 1] AS m FROM {src} GROUP BY doc_id)"
ORACLES = {
    "layout_page_numbers": with_views("SELECT doc_id, page, row_idx, text FROM prows", **_V),
    "layout_font_clusters": with_views("SELECT doc_id, body_h, heading_h FROM fonts", **_V),
    "layout_headings": with_views(
        f"""SELECT doc_id, page, row_idx, text, lk OR promoted AS heading, CASE WHEN starts AND NOT lk AND NOT promoted THEN toc END AS injected, gap > greatest(coalesce(mg, 12) * 2.5, mh * 2.4) OR (is_first AND page > 1 AND (lk OR toc IS NOT NULL)) AS breaks FROM (
SELECT *, is_first AND toc IS NOT NULL AS starts, is_first AND toc IS NOT NULL AND coalesce((length(a) >= 3 AND length(b) >= 3 AND (contains(a, b) OR contains(b, a))) OR h >= heading_h, false) AS promoted FROM (
SELECT *, {_LIKE} AS lk FROM (SELECT r.*, heading_h, mh.m AS mh, mg.m AS mg, toc, row_number() OVER (PARTITION BY r.doc_id, r.page ORDER BY row_idx) = 1 AS is_first, len(regexp_split_to_array(text, ' +')) AS words, regexp_replace(text, '[^a-zA-Z]', '', 'g') AS letters,
len(list_filter(regexp_split_to_array(text, ' +'), lambda w: regexp_matches(w, '^[A-Z]'))) AS capital, trim(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'))[1:24] AS a, trim(regexp_replace(lower(toc), '[^a-z0-9 ]', '', 'g'))[1:24] AS b
FROM prows r JOIN fonts USING (doc_id) JOIN {_MED("h", "prows")} mh USING (doc_id) LEFT JOIN {_MED("gap", "prows WHERE gap > 0")} mg USING (doc_id) LEFT JOIN toc t ON t.doc_id = r.doc_id AND t.page = r.page)))""", **_V
    ),
    "styled_headings": with_views(
        f"""SELECT doc_id, line_no, line_no % 10 = 0 OR (line_no % 3 = 1 AND length(t) > 2 AND length(t) < 70 AND size >= 1.25 * m) OR {T.sql_is_heading("t")} AS heading FROM styled JOIN {_MED("size", "styled")} USING (doc_id)""",
        styled="SELECT doc_id, line_no, CASE WHEN line_no % 6 = 1 THEN 15.0 ELSE 11.0 END AS size, trim(text) AS t FROM lines WHERE trim(text) <> ''",
    ),
    "slides_to_lines": with_views(
        """SELECT conv_id, slide, CASE WHEN k = 0 THEN -1 ELSE k END::INT AS k, CASE WHEN k = 0 THEN 'Slide ' || (slide + 1) || ': ' || item ELSE item END AS text, k = 0 AS heading FROM items""",
        items="SELECT conv_id, turn AS slide, unnest(range(len(p))) AS k, unnest(p) AS item FROM (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[.] |\\n'), lambda x: trim(x)), lambda x: x <> '') AS p FROM conversations)",
    ),
    "spine_assemble": with_views(
        f"""WITH flags AS (SELECT page_id, max(t2 IN ('h1', 'h2')) AS has_head, max(length(text) > 40) AS has_text FROM rows2 GROUP BY page_id),
kept AS (SELECT p.*, has_head FROM (SELECT page_id, page_id // {SPINE} AS book, row_number() OVER (PARTITION BY page_id // {SPINE} ORDER BY page_id) AS item, url FROM pages) p JOIN flags USING (page_id) WHERE page_id % 7 <> 3 AND item <= {SPINE} AND has_text)
SELECT book, item, -1 AS line_no, regexp_replace(regexp_extract(url, '([^/]+)$', 1), '[-_]', ' ', 'g') AS text, true AS heading FROM kept WHERE NOT has_head
UNION ALL SELECT book, item, line_no, text, t2 IN ('h1', 'h2') FROM rows2 JOIN kept USING (page_id)""",
        **ingest._V, rows2="SELECT *, CASE WHEN tag = 'h1' AND page_id % 4 = 0 THEN 'h4' ELSE tag END AS t2 FROM hlines",
    ),
}
