"""HTML as tag events: which pieces of a page stand inside which elements, and what character references mean."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Windows-1252's characters for 0x80-0x9F, which references to these numbers mean too.
HIGH = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
RAW = ("script", "style", "noscript", "iframe")  # elements whose content isn't markup
_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+"""


def character(code: Column) -> Column:
    """The character of a code point; what isn't one is U+FFFD."""
    bytes_of = F.unhex(F.lpad(F.hex(code), 8, "0"))
    known = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    high = F.element_at(F.array(*map(F.lit, HIGH)), F.when(code.between(0x80, 0x9F), (code - 0x7F).cast("int")).otherwise(1))
    return F.when(~known, "\ufffd").when(code.between(0x80, 0x9F), high).otherwise(F.decode(F.when(known, bytes_of), "UTF-32"))


def unescaped(col: Column) -> Column:
    """Character references decoded once, from left to right: named ones, decimal and hexadecimal ones."""
    names = F.from_json(F.lit(json.dumps({name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"})), "map<string,string>")

    def piece(text: Column, k: Column) -> Column:
        reference = F.regexp_extract(text, r"^(#[xX][0-9a-fA-F]{1,6};?|#[0-9]{1,7};?|[A-Za-z][A-Za-z0-9]*;)", 1)
        digits = F.regexp_replace(reference, "[#xX;]", "")
        hexed = F.lower(F.substring(reference, 2, 1)) == "x"
        code = F.when(hexed, F.conv(digits, 16, 10)).otherwise(F.when(reference.startswith("#"), digits)).cast("long")
        meant = F.when(reference.startswith("#"), character(code)).otherwise(F.element_at(names, F.regexp_replace(reference, ";", "")))
        rest = F.substr(text, F.length(reference) + 1)
        return F.when((k == 0) | (reference == "") | meant.isNull(), F.when(k == 0, text).otherwise(F.concat(F.lit("&"), text))).otherwise(F.concat(meant, rest))

    return F.when(F.contains(col, F.lit("&")), F.array_join(F.transform(F.split(col, "&"), piece), "")).otherwise(col)


def tag_events(pages: DataFrame, key: str, html: str, names) -> DataFrame:
    """key, pos, tag (``name`` or ``/name``, null before the first), text: a page cut at the tags of some elements.

    Comments, the content of RAW elements and all other tags are left out.  An element that isn't in ``names`` cuts
    nothing.
    """
    bare = F.regexp_replace(html, rf"(?is)<!--.*?-->|<({'|'.join(RAW)})(?:\s{_ATTRIBUTES})?>.*?</\1\s*>", "")
    cut = F.regexp_replace(bare, rf"(?i)<(/?)({'|'.join(names)})(?:[\s/]{_ATTRIBUTES})?>", "\x01$1$2\x02")
    clean = F.regexp_replace(cut, rf"<[/!?a-zA-Z]{_ATTRIBUTES}>", "")
    rows = pages.select(key, F.split(clean, "\x01").alias("pieces")).select(key, F.posexplode("pieces").alias("pos", "piece"))
    tag = F.when(F.contains("piece", F.lit("\x02")), F.lower(F.substring_index("piece", "\x02", 1)))
    return rows.select(key, "pos", tag.alias("tag"), F.substr("piece", F.instr("piece", "\x02") + 1).alias("text"))


def with_depths(events: DataFrame, key: str, dropped, scopes) -> DataFrame:
    """Adds ``inside``, the depth in ``dropped`` elements, and ``scope_<name>``, true in the first element of that name.

    Tags are matched by name, like brackets: the levels of a page's own tags are running sums, an end tag that goes
    below all levels before it matches nothing, and a start tag below whose level nothing comes is never closed.
    Dropped elements that are never closed drop nothing; scopes that are never closed reach the page's end.
    """
    name = F.regexp_replace("tag", "^/", "")
    own = W.partitionBy(key, "name").orderBy("pos")
    page = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    e = events.withColumn("name", name).withColumn("step", F.when(F.col("name").isin(*dropped, *scopes), F.when(F.col("tag").startswith("/"), -1).otherwise(1)).otherwise(0))
    e = e.withColumn("level", F.sum("step").over(own))
    before = F.least(F.lit(0), F.coalesce(F.min("level").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    after = F.min("level").over(own.rowsBetween(1, W.unboundedFollowing))
    closed = (F.col("step") == 1) & F.coalesce(after < F.col("level"), F.lit(False))
    opened = (F.col("step") == -1) & (F.col("level") >= before)
    e = e.withColumn("matched", closed | opened)
    e = e.withColumn("inside", F.coalesce(F.sum(F.when(F.col("name").isin(*dropped) & F.col("matched"), F.col("step"))).over(page), F.lit(0)))
    for scope in scopes:
        here = (F.col("name") == scope) & (F.col("inside") == 0) & (F.col("matched") | (F.col("step") == 1))
        e = e.withColumn("_depth", F.coalesce(F.sum(F.when(here, F.col("step"))).over(page), F.lit(0)))
        first = F.coalesce(F.sum(F.when(here & (F.col("step") == 1) & (F.col("_depth") == 1), 1)).over(page), F.lit(0)) == 1
        e = e.withColumn(f"scope_{scope}", first & (F.col("_depth") > 0))
    return e.drop("name", "step", "level", "matched", "_depth")
