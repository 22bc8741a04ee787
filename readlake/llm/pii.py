"""Personal data: patterns propose spans, validators confirm them, context words adjust their score.

Everything is built from SQL functions.  A kind's matches and the gaps between them (``regexp_extract_all``
and ``split`` with one pattern) give each match's place in code points; places are summed in blocks, so a
text with very many matches costs little more than its length.  Patterns use possessive repeats and anchor
each run of characters at its start (or at the last match's end), so no text is scanned more than once.

Base kinds (email, ip, card, phone) are kept when their validator holds.  The method adds
iban (mod 97), ssn, intl and tel (numbers that the base's phone misses, as where it runs on into other digits)
and secret (tokens and keys, by their entropy), which need a score of KEEP: the kind's own, raised by a
context word close by.  For ssn, tel and secret the context decides.  An added span that overlaps a base span
or one of a kind before it is dropped.

Cases: null text is empty and has no spans; every row has its result, repeated rows alike; columns other
than doc_id and text are ignored by the query and carried by ``stage``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.llm.common import table

BLOCK = 256  # matches whose places are summed at a time
NEAR = 48  # characters before and after in which context words count
KEEP = 0.6
CONTEXT = 0.3

_SPANS = "array<struct<start:int,stop:int,value:string>>"
_DIGITS = "regexp_replace(s.value, '[^0-9]', '')"
_LUHN = (
    "aggregate(sequence(1, length(d)), 0, (a, i) -> a + element_at(array(0,1,2,3,4,5,6,7,8,9,0,2,4,6,8,1,3,5,7,9), "
    "cast(substring(d, length(d) - i + 1, 1) as int) + 1 + 10 * ((i + 1) % 2))) % 10 = 0"
)
_MOD97 = (
    "aggregate(split(concat(substring(d, 5), substring(d, 1, 4)), ''), 0, (a, c) -> case when c = '' then a "
    "when c between '0' and '9' then (a * 10 + ascii(c) - 48) % 97 else (a * 100 + ascii(c) - 55) % 97 end) = 1"
)


SECRET, BITS = 200, 3.0  # longest secret; bits of entropy that a character of one has at least
_ENTROPY = "-aggregate(transform(array_distinct(split(s.value, '')), c -> (length(s.value) - length(replace(s.value, c, ''))) / length(s.value)), 0D, (a, p) -> a + p * log2(p))"


def _with(value: str, test: str) -> str:
    """``test`` over d, bound once to ``value``."""
    return f"element_at(transform(array({value}), d -> {test}), 1)"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    probe: str  # cheap condition on text that every match needs
    valid: str  # condition on the span s
    score: float
    words: str  # context words (lower case)
    base: bool = False


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')", "true", 0.9, "mail|contact", True),
    Kind(
        "ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "contains(text, '.')",
        "forall(split(s.value, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', right(p, 3)) as int) <= 255)", 0.7, "ip|host|address|server", True,
    ),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", "true", _with(_DIGITS, f"length(d) between 16 and 19 and {_LUHN}"), 0.8, "card|visa|master|payment", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "contains(text, '+')", f"length({_DIGITS}) between 8 and 15", 0.7, "phone|tel|call|mobile|fax", True),
    Kind(
        "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "text rlike '[A-Z]{2}[0-9]{2}'",
        _with("replace(s.value, ' ', '')", f"length(d) between 15 and 34 and {_MOD97}"), 0.6, "iban|account|konto|bank",
    ),
    Kind(
        "ssn", r"[0-9][0-9-]{10}[0-9-]*+", "text rlike '[0-9]-[0-9]{2}-[0-9]'",
        "s.value rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$' and substring(s.value, 1, 3) not in ('000', '666') and substring(s.value, 1, 1) <> '9' and substring(s.value, 5, 2) <> '00' and right(s.value, 4) <> '0000'",
        0.3, "ssn|social|security",
    ),
    Kind(
        "intl", r"\+[0-9]{1,3}[ .-]?[(]?[0-9]{2,4}[)]?[ .-][0-9]{3}[ .-][0-9]{4}[0-9-]*+", "contains(text, '+')",
        r"s.value rlike '[^0-9][0-9]{4}$'", 0.7, "phone|tel|call|mobile|fax",
    ),
    Kind(
        "tel", r"(?<![0-9(+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])", "text rlike '[0-9]{3}[ .-][0-9]{4}'",
        "true", 0.3, "phone|tel|call|mobile|fax",
    ),
    Kind(
        "secret", r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{24,}+", "true",
        f"length(s.value) <= {SECRET} and length({_DIGITS}) >= 3 and length({_DIGITS}) < length(s.value) and {_ENTROPY} >= {BITS}", 0.35, "token|secret|key|password|passwd|credential|bearer|auth",
    ),
)
BASE = tuple(k.name for k in KINDS if k.base)


def _matches(df: DataFrame, kind: Kind) -> DataFrame:
    """Adds h_NAME, the kind's matches, and g_NAME, the gaps before each and after the last."""
    pattern = kind.pattern.replace("\\", "\\\\")
    df = df.withColumn(f"h_{kind.name}", F.expr(f"case when {kind.probe} then regexp_extract_all(text, '{pattern}', 0) else cast(array() as array<string>) end"))
    return df.withColumn(f"g_{kind.name}", F.expr(f"case when size(h_{kind.name}) > 0 then split(text, '{pattern}', -1) else cast(array() as array<string>) end"))


def _placed(df: DataFrame, kind: Kind) -> DataFrame:
    """Adds p_NAME: the matches with their places."""
    g, h = f"g_{kind.name}", f"h_{kind.name}"
    before = f"aggregate(slice({g}, 1, b * {BLOCK}), 0, (a, x) -> a + length(x)) + aggregate(slice({h}, 1, b * {BLOCK}), 0, (a, x) -> a + length(x))"
    block = f"""aggregate(
        zip_with(slice({g}, b * {BLOCK} + 1, least({BLOCK}, size({h}) - b * {BLOCK})), slice({h}, b * {BLOCK} + 1, {BLOCK}), (g, h) -> named_struct('g', length(g), 'h', h)),
        named_struct('pos', {before}, 'out', cast(array() as {_SPANS})),
        (a, x) -> named_struct('pos', a.pos + x.g + length(x.h), 'out', concat(a.out, array(named_struct('start', a.pos + x.g, 'stop', a.pos + x.g + length(x.h), 'value', x.h)))),
        a -> a.out)"""
    return df.withColumn(
        f"p_{kind.name}",
        F.expr(f"case when size({h}) > 0 then flatten(transform(sequence(0, cast((size({h}) - 1) / {BLOCK} as int)), b -> {block})) else cast(array() as {_SPANS}) end"),
    )


def _scored(kind: Kind, spans: str) -> str:
    near = f"lower(substring(text, greatest(s.start - {NEAR}, 0) + 1, s.stop - s.start + {2 * NEAR})) rlike '(^|[^a-z])({kind.words})'"
    return (
        f"transform(filter({spans}, s -> {kind.valid}), s -> named_struct('kind', '{kind.name}', 'start', s.start, 'stop', s.stop, 'value', s.value, "
        f"'score', cast({kind.score} + case when {near} then {CONTEXT} else 0.0 end as double)))"
    )


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, stop, value, score) of each document."""
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for kind in KINDS:
        df = _placed(_matches(df, kind), kind)
    df = df.withColumn("base", F.expr(f"concat({', '.join(_scored(k, f'p_{k.name}') for k in KINDS if k.base)})"))
    df = df.withColumn("added", F.expr("slice(base, 1, 0)"))
    for kind in (k for k in KINDS if not k.base):
        free = "not exists(base, b -> b.start < s.stop and s.start < b.stop) and not exists(added, b -> b.start < s.stop and s.start < b.stop)"
        more = f"concat(added, filter({_scored(kind, f'p_{kind.name}')}, s -> s.score >= {KEEP} and {free}))"
        df = df.withColumn("added", F.expr(f"case when size(h_{kind.name}) > 0 then {more} else added end"))
    return df.select("doc_id", "base", "added")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda x: f"array_join(transform({x}, s -> concat(s.kind, ':', s.start, ':', s.stop)), ',')"
    return spans(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE],
        F.expr("cast(size(added) as bigint)").alias("n_added"),
        F.expr(f"sha2(cast({listed('base')} as binary), 256)").alias("base_sha256"),
        F.expr(listed("concat(base, added)")).alias("spans"),
    )


#: Order in which kinds are masked: secrets, whose context other masks would change, then those that take in most characters.
MASK_ORDER = ("secret", "phone", "card", "iban", "email", "ip", "intl", "ssn", "tel")


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with each found span of text replaced by its kind in brackets; null text stays null."""
    kinds = {k.name: k for k in KINDS}
    df = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for kind in map(kinds.get, MASK_ORDER):
        df = _placed(_matches(df, kind), kind)
        good = f"({kind.valid})" + ("" if kind.base else f" and element_at({_scored(kind, 'array(s)')}, 1).score >= {KEEP}")
        put = f"zip_with(slice(g_{kind.name}, 1, size(h_{kind.name})), transform(p_{kind.name}, s -> case when {good} then '[{kind.name.upper()}]' else s.value end), (g, x) -> concat(g, x))"
        new = f"case when size(h_{kind.name}) = 0 then text else concat(array_join({put}, ''), element_at(g_{kind.name}, -1)) end"
        df = df.select("row", F.expr(new).alias("text"))
    return df.select(*[F.when(F.col("row.text").isNotNull(), F.col("text")).alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data masked and n_chars counted anew."""
    out = masked(docs)
    if "n_chars" not in out.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType))


def _sql_spans(kind: str, pattern: str, test: str) -> str:
    return f"""
    (SELECT list(k || ':' || s || ':' || e ORDER BY s) FROM (
       SELECT '{kind}' AS k, v, g + coalesce(sum(g + length(v)) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, s + length(v) AS e, regexp_replace(v, '[^0-9]', '', 'g') AS d
       FROM (SELECT unnest(h) AS v, unnest(list_transform(g[1:len(h)], lambda x: length(x))) AS g, unnest(range(len(h))) AS i
             FROM (SELECT regexp_extract_all(t, '{pattern}') AS h, string_split_regex(t, '{pattern}') AS g)))
     WHERE {test})"""


_SQL_LUHN = "list_sum(list_transform(range(length(d)), lambda i: [[0,1,2,3,4,5,6,7,8,9],[0,2,4,6,8,1,3,5,7,9]][1 + i % 2][1 + d[length(d) - i]::INT])) % 10 = 0"


def _sql_near(kind: str) -> str:
    words = next(k.words for k in KINDS if k.name == kind)
    return f"regexp_matches(lower(t[greatest(s - {NEAR}, 0) + 1 : greatest(s - {NEAR}, 0) + e - s + {2 * NEAR}]), '(^|[^a-z])({words})')"


_SQL_ENTROPY = "-list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: (length(v) - length(replace(v, c, ''))) / length(v) * log2((length(v) - length(replace(v, c, ''))) / length(v))))"
_SQL_SECRET = f"length(v) <= {SECRET} AND length(d) >= 3 AND length(d) < length(v) AND {_SQL_ENTROPY} >= {BITS} AND {_sql_near('secret')}"
_SQL_SSN = f"regexp_full_match(v, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') AND v[1:3] NOT IN ('000', '666') AND v[1] <> '9' AND v[5:6] <> '00' AND v[8:11] <> '0000' AND {_sql_near('ssn')}"
_SQL_FREE = lambda kind, *before: f"list_filter({kind}, lambda x: len(list_filter(email || ip || card || phone{''.join(' || ' + b for b in before)}, lambda b: split_part(b, ':', 2)::INT < split_part(x, ':', 3)::INT AND split_part(x, ':', 2)::INT < split_part(b, ':', 3)::INT)) = 0)"
#: The base kinds, and of the added ones those that need no look-around (ssn, intl, secret), as plain SQL; iban and tel have none in the test tables (see tests).
SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (
  SELECT doc_id,
    coalesce({_sql_spans("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "true")}, []) AS email,
    coalesce({_sql_spans("ip", "[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)", "list_bool_and(list_transform(string_split(v, '.'), lambda p: p::HUGEINT <= 255))")}, []) AS ip,
    coalesce({_sql_spans("card", "[0-9]([\\x20-]?[0-9])+", f"length(d) BETWEEN 16 AND 19 AND {_SQL_LUHN}")}, []) AS card,
    coalesce({_sql_spans("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", "length(d) BETWEEN 8 AND 15")}, []) AS phone,
    coalesce({_sql_spans("ssn", "[0-9][0-9-]{10}[0-9-]*", _SQL_SSN)}, []) AS ssn,
    coalesce({_sql_spans("intl", "\\+[0-9]{1,3}[ .-]?[(]?[0-9]{2,4}[)]?[ .-][0-9]{3}[ .-][0-9]{4}[0-9-]*", "regexp_matches(v, '[^0-9][0-9]{4}$')")}, []) AS intl,
    coalesce({_sql_spans("secret", "[A-Za-z0-9_+/-]{24,}", _SQL_SECRET)}, []) AS secret
  FROM t), f AS (SELECT *, {_SQL_FREE("ssn")} AS ssn1, {_SQL_FREE("intl", "ssn")} AS intl1, {_SQL_FREE("secret", "ssn", "intl")} AS secret1 FROM s)
SELECT doc_id, len(email) AS n_email, len(ip) AS n_ip, len(card) AS n_card, len(phone) AS n_phone, len(ssn1 || intl1 || secret1) AS n_added,
  sha256(array_to_string(email || ip || card || phone, ',')) AS base_sha256,
  array_to_string(email || ip || card || phone || ssn1 || intl1 || secret1, ',') AS spans
FROM f
"""
