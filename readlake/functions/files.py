"""What a file is by its first bytes, its name and its size, and the text of its bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readlake.functions.html import HIGH
from readlake.params import FORMATS, UPLOAD_LIMIT_MB


def file_format(head: Column, ext: Column, mime: Column) -> Column:
    """First bytes (hex) win, then the extension; MIME alone counts only where there is no extension."""
    kind = F.when(head.startswith("25504446"), "pdf")
    zipped = head.startswith("504B")
    for name in ("epub", "docx", "pptx"):
        kind = kind.when(zipped & ext.isin(*dict((f[0], f[1]) for f in FORMATS)[name]), name)
    for name, part in (("epub", "epub"), ("docx", "wordprocessingml"), ("pptx", "presentationml")):
        kind = kind.when(zipped & F.contains(mime, F.lit(part)), name)
    kind = kind.when(zipped, F.lit(None))
    for name, exts, _ in FORMATS:
        kind = kind.when(ext.isin(*exts), name)
    for name, _, kind_of in FORMATS:
        kind = kind.when((ext == "") & (mime == kind_of), name)
    return F.coalesce(kind, F.lit("unknown"))


def reject_code(ext: Column, size: Column) -> Column:
    """Why a file is refused, or null."""
    every = [e for _, exts, _ in FORMATS for e in exts]
    return F.when(~ext.isin(*every), "type").when(size > UPLOAD_LIMIT_MB * 1024 * 1024, "size").when(size == 0, "empty")


def decoded(raw: Column) -> Column:
    """Bytes as UTF-8 where they are valid, else as Windows-1252."""
    latin = F.translate(F.decode(raw, "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), HIGH)
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(latin)
