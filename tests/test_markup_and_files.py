"""HTML with nested elements and all kinds of references, and files as a source."""

from __future__ import annotations

import html
import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from readlake.functions import html as H
from readlake.plans import ingest
from readlake.sources import files


def lines_of(spark, *pages: str) -> list[list[tuple]]:
    df = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "page_id long, html string")
    found = [[] for _ in pages]
    for r in ingest.html_line_rows(df).orderBy("page_id", "line_no").collect():
        found[r["page_id"]].append((r["tag"], r["text"]))
    return found


def test_nested_elements(spark):
    got = lines_of(
        spark,
        "<body><aside>a<aside><p>inner</p></aside><p>tail of the outer</p></aside><p>kept</p></body>",
        "<article><p>one</p><article><p>reply</p></article><p>two</p></article><p>after</p>",
        "<main><p>x<aside>drop <nav>this</nav></aside>y</p></main><article><nav><p>menu</p></nav><h2>Title</h2><li>item<p>inside</p></li></article>",
        "<p>no container</p><aside><p>never closed stays</p>",
        "<body></nav><p>end tags that match nothing</p></aside><p>change nothing</p></body>",
        "<nav><article><p>in a menu</p></article></nav><article><p>the article</p></article><article><p>a second one</p></article>",
        '<body><p title="a > b">quoted</p><script>var x = "</p><aside>";</script><p>next</p></body>',
        "",
    )
    assert got == [
        [("p", "kept")], [("p", "one"), ("p", "reply"), ("p", "two")], [("h2", "Title"), ("li", "item"), ("p", "inside")], [("p", "no container"), ("p", "never closed stays")],
        [("p", "end tags that match nothing"), ("p", "change nothing")], [("p", "the article")], [("p", "quoted"), ("p", "next")], [],
    ]


def test_references(spark):
    texts = [
        "&#233;&#x4e2d;&#X4E2D;&#233", "&eacute;&copy;&nbsp;&middot;&hellip;", "&amp;lt; &amp;amp;", "&unknown; & alone &", "&#150;&#x93;quoted&#148;", "&#0;&#xD800;&#1114112;", "&#x1F600;", "a &lt;b&gt; &quot;c&quot; &apos;", "", "plain",
    ]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(H.unescaped(F.col("t"))).collect()]
    assert got == [html.unescape(t) for t in texts]


class Reader(HTMLParser):
    """Blocks outside dropped elements, by a parser that counts depths."""

    def __init__(self):
        super().__init__()
        self.depth, self.blocks, self.open = 0, [], False

    def handle_starttag(self, tag, attrs):
        if tag in ("aside", "nav"):
            self.depth += 1
        elif tag in ingest.BLOCKS and not self.depth:
            self.blocks.append([tag, ""])
            self.open = True

    def handle_endtag(self, tag):
        if tag in ("aside", "nav"):
            self.depth -= 1
        elif tag in ingest.BLOCKS and not self.depth:
            self.open = False

    def handle_data(self, data):
        if not self.depth and self.open:
            self.blocks[-1][1] += data


def test_random_pages_equal_a_parser(spark):
    rng = random.Random(8)

    def made(depth: int) -> str:
        parts = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice(["p", "h2", "aside", "nav", "div", "text"])
            inner = made(depth - 1) if depth and kind in ("aside", "nav", "div") else f"w{rng.randrange(1000)} &#x{rng.randrange(0x4E00, 0x4F00):x}; <b>bold</b>"
            parts.append(inner if kind == "text" else f"<{kind} class='x'>{inner}</{kind}>")
        return "".join(parts)

    pages = [f"<body>{made(4)}</body>" for _ in range(60)]
    want = []
    for p in pages:
        reader = Reader()
        reader.feed(p)
        want.append([(t, " ".join(x.split())) for t, x in reader.blocks if len(" ".join(x.split())) >= 2])
    assert lines_of(spark, *pages) == want


def test_a_folder_of_mixed_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("readlake.sources.files.UPLOAD_LIMIT_MB", 1)
    monkeypatch.setattr("readlake.functions.files.UPLOAD_LIMIT_MB", 1)
    folder = tmp_path / "in" / "deeper"
    folder.mkdir(parents=True)
    given = {
        "note.txt": "naïve café".encode(), "old.txt": b"\x93quoted\x94", "page.HTM": b"<p>x</p>", "really.txt": b"%PDF-1.7 ...", "book.epub": b"PK\x03\x04zip", "zip.txt": b"PK\x03\x04zip", "empty.md": b"", "huge.md": b"x" * (1 << 20) + b"y",
        "tool.exe": b"MZ", "noext": b"plain",
    }
    for name, content in given.items():
        (folder / name).write_bytes(content)
    got = {r["name"]: (r["format"], r["reject_code"]) for r in files.file_verdicts(spark, str(tmp_path / "in")).collect()}
    assert got == {
        "note.txt": ("txt", None), "old.txt": ("txt", None), "page.HTM": ("html", None), "really.txt": ("pdf", None), "book.epub": ("epub", None), "zip.txt": ("unknown", "type"), "huge.md": (None, "size"),
        "tool.exe": (None, "type"), "noext": (None, "type"),
    }
    files.take_in(spark, str(tmp_path / "in"), f"{tmp_path}/good", f"{tmp_path}/bad")
    kept = {r["name"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/good").collect()}
    assert kept == {"note.txt": "naïve café", "old.txt": "“quoted”", "page.HTM": "<p>x</p>", "really.txt": None, "book.epub": None}
    assert {r["name"] for r in spark.read.parquet(f"{tmp_path}/bad").collect()} == {"zip.txt", "huge.md", "tool.exe", "noext"}
    plan = files.file_verdicts(spark, str(tmp_path / "in"))._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,1048576)" in plan
