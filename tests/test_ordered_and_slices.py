"""Operators on long histories against plain windows, part ends against a fold, slices on disk, and what people read."""

from __future__ import annotations

import glob
import os
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readlake.functions import text as T
from readlake.operators.keyed import overwrite_slices
from readlake.operators.ordered import with_neighbour, with_running_sums, with_window_of
from readlake.plans import ingest, registry, scalars
from tests.oracle import rows


@pytest.fixture(scope="module")
def history(spark):
    rng = random.Random(3)
    return spark.createDataFrame([(k % 3, rng.randrange(300), k, rng.choice([None, 1, 2, 5])) for k in range(400)], "k long, at long, id long, v long").cache()


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_two_levels_equal_plain_windows(history, block):
    w = W.partitionBy("k").orderBy("at", "id")
    span = F.floor(F.col("at") / block)
    got = with_running_sums(history, ["k"], ["at", "id"], {"s": F.col("v"), "n": F.lit(1)}, span)
    want = history.withColumn("s", F.coalesce(F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))).withColumn("n", F.row_number().over(w))
    assert rows(got.toPandas()) == rows(want.toPandas())
    for ahead, shift in ((False, F.lag), (True, F.lead)):
        got = with_neighbour(history, ["k"], ["at", "id"], "v", "x", span, ahead)
        assert rows(got.toPandas()) == rows(history.withColumn("x", shift("v").over(w)).toPandas())
    got = with_window_of(history, ["k"], "at", block, {"n": F.count(F.lit(1)), "least": F.min("at")})
    r = W.partitionBy("k").orderBy("at").rangeBetween(-block, 0)
    assert rows(got.toPandas()) == rows(history.withColumn("n", F.count(F.lit(1)).over(r)).withColumn("least", F.min("at").over(r)).toPandas())


def test_no_window_over_a_whole_history_or_book(spark, sf):
    for name, keys in (("rate_window", {"user_id"}), ("build_chapters", {"book_id"}), ("fallback_split", {"book_id"}), ("finish_events", {"user_id", "doc_id"})):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.split("\n"):
            if "Window [" in line and ("_b" not in line and "_span" not in line):
                assert "text" not in line and "sec" not in line  # one row a block, or a document


@pytest.mark.parametrize("lines", [1, 3, 50])
def test_parts_equal_a_fold(spark, monkeypatch, lines):
    monkeypatch.setattr(ingest, "PART_WORDS", 20)
    monkeypatch.setattr(ingest, "LEAST_PART", 8)
    monkeypatch.setattr(ingest, "WHOLE", 30)
    monkeypatch.setattr(ingest, "LINES", lines)
    rng = random.Random(lines)
    books = {f"b{b}": [rng.randint(0, 12) for _ in range(rng.choice([1, 2, 9, 40]))] for b in range(30)}
    df = spark.createDataFrame([(b, k, w) for b, ws in books.items() for k, w in enumerate(ws)], "book_id string, k int, words int")
    want = []
    for b, words in books.items():
        part, opened, own = 0, 0, []
        for w in words:
            own.append(part)
            opened += w
            if opened >= 20:
                part, opened = part + 1, 0
        whole = sum(words) < 30
        if part and opened < 8:
            own = [min(p, part - 1) for p in own]
        want += [(b, k, 0 if whole else p, whole) for k, p in enumerate(own)]
    got = ingest.fallback_parts(df).select("book_id", "k", "part", "whole").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_slices_on_disk_leave_other_files_alone(spark, tmp_path):
    path = str(tmp_path / "scenes")
    spark.createDataFrame([(d, c, f"old {d} {c}") for d in range(3) for c in range(3)], "doc int, chapter int, t string").write.partitionBy("doc", "chapter").parquet(path)
    before = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/doc=*/chapter=*/*.parquet")}
    overwrite_slices(spark.createDataFrame([(1, 2, "new"), (1, 2, "newer"), (7, 0, "added")], "doc int, chapter int, t string"), path, ["doc", "chapter"])
    after = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/doc=*/chapter=*/*.parquet")}
    assert {p for p in before if p not in after} == {p for p in before if "doc=1/chapter=2/" in p} and all(after[p] == before[p] for p in before if p in after)
    found = spark.read.parquet(path)
    assert sorted(r["t"] for r in found.where("doc = 1 and chapter = 2").collect()) == ["new", "newer"] and found.count() == 11


def test_titles_stand_as_in_a_dictionary(spark):
    titles = ["Zebra", "apple", "Éclair", "eagle", "Apple", "echo", "Ångström", "banana"]
    got = [r["t"] for r in spark.createDataFrame([(t,) for t in titles], "t string").orderBy(F.collate("t", "UNICODE")).collect()]
    assert got == ["Ångström", "apple", "Apple", "banana", "eagle", "echo", "Éclair", "Zebra"]


def curled(text: str) -> str:
    """Quotes curled by what stands beside them, character by character."""
    out = []
    for k, c in enumerate(text):
        before, after = text[k - 1] if k else " ", text[k + 1] if k + 1 < len(text) else " "
        opens = before.isspace() and not after.isspace()
        letters = before.isascii() and before.isalpha() and after.isascii() and after.isalpha()
        out.append(("“" if opens else "”") if c == '"' else ("’" if letters or not opens else "‘") if c == "'" else c)
    return "".join(out)


def test_quotes_equal_brute_force(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab \"'.,\n") for _ in range(rng.randint(0, 14))) for _ in range(400)]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(T.smart_quotes(F.col("t"))).collect()]
    assert got == [curled(t) for t in texts]


def test_what_people_read(spark):
    at = F.lit("2024-03-05 10:00:00").cast("timestamp")
    cases = {0: "just now", 59: "just now", 60: "1m ago", 3599: "59m ago", 3600: "1h ago", 86_399: "23h ago", 86_400: "1d ago", 604_800: "1w ago", 3_023_999: "4w ago", 3_024_000: "Mar 5"}
    got = spark.createDataFrame([(s,) for s in cases], "s long").select("s", scalars.ago(F.col("s"), at).alias("x")).collect()
    assert {r["s"]: r["x"] for r in got} == cases
    counts = {0: "0 words", 999: "999 words", 1000: "1.0k words", 12_345: "12.3k words", 1_250_000: "1.3M words"}
    got = spark.createDataFrame([(n,) for n in counts], "n long").select("n", scalars.counted(F.col("n")).alias("x")).collect()
    assert {r["n"]: r["x"] for r in got} == counts


def test_filters_need_one_scan_and_one_sort(spark, sf):
    plan = registry.queries()["library_filter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Sort [") == 1 and "Union" not in plan
