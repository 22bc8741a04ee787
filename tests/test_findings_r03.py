"""What the findings of round 3 named, on tables that are just large or odd enough to show it."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from readlake.functions import text as T
from readlake.llm import common, near_dedup, packing
from readlake.plans import ingest, keywords, registry, streams
from readlake.sources import tables
from readlake.streaming import sources
from readlake.streaming.sources import file_stream
from tests import oracle


def equal_to_sql(spark, name: str, folder) -> None:
    oracle.check(registry.queries()[name](spark, str(folder)).toPandas(), registry.oracle_sql()[name], str(folder))


def write_documents(spark, folder, texts: list[str]) -> None:
    rows = [(k, t, "en", "src0", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")


def test_f2_parts_beyond_the_twelfth(spark, tmp_path):
    write_documents(spark, tmp_path, ["\n".join(["word " * 100] * 30) for _ in range(14)])
    equal_to_sql(spark, "fallback_split", tmp_path)


def test_f3_first_letters_whose_capitals_are_several(spark, tmp_path):
    write_documents(spark, tmp_path, [f"{c}ab cd" for c in "ßŉǰΐᾀᾳῃῼﬁﬆևéǆaZ1"] + ["", " ", "-ßx y", "straße ßß"])
    for name in ("initials", "title_case"):
        equal_to_sql(spark, name, tmp_path)


def test_f3_shared_step_in_themes_and_scenes(spark, tmp_path):
    write_documents(spark, tmp_path, ["ßabel ßabel ran far. ßabel came home.\n" * 3])
    for name in ("themes", "scene_slices"):
        equal_to_sql(spark, name, tmp_path)


def test_f4_digits_at_the_ends_of_quotes_and_items(spark, tmp_path):
    write_documents(spark, tmp_path, ['He said "0key 1000" to all. Then "1 and 11" came. And "2x2" or "another 22" too.\n' * 2])
    equal_to_sql(spark, "scene_slices", tmp_path)
    spark.createDataFrame([(1, 0, "user", "First. 1 for 1. 2 and 2. 3"), (1, 1, "assistant", "0 or 0")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    equal_to_sql(spark, "slides_to_lines", tmp_path)


def test_f5_pauses_of_about_an_hour(spark, tmp_path):
    """Pauses of just under, just and just over an hour, of whole seconds and of parts."""
    base, out = dt.datetime(2024, 1, 1), []
    for user, (first, pause) in enumerate((a, b) for a in (0.0, 0.25, 0.9) for b in (3599.0, 3599.1, 3599.2, 3599.999999, 3600.0, 3600.000001, 3600.9)):
        out += [(user, first), (user, first + pause), (user, first + 2 * pause), (user, first + 9000 + 2 * pause)]
    rows = [(k, u, "view", float(k), base + dt.timedelta(microseconds=round(s * 1e6))) for k, (u, s) in enumerate(out)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("props", F.lit("")).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("session_last", "stream_session_last"):
        equal_to_sql(spark, name, tmp_path)


def test_f5_a_part_of_several_files_is_one_batch(spark, sf, monkeypatch):
    monkeypatch.setattr(sources, "ROWS", 20)
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(7)
    path = sources.played_back(events, "ts", 3600, "event_id")
    seen = []
    sources.run_to_end(sources.part_stream(spark, path), "append", lambda df, batch: seen.append(df.where("event_id is not null").count()))
    assert sum(seen) == events.count() and len(seen) == sources.PARTS + 1 and seen[-1] == 0
    for name in ("stream_session_last", "stream_read_throttle", "stream_cache_state"):
        equal_to_sql(spark, name, sf)


def test_f5_a_part_without_rows_is_a_batch(spark):
    """Nothing arrives in the middle parts, yet later parts don't flow into them."""
    base = dt.datetime(2024, 1, 1)
    rows = [(k, base + dt.timedelta(hours=h)) for k, h in enumerate((0, 1, 98, 99, 100))]
    path = sources.played_back(spark.createDataFrame(rows, "id long, ts timestamp").repartition(3), "ts", 3600, "id")
    seen = []
    sources.run_to_end(sources.part_stream(spark, path), "append", lambda df, batch: seen.append(df.where("id is not null").count()))
    assert len(seen) == sources.PARTS + 1 and seen[0] == 2 and seen[4] == 3


def test_f1_no_python_stands_in_the_way_of_jobs(spark, sf):
    rows = file_stream(spark, f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("job_id"), F.lit("done").alias("status"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    plan = streams.job_stream(rows.withWatermark("ts", "1 hour"))._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "session_window" in plan


def test_f15_f16_state_is_by_bucket_and_not_by_row(spark):
    """2000 users with four events each: before, the state had a row for each waiting event and each user."""
    base = dt.datetime(2024, 1, 1)
    rows = [(k, k % 2000, "view", 1.0, base + dt.timedelta(seconds=k)) for k in range(8000)]
    path = sources.played_back(spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp"), "ts", 3600, "event_id")
    for made, mode, most in ((streams.throttled_stream, "append", 8 * streams.BUCKETS), (streams.cache_stream, "update", 20 * streams.SHARDS)):
        events = sources.part_stream(spark, path).withWatermark("ts", "1 hour")
        progress = sources.run_to_end(made(events), mode, lambda df, batch: df.count())
        assert 0 < max(sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress) <= most


def test_f22_f23_texts_are_shuffled_once_and_over_tasks_by_size(spark, sf, monkeypatch):
    """Before, every counted word was shuffled, over as many tasks whatever the input."""
    for name in ("tokens", "term_freq"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    found = []
    for share in (1 << 30, 1 << 12):
        monkeypatch.setattr(tables, "SHARE", share)
        found.append(tables.dealt(tables.table(spark, sf, "documents"), "doc_id").rdd.getNumPartitions())
    assert found[0] == spark.sparkContext.defaultParallelism < found[1]


def test_f6_f7_no_pair_of_a_bucket_is_lost(spark):
    """Ten pairs of near copies in one bucket, in an order that keeps copies apart: before, only those with a hub met."""
    rng = np.random.default_rng(6)
    shared, made = rng.integers(0, 1 << 32, 40, np.uint32), []
    for copy in range(2):
        for k in range(10):
            own = np.random.default_rng(k).integers(0, 1 << 32, 60, np.uint32)
            own[: 4 * copy] += np.uint32(1)
            made.append((copy * 10 + k, bytes([copy * 10 + k]) * 16, np.sort(np.concatenate([shared, own])).tobytes()))
    sets = spark.createDataFrame(made, "rid long, node binary, shingles binary")
    first = sets.select("rid", "node", F.lit(bytes(4 * near_dedup.BANDS * near_dedup.ROWS)).alias("samples"), F.lit(1.0).cast("float").alias("central"))
    flat = np.zeros((2, 1 << near_dedup.DF_BITS), np.float32)
    idf, spread = (spark.sparkContext.broadcast(x) for x in (flat + 1, flat))
    roots = {r["node"][0]: r["root"][0] for r in near_dedup.linked(first, sets, idf, spread).collect()}
    assert roots == {copy * 10 + k: k for copy in range(2) for k in range(10)}


def test_f17_f21_lines_are_cleaned_once(spark, sf):
    """Before, each paragraph was cleaned for the filter on its length and once more for its text."""
    plan = ingest.chapter_rows(tables.books(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(T.CLEAN_STEPS[6][0]) == 2  # a title's line, and any other's


def test_f17_f21_clean_texts_are_left_as_they_are(spark):
    odd = ["", "a", " a ", "a  b", "a\tb", "a\x0bb", "a\x00b", "ﬁ ﬂ ﬃ ﬄ", "a . . . b", "a....", "a..", "a — b", "a–b", "a ,b", "a )", "a] b", "a. b", "a\x7f", "a b", "a\n\nb", "a.\n.\n.", "a  . . ."]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select(T.clean_inline(F.col("t")).alias("a"), F.trim(T.replaced(F.col("t"), T.CLEAN_STEPS)).alias("b"))
    assert all(r["a"] == r["b"] for r in rows.collect())


def test_f9_f10_sentences_are_found_once(spark, sf):
    """Before, each part of an analysis and of a study set cut the texts into sentences anew."""
    for name in ("analysis", "study_set"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert T.SENTENCE_STEPS[1][0] not in plan


def test_f14_words_of_sentences_are_not_grouped_before_they_are_weighed(spark, sf):
    """Before, every word of every sentence, counted or not, went through an aggregate of its own."""
    docs = keywords.documents(spark, sf)
    plan = keywords.summaries(keywords.sentence_arrays(docs), ["doc_id"], 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2


def test_f9_f10_f14_sentences_without_words_that_count(spark, tmp_path):
    write_documents(spark, tmp_path, ["Of the and. It is so! \"(Anna) said,\" he. “Bob” said 'Carl' (Dora). Bob. Anna? Anna’s 12. A É.\n\nIt was. " * 2, "", "...", "of", "\"\" Anna \"\" said. Anna."])
    for name in ("summary", "analysis", "study_set", "arc_summary", "characters"):
        equal_to_sql(spark, name, tmp_path)


def test_op8_counters_are_fetched_by_few_jobs(spark, sf):
    """Before, each partition of the counters was a job of its own, 64 here, one after the other."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    sets = near_dedup.materialize(near_dedup.shingled(tables.table(spark, sf, "documents")), "test-shingles")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("op8-counters", "")
        n = near_dedup.document_frequencies(sets)[1]
        assert n == sets.count() and len(spark.sparkContext.statusTracker().getJobIdsForGroup("op8-counters")) < 10
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)


def test_op8_a_round_contracts_its_own_links_alone(spark, monkeypatch):
    """Before, every round went through all links of the rounds before it."""
    rng, schema, given = np.random.default_rng(8), "node binary, hub binary", []
    rounds = [[(bytes(rng.integers(0, 60, 1, np.uint8)), bytes(rng.integers(0, 60, 1, np.uint8))) for _ in range(n)] for n in (15, 6, 20)]
    rounds = [[(a, b) for a, b in links if a != b] for links in rounds]
    real = near_dedup.components
    monkeypatch.setattr(near_dedup, "components", lambda edges: given.append(edges.count()) or real(edges))
    labels = None
    for links in rounds:
        labels = near_dedup.joined(labels, spark.createDataFrame(links, schema))
    root = {x: x for links in rounds for pair in links for x in pair}
    for _ in root:
        for a, b in (pair for links in rounds for pair in links):
            root[a] = root[b] = min(root[a], root[b])
    assert {bytes(r["node"]): bytes(r["root"]) for r in labels.collect()} == root
    assert all(n <= len(links) for n, links in zip(given, rounds, strict=True)) and len(given) == 3


def test_f24_tasks_are_dealt_by_texts_and_not_by_their_files(spark, tmp_path):
    """Before, a text that a file held once for many rows counted once: copies made a task's share grow."""
    text, counts = "".join(f"word{k} " for k in range(20_000)), []
    for n in (30, 300):
        rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")).coalesce(1)
        rows.write.parquet(f"{tmp_path}/of {n}/documents.parquet")
        docs = tables.table(spark, f"{tmp_path}/of {n}", "documents")
        counts.append((tables.input_bytes(docs), tables.dealt(docs, "doc_id").rdd.getNumPartitions()))
    assert [c[0] for c in counts] == [30 * len(text), 300 * len(text)]
    assert counts[1][1] == -(-300 * len(text) // tables.SHARE) > counts[0][1] == spark.sparkContext.defaultParallelism


def test_pipeline_workers_return_memory(monkeypatch):
    """What a stage of the pipeline takes in a Python worker goes back while the task runs and at its end."""
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(rows))
    big = pa.RecordBatch.from_pydict({"text": ["word " * 200_000] * 10})
    rows = 0
    for part in common.small([big, big.slice(0, 1), big]):
        rows += part.num_rows
    assert rows == 21 and calls == [10, 21, 21]
    calls.clear()
    assert list(common.small([])) == [] and [x.num_rows for x in common.small([pa.RecordBatch.from_pydict({"text": ["a"]})])] == [1]
    assert calls == []


def test_pipeline_packs_distinct_words_in_lots(monkeypatch):
    """A text of many distinct words is looked up in lots, and its ids are those of the whole text."""
    from tokenizers import Tokenizer

    sizes, learn = [], packing.WordEncoder.learn
    monkeypatch.setattr(packing.WordEncoder, "learn", lambda self, words: sizes.append(len(words)) or learn(self, words))
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [f"{letters[k % 26]}{letters[k // 26 % 26]}{letters[k // 676 % 26]}{letters[k // 17576]}{'.' * (k % 3)}" for k in range(2 * packing.LOT + 9)]
    texts = [" ".join(words), None, "", " ".join(words[::-7])]
    path = packing.default_tokenizer()
    found = packing.WordEncoder(path).ids(pa.array(texts, pa.string()))
    assert len(sizes) == 3 and max(sizes) == packing.LOT  # the empty word is one more
    whole = Tokenizer.from_file(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
