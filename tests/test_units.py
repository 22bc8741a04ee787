"""One small case for each rule that tables of prose don't exercise."""

from __future__ import annotations

from pyspark.sql import functions as F

from readlake.functions import text as T
from readlake.operators.keyed import cascade, latest_by_key, patched, replaced_slice
from readlake.operators.ordered import with_island_start
from readlake import params
from readlake.plans import scalars


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first()["x"]


def test_sentences(spark):
    cases = {
        "The garden. It grew.": ["The garden.", "It grew."],
        "A cat. It sat.": ["A cat. It sat."],
        "No! Yes.": ["No!", "Yes."],
        "It costs 3.14 today. Fine.": ["It costs 3.14 today.", "Fine."],
        "We waited. then left.": ["We waited. then left."],
        "First part\n\nSecond part": ["First part", "Second part"],
        "She said “Wait! It burns. Truly?” and left. Nobody answered.": ["She said “Wait! It burns. Truly?” and left. Nobody answered."],
        "“Begin here. Then stop.” They obeyed. Silence!": ["“Begin here. Then stop.” They obeyed.", "Silence!"],
    }
    for text, wanted in cases.items():
        assert list(one(spark, text, T.sentences)) == wanted


def test_headings(spark):
    yes = ["Chapter one", "Kapitel 3", "The Third Book", "第三章 风", "XII)", "IV", "7. Arrival", "DRAMATIS PERSONAE", "IV. The Return"]
    no = ["Chapter one.", "x", "A" * 81, "ROOM 1234 KEYS", "It was late and we left", "7. " + "w " * 12]
    assert [x for x in yes if not one(spark, x, T.is_heading)] == []
    assert [x for x in no if one(spark, x, T.is_heading)] == []


def test_clean_and_join(spark):
    assert one(spark, "a . . . b  –  c ,\x07d", T.clean_inline) == "a … b—c,d"
    assert one(spark, "won-\nder and\nHalf-\nTime", lambda c: T.join_lines(F.split(c, "\n"))) == "wonder and Half- Time"


def test_smart_quotes(spark):
    assert one(spark, "\"Hi,\" she said, 'it's' don't", T.smart_quotes) == "“Hi,” she said, ‘it’s’ don’t"


def test_title_case_truncation_language(spark):
    assert one(spark, "the house of salt", T.title_case) == "The House of Salt"
    assert one(spark, "NASA report", T.title_case) == "NASA report"
    assert one(spark, "a b c d", lambda c: T.truncate_words(c, 2)) == "a b…"
    assert one(spark, "", T.detect_language) == "und"


def test_fnv(spark):
    assert one(spark, "abc", T.fnv1a) == 440920331


def test_json_payload(spark):
    body, step = scalars.json_payload_of(F.col("t"))
    raw = 'Sure ```json\n{"a": "x } \\" {", "b": [1, {"c": 2}]} trailing } prose'
    df = spark.createDataFrame([(raw,), ("none",), ('{"a": 1',)], "t string").select(body.alias("body"))
    df = df.select("body", F.expr(f"aggregate(split(body, ''), named_struct('n', 0, 'depth', 0, 'text', false, 'esc', false, 'done', false), {step})").alias("a"))
    got = [r[0] for r in df.select(F.when(F.col("a.done"), F.expr("substring(body, 1, a.n)"))).collect()]
    assert got == ['{"a": "x } \\" {", "b": [1, {"c": 2}]}', None, None]


def test_question_intent_prefers_theme_over_define():
    patterns = dict(params.INTENTS)
    import re

    assert re.search(patterns["theme"], "meaning of") and list(patterns).index("theme") < list(patterns).index("define")


def test_keyed_changes(spark):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, ver int")
    delta = spark.createDataFrame([(2, "c", 1), (3, "d", 1)], "k int, v string, ver int")
    assert sorted(map(tuple, latest_by_key(base, delta, "k", "ver").select("k", "v").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    patch = spark.createDataFrame([(1, None), (2, "z")], "k int, v string")
    assert sorted(map(tuple, patched(base.select("k", "v"), patch, "k").collect())) == [(1, "a"), (2, "z")]
    left = cascade({"base": base}, spark.createDataFrame([(1,)], "k int"), "k")["base"]
    assert [r["k"] for r in left.collect()] == [2]
    new = spark.createDataFrame([(2, "n", 7), (2, "m", 9)], "k int, v string, ver int")
    assert sorted(map(tuple, replaced_slice(base, new, ["k"], "ver").collect())) == [(1, "a", 0), (2, "m", 1), (2, "n", 0)]


def test_islands_do_not_depend_on_buckets(spark):
    rows = [(1, t, i) for i, t in enumerate([0, 5, 9, 40, 45, 200, 205, 209, 300])] + [(2, 7, 99)]
    df = spark.createDataFrame(rows, "k int, t long, i int")
    want = {0: 0, 1: 0, 2: 0, 3: 40, 4: 40, 5: 200, 6: 200, 7: 200, 8: 300, 99: 7}
    for bucket in (3, 10, 1000):
        got = {r["i"]: r["island"] for r in with_island_start(df, "k", "t", ["i"], 10, bucket).collect()}
        assert got == want


def test_throttle_emits_at_exactly_the_limit(spark):
    from readlake.plans.ledger import throttled

    s = 1_000_000
    df = spark.createDataFrame([(1, k, t * s) for k, t in enumerate([0, 599, 600, 900, 1199, 1200])], "user_id long, event_id long, at long")
    assert sorted(r["event_id"] for r in throttled(df).collect()) == [0, 2, 5]


def test_quotes_query(spark, sf):
    from readlake.plans.scalars import quotes

    r = quotes(spark, sf).first()
    assert (r["opened"], r["closed"], r["single"]) == (1, 1, 1) and r["apostrophes"] >= 2


def test_stores_are_appended_to_exported_and_cleared(spark, tmp_path):
    from readlake.operators.stores import append_rows, clear_stores, export_stores

    log, out = f"file://{tmp_path}/log", f"file://{tmp_path}/out"
    for k in (1, 2):
        append_rows(spark.createDataFrame([(k, None)], "k int, note string"), log)
    rows = spark.read.parquet(log)
    assert sorted(r["k"] for r in rows.collect()) == [1, 2]
    export_stores({"log": rows}, out)
    assert sorted(r["value"] for r in spark.read.text(f"{out}/log/store=log").collect()) == ['{"k":1,"note":null}', '{"k":2,"note":null}']
    clear_stores(spark, [log])
    assert spark.read.parquet(log).count() == 0 and spark.read.parquet(log).columns == ["k", "note"]
