"""What the findings of round 4 named, on tables that are just large or odd enough to show it."""

from __future__ import annotations

from readlake.functions import text as T
from readlake.plans import registry
from readlake.sources import tables
from tests.test_findings_r03 import equal_to_sql

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STOPS = "of the and to in on at by it is as if so no we us or an be he " * 3


def write(spark, folder, rows: list[tuple]) -> None:
    spark.createDataFrame([(k, t, "en", "src0", len(t or "")) for k, t in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")


def test_f1_a_chapter_is_worked_out_once(spark, sf):
    """Before, sentences were cut at eight places of the plan, some of them once a slice, and a text made lower-case for every word of a mood."""
    plan = registry.queries()["scene_slices"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(T.SENTENCE_STEPS[2][0]) == plan.count(T.TOKEN) == plan.count("lower(text") == 1
    assert len(plan) < 30_000  # 87,000 before at sf0.01: its code was too long to be compiled


def test_f1_texts_are_shuffled_once_and_by_their_size(spark, sf):
    """Before, they were shuffled line by line and chapter by chapter, for the names, the keywords and the scenes each, and words too."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.queries()["scene_slices"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    held = [line[line.index("hashpartitioning") :].split(", [plan_id")[0] for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(held) == 2 and all("REPARTITION_BY_NUM" in x for x in held)  # two readers of what is written once


def test_f1_names_by_one_mention(spark, tmp_path):
    """A name that is said once counts beside a verb of speech, unless the chapter has the word in small letters too."""
    texts = [
        "Anna said hello to all. The anna was there. Bertha said nothing at all.", "ANNA said so to them. Anna came along. The anna was there.", "Anna asked. Bob told. THE said it here. The the end of it.",
        "The Carl said it to them. A Dora added more. Never said that here. NEVER said this here. never.", "Emil said emil's. Fritz said “Fritz”. \"Gerda asked (Gerda) it,\" Hans shouted.", "Ida. Ida. ida. Jan. Jan said. jan jan.",
        "O'Neil said it well. o'neil. Éva said that. Eva muttered it. eva.", "Karl said.\nkarl\nMia said.\nmia was here.\nNo. Mia.\nKarl said.\nKarl too. Olga answered them. olga",
    ]
    write(spark, tmp_path, list(enumerate(texts)))
    equal_to_sql(spark, "scene_slices", tmp_path)


def test_f1_first_keywords(spark, tmp_path):
    """A word that occurs once is the keyword only if none occurs twice; words of no count stand before it, as many as may be."""
    texts = [
        f"{STOPS}zebra yak.", f"{STOPS}.", f"{STOPS}zebra yak yak zebra.", "yak zebra zebra.", "Yak said zebra. Zebra.", "ok go up.", "1234 99 ab'c ab'c.", f"{STOPS}. Once ßabel ßabel.", "One. The THE Yak. YAK.", "Said Ann. Ann? Bob!",
    ]
    write(spark, tmp_path, list(enumerate(texts)))
    equal_to_sql(spark, "scene_slices", tmp_path)


def test_f1_moods_by_words_within_words(spark, tmp_path):
    texts = [
        "A threathreat here. It was no embracembrace at all. A deskind too.", "Ash ash ASHEN lash. Threat. Kindly kindred.", "Nightfallasleep breakfastmidday. Owl owl. Lunchlunch supper.", "Bedbed path. Meadow cliff beach.", "ﬁne İstanbul kindﬁ. Desk.",
        "Laugh and smile. " * 40 + "Danger, alarm. " * 60 + "Love " * 900 + ". " + "Ruin here. " * 300,
    ]
    write(spark, tmp_path, list(enumerate(texts)))
    for name in ("scene_slices", "mood_class"):
        equal_to_sql(spark, name, tmp_path)


def test_f1_documents_without_text_id_or_sentences(spark, tmp_path):
    """Before, documents without an id had scenes here and none in the SQL."""
    long = "\n".join(f"Line {k} says more of it. Karl said “what is this {k}” to them. It went on and on." * 9 for k in range(23))
    write(spark, tmp_path, [(0, None), (1, ""), (2, " \n\n \n"), (3, "ab"), (4, "a.\nb.\n\nc."), (5, long), (None, "Nobody knows this one. It has no id."), (None, long), (-7, long[::-1]), (1 << 40, long.replace("\n", " "))])
    equal_to_sql(spark, "scene_slices", tmp_path)


def test_f1_ids_of_chapters_are_many_tasks(spark, sf, monkeypatch):
    monkeypatch.setattr(tables, "SHARE", 1 << 14)
    equal_to_sql(spark, "scene_slices", sf)


def test_f1_sentences_end_as_in_the_sql(spark, tmp_path):
    """Before, a blank before the last carriage return (or another end of a line) of a sentence went."""
    ends = ["\r", "\r\n", "\x85", "\u2028", "\u2029", "\n", "\t \n", "\x0b", "\x0c", "\u00a0", ""]
    texts = [f" \t{body} {end}" for body in ("One more day", "It was so. They went", "Dr! Who? mr!\x01mr! Mrs… it is. etc. Etc! Ok", "“Is it? Mr!” Said “so. and", "be\x01d \x02 and. bed") for end in ends]
    write(spark, tmp_path, list(enumerate(texts)))
    for name in ("sentences", "scene_slices"):
        equal_to_sql(spark, name, tmp_path)
