"""Vector codes, line dedup, conversation repair and the runs they are kept in, against brute force and odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from readlake.llm import exact_dedup, line_dedup, turn_repair, vector_codes
from readlake.operators.runs import FAN

BLANKS = " \t\n\x0b\x0c\r"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# --- sorted runs


def other_session(spark, partitions: int):
    """A session with its own settings, and a catalogue that has forgotten all runs."""
    other = spark.newSession()
    for t in spark.catalog.listTables():
        if not t.isTemporary:
            spark.sql(f"DROP TABLE {t.name}")
    other.conf.set("spark.sql.shuffle.partitions", partitions)
    return other


def test_index_is_read_whole_by_another_session(spark):
    index = exact_dedup.DigestIndex(spark, name="first", rows=8 * exact_dedup.BUCKET_ROWS)
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("digest"))
    index.append(rows.where("doc_id < 600"), "a")
    index.append(rows.where("doc_id >= 600"), "b")
    assert index.buckets == 8
    other = other_session(spark, 3)
    again = exact_dedup.DigestIndex(other, path=index.path, name="second")
    assert again.buckets == 8 and again.read().count() == 1000
    fresh = other.range(990, 1010).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("digest"))
    assert again.runs.unseen(fresh.select("digest")).count() == 10
    again.append(fresh, "c")
    found = exact_dedup.DigestIndex(spark, path=index.path).read()
    assert found.count() == 1010 and found.where("group_size = 2").count() == 10
    again.drop()


def test_a_delta_that_comes_again_changes_nothing(spark):
    index = exact_dedup.DigestIndex(spark)
    delta = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "doc_id long, digest string")
    index.append(delta, "monday")
    kept = sorted(map(tuple, index.read().collect()))
    index.append(delta, "monday")
    exact_dedup.DigestIndex(spark, path=index.path).append(delta, "monday")
    assert sorted(map(tuple, exact_dedup.DigestIndex(spark, path=index.path).read().collect())) == kept == [("x", 2, 2), ("y", 3, 1)]
    # a run that was written but not committed, as by a driver that was lost, isn't read
    index.runs._write(delta.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    assert sorted(map(tuple, exact_dedup.DigestIndex(spark, path=index.path).read().collect())) == kept
    stale = exact_dedup.DigestIndex(spark, path=index.path)
    index.append(delta.limit(1), "tuesday")
    with pytest.raises(RuntimeError, match="another writer"):
        stale.append(delta, "wednesday")
    with pytest.raises(ValueError, match="digest"):
        line_dedup.LineIndex(spark, path=index.path)
    index.drop()


def test_runs_are_merged_in_levels(spark):
    index = exact_dedup.DigestIndex(spark)
    n = FAN * FAN + 1
    for k in range(n):
        index.append(spark.createDataFrame([(k, "all"), (k, f"d{k}")], "doc_id long, digest string"), f"d{k}")
    assert sorted(level for level, _ in index.runs.state["runs"]) == [0, 2]
    found = {r["digest"]: (r["keep_id"], r["group_size"]) for r in index.read().collect()}
    assert found == {"all": (n - 1, n)} | {f"d{k}": (k, 1) for k in range(n)}
    plan = index.read()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan
    index.drop()


# --- line dedup


def brute_lines(docs: list[tuple]) -> list[tuple]:
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(BLANKS).translate(lower)
    holders: dict[str, list] = {}
    for doc_id, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 20:
                holders.setdefault(k, []).append(doc_id)
    gone = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(ids) >= 3}
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def found_lines(docs, **how) -> list[tuple]:
    d = line_dedup.deduplicated(docs, **how)
    return sorted(map(tuple, d.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()), key=repr)


def test_lines_equal_brute_force(spark):
    rng = random.Random(5)
    stock = ["A line that many documents hold", " a LINE that many documents hold\t", "exactly twenty chars", "nineteen characters", "é" * 20, "É" * 20, "é" * 19, "", "x", "  \v ", "a line with other white space ", "𝒳" * 20]
    docs = [(k, None if k % 17 == 0 else "\n".join(rng.choice([*stock, f"own {k} {rng.random()} and longer"]) for _ in range(rng.randint(0, 12)))) for k in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for batches in (1, 3, 6):
        assert found_lines(df, batches=batches) == brute_lines(docs)


def test_lines_odd_inputs(spark):
    common, long = "the very same line in every document", "\n".join(f"row {k % 5000} of a very long text" for k in range(20_000))
    docs = [(1, common), (1, common), (None, common + "\nown"), (2, f"{common}\n{common}\nmine"), (3, None), (4, ""), (5, long), (6, long), (7, long.upper()), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit(k).alias(c) for k, c in enumerate(("mark", "pos", "h1", "_lost", "row", "n_lines", "kept_text", "batch"))])
    assert found_lines(df, batches=2) == brute_lines(docs)
    out = line_dedup.deduplicated(df)
    assert out.columns == ["doc_id", "text", "mark", "pos", "h1", "_lost", "row", "batch", "n_lines", "n_dropped", "kept_text"]
    assert line_dedup.deduplicated(df.limit(0), batches=3).count() == 0
    alone = [(None, common)] * 4
    assert found_lines(spark.createDataFrame(alone, "doc_id long, text string")) == brute_lines(alone)


def test_line_index_takes_batches_of_several_sessions(spark):
    index = line_dedup.LineIndex(spark)
    batch = lambda ids, text: spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")
    first, second = "a line of the first batch, long enough", "a line of the second batch, long enough"
    index.add(line_dedup.lines(batch([1, 2], first)), "one")
    again = line_dedup.LineIndex(other_session(spark, 2), path=index.path)
    new = line_dedup.lines(batch([3], f"{first}\n{second}"))
    assert again.unseen(new).count() == 1
    again.add(new, "two")
    again.add(new, "two")
    assert again.size() == 2 and [tuple(r)[2:] for r in again.repeated().collect()] == [(3, 3)]
    out = line_dedup.deduplicated(batch([0], f"{first}\n{second}"), index=again, name="three").first()
    assert (out["n_dropped"], out["kept_text"]) == (1, second)
    again.runs.drop()


# --- vector codes


def brute_codes(rows: list[tuple]) -> tuple[dict, str]:
    """By vec_id code and error, by all distances; and the digest of the codebooks."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: r[0])
    points = np.floor(np.array([r[1] for r in kept], np.float64) * 1024).astype(np.int64)
    width, codes, errors, numbers = points.shape[1] // 4, [], np.zeros(len(points), np.int64), []
    for part in range(4):
        own = points[:, part * width : (part + 1) * width]
        book = own[:256].copy()
        far = lambda b: ((own[:, None] - b[None]) ** 2).sum(-1)  # noqa: E731,B023
        for _ in range(4):
            nearest = far(book).argmin(1)
            book = np.array([[int(v) // len(m) for v in m.sum(0)] if len(m := own[nearest == k]) else entry for k, entry in enumerate(book)])
        d = far(book)
        codes.append(d.argmin(1))
        errors += d.min(1)
        numbers += book.reshape(-1).tolist()
    found = {r[0]: ("".join(f"{codes[p][k]:02x}" for p in range(4)), int(errors[k])) for k, r in enumerate(kept)}
    return found, hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def clustered(n: int, width: int = 16, copies: int = 0) -> list[tuple]:
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 3, (20, width))
    x = centres[rng.integers(0, 20, n)] + rng.normal(0, 0.02, (n, width))
    x[n - copies :] = x[0]
    return [(int(k), [float(np.float32(v)) for v in row], int(k) % 7) for k, row in enumerate(x)]


SHAPE = "vec_id long, embedding array<float>, label int"


def test_codes_equal_all_distances(spark, monkeypatch):
    rows = clustered(1500, copies=500) + [(5000, None, 1), (5001, [None] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, [float("inf")] * 16, None)]
    monkeypatch.setattr(vector_codes, "CHUNK", 300)
    got, books = vector_codes.coded(spark.createDataFrame(rows, SHAPE).repartition(3))
    want, digest = brute_codes(rows)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got.collect()} == want and vector_codes.books_digest(books) == digest


def test_cover_tree_covers_and_settles_subtrees():
    points = np.floor(np.array([r[1] for r in clustered(1200, 8, 300)]) * 1024).astype(np.int64)
    tree = vector_codes.CoverTree.build(points)
    own = points[tree.order]
    assert sorted(tree.order) == list(range(1200))
    for k in range(len(tree.lo)):
        far = np.sqrt(((own[tree.lo[k] : tree.hi[k]] - own[tree.centre[k]]) ** 2).sum(1))
        assert np.isclose(far.max(), tree.radius[k])
        below = range(tree.child[k], tree.child[k] + tree.children[k])
        if tree.children[k]:  # they share out the node's slice, within half its radius of centres that are further apart
            assert [tree.lo[c] for c in below] == [tree.lo[k], *[tree.hi[c] for c in below][:-1]] and tree.hi[below[-1]] == tree.hi[k]
            assert max(tree.radius[c] for c in below) <= tree.radius[k] / 2 and tree.centre[below[0]] == tree.centre[k]
            centres = own[[tree.centre[c] for c in below]]
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(-1))
            assert (apart[~np.eye(len(centres), dtype=bool)] > tree.radius[k] / 2).all()
    entries = np.array([own[0], own[-1], own[0] + 9000])
    label, count, total, met = tree.assign(own, entries, np.arange(3))
    nearest = ((own[:, None] - entries[None]) ** 2).sum(-1).argmin(1)
    assert (label == nearest).all() and count.tolist() == np.bincount(nearest, minlength=3).tolist() and (total.sum(0) == own.sum(0)).all()
    assert met < 100  # of 1200 points only the centres of nodes that weren't settled above met the entries


def test_codes_odd_inputs(spark):
    rows = [(3, [1.0, 2.0, 3.0, 4.0, 5.0], None), (3, [1.0, 2.0, 3.0, 4.0, 6.0], 1), (None, [0.0] * 5, 1), (4, [1.0], 1), (5, [], 2), (6, [1e30] * 5, 2)]
    df = spark.createDataFrame(rows, SHAPE).withColumn("code", F.lit("x")).withColumn("part", F.lit(1))
    codes, books = vector_codes.coded(df)
    got = sorted(map(tuple, codes.collect()), key=repr)
    assert got == [(3, 1, "00000001", 0), (3, None, "00000000", 0), (None, 1, "02020202", 0)] and [b.shape for b in books] == [(3, 1), (3, 1), (3, 1), (3, 2)]
    assert vector_codes.coded(df.limit(0))[0].count() == 0
    empty, _ = vector_codes.coded(spark.createDataFrame([(1, [], 1), (2, [], 1)], SHAPE))
    assert sorted(map(tuple, empty.collect())) == [(1, 1, "00000000", 0), (2, 1, "00000000", 0)]


# --- conversation repair


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
NEXT = {"0": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def brute_repair(rows: list[tuple]) -> tuple:
    """Of one conversation's rows (turn, role, text) in order: best edits of each rest, by whole scripts."""
    faults, seen = [], set()
    for _, role, text in rows:
        end = text.strip(BLANKS)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    best: list[dict] = [{}] * (len(rows) + 1)
    for i in range(len(rows), -1, -1):
        now = {}
        for state in "0sua":
            ways = [(0, "")] if i == len(rows) and state in "0a" else []
            if i < len(rows):
                ways.append((2 + best[i + 1][state][0], "D" + best[i + 1][state][1]))
                if faults[i] in ("", "truncated"):
                    more, to = 5 * (faults[i] == "truncated"), rows[i][1][:1]
                    if to == "s" and state == "0" or to == "u" and state in "0sa" or to == "a" and state == "u":
                        ways.append((more + best[i + 1][to][0], "K" + best[i + 1][to][1]))
                    to = NEXT[state]
                    ways.append((1 + more + best[i + 1][to][0], "R" + best[i + 1][to][1]))
            now[state] = min(ways, default=(10**9, ""))
        for _ in range(4):
            for state in "0sua":
                now[state] = min(now[state], (5 + now[NEXT[state]][0], "I" + now[NEXT[state]][1]))
        best[i] = now
    cost, audit = best[0]["0"]
    state, left, out = "0", iter(rows), []
    for edit in audit:
        _, role, text = (None, None, "") if edit == "I" else next(left)
        if edit != "D":
            state = role[:1] if edit == "K" else NEXT[state]
            out.append(f"{role if edit == 'K' else NAMES[state]}:{text}")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def found_repairs(df) -> dict:
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def random_turns(seed: int, lengths) -> list[tuple]:
    rng = random.Random(seed)
    texts = ["a.", "b", "c!", "", "  ", "d. ", "e?"]
    roles = ["user", "assistant", "system", "tool", "user", "assistant", "", "uncle"]
    return [(c, t, rng.choice(roles), rng.choice([*texts, *[f"x{rng.randrange(10**6)}{rng.choice(['.', ''])}"] * 8])) for c, n in enumerate(lengths) for t in range(n)]


@pytest.mark.parametrize(("block", "fan_bits"), [(1024, 10), (3, 1), (1, 3)])
def test_repairs_equal_brute_force(spark, monkeypatch, block, fan_bits):
    """In one block, in many blocks, and in many levels of blocks."""
    rows = random_turns(1, [1, 2, 3, 5, 9, 40, 700, 4, 6, 8, 2, 3])
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    monkeypatch.setattr(turn_repair, "FAN_BITS", fan_bits)
    want = {c: brute_repair([r[1:] for r in rows if r[0] == c]) for c in range(12)}
    assert found_repairs(turn_repair.reports(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))) == want


def test_short_conversations_equal_brute_force(spark):
    rows = random_turns(2, [k % 6 + 1 for k in range(600)])
    by: dict = {}
    for c, *r in rows:
        by.setdefault(c, []).append(tuple(r))
    assert found_repairs(turn_repair.reports(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == {c: brute_repair(r) for c, r in by.items()}


def test_damage_and_repair_of_the_table(spark, sf):
    by: dict = {}
    for c, t, role, text in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect():
        fault = zlib.crc32(f"{c}:{t}".encode()) % 20
        row = (t, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)
        by.setdefault(c, []).extend([] if fault == 0 else [row] * (1 + (fault == 3)))
    want = {c: brute_repair(sorted(r)) if r else (0, 0, 0, 0, 0, 0, "", EMPTY_SHA) for c, r in by.items()}
    assert found_repairs(turn_repair.op13_turn_repair(spark, sf)) == want


def test_repair_odd_inputs(spark, tmp_path):
    rows = [(None, None, None, None), (None, 2, "user", "hi."), (1, None, "user", "q?"), (1, None, "user", "q?"), (1, 5, "assistant", "lorem " * 50_000 + "."), (2, 1, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    extra = df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("conv", "at", "cut", "kinds", "whole", "audit", "fault", "h1"))])
    got = found_repairs(turn_repair.reports(extra))
    assert got[None] == brute_repair([(None, " ", " "), (2, "user", "hi.")])
    assert got[1] == brute_repair([(None, "user", "q?"), (None, "user", "q?"), (5, "assistant", "lorem " * 50_000 + ".")])
    assert got[2] == brute_repair([(1, "user", " ")])
    assert turn_repair.reports(extra.limit(0)).count() == 0
    out = turn_repair.repaired(extra).where("conv_id = 1").orderBy("at", "pos").collect()
    assert [(r["role"], r["edit"]) for r in out] == [("user", "K"), ("assistant", "K")]
    extra.write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(found_repairs(turn_repair.op13_turn_repair(spark, str(tmp_path))), key=repr) == [1, 2, None]
