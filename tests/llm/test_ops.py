"""The training-data operators against brute force, the libraries they follow, and odd inputs."""

from __future__ import annotations

import collections
import hashlib
import json
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readlake.llm import exact_dedup, html_text, lattice_lm, near_dedup, packing, pii, piece_bpe, quality, registry, tool_links, toxicity
from tests import oracle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum " * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names clash."""
    a = " ".join(f"word{i}" for i in range(80))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, LONG, "en", None, len(LONG)), (4, a, "en", "a", 9), (4, a, "en", "a", 9), (5, a.upper(), None, "b", 1),
        (6, a + " extra", "de", "b", 2), (None, "no id here at all", "en", "a", 3), (7, "x", "en", "a", 1), (8, "mail me@x.org or +1 (555) 010-9999 at 10.0.0.1", "en", "a", 1),
    ]
    extra = [F.lit(k).alias(c) for k, c in enumerate(("node", "digest", "_key", "row", "kept", "grp", "n_words"))]
    return spark.createDataFrame(rows, DOCS).select("*", *extra)


@pytest.fixture(scope="module")
def larger(sf):
    """A larger set of the tables beside the small one, where there is one."""
    path = os.environ.get("TEST_LARGER_SF_DIR", os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.1"))
    return path if os.path.isdir(path) else sf


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_reference_sql(spark, sf, name):
    oracle.check(registry.queries()[name](spark, sf).toPandas(), registry.oracle_sql()[name], sf)


# --- personal data


def brute_pii(text: str) -> dict[str, list[tuple[int, int]]]:
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        total = 0
        for k, c in enumerate(reversed(d)):
            v = int(c) * (1 + k % 2)
            total += v - 9 if v > 9 else v
        return total % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([ -]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][ ().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in kinds.items()}


def test_pii_base_spans_equal_brute_force(spark):
    rng = random.Random(3)
    bits = ["a@b.c", "x.y@d-e.org", "_d@e.f", "@", ".", "1.2.3.4", "256.1.1.1", "0255.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (0) 170 12345-67", "+1", " ", "é", "𝒳", "a", "7", "-", "--", "++1 234 567 89"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(400)] + ["a@b.co " * 700, "1" * 5000, "a" * 30_000 + "@", "a.b" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.spans(df).collect():
        got = {k: [(s["start"], s["stop"]) for s in r["base"] if s["kind"] == k] for k in pii.BASE}
        assert got == brute_pii(texts[r["doc_id"]])


def test_pii_added_kinds(spark):
    texts = {
        1: "account GB82 WEST 1234 5698 7654 32 now", 2: "GB82 WEST 1234 5698 7654 33", 3: "my social security number 123-45-6789", 4: "lot 123-45-6789", 5: "call (555) 010-1234", 6: "range 555-010-1234",
        7: 'token = "0123456789abcdef0123456789abcdef01234567"', 8: "commit 0123456789abcdef0123456789abcdef01234567", 9: "secret aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa111", 10: "+1 (826) 555-4081 190.137.223.204",
        11: "key " + "a1b2c3d4" * 40, 12: "password: hunter2 and bearer x9Kq2LmZ7Tw4Rv8Bn3Hc6Yd1",
    }
    got = {r["doc_id"]: [s["kind"] for s in r["added"]] for r in pii.spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: ["iban"], 2: [], 3: ["ssn"], 4: [], 5: ["tel"], 6: [], 7: ["secret"], 8: [], 9: [], 10: ["intl"], 11: [], 12: ["secret"]}


def brute_added(text: str) -> list[tuple[str, int, int]]:
    """The added kinds by Python's regular expressions, in order, each apart from all before."""
    taken = [x for spans in brute_pii(text).values() for x in spans]
    near = lambda a, b, words: bool(re.search(f"(^|[^a-z])({words})", text[max(0, a - 48) : max(0, a - 48) + b - a + 96].lower()))

    def iban(v):
        d = v.replace(" ", "")
        return 15 <= len(d) <= 34 and int("".join(str(int(c, 36)) for c in d[4:] + d[:4])) % 97 == 1

    def secret(v):
        n = sum(c.isdigit() for c in v)
        return len(v) <= 200 and 3 <= n < len(v) and -sum(v.count(c) / len(v) * math.log2(v.count(c) / len(v)) for c in set(v)) >= 3

    ssn = lambda v: bool(re.fullmatch(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}", v))
    kinds = (
        ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", iban, None), ("ssn", r"[0-9][0-9-]{10}[0-9-]*", ssn, "ssn|social|security"),
        ("intl", r"\+[0-9]{1,3}[ .-]?[(]?[0-9]{2,4}[)]?[ .-][0-9]{3}[ .-][0-9]{4}[0-9-]*", lambda v: bool(re.search(r"[^0-9][0-9]{4}$", v)), None),
        ("tel", r"(?<![0-9(+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])", lambda v: True, "phone|tel|call|mobile|fax"),
        ("secret", r"[A-Za-z0-9_+/-]{24,}", secret, "token|secret|key|password|passwd|credential|bearer|auth"),
    )
    out = []
    for kind, pattern, valid, words in kinds:
        found = [m.span() for m in re.finditer(pattern, text) if valid(m[0]) and (words is None or near(*m.span(), words))]
        found = [x for x in found if not any(a < x[1] and x[0] < b for a, b in taken)]
        taken += found
        out += [(kind, *x) for x in found]
    return out


def test_pii_added_spans_equal_brute_force(spark, larger):
    rng = random.Random(9)
    bits = ["token=", "key: ", "0123456789abcdef0123456789abcdef01234567", "call ", "(555) 010-1234", "555.010.1234", "+1 826 555-4081", "123-45-6789", "ssn ", "GB82 WEST 1234 5698 7654 32", " ", "x", "-", "9", "é", "a@b.co", "bearer "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 20))) for _ in range(300)]
    texts += [r["text"] for r in spark.read.parquet(f"{larger}/documents.parquet").where("text rlike '[A-Za-z0-9_+/-]{24}|[0-9]{3}[ .-][0-9]{4}'").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = 0
    for r in pii.spans(df).collect():
        got = [(s["kind"], s["start"], s["stop"]) for s in r["added"]]
        assert got == brute_added(texts[r["doc_id"]])
        found += len(got)
    assert found > 100


def test_pii_stage_masks(spark, odd, empty):
    out = {r["doc_id"]: r for r in pii.stage(spark, odd, "").collect()}
    assert out[8]["text"] == "mail [EMAIL] or [PHONE] at [IP]" and out[8]["n_chars"] == len(out[8]["text"])
    assert out[1]["text"] is None and out[3]["text"] == LONG
    assert pii.stage(spark, empty, "").count() == 0
    assert pii.stage(spark, odd, "").columns == odd.columns


# --- tool calls


def test_tool_links(spark):
    calls = spark.createDataFrame(
        [
            (1, 0, "a", "search", '{"limit": 3, "query": "q"}', []), (1, 1, "b", "search", '{"query": 5, "x": 1}', ["a"]), (1, 2, "c", "none", "{}", ["b", "a"]),
            (1, 3, "d", "search", "[1]", ["e"]), (1, 4, "e", "search", '{"query": "", "limit": 1}', ["d"]), (1, 5, "f", "search", None, ["zzz"]), (2, 0, "a", "search", '{"query": "q", "limit": 1}', []),
            (1, 9, "a", "search", "{}", []), (None, 1, "a", "search", "{}", []),
        ],
        "conv_id long, turn long, call_id string, name string, arguments string, depends array<string>",
    )
    results = spark.createDataFrame([(1, 7, "a", 'r"1'), (1, 8, "b", None), (1, 8, "x", "?"), (2, 0, "a", "early"), (1, 8, "c", ""), (1, 8, "d", ""), (1, 8, "f", "")], "conv_id long, turn long, call_id string, content string")
    r = {(x["conv_id"], x["call_id"]): x for x in tool_links.linked(calls, results, tool_links.schema_table(spark)).collect()}
    assert {k: (v["status"], v["level"]) for k, v in r.items()} == {
        (1, "a"): ("linked", 0), (1, "b"): ("linked", 1), (1, "c"): ("linked", 2), (1, "d"): ("cycle", None), (1, "e"): ("call without result", None), (1, "f"): ("missing dependency", 0),
        (1, "x"): ("result without call", None), (2, "a"): ("result before call", 0),
    }
    assert r[1, "a"]["json"] == '{"arguments":{"limit":3,"query":"q"},"id":"a","name":"search","result":"r\\"1"}'
    assert r[1, "a"]["duplicates"] == 1 and r[1, "b"]["json"] is None
    assert r[1, "b"]["errors"] == ["missing limit", "type of query", "unknown x"]
    assert r[1, "c"]["errors"] == ["unknown tool"] and r[1, "d"]["errors"] == ["arguments are no object"]


def test_tool_levels_equal_brute_force(spark):
    rng, rows, want = random.Random(3), [], {}
    for conv in range(12):
        n, deps = rng.randint(1, 40), {}
        for i in range(n):
            some = {rng.randrange(i) for _ in range(rng.choice((0, 1, 1, 1, 2, 3)))} if i else set()
            deps[i] = some | ({rng.randrange(n)} if rng.random() < 0.03 else set()) | ({99} if rng.random() < 0.1 else set())
        if conv == 0:
            deps = {i: {i - 1} if i else set() for i in range(300)}  # a chain
        if conv == 1:
            deps = {0: {1}, 1: {2}, 2: {0}, 3: {2}, 4: {3, 5}, 5: set(), 6: {5, 6}, 7: {4}}  # cycles, and what is behind them
        rows += [(conv, str(i), [str(d) for d in sorted(ds)]) for i, ds in deps.items()]
        level: dict = {}
        for _ in deps:
            for i, ds in deps.items():
                known = [level.get(d) for d in ds if d in deps]
                if i not in level and None not in known:
                    level[i] = max(known, default=-1) + 1
        want |= {(conv, str(i)): v for i, v in level.items()}
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, depends array<string>")
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in tool_links.levels(calls).collect()}
    assert got == want
    assert tool_links.levels(calls.limit(0)).count() == 0


def test_tool_links_query_equals_brute_force(spark, sf):
    """Statuses, errors and canonical JSON of every call that the conversations stand for, by Python's json."""
    calls, results = tool_links.derived_calls(spark.read.parquet(f"{sf}/conversations.parquet"))
    got = {(r["conv_id"], r["call_id"]): r for r in registry.queries()["op2_tool_links"](spark, sf).collect()}
    own = {(r["conv_id"], r["call_id"]): r for r in calls.collect()}
    back = {(r["conv_id"], r["call_id"]): r for r in results.collect()}
    kinds = {"STRING": str, "BIGINT": int, "BOOLEAN": bool}
    assert set(got) == set(own) | set(back)
    for key, r in got.items():
        c, b = own.get(key), back.get(key)
        if c is None:
            assert r["status"] == "result without call"
            continue
        missing = [d for d in c["depends"] if (key[0], d) not in own]
        errors, args = [], json.loads(c["arguments"])
        if c["name"] not in tool_links.TOOLS:
            errors = ["unknown tool"]
        elif not isinstance(args, dict):
            errors = ["arguments are no object"]
        else:
            params = {p: (kind, need) for p, kind, need in tool_links.TOOLS[c["name"]]}
            errors = [f"missing {p}" for p, (_, need) in params.items() if need and p not in args]
            errors += [f"type of {p}" for p, v in args.items() if p in params and type(v) is not kinds[params[p][0]]] + [f"unknown {p}" for p in args if p not in params]
        status = "call without result" if b is None else "result before call" if b["turn"] <= c["turn"] else "cycle" if key[1] in c["depends"] else None
        assert r["errors"] == "; ".join(sorted(errors)) and (status is None or r["status"] == status)
        if r["status"] == "linked" and not errors:
            assert r["json"] == json.dumps({"arguments": args, "id": key[1], "name": c["name"], "result": b["content"]}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        else:
            assert r["json"] is None
        assert (r["status"] == "missing dependency") <= bool(missing)


def test_tool_links_odd_tables(spark):
    calls = spark.createDataFrame([], "conv_id long, turn long, call_id string, name string, arguments string, depends array<string>")
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    assert tool_links.linked(calls, results, tool_links.schema_table(spark)).count() == 0
    some = spark.createDataFrame([(1, 0, "a", "search", '{"query": "q", "limit": 1}', None)], calls.schema).withColumn("level", F.lit("x")).withColumn("content", F.lit("x")).withColumn("times", F.lit(9))
    r = tool_links.linked(some, results.withColumn("name", F.lit("y")), tool_links.schema_table(spark)).collect()
    assert [(x["status"], x["level"], x["duplicates"]) for x in r] == [("call without result", 0, 0)]


def test_tool_links_levels_of_a_long_chain(spark, sf):
    r = registry.queries()["op2_tool_links"](spark, sf).toPandas()
    turns = {(c, f"call_{t}"): t for c, t in zip(r.conv_id, r.call_turn, strict=True)}
    level = {(c, i): v for c, i, v in zip(r.conv_id, r.call_id, r.level, strict=True)}
    for (c, i), t in turns.items():
        dep = f"call_{2 * int(t // 4) + int(t % 2)}"
        if t >= 2 and (c, dep) in turns and dep != i:
            assert level[c, i] == level[c, dep] + 1


# --- exact copies


def test_exact_index_persists(spark):
    index = exact_dedup.DigestIndex(spark)
    first = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "doc_id long, digest string")
    index.append(first)
    index.append(spark.createDataFrame([(9, "x"), (10, "z")], "doc_id long, digest string"))
    assert sorted(map(tuple, index.read().collect())) == [("x", 9, 3), ("y", 3, 1), ("z", 10, 1)]
    again = exact_dedup.DigestIndex(spark, path=index.path, name=index.name, rows=10**9)  # found again, with its own buckets
    again.append(spark.createDataFrame([(4, "y"), (5, "x")], "doc_id long, digest string"))
    assert sorted(map(tuple, again.read().collect())) == [("x", 9, 4), ("y", 4, 2), ("z", 10, 1)] and again.buckets == index.buckets
    plan = index.read()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan
    again.drop()
    assert not spark.catalog.tableExists(index.name)


def test_exact_deltas_agree_with_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(map(tuple, exact_dedup.classes(docs, deltas=3).collect())) == sorted(map(tuple, exact_dedup.classes(docs).collect()))


def test_exact_odd_inputs(spark, odd, empty):
    r = exact_dedup.classes(odd).collect()
    assert len(r) == odd.count()
    by = {(x["doc_id"], x["kept"]) for x in r}
    assert (5, True) in by and (4, False) in by and (2, True) in by and (1, False) in by
    assert {x["doc_id"]: x["group_size"] for x in r}[4] == 3
    left = exact_dedup.stage(spark, odd, "")
    assert left.columns == odd.columns and sorted(x["doc_id"] or 0 for x in left.collect()) == [0, 2, 3, 5, 6, 7, 8]
    assert exact_dedup.classes(empty).count() == 0 and exact_dedup.stage(spark, empty, "").count() == 0


def test_exact_stage_keeps_one_of_repeated_rows(spark):
    d = spark.createDataFrame([(1, "a", "en", "s", 1), (1, "a", "en", "s", 1), (1, "b", "en", "s", 1)], DOCS)
    assert sorted(r["text"] for r in exact_dedup.stage(spark, d, "").collect()) == ["a", "b"]


# --- toxicity


def test_toxicity_held_out(spark, larger):
    r = toxicity.op4_toxicity(spark, larger).toPandas()
    labels = spark.read.parquet(f"{larger}/labels.parquet").toPandas()
    held = r[r.held_out].merge(labels, on="doc_id")
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in held.doc_id]).all()
    hit = held.predicted == held.toxic
    assert hit.mean() > 0.95 and held[held.toxic == 1].predicted.mean() > 0.65 and held[held.toxic == 0].predicted.mean() < 0.02


def test_toxicity_sees_terms_of_toxic_texts_only(spark):
    rng = random.Random(4)
    texts = {i: " ".join(f"w{rng.randrange(300)}" for _ in range(40)) + (f" insult{i % 3}" if i % 8 == 0 else "") for i in range(400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in texts], "doc_id long, toxic int")
    features, _ = toxicity.fitted(docs, labels)
    assert {toxicity.slot(f"insult{k}") for k in range(3)} <= set(features)
    held = [r for r in toxicity.scored(docs, labels).collect() if r["held_out"]]
    assert min(r["score"] for r in held if r["doc_id"] % 8 == 0) > max(r["score"] for r in held if r["doc_id"] % 8)


def test_toxicity_of_pairs_alone(spark):
    """An insult with a group is toxic; several insults, or several groups, are not: no additive weights can tell."""
    rng, rows = random.Random(5), []
    insults, groups = ("insultone", "insulttwo"), ("groupone", "grouptwo")
    for i in range(6000):
        words, kind = [f"w{rng.randrange(3000)}" for _ in range(40)], rng.random()
        words += [rng.choice(insults), rng.choice(groups)] if i % 12 == 0 else insults if kind < 0.3 else groups if kind < 0.6 else ()
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(i % 12 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = [r for r in toxicity.scored(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect() if r["held_out"]]
    caught = lambda rs: np.mean([r["predicted"] for r in rs])
    assert caught([r for r in held if r["doc_id"] % 12 == 0]) >= 0.9 and caught([r for r in held if r["doc_id"] % 12]) <= 0.01
    # the same features without pairs
    features = {t: k for k, t in enumerate(sorted({t for _, text, _ in rows for t in toxicity.terms(text)}))}
    x, y = [np.array([features[t] for t in toxicity.terms(text)]) for _, text, _ in rows], np.array([float(v) for *_, v in rows])
    linear = toxicity.FactorizationMachine(len(features), y.mean(), factors=1)
    linear.v[:] = 0  # where they stay
    linear.fit(x[:4500], y[:4500])
    z = np.array([linear.w0 + linear.w[f].sum() for f in x[4500:]])
    assert np.mean(1 / (1 + np.exp(-z[y[4500:] == 1])) >= toxicity.THRESHOLD) < 0.2


def test_factorization_machine_learns_a_pair():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(3000)]
    y = np.array([float(0 in r and 1 in r) for r in map(set, (r.tolist() for r in rows))])
    m = toxicity.FactorizationMachine(6, y.mean()).fit(rows, y)
    assert np.mean([(m.score(list(r)) > 0.5) == v for r, v in zip(rows, y, strict=True)]) > 0.97
    assert abs(m.raw(np.array([0, 1, 2])) - (m.w0 + m.w[:3].sum() + sum(m.v[i] @ m.v[j] for i in range(3) for j in range(i)))) < 1e-9


def test_toxicity_odd_inputs(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    r = toxicity.scored(odd, none).collect()
    assert len(r) == odd.count() and all(x["score"] == pytest.approx(0, abs=1e-9) for x in r)
    some = spark.createDataFrame([(4, 1, 1), (4, 1, 0), (6, 1, 0), (8, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.scored(odd, some).count() == odd.count() and toxicity.scored(empty, some).count() == 0


# --- quality


def brute_quality(text: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality_counts_equal_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in quality.op5_quality_rules(spark, sf).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_quality(docs[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    for text in ("", "a b a b a b", "x\n\nx\n x\n", "a b \x1c c", "# # # #"):
        assert quality.measure(text)[:5] == brute_quality(text)


def test_quality_sketches_merge_and_bound_quantiles(spark):
    rng = random.Random(1)
    rows = [(i, f"s{i % 3}", "en", rng.expovariate(1.0)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, grp string, lang string, v double").withColumn("n_words", F.lit(1))
    for m in quality.METRICS:
        df = df.withColumn(m, F.col("v"))
    parts = quality.sketch(df.where("doc_id < 700"), ["lang"]).unionByName(quality.sketch(df.where("doc_id >= 700"), ["lang"]))
    assert sorted(map(tuple, quality.merged(parts, ["lang"]).collect())) == sorted(map(tuple, quality.sketch(df, ["lang"]).collect()))
    f = quality.fences(quality.merged(parts, ["lang"]), ["lang"]).first()
    v = sorted(r[3] for r in rows)
    q1, q3 = v[math.ceil(750) - 1], v[math.ceil(2250) - 1]
    assert f["word_len_least"] == pytest.approx(q1 - 3 * max(q3 - q1, 1.0), abs=0.2) and f["word_len_most"] == pytest.approx(q3 + 3 * max(q3 - q1, 1.0), abs=0.2)


def test_quality_finds_junk_and_keeps_clean(spark, larger):
    r = quality.op5_quality_rules(spark, larger).toPandas().merge(spark.read.parquet(f"{larger}/labels.parquet").toPandas(), on="doc_id")
    judged = r[~r.base_failed]
    assert (~judged[judged.quality == 0].kept).mean() > 0.95 and judged[judged.quality == 1].kept.mean() > 0.99


def test_quality_odd_inputs(spark, odd, empty):
    assert quality.judged(odd).count() == odd.count()
    left = quality.stage(spark, odd, "")
    assert left.columns == odd.columns and sorted(r["doc_id"] for r in left.collect()) == [4, 4, 6]  # 5 is all capitals
    assert quality.stage(spark, empty, "").count() == 0


# --- language model


def test_lattice_equals_all_segmentations():
    v = lattice_lm.Vocabulary(lattice_lm.default_model())
    logp = np.log(v.first)
    ids = {p: i for i, p in enumerate(v.pieces)}

    def brute(word):
        text, n = lattice_lm.MARK + word, len(word) + 1
        ahead = [1.0] + [0.0] * n
        for j in range(1, n + 1):
            for i in range(j):
                piece = text[i:j]
                if piece in ids:
                    ahead[j] += ahead[i] * v.first[ids[piece]]
                elif j - i == 1:
                    ahead[j] += ahead[i] * math.exp(v.spelled(ord(piece), logp)[0])
        return math.log(ahead[n])

    words = ["the", "nation", "a", "", "éeau", "日本", "𝒳y", "thethethe", "zq"]
    total, uses = v.lattices(words, logp, np.ones(len(words)))
    assert total == pytest.approx([brute(w) for w in words], abs=1e-9)
    one, own = v.lattices(["a"], logp, np.ones(1))
    direct, split = v.first[ids["▁a"]], v.first[ids["▁"]] * v.first[ids["a"]]
    assert own[ids["▁a"]] == pytest.approx(direct / (direct + split)) and own[ids["a"]] == pytest.approx(split / (direct + split))


def test_language_model_base_and_rare_words(spark, sf, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = {i: re.findall(r"[^\x20\x09-\x0D]+", t.translate(low)) for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in toks}
    c = collections.Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    ends = sum(not h for h in held.values())
    n, v = sum(c.values()) + ends, len(c) + 1
    monkeypatch.setattr(lattice_lm, "SHARE", 300)  # so that most words take the joined way
    few = {r["doc_id"]: r for r in lattice_lm.op6_lattice_lm(spark, sf).collect()}
    monkeypatch.setattr(lattice_lm, "SHARE", 10**9)
    all_ = {r["doc_id"]: r for r in lattice_lm.op6_lattice_lm(spark, sf).collect()}
    for i, ws in toks.items():
        base = sum(math.log10((k + 0.5) / (n + 0.5 * (v + 1))) for k in [*(c[w] for w in ws), ends])
        for got in (few[i], all_[i]):
            assert (got["held_out"], got["n_tokens"], got["n_known"], got["train_tokens"]) == (held[i], len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, n)
            assert got["base_score"] == pytest.approx(base, rel=1e-9)
        assert few[i]["score"] == pytest.approx(all_[i]["score"], rel=1e-9)


def test_language_model_training_raises_held_out_probability(spark, sf):
    fitted = sum(r["score"] for r in lattice_lm.op6_lattice_lm(spark, sf).collect() if r["held_out"])
    v = lattice_lm.Vocabulary(lattice_lm.default_model())
    logp, first = np.log(v.first), 0.0
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1:
            words = [w.decode() for w in lattice_lm.tokens_of(r["text"])]
            first += (v.lattices(words, logp).sum() + logp[-1]) / math.log(10)
    assert fitted > first


def test_long_words_equal_the_block_way(monkeypatch):
    v = lattice_lm.Vocabulary(lattice_lm.default_model())
    words, weights, logp = ["the" + "nationéx𝒳" * k for k in (1, 9, 60)], np.array([1.0, 2.0, 3.0]), np.log(v.first)
    block, uses = v.lattices(words, logp, weights)
    monkeypatch.setattr(lattice_lm, "LONG_BLOCK", 4)
    single, own = v.lattices(words, logp, weights)
    assert single == pytest.approx(block, rel=1e-12) and own == pytest.approx(uses, abs=1e-8)


def test_language_model_of_very_long_frequent_words(spark):
    rule = "=" * 300_000
    docs = spark.createDataFrame([(i, f"{rule[:100]} a {rule if i % 50 == 0 else ''}") for i in range(100)], "doc_id long, text string")
    r = {x["doc_id"]: x for x in lattice_lm.scored(docs).collect()}
    assert r[0]["n_tokens"] == 4 and r[1]["n_tokens"] == 3 and all(math.isfinite(x["score"]) and x["n_known"] == x["n_tokens"] for x in r.values())


def test_language_model_odd_inputs(spark, odd, empty):
    assert lattice_lm.scored(odd).count() == odd.count() and lattice_lm.scored(empty).count() == 0


# --- packing


def test_word_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    t, e, rng = Tokenizer.from_file(packing.default_tokenizer()), packing.WordEncoder(packing.default_tokenizer()), random.Random(2)
    bits = list("aabcDE  \n\t.,!'12") + ["é", "日本", "😀", "́", "\xa0", "\x85", "<|endoftext|>", "<|STARTOFTEXT|>", "'s", "'LL", "Σ", "İ", "***", "İ,"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    want = [np.asarray(x.ids, "<u4").tobytes() for x in t.encode_batch(texts, add_special_tokens=False)]
    assert [bytes(x) for x in e.ids(pa.array(texts))] == want and [bytes(x) for x in e.ids(pa.array(texts).slice(700, 300))] == want[700:1000]


def test_remembered_words_are_bounded():
    r = packing.Remembered(10 * packing.OVERHEAD)
    for k in range(100):
        for x in r.missing([f"w{k}", "often"]):
            r.put(x, b"1234")
    assert "often" in r.young and len(r.young) + len(r.elder) < 14


def check_packing(df, spark):
    r = df.toPandas()
    seqs = collections.defaultdict(list)
    for row in r.itertuples():
        seqs[row.sequence_id].append((row.offset, row.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.MAX_LEN
    return r, len(seqs)


def test_packing_is_gapless_complete_and_near_the_bound(spark, sf):
    from tokenizers import Tokenizer

    r, n = check_packing(packing.op7_best_fit_packing(spark, sf), spark)
    t = Tokenizer.from_file(packing.default_tokenizer())
    want = {}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = [*t.encode(d["text"], add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[d["doc_id"], k // 4096] = (k, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()))
    assert {(x.doc_id, x.piece): (x.start, x.length, x.ids_crc32) for x in r.itertuples()} == want
    assert n <= math.ceil(r.length.sum() / 4096) * 1.02 + 1


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(4)
    for hist in (np.zeros(4097, int), np.bincount(rng.integers(1, 4097, 3000), minlength=4097), np.bincount([4096] * 5 + [2048] * 7 + [1] * 9 + [4095] * 9, minlength=4097), np.bincount([3000] * 1000, minlength=4097)):
        plan, used = packing.plan_sequences(hist), np.zeros(4097, int)
        for lengths, times in plan:
            assert sum(lengths) <= 4096 and times > 0
            for x in lengths:
                used[x] += times
        assert (used == hist).all() and len(plan) <= 2 * 4097 + packing.ROUNDS * packing.MOST * packing.DRAWS


def test_most_pieces_are_placed_by_fitted_patterns(spark, larger):
    lengths = packing.pieces(spark.read.parquet(f"{larger}/documents.parquet")).toPandas().length
    hist = np.bincount(lengths, minlength=4097)
    plan, left = packing.fitted_sequences(hist)
    assert all(sum(p) == 4096 for p, _ in plan) and left.sum() < 0.2 * hist.sum()
    assert sum(n for _, n in packing.plan_sequences(hist)) <= math.ceil(lengths.sum() / 4096) + 1


def test_least_squares_recovers_counts():
    hist = np.zeros(101)
    patterns = np.array([[60, 40, 0], [50, 30, 20], [70, 30, 0]])
    for p, n in zip(patterns, (5, 7, 3), strict=True):
        for x in p:
            if x:
                hist[x] += n
    assert packing.fit_counts(hist, patterns, 100) == pytest.approx([5, 7, 3], abs=0.2)


def test_packing_odd_inputs(spark, odd, empty):
    r, _ = check_packing(packing.pack_documents(odd), spark)
    assert (r[r.doc_id == 2].length == 1).all() and r[r.doc_id == 3].length.sum() == 80_001 and len(r[r.doc_id == 4]) == 2
    assert packing.pack_documents(empty).count() == 0


# --- near copies


def test_sampler_is_unbiased():
    rng = np.random.default_rng(0)
    a, wa = rng.integers(0, 2**32, 300).astype(np.uint32), rng.uniform(0.5, 3, 300)
    wb = wa * np.where(np.arange(300) < 100, rng.uniform(0.3, 1, 300), 1)
    s = near_dedup.Sampler(4000)
    same = (s.samples(a, np.log(wa), np.array([0])) == s.samples(a, np.log(wb), np.array([0]))).mean()
    assert same == pytest.approx(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum(), abs=0.03)


def brute_classes(texts: dict) -> dict:
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()

    g, root = {i: grams(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = g[i], g[j]
            if a == b or (a and b and (c := sum((a & b).values())) / (sum(a.values()) + sum(b.values()) - c) >= 0.8):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_classes_equal_brute_force(spark):
    rng = random.Random(8)
    texts, words = {}, [f"w{k}" for k in range(3000)]
    for g in range(30):
        base = [rng.choice(words) for _ in range(rng.choice((6, 60, 300)))]
        for k in range(rng.choice((1, 2, 5))):
            own = list(base)
            for _ in range(max(0, int(len(base) * 0.012 * k))):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts[g * 10 + k] = " ".join(own).upper() if k == 1 else " ".join(own)
    shared = [rng.choice(words) for _ in range(60)]
    texts |= {900 + k: " ".join([rng.choice(words) for _ in range(200)] + shared) for k in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(df).collect()}
    assert got == brute_classes(texts)


def test_near_large_group_and_chain(spark):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(400)]
    rows = []
    for i in range(400):  # copies of one text, each with a change of its own
        own = list(base)
        own[rng.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    r = near_dedup.near_classes(df).collect()
    assert {x["class_id"] for x in r} == {0} and [x["doc_id"] for x in r if x["kept"]] == [399]


def test_near_star_equals_brute_force(spark):
    """Many edited copies of a base: each is similar to it, hardly any two of them to each other."""
    rng, bases, texts = random.Random(21), [[f"s{b}w{i}" for i in range(600)] for b in range(2)], {}
    for b, base in enumerate(bases):
        for k in range(60):
            own = list(base)
            for at in rng.sample(range(0, 600, 6), 8):
                own[at] = f"edit{b}x{k}x{at}"
            texts[1000 * b + k] = own
        texts[1000 * b + 500] = base
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in texts.items()}
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert np.mean([jaccard(a, b) < 0.8 for a in range(60) for b in range(a)]) > 0.9 and min(jaccard(500, k) for k in range(60)) >= 0.8
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    r = near_dedup.near_classes(df).collect()
    assert all(x["class_id"] == x["doc_id"] // 1000 * 1000 and x["class_size"] == 61 for x in r) and sum(x["kept"] for x in r) == 2


def test_near_recall_on_the_tables(spark, larger):
    """All pairs of different texts whose exact weighted Jaccard similarity (TF or TF-IDF) reaches 0.8, against the classes."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{larger}/documents.parquet").collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    grams = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(low))
        grams[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    df = collections.Counter(x for c in grams.values() for x in c)
    idf = {x: min(1.0, max(near_dedup.IDF_LEAST, math.log(len(texts) / n) / math.log(1 / near_dedup.RARE))) for x, n in df.items()}
    # two multisets of similarity s share one of the rarest shingles that make up 1 - s of the weight of either
    index, pairs = collections.defaultdict(list), set()
    for i, c in grams.items():
        ranked, total, so_far = sorted(c, key=lambda x: (df[x], x)), sum(c.values()), 0.0
        for x in ranked:
            pairs.update((j, i) for j in index[x])
            index[x].append(i)
            so_far += c[x] * near_dedup.IDF_LEAST  # weights are at least this share of the counts
            if so_far > (1 - near_dedup.SIMILARITY) * total:
                break
    wanted = []
    for i, j in pairs:
        a, b = grams[i], grams[j]
        both = a & b
        plain = sum(both.values()) / (sum(a.values()) + sum(b.values()) - sum(both.values()))
        weigh = lambda c: sum(n * idf[x] for x, n in c.items())
        if a != b and max(plain, weigh(both) / (weigh(a) + weigh(b) - weigh(both))) >= near_dedup.SIMILARITY:
            wanted.append((i, j))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark.read.parquet(f"{larger}/documents.parquet")).collect()}
    assert wanted and np.mean([got[i] == got[j] for i, j in wanted]) >= 0.98


def test_near_document_frequencies_are_near_the_truth():
    rng = np.random.default_rng(1)
    often, n = rng.integers(0, 2**32, 50).astype(np.uint32), 4000
    table_ = np.zeros((2, 1 << near_dedup.DF_BITS), np.int64)
    for _ in range(n):
        keys = np.unique(np.concatenate([often[rng.random(50) < np.linspace(0.02, 0.9, 50)], rng.integers(0, 2**32, 300).astype(np.uint32)]))
        for k, at in enumerate(near_dedup.slots(keys)):
            np.add.at(table_[k], at, 1)
    one, two = near_dedup.slots(often)
    held = near_dedup.holders(table_)
    assert np.minimum(held[0][one], held[1][two]) / n == pytest.approx(np.linspace(0.02, 0.9, 50), abs=0.03)
    idf = near_dedup.idf_of(often, near_dedup.idf_tables(table_, n))
    assert idf.min() >= near_dedup.IDF_LEAST and idf[0] > idf[-1]


def test_near_runs_pair_members_of_different_components():
    run = [(b"a", b"a", 1.0, 0), (b"b", b"b", 3.0, 0), (b"c", b"b", 2.0, 0), (b"d", b"d", 0.5, 0)]
    hubs, partners = near_dedup._partners(run, 0)
    assert [h[0] for h in hubs] == [b"b", b"a"] and partners == [[b"b"], [b"a"], [b"a"], [b"b", b"a", b"c"]]
    assert near_dedup._partners(run[1:3], 0)[1] == []


def test_near_runs_that_tasks_cut_are_paired(spark):
    """Every member of every run is linked to its run, however the order is divided."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    rows = [(bytes([r, k]), bytes([r, k]), 0.5, 0, bytes([0, r]), bytes([k])) for r in range(40) for k in range(2 if r % 3 else 3)]
    members = spark.createDataFrame(rows, "node binary, comp binary, central float, band int, key binary, rest binary")
    try:
        for n in ("1", "23", "61"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            joined = {frozenset((bytes(r["node"]), bytes(p))) for r in near_dedup._paired(members).collect() for p in r["partners"]}
            for r in range(40):
                run = {x[0] for x in rows if x[4] == bytes([0, r])}
                reached, grew = {min(run)}, True
                while grew:
                    more = {b for pair in joined if pair & reached for b in pair} - reached
                    reached, grew = reached | more, bool(more)
                assert reached == run
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["root"] for r in near_dedup.components(edges).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_near_odd_inputs(spark, odd, empty):
    r = near_dedup.near_classes(odd).collect()
    assert len(r) == odd.count()
    by = {x["doc_id"]: x["class_id"] for x in r}
    assert by[1] == by[2] == 1 and by[4] == by[5] == by[6] == 4
    left = near_dedup.stage(spark, odd, "")
    assert left.columns == odd.columns and sorted(x["doc_id"] or 0 for x in left.collect()) == [0, 2, 3, 6, 7, 8]
    assert near_dedup.near_classes(empty).count() == 0


def test_near_stage_keeps_one_of_each_class_under_any_ids(spark):
    words = {n: [f"{n}{i}" for i in range(60)] for n in "abc"}
    rows = [(None, " ".join(words["a"])), (None, " ".join(words["a"] + ["more"])), (None, " ".join(words["b"])), (5, " ".join(words["a"][::-1])), (5, " ".join(words["c"])), (5, " ".join(words["c"]))]
    df = spark.createDataFrame(rows + [(0, " ".join(words["b"][::-1]))], "doc_id long, text string")
    left = near_dedup.stage(spark, df, "").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"].split()[0]) for r in left) == [(False, 0, "b59"), (False, 5, "a59"), (False, 5, "c0"), (True, 0, "a0"), (True, 0, "b0")]


# --- html


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies, accept them all please</div><main><article><h1>A &amp; B</h1><p><b>First   part<br>goes&nbsp;on &#233;<p>Short.<aside>Related</aside><p>Last one is a longer paragraph of text, with <a href=x>a link</a>.</p>
<div class="comments"><p>First! I am a reader with much to say about all of this, truly</p></div></article></main><div id="ad-top">Buy now</div><footer>&copy; x</footer>"""


def test_html_main_text():
    assert html_text.main_text(PAGE) == ["A & B", "First part goes on é", "Short.", "Last one is a longer paragraph of text, with a link."]
    assert html_text.main_text("<p>only</p>") == ["only"] and html_text.main_text("plain") == ["plain"]
    assert html_text.main_text("<nav>x</nav>") == [] and html_text.main_text("") == []
    html_text.main_text("<![if x]><p>a<![endif]--> <!-- open <div <p")


def test_html_nested_and_sibling_containers():
    long = "A long paragraph of the text that goes on for quite a while, number "
    page = f"<main><h1>Title</h1><p>{long}0</p><article><p>{long}1</p></article><article><p>{long}2</p><p>{long}3</p></article><p>Outro</p></main>"
    assert html_text.main_text(page) == ["Title", *(f"{long}{k}" for k in range(4)), "Outro"]
    page = f"<div><a href=x>Link</a></div><article><p>{long}1</p></article><article><p>{long}2</p><p>{long}3</p></article>"
    assert html_text.main_text(page) == [f"{long}{k}" for k in range(1, 4)]


def test_html_open_head():
    for page in ("<html><head><title>T</title><body><p>Text</p>", "<head><meta charset=x><title>T</title><p>Text", "<head><title>T</title>Text"):
        assert html_text.main_text(page) == ["Text"]


def test_html_plain_divs():
    long = "A long paragraph of the text that goes on for quite a while, as texts do, number "
    links = "".join(f"<li><a href=/{k}>Link {k}</a></li>" for k in range(12))
    text = "".join(f"<div>{long}{k}</div>" for k in range(6))
    page = f"<body><div class=x1><ul>{links}</ul></div><div class=x2><div><h1>Title</h1></div>{text}<p>Short.</p></div><div class=x3><ul>{links}</ul></div>"
    assert html_text.main_text(page) == ["Title", *(f"{long}{k}" for k in range(6)), "Short."]
    assert html_text.main_text("<div>First</div><div>Second, longer than that by far, and then some more</div>") == ["First", "Second, longer than that by far, and then some more"]


def test_html_without_containers_menus_and_legal_lines():
    long = "A long paragraph of the text that goes on for quite a while, as texts do, number "
    body = "".join(f"<p>{long}{k}</p>" for k in range(4))
    menu = "<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li><li><a href=c>About us</a></li></ul>"
    page = f"<body>{menu}<div><h2>Title</h2>{body}</div><div>Copyright 2024, all rights reserved</div></body>"
    assert html_text.main_text(page) == ["Title", *(f"{long}{k}" for k in range(4))]
    page = f"<body>{menu}<h2>Title</h2>{body}<p>Short one.</p>{body}{menu}</body>"  # no element around the text at all
    assert html_text.main_text(page) == ["Title", *(f"{long}{k}" for k in range(4)), "Short one.", *(f"{long}{k}" for k in range(4))]


def test_html_class_names_alone_lose_no_heading_or_paragraph():
    long = "A long paragraph of the text that goes on for quite a while, as texts do, number "
    page = f'''<article><h2 class="header">Head</h2><p class="side">{long}1</p><div class="tags-intro"><p>{long}2</p></div><div class="tags"><a href=x>a</a> <a href=y>b</a></div>
<p class="advert">Buy this now</p><div class="ad">Or that</div><div class="comments"><p>{long}3</p></div><p class="notice">{long}4</p></article>'''
    assert html_text.main_text(page) == ["Head", f"{long}1", f"{long}2", f"{long}4"]


def test_html_of_stripped_pages(spark, sf, monkeypatch):
    """The test pages with all containers renamed to div and without classes: the ratios alone find the article."""
    import html as entities

    kept = lost = article = rest = 0
    changed = 0
    pages = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    for page in pages:
        bare = re.sub(r"<(/?)(?:article|main|nav|header|footer|aside|section|ul|li)\b[^>]*>", r"<\1div>", re.sub(r' class="[^"]*"', "", page))
        text = lambda h: {x for x in (" ".join(entities.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1|div|li|nav|footer|article|ul)\b[^>]*>", re.sub(r"(?s)<(script|style|title)\b.*?</\1>|<!--.*?-->", "", h))) if x}
        inside = text(re.search(r"(?s)<article>(.*?)</article>", page)[1])
        outside = text(re.sub(r"(?s)<article>.*?</article>", "", page)) - inside
        got = html_text.main_text(bare)
        kept += sum(len(x) for x in inside if x in got)
        article += sum(map(len, inside))
        lost += sum(len(x) for x in outside if x not in got)
        rest += sum(map(len, outside))
        with monkeypatch.context() as m:
            m.setattr(html_text, "smoothed", lambda values: [1.0] * len(values))
            changed += html_text.main_text(bare) != got
    assert kept >= 0.95 * article and lost >= 0.9 * rest, (kept / article, lost / rest)
    assert changed >= 0.3 * len(pages), changed  # where the ratios don't matter, the rest of the page is a small part of it


def test_html_on_the_test_pages(spark, sf):
    import html as entities

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html_text.op9_html_text(spark, sf).collect():
        body = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", body)]
        assert r["text"] == "\n\n".join(x for x in blocks if x) and r["n_chars"] == len(r["text"])


def test_html_odd_inputs(spark):
    p = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", "<p>x" * 5000), (2, "u", "<p>x" * 5000)], "page_id long, url string, html string")
    assert sorted(r["n_chars"] for r in html_text.extracted(p).collect()) == [0, 0, 14998, 14998]
    assert html_text.extracted(p.limit(0)).count() == 0


# --- subwords


def test_pieces_equal_library(spark, odd):
    from sentencepiece import SentencePieceProcessor

    sp, codec, rng = SentencePieceProcessor(model_file=piece_bpe.default_model()), piece_bpe.PieceCodec(piece_bpe.default_model()), random.Random(6)
    bits = list("aaabcdethin   \n\t.,12") + ["é", "▁", "日", "語", "\x00", "😀", "ß", "    ", "́", "\xa0", "<s>", "<0x41>", "ing", "tion"]
    texts = ["", " ", "\n", "▁", *(" " * n + "x" for n in range(40)), *("a" * n for n in range(60)), *("".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(2500)), "ab" * 20_000]
    for t in texts:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        own = codec.encode(t)
        assert np.frombuffer(own, "<u4").tolist() == ids and codec.decode(own) == sp.decode(ids)
    r = {x["doc_id"]: x for x in piece_bpe.digested(odd).collect()}
    assert r[1]["n_tokens"] == 2 and r[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert r[3]["decoded_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()
    full = {x["doc_id"]: x for x in piece_bpe.encoded(odd).collect()}
    assert full[8]["decoded"].startswith("mail me@x.org")


# --- pipeline


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty):
    import corpus_pipeline

    rng = random.Random(1)
    base = [f"{rng.choice('abcdefgh')}{rng.randrange(900)}word" for _ in range(120)]
    rows = [(i, " ".join(base + [f"more{k}" for k in range(i % 3)])) for i in (1, 2, 3, 3)] + [(None, " ".join(base[::-1])), (None, " ".join(base[5:] + base[:5] * 9)), (9, None), (None, ""), (10, " ".join(base).upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string) lang", "'s' source", "cast(length(text) as bigint) n_chars")
    mine = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        mine = spark.createDataFrame(stage(spark, mine, "").collect(), docs.schema)
    # all near copies of the base are one document, that with the largest doc_id that the rules keep; the reversed and the repeated text are two more
    kept = sorted(((r["doc_id"] or 0), r["text"].split()[0].lower()) for r in mine.collect())
    assert [k for k, _ in kept].count(0) == 2 and len([k for k, _ in kept if k]) == 1
    out, _ = check_packing(corpus_pipeline.applied(spark, docs, ""), spark)
    assert len(out) == len(kept)
    for table_ in (empty, odd.limit(0)):
        assert corpus_pipeline.applied(spark, table_, "").count() == 0
    assert corpus_pipeline.applied(spark, odd, "").count() >= 1


def test_pipeline_stages_chain(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = [set(r["doc_id"] for r in docs.collect())]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        ids.append(set(r["doc_id"] for r in docs.collect()))
    assert all(a >= b for a, b in zip(ids, ids[1:], strict=False)) and ids[3] == ids[4]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len({t.lower() for t in texts.values()}) >= len(texts) - 2
    out, _ = check_packing(corpus_pipeline.run(spark, sf), spark)
    assert set(out.doc_id) == ids[-1]
