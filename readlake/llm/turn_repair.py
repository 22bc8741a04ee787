"""Repair of conversations: the cheapest edits that make the turns alternate, found by divide and conquer.

A conversation is right if its roles' initials are (s?(ua)+)?.  An automaton of four states reads it: nothing yet,
and after s, u or a.  Each row is kept, given another role or deleted, and turns without text may be inserted
before it; an edit script (the audit) is a path through the automaton.

1. Rows are sorted by conversation and turn over all tasks (a range partitioning, so that a conversation of any
   length is dealt over many), and each task cuts its range into blocks: at most BLOCK rows and about BLOCK_BYTES
   of text of one conversation.  Blocks are written once.  Most hold a whole conversation.
2. Where a conversation has several blocks, a text is a duplicate if an earlier block holds its key: keys are
   counted by conversation and hash, in the hash's task.
3. A row, a block, or many blocks in a row are all alike to the search: for each pair of states the least cost from
   one to the other, and the order of the least scripts.  Long conversations are summed up in levels of FAN
   elements, so no task holds more than FAN of one.
4. Hirschberg's scheme finds the states: the costs forward to the middle and backward from the end meet there, the
   state with the least sum is crossed, and both halves are searched in turn.  It holds two vectors of four costs
   and one state for each element, never a table of rows by states.  It goes from the top level down to blocks, and
   from a block's ends down to its rows.

Ties go to the least script in ASCII.  A script to a state ends with a row's own edit (insertions belong to the row
after them, or to the end), so of two scripts over the same rows neither begins with all of the other.  Thus the
order of the scripts to four states, carried along as four ranks, decides a tie at a crossing whatever follows,
without holding any script.

Cases: null role and text count as one space (a role of its own; a blank text), a null conv_id is one conversation,
null turns come first; rows of one turn are ordered by role, then by a hash of the text; repeated rows are duplicates;
a role's initial is its first character, and an empty role has none; an empty table gives empty results; other
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.llm.common import discard, fresh_path, materialize, table

BLOCK, BLOCK_BYTES = 1024, 4 << 20
FAN_BITS = 10  # a level sums up 2 ** FAN_BITS elements
BLANKS = " \t\n\x0b\x0c\r"
INSERT, DELETE, REROLE, CUT = 5, 2, 1, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 40
CLOSING = (0, 2 * INSERT, INSERT, 0)  # what it takes to end in a state
CLOSERS = ((), (USER, ASSISTANT), (ASSISTANT,), ())
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
CLASSES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = {"su", "ua", "au"}
SLACK = 2 * INSERT  # a state that costs more than this above another never is on a cheapest path: inserting two turns brings any state to what another accepts


def _kept(state: int, kind: int) -> int | None:
    """The state after a kept row of a class, where it may stand."""
    if kind == SYSTEM:
        return SYSTEM if state == NOTHING else None
    if kind == USER:
        return USER if state != USER else None
    return ASSISTANT if kind == ASSISTANT and state == USER else None


def _edits(kind: int, fault: int) -> list[list[tuple[int, str, tuple[int, ...]] | None]]:
    """By state before and after a row: cost, script and the states of inserted turns, of the least script."""
    out: list[list[tuple[int, str, tuple[int, ...]] | None]] = [[None] * 4 for _ in range(4)]
    for before in range(4):
        at, inserted = before, ()
        for many in range(3):
            if many:
                at = ASSISTANT if at == USER else USER
                inserted = (*inserted, at)
            ways = [(at, DELETE, "D")]
            if fault in (FINE, TRUNCATED):
                ways.append((ASSISTANT if at == USER else USER, REROLE + CUT * fault, "R"))
                if (to := _kept(at, kind)) is not None:
                    ways.append((to, CUT * fault, "K"))
            for to, cost, edit in ways:
                found = (INSERT * many + cost, "I" * many + edit, inserted)
                if out[before][to] is None or found < out[before][to]:
                    out[before][to] = found
    return out


#: By a row's kind (4 * class + fault; class 0 is any other role).
EDITS = [_edits(kind, fault) for kind in range(4) for fault in range(4)]
_SCRIPTS = sorted({e[1] for table in EDITS for row in table for e in row if e})
#: An element: costs by state before and after, and the rank of each least script among those from the same state.
ROWS = [
    (tuple(tuple(e[0] if e else NEVER for e in row) for row in table), tuple(tuple(_SCRIPTS.index(e[1]) if e else NEVER for e in row) for row in table))
    for table in EDITS
]


def begin(state: int) -> tuple[tuple, tuple]:
    return tuple(0 if s == state else NEVER for s in range(4)), (0, 0, 0, 0)


def forward(vector, element):
    """Costs and ranks of the four states after one more element; costs are relative to the least, which is returned too."""
    (costs, ranks), (step, order) = vector, element
    best = [min(((costs[x] + step[x][y], ranks[x], order[x][y]) for x in range(4) if costs[x] < NEVER and step[x][y] < NEVER), default=None) for y in range(4)]
    least = min(b[0] for b in best if b)
    best = [b if b and b[0] <= least + SLACK else None for b in best]
    by = {b[1:]: k for k, b in enumerate(sorted((b for b in best if b), key=lambda b: b[1:]))}
    return (tuple(b[0] - least if b else NEVER for b in best), tuple(by[b[1:]] if b else 0 for b in best)), least


def backward(costs, element):
    """Costs from each state through one more element at the front, relative to the least."""
    step = element[0]
    best = [min((step[x][y] + costs[y] for y in range(4) if step[x][y] < NEVER and costs[y] < NEVER), default=NEVER) for x in range(4)]
    least = min(best)
    return tuple(b - least if b < NEVER else NEVER for b in best)


@functools.lru_cache(maxsize=1 << 14)
def _row_forward(vector, kind: int):
    return forward(vector, ROWS[kind])


@functools.lru_cache(maxsize=1 << 14)
def _row_backward(costs, kind: int):
    return backward(costs, ROWS[kind])


def summed(elements, step=forward) -> tuple[tuple, tuple]:
    """Elements in a row as one."""
    costs, ranks = [], []
    for before in range(4):
        vector, total = begin(before), 0
        for e in elements:
            vector, least = step(vector, e)
            total += least
        costs.append(tuple(c + total if c < NEVER else NEVER for c in vector[0]))
        ranks.append(vector[1])
    return tuple(costs), tuple(ranks)


def ending(elements, before: int, step=forward) -> int:
    """The state in which the cheapest whole script ends, before turns are inserted at the end."""
    vector = begin(before)
    for e in elements:
        vector, _ = step(vector, e)
    costs, ranks = vector
    return min((s for s in range(4) if costs[s] < NEVER), key=lambda s: (costs[s] + CLOSING[s], ranks[s]))


def crossed(elements, before: int, after: int, ahead=forward, back=backward) -> list[int]:
    """The state after each element on the least cheapest path between two states."""
    states = [after] * len(elements)
    spans = [(0, len(elements), before, after)]
    while spans:
        lo, hi, x, y = spans.pop()
        if hi - lo < 2:
            continue
        middle = (lo + hi) // 2
        vector, costs = begin(x), begin(y)[0]
        for k in range(lo, middle):
            vector, _ = ahead(vector, elements[k])
        for k in range(hi - 1, middle - 1, -1):
            costs = back(costs, elements[k])
        meet = min((s for s in range(4) if vector[0][s] < NEVER and costs[s] < NEVER), key=lambda s: (vector[0][s] + costs[s], vector[1][s]))
        states[middle - 1] = meet
        spans += [(lo, middle, x, meet), (middle, hi, meet, y)]
    return states


# --- blocks of rows

_TEXTS = "roles array<string>, texts array<string>"
_STATS = "illegal long, head string, tail string, least_turn long, most_turn long, turns long"


def ordered(rows: DataFrame) -> DataFrame:
    """Rows in order over all tasks: conv, conv_id, turn, role, text, two hashes of role and text, blank, cut."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    r = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    end = F.rtrim("text", F.lit(BLANKS))
    r = r.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), "*", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "role", "text").alias("h2"), (end == "").alias("blank"),
        (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    return r.repartitionByRange("conv", "turn", "role", "h1", "h2").sortWithinPartitions("conv", "turn", "role", "h1", "h2")


class _Block:
    def __init__(self, conv, conv_id, at: int, first: bool):
        self.conv, self.conv_id, self.at, self.whole = conv, conv_id, at, first
        self.kinds, self.keys, self.roles, self.texts = bytearray(), [], [], []
        self.illegal, self.turns, self.least, self.most, self.bytes = 0, 0, None, None, 0

    def add(self, turn, role, text, h1, h2, blank, cut, seen: set) -> None:
        key = (h1, h2)
        fault = BLANK if blank else DUPLICATE if key in seen else TRUNCATED if cut else FINE
        if fault in (FINE, TRUNCATED):
            seen.add(key)
            self.keys.append({"pos": len(self.kinds), "h1": h1, "h2": h2})
        if self.roles and self.roles[-1][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        if turn is not None and turn != self.most:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        self.kinds.append(4 * CLASSES.get(role[:1], 0) + fault)
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(text)


_BLOCK = f"conv string, at long, whole boolean, kinds binary, keys array<struct<pos:int,h1:long,h2:long>>, {_TEXTS}, {_STATS}"


def _blocks(schema: pa.Schema):
    def out(b: _Block, whole: bool) -> pa.RecordBatch:
        row = {
            "conv": b.conv, "conv_id": b.conv_id, "at": b.at, "whole": whole, "kinds": bytes(b.kinds), "keys": [] if whole else b.keys, "roles": b.roles, "texts": b.texts, "illegal": b.illegal,
            "head": b.roles[0][:1], "tail": b.roles[-1][:1], "least_turn": b.least, "most_turn": b.most, "turns": b.turns,
        }
        return pa.RecordBatch.from_pylist([row], schema=schema)

    def made(batches):
        """One block a conversation, or several; whole if the conversation surely is in this task alone and in one block."""
        base, n, block, seen = TaskContext.get().partitionId() << 33, 0, None, set()
        begun = False
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", "conv_id", "turn", "role", "text", "h1", "h2", "blank", "cut")]
            for conv, conv_id, *rest in zip(*columns, strict=True):
                if block is None or conv != block.conv:
                    if block is not None:
                        yield out(block, block.whole)
                    block, seen = _Block(conv, conv_id, base + n, begun), set()
                    begun = True
                elif len(block.kinds) >= BLOCK or block.bytes >= BLOCK_BYTES:
                    yield out(block, False)
                    block, seen = _Block(conv, conv_id, base + n, False), set()
                block.add(*rest, seen)
                n += 1
        if block is not None:
            yield out(block, False)

    return made


def blocks(rows: DataFrame, path: str) -> DataFrame:
    """Rows (conv_id, turn, role, text) as blocks, written to ``path``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    sorted_rows = ordered(rows)
    schema = StructType.fromDDL(f"{_BLOCK}, conv_id {dict(rows.dtypes)['conv_id']}")
    sorted_rows.mapInArrow(_blocks(to_arrow_schema(schema)), schema).write.parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def _faults(kinds: bytes, repeated) -> bytes:
    """Kinds with the duplicates of earlier blocks marked."""
    out = bytearray(kinds)
    for pos in repeated or ():
        out[pos] = out[pos] // 4 * 4 + DUPLICATE
    return bytes(out)


# --- conversations of several blocks

_ELEMENT = "costs array<long>, ranks array<int>"


def _flat(element) -> dict:
    return {"costs": [c for row in element[0] for c in row], "ranks": [r for row in element[1] for r in row]}


def _element(row: dict):
    return tuple(tuple(row["costs"][4 * x : 4 * x + 4]) for x in range(4)), tuple(tuple(row["ranks"][4 * x : 4 * x + 4]) for x in range(4))


def repeated_keys(parts: DataFrame) -> DataFrame:
    """conv, at, repeated: by block, the positions of rows whose key an earlier block of the conversation holds."""
    keys = parts.select("conv", "at", F.explode("keys").alias("k")).select("conv", "at", "k.*")
    first = keys.groupBy("conv", "h1", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return keys.join(first, ["conv", "h1", "h2"]).where("at > first").groupBy("conv", "at").agg(F.collect_list("pos").alias("repeated"))


def _sum_blocks(batches):
    for batch in batches:
        rows = batch.to_pylist()
        yield pa.RecordBatch.from_pylist(
            [{"conv": r["conv"], "at": r["at"]} | _flat(summed(_faults(r["kinds"], r["repeated"]), _row_forward)) for r in rows],
            schema=pa.schema([("conv", pa.string()), ("at", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32()))]),
        )


def _sum_nodes(batches):
    for batch in batches:
        rows = batch.to_pylist()
        yield pa.RecordBatch.from_pylist(
            [{"conv": r["conv"], "at": r["at"]} | _flat(summed([_element(x) for x in r["below"]])) for r in rows],
            schema=pa.schema([("conv", pa.string()), ("at", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32()))]),
        )


def _descend(batches):
    """Nodes and the states around them (of the top: none) to their elements and the states around these."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            below = [_element(x) for x in r["below"]]
            before = NOTHING if r["before"] is None else r["before"]
            after = ending(below, before) if r["after"] is None else r["after"]
            for x, state in zip(r["below"], crossed(below, before, after), strict=True):
                out.append({"conv": r["conv"], "at": x["at"], "before": before, "after": state, "last": r["last"] and x is r["below"][-1]})
                before = state
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv", pa.string()), ("at", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("last", pa.bool_())]))


_AROUND = "conv string, at long, before int, after int, last boolean"


def _grouped(elements: DataFrame, key) -> DataFrame:
    """Elements by conversation and ``key`` of their place: conv, node, at (of the first), below (in order)."""
    g = elements.groupBy("conv", key.alias("node")).agg(F.sort_array(F.collect_list(F.struct("at", "costs", "ranks"))).alias("below"))
    return g.select("conv", "node", F.col("below")[0]["at"].alias("at"), "below")


def block_states(elements: DataFrame) -> DataFrame:
    """conv, at, before, after, last: the states around each block of conversations, from its costs."""
    levels, shift = [], 0
    while (elements.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > 1 << FAN_BITS:
        shift += FAN_BITS
        nodes = materialize(_grouped(elements, F.shiftright("at", shift)), "repair-nodes")
        levels.append(nodes)
        elements = materialize(nodes.mapInArrow(_sum_nodes, f"conv string, at long, {_ELEMENT}"), "repair-elements")
    none = F.lit(None).cast("int")
    top = _grouped(elements, F.lit(0)).select("conv", "below", none.alias("before"), none.alias("after"), F.lit(True).alias("last"))
    around = top.mapInArrow(_descend, _AROUND)
    for nodes in reversed(levels):
        around = nodes.join(around, ["conv", "at"]).select("conv", "below", "before", "after", "last").mapInArrow(_descend, _AROUND)
    return around


# --- scripts and repaired rows


def _repaired(schema: pa.Schema):
    names = {USER: "user", ASSISTANT: "assistant"}

    def made(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                kinds = _faults(r["kinds"], r.pop("repeated"))
                before, after, last = r.pop("before"), r.pop("after"), r.pop("last")
                if before is None:
                    before, after, last = NOTHING, ending(kinds, NOTHING, _row_forward), True
                cost, script, roles, texts, edits = 0, [], [], [], []

                def insert(state):
                    roles.append(names[state])
                    texts.append("")
                    edits.append("I")

                for kind, state, role, text in zip(kinds, crossed(kinds, before, after, _row_forward, _row_backward), r["roles"], r["texts"], strict=True):
                    price, edit, inserted = EDITS[kind][before][state]
                    cost += price
                    script.append(edit)
                    for s in inserted:
                        insert(s)
                    if edit[-1] != "D":
                        roles.append(role if edit[-1] == "K" else names[state])
                        texts.append(text)
                        edits.append(edit[-1])
                    before = state
                if last:
                    cost += CLOSING[before]
                    script.append("I" * len(CLOSERS[before]))
                    for s in CLOSERS[before]:
                        insert(s)
                faults = [kind % 4 for kind in kinds]
                r |= {"cost": cost, "audit": "".join(script), "roles": roles, "texts": texts, "edits": edits}
                r |= {name: faults.count(fault) for name, fault in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in schema.names}], schema=schema)

    return made


_PIECE = f"conv string, at long, whole boolean, {_TEXTS}, edits array<string>, {_STATS}, blank long, duplicate long, truncated long, cost long, audit string"


def pieces(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as repaired blocks: the script, cost and faults of each, and its rows after repair."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = rows.sparkSession
    path = fresh_path(spark, "repair-blocks")
    made = blocks(rows, path)
    parts = made.where(~F.col("whole"))
    several = parts.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv")
    parts_of_several = parts.select("conv", "at", "kinds", "keys").join(several, "conv", "left_semi")
    repeated = materialize(repeated_keys(parts_of_several), "repair-repeated")
    elements = parts_of_several.drop("keys").join(repeated, ["conv", "at"], "left").mapInArrow(_sum_blocks, f"conv string, at long, {_ELEMENT}")
    around = block_states(materialize(elements, "repair-elements"))
    known = around.join(repeated, ["conv", "at"], "left")
    none = {"repeated": F.lit(None).cast("array<int>"), "before": F.lit(None).cast("int"), "after": F.lit(None).cast("int"), "last": F.lit(None).cast("boolean")}
    both = made.where("whole").withColumns(none).unionByName(parts.join(known, ["conv", "at"], "left"))
    schema = StructType.fromDDL(f"{_PIECE}, conv_id {dict(rows.dtypes)['conv_id']}")
    out = materialize(both.drop("keys").mapInArrow(_repaired(to_arrow_schema(schema)), schema), "repair-pieces")
    discard(spark, path)
    return out


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, at, pos, edit, role, text: the conversations after repair, in the order of at and pos."""
    zipped = F.posexplode(F.arrays_zip("edits", "roles", "texts")).alias("pos", "row")
    return pieces(rows).select("conv_id", "at", zipped).select("conv_id", "at", "pos", F.col("row.edits").alias("edit"), F.col("row.roles").alias("role"), F.col("row.texts").alias("text"))


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _reports(schema: pa.Schema):
    """Pieces in the order of their conversations to one row a conversation; a text is held no longer than its piece."""
    sums = ("blank", "duplicate", "truncated", "illegal", "cost", "turns")

    def made(batches):
        at, found = None, None

        def out():
            turns = 0 if found["least"] is None else found["most"] - found["least"] + 1 - found["turns"]
            row = {"conv_id": found["conv_id"], "gaps": turns, "audit": "".join(found["audit"]), "repaired_sha256": found["sha"].hexdigest()}
            return pa.RecordBatch.from_pylist([row | {c: found[c] for c in sums[:-1]}], schema=schema)

        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                if r["conv"] != at:
                    if found:
                        yield out()
                    at = r["conv"]
                    found = dict.fromkeys(sums, 0) | {"conv_id": r["conv_id"], "audit": [], "sha": hashlib.sha256(), "any": False, "tail": None, "least": None, "most": None}
                for c in sums:
                    found[c] += r[c]
                if found["tail"] is not None and found["tail"] + r["head"] not in LEGAL:
                    found["illegal"] += 1
                found["tail"] = r["tail"]
                if r["least_turn"] is not None:
                    found["turns"] -= found["most"] == r["least_turn"]
                    found["least"] = r["least_turn"] if found["least"] is None else found["least"]
                    found["most"] = r["most_turn"]
                found["audit"].append(r["audit"])
                for role, text in zip(r["roles"], r["texts"], strict=True):
                    found["sha"].update(f"{chr(10) if found['any'] else ''}{role}:{text}".encode(errors="surrogatepass"))
                    found["any"] = True
        if found:
            yield out()

    return made


def reports(rows: DataFrame) -> DataFrame:
    """One row a conversation: its gaps, faults, cost, script and the digest of its repaired rows.

    Only conversations of several pieces are shuffled; a digest reads a conversation in order, one piece at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(f"conv_id {dict(rows.dtypes)['conv_id']}, {_REPORT}")
    done = pieces(rows).drop("edits")
    fold = _reports(to_arrow_schema(schema))
    rest = done.where(~F.col("whole")).repartition("conv").sortWithinPartitions("conv", "at")
    return done.where("whole").mapInArrow(fold, schema).unionByName(rest.mapInArrow(fold, schema))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults, by a checksum of conversation and turn: dropped, emptied, cut, repeated, given to the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    r = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("fault"))
    r = r.where("fault <> 0").withColumn("text", F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    r = r.withColumn("role", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")))
    return r.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = reports(damaged(rows)).withColumnRenamed("conv_id", "_id")
    ids = rows.select("conv_id").distinct()
    both = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
