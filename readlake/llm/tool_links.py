"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

1. Calls and results of a conversation are hash-joined by identifier; either may lack the other.
2. A call's level is one more than the highest level of the calls that it depends on, found by joins: chains
   of single dependencies by doubling, calls with several a level a round (calls of a cycle, and behind one,
   get none; a dependency that doesn't exist is reported).  Sorting by
   conv_id, level and turn is a topological order; no window needs a whole conversation in a task.
3. Arguments are parsed as VARIANT and held against the tool's parameters: missing, unknown and wrongly
   typed ones are listed.
4. A linked call is written as canonical JSON: keys sorted, no white space (what VARIANT's text form is).

All of it is DataFrame and SQL functions.

Cases: rows without conversation or identifier link to nothing; arguments that aren't a JSON object are
invalid; of several calls (results) with one identifier the first turn counts and the others are reported
as duplicates; null text is an empty result; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.llm.common import materialize, table

#: Parameters of the tools that the query's calls use: tool -> [(parameter, VARIANT type, required)].
TOOLS = {
    "search": [("query", "STRING", True), ("limit", "BIGINT", True), ("exact", "BOOLEAN", False)],
    "summarise": [("text", "STRING", True), ("words", "BIGINT", True)],
    "translate": [("text", "STRING", True), ("target", "STRING", True)],
}


def schema_table(spark: SparkSession, tools: dict = TOOLS) -> DataFrame:
    rows = [(name, [(p, kind, need) for p, kind, need in params]) for name, params in tools.items()]
    return spark.createDataFrame(rows, "name string, params array<struct<param:string,kind:string,required:boolean>>")


def first_of_each(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per conversation and identifier (the first turn's), and how many there were."""
    packed = F.struct("turn", *[c for c in columns if c != "turn"])
    return (
        rows.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
        .groupBy("conv_id", "call_id")
        .agg(F.min(packed).alias("first"), F.count(F.lit(1)).alias("times"))
        .select("conv_id", "call_id", "times", "first.*")
    )


def _jumped(single: DataFrame, most: int) -> DataFrame:
    """(conv_id, call_id, to, hops): where each call's chain of single dependencies ends, found by doubling.

    single: conv_id, call_id, dep.  Chains that don't end within ``most`` calls go round in a cycle and are left out.
    """
    ends = single.select("conv_id", F.col("call_id").alias("to"))
    point = materialize(single.select("conv_id", "call_id", F.col("dep").alias("to"), F.lit(1).cast("long").alias("hops")), "tool-jumps")
    for _ in range(max(1, most).bit_length()):
        far = point.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"))
        point = materialize(
            point.join(far, ["conv_id", "to"], "left").select("conv_id", "call_id", F.coalesce("next", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")), "tool-jumps"
        )
    return point.join(ends, ["conv_id", "to"], "left_anti")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls (conv_id, call_id, depends) that lie on no cycle and behind none.

    Chains of calls with one dependency each are followed by doubling, in a number of rounds that is the logarithm
    of their length.  What remains are calls with several dependencies, which are placed a level a round.
    """
    nodes = calls.select("conv_id", "call_id")
    wanted = calls.select("conv_id", "call_id", F.explode(F.array_distinct("depends")).alias("dep"))
    there = nodes.select("conv_id", F.col("call_id").alias("dep"))
    edges = materialize(wanted.join(there, ["conv_id", "dep"]), "tool-edges")
    counted = materialize(edges.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("dep")), "tool-counts")
    free = nodes.join(counted, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0).cast("long"))
    most = counted.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if not most:
        return free.withColumn("level", F.col("level").cast("int"))
    jumps = materialize(_jumped(counted.where("n = 1").select("conv_id", "call_id", "dep"), most), "tool-ends")
    # calls with several dependencies: each dependency stands for the end of its chain
    via = jumps.select("conv_id", F.col("call_id").alias("dep"), "to", "hops")
    several = edges.join(counted.where("n > 1").select("conv_id", "call_id"), ["conv_id", "call_id"], "left_semi")
    chained = counted.where("n = 1").select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("chained"))
    some = several.join(via, ["conv_id", "dep"], "left").join(chained, ["conv_id", "dep"], "left")
    # (a chain that ends nowhere leads into a cycle: ``to`` is then no call that is ever placed)
    end = F.when(F.col("chained"), F.col("to")).otherwise(F.col("dep"))
    open_ = materialize(some.select("conv_id", "call_id", end.alias("to"), (F.coalesce("hops", F.lit(0)) + 1).alias("hops")), "tool-open")
    placed = materialize(free, "tool-levels")
    out, fresh = placed, placed
    reached = None
    while not open_.isEmpty() and not fresh.isEmpty():
        at = fresh.select("conv_id", F.col("call_id").alias("to"), "level")
        hit = open_.join(at, ["conv_id", "to"]).groupBy("conv_id", "call_id").agg(F.max(F.col("level") + F.col("hops")).alias("level"))
        reached = materialize((hit if reached is None else reached.unionByName(hit)).groupBy("conv_id", "call_id").agg(F.max("level").alias("level")), "tool-reached")
        open_ = materialize(open_.join(at, ["conv_id", "to"], "left_anti"), "tool-open")
        waiting = open_.select("conv_id", "call_id").distinct()
        fresh = materialize(reached.join(waiting, ["conv_id", "call_id"], "left_anti"), "tool-levels")
        reached = materialize(reached.join(waiting, ["conv_id", "call_id"], "left_semi"), "tool-reached")
        out = out.unionByName(fresh)
    behind = jumps.join(out.select("conv_id", F.col("call_id").alias("to"), "level"), ["conv_id", "to"]).select("conv_id", "call_id", (F.col("level") + F.col("hops")).alias("level"))
    return out.unionByName(behind).withColumn("level", F.col("level").cast("int"))


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per identifier of a conversation.

    calls: conv_id, turn, call_id, name, arguments (JSON text), depends (array of call ids);
    results: conv_id, turn, call_id, content; schemas: name, params.
    """
    own = first_of_each(calls, ["turn", "name", "arguments", "depends"])
    own = materialize(own, "tool-calls")
    got = first_of_each(results.withColumn("content", F.coalesce("content", F.lit(""))), ["turn", "content"]).select(
        "conv_id", "call_id", F.col("turn").alias("result_turn"), F.col("times").alias("result_times"), "content"
    )
    missing = (
        own.select("conv_id", "call_id", F.explode(F.array_distinct("depends")).alias("dep"))
        .join(own.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_anti")
        .groupBy("conv_id", "call_id")
        .agg(F.count(F.lit(1)).alias("missing_deps"))
    )
    key = ["conv_id", "call_id"]
    both = own.hint("shuffle_hash").join(got, key, "full").join(levels(own), key, "left").join(missing, key, "left").join(schemas, "name", "left")
    both = both.withColumn("parsed", F.expr("try_parse_json(arguments)"))
    both = both.withColumn("args", F.expr("case when schema_of_variant(parsed) like 'OBJECT%' then cast(parsed as map<string, variant>) end"))
    errors = F.expr(
        """case when name is null then cast(array() as array<string>)
             when params is null then array('unknown tool')
             when args is null then array('arguments are no object')
             else array_sort(concat(
               transform(filter(params, p -> p.required and not map_contains_key(args, p.param)), p -> concat('missing ', p.param)),
               transform(filter(params, p -> map_contains_key(args, p.param) and schema_of_variant(element_at(args, p.param)) <> p.kind), p -> concat('type of ', p.param)),
               transform(array_except(map_keys(args), transform(params, p -> p.param)), k -> concat('unknown ', k)))) end"""
    )
    status = F.expr(
        """case when name is null then 'result without call' when result_turn is null then 'call without result'
             when result_turn <= turn then 'result before call' when level is null then 'cycle'
             when coalesce(missing_deps, 0) > 0 then 'missing dependency' else 'linked' end"""
    )
    out = both.select(
        "conv_id", "call_id", F.col("turn").alias("call_turn"), "result_turn", "name", "level", status.alias("status"),
        (F.coalesce("times", F.lit(1)) - 1 + F.coalesce("result_times", F.lit(1)) - 1).cast("int").alias("duplicates"),
        errors.alias("errors"), "arguments", "parsed", "content",
    )
    json = F.expr(
        """concat('{"arguments":', coalesce(to_json(parsed), 'null'), ',"id":', to_json(call_id_v), ',"name":', to_json(name_v), ',"result":', to_json(content_v), '}')"""
    )
    text = lambda c: F.expr(f"cast({c} as variant)")
    good = (F.col("status") == "linked") & (F.size("errors") == 0)
    return (
        out.withColumn("valid", F.size("errors") == 0)
        .withColumn("call_id_v", text("call_id"))
        .withColumn("name_v", text("name"))
        .withColumn("content_v", text("content"))
        .withColumn("json", F.when(good, json))
        .drop("arguments", "parsed", "content", "call_id_v", "name_v", "content_v")
    )


def derived_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tool calls and results that the conversations stand for.

    A user's turn is a call (its tool by its length, its arguments from its text, some of them wrong); the
    turn after it, if the assistant's, is the result.  A call depends on that of half its turn.
    """
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    name = F.expr("element_at(array('search', 'summarise', 'translate', 'forget'), cast(case when length(text) % 23 = 0 then 4 else length(text) % 3 + 1 end as int))")
    arguments = F.expr(
        """case when turn % 11 = 10 then concat('[', length(text), ']')
             when length(text) % 3 = 0 and turn % 7 = 4 then to_json(named_struct('query', text, 'limit', 'ten'))
             when length(text) % 3 = 0 then to_json(named_struct('query', text, 'limit', length(text) % 10))
             when length(text) % 3 = 1 then to_json(named_struct('words', 20, 'text', text))
             when turn % 5 = 2 then to_json(named_struct('text', text, 'to', 'en'))
             else to_json(named_struct('text', text, 'target', 'en')) end"""
    )
    calls = c.where("role = 'user'").select(
        "conv_id", "turn", F.concat(F.lit("call_"), F.col("turn")).alias("call_id"), name.alias("name"), arguments.alias("arguments"),
        F.expr("case when turn >= 2 then array(concat('call_', 2 * cast(floor(turn / 4) as bigint) + turn % 2)) else cast(array() as array<string>) end").alias("depends"),
    )
    results = c.where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("call_"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op2_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = derived_calls(table(spark, sf_dir, "conversations"))
    return linked(calls, results, schema_table(spark)).select(
        "conv_id", "call_id", "call_turn", "result_turn", "name", "level", "status", "duplicates", F.array_join("errors", "; ").alias("errors"), "valid", "json"
    )
