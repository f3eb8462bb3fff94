"""Tool calls and their results, linked, ordered, checked and serialised (DataFrame operations only).

Calls and results meet in a hash join on (conversation, identifier); both sides first keep one row per
identifier, so a repeated identifier never multiplies rows and a hot one is reduced before it moves. A call may
name the call it follows; levels (calls to follow back) give a topological order and come from pointer doubling,
each round joining every open call with the call its pointer stands on, so a chain of n calls takes log2(n) rounds.
Arguments are parsed as variants, checked against the tool's schema by column expressions, and written as
canonical JSON: sorted keys, no spaces, no null members.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.llm.common import saved

#: JSON schema types and how Spark names a variant's type.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN",
         "object": "OBJECT<.*", "array": "ARRAY<.*", "null": "VOID"}


def _levels(calls: DataFrame) -> DataFrame:
    """(conv, id, parent) with one row per (conv, id): (conv, id, level). A call whose parent is not a call of its
    conversation is at level 0; calls on a cycle or behind one have level null."""
    ids = calls.select(F.col("conv").alias("c"), F.col("id").alias("i"))
    known = calls.join(ids, F.col("conv").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("i")), "left")
    now = saved(known.select("conv", "id", F.col("i").alias("to"), F.col("i").isNotNull().cast("long").alias("level")))
    rounds = ceil(log2(now.count() + 1)) + 1
    for _ in range(rounds):
        if now.filter(F.col("to").isNotNull()).isEmpty():
            break
        on = now.select(F.col("conv").alias("c"), F.col("id").alias("i"), F.col("to").alias("next"), F.col("level").alias("more"))
        still = now.filter(F.col("to").isNotNull())
        moved = still.join(on, F.col("conv").eqNullSafe(F.col("c")) & (F.col("to") == F.col("i")))
        now = saved(moved.select("conv", "id", F.col("next").alias("to"), (F.col("level") + F.col("more")).alias("level"))
                    .unionByName(now.filter(F.col("to").isNull())))
    return now.select("conv", "id", F.when(F.col("to").isNull(), F.col("level")).alias("level"))


def problems(name: Column, parsed: Column, text: Column, schemas: dict[str, dict]) -> Column:
    """What is wrong with a call's arguments, as an array of short texts. ``schemas``: by tool, ``properties`` (by name:
    type, and minLength, minimum or maximum), ``required`` and ``additionalProperties`` (default true)."""
    def of(schema: dict) -> Column:
        found = []
        for p in schema.get("required", []):
            found.append(F.when(F.try_variant_get(parsed, f"$.{p}", "variant").isNull(), F.lit(f"{p}: missing")))
        for p, rule in schema.get("properties", {}).items():
            value = F.try_variant_get(parsed, f"$.{p}", "variant")
            fits = F.schema_of_variant(value).rlike(f"^({TYPES[rule['type']]})$")
            found.append(F.when(value.isNotNull() & ~fits, F.lit(f"{p}: not {rule['type']}")))
            if "minLength" in rule:
                found.append(F.when(F.length(F.try_variant_get(parsed, f"$.{p}", "string")) < rule["minLength"],
                                    F.lit(f"{p}: too short")))
            number = F.try_variant_get(parsed, f"$.{p}", "double")
            if "minimum" in rule:
                found.append(F.when(fits & (number < rule["minimum"]), F.lit(f"{p}: too small")))
            if "maximum" in rule:
                found.append(F.when(fits & (number > rule["maximum"]), F.lit(f"{p}: too large")))
        if not schema.get("additionalProperties", True):
            known = F.array(*[F.lit(p) for p in schema.get("properties", {})]).cast("array<string>")
            found.append(F.when(F.size(F.array_except(F.json_object_keys(text), known)) > 0, F.lit("unknown members")))
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    shape = F.schema_of_variant(parsed).rlike("^OBJECT<")
    by_tool = reduce(lambda rest, kv: F.when(name == kv[0], of(kv[1])).otherwise(rest), schemas.items(),
                     F.array(F.lit("unknown tool")))
    return F.when(parsed.isNull() | ~shape, F.array(F.lit("not a JSON object"))).otherwise(by_tool)


def linked_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call, and per result without a call: conv_id, call_id, turn, level, name, valid, problems,
    arguments, result, n_calls, n_results, status, json.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), parent_id (null: none); ``results``: conv_id, turn,
    call_id, content; other columns are ignored. Of several calls or results with one identifier the one with the
    least turn counts (then the least values, nulls first) and n_calls and n_results tell how many there were. status:
    ``linked``, ``no_result``, ``no_call`` (a result alone) or ``no_id`` (a call or result without identifier, one row
    each). Ordered by level, turn and call_id, the calls of a conversation follow their parents; level is null on
    cycles. Empty tables give empty results.
    """
    told = calls.select(F.col("conv_id").alias("conv"), F.col("call_id").cast("string").alias("id"), F.struct(
        F.col("turn"), F.col("name").cast("string").alias("name"), F.col("arguments").cast("string").alias("arguments"),
        F.col("parent_id").cast("string").alias("parent")).alias("call"))
    came = results.select(F.col("conv_id").alias("conv"), F.col("call_id").cast("string").alias("id"), F.struct(
        F.col("turn"), F.col("content").cast("string").alias("content")).alias("result"))
    one = saved(told.filter("id is not null").groupBy("conv", "id").agg(F.min("call").alias("call"), F.count("*").alias("n_calls")))
    answer = came.filter("id is not null").groupBy("conv", "id").agg(F.min("result").alias("result"), F.count("*").alias("n_results"))
    levels = _levels(one.select("conv", "id", F.col("call.parent").alias("parent")))
    one = one.join(levels.toDF("lc", "li", "level"), F.col("conv").eqNullSafe(F.col("lc")) & (F.col("id") == F.col("li"))).drop("lc", "li")
    answer = answer.toDF("rc", "ri", "result", "n_results")
    both = one.join(answer, F.col("conv").eqNullSafe(F.col("rc")) & (F.col("id") == F.col("ri")), "full")
    both = both.select(
        F.when(F.col("call").isNotNull(), F.col("conv")).otherwise(F.col("rc")).alias("conv"), F.coalesce("id", "ri").alias("id"),
        "call", "result", "level", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.when(F.col("call").isNull(), "no_call").when(F.col("result").isNull(), "no_result").otherwise("linked").alias("status"))
    rest = {"level": F.lit(None).cast("long"), "n_calls": F.lit(0), "n_results": F.lit(0), "status": F.lit("no_id")}
    loose = [df.filter("id is null").withColumns(rest | {n: F.lit(1)})
             for df, n in ((told, "n_calls"), (came, "n_results"))]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), loose, both)
    parsed = F.try_parse_json(F.col("call.arguments"))
    rows = both.select("*", parsed.alias("parsed"))
    wrong = F.when(F.col("call").isNotNull(), problems(F.col("call.name"), F.col("parsed"), F.col("call.arguments"), schemas))
    rows = rows.select(F.col("conv").alias("conv_id"), F.col("id").alias("call_id"),
                       F.coalesce("call.turn", "result.turn").alias("turn"), "level", F.col("call.name").alias("name"),
                       wrong.alias("problems"), F.to_json("parsed").alias("arguments"), F.col("result.content").alias("result"),
                       F.col("n_calls").cast("long").alias("n_calls"), F.col("n_results").cast("long").alias("n_results"), "status")
    rows = rows.withColumn("valid", F.when(F.col("problems").isNotNull(), F.size("problems") == 0))
    plain = F.to_json(F.struct(F.col("call_id").alias("id"), "level", "name", "result", "status"))
    return rows.withColumn("json", F.concat(F.coalesce(F.concat(F.lit('{"arguments":'), "arguments", F.lit(",")), F.lit("{")),
                                            F.substr(plain, F.lit(2))))


def exchanges(conversations: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, dict]]:
    """Conversations as calls and results of one tool: a user's message calls ``reply`` with its text and turn, as
    identifier the conversation and the turn, and follows the user's message two turns before; an assistant's
    message is the result of the call in the turn before. (conv_id, turn, role, text.)"""
    at = lambda back: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    calls = conversations.filter("role = 'user'").select(
        "conv_id", "turn", F.when(known, at(0)).alias("call_id"), F.lit("reply").alias("name"),
        F.to_json(F.struct("text", "turn")).alias("arguments"), F.when(known, at(2)).alias("parent_id"))
    results = conversations.filter("role = 'assistant'").select(
        "conv_id", "turn", F.when(known, at(1)).alias("call_id"), F.col("text").alias("content"))
    schema = {"reply": {"properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
                        "required": ["text", "turn"], "additionalProperties": False}}
    return calls, results, schema
