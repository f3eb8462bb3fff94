import json

import pytest

from rentlens.llm import tool_calls

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, parent_id string"
RESULTS = "conv_id long, turn long, call_id string, content string"
SCHEMA = {"add": {"properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "number", "maximum": 9},
                                 "s": {"type": "string", "minLength": 2}}, "required": ["a"], "additionalProperties": False},
          "any": {}}


def linked(spark, calls, results):
    return tool_calls.linked_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMA)


@pytest.mark.parametrize("arguments,wrong", [
    ('{"b": 1.5, "a": 3}', []), ('{"a": 1, "s": "xy"}', []), ('{"b": 1}', ["a: missing"]), ('{"a": "3"}', ["a: not integer"]),
    ('{"a": -1}', ["a: too small"]), ('{"a": 1, "b": 10}', ["b: too large"]), ('{"a": 1, "s": "x"}', ["s: too short"]),
    ('{"a": 1, "z": 0}', ["unknown members"]), ("[1]", ["not a JSON object"]), ("{", ["not a JSON object"]), (None, ["not a JSON object"]),
    ('{"a": 1.5}', ["a: not integer"]), ('{"a": null}', ["a: not integer"])])
def test_schemas(spark, arguments, wrong):
    r = linked(spark, [(1, 0, "x", "add", arguments, None)], []).first()
    assert (r.problems, r.valid) == (wrong, not wrong)


def test_links_levels_and_json(spark):
    calls = [(1, 0, "a", "any", '{ "z":1, "a": {"y": [1, 2], "b": "\\u00e9"}}', None), (1, 4, "b", "any", "{}", "a"),
             (1, 2, "c", "any", "{}", "b"), (1, 9, "c", "any", '{"later": 1}', None), (1, 5, "d", "any", "{}", "elsewhere"),
             (2, 1, "a", "none", "{}", "a"), (3, 1, "p", "any", "{}", "q"), (3, 2, "q", "any", "{}", "p"),
             (3, 3, "r", "any", "{}", "q"), (None, 1, "a", "any", "{}", None), (1, 7, None, "any", "{}", "a")]
    results = [(1, 1, "a", "done"), (1, 3, "a", "again"), (1, 2, "zz", "lost"), (None, 2, "a", "null"), (4, 1, "a", None), (4, 1, None, "x")]
    got = {(r.conv_id, r.call_id): r for r in linked(spark, calls, results).collect()}
    assert len(got) == 13
    assert {k: r.level for k, r in got.items() if k[0] == 1 and k[1]} == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): 0, (1, "zz"): None}
    assert [got[3, x].level for x in "pqr"] == [None] * 3 and got[2, "a"].level is None
    a = got[1, "a"]
    assert (a.result, a.n_results, a.status) == ("done", 2, "linked")
    assert got[1, "c"].n_calls == 2 and got[1, "c"].turn == 2 and got[1, "c"].status == "no_result"
    assert got[1, "zz"].status == "no_call" and got[1, "zz"].valid is None
    assert got[None, "a"].result == "null" and got[None, "a"].status == "linked"
    assert got[1, None].status == got[4, None].status == "no_id"
    assert got[2, "a"].problems == ["unknown tool"]
    told = json.loads(a.json)
    assert a.json == json.dumps(told, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert told == {"arguments": {"a": {"b": "é", "y": [1, 2]}, "z": 1}, "id": "a", "level": 0, "name": "any", "result": "done",
                    "status": "linked"}


def test_long_chains(spark):
    calls = [(1, i, f"k{i}", "any", "{}", f"k{i - 1}") for i in range(300)]
    got = linked(spark, calls, []).collect()
    assert {r.call_id: r.level for r in got} == {f"k{i}": i for i in range(300)}


def test_empty_tables_and_clashing_names(spark):
    from pyspark.sql import functions as F
    assert linked(spark, [], []).count() == 0
    calls = spark.createDataFrame([(1, 0, "x", "any", "{}", None)], CALLS).withColumns({c: F.lit("own") for c in ("conv", "id", "call", "level", "json", "parsed")})
    results = spark.createDataFrame([(1, 1, "x", "r")], RESULTS).withColumns({c: F.lit("own") for c in ("conv", "id", "rc", "ri", "result")})
    assert tool_calls.linked_calls(calls, results, SCHEMA).first().status == "linked"


def test_conversations_with_nulls(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "user", None), (None, 0, "user", "x"), (1, None, "user", "y"),
            (2, 3, "assistant", "first"), (1, 0, "user", "hi"), (1, 3, None, "z"), (5, 0, "user", "")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in tool_calls.linked_calls(*tool_calls.exchanges(conv)).collect()}
    assert got[1, 0].n_calls == 2 and got[1, 0].status == "linked" and got[1, 0].result is None
    assert got[1, 2].problems == ["text: missing"] and got[1, 2].level == 1
    assert got[None, 0].status == got[1, None].status == "no_id"
    assert got[2, 3].status == "no_call" and got[5, 0].problems == ["text: too short"]
