"""Linking, order and checks of tool calls."""

import json
import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.llm import tool_calls as C

SCHEMAS = {
    "add": {
        "type": "object",
        "properties": {"a": {"type": "integer", "minimum": 0, "maximum": 9}, "b": {"type": "array", "items": {"type": "number"}}},
        "required": ["a"],
        "additionalProperties": False,
    },
    "pick": {"type": "object", "properties": {"s": {"type": "string", "enum": ["x", "y"], "minLength": 1}}},
}
CALLS = "conv long, turn long, id string, name string, arguments string, after array<string>"
RESULTS = "conv long, turn long, id string, content string"


def linked(spark, calls, results):
    a, b = spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)
    return C.link(a.repartition(3), b.repartition(2), SCHEMAS).collect()


def test_links_and_records(spark):
    calls = [
        (1, 0, "a", "add", '{"b": [1, 2.5], "a": 3}', []),
        (1, 2, "b", "pick", '{"s":"é\\n"}', ["a"]),
        (1, 4, "c", "add", '{"a": 1}', ["zz"]),
        (1, 6, "d", "none", "{}", None),
        (1, 8, "e", "add", "{oops", []),
        (1, 9, "f", "add", "NaN", []),
        (1, 9, "g", "add", None, []),
        (2, 0, None, "add", '{"a": 1}', []),
        *[(3, 5 + i, "many", "add", '{"a": 1}', []) for i in range(50)],
    ]
    results = [(1, 1, "a", "4"), (1, 5, "a", "late"), (1, 3, "b", None), (1, 9, "lost", "?"), (None, None, None, "x")]
    results += [(3, 90 + i, "many", f"r{i}") for i in range(50)]
    rows = linked(spark, calls, results)
    by = {r["call_id"]: r for r in rows if r["call_id"]}
    assert len(rows) == 8 + 1 + 2
    assert {k: r["status"] for k, r in by.items()} == {
        "a": "linked", "b": "linked", "c": "no_result", "d": "no_result", "e": "no_result", "f": "no_result",
        "g": "no_result", "many": "linked", "lost": "no_call",
    }
    assert by["a"]["record"] == '{"arguments":{"a":3,"b":[1,2.5]},"id":"a","name":"add","result":"4"}'
    assert by["a"]["valid"] and by["a"]["n_results"] == 2 and by["many"]["n_calls"] == by["many"]["n_results"] == 50
    assert by["many"]["turn"] == 5 and json.loads(by["many"]["record"])["result"] == "r0"
    errors = {k: by[k]["error"] for k in "bcdefg"}
    assert errors == {
        "b": "s: not one of the allowed values", "c": "after: no such call", "d": "name: unknown tool",
        "e": "arguments: not JSON", "f": "arguments: not JSON", "g": "arguments: not JSON",
    }
    assert sum(r["status"] == "no_id" for r in rows) == 2
    assert linked(spark, [], []) == [] and len(linked(spark, [], results)) == 5


def test_no_repeat_is_dropped(spark):
    """Ids numbered per conversation stay apart, and repeats that differ keep rows of their own."""
    ask = lambda n: f'{{"a": {n}}}'
    calls = [(c, 0, "call_1", "add", ask(c), []) for c in (1, 2, 3)] + [(c, 2, "call_2", "add", ask(c), ["call_1"]) for c in (1, 2)]
    calls += [(3, 2, "call_3", "add", ask(3), ["call_2"]), (None, 0, "call_1", "add", ask(4), [])]
    calls += [(1, 0, "call_1", "add", ask(1), [])] + [(2, 0, "call_1", "add", ask(7), []), (2, 4, "call_1", "add", ask(2), [])] * 2
    results = [(c, 1, "call_1", f"r{c}") for c in (1, 2, 3)] + [(None, 1, "call_1", "rn"), (2, 1, "call_1", "other"), (2, 1, "call_1", "other")]
    a, b = spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)
    rows = C.link(a.repartition(3), b.repartition(2), SCHEMAS, repeats=True).collect()
    main = {(r["conv"], r["call_id"]): r for r in rows if r["status"] != "duplicate_id"}
    assert len(main) == 7 and len(rows) == 7 + 3
    for conv, n in ((1, 1), (3, 3), (None, 4)):
        assert json.loads(main[conv, "call_1"]["record"])["arguments"] == {"a": n} and main[conv, "call_1"]["status"] == "linked"
        assert json.loads(main[conv, "call_1"]["record"])["result"] == ("rn" if conv is None else f"r{conv}")
    assert main[1, "call_2"]["valid"] and main[3, "call_3"]["error"] == "after: no such call"
    assert main[1, "call_1"]["n_calls"] == 2 and main[2, "call_1"]["n_calls"] == 5 and main[2, "call_1"]["n_results"] == 3
    told = {(r["turn"], r["record"]): (r["n_calls"], r["n_results"], r["valid"]) for r in rows if r["status"] == "duplicate_id"}
    spare = [(json.loads(k[1])["arguments"], json.loads(k[1])["result"], v) for k, v in sorted(told.items())]
    assert spare == [
        ({"a": 7}, None, (2, 0, False)), (None, "r2", (0, 1, False)), ({"a": 2}, None, (2, 0, False))
    ]
    texts = {(c, a) for c, _, _, _, a, _ in calls} | {(c, t) for c, _, _, t in results}
    kept = {(r["conv"], canonical_args(r)) for r in rows if r["n_calls"]} | {(r["conv"], json.loads(r["record"])["result"]) for r in rows}
    assert texts <= kept


def canonical_args(row):
    return json.dumps(json.loads(row["record"])["arguments"])


def test_order_is_topological(spark):
    rng = random.Random(1)
    calls, deps = [], {}
    for conv in range(12):
        order = list(range(10))
        turns = order if conv % 3 == 0 else rng.sample(order, 10)
        for i in order:
            after = [f"{conv}-{j}" for j in rng.sample(range(i), min(i, rng.randint(0, 2)))]
            deps[f"{conv}-{i}"] = after
            calls.append((conv, turns[i], f"{conv}-{i}", "pick", "{}", after))
    calls += [(50, 0, "p", "pick", "{}", ["q"]), (50, 1, "q", "pick", "{}", ["p"]), (50, 2, "r", "pick", "{}", ["r"])]
    rows = {r["call_id"]: r for r in linked(spark, calls, [])}
    place = {k: (r["wave"], r["turn"]) for k, r in rows.items()}
    assert all(place[d] < place[k] for k, after in deps.items() for d in after)
    assert all(rows[k]["error"] == "after: in a circle" for k in "pqr") and rows["1-3"]["valid"]
    assert all(rows[f"{c}-{i}"]["wave"] == 0 for c in (0, 3, 6, 9) for i in range(10))


@pytest.mark.parametrize(
    "value, fault",
    [
        ({"a": 1}, None), ({"a": True}, "a: not integer"), ({"a": 10}, "a: out of range"), ({}, "a: missing"),
        ({"a": 1, "z": 1}, "z: unknown"), ({"a": 1, "b": ["x"]}, "b[]: not number"), ([], "arguments: not object"),
    ],
)
def test_schema(value, fault):
    assert C.problem(value, SCHEMAS["add"]) == fault


def test_turns_as_calls(spark):
    talk = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", None), (1, 3, "assistant", "?"), (2, 0, "system", "s")]
    talk += [(2, 1, "user", ""), (None, 0, "user", "x"), (3, None, "assistant", "y")]
    calls, results = C.turns_as_calls(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string"))
    rows = C.link(calls, results, C.TURN_TOOLS).collect()
    by = {r["call_id"]: r for r in rows if r["call_id"]}
    assert set(by) == {"1:0", "1:2", "2:1"} and len(rows) == 5
    assert by["1:0"]["valid"] and by["1:2"]["error"] == "query: missing" and by["2:1"]["error"] == "query: too short"


def test_waves_of_a_real_log(spark):
    """Calls of the table with dependencies by hash order, half of them forward: waves as by plain passes."""
    sf = "/root/testdata/sf0.001/conversations.parquet"
    if not os.path.exists(sf):
        pytest.skip("test tables are not here")
    calls, results = C.turns_as_calls(spark.read.parquet(sf))
    by_hash = Window.partitionBy("conv").orderBy(F.xxhash64("id"), "id")
    before = F.lag("id").over(by_hash)
    calls = calls.where("id IS NOT NULL").withColumn("after", F.when(before.isNull(), F.array().cast("array<string>")).otherwise(F.array(before)))
    given = {(r["conv"], r["id"]): (r["turn"], [(r["conv"], d) for d in r["after"]]) for r in calls.collect()}
    want = dict.fromkeys(given, 0)
    while True:
        new = {k: max([want[k], *(want[d] + (given[d][0] >= t) for d in deps)]) for k, (t, deps) in given.items()}
        if new == want:
            break
        want = new
    rows = {(r["conv"], r["call_id"]): r["wave"] for r in C.link(calls, results, C.TURN_TOOLS).where("n_calls > 0").collect()}
    assert rows == want and max(want.values()) > 0


def test_values_that_no_column_holds(spark):
    """Numbers beyond all bounds and halves of surrogate pairs are errors of the row, never of the job."""
    texts = ['{"a":1e999}', '{"a":-1e999}', '{"a":NaN}', '{"s":"\\ud800"}', '{"\\ud800":1}', '{"s":"\\ud83d\\ude00x"}', '"\\udc00"', "1" * 5000]
    calls = [(1, i, f"c{i}", "add", t, []) for i, t in enumerate(texts)] + [(1, 90, "p", "pick", texts[3], [])]
    got = {r["call_id"]: r for r in linked(spark, calls, [(1, i, f"c{i}", "ok") for i in range(8)])}
    assert len(got) == 9 and not any(r["valid"] for r in got.values())
    assert got["c0"]["error"] == got["c1"]["error"] == "arguments: a number is too large"
    assert got["c2"]["error"] == "arguments: not JSON"
    assert json.loads(got["p"]["record"])["arguments"] == {"s": "�"}
    assert json.loads(got["c5"]["record"])["arguments"] == {"s": "\U0001f600x"}


@pytest.mark.parametrize(
    "value, schema, good",
    [
        ("x", {"minimum": 0}, True),
        ([1], {"maximum": 0, "minLength": 4}, True),
        (None, {"minLength": 1}, True),
        (True, {"minimum": 5}, True),
        (3, {"minLength": 9, "minimum": 3}, True),
        (2.5, {"maximum": 2}, False),
        (True, {"enum": [1]}, False),
        (1.0, {"enum": [1]}, True),
        ({"a": "x"}, {"properties": {"a": {"minimum": 1}}}, True),
    ],
)
def test_bounds_hold_for_their_types(value, schema, good):
    assert (C.problem(value, schema) is None) == good
