import json

from personyear.llm import tool_calls

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>, json string"
RESULTS = "conv_id long, turn long, call_id string, output string, status string"
SCHEMAS = {
    "add": {"a": {"type": "number", "required": True}, "b": {"type": "integer", "minimum": 0, "maximum": 9}},
    "say": {"to": {"type": "string", "enum": ["x", "y"]}, "loud": {"type": "boolean"}, "what": {"type": "array"}, "how": {"type": "object"}},
}


def _linked(spark, calls, results):
    calls = spark.createDataFrame([(*c, None) for c in calls], CALLS)
    results = spark.createDataFrame([(*r, None) for r in results], RESULTS)
    return tool_calls.link_tool_calls(calls, results, SCHEMAS)


def test_order_follows_dependencies(spark):
    calls = [
        (1, 5, "a", "add", '{"a":1}', []),
        (1, 1, "b", "add", '{"a":1}', ["a"]),
        (1, 2, "c", "add", '{"a":1}', ["a", "b"]),
        (1, 3, "d", "add", '{"a":1}', ["c", "gone"]),
        (1, 4, "loop1", "add", '{"a":1}', ["loop2"]),
        (1, 4, "loop2", "add", '{"a":1}', ["loop1"]),
        (1, 6, "behind", "add", '{"a":1}', ["loop1", "a"]),
        (2, 1, "a", "add", '{"a":1}', ["a"]),
        (2, 2, "b", "add", '{"a":1}', None),
    ]
    results = [(1, 9, "a", "late"), (1, 7, "a", "first"), (2, 3, "nobody", "?"), (2, 3, None, "lost"), (2, 4, "b", None)]
    rows = _linked(spark, calls, results).collect()
    order = {c: [r.call_id for r in sorted(rows, key=lambda r: r.position) if r.conv_id == c] for c in (1, 2)}
    assert order == {1: ["a", "b", "c", "d", "loop1", "loop2", "behind"], 2: ["b", "a", None, "nobody"]}
    by = {(r.conv_id, r.call_id): r for r in rows}
    assert [by[1, x].level for x in "abcd"] == [0, 1, 2, 3]
    assert {by[1, x].status for x in ("loop1", "loop2", "behind")} | {by[2, "a"].status} == {"cycle"}
    assert by[1, "a"].status == "answered" and by[1, "a"].n_results == 2 and json.loads(by[1, "a"].json)["result"] == "first"
    assert by[2, "b"].status == "answered" and "result" not in json.loads(by[2, "b"].json)
    assert by[1, "b"].status == "unanswered" and by[2, "nobody"].status == by[2, None].status == "orphan"
    assert by[1, "d"].errors == ["depends_on: unknown call"]


def test_arguments_are_validated_and_canonical(spark):
    texts = {
        '{"b":3, "a" : 1.5}': [],
        '{"a":"x"}': ["a: not number"],
        '{"b":1}': ["a: missing"],
        '{"a":1,"b":10}': ["b: beyond maximum"],
        '{"a":1,"b":-1}': ["b: beyond minimum"],
        '{"a":1,"b":1.5}': ["b: not integer"],
        '{"a":1,"z":2,"y":3}': ["unlisted: y,z"],
        "[1]": ["arguments: not an object"],
        "{": ["arguments: not an object"],
        '{"a":1,"a":2}': ["arguments: not an object"],
    }
    calls = [(1, i, f"c{i}", "add", t, []) for i, t in enumerate(texts)]
    calls += [(1, 50, "s1", "say", '{"how":{"z":1,"b":[ ]},"what":[ 1 ],"loud":true,"to":"x"}', [])]
    calls += [(1, 51, "s2", "say", '{"to":"q","loud":1,"what":{},"how":[]}', []), (1, 52, "s3", "sing", "{}", []), (1, 53, "s4", None, None, [])]
    rows = {r.call_id: r for r in _linked(spark, calls, []).collect()}
    assert [rows[f"c{i}"].errors for i in range(len(texts))] == list(texts.values())
    assert rows["c0"].json == '{"arguments":{"a":1.5,"b":3},"depends_on":[],"id":"c0","name":"add","status":"unanswered"}'
    assert '"arguments":{"how":{"b":[],"z":1},"loud":true,"to":"x","what":[1]}' in rows["s1"].json
    assert rows["s2"].errors == ["how: not object", "loud: not boolean", "to: not listed", "what: not array"]
    assert rows["s3"].errors == ["tool: unknown"]
    assert rows["s4"].errors == ["arguments: not an object", "tool: unknown"]


def test_repeated_and_missing_ids(spark):
    calls = [(1, 1, "a", "add", '{"a":1}', [])] * 2 + [(1, 2, "a", "add", '{"a":2}', []), (1, 3, None, "add", '{"a":1}', ["a", None])]
    calls += [(None, 1, "a", "add", '{"a":1}', []), (None, None, "b", "add", '{"a":1}', ["a"])]
    rows = _linked(spark, calls, [(1, 4, "a", "r"), (None, 2, "a", "s")]).collect()
    assert len(rows) == 6
    assert sorted(r.position for r in rows if r.conv_id == 1) == [0, 1, 2, 3]
    assert {(r.turn, r.level) for r in rows if r.conv_id is None} == {(1, 0), (None, 1)}
    assert {r.status for r in rows if r.conv_id == 1 and r.call_id == "a"} == {"answered"}
    assert _linked(spark, [], []).collect() == []


def test_long_conversation_and_plan(spark):
    calls = [(1, i, f"c{i}", "add", '{"a":1}', [f"c{i // 2}"] if i else []) for i in range(1, 3000)]
    linked = _linked(spark, calls, [])
    rows = linked.collect()
    assert sorted(r.position for r in rows) == list(range(2999))
    # c1 waits for c0, which is no call.
    assert all(r.level == r.turn.bit_length() - 1 for r in rows)
    plan = linked._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_other_messages_stay(spark):
    names = "conv_id long, turn long, role string, text string, level int"
    others = spark.createDataFrame([(1, 0, "system", 'say "a"', 7), (1, 9, None, None, 7), (None, None, "", "", 7), (2, 1, "tool", "x" * 200_000, 7)], names)
    calls = spark.createDataFrame([(1, 1, "a", "add", '{"a":1}', [], None)], CALLS)
    results = spark.createDataFrame([(1, 5, "z", "lost", None)], RESULTS)
    rows = tool_calls.link_tool_calls(calls, results, SCHEMAS, others).collect()
    assert [(r.status, r.turn) for r in sorted(rows, key=lambda r: r.position) if r.conv_id == 1] == [
        ("unanswered", 1), ("orphan", 5), ("message", 0), ("message", 9),
    ]
    found = {(r.conv_id, r.turn): r for r in rows if r.status == "message"}
    assert found[1, 0].json == '{"role":"system","status":"message","text":"say \\"a\\""}'
    assert found[1, 9].json == '{"status":"message"}'
    assert found[None, None].json == '{"role":"","status":"message","text":""}'
    assert len(json.loads(found[2, 1].json)["text"]) == 200_000
    assert all((r.level, r.call_id, r.errors, r.n_results) == (None, None, [], 0) for r in found.values())


def test_every_message_of_a_table_enters(spark):
    names = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, None, None), (1, 4, "tool", "t")]
    parts = tool_calls.calls_and_results(spark.createDataFrame(rows, names))
    assert [p.count() for p in parts] == [1, 1, 3]
