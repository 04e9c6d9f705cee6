import json

from stowage.llm.chat import canonical, format_chats, read_message, violation
from stowage.llm.queries import TOOLS as QUERY_TOOLS
from stowage.llm.queries import op10_chat, with_tools

TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "sum": {"type": "object", "properties": {"of": {"type": "array", "items": {"type": "number"}}, "mode": {"enum": ["a", "b"]}}},
}
SCHEMA = "conv_id bigint, turn int, role string, text string, tool_calls string, tool_call_id string, uid int, k string, position string"


def chats(spark, rows):
    out = format_chats(spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA), TOOLS).collect()
    return sorted((tuple(r) for r in out), key=lambda r: (str(r[0]), r[1]))


def call(*calls):
    return json.dumps([{"id": i, "name": n, "arguments": a, **({"after": list(d)} if d else {})} for i, n, a, *d in calls])


def test_links_order_and_validation(spark):
    rows = [
        (1, 0, "user", "hi é", None, None),
        (1, 1, "tool", "early", None, "c1"),  # before its call: comes after it
        (1, 2, "assistant", None, call(("c2", "search", {"query": "x", "limit": "3"}, "c3")), None),  # waits for c3
        (1, 3, "assistant", "", call(("c1", "search", {"limit": 2, "query": "q"}), ("c3", "sum", {"of": [1, 2.5]})), None),
        (1, 4, "tool", "three", None, "c3"),
        (1, 5, "tool", "lost", None, "zz"),
        (1, 6, "user", "bye", None, None),
        (2, 0, "assistant", "x", "not json", None),
        (2, 1, "assistant", "x", call(("a", "search", {"query": "1"}, "b")), None),
        (2, 2, "assistant", "x", call(("b", "nope", {}, "a")), None),
    ]
    found = chats(spark, rows)
    assert [(r[0], r[1], r[2], r[9]) for r in found] == [
        (1, 1, 0, "plain"), (1, 2, 3, "call"), (1, 3, 1, "result"), (1, 4, 4, "result"), (1, 5, 2, "call"), (1, 6, 5, "orphan"), (1, 7, 6, "plain"),
        (2, 1, 0, "plain"), (2, 2, 1, "ring"), (2, 3, 2, "ring"),
    ]
    by_turn = {(r[0], r[2]): r for r in found}
    assert by_turn[1, 3][5:8] == (2, 2, 2) and by_turn[1, 1][8] == 3
    assert by_turn[1, 2][10] == "arguments.limit is not of type integer"
    assert by_turn[2, 0][10] == "calls are no JSON list of objects" and by_turn[2, 2][10] == "unknown tool"
    assert by_turn[1, 3][4] == ('{"content":"","role":"assistant","tool_calls":[{"arguments":{"limit":2,"query":"q"},"id":"c1","name":"search"},'
                                '{"arguments":{"of":[1,2.5]},"id":"c3","name":"sum"}]}')
    assert by_turn[1, 0][4] == '{"content":"hi é","role":"user"}'


def test_ids_used_again_nulls_and_repeats(spark):
    rows = [
        (7, 0, "assistant", "", call(("i", "search", {"query": "1"})), None), (7, 1, "tool", "r1", None, "i"),
        (7, 2, "assistant", "", call(("i", "search", {"query": "2"})), None), (7, 3, "tool", "r2", None, "i"), (7, 4, "tool", "r3", None, "i"),
        (None, None, None, None, None, None), (None, 0, "user", "a", None, None), (None, 0, "user", "a", None, None),
        (8, 0, "user", "x" * 200_000, "", None),
    ]
    found = chats(spark, rows)
    assert [(r[0], r[1], r[2], r[8], r[9]) for r in found] == [
        (7, 1, 0, None, "call"), (7, 2, 1, 0, "result"), (7, 3, 2, None, "call"), (7, 4, 3, 2, "result"), (7, 5, 4, None, "orphan"),
        (8, 1, 0, None, "plain"), (None, 1, None, None, "plain"), (None, 2, 0, None, "plain"), (None, 3, 0, None, "plain"),
    ]


def test_empty_table(spark):
    assert chats(spark, []) == []


def test_schemas():
    assert violation({"query": "a"}, TOOLS["search"]) is None
    assert violation({}, TOOLS["search"]) == "arguments lacks query"
    assert violation({"query": "a", "b": 1}, TOOLS["search"]) == "arguments has unknown b"
    assert violation({"of": [1, "x"]}, TOOLS["sum"]) == "arguments.of[1] is not of type number"
    assert violation({"mode": "c"}, TOOLS["sum"]) == "arguments.mode is none of the values allowed"
    assert violation([], TOOLS["sum"]) == "arguments is not of type object"
    assert violation({"query": "a", "limit": True}, TOOLS["search"]) == "arguments.limit is not of type integer"
    assert canonical({"b": 1, "a": {"d": "é", "c": None}}) == '{"a":{"c":null,"d":"é"},"b":1}'


def test_numbers_keys_and_text_are_spelled_one_way():
    same = [1e21, 1e-7, 123456789012345680000.0, 5e-324, 1.5, -0.0, 1.0, 0.000001, 333333333.33333329, 2.0 ** 60, -1e23]
    assert canonical(same) == "[1e+21,1e-7,123456789012345680000,5e-324,1.5,0,1,0.000001,333333333.3333333,1152921504606847000,-1e+23]"
    assert canonical({"": 1, "\U00010000": 2, "a": [True, None, 10 ** 25]}) == '{"a":[true,null,10000000000000000000000000],"\U00010000":2,"":1}'
    assert canonical([1, 1.0]) == "[1,1]" and json.loads(canonical({"x": 0.1})) == {"x": 0.1}


def test_lists_of_types_and_whole_doubles():
    schema = {"type": ["integer", "null"]}
    assert violation(1.0, schema) is None and violation(None, schema) is None
    assert violation("x", schema) == "arguments is not of type integer or null" and violation(True, schema)


def test_numbers_and_text_that_json_cannot_hold_are_errors(spark):
    deep = "[" * 3000 + "]" * 3000
    rows = [
        (1, 0, "assistant", "x", '[{"id":"a","name":"sum","arguments":{"of":[1e400]}}]', None),
        (1, 1, "assistant", "x", '[{"id":"b","name":"search","arguments":{"query":"\\ud800"}}]', None),
        (1, 2, "assistant", "x", json.dumps([{"id": "c", "name": "sum", "arguments": '{"of":[-1e999]}'}]), None),
        (1, 3, "assistant", "x", f'[{{"id":"d","name":"sum","arguments":{deep}}}]', None),
        (1, 4, "assistant", "x", '[{"id":"e","name":"sum","arguments":{"of":[NaN]}}]', None),
        (1, 5, "assistant", "x", '[{"id":"f","name":"sum","arguments":{"of":[1.0,-0.0,1e2]}}]', None),
    ]
    found = {r[2]: r for r in chats(spark, rows)}
    assert {t: found[t][10] for t in range(6)} == {
        0: "calls are no JSON list of objects", 1: "calls are no JSON list of objects", 2: "arguments are no JSON",
        3: "calls are no JSON list of objects", 4: "calls are no JSON list of objects", 5: None}
    assert '"of":[1,0,100]' in found[5][4]


def plain_chats(rows):
    """The order of each conversation, one message after another. Ids are used once, and a turn has one call and one result at most."""
    out = []
    for conv in {r[0] for r in rows}:
        found = []
        for _, turn, role, text, calls, call_id in (r for r in rows if r[0] == conv):
            text_json, listed, error = read_message(role, text, calls, call_id, QUERY_TOOLS)
            found.append({"turn": turn, "role": role, "json": text_json, "calls": listed, "error": error, "answers": call_id if role == "tool" else None})
        callers = {c[1]: m for m in found for c in m["calls"]}
        answers = {m["answers"]: m for m in found if m["answers"] in callers}
        waits = {id(m): [callers[a] for c in m["calls"] for a in c[4] if a in callers and callers[a] is not m] for m in found}
        level = {id(m): (m["turn"], 0) for m in found if not waits[id(m)]}
        step = 0
        while True:
            step += 1
            ready = {id(m): (max([m["turn"], *(level[id(w)][0] for w in waits[id(m)])]), step)
                     for m in found if id(m) not in level and all(id(w) in level for w in waits[id(m)])}
            if not ready:
                break
            level.update(ready)

        def place(m):
            call = callers.get(m["answers"]) if m["role"] == "tool" else None
            at = call or m
            return (*level.get(id(at), (at["turn"], 0)), at["turn"], 1 if call or m["calls"] else 0, 1 if call else 0, m["role"], m["json"])

        for position, m in enumerate(sorted(found, key=place), 1):
            call = callers.get(m["answers"]) if m["role"] == "tool" else None
            status = ("ring" if id(m) not in level else "call" if m["calls"] else "result" if call else "orphan" if m["role"] == "tool" else "plain")
            error = m["error"] or next((c[3] for c in m["calls"] if c[3]), None)
            out.append((conv, position, m["turn"], m["role"], m["json"], len(m["calls"]), sum(c[3] is None for c in m["calls"]),
                        sum(c[1] in answers for c in m["calls"]), call and call["turn"], status, error))
    return sorted(out, key=repr)


def test_registered_query_equals_a_plain_model(spark):
    folder = "/root/testdata/sf0.01"
    got = sorted(map(tuple, op10_chat(spark, folder).collect()), key=repr)
    want = plain_chats([tuple(r) for r in with_tools(spark.read.parquet(f"{folder}/conversations.parquet")).collect()])
    assert got == want
    # Messages move forward, some wait for each other, and whole texts are in the calls.
    in_order = [g[2] for g in sorted(got, key=lambda g: (g[0], g[1]))]
    assert in_order != sorted(in_order) and {g[9] for g in got} == {"plain", "call", "result", "orphan", "ring"} and max(len(g[4]) for g in got) > 2000
