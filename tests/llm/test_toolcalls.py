import json

from folioscope.llm.toolcalls import REPLY, call_depths, conversation_calls, link_calls, other_messages

SCHEMAS = {"search": {"query": ("string", True), "limit": ("integer", False)}, "add": {"a": ("number", True), "b": ("number", True)}}
CALLS = "thread long, call_id string, after string, tool string, arguments string"


def linked(spark, calls, results=()):
    rows = link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(list(results), "thread long, call_id string, content string"), SCHEMAS).collect()
    return {r["call_id"]: r for r in rows}


def test_links_orders_and_validates(spark):
    calls = [
        (1, "c", "b", "add", '{"a": 1, "b": 2.5}'),
        (1, "a", None, "search", '{"query": "x", "limit": 3}'),
        (1, "b", "a", "search", '{"limit": "3", "more": 1}'),
        (2, "d", None, "fly", "{}"),
        (2, "e", None, "add", "no json"),
        (2, "f", "gone", "search", '{"query": ""}'),
        (3, "g", "h", "search", '{"query": "x"}'),
        (3, "h", "g", "search", None),
        (3, None, None, "search", None),
        (1, "a", None, "search", '{"query": "x", "limit": 3}'),
    ]
    got = linked(spark, calls, [(1, "a", "found"), (1, "b", 'say "é"'), (9, "z", "lost"), (1, "a", "found"), (1, None, "x")])
    assert {k: (r["depth"], r["status"]) for k, r in got.items()} == {
        "a": (0, "linked"), "b": (1, "linked"), "c": (2, "unanswered"), "d": (0, "unanswered"), "e": (0, "unanswered"),
        "f": (None, "cyclic"), "g": (None, "cyclic"), "h": (None, "cyclic"), "z": (None, "orphan"),
    }
    problems = {k: r["problems"] for k, r in got.items()}
    assert problems["a"] == problems["c"] == problems["z"] == ""
    assert problems["b"] == "limit is no integer; missing query; unknown more"
    assert problems["d"] == "unknown tool fly" and problems["e"] == "arguments are no object"
    assert got["a"]["repeats"] == 2
    record = got["b"]["record"]
    assert record == json.dumps(json.loads(record), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(record)["result"] == 'say "é"'


def test_long_chains_take_few_rounds(spark):
    n = 500
    df = spark.createDataFrame([(1, str(i), str(i - 1) if i else None, "add", "{}") for i in range(n)], CALLS)
    assert {r["call_id"]: r["depth"] for r in call_depths(df).collect()} == {str(i): i for i in range(n)}


def test_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, thread string"
    rows = [
        (1, 0, "system", "be kind", "x"), (1, 1, "user", "hi", "x"), (1, 2, "assistant", "hello", "x"), (1, 3, "user", None, "x"), (1, 3, "user", None, "x"),
        (2, 1, "assistant", "alone", "x"), (None, 1, "user", "lost", "x"), (3, None, "user", "lost", "x"), (4, 0, "user", "", "x"), (4, 1, None, "?", "x"),
    ]
    got = {r["call_id"]: r for r in link_calls(*conversation_calls(spark.createDataFrame(rows, schema)), REPLY).collect()}
    assert {k: (r["status"], r["depth"], r["problems"], r["repeats"]) for k, r in got.items()} == {
        "1:1": ("linked", 0, "", 0), "1:3": ("unanswered", 1, "missing text", 1), "2:0": ("orphan", None, "", 0), "4:0": ("unanswered", 0, "", 0),
    }
    assert link_calls(*conversation_calls(spark.createDataFrame([], schema)), REPLY).count() == 0


def test_other_messages(spark):
    rows = [(1, 0, "system", 'be "kind"'), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (4, 1, None, "?"), (None, 1, "user", "lost"), (3, None, "assistant", "lost"), (5, 2, "tool", None), (5, 2, "tool", None)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((str(r["call_id"]), r["status"], r["record"]) for r in other_messages(messages).collect())
    want = []
    for conv, turn, role, text in rows[:1] + rows[3:]:
        record = {k: v for k, v in {"conversation": conv, "role": role, "text": text, "turn": turn}.items() if v is not None}
        want.append((str(None if conv is None or turn is None else f"{conv}:{turn}"), "message", json.dumps(record, separators=(",", ":"))))
    assert got == sorted(want)
    assert other_messages(messages).columns == link_calls(*conversation_calls(messages), REPLY).columns


def test_equal_arguments_give_equal_records(spark):
    forms = ['{"a": 1.50, "b": {"y": 2, "x": [1e2]}}', '{"b":{"x":[100.0],"y":2},"a":1.5}', '{ "b" : {"y":2, "x":[1E+2]}, "a":1.5}']
    got = linked(spark, [(1, f"c{i}", None, "add", a) for i, a in enumerate(forms)])
    assert {r["record"].replace(k, "c") for k, r in got.items()} == {'{"arguments":{"a":1.5,"b":{"x":[100],"y":2}},"id":"c","name":"add"}'}
    texts = ['say "1.0," \\ ' + "x" * 20_000 + " 2.0]", "no json"]
    odd = linked(spark, [(1, "c", None, "add", json.dumps({"a": 2.0, "b": texts[0]}))])["c"]["record"]
    assert json.loads(odd)["arguments"]["b"] == texts[0] and '"a":2,' in odd
    assert json.loads(linked(spark, [(1, "c", None, "add", "no json")])["c"]["record"])["arguments"] == "no json"


def test_numbers_have_one_form(spark):
    groups = [["100000000", "1e8", "1E+8", "100000000.0", "1.0e8"], ["0.0000001", "1e-7", "0.1E-6", "1.0e-7"], ["0", "-0", "0.0", "-0.0", "0e5"], ["-12.5", "-1.25e1", "-125e-1", "-12.500"], ["1.5e20", "150000000000000000000"], ["123456789012345678"], ["0.1", "1e-1"]]
    shown = ["100000000", "0.0000001", "0", "-12.5", "150000000000000000000", "123456789012345678", "0.1"]
    calls = [(1, f"c{i}-{j}", None, "add", f'{{"a":{n},"b":["{n}",{n}]}}') for i, g in enumerate(groups) for j, n in enumerate(g)]
    got = linked(spark, calls)
    for i, (g, want) in enumerate(zip(groups, shown, strict=True)):
        for j, n in enumerate(g):
            assert got[f"c{i}-{j}"]["record"] == f'{{"arguments":{{"a":{want},"b":["{n}",{want}]}},"id":"c{i}-{j}","name":"add"}}'


NESTED = {
    "plan": {
        "type": "object",
        "required": ["title", "steps"],
        "properties": {
            "title": {"type": "string", "minLength": 2, "maxLength": 5},
            "kind": {"enum": ["a", 1, {"x": 1}]},
            "steps": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 0, "maximum": 9}, "tags": {"type": "array", "items": {"type": "string"}}}}},
            "free": {"type": "object", "additionalProperties": True},
        },
    }
}


def plain_problems(value, schema, path=""):
    """The same rules, value by value."""
    kinds = {"string": lambda v: isinstance(v, str), "integer": lambda v: isinstance(v, int) and not isinstance(v, bool), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "boolean": lambda v: isinstance(v, bool), "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list)}
    kind = schema.get("type")
    if kind and not kinds[kind](value):
        return [f"{path or 'arguments'} {'is' if path else 'are'} no {kind}"]
    out, here = [], path or "arguments"
    if "enum" in schema and not any(json.dumps(value, sort_keys=True) == json.dumps(e, sort_keys=True) for e in schema["enum"]):
        out.append(f"{here} is none of {', '.join(json.dumps(e, sort_keys=True, separators=(',', ':')) for e in schema['enum'])}")
    sizes = {"": value if kinds["number"](value) else None, "Length": len(value) if isinstance(value, str) else None, "Items": len(value) if isinstance(value, list) else None}
    units = {"": "", "Length": " characters", "Items": " items"}
    for name, what, low in (("minimum", "", True), ("maximum", "", False), ("minLength", "Length", True), ("maxLength", "Length", False), ("minItems", "Items", True), ("maxItems", "Items", False)):
        if name in schema and sizes[what] is not None and (sizes[what] < schema[name] if low else sizes[what] > schema[name]):
            out.append(f"{here} is {'below' if low else 'above'} {schema[name]}{units[what]}")
    if "items" in schema and isinstance(value, list):
        out += [p for i, v in enumerate(value) for p in plain_problems(v, schema["items"], f"{path}[{i}]")]
    if isinstance(value, dict) and ("properties" in schema or kind == "object"):
        inner = lambda k: f"{path}.{k}" if path else k
        for k, sub in schema.get("properties", {}).items():
            if value.get(k) is None:
                out += [f"missing {inner(k)}"] if k in schema.get("required", ()) else []
            else:
                out += plain_problems(value[k], sub, inner(k))
        if not schema.get("additionalProperties", False):
            out += [f"unknown {inner(k)}" for k in value if k not in schema.get("properties", {})]
    return out


def test_nested_schemas(spark):
    values = [
        {"title": "abc", "steps": [{"n": 1, "tags": ["x"]}], "kind": {"x": 1}, "free": {"any": [1]}},
        {"title": "a", "steps": [], "kind": "b"},
        {"title": "abcdef", "steps": [{"n": -1}, {"n": 10, "tags": [1, "y", None]}, {"m": 2}], "kind": 1},
        {"title": 3, "steps": {"n": 1}, "more": True, "free": 7},
        {"steps": [1, [], {"n": 1.5, "tags": "x"}], "title": None},
        [1], "text", {"title": "é東", "steps": [{"n": 3, "tags": [], "other": {"deep": 1}}], "kind": {"x": 1, "y": 2}},
    ]
    calls = spark.createDataFrame([(1, str(i), None, "plan", json.dumps(v)) for i, v in enumerate(values)], CALLS)
    got = {r["call_id"]: r["problems"] for r in link_calls(calls, spark.createDataFrame([], "thread long, call_id string, content string"), NESTED).collect()}
    assert {int(k): v for k, v in got.items()} == {i: "; ".join(sorted(plain_problems(v, NESTED["plan"]))) for i, v in enumerate(values)}


def test_positions_are_topological(spark):
    calls = [(1, c, a, "add", "{}") for c, a in (("z", None), ("b", "z"), ("a", "z"), ("c", "a"), ("d", None), ("x", "gone"))] + [(2, "p", None, "add", "{}"), (None, "q", None, "add", "{}")]
    got = linked(spark, calls, [(1, "lost", "x")])
    assert {k: r["position"] for k, r in got.items()} == {"d": 0, "z": 1, "a": 2, "b": 3, "c": 4, "x": None, "p": 0, "q": 0, "lost": None}
    needs = {c: a for _, c, a, *_ in calls if a}
    assert all(got[a]["position"] < got[c]["position"] for c, a in needs.items() if a in got)


def test_a_very_long_conversation(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(4000)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    got = {r["call_id"]: (r["depth"], r["position"], r["status"]) for r in link_calls(*conversation_calls(messages), REPLY).collect()}
    assert got == {f"1:{i}": (i // 2, i // 2, "linked") for i in range(0, 4000, 2)}
    assert other_messages(messages).count() == 0 == other_messages(messages.limit(0)).count()
