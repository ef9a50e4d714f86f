"""Chat formatting: tool calls linked with their results, in DataFrame operations only.

Calls and results are joined by identifier, ordered so that each call comes after the one whose result
it needs, checked against the schemas of the tools, and written as canonical JSON: keys in order of
code points, no white space, one form for each number, also within the arguments.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialize
from folioscope.llm.mixing import numbered

#: A schema of JSON: type (string, integer, number, boolean, object, array; any if missing), enum, minimum, maximum, minLength,
#: maxLength, minItems, maxItems, items (a schema), properties (name -> schema), required (names), additionalProperties
#: (false if missing). A pair (type, required) is short for a property of that type.
Schema = dict[str, Any]
#: Tool -> schema of its arguments, or parameter -> (type, required).
Schemas = dict[str, Schema | dict[str, tuple[str, bool]]]

#: Patterns of what schema_of_variant says of each JSON type.
VARIANT_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT<", "array": "^ARRAY<"}
#: What JSON text consists of: strings, numbers, and runs of anything else.
TOKENS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9]+(?:\.[0-9]+)?(?:E[-+]?[0-9]+)?|[^"0-9-]++|-'
#: Numbers that may have another form: with a decimal point or an exponent.
OTHER_FORM = r"[0-9](?:\.|E)|-0"


def whole_schema(schema: Schema | dict[str, tuple[str, bool]]) -> Schema:
    """The schema that a table of parameters is short for."""
    if all(isinstance(v, tuple) for v in schema.values()):
        return {"type": "object", "properties": {k: {"type": t} for k, (t, _) in schema.items()}, "required": [k for k, (_, r) in schema.items() if r]}
    return schema


def schema_problems(value: Column, schema: Schema, path: Column) -> Column:
    """Problems of a variant by a schema, as an array of texts that name the path of each; the expression nests as the schema does.

    A value of the wrong type has that problem alone. A null value is an absent one.
    """
    kind = F.schema_of_variant(value)
    none = F.array().cast("array<string>")
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    here = F.when(path == "", F.lit("arguments")).otherwise(path)
    own: list[Column] = []
    nested: list[Column] = []
    if "enum" in schema:
        allowed = [json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for v in schema["enum"]]
        own.append(F.when(~canonical_text(F.to_json(value)).isin(*allowed), said(here, " is none of ", ", ".join(allowed))))
    number = F.try_variant_get(value, "$", "double")
    size = {"Length": F.char_length(F.try_variant_get(value, "$", "string")), "Items": F.size(F.try_variant_get(value, "$", "array<variant>"))}
    bounds = [("minimum", number, -1), ("maximum", number, 1), *((f"{end}{what}", size[what], sign) for what in size for end, sign in (("min", -1), ("max", 1)))]
    for name, found, sign in bounds:
        if name in schema:
            beyond = found < schema[name] if sign < 0 else found > schema[name]
            unit = " items" if name.endswith("Items") else " characters" if name.endswith("Length") else ""
            own.append(F.when(beyond, said(here, f" is {'below' if sign < 0 else 'above'} {schema[name]}{unit}")))
    if "items" in schema:
        elements = F.try_variant_get(value, "$", "array<variant>")
        nested.append(F.flatten(F.transform(elements, lambda v, i: schema_problems(v, schema["items"], said(path, "[", i.cast("string"), "]")))))
    if "properties" in schema or schema.get("type") == "object":
        properties = schema.get("properties", {})
        inner = lambda name: F.when(path == "", F.lit(name)).otherwise(said(path, f".{name}"))
        for name, sub in sorted(properties.items()):
            at = F.try_variant_get(value, f"$['{name}']", "variant")
            absent = F.coalesce(F.schema_of_variant(at) == "VOID", F.lit(True))
            missing = F.array_compact(F.array(said("missing ", inner(name)))) if name in schema.get("required", ()) else none
            nested.append(F.when(absent, missing).otherwise(schema_problems(at, sub, inner(name))))
        if not schema.get("additionalProperties", False):
            keys = F.coalesce(F.json_object_keys(F.to_json(value)), none)
            more = F.array_except(keys, F.array(*map(F.lit, sorted(properties))).cast("array<string>"))
            nested.append(F.transform(more, lambda k: F.when(path == "", said("unknown ", k)).otherwise(said("unknown ", path, ".", k))))
    found = F.concat(F.array_compact(F.array(*own)) if own else none, *(F.coalesce(n, none) for n in nested))
    if "type" not in schema:
        return found
    article = "no object" if schema["type"] == "object" else f"no {schema['type']}"
    verb = F.when(path == "", F.lit("are ")).otherwise(F.lit("is "))
    return F.when(F.coalesce(kind.rlike(VARIANT_TYPES[schema["type"]]), F.lit(False)), found).otherwise(F.array(said(here, " ", verb, article)))


def argument_problems(tool: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted problems of JSON arguments by the schema of their tool: unknown tool, missing, mistyped, unknown and unfit values at any depth."""
    value = F.try_parse_json(arguments)
    checks = F.array(F.concat(F.lit("unknown tool "), F.coalesce(tool, F.lit("null"))))
    for name, schema in sorted(schemas.items()):
        checks = F.when(tool == name, F.array_sort(schema_problems(value, whole_schema(schema), F.lit("")))).otherwise(checks)
    return checks


def call_depths(calls: DataFrame) -> DataFrame:
    """(call_id, depth) of calls (call_id, after): 0 for calls that need none, else one more than the call that they need.

    Paths double each round, so the number of rounds grows with the logarithm of the longest chain. Calls
    that need none, or are done, are in no join. A call that needs itself in the end, or a call that isn't
    there, has a null depth.
    """
    known = calls.select(F.col("call_id").alias("after"), F.lit(True).alias("there"))
    needing = calls.where("after IS NOT NULL").select("call_id", "after").join(known, "after", "left")
    first = needing.select("call_id", "after", F.when(F.col("there"), F.lit(1)).cast("long").alias("depth"))
    # after: an ancestor not yet passed, at a distance of depth; null: none left
    now = materialize(first.unionByName(calls.where("after IS NULL").select("call_id", F.lit(None).cast("string").alias("after"), F.lit(0).cast("long").alias("depth"))))
    total, open_ = now.count(), F.col("after").isNotNull() & F.col("depth").isNotNull()
    span = 1
    while span <= total and not now.where(open_).isEmpty():
        up = now.select(F.col("call_id").alias("after"), F.col("after").alias("next"), F.col("depth").alias("more"))
        further = now.where(open_).join(up, "after").select("call_id", F.col("next").alias("after"), (F.col("depth") + F.col("more")).alias("depth"))
        now = materialize(now.where(~open_).unionByName(further))
        span *= 2
    return now.select("call_id", F.when(F.col("after").isNull(), F.col("depth")).alias("depth"))


def canonical_number(text: Column) -> Column:
    """A JSON number in the one form of its value: all its digits, no exponent, no zeros that say nothing; minus zero is 0."""
    digits = F.concat(F.regexp_extract(text, r"^-?([0-9]+)", 1), F.regexp_extract(text, r"\.([0-9]+)", 1))
    power = F.coalesce(F.nullif(F.regexp_extract(text, r"E\+?(-?[0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0))
    point = F.char_length(F.regexp_extract(text, r"^-?([0-9]+)", 1)) + power
    before = F.when(point <= 0, F.lit("0")).otherwise(F.rpad(F.substring(digits, F.lit(1), point), point, F.lit("0")))
    after = F.when(point <= 0, F.concat(F.repeat(F.lit("0"), -point), digits)).otherwise(F.substring(digits, point + 1, F.char_length(digits)))
    whole, part = F.regexp_replace(before, "^0+(?=[0-9])", ""), F.regexp_replace(after, "0+$", "")
    plain = F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))
    return F.when(F.startswith(text, F.lit("-")) & (plain != "0"), F.concat(F.lit("-"), plain)).otherwise(plain)


def canonical_text(text: Column) -> Column:
    """JSON text with each number in its one form; what is in strings stays."""
    tokens = F.transform(F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0)), lambda t: F.when(t.rlike("^-?[0-9]"), canonical_number(t)).otherwise(t))
    return F.when(text.rlike(OTHER_FORM), F.array_join(tokens, "")).otherwise(text)


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON object of the fields that aren't null, keys in order, each number in one form."""
    return canonical_text(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))))


def call_positions(calls: DataFrame) -> DataFrame:
    """(call_id, position) of calls (thread, call_id, depth): their place in a topological order of their thread, from 0: by depth,
    then identifier. Calls without a depth have none. Places come from range partitions, so a thread of any length is split."""
    ranked = materialize(numbered(calls.where("depth IS NOT NULL").select("thread", "call_id", "depth"), F.col("thread").asc_nulls_first(), F.col("depth"), F.col("call_id")))
    starts = ranked.groupBy("thread").agg(F.min("number").alias("start"))
    return ranked.join(starts, ranked["thread"].eqNullSafe(starts["thread"])).select("call_id", (F.col("number") - F.col("start")).alias("position"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """Links calls (thread, call_id, after, tool, arguments) with results (thread, call_id, content).

    One row per identifier of either side: thread, call_id, tool, depth, position, status, problems, record. position is the place
    of a call in a topological order of its thread (call_positions). status is
    `linked`, `unanswered` (no result), `orphan` (no call) or `cyclic` (it needs itself or a call that
    isn't there: depth is null). Of rows that repeat an identifier, the smallest is taken on either side
    and `repeats` counts the others; a column `stands_for` of calls says how many equal rows a row stands
    for (1 where it is missing, null or no number). Rows without an identifier are left out. record is
    canonical JSON of what is known; arguments that are no JSON, or too large to be parsed (more than 128 MB),
    stand in it as text.
    """
    times = F.coalesce(F.col("stands_for").cast("string").try_cast("long"), F.lit(1)) if "stands_for" in calls.columns else F.lit(1)
    one = calls.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min(F.struct("thread", "after", "tool", "arguments")).alias("call"), (F.sum(times) - 1).alias("again"))
    one = materialize(one.select("call_id", "call.*", "again"))
    answer = results.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min(F.struct("thread", "content")).alias("answer"), (F.count("*") - 1).alias("more"))
    answer = answer.select("call_id", F.col("answer.thread").alias("answer_thread"), F.col("answer.content").alias("content"), "more", F.lit(True).alias("answered"))
    one = materialize(one.join(call_depths(one), "call_id"))
    one = one.join(call_positions(one), "call_id", "left")
    rows = one.withColumn("called", F.lit(True)).join(answer, "call_id", "full_outer")
    status = F.when(F.col("called").isNull(), "orphan").when(F.col("depth").isNull(), "cyclic").when(F.col("answered").isNull(), "unanswered").otherwise("linked")
    problems = F.when(F.col("called"), argument_problems(F.col("tool"), F.col("arguments"), schemas)).otherwise(F.array().cast("array<string>"))
    record = {"id": F.col("call_id"), "name": F.col("tool"), "arguments": F.coalesce(F.try_parse_json("arguments"), F.col("arguments").cast("variant")), "after": F.col("after"), "result": F.col("content")}
    return rows.select(
        F.coalesce("thread", "answer_thread").alias("thread"),
        "call_id",
        "tool",
        "depth",
        "position",
        status.alias("status"),
        F.array_join(problems, "; ").alias("problems"),
        (F.coalesce("again", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long").alias("repeats"),
        canonical_json(record).alias("record"),
    )


#: The tool that a user turn is read as a call of.
REPLY: Schemas = {"reply": {"conversation": ("integer", True), "text": ("string", True), "turn": ("integer", True)}}


def conversation_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations (conv_id, turn, role, text), which hold no tool traffic of their own.

    Each user turn is a call of `reply` that needs the conversation's user turn before it; the assistant
    turn with the next number is its result. Turns are numbered over range partitions, so a conversation
    of any length is split. Rows without conv_id or turn have no identifier. Of user rows that repeat a
    turn, the smallest text is taken, and `stands_for` of the call counts them. Messages that are neither
    calls nor results are rows of other_messages.
    """
    users = messages.where("role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("text").alias("text"), F.count("*").alias("times"))
    ranked = materialize(numbered(users, F.col("conv_id"), F.col("turn")))
    name = F.concat_ws(":", "conv_id", "turn")
    before = ranked.select((F.col("number") + 1).alias("number"), F.col("conv_id").alias("before_conv"), name.alias("after"))
    joined = ranked.join(before, "number", "left")
    arguments = canonical_json({"conversation": F.col("conv_id"), "text": F.col("text"), "turn": F.col("turn")})
    calls = joined.select(
        F.col("conv_id").alias("thread"),
        name.alias("call_id"),
        F.when(F.col("before_conv") == F.col("conv_id"), F.col("after")).alias("after"),
        F.lit("reply").alias("tool"),
        arguments.alias("arguments"),
        F.col("times").alias("stands_for"),
    )
    answers = messages.where("role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL")
    results = answers.select(F.col("conv_id").alias("thread"), F.concat_ws(":", F.col("conv_id"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def other_messages(messages: DataFrame) -> DataFrame:
    """The messages that conversation_calls takes neither as calls nor as results: of other roles or none, without conv_id or turn.

    One row per message, of the columns of link_calls: status is `message`, call_id null where it has no
    conv_id or turn, record the canonical JSON of what is known.
    """
    conv, turn = F.col("conv_id"), F.col("turn")
    taken = F.col("role").isin("user", "assistant") & conv.isNotNull() & turn.isNotNull()
    record = {"conversation": conv, "role": F.col("role"), "text": F.col("text"), "turn": turn}
    return messages.where(~F.coalesce(taken, F.lit(False))).select(
        conv.alias("thread"),
        F.concat(conv.cast("string"), F.lit(":"), turn.cast("string")).alias("call_id"),
        F.lit(None).cast("string").alias("tool"),
        F.lit(None).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("position"),
        F.lit("message").alias("status"),
        F.lit("").alias("problems"),
        F.lit(0).cast("long").alias("repeats"),
        canonical_json(record).alias("record"),
    )
