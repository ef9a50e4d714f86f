"""JSON objects in free text: found, and repaired where they are slightly broken."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a bracket is closed by.
CLOSES = {"{": "}", "[": "]"}


def json_part(text: Column) -> Column:
    """The part of a text that should be JSON: of its first block marked as code, else of all of it, from the first opening
    brace to the last closing one; without braces as it is."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    marked, fence = F.split_part(F.split_part(plain, F.lit("```json"), F.lit(2)), F.lit("```"), F.lit(1)), F.split_part(plain, F.lit("```"), F.lit(2))
    block = F.when(F.contains(plain, F.lit("```json")), marked).when(F.contains(plain, F.lit("```")), F.regexp_replace(F.trim(fence), "^json", "")).otherwise(plain)
    return F.coalesce(F.nullif(F.regexp_extract(block, r"(?s)(\{.*\})", 1), F.lit("")), F.trim(block))


def repaired(text: str, *, complete: bool = False) -> str | None:
    """The text as JSON, or null if it can't be read as such. One pass with a stack of open brackets: commas before a closing bracket go,
    strings in single quotes get double ones, what is in a string stays. complete: open strings and brackets at the end are closed,
    after a comma or a key without a value has gone."""
    out: list[str] = []
    stack: list[str] = []
    at, n = 0, len(text)
    while at < n:
        c = text[at]
        if c in "\"'":
            end = at + 1
            while end < n and text[end] != c:
                end += 2 if text[end] == "\\" else 1
            inner, closed = text[at + 1 : min(end, n)], end < n
            if not closed and not complete:
                return None
            if not closed and inner.endswith("\\"):
                inner = inner[:-1]
            if c == "'":
                inner = inner.replace("\\'", "'").replace('\\"', '"').replace('"', '\\"')
            out.append(f'"{inner}"')
            at = end + 1
            continue
        if c in CLOSES:
            stack.append(c)
        elif c in "}]":
            if not stack or CLOSES[stack.pop()] != c:
                return None
            _drop(out, ",")
        out.append(c)
        at += 1
    if stack and not complete:
        return None
    while stack:
        _drop(out, ",")
        if _last(out) == ":":
            _drop(out, ":")
            _drop_value(out)
            _drop(out, ",")
        elif stack[-1] == "{" and _is_key(out):
            _drop_value(out)
            _drop(out, ",")
        out.append(CLOSES[stack.pop()])
    fixed = "".join(out)
    return fixed if valid(fixed) else None


def valid(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def _last(out: list[str]) -> str:
    return next((x for x in reversed(out) if not x.isspace()), "")


def _drop(out: list[str], mark: str) -> None:
    """Takes a mark and the blanks after it from the end."""
    if _last(out) == mark:
        while out and out.pop() != mark:
            pass


def _drop_value(out: list[str]) -> None:
    while out and out[-1].isspace():
        out.pop()
    if out and out[-1].startswith('"'):
        out.pop()


def _is_key(out: list[str]) -> bool:
    """Whether an object ends with a string that stands where a key would: after its brace or a comma."""
    told = [x for x in out if not x.isspace()][-2:]
    return len(told) == 2 and told[1].startswith('"') and told[0] in "{,"


def extracted(text: Column, *, strict: bool = False, complete: bool = False) -> Column:
    """The JSON in a text, as text; null where there is none, or none that can be repaired.

    strict: nothing is repaired. complete: what was cut off at the end is closed. Text that parses as it is never reaches
    Python; the others do, in Arrow batches.
    """
    part = json_part(text)
    sound = F.try_parse_json(part).isNotNull()

    def mend(parts: pa.Array, tails: pa.Array) -> pa.Array:
        out = []
        for part, tail in zip(parts.to_pylist(), tails.to_pylist(), strict=True):
            if part is None or valid(part) or strict:
                out.append(part if part is not None and valid(part) else None)
                continue
            whole = repaired(part)
            out.append(repaired(tail, complete=True) if whole is None and complete and tail else whole)
        return pa.array(out, pa.string())

    broken = F.when(~sound & (part != ""), part)
    tail = F.when(broken.isNotNull(), F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)(\{.*)", 1))  # from the first brace to the end, as a cut loses the last one
    return F.when(sound, part).otherwise(F.arrow_udf(mend, "string")(broken, tail))
