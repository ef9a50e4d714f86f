import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from folioscope.llm import convtrie
from folioscope.llm.convtrie import trie


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def plain_trie(rows):
    """{(conv_id, depth): rest of the row} by walking a tree of tuples."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    turns = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in turns:
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        h = 0 if base == c else zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(turns.get(base, [])[:h]) + tuple(turns[c][h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    saved, leaves = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(who) - 1) * words
            leaves[node[:d]] += not children[node]
    out = {}
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(paths[c]) == len(node))
        out[min(who), len(node)] = (min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())
    return out


def build(spark, rows, parts=3):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)


def check(spark, rows):
    got = trie(build(spark, rows)).collect()
    want = plain_trie(rows)
    assert len(got) == len(want)
    assert {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got} == want


def talk(conv, words, start=0):
    return [(conv, start + i, ("user", "assistant")[i % 2], w) for i, w in enumerate(words)]


@pytest.fixture
def conversations():
    rows = []
    for c in range(0, 70):
        rows += talk(c, ["hello there you", f"topic {c % 3}", "more   on\tthat", f"end {c % 5}", "bye"][: 1 + c % 5])
    return rows


def test_equals_a_walked_tree(spark, conversations):
    check(spark, conversations)


def test_odd_rows(spark, conversations):
    rows = conversations + [
        (100, None, None, None), (100, None, "user", ""), (100, 1, "user", "x y"), (100, 1, "assistant", "tie"), (100, 2, "user", "x y"), (100, 2, "user", "x y"),  # null turns, ties, repeats
        (None, 0, "user", "belongs to nothing"), (101, 5, "system", "\x0b é 東京 \n z"), (-3, 0, "user", "hello there you"), (-20, 0, "user", "a"), (-39, 0, "user", "b"),
        (123, 0, "user", "the base is absent"), (1000, 0, "user", "w " * 50_000), (1001, 0, "user", "w " * 50_000),
    ]
    check(spark, rows)


def test_turnless_conversations(spark):
    gone = [c for c in range(1, 60) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:4]
    check(spark, [(c, 0, "user", "cut off") for c in gone])
    check(spark, [(c, 0, "user", "cut off") for c in gone] + [(gone[-1] + 200, i, "user", f"t{i}") for i in range(5)])


def test_long_conversations_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "BLOCK", 7)
    rows = [r for c in (20, 40, 60, 61) for r in talk(c, [f"turn {i if c < 60 else min(i, 90)}" for i in range(120)])]
    check(spark, rows + talk(21, ["turn 0", "turn 1"]))


def test_hot_conversation_and_lists_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "LIST_BYTES", 20)
    check(spark, [r for c in range(0, 4000, 20) for r in talk(c, ["same start", "same middle", "same end" if c % 3 else f"end {c}"])])


def test_empty_tables(spark):
    assert trie(build(spark, [])).count() == 0
    assert trie(build(spark, [(None, 1, "user", "x")])).count() == 0
