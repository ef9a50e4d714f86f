import re
from itertools import permutations

import pytest

from folioscope.llm.filteraudit import COUNTS, filter_audit

WORDY = " ".join(f"w{i}" for i in range(250))


def plain_audit(docs, labels):
    """The audit document by document and order by order; docs: (doc_id, text, source)."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    judged = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        failed = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": copy}
        judged.append((source or "", {f for f, x in failed.items() if x}, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in judged}:
        rows = [r for r in judged if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [r for r in rows if f in r[1] and not r[1] & before]
                shapley[f] += len(here)
                out[part, "".join(order), k + 1] = [
                    sum(f not in r[1] and not r[1] & before for r in rows), len(here), sum(f in r[1] and bool(r[1] & before) for r in rows),
                    sum(r[1] == {f} for r in rows), sum(r[2] for r in here), sum(r[3] for r in here), f,
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v[-1] = shapley[order[step - 1]]
    return out


@pytest.fixture
def rows():
    return [
        (1, WORDY, "a"), (2, WORDY, "b"), (3, WORDY, "b"), (3, WORDY, "b"), (1, WORDY, "a"),  # copies, and repeated rows that aren't copies of each other
        (4, WORDY + " # mark", "a"), (5, "LOUD WORDS", "a"), (6, "so " * 300, "b"), (7, None, None), (8, "", None), (9, "", ""),
        (None, WORDY, "a"), (None, "LOUD WORDS", None), (10, "A" + "x" * 49 + " " + WORDY, "c"), (11, "é東 \x0b ü x", "c"), (12, "a | b " * 40_000, "c"),
    ]


def test_equals_brute_force(spark, documents, rows):
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (4, 1, None), (5, 0, 1), (None, 1, 1), (99, 1, 1), (6, 1, 1), (7, 1, 1)]
    docs = documents([(i, t, "en", s) for i, t, s in rows])
    got = filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r["part"], r["filter_order"], r["step"]): [*(r[c] for c in COUNTS), r["shapley"]] for r in got} == plain_audit(rows, labels)
    assert len(got) == 600 * 4


def test_copies_in_one_hot_group(spark, documents):
    rows = [(i, WORDY if i % 3 else f"{WORDY} {i}", f"s{i % 2}") for i in range(200)]
    docs = documents([(i, t, "en", s) for i, t, s in rows], clashing=False).repartition(7)
    got = filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("step = 1").collect()
    want = plain_audit(rows, [])
    assert all([*(r[c] for c in COUNTS), r["shapley"]] == want[r["part"], r["filter_order"], 1] for r in got)
    assert sum(r["removed"] for r in got if r["filter_order"] == "EABCD") == 132


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(documents([]), none).count() == 0
    assert filter_audit(documents([(1, None)]), none).count() == 600
