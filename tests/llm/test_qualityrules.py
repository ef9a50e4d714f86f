import random
import re
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm.qualityrules import COUNTS, RISK, binomial_tail, certified_cutoffs, counted_texts, fit_cutoffs, keep_good, rule_report, text_counts

LABELS = "doc_id long, quality int, toxic int"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t\x0b#|東", max_size=60), max_size=6))
def test_counts_equal_plain_ones(texts):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    got = text_counts(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert got.tolist() == [plain_counts(t) for t in texts]


def test_binomial_tail_is_exact():
    for n, lost, risk in [(1, 0, 0.02), (217, 0, 0.02), (400, 3, 0.02), (500, 10, 0.02), (500, 40, 0.02), (50, 49, 0.5), (2000, 20, 0.013)]:
        p = Fraction(risk)
        want = float(sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(lost + 1)))
        assert binomial_tail(np.array([lost]), np.array([n]), risk)[0] == pytest.approx(want, rel=1e-9)
    assert binomial_tail(np.array([0, 5, 7]), np.array([0, 5, 7]), 0.02).tolist() == [1, 1, 1]
    assert 0 < binomial_tail(np.array([1_980_000]), np.array([100_000_000]), 0.02)[0] < 1e-30


def labelled(n, seed, noise):
    """Good texts with values around zero, bad ones with many symbols; in stratum c good texts have symbols too."""
    r = random.Random(seed)
    for i in range(n):
        good, stratum = i % 5 > 0, "abc"[i % 3]
        symbols = r.randrange(0, 3) if good and stratum != "c" else r.randrange(0, 3000)
        yield (stratum, [r.randrange(400, 600), -r.randrange(400, 600), symbols, r.randrange(noise), r.randrange(noise)], good, i % 4 == 0)


def test_certified_cutoffs_keep_the_risk(spark):
    schema = "stratum string, values array<long>, good boolean, proposes boolean"
    got = {r["stratum"]: r for r in certified_cutoffs(spark.createDataFrame(list(labelled(9000, 1, 40)), schema)).collect()}
    fresh = list(labelled(30_000, 2, 40))
    for stratum in "abc":
        lost = [any(v > c for v, c in zip(values, got[stratum]["cutoffs"], strict=True)) for s, values, good, _ in fresh if s == stratum and good]
        assert sum(lost) / len(lost) <= RISK
        assert got[stratum]["p_value"] <= 0.05 / 3
    caught = [any(v > c for v, c in zip(values, got["a"]["cutoffs"], strict=True)) for s, values, good, _ in fresh if s == "a" and not good]
    assert sum(caught) / len(caught) > 0.9


def test_too_few_labels_certify_nothing(spark):
    schema = "stratum string, values array<long>, good boolean, proposes boolean"
    assert certified_cutoffs(spark.createDataFrame(list(labelled(200, 1, 40)), schema)).count() == 0


def rows(n=1200):
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "house", "tree", "river", "stone", "cloud", "window"]
    for i in range(n):
        text = " ".join("".join(r.choices(words, k=1)) + str(r.randrange(50)) for _ in range(60))
        yield (i, text if i % 6 else text.replace("a", "$$"), "en", "a")


def test_report_and_documents_kept(spark, documents):
    data = list(rows())
    docs = documents(data)
    labels = spark.createDataFrame([(i, int(i % 6 > 0), 0) for i, *_ in data if i % 3 < 2], LABELS)
    got = {r["doc_id"]: r for r in rule_report(docs, labels).collect()}
    assert all([got[i][c] for c in COUNTS] == plain_counts(t) for i, t, *_ in data)
    assert not any(got[i]["kept"] for i, *_ in data if i % 6 == 0)
    assert sum(got[i]["kept"] for i, *_ in data if i % 6) >= 0.97 * sum(i % 6 > 0 for i, *_ in data)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i]["kept"]}


def test_odd_rows(spark, documents, odd_rows):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, None, 0), (None, 1, 1), (99, 1, 0), (7, 0, 1)], LABELS)
    docs = documents(odd_rows)
    got = rule_report(docs, labels).collect()
    text = {(r[0], len(r[1] or "")): r[1] for r in odd_rows}
    assert len(got) == len(odd_rows)
    for r in got:
        if r["doc_id"] not in (None, 9, 7):
            want = plain_counts(next(t for (i, _), t in text.items() if i == r["doc_id"]))
            assert [r[c] for c in COUNTS] == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r["kept"] == (not r["base_failed"])
    assert {tuple(r[c] for c in COUNTS) for r in got if r["doc_id"] == 7} == {(60_000, 240_000, 0, 0, 60_000)}


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], LABELS)
    assert rule_report(documents([]), none).count() == 0
    assert [tuple(r) for r in rule_report(documents([(1, "x")]), none).collect()] == [(1, 1, 1, 0, 0, 0, True, False)]
    counted = counted_texts(documents([(1, None)])).select("row.doc_id", "counts", "stratum")
    assert fit_cutoffs(counted, none).count() == 0
