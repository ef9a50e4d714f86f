import hashlib
import random

import numpy as np
import pytest

from folioscope.llm import suffix_dedup
from folioscope.llm.suffix_dedup import longest_previous_factors, minimizer_runs, previous_factor, repeat_report, without_repeats


def brute(docs, length=100):
    seen, out = set(), {}
    for key, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(raw[i : i + length])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[key] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept)
    return out


def corpus(seed):
    r = random.Random(seed)
    passages = ["".join(r.choice("abcdefgh é\n") for _ in range(r.choice([60, 99, 100, 101, 160, 400]))) for _ in range(8)]
    docs = []
    for i in range(60):
        text = "".join(r.choice(passages) if r.random() < 0.5 else "".join(r.choice("abcdefgh é") for _ in range(r.randint(1, 80))) for _ in range(r.randint(0, 8)))
        docs.append((i * 3, text))
    docs += [(500, "x" * 350), (501, "xy" * 200), (502, "x" * 99), (503, docs[4][1]), (504, None), (505, "")]
    return docs


def report(df, **options):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeat_report(df, **options).collect()}


@pytest.mark.parametrize("length", [100, 30])
def test_matches_brute_force(spark, length):
    docs = corpus(length)
    got = report(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), length=length)
    assert got == {k: v[:4] for k, v in brute(docs, length).items()}


def test_split_groups_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 2)
    line = "A line of sixty or so characters that very many documents have."
    r = random.Random(5)
    docs = [(i, "".join(r.choice("abcdef") for _ in range(70)) + line + ("Same tail after the line for some. " * 3 if i % 3 == 0 else str(i) * 50)) for i in range(40)]
    got = report(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got == {k: v[:4] for k, v in brute(docs).items()}


def test_odd_rows(spark, documents, odd_rows):
    got = sorted((tuple(r) for r in repeat_report(documents(odd_rows)).collect()), key=str)

    assert len(got) == len(odd_rows)
    by_id = {r[0]: r for r in got}
    twice = [r for r in got if r[0] == 1]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert by_id[10][2] == by_id[10][1] and by_id[3][1] == by_id[4][1] == 0
    assert by_id[7][2] == 299_995  # of "word word ...", what starts at 5 or later starts earlier too


def test_texts_are_cut(spark, documents, odd_rows):
    docs = documents(odd_rows)
    cut = without_repeats(docs)
    assert cut.columns == docs.columns and cut.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert cut.where("doc_id = 10").count() == 0
    assert cut.where("doc_id IN (3, 4, 5, 8)").count() == 4
    assert cut.where("doc_id = 7").first()["n_chars"] == 5


def test_empty_table(spark, documents):
    assert repeat_report(documents([])).count() == 0


def test_runs_cover_every_start_once():
    r = random.Random(3)
    texts = ["".join(r.choice("ab") for _ in range(n)) for n in (0, 99, 100, 101, 700, 5, 2000)]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0, *map(len, texts)])
    runs = minimizer_runs(np.frombuffer(raw, np.uint8), offsets, 100, 32)
    starts = sorted((int(w), s) for w, a, c in zip(runs["row"], runs["start"], runs["count"]) for s in range(a, a + c))
    assert starts == [(i, s) for i, t in enumerate(texts) for s in range(len(t) - 99)]


def test_previous_factor():
    data = np.frombuffer(b"abcabcabcabcabcabcxabcabcabcab", np.uint8)
    starts = np.arange(len(data) - 9)
    text = data.tobytes()
    want = [text[i : i + 10] in {text[j : j + 10] for j in range(i)} for i in starts]
    assert previous_factor(data, starts, 10).tolist() == want


def test_longest_previous_factors():
    r = random.Random(9)
    fragments = [bytes(r.choice(b"ab") for _ in range(r.choice([30, 45, 70]))) * r.choice([1, 2]) for _ in range(12)] + [b"\0" * 40, b"a" * 60]
    data, ends = np.frombuffer(b"".join(fragments), np.uint8), np.repeat(np.cumsum([len(f) for f in fragments]), [len(f) for f in fragments])
    starts = np.flatnonzero(ends - np.arange(len(data)) >= 10)
    starts = starts[np.random.default_rng(1).permutation(len(starts))]
    got = longest_previous_factors(data, ends, starts, 10)

    def common(i, j):
        n = 0
        while i + n < ends[i] and j + n < ends[j] and data[i + n] == data[j + n]:
            n += 1
        return n

    want = [max((common(i, j) for j in starts[:k]), default=0) for k, i in enumerate(starts)]
    ordered_by = 10 + suffix_dedup.DEEPER
    assert [min(g, ordered_by) for g in got.tolist()] == [min(w, ordered_by) if w >= 10 else 0 for w in want]
