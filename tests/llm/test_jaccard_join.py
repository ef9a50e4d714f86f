import random
import re
from math import comb

import pytest

from folioscope.llm import jaccard_join
from folioscope.llm.jaccard_join import components, jaccard_groups, least_matches, one_of_each

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, threshold=0.8):
    sets = {}
    for key, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        sets[key] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(1, len(w))))}
    root, links = {k: k for k in sets}, dict.fromkeys(sets, 0)

    def find(x):
        return x if root[x] == x else find(root[x])

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and common >= threshold * (len(sets[a]) + len(sets[b]) - common):
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: (find(k), links[k]) for k in keys}


def near_copies(seed, n):
    r = random.Random(seed)
    base = [[r.choice("abcdefghij") * r.randint(1, 3) for _ in range(60)] for _ in range(4)]
    docs = []
    for i in range(n):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            words[r.randrange(60)] = r.choice(["zz", "yy", "xx"])
        docs.append((i, " ".join(words)))
    return docs


def groups(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in df.collect()}


@pytest.mark.parametrize("block", [512, 16])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    docs = near_copies(block, 150)
    assert groups(jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_odd_rows(spark, documents, odd_rows):
    docs = dict.fromkeys(r[:2] for r in odd_rows)  # repeated rows are one document
    got = sorted((tuple(r) for r in jaccard_groups(documents(odd_rows)).collect()), key=str)
    names = {i: d for i, (d, _) in enumerate(sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)))}
    want = brute([(i, t) for i, (_, t) in enumerate(sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)))])
    assert got == sorted(((names[i], names[c], n) for i, (c, n) in want.items()), key=str)
    assert (1, 1, 2) in got and (10, 1, 2) in got and (3, 3, 0) in got  # the text without an id counts
    assert [g[0] for g in got].count(9) == 2 and [g[0] for g in got].count(None) == 2


def test_texts_of_one_id(spark, documents):
    prose = " ".join(f"w{i}" for i in range(50))
    docs = documents([(1, prose), (2, "a totally different text of some words"), (2, prose + " more"), (None, prose)])
    assert sorted((tuple(r) for r in jaccard_groups(docs).collect()), key=str) == [(1, 1, 2), (2, 1, 2), (2, 2, 0), (None, 1, 2)]
    assert sorted(r["text"] for r in one_of_each(docs).collect()) == ["a totally different text of some words", prose]


def test_long_words_of_a_regular_pattern(spark):
    """Two words that a polynomial hash modulo 2**64 takes for the same, whatever its base."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    docs = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word)]
    assert groups(jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string"))) == {1: (1, 1), 2: (2, 0), 3: (1, 1)}


def test_one_of_each(spark, documents, odd_rows):
    docs = documents(odd_rows)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id = 10").count() == 0 and kept.where("doc_id = 1").count() == 2
    assert [r["text"] for r in kept.where("doc_id IS NULL").collect()] == ["another text without an id"] and kept.where("doc_id = 9").count() == 2


def test_empty_table(spark, documents):
    assert jaccard_groups(documents([])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60) if i % 20] + [(7, 7), (100, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: (i - 1) // 20 * 20 + 1 for i in range(1, 61)}, 100: 1}


def test_posterior():
    for n, m in ((8, 2), (32, 17)):
        tail = sum(comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m + 1))
        assert (least_matches(n, 0.8, 1e-4) <= m) == (tail >= 1e-4)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_table_of_one_short_text(spark, n):
    docs = [(1, " ".join("abcd"[:n]))]
    assert groups(jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs) == {1: (1, 0)}


# ---------------------------------------------------------------- what is compared


def chain(n):
    """Texts each of which is similar to the two before and the two after it, and no other."""
    words = [f"w{i}" for i in range(5 * n + 100)]
    return [(k, " ".join(words[5 * k : 5 * k + 100])) for k in range(n)]


def compared(spark, docs):
    """Pairs that were compared by buckets."""
    seen = []
    real = jaccard_join.survivors
    with pytest.MonkeyPatch.context() as m:
        m.setattr(jaccard_join, "survivors", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
        got = groups(jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string")))
    return got, seen[0].agg({"compared": "sum"}).first()[0]


def test_a_long_chain_is_compared_in_linear_time(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 64)
    counts = {}
    for n in (500, 2000):
        got, counts[n] = compared(spark, chain(n))
        assert {c for c, _ in got.values()} == {0} and all(got[k][1] == min(2, k) + min(2, n - 1 - k) for k in range(n))
    assert counts[2000] < 4.5 * counts[500] and counts[2000] < 2000 * 60


@pytest.mark.parametrize("by_bucket", [True, False])
def test_both_ways_of_verifying_a_large_component(spark, monkeypatch, by_bucket):
    """One large group of near copies, tied to a chain: by pairs of blocks, and by buckets."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    if by_bucket:
        monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 1 << 5)  # many blocks: buckets send less
    r = random.Random(4)
    docs = chain(30)
    for k in range(30, 90):
        words = docs[0][1].split()
        for _ in range(r.randrange(4)):
            words[r.randrange(100)] = r.choice(["zz", "yy"])
        docs.append((k, " ".join(words)))
    assert groups(jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_pairs_of_blocks_are_each_made_once():
    import numpy as np

    own, low, high = (np.array(x) for x in ([0, 0, 1, 0, 1, 1, 2, 2, 2], [0, 0, 0, 0, 0, 0, 2, 2, 2], [1, 1, 1, 1, 1, 1, 2, 2, 2]))
    got = [(int(i), int(j)) for a, b in jaccard_join.pair_chunks([0, 3, 6], own, low, high) for i, j in zip(a, b, strict=True)]
    assert got == [(0, 2), (1, 2), (3, 4), (3, 5), (6, 7), (6, 8), (7, 8)]


def test_star_forest():
    import numpy as np

    rows, lows = jaccard_join.star_forest(np.array([5, 4, 3, 8]), np.array([4, 3, 1, 9]), 10)
    assert dict(zip(rows.tolist(), lows.tolist(), strict=True)) == {3: 1, 4: 1, 5: 1, 9: 8}
    assert [len(x) for x in jaccard_join.star_forest(np.zeros(0, np.int64), np.zeros(0, np.int64), 3)] == [0, 0]
