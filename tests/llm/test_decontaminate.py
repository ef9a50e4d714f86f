import hashlib
import random
import re

from folioscope.llm.decontaminate import contamination_report, drop_contaminated

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for name, text in items:
        w = words(text)
        for i in range(max(len(w) - 9, min(1, len(w)))):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(name)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (names := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= names
        found.discard(None)
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def random_case(seed):
    r = random.Random(seed)
    vocabulary = ["Alpha", "béta", "x", "42", "dé-jà", "ZULU"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 9, 10, 14])))) for i in range(12)]
    docs = [(i, ", ".join(r.choice(vocabulary) for _ in range(r.randint(0, 200)))) for i in range(30)]
    docs += [(100 + i, f"start {t} end") for i, t in items]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = random_case(1)
    got = contamination_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == brute(docs, items)


def test_several_blocks_give_the_same(spark):
    docs, items = random_case(2)
    got = contamination_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=150)
    assert rows(got) == brute(docs, items)


def test_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    items = [(1, "word " * 11), (2, None), (None, "one text of nine"), (4, "東京"), (4, "東京")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert rows(contamination_report(docs, benchmark)) == brute([r[:2] for r in odd_rows], items)
    kept = drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert kept.where("doc_id IN (6, 7)").count() == 0 and kept.where("doc_id IS NULL").count() == 2


def test_empty_tables(spark, documents, odd_rows):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert contamination_report(documents([]), benchmark).count() == 0
    assert {r["contaminated"] for r in contamination_report(documents(odd_rows), benchmark).collect()} == {False}


def test_words_that_are_letters_and_long_words(spark):
    long_word = "ab" * 200
    docs = [(1, "the " * 300 + long_word), (2, long_word[:-1] + "c"), (3, f"x {long_word} y")]
    items = [(1, "The"), (2, long_word)]
    got = contamination_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == brute(docs, items)


def test_names_that_differ_in_capitals(spark):
    docs = spark.createDataFrame([(1, "some words", "x")], "doc_id long, text string, HIT string")
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    assert drop_contaminated(docs, items).columns == docs.columns
    assert drop_contaminated(docs, items).count() == 0
