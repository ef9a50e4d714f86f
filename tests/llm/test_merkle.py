import hashlib

from pyspark.sql import functions as F

from folioscope.llm.merkle import edited_paragraphs, fingerprint, fingerprints, likeness, merkle_leaves


def prints(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r[0] for r in df.select("i", fingerprint(merkle_leaves(F.col("text"))).alias("f")).orderBy("i").select("f").collect()]


def test_roots_test_equality(spark):
    texts = ["a. b", "a. b", "a.b", "a. \nb", "a. \n\nb", "a. \u0001b", "", None, "\n", "\n\n", "a, b", "a; b"]
    got = prints(spark, texts)
    assert got[0] == got[1] and got[6] == got[7]
    assert len(set(got)) == len(texts) - 2


def test_branches_locate_edits(spark):
    before = "one. two\nthree\n\nfour\nfive, six\n\nseven"
    after = "one. two\nthree\n\nfour\nfive, changed\n\nseven\neight"
    df = spark.createDataFrame([(before, after), (before, before)], "a string, b string")
    got = [r[0] for r in df.select(edited_paragraphs(merkle_leaves(F.col("a")), merkle_leaves(F.col("b")))).collect()]
    assert [tuple(x) for x in got[0]] == [(1, 1), (2, 1)] and got[1] == []


def test_likeness(spark):
    a, b, c = prints(spark, ["one, two, three, four.", "one, two, three, 4.", "x"])
    row = spark.range(1).select(likeness(F.lit(a), F.lit(b)), likeness(F.lit(a), F.lit(a)), likeness(F.lit(a), F.lit(c))).first()
    assert tuple(row) == (0.75, 1.0, 0.0)


def test_odd_rows(spark, documents, odd_rows):
    rows = [r for r in odd_rows if r[0] not in (9, None)]
    got = {r["doc_id"]: r for r in fingerprints(documents(rows)).collect()}
    texts = {r[0]: r[1] or "" for r in rows}
    ids = sorted(texts)
    for k, i in enumerate(ids):
        text, following = texts[i], texts[ids[(k + 1) % len(ids)]]
        edited = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_next"] <= 1 and 0 <= got[i]["near_edited"] <= 1
    assert got[1]["fingerprint"] == got[10]["fingerprint"]
    assert fingerprints(documents(odd_rows)).count() == len(odd_rows)


def test_one_and_no_document(spark, documents):
    assert fingerprints(documents([])).count() == 0
    only = fingerprints(documents([(5, "abcdefgh")])).first()
    assert only["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and only["near_next"] == 1.0


def test_inserted_branches(spark):
    def places(before, after):
        df = spark.createDataFrame([(before, after)], "a string, b string")
        return [tuple(x) for x in df.select(edited_paragraphs(merkle_leaves(F.col("a")), merkle_leaves(F.col("b")))).first()[0]]

    assert places("a\nb\nc", "a\nnew\nb\nc") == [(0, 1)] == places("a\nnew\nb\nc", "a\nb\nc")
    assert places("a\n\nb\n\nc", "a\n\nnew\nlines\n\nb\n\nc") == [(1, 0), (1, 1)]
    assert places("a\na", "a\na\na") == [(0, 2)] and places("", "x") == [(0, 0)] and places("", "") == []


def test_smallest_id_is_not_null(spark):
    docs = spark.createDataFrame([(-(1 << 63), "one two"), (None, "three four")], "doc_id long, text string")
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints(docs).collect()}
    assert got == {-(1 << 63): hashlib.sha256(b"one tw" + b"t").hexdigest(), None: hashlib.sha256(b"three fo" + b"on").hexdigest()}


def test_long_texts_have_bounded_fingerprints(spark):
    """Beyond KEPT leaves a fingerprint stops growing, and likeness is near the share of common clauses."""
    clause = [f"clause number {i}, " for i in range(4000)]
    a, b, c, d = "".join(clause[:2000]), "".join(clause[500:2500]), "".join(clause[2000:]), "".join(clause[:2000]) + "x"
    shown = prints(spark, [a, b, c, d])
    assert all(len(p) == 64 + 1 + 8 * 128 for p in shown) and len(set(shown)) == 4
    near = spark.range(1).select(*(likeness(F.lit(shown[0]), F.lit(p)) for p in shown)).first()
    assert near[0] == 1.0 and abs(near[1] - 0.75) < 0.12 and near[2] == 0.0 and near[3] > 0.97
