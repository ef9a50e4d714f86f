"""The store of segments and the inverted index that is kept in it."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.functions.text import word_tokens
from folioscope.operators.search import asked_tokens, fts_search
from folioscope.operators.textindex import TextIndex
from folioscope.session import work_dir
from folioscope.sources.segments import Conflict, Segments, nested


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "store")


CHILDREN = ["blocks", "chunks", "tables", "targets", "pages", "segments", "outlines", "formulas"]


def document(spark, doc, version, rows=3):
    return {name: spark.createDataFrame([(doc, i, f"{name} {version}.{i}") for i in range(rows)], "doc_id long, n long, text string") for name in CHILDREN}


def state(store):
    return {name: sorted((r["doc_id"], r["n"], r["text"]) for r in store.read(name).collect()) for name in CHILDREN}


def keys(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "doc_id long")


def test_replaces_all_tables_of_a_document(spark, path):
    store = Segments(spark, path, "doc_id")
    assert store.commit("a", document(spark, 1, "old"))
    assert store.commit("b", document(spark, 2, "old"))
    assert store.commit("c", document(spark, 1, "new", rows=2), gone=keys(spark, 1))
    got = state(store)
    assert all(got[n] == [(1, 0, f"{n} new.0"), (1, 1, f"{n} new.1"), (2, 0, f"{n} old.0"), (2, 1, f"{n} old.1"), (2, 2, f"{n} old.2")] for n in CHILDREN)
    assert not store.commit("c", document(spark, 1, "again"), gone=keys(spark, 1)) and state(store) == got


def test_a_failure_between_two_tables_leaves_the_old_document_whole(spark, path):
    store = Segments(spark, path, "doc_id")
    store.commit("a", document(spark, 1, "old"))
    before = state(store)
    broken = document(spark, 1, "new")
    broken["pages"] = broken["pages"].withColumn("text", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.commit("b", broken, gone=keys(spark, 1))
    assert state(store) == before and store.manifest().number == 1
    assert store.commit("b", document(spark, 1, "new"), gone=keys(spark, 1))  # the same batch, run again
    assert {r[2].split(" ")[1][:3] for rows in state(store).values() for r in rows} == {"new"}


def test_cascade_delete_and_aggregate(spark, path):
    store = Segments(spark, path, "doc_id")
    for i in (1, 2, 3):
        store.commit(f"doc {i}", document(spark, i, "v"))
    store.commit("delete", {}, gone=keys(spark, 2, 99, None))
    got = nested(keys(spark, 1, 2, 3), {n: store.read(n) for n in CHILDREN}, "doc_id", {n: ["n"] for n in CHILDREN}).orderBy("doc_id").collect()
    assert [[len(r[n]) for n in CHILDREN] for r in got] == [[3] * 8, [0] * 8, [3] * 8]
    assert [x["n"] for x in got[0]["pages"]] == [0, 1, 2]


def test_compaction_keeps_the_rows_and_the_batches(spark, path):
    store = Segments(spark, path, "doc_id")
    store.commit("a", document(spark, 1, "old"), facts={"n": 3})
    at = store.manifest()
    store.commit("b", document(spark, 1, "new"), gone=keys(spark, 1), facts={"n": -1})
    before = state(store)
    store.compact()
    assert state(store) == before and len(store.manifest().segments) == 1 and store.manifest().facts() == {"n": 2}
    assert not store.commit("b", document(spark, 1, "newer"), gone=keys(spark, 1))
    assert store.commit("c", {}, gone=keys(spark, 1)) and all(not rows for rows in state(store).values())
    assert sorted(r["text"] for r in store.read("pages", at=at).collect()) == [f"pages old.{i}" for i in range(3)]  # an older state is still there


def test_two_writers_from_one_state(spark, path):
    store = Segments(spark, path, "doc_id")
    store.commit("a", document(spark, 1, "old"))
    old = store.manifest()
    store.commit("b", document(spark, 2, "old"))
    with pytest.raises(Conflict):
        store._switch(type(old)(old.number + 1, old.segments, old.schemas))


# ---------------------------------------------------------------- inverted index

TEXTS = [(1, "the cat sat on the mat"), (2, "The dog, the dog!"), (3, "结构 构件 the 梁"), (4, ""), (5, None), (6, "cat " * 300), (7, "café naïve 東京都 cat"), (8, "the cat sat on the mat")]


def plain_bm25(texts, query, k1=1.2, b=0.75):
    tokens = {k: [t for run in [text or ""] for t in all_tokens(run)] for k, text in texts.items()}
    n, average = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = {q: sum(q in t for t in tokens.values()) for q in query}
    out = {}
    for k, ts in tokens.items():
        c = Counter(ts)
        if any(q in c for q in query):
            out[k] = sum(math.log((n - df[q] + 0.5) / (df[q] + 0.5) + 1) * c[q] * (k1 + 1) / (c[q] + k1 * (1 - b + b * len(ts) / average)) for q in query if q in c)
    return out


def all_tokens(text):
    """Tokens of a text with repetitions: asked_tokens keeps each once."""
    out = []
    for word in text.split():
        out += asked_tokens(word)
    return out


def index(spark, rows, path, **more):
    out = TextIndex(spark, path, **more)
    out.replace("all", spark.createDataFrame(rows, "id long, text string"), "id", "text")
    return out


def scores(df):
    return {r["key"]: round(r["score"], 9) for r in df.collect()}


@pytest.mark.parametrize("query", [["cat", "the"], ["構"], ["结构", "dog"], ["東京", "京都"], ["absent"], []])
def test_search_equals_a_scan(spark, path, query):
    docs = spark.createDataFrame(TEXTS, "id long, text string")
    got = scores(index(spark, TEXTS, path, buckets=7).search(query))
    assert got == {k: round(v, 9) for k, v in plain_bm25({str(k): t for k, t in TEXTS}, query).items()}
    if query:
        assert got == scores(fts_search(docs, "id", "text", query).withColumn("key", F.col("key").cast("string")))


def test_replaced_documents(spark, path):
    kept = index(spark, TEXTS, path, buckets=7)
    changed = [(2, "a cat instead"), (9, "new dog"), (4, "结构 at last")]
    assert kept.replace("second", spark.createDataFrame(changed, "id long, text string"), "id", "text", removed=spark.createDataFrame([(1,), (77,)], "id long"))
    assert not kept.replace("second", spark.createDataFrame(changed, "id long, text string"), "id", "text")
    now = {k: t for k, t in {**dict(TEXTS), **dict(changed)}.items() if k != 1}
    fresh = index(spark, list(now.items()), f"{path}-fresh", buckets=7)
    for query in (["cat", "the"], ["dog"], ["结构"], ["mat", "new"]):
        assert scores(kept.search(query)) == scores(fresh.search(query)) == {k: round(v, 9) for k, v in plain_bm25({str(k): t for k, t in now.items()}, query).items()}
    kept.store.compact()
    assert scores(kept.search(["cat", "dog"])) == scores(fresh.search(["cat", "dog"]))


def test_a_question_reads_the_buckets_of_its_tokens(spark, path):
    kept = index(spark, TEXTS, path, buckets=64)
    plan = kept.search(["cat", "dog"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters: [In(token" in plan
    files = kept.hits(["cat"]).select(F.input_file_name().alias("f")).distinct().collect()
    assert len({r["f"].split("bucket=")[1].split("/")[0] for r in files}) == 1


def test_an_update_writes_the_buckets_of_its_tokens(spark, path):
    kept = index(spark, TEXTS, path, buckets=64)
    kept.replace("one", spark.createDataFrame([(2, "cat dog")], "id long, text string"), "id", "text")
    segment = kept.store.manifest().segments[-1]["id"]
    written = spark.read.parquet(f"{path}/postings/segment={segment}")
    assert written.count() == 2 and written.select("bucket").distinct().count() <= 2


def test_empty_tables(spark, path):
    kept = index(spark, [], path)
    assert kept.search(["cat"]).count() == 0
    kept.replace("more", spark.createDataFrame(TEXTS, "id long, text string"), "id", "text")
    assert scores(kept.search(["dog"])) == {k: round(v, 9) for k, v in plain_bm25({str(k): t for k, t in TEXTS}, ["dog"]).items()}
    assert work_dir(spark)


# ---------------------------------------------------------------- pairs of characters


def test_pairs_equal_a_scan(spark, path):
    from folioscope.operators.search import paragraph_search, paragraph_tokens, tfidf_recall
    from folioscope.operators.textindex import GramIndex

    texts = [("a", "sort a list"), ("b", "how to sort"), ("c", "listing of things"), ("d", "结构 构件"), ("e", ""), ("f", None), ("g", "x"), ("h", "sort a list"), ("i", "o a l s")]
    docs = spark.createDataFrame(texts, "id string, text string")
    kept = GramIndex(spark, path)
    kept.load(docs, "id", "text")
    for query in ("how do I sort a list", "结构", "zz", "x", "", "listlist"):
        assert scores(kept.recall(query, top=9, least=0.0001)) == scores(tfidf_recall(docs, "id", "text", query, top=9, least=0.0001))
    kept.load(docs.where("id <> 'a'").unionByName(spark.createDataFrame([("j", "sort sort")], docs.schema)), "id", "text")  # a further load replaces what it has
    now = docs.unionByName(spark.createDataFrame([("j", "sort sort")], docs.schema))
    assert scores(kept.recall("sort", top=9)) == scores(tfidf_recall(now, "id", "text", "sort", top=9))
    paragraphs = TextIndex(spark, f"{path}-p", tokens=word_tokens)
    paragraphs.replace("all", docs, "id", "text")
    assert scores(paragraphs.bm25(paragraph_tokens("sort a sort 构"), k1=1.5)) == scores(paragraph_search(docs, "id", "text", "sort a sort 构", top=99))
