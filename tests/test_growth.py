"""That work grows with the input: what a query has to do is done, and no more."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions.text import word_tokens
from folioscope.operators import alignment, retrieval, search, structure, upkeep
from folioscope.operators.textindex import TextIndex
from folioscope.plans import routes
from folioscope.plans.registry import QUERIES, Tables

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def refuse(*_, **__):
    raise AssertionError("not for this query")


def test_one_question_indexes_nothing(spark, monkeypatch):
    monkeypatch.setattr(TextIndex, "replace", refuse)
    assert QUERIES["sparse_retriever"](spark, SMALL).count() > 0


RUNS = ["一", "a一", "一二a三b四五六 七", "𠀀a𐐀b一二𠀀三", "😀the 😀一", "", None, "é1二", "x二二", "the", "other", "THE.of", "3.2.1", "3２"]


def test_having_a_token_is_having_it_in_the_list(spark):
    rows = spark.createDataFrame([(x,) for x in RUNS], "t string")
    for asked in (["the", "of", "3"], ["一"], ["一二", "七"], ["b", "二二", "三"], ["𠀀a𐐨b", "é1"], []):
        listed = F.arrays_overlap(search.index_tokens(F.col("t")), F.array(*map(F.lit, asked)).cast("array<string>"))
        assert rows.where(search.has_token(F.col("t"), asked) != listed).count() == 0
    assert rows.where("t LIKE '%🙂%' OR t = '𠀀a𐐀b一二𠀀三'").select(search.index_tokens(F.col("t"))).first()[0] == ["𠀀a𐐨b", "一二", "𠀀", "三"]


def test_boxes_of_pages_stream(spark):
    blocks = spark.createDataFrame([(1, p, f"b{p}{i}", i, "paragraph", "same" if i < 2 else f"text {i}") for p in range(3) for i in range(3)], "doc_id long, page_idx long, block_id string, reading_order long, block_type string, text string")
    found = alignment.resolved_boxes(blocks, blocks.withColumn("candidate_id", F.concat(F.lit("c"), "block_id")))
    assert {(r[0], r[1]) for r in found.collect()} == {(f"b{p}{i}", f"cb{p}{i}") for p in range(3) for i in range(3)}
    assert "FlatMapGroups" not in plan(found)


def test_chunks_of_documents_stream(spark):
    rows = [(d, f"{d}:{i}", kind, "s", 0, i, text) for d in range(3) for i, (kind, text) in enumerate([("title", "t"), ("paragraph", "one  two"), ("paragraph", " "), ("paragraph", "x" * 1020), ("paragraph", "y" * 30), ("table", "z")])]
    found = structure.chunk_assembly(spark.createDataFrame(rows, "doc_id long, block_id string, block_type string, section_path string, page_idx long, reading_order long, text string").repartition(5))
    assert "FlatMapGroups" not in plan(found)
    told = sorted((r["chunk_id"], r["chunk_type"], r["n_blocks"], r["token_count"]) for r in found.where("doc_id = 1").collect())
    # a text of Unicode's white space alone has no length and no blank before it
    assert told == [("chunk-1:0", "outline_anchor", 1, 1), ("chunk-1:1", "content", 3, 257), ("chunk-1:4", "table_summary", 2, 8)]


def test_the_dense_route_makes_no_tables_of_others(spark, monkeypatch):
    for name in ("loaded_blocks", "loaded_chunks", "loaded_targets", "loaded_windows"):
        monkeypatch.setattr(routes, name, refuse)
    assert QUERIES["dense_retriever"](spark, SMALL).count() > 0


def test_hashed_vectors_are_made_in_their_rows(spark):
    texts = spark.createDataFrame([("a", "the cat the mat"), ("b", ""), ("c", None), ("d", "cat 12 漢字"), ("e", "x")], "id string, text string")
    found = upkeep.hash_vectors(texts, "id", "text", dimension=8)
    assert "Exchange" not in plan(found)
    want = {(r["key"], r["bucket"]): r["value"] for r in search.hash_embedding(texts, "id", word_tokens(F.col("text")), dimension=8).collect()}
    assert {(r["key"], i): v for r in found.collect() for i, v in enumerate(r["vector"]) if v} == want


def test_packets_of_keys_stream(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        items = spark.createDataFrame([(k, i, n) for k in (1, 2, None) for i, n in enumerate([5, 5, 1, 20, None, 3])], "k long, i long, n long").repartition(4)
        found = structure.packed(items, "k", "i", "n", most=10)
        assert "FlatMapGroups" not in plan(found)
        got = {(r["k"], r["i"]): r["packet"] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(k, i): p for k in (1, 2, None) for i, p in enumerate([0, 0, 1, 2, 2, 2])}


@pytest.mark.parametrize("n, tasks", [(10, 4), (300_000_000, 300)])
def test_postings_are_dealt_by_their_number(spark, tmp_path, n, tasks):
    kept = TextIndex(spark, str(tmp_path / "index"))
    rows = spark.createDataFrame([("a", 3, [("x", 2), ("y", 1)])], "key string, dl long, counts array<struct<term:string,n:long>>")
    dealt = kept._postings(rows, n)
    assert f", {tasks})" in plan(dealt).split("Exchange")[-1].split("\n")[0] or f", {tasks}), REPARTITION" in plan(dealt)
    assert "rangepartitioning" not in plan(dealt) and dealt.count() == 2


def test_pages_are_cut_in_the_rows_of_their_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "\n".join(f"l{i}" for i in range(41))), (2, ""), (3, None), (None, "a\n\n b"), (10, "\n" * 19)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "once" / "documents.parquet"))
    docs.union(docs.where("doc_id = 1").withColumn("text", F.lit("m0\nm1"))).write.parquet(str(tmp_path / "twice" / "documents.parquet"))
    pages = {}
    for folder in ("once", "twice"):
        found = routes.chunks(Tables(spark, str(tmp_path / folder)))
        assert ("Exchange" in plan(found)) == (folder == "twice")
        pages[folder] = {r["chunk_id"]: r["text"] for r in found.collect()}
    whole = "\n".join(f"l{i}" for i in range(20))
    assert pages["once"]["c1-0"] == whole and pages["once"]["c1-2"] == "l40" and pages["twice"]["c1-0"].startswith("l0\nm0\nl1\nm1")
    assert {k: v for k, v in pages["once"].items() if k != "c1-0"} == {k: v for k, v in pages["twice"].items() if k != "c1-0"}


def test_searches_that_ask_the_same_share_their_candidates(spark, monkeypatch):
    from folioscope import catalog

    asked = []
    monkeypatch.setattr(routes, "sources", lambda t, q, made=routes.sources: asked.append(q) or made(t, q))
    assert catalog.QUERIES["search_adapters"](spark, SMALL).count() > 0 and len(asked) == 1


def test_formulas_alone_gather_no_surroundings(spark):
    tables = Tables(spark, SMALL)
    found = retrieval.formula(routes.loaded_windows(tables), routes.loaded_chunks(tables), routes.FORMULA_QUESTION, top=routes.TOP)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("array_distinct(") == 1


def test_windows_send_a_text_once(spark):
    found = retrieval.formula_windows(routes.loaded_blocks(Tables(spark, SMALL)))
    sent = next(line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Project" in line and " AS part#" in line)
    assert "plain#" not in sent.split("CASE WHEN")[0]


def test_an_index_of_pairs_is_sent_runs(spark, tmp_path, monkeypatch):
    from folioscope.operators import textindex

    texts = [*RUNS, "一二一二 一二 a一二一", "二二二二二", "a a b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    sent = []
    monkeypatch.setattr(textindex, "index_runs", lambda text, made=search.index_runs: sent.append(text) or made(text))
    kept = TextIndex(spark, str(tmp_path / "index"))
    kept.replace("load", rows, "id", "t")
    assert len(sent) == 1
    want = search.postings(rows.withColumn("id", F.col("id").cast("string")), "id", search.index_tokens(F.col("t")))
    names = ["key", "token", "dl", "tf"]
    assert sorted(map(tuple, kept.store.read("postings").select(*names).collect())) == sorted(map(tuple, want.select(*names).collect()))
    lengths = {r["key"]: r["dl"] for r in kept.store.read("lengths").collect()}
    assert lengths == {str(r["id"]): r["n"] for r in rows.select("id", F.size(search.index_tokens(F.col("t"))).alias("n")).collect()}
