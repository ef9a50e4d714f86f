"""Rules on documents' structure, exports and searches on fixtures with nulls, ties and odd rows."""

from pyspark.sql import functions as F

from folioscope.operators import adapters, alignment, edits, structure
from folioscope.operators.retrieval import CANDIDATE
from folioscope.sources import sinks


def test_instructions(spark):
    blocks = spark.createDataFrame(
        [(1, "a", "paragraph", 0, 0, None), (1, "b", "list_item", 0, 1, None), (1, "t", "title", 0, 2, None), (1, "c", "paragraph", 1, 0, None), (1, "x", "table", 1, 1, 3), (1, "y", "table", 2, 0, 3), (1, "z", "table", 2, 1, 4), (1, "n", None, None, None, None), (2, "d", "paragraph", 0, 0, None)],
        "doc_id long, block_id string, block_type string, page_idx int, block_seq int, columns int",
    )
    rows = [("contd", "a", "b"), ("contd", "a", "c"), ("contd", "b", "a"), ("contd", "a", "a"), ("contd", "a", "t"), ("contd", "a", "n"), ("contd", "a", "d"), ("contd", "a", "gone"), ("table_merge", "x", "y"), ("table_merge", "x", "z"), ("table_merge", "a", "x"), (None, "a", "b"), ("contd", None, "b")]
    got = edits.checked_instructions(blocks, spark.createDataFrame(rows, "kind string, source_uid string, target_uid string")).collect()
    want = [None, "title between", "not later", "not later", "types", "types", "missing", "missing", None, "columns", "types", "unknown kind", "missing"]
    assert {(r["kind"], r["source_uid"], r["target_uid"]): (r["accepted"], r["reason"]) for r in got} == {k: (w is None, w) for k, w in zip(rows, want, strict=True)}


def contents(spark, pages):
    rows = [(1, f"{p}:{i}", kind, p, text) for p, blocks in pages.items() for i, (kind, text) in enumerate(blocks)]
    df = spark.createDataFrame(rows, "doc_id long, block_id string, block_type string, page_idx int, text string")
    return sorted(r["block_id"] for r in structure.contents_rows(df).collect())


def test_contents_rows(spark):
    entry, prose = ("paragraph", "1.2 General 7"), ("paragraph", "some prose")
    pages = {0: [entry, entry], 1: [("title", "目 录"), prose, ("image", "x"), ("paragraph", None)], 2: [entry, entry, prose], 3: [("paragraph", "3 A 1\n4 B 2"), prose], 4: [prose, prose], 5: [entry, entry], 6: [("list", "目次")]}
    assert contents(spark, pages) == ["1:0", "1:1", "2:0", "2:1", "2:2", "3:0", "3:1", "6:0"]
    assert contents(spark, {0: [entry, entry]}) == [] == contents(spark, {})
    assert contents(spark, {0: [("header", "目录"), entry], 1: [entry], 2: [entry]}) == ["0:1"]  # one entry of one block is too few


def test_entries(spark):
    texts = ["目录", "1.2 x 7", "附录A 表（12）", "……......12", "abcdef…12", "7", "x 12345x", None, "", "条文说明 99", "prose 12"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(structure.contents_entry(F.col("t"))).collect()] == [True, True, True, True, True, True, False, False, False, True, False]


def test_related_blocks(spark):
    blocks = [(1, 0, "a", "paragraph", "图 1 布置"), (1, 0, "b", "title", "图 1 布置"), (1, 0, "c", "paragraph", "1.2 图1布置"), (1, 0, "d", "Table", "图1布置"), (1, 0, "e", "paragraph", "see 图1布置图 here"), (1, 0, "f", "paragraph", "单位为毫米和厘米以及米"), (1, 1, "g", "paragraph", "图1布置"), (1, 0, "h", "paragraph", None), (1, 0, "i", None, "图1")]
    media = [(1, 0, "m", ["图1 布置图", "x", None], ["注：单位为毫米和厘米以及米。"]), (1, 0, "n", None, []), (1, 0, "a", ["图1布置图"], None)]
    df = spark.createDataFrame(blocks, "doc_id long, page_idx int, block_id string, block_type string, text string")
    got = alignment.related_blocks(df, spark.createDataFrame(media, "doc_id long, page_idx int, block_id string, captions array<string>, footnotes array<string>"))
    assert sorted(map(tuple, got.collect())) == [("a", "caption", "e"), ("a", "caption", "i"), ("m", "caption", "a"), ("m", "caption", "e"), ("m", "caption", "i"), ("m", "footnote", "f")]


def test_export_follows_entities(spark, tmp_path):
    table = spark.createDataFrame
    tables = {
        "relations": table([("d1", "e1", "e2"), ("d2", "e3", "e4"), ("d1", None, "e1")], "doc_id string, source_id string, target_id string"),
        "notes": table([("n1", "d1"), ("n2", "d2")], "note_id string, doc_id string"),
        "note_entities": table([("n1", "e5"), ("n2", "e6"), ("n1", "e1")], "note_id string, entity_id string"),
        "entities": table([(f"e{i}", f"name {i}") for i in range(1, 8)], "entity_id string, name string"),
    }
    sinks.export_documents(tables, table([("d1",), ("d1",), ("gone",)], "doc_id string"), "doc_id", str(tmp_path), relations="relations", entities="entities", bridges={"note_entities": "notes"})
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    assert sorted(r["entity_id"] for r in read("entities").collect()) == ["e1", "e2", "e5"] and read("relations").count() == 2 and read("notes").count() == 1 and read("note_entities").count() == 2


def candidates(spark, rows):
    full = [(route, item, 1, kind, "title", text, score, None, None, None, 1) for route, item, kind, text, score in rows]
    return spark.createDataFrame(full, "route string, item_id string, doc_id long, kind string, title string, text string, score double, target_id string, table_id string, section_path string, page_idx long").select(*CANDIDATE)


def test_searches_have_one_signature(spark):
    routes = {"dense": candidates(spark, [("dense", "d1", "content", "the cat", 0.9), ("dense", "d2", "content", "a dog", 0.5)]), "table": candidates(spark, [("table", "t1", "table_row_key", "x | y", 4.0)]), "formula": candidates(spark, [("formula", "f1", "formula", "a = b", 3.0)])}
    entities = spark.createDataFrame([("e1", "Cat", ["feline"], 7), ("e2", "Dog", None, 8)], "entity_id string, name string, aliases array<string>, doc_id long")
    tools = adapters.Searches(lambda q: routes, entities).tools()
    found = {name: [(r["mark"], r["item_id"]) for r in search("feline", top=5).orderBy("mark").collect()] for name, search in tools.items()}
    assert found == {"knowledge_search": [("K1", "d1"), ("K2", "d2")], "table_search": [("T1", "t1"), ("T2", "f1")], "entity_search": [("E1", "e1")]}
    assert [(r["mark"], r["item_id"]) for r in tools["entity_search"]("nobody").orderBy("mark").collect()] == [("E1", "d1"), ("E2", "d2")]
    assert all(search(" ").count() == 0 for search in tools.values())
    assert len({tuple(search("cat").columns) for search in tools.values()}) == 1
