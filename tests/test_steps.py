import pytest
from pyspark.sql import functions as F

from folioscope.operators import edits, graph, lookup, retrieval, steps
from folioscope.functions.query import Question


def test_registry():
    tools = steps.Registry()
    tools.add("one")(lambda inputs: {})
    assert "one" in tools and tools.names() == ["one"]
    with pytest.raises(ValueError):
        tools.add("one")(lambda inputs: {})
    with pytest.raises(KeyError):
        tools["two"]


def test_constants_and_choice():
    assert [steps.constant(x) for x in ("0.15", "-1", " True ", "x")] == [0.15, -1, True, None]
    results = {"design_draft": "a", "error": "b"}
    assert steps.selected("T", results, {}) == "a" and steps.selected("other", results, {}) == "a"
    assert steps.selected("z1", {"x": 1, "y": 2}, {}) is None and steps.selected("x", {"x": 1, "y": 2}, {}) == 1


def test_outputs_that_are_there_stay(spark):
    rows = spark.createDataFrame([(1, 2.0, None, "nan"), (2, 3.0, 7.0, "ok")], "id int, a double, b double, c string")
    out = steps.run(rows, [steps.Step("s", "calculator", {"expression": "a * k", "a": "${a}", "k": 10}, {"b": "result"}), steps.Step("t", "no tool", {}, {"c": "result"})]).orderBy("id").collect()
    assert [(r["b"], r["c"], len(r["problems"])) for r in out] == [(20.0, "nan", 1), (7.0, "ok", 1)]


def test_solving(spark):
    rows = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    assert rows.select(lookup.solved("a * x - b", "x", ["a", "b"])).first()[0] == 1.5
    assert rows.select(lookup.solved("a - b", "x", ["a", "b"])).first()[0] is None
    assert rows.select(lookup.solved("x * x - b", "x", ["a", "b"])).first()[0] is None
    assert lookup.calculated(rows, {"c": "a + b", "d": "c * 2"}).first()["d"] == 10.0


def test_rings_of_nodes_end(spark):
    nodes = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("x", "y", "X"), ("y", "x", "Y")], "node_id string, parent_id string, title string")
    assert {r["node_id"]: r["depth"] for r in graph.subtree(nodes, "a").collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r["node_id"] for r in graph.subtree(nodes, "x").collect()} == {"x", "y"}
    assert {r["node_id"]: r["path"] for r in graph.tree_paths(nodes).collect()} == {"a": "A", "b": "A / B", "c": "A / B / C"}


def test_deep_trees(spark):
    n = 40
    nodes = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None, "t") for i in range(n)], "node_id string, parent_id string, title string")
    assert graph.subtree(nodes, "n0").count() == n
    blocks = spark.createDataFrame([(f"b{i}", f"b{i - 1}" if i else None) for i in range(n)], "block_id string, parent_id string")
    left = {r["block_id"]: r["parent_id"] for r in edits.deleted(blocks, blocks.where("block_id NOT IN ('b0', 'b39')")).collect()}
    assert left == {"b0": None, "b39": "b0"}


def test_moves(spark):
    nodes = spark.createDataFrame([("a", "p", 0), ("b", "p", 1), ("c", "p", 2), ("d", "q", 0), ("e", "r", 5)], "node_id string, parent_id string, sort_order int")
    got = {r["node_id"]: (r["parent_id"], r["sort_order"]) for r in graph.moved(nodes, spark.createDataFrame([("a", "q")], "node_id string, parent_id string")).collect()}
    assert got == {"a": ("q", 1), "b": ("p", 0), "c": ("p", 1), "d": ("q", 0), "e": ("r", 5)}


def test_fallback_and_marks(spark):
    some, none = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([], "x int")
    assert retrieval.or_else(some, spark.createDataFrame([(2,)], "x int")).collect() == [(1,)]
    assert retrieval.or_else(none, spark.createDataFrame([(2,)], "x int")).collect() == [(2,)]
    items = spark.createDataFrame([(1, "t", "斜坡堤稳定"), (2, "t", "别的")], "id int, title string, text string")
    assert [r["id"] for r in retrieval.citations(items, Question("斜坡堤稳定"), [F.col("id")]).collect()] == [1]
    assert [r["id"] for r in retrieval.citations(items, Question("没有的词语"), [F.col("id")]).collect()] == [1, 2]
    assert [r["mark"] for r in retrieval.numbered_marks(items, "T", [F.col("id")]).collect()] == ["T1", "T2"]
    titled = retrieval.titled(items.withColumn("doc_id", F.col("id")), spark.createDataFrame([(1, "规范")], "doc_id int, doc_title string")).orderBy("id").collect()
    assert [r["text"] for r in titled] == ["《规范》 斜坡堤稳定", "别的"]


def test_similar_names_are_reused(spark):
    names = spark.createDataFrame([("abcdefghijklmnop",), ("abcdefghijklmnoq x",), ("zzz",)], "name string")
    entities = spark.createDataFrame([(1, "abcdefghijklmnopq", []), (2, "other", ["zzz"])], "entity_id int, name string, aliases array<string>")
    got = {r["name"]: (r["entity_id"], r["method"]) for r in edits.reuse(names, entities, F.col("name"), F.col("name")).collect()}
    assert got == {"abcdefghijklmnop": (1, "similar"), "zzz": (2, "alias")}
