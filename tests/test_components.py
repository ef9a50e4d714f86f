"""Connected components, merges by name and the vector index against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import components as module
from folioscope.operators import graph
from folioscope.operators.components import components, merge_pairs, merged_by_name
from folioscope.operators.vectorindex import VectorIndex, as_units, recall


def plain(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def found(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    return {r["id"]: r["component"] for r in components(df, "a", "b").collect()}


@pytest.mark.parametrize(
    "pairs",
    [
        [(i, (i + 1) % 40) for i in range(40)],  # a ring
        [(0, i) for i in range(1, 200)] + [(300, i) for i in range(301, 400)],  # stars
        [(5, 5)] + [(i, i + 1) for i in range(0, 20, 2)] * 2,  # single pairs, repeated
        [(random.Random(1).randrange(300), random.Random(i).randrange(300)) for i in range(200)],
    ],
)
def test_shapes(spark, pairs):
    assert found(spark, pairs) == plain([p for p in pairs if p[0] != p[1]])


def test_long_path_in_logarithmic_rounds(spark, monkeypatch):
    ids = list(range(3000))
    random.Random(2).shuffle(ids)
    rounds = []
    monkeypatch.setattr(module, "written", lambda df, real=module.written: rounds.append(1) or real(df))
    assert set(found(spark, list(zip(ids, ids[1:], strict=False))).values()) == {0}
    assert len(rounds) <= 2 + 2 * 40  # two written tables a round; a round keeps fewer than 3/4 of the ids


def test_nulls_and_empty_tables(spark):
    assert found(spark, [(None, 1), (2, None), (3, 3)]) == {} == found(spark, [])
    names = spark.createDataFrame([("b", "a"), ("c", "b"), (None, "a")], "a string, b string")
    assert {r["id"]: r["component"] for r in components(names, "a", "b").collect()} == {"a": "a", "b": "a", "c": "a"}


def test_entities_of_one_name_are_tied_once_each(spark):
    rows = [(i, "x", "concrete", []) for i in range(50)] + [(50, "x", "concretes", ["c"]), (51, "y", "concrete", []), (52, "x", "steel", []), (53, "x", " ", []), (54, "x", None, [])]
    entities = spark.createDataFrame(rows, "entity_id long, layer string, name string, aliases array<string>")
    assert merge_pairs(entities, layer="layer", least=0.85).count() == 50
    edges = spark.createDataFrame([(7, 52), (7, 9), (51, 50), (52, 52)], "source_id long, target_id long")
    kept, redirected = merged_by_name(entities, edges, layer="layer", least=0.85)
    assert sorted(r["entity_id"] for r in kept.collect()) == [0, 51, 52, 53, 54]
    assert kept.where("entity_id = 0").first()["aliases"] == ["c", "concretes"]
    assert sorted(map(tuple, redirected.select("source_id", "target_id").collect())) == [(0, 52), (51, 0)]


# ---------------------------------------------------------------- trees


def tree(spark, rows):
    return spark.createDataFrame(rows, "node_id string, parent_id string, title string")


def test_deep_trees_in_logarithmic_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "written", lambda df, real=graph.written: rounds.append(1) or real(df))
    chain = tree(spark, [(f"n{i}", f"n{i - 1}" if i else None, f"t{i}") for i in range(300)] + [("x", None, "x")])
    assert {r["node_id"]: r["depth"] for r in graph.subtree(chain, "n100").collect()} == {f"n{i}": i - 100 for i in range(100, 300)}
    assert len(rounds) <= 11
    paths = {r["node_id"]: r["path"] for r in graph.tree_paths(chain).collect()}
    assert paths["n250"] == " / ".join(f"t{i}" for i in range(251)) and paths["x"] == "x" and len(paths) == 301
    assert len(rounds) <= 22


def test_odd_trees(spark):
    rows = [("a", None, "A"), ("b", "a", None), ("c", "b", "C"), ("d", "gone", "D"), ("e", "d", "E"), ("r1", "r2", "R1"), ("r2", "r1", "R2"), ("s", "r1", "S"), ("c", "b", "C"), (None, "a", "N")]
    assert {r["node_id"]: r["path"] for r in graph.tree_paths(tree(spark, rows)).collect()} == {"a": "A", "b": "A", "c": "A / C"}
    depths = lambda root: {r["node_id"]: r["depth"] for r in graph.subtree(tree(spark, rows), root).collect()}
    assert depths("a") == {"a": 0, "b": 1, "c": 2} and depths("r1") == {"r1": 0, "r2": 1, "s": 1} and depths("d") == {"d": 0, "e": 1} and depths("nothing") == {}
    assert graph.subtree(tree(spark, []), "a").count() == 0 == graph.tree_paths(tree(spark, [])).count()


# ---------------------------------------------------------------- vectors


def vectors(n=3000, size=32, seed=3):
    r = np.random.default_rng(seed)
    heart = r.normal(size=(30, size))
    return heart[r.integers(30, size=n)] + 0.7 * r.normal(size=(n, size))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    x = vectors()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    out = VectorIndex(spark, str(tmp_path_factory.mktemp("vectors")))
    out.fit(df, "id", "v", cells=30)
    out.replace("load", df, "id", "v")
    return out, x


def exact(x, q, top):
    s = np.maximum(as_units(x) @ as_units(q), 0)
    order = sorted(range(len(x)), key=lambda i: (-round(s[i], 12), str(i)))[:top]
    return [(str(i), round(float(s[i]), 9)) for i in order]


def test_all_cells_are_an_exact_scan(index):
    kept, x = index
    for q in (x[0], vectors(1, seed=9)[0]):
        assert [(r["key"], round(r["score"], 9)) for r in kept.search(q.tolist(), top=10, probes=None).collect()] == exact(x, q, 10)


def test_recall(spark, index):
    kept, x = index
    asked = spark.createDataFrame([(str(i), (x[i] + 0.1).tolist()) for i in range(0, 3000, 50)], "query_id string, vector array<double>")
    assert recall(kept, asked, top=10) >= 0.9
    one = kept.search_all(asked.where("query_id = '50'"), top=10).orderBy(F.desc("score"), "key").collect()
    alone = kept.search((x[50] + 0.1).tolist(), top=10).collect()
    assert [(r["key"], round(r["score"], 9)) for r in one] == [(r["key"], round(r["score"], 9)) for r in alone]
    every = kept.search_all(asked, top=5, probes=None).where("query_id = '100'").orderBy(F.desc("score"), "key").collect()
    assert [(r["key"], round(r["score"], 9)) for r in every] == exact(x, x[100] + 0.1, 5)


def test_a_question_reads_the_cells_next_to_it(index):
    kept, x = index
    plan = kept.search(x[0].tolist(), top=5, probes=3)._jdf.queryExecution().executedPlan().toString()
    assert "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_replaced_and_odd_vectors(spark, tmp_path):
    x = vectors(400, 8)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, []), (402, [0.0] * 8), (403, [1.0]), (None, [1.0] * 8), (404, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    kept = VectorIndex(spark, str(tmp_path / "v"))
    assert not kept.replace("too early", df, "id", "v") and kept.search([1.0] * 8, top=3).count() == 0
    kept.fit(df, "id", "v")
    assert kept.replace("load", df, "id", "v")
    assert kept.store.read("vectors").count() == 400
    new = spark.createDataFrame([(3, [1.0] * 8), (500, [0.9] * 7 + [0.5])], "id long, v array<float>")
    assert kept.replace("change", new, "id", "v", removed=spark.createDataFrame([(4,)], "id long")) and not kept.replace("change", new, "id", "v")
    got = kept.search([1.0] * 8, top=400, probes=None)
    assert [r["key"] for r in got.limit(2).collect()] == ["3", "500"] and got.count() == 400 and got.where(F.col("key") == "4").count() == 0
    assert kept.search([1.0] * 3, top=3).count() == 0


def test_contradiction_groups_count_what_pairs_list(spark):
    r = random.Random(5)
    rows = [(f"r{i}", r.randrange(3), r.randrange(2), r.choice(["a", "b", None]), r.choice(["d1", "d2", "d3", None])) for i in range(120)]
    relations = spark.createDataFrame(rows, "relation_id string, source_id long, target_id long, relation_type string, doc_id string")
    listed = graph.contradictions(relations).groupBy("source_id", "target_id").count().collect()
    counted = graph.contradiction_groups(relations).collect()
    assert {(r["source_id"], r["target_id"]): r["n_pairs"] for r in counted} == {(r["source_id"], r["target_id"]): r["count"] for r in listed}
    assert all(sum(t["n"] for t in r["types"]) == r["relations"] for r in counted)
    assert graph.contradiction_groups(relations.limit(0)).count() == 0


def test_vectors_without_groups_are_found_too(spark, tmp_path):
    from folioscope.operators.vectorindex import PROBES

    x = np.random.default_rng(4).normal(size=(3000, 32))
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, v array<double>")
    kept = VectorIndex(spark, str(tmp_path / "flat"))
    kept.fit(df, "id", "v")
    kept.replace("load", df, "id", "v")
    asked = df.where("id % 50 = 0").selectExpr("string(id) AS query_id", "v AS vector")
    assert recall(kept, asked, top=10) >= 0.9 > recall(kept, asked, top=10, probes=PROBES)
    assert VectorIndex(spark, str(tmp_path / "flat")).model.probes == kept.model.probes > PROBES


def test_contradiction_groups_deal_relations_by_their_number(spark):
    rows = [(s, t, f"t{(s + i) % 3}", f"d{i % 4}") for s in range(10) for t in range(3) for i in range(7)] + [(0, 0, None, "d0"), (0, 0, "t0", None), (None, 1, "t0", "d0"), (None, 1, "t1", "d1")]
    relations = spark.createDataFrame(rows, "source_id long, target_id long, relation_type string, doc_id string")
    found = graph.contradiction_groups(relations, task_rows=20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [line.split("hashpartitioning")[1] for line in plan.split("\n") if "Exchange" in line]
    assert dealt and all(", 11)" in line for line in dealt)  # of 210 relations without nulls, whatever the session's number of partitions
    assert found.where("source_id IS NULL").isEmpty()
    assert sorted(found.collect(), key=str) == sorted(graph.contradiction_groups(relations).collect(), key=str)


def test_many_questions_make_no_rows_of_pairs(spark, index, monkeypatch):
    from folioscope.operators import vectorindex

    kept, x = index
    asked = spark.createDataFrame([(str(i), (x[i] + 0.1).tolist()) for i in range(0, 3000, 50)], "query_id string, vector array<double>")
    for probes in (None, 5):
        usual = kept.search_all(asked, top=10, probes=probes)
        plan = usual._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "FlatMapCoGroups" in plan  # vectors and questions meet in blocks, not row by row
        told = sorted(map(tuple, usual.collect()))
        with monkeypatch.context() as small:
            for name, value in {"BLOCK_VECTORS": 301, "BLOCK_QUERIES": 7, "TILE": 900, "WAITING": 50}.items():
                small.setattr(vectorindex, name, value)
            assert sorted(map(tuple, kept.search_all(asked, top=10, probes=probes).collect())) == told  # to the last digit
        for i in (0, 1500):
            alone = kept.search((x[i] + 0.1).tolist(), top=10, probes=probes).collect()
            assert [(k, round(s, 9)) for q, k, s in sorted(told, key=lambda r: (-r[2], r[1])) if q == str(i)] == [(r["key"], round(r["score"], 9)) for r in alone]


def test_blocks_with_copies_and_odd_questions(spark, tmp_path):
    x = vectors(90, 8)
    x[30:60] = x[0]  # copies, of which the first by key are the nearest
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    kept = VectorIndex(spark, str(tmp_path / "v"))
    kept.fit(df, "id", "v")
    kept.replace("load", df, "id", "v")
    odd = [("same", x[0].tolist()), ("away", (-x[0]).tolist()), ("zero", [0.0] * 8), ("nan", [float("nan")] * 8), ("null", [1.0] * 7 + [None]), ("short", [1.0]), ("none", None)]
    asked = spark.createDataFrame(odd, "query_id string, vector array<double>")
    got = {}
    for r in kept.search_all(asked, top=12, probes=None).orderBy(F.desc("score"), "key").collect():
        got.setdefault(r["query_id"], []).append((r["key"], round(r["score"], 9)))
    assert got == {name: exact(x, np.array(v), 12) for name, v in odd[:3]}
    found = kept.search_all(asked.where("query_id = 'same'"), top=12).orderBy(F.desc("score"), "key").collect()
    assert [(r["key"], round(r["score"], 9)) for r in found] == got["same"]
    assert kept.search_all(asked.limit(0), top=3).isEmpty()
