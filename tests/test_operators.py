import pytest
from pyspark.sql import functions as F

from folioscope.functions.query import Question
from folioscope.operators import evaluate, graph, listing, lookup, records, search, stats, structure

CANDIDATE = "route string, item_id string, doc_id long, kind string, title string, text string, score double, target_id string, table_id string, section_path string, page_idx int"


def candidate(route, item, score, kind="content", target=None, table=None, title="t", text="text", section="body", page=3):
    return (route, item, 1, kind, title, text, score, target, table, section, page)


def test_clause_hits_lead_and_tables_meet_once(spark):
    rows = [candidate("clause", "c1", 14.0)] + [candidate("table", f"t:{i}", 0.9 - 0.01 * i, "table_text_row", table="T") for i in range(5)] + [candidate("dense", "d1", 0.5)]
    got = search.fuse(spark.createDataFrame(rows, CANDIDATE), task="table_qa", top=10).collect()
    assert got[0]["key"] == "c1" and [r["key"] for r in got].count("table:T") == 1
    assert next(r for r in got if r["key"] == "table:T")["fusion_score"] < 1.0


def test_hashed_vectors_weigh_little(spark):
    rows = [candidate("dense", "d", 0.99), candidate("sparse", "s", 0.1)]
    df = spark.createDataFrame(rows, CANDIDATE)
    assert [r["key"] for r in search.fuse(df, task="locate_figure", top=5, hashed=True).collect()] == ["s", "d"]


def test_contents_pages_are_a_last_resort(spark):
    toc, body = candidate("sparse", "a", 9.0, title="目次"), candidate("sparse", "b", 1.0)
    fuse = lambda rows, task: [r["key"] for r in search.fuse(spark.createDataFrame(rows, CANDIDATE), task=task, top=5).collect()]
    assert fuse([toc, body], "definition_qa") == ["b"]
    assert fuse([toc], "definition_qa") == ["a"]
    assert fuse([toc, body], "locate_qa") == ["a", "b"]


def test_rerank_and_sufficiency(spark):
    question = Question("斜坡堤稳定", task="definition_qa")
    rows = spark.createDataFrame([("k1", 0.5, "a", "别的", 1.0, "content"), ("k2", 0.4, "b", "论斜坡堤稳定的方法", 1.0, "content")], "key string, fusion_score double, title string, text string, normal double, kind string")
    got = search.phrase_rerank(rows, question).collect()
    assert [r["key"] for r in got] == ["k2", "k1"] and got[0]["rerank_score"] == 0.55
    enough = rows.select(search.sufficient(F.col("title"), F.col("text"), F.lit(1.0), F.col("kind"), question)).collect()
    assert [r[0] for r in enough] == [False, True]


def test_full_text_tokens(spark):
    text = spark.createDataFrame([("港口 Port12 水深图 图",)], "t string")
    assert text.select(search.index_tokens(F.col("t"))).first()[0] == ["港口", "port12", "水深", "深图", "图"]


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, []), (4, [1.0])], "id int, v array<double>")
    assert [tuple(r) for r in search.vector_top(rows, "id", "v", [1.0, 0.0], top=2).collect()] == [(1, 1.0), (2, 0.6)]
    parts = search.hash_embedding(spark.createDataFrame([(1, ["a", "b", "a"])], "id int, terms array<string>"), "id", F.col("terms")).collect()
    assert abs(sum(r["value"] ** 2 for r in parts) - 1) < 1e-12


def blocks(spark, rows):
    return spark.createDataFrame([(1, f"b{i}", i // 20, i % 20, kind, level, text) for i, (kind, level, text) in enumerate(rows)], "doc_id long, block_id string, page_idx int, reading_order int, block_type string, title_level int, text string")


def test_section_paths_and_chunks(spark):
    rows = blocks(spark, [("title", 1, "1"), ("paragraph", None, "a" * 600), ("title", 2, "1.1"), ("formula", None, "E = 1"), ("paragraph", None, "b" * 1200), ("title", 3, "1.1.1"), ("list_item", None, "x"), ("list_item", None, "y"), ("title", 1, "2"), ("table", None, "t"), ("paragraph", None, "")])
    paths = structure.section_paths(rows)
    assert [r["section_path"] for r in paths.orderBy("reading_order").collect()] == ["1", "1", "1 / 1.1", "1 / 1.1", "1 / 1.1", "1 / 1.1 / 1.1.1", "1 / 1.1 / 1.1.1", "1 / 1.1 / 1.1.1", "2", "2", "2"]
    chunks = structure.chunk_assembly(paths).orderBy("chunk_id").collect()
    assert {r["chunk_id"]: (r["chunk_type"], r["n_blocks"]) for r in chunks} == {
        "chunk-b0": ("outline_anchor", 1), "chunk-b1": ("content", 1), "chunk-b2": ("outline_anchor", 1), "chunk-b3": ("content", 2), "chunk-b5": ("outline_anchor", 1),
        "chunk-b6": ("content", 2), "chunk-b8": ("outline_anchor", 1), "chunk-b9": ("table_summary", 1),
    }


def test_page_roles(spark):
    rows = blocks(spark, [("title", 1, "某规范")] + [("paragraph", None, "x")] * 19 + [("title", 1, "目次")] + [("paragraph", None, "1 总则 …… 1")] * 19 + [("title", 1, "1 总则")] + [("paragraph", None, "y")] * 19)
    assert [r["role"] for r in structure.page_roles(rows).orderBy("page_idx").collect()] == ["cover", "toc", "body"]


def test_similar_names_equal_all_pairs(spark):
    import random

    r = random.Random(2)
    names = ["".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(120)]
    df = spark.createDataFrame([(i, "x", n) for i, n in enumerate(names)], "entity_id int, layer string, name string")
    got = {(p["first_id"], p["second_id"]) for p in graph.similar_names(df, layer="layer", least=0.75, auto=0.9).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if 1 - edits(names[i], names[j]) / max(len(names[i]), len(names[j])) >= 0.75}
    assert got == want


def test_merge_chains_reject_rings(spark):
    merges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5)], "loser int, keeper int")
    assert {tuple(r) for r in graph.final_keepers(merges).collect()} == {(1, 3), (2, 3)}


def test_steps(spark):
    steps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "gone"), ("e", None)], "step_id string, next_id string")
    assert sorted(map(tuple, graph.cycles_and_gaps(steps).collect())) == [("a", "cycle"), ("b", "cycle"), ("c", "cycle"), ("d", "dangling")]


def test_compiled_expressions(spark):
    row = spark.createDataFrame([(3.0, 4.0)], "a double, b double")
    assert row.select(lookup.compiled("sqrt(a**2 + b**2) + max(a, b) - cos(0) * log(e)", ["a", "b"])).first()[0] == pytest.approx(8.0)
    for bad in ("__import__('os')", "a.b", "open(a)", "c + 1", "'x'", "[a]", "lambda: 1"):
        with pytest.raises((ValueError, SyntaxError)):
            lookup.compiled(bad, ["a", "b"])


def test_shown_numbers(spark):
    got = spark.createDataFrame([(2.0,), (0.5,), (1 / 3,), (-7.0,)], "x double").select(lookup.shown(F.col("x"))).collect()
    assert [r[0] for r in got] == ["2", "0.5", "0.333333", "-7"]


def test_tables(spark):
    html = "<table><thead><tr><th colspan=2>A &amp; B</th><th>C</th></tr></thead><tr><td>1</td><td> x\n y </td><td/></tr></table>"
    df = spark.createDataFrame([(html,), (None,), ("no table",)], "h string")
    got = [r[0] for r in df.select(lookup.html_rows(F.col("h"))).collect()]
    assert got[0][0] == ["A & B", "A & B", "C"] and got[0][1][:2] == ["1", "x y"] and got[1] is None and got[2] is None
    text = "intro\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nnot | a table\n"
    found = spark.createDataFrame([(text,), (None,)], "t string").select(lookup.markdown_tables(F.col("t"))).collect()
    assert [(t["context"], t["rows"]) for t in found[0][0]] == [("intro", [["a", "b"], ["1", "2"]])] and found[1][0] == []


def test_conditions(spark):
    df = spark.createDataFrame([("散货船",), ("集装箱船",), ("Mud bottom",)], "c string")
    assert [r[0] for r in df.select(lookup.condition_matches(F.col("c"), "散货船类型")).collect()] == [True, False, False]


def test_upsert_and_changes(spark):
    table = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, t int")
    changes = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", 1)], "k int, v string, t int")
    assert {r["k"]: r["v"] for r in records.upsert(table, changes, ["k"], "t").collect()} == {1: "c", 2: "b", 3: "e"}
    assert {tuple(r) for r in records.changed(table, changes, "k", "v").collect()} == {(1, "changed"), (2, "changed"), (3, "added")}


def test_evaluation(spark):
    df = spark.createDataFrame([("q1", ["x", "a / b", "c"], ["b"]), ("q2", [], ["b"]), ("q3", ["a"], []), ("q4", None, ["b"])], "question_id string, paths array<string>, gold array<string>")
    got = {r["question_id"]: (r["hit_1"], r["hit_3"], r["mrr"]) for r in evaluate.scores(df).collect()}
    assert got == {"q1": (0.0, 1.0, 0.5), "q2": (0.0, 0.0, 0.0), "q4": (0.0, 0.0, 0.0)}


def test_table_kinds(spark):
    wide = [["k1", "a text that is longer than twenty characters"], ["k2", "another text of more than twenty characters"]]
    dense = [["1", "2.5"], ["3", "4%"]]
    df = spark.createDataFrame([(wide,), (dense,), ([],)], "r array<array<string>>")
    assert [r[0] for r in df.select(stats.table_kind(stats.table_features(F.col("r")))).collect()] == ["text_dense", "numeric_dense", "hybrid"]


def test_listing(spark):
    df = spark.createDataFrame([(i, "Title" if i % 2 else None, i) for i in range(10)], "id int, text string, n int")
    assert [r["id"] for r in listing.listing(df, keyword="title", order=["id"], limit=3).collect()] == [1, 3, 5]
    assert listing.listing(df, order=["id"], limit=-5).count() == 1


def test_deep_titles(spark):
    rows = blocks(spark, [("title", k, f"t{k}") for k in range(1, 10)] + [("paragraph", None, "x")])
    paths = structure.section_paths(rows).orderBy("reading_order").collect()
    assert paths[-1]["section_path"] == " / ".join(f"t{k}" for k in range(1, 10)) and paths[8]["parent_id"] == "b7"
    assert structure.section_paths(rows, levels=2).orderBy("reading_order").collect()[-1]["section_path"] == "t1 / t9"
    assert {r["block_id"]: r["parent_at"] for r in structure.parents(rows).collect()}["b8"] == "b7"
    none = blocks(spark, [("paragraph", None, "x")])
    assert structure.section_paths(none).first()["section_path"] == ""


def test_latest_states_after_a_restart_without_new_data(spark, tmp_path):
    from folioscope.streaming import events

    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "user_id long, at long, what string").coalesce(1).write.parquet(f"{tmp_path}/in/events.parquet")
    stream = lambda: spark.readStream.schema("user_id long, at long, what string").parquet(f"{tmp_path}/in/*")
    first = sorted(map(tuple, events.keep_latest(stream(), str(tmp_path), keys=["user_id"], at="at").collect()))
    again = sorted(map(tuple, events.keep_latest(stream(), str(tmp_path), keys=["user_id"], at="at").collect()))
    assert first == again == [(1, 2, "b"), (2, 1, "c")]


def test_running_sums_of_a_group_over_many_tasks(spark):
    from folioscope.operators.scans import running_before

    rows = [("hot", i, i % 7 if i % 5 else None) for i in range(500)] + [("a", 1, 5), ("a", 0, 3), (None, 2, 1), (None, 1, 4)]
    df = spark.createDataFrame(rows, "key string, n long, v long").repartition(7)
    got = {(r["key"], r["n"]): r["before"] for r in running_before(df, "key", ["n"], "v", "before").collect()}
    want = {(k, n): sum(v or 0 for j, m, v in rows if j == k and m < n) for k, n, _ in rows}
    assert got == want and running_before(df.limit(0), "key", ["n"], "v", "before").count() == 0


def test_compaction_of_one_long_conversation(spark):
    from folioscope.operators.records import compaction

    rows = [(1, i, ("tool", "user")[i % 2], "x" * (50 + i % 9)) for i in range(400)] + [(2, 0, None, None), (None, 0, "tool", "y" * 90)]
    got = {(r["conv_id"], r["turn"]): (r["compact"], r["halted"]) for r in compaction(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=6000, summary=10, stop=5000).collect()}
    want, groups = {}, {c: [r for r in rows if r[0] == c] for c in (1, 2, None)}
    for c, messages in groups.items():
        total, saved = sum(len(t or "") for *_, t in messages), 0
        for _, turn, role, text in messages:
            saving = max(len(text or "") - 10, 0) if role == "tool" else 0
            want[c, turn] = saving > 0 and total / 2 - saved / 2 > 6000
            saved += saving
        left = total - sum(max(len(t) - 10, 0) for _, turn, role, t in messages if want[c, turn])
        want |= {(c, turn): (want[c, turn], left / 2 > 5000) for _, turn, *_ in messages}
    assert got == want and sum(x for x, _ in got.values()) > 50


def test_near_names_pair_across_sides_and_names_once(spark):
    import random
    from difflib import SequenceMatcher

    from folioscope.operators import edits

    r = random.Random(5)

    def changed(name):
        chars = list(name)
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(chars))
            chars[at : at + 1] = r.choice([[], [r.choice("abcd")], [chars[at], r.choice("abcd")]])
        return "".join(chars) or "a"

    firsts = ["".join(r.choice("abcd") for _ in range(r.randint(8, 30))) for _ in range(60)]
    rows = [("x", n, True) for n in firsts] + [("x", changed(n), False) for n in firsts * 2]
    pairs = graph.near_names(spark.createDataFrame(rows, "layer string, name string, side boolean"), least=0.84).collect()
    lev = spark.createDataFrame([(a, b) for _, a, s in rows for _, b, t in rows if s and not t and a != b], "a string, b string").distinct().where("1 - levenshtein(a, b) / greatest(length(a), length(b)) >= 0.84").collect()
    assert sorted(tuple(sorted((p["long_name"], p["short_name"]))) for p in pairs) == sorted({tuple(sorted((p["a"], p["b"]))) for p in lev}) and len(pairs) > 50

    known, new = sorted(set(firsts)), sorted({n for _, n, side in rows if not side} - set(firsts))
    got = edits.reuse(spark.createDataFrame([(n,) for n in new], "name string"), spark.createDataFrame([(i, n, []) for i, n in enumerate(known)], "entity_id int, name string, aliases array<string>"), F.col("name"), F.col("name"))
    want = {n: max((SequenceMatcher(None, k, n).ratio(), -i) for i, k in enumerate(known)) for n in new}
    assert {g["name"]: g["entity_id"] for g in got.collect()} == {n: -i for n, (score, i) in want.items() if score >= 0.92}


def test_copies_of_names_are_not_compared(spark):
    rows = spark.range(4000).selectExpr("id AS entity_id", "'x' AS layer", "concat('some name ', id % 40) AS name")
    got = graph.similar_names(rows, layer="layer", least=0.9, auto=0.95)
    want = spark.sql("WITH e AS (SELECT id, concat('some name ', id % 40) AS name FROM range(4000)) SELECT count(*) FROM e a JOIN e b ON a.id < b.id WHERE 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) >= 0.9").first()[0]
    assert got.count() == want and got.select("first_id", "second_id").distinct().count() == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    compared = plan[plan.index("levenshtein") :]
    assert "entity_id" not in compared[: compared.index("Join")]


def test_cycles_take_few_rounds_and_no_broadcast(spark, monkeypatch):
    plans, keep = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    # Cycles of three with ways of two into them, ends of four steps, and one step after itself.
    rows = [(5 * i + j, 5 * i + (j + 1 if j < 4 else 2)) for i in range(200) for j in range(5)] + [(2000 + 4 * i + j, 2001 + 4 * i + j if j < 3 else 9999) for i in range(50) for j in range(4)] + [(5000, 5000)]
    got = graph.cycles_and_gaps(spark.createDataFrame(rows, "step_id long, next_id long")).collect()
    assert sorted(r["step_id"] for r in got if r["problem"] == "cycle") == sorted([5 * i + j for i in range(200) for j in (2, 3, 4)] + [5000])
    assert sorted(r["step_id"] for r in got if r["problem"] == "dangling") == [2003 + 4 * i for i in range(50)]
    assert len(plans) <= 6 and all("Broadcast" not in p for p in plans[1:])
