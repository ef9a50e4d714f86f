import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from folioscope.operators import alignment, lookup, tables


def first(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` string" for k in values)).select(column).first()[0]


def test_headers_of_one_and_two_rows(spark):
    two = "<p>表 1</p><table><tr><td rowspan=2>a</td><td>x</td><td>y</td></tr><tr><td>b</td><td>c</td><td>d</td></tr><tr><td colspan=2>1</td><td>2</td></tr></table>"
    got = first(spark, tables.lookup_tables(F.col("h")), h=two)
    assert (got["context"], got["headers"], got["rows"]) == ("表 1", ["a", "b", "c", "d"], [["1", "2"]])
    one = first(spark, tables.lookup_tables(F.col("h")), h="before\n<table><tr><td>a</td></tr><tr><td>1</td></tr></table><table><tr><td>z</td></tr></table>")
    assert (one["context"], one["headers"], one["rows"]) == ("before", ["a"], [["1"]])
    assert first(spark, tables.lookup_tables(F.col("h")), h="")["headers"] is None
    assert first(spark, tables.lookup_tables(F.col("h")), h="no table")["rows"] == []


def test_joining(spark):
    head, tail = "<table><tr><th>A b</th></tr><tr><td>1</td></tr></table> end", "<table><tr><td>Ab</td></tr><tr><td>2</td></tr></table>"
    assert first(spark, tables.joined_html(F.col("a"), F.col("b")), a=head, b=tail) == "<table><tr><th>A b</th></tr><tr><td>1</td></tr><tr><td>2</td></tr></table> end"
    assert first(spark, tables.joined_html(F.col("a"), F.col("b")), a=head, b="") == head
    assert first(spark, tables.joined_html(F.col("a"), F.col("b")), a="", b=tail) == tail


def test_references(spark):
    score = lambda asked, context: first(spark, tables.reference_score(asked, F.col("c")), c=context)
    assert [score("表A.0.2-7", c) for c in ("见表 A.0.2-7", "表A.0.2-71", "其他")] == [300, 220, 0]
    assert [score("表A.0.2-1~表A.0.2-14", c) for c in ("表A.0.2-14 续", "表A.0.2-15")] == [280, 0]
    assert tables.reference_range("表A-3~表A-2") is None


def test_fit_and_choice(spark):
    fit = lambda cells, v: spark.range(1).select(tables.numeric_fit(F.array(*map(F.lit, cells)).cast("array<string>"), F.lit(v))).first()[0]
    assert [fit(["1~10", "x"], 5.0), fit(["10"], 10.5), fit(["10"], 900.0), fit(["10"], 9000.0), fit(["10"], 90000.0), fit(["x"], 5.0)] == [60, 50, 35, 20, 5, 0]
    rows = spark.createDataFrame([("t1", "表 3 深度", ["名称", "深度"]), ("t2", "表 4", ["吨级"]), ("t3", "表 3", ["名称"])], "table_id string, context string, headers array<string>")
    assert tables.chosen_table(rows, "表3", {"深度": "5"}).first()["table_id"] == "t1"


def test_rows_by_words_and_numbers(spark):
    rows = spark.createDataFrame([(0, ["散货船", "1000~5000", "a"]), (1, ["散货船", "6000", "b"]), (2, ["油船", "5500", "c"])], "row_index int, cells array<string>")
    heads = ["船型", "吨级", "值"]
    pick = lambda **c: tables.looked_up(rows, heads, c, "值").first()
    assert (pick(船型="干散货船", 吨级="5400")["value"], pick(船型="干散货船", 吨级="4000")["value"], pick(吨级="5400")["value"]) == ("a", "a", "c")
    assert pick(船型="没有这种", 吨级="5600")["value"] == "c"


def test_conditions_equal_plain_python(spark):
    def variants(text):
        base = "".join(text.split()).lower()
        out = {base, base.translate(str.maketrans("", "", "或和及的"))}
        return {x for x in out | {base.replace(s, "") for s in lookup.SUFFIXES if s in base} if x}

    def fits(cell, wanted):
        return any(a in b or b in a or (min(len(a), len(b)) >= 3 and SequenceMatcher(None, a, b).ratio() >= 0.62) for a in variants(wanted) for b in variants(cell))

    r = random.Random(3)
    cells = ["".join(r.choice("红色环形 设计值和abc") for _ in range(r.randint(1, 9))) for _ in range(200)]
    got = spark.createDataFrame([(c,) for c in cells], "c string").select("c", lookup.condition_matches(F.col("c"), "红色环形值").alias("fits")).collect()
    assert [r["fits"] for r in got] == [fits(r["c"], "红色环形值") for r in got]
    assert {r["fits"] for r in got} == {True, False}


def test_layout_candidates_are_used_once(spark):
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "alpha beta", "alpha beta gamma", "alpha beta gamma delta"]
    own = [(d, 0, f"b{d}-{i}", i, r.choice(["text", "title"]), r.choice(words)) for d in range(12) for i in range(6)]
    found = [(d, 0, f"c{d}-{i}", r.choice(["text", "title"]), r.choice(words)) for d in range(12) for i in range(6)]

    def score(a, b, kind, other):
        a, b = a.replace(" ", ""), b.replace(" ", "")
        s = 1.0 if a == b else 0.72 + 0.24 * min(len(a), len(b)) / max(len(a), len(b)) if a in b or b in a else 0.0
        return round(s + 0.04 * (kind == other), 6)

    want = {}
    for d in range(12):
        used = set()
        for _, _, block, _, kind, text in (x for x in own if x[0] == d):
            best = sorted((-score(text, t, kind, k), c) for dd, _, c, k, t in found if dd == d and c not in used and score(text, t, kind, k) >= 0.74)
            if best:
                used.add(best[0][1])
                want[block] = best[0][1]
    blocks = spark.createDataFrame(own, "doc_id int, page_idx int, block_id string, reading_order int, block_type string, text string")
    candidates = spark.createDataFrame(found, "doc_id int, page_idx int, candidate_id string, block_type string, text string")
    assert {x["block_id"]: x["candidate_id"] for x in alignment.resolved_boxes(blocks, candidates).collect()} == want


def test_captions_in_order(spark):
    media = spark.createDataFrame([(1, 0, 0.5, "m2"), (1, 0, 0.1, "m1"), (1, 1, 0.2, "m3")], "doc_id int, page_idx int, y0 double, id string")
    captions = spark.createDataFrame([(1, 0, 0.3, "c1"), (1, 0, 0.7, "c2")], "doc_id int, page_idx int, y0 double, id string")
    assert sorted((r["media_id"], r["caption_id"]) for r in tables.caption_order(media, captions).collect()) == [("m1", "c1"), ("m2", "c2")]
