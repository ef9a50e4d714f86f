"""Dictionaries and the rules that read questions."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions.automaton import Dictionary
from folioscope.functions.intents import classified
from folioscope.functions.terms import found_terms


def found(spark, terms, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r["names"] for r in df.select("i", Dictionary(spark, terms).found(F.col("text")).alias("names")).orderBy("i").collect()]


def test_equals_one_contains_a_term(spark):
    r = random.Random(4)
    terms = {"".join(r.choices("abc梁", k=r.randrange(1, 5))): f"n{r.randrange(30)}" for _ in range(200)}
    texts = ["".join(r.choices("abc梁d ", k=r.randrange(0, 80))) for _ in range(100)] + [None, ""]
    got = found(spark, terms, texts)
    order = list(dict.fromkeys(terms.values()))
    assert got == [[n for n in order if any(v == n and k in (t or "") for k, v in terms.items())] for t in texts]
    df = spark.createDataFrame([(t,) for t in texts[:20]], "text string")
    few = dict(list(terms.items())[:40])
    rows = df.select(Dictionary(spark, few).found(F.col("text")).alias("a"), F.array_distinct(found_terms(F.col("text"), few)).alias("b")).collect()
    assert all(sorted(x["a"]) == sorted(x["b"]) for x in rows)


def test_overlaps_case_and_odd_dictionaries(spark):
    assert found(spark, ["he", "she", "hers", "He"], ["ushers", "He"]) == [["he", "she", "hers"], ["He"]]
    assert found(spark, [], ["x", None]) == [[], []] == found(spark, [""], ["x", ""])
    with pytest.raises(ValueError, match="bytes"):
        Dictionary(spark, [str(i) for i in range(1000)], most_bytes=1000)


QUESTIONS = {
    None: None, "": None, "你好": "casual_chat", "hello!": "casual_chat", "你是谁": "casual_chat", "帮我计算": "standard_calculation", "你好，什么是港口": "concept_resolution", "this is a long english sentence": None,
    "按 JTS 165-2025 计算 5m 与 3m (A) 1 (B) 2": "clause_then_calculation", "JGJ 162 讲了什么": "standard_lookup", "计算水深 3.5m （A）": "standard_calculation", "H=3.5，L＝20 求解": "standard_calculation", "计算 3m 和 4m": "standard_calculation",
    "第6.4.5条 的规定": "clause_application", "6.4.5条有要求吗": "clause_application", "航标位于何处": "locate_navigation", "简述码头组成": "concept_resolution", "简述 4m 的计算": "standard_calculation", "验算": "standard_calculation",
    "先做比选然后定": "complex_task", "比选一下": None, "可行性研究" + "甲" * 30: "complex_task", "限值呢": "clause_application", "第3.2.1节": None, "风景": None,
}


def test_questions(spark):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(QUESTIONS)], "i int, q string")
    got = [r["c"] for r in df.select("i", classified(spark, F.col("q")).alias("c")).orderBy("i").collect()]
    assert [c["kind"] if c else None for c in got] == list(QUESTIONS.values())
    by = dict(zip(QUESTIONS, got, strict=True))
    assert by["H=3.5，L＝20 求解"]["parameters"] == {"H": 3.5, "L": 20.0} and by["第6.4.5条 的规定"]["clause_id"] == by["6.4.5条有要求吗"]["clause_id"] == "6.4.5"
    assert by["JGJ 162 讲了什么"]["standard"] == "JGJ 162" and by["计算 3m 和 4m"]["measures"] == 2
    assert by["你好"]["capabilities"] == [] and by["先做比选然后定"]["plan"] == ["dynamic_orchestration"] and by["限值呢"]["level"] == "L2"
    assert by["按 JTS 165-2025 计算 5m 与 3m (A) 1 (B) 2"]["plan"] == ["structured_lookup", "standard_sop", "dynamic_orchestration"]


def test_a_parameter_that_comes_twice(spark):
    df = spark.createDataFrame([("H=1 H=2 K=1.2.3 计算",)], "q string").select(classified(spark, F.col("q"))["parameters"].alias("p"))
    assert df.first()["p"] == {"H": 2.0, "K": None}
