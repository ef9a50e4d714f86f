"""Symbols of formulas and JSON in free text."""

import json

import pytest
from pyspark.sql import functions as F

from folioscope.functions import jsontext, latex

FORMULAS = [
    (r"\pmb { Z } = H _ { \mathrm { n a r } } - D\tag{6.4.5-3}", [r"H_{\mathrm{aa v}}"], [("H", r"H _ { \mathrm { n a r } }", r"H_{\mathrm{aa v}}")]),
    ("D _ { 0 } = T + Z _ { 0 }", ["D_0", "T", "Z_0"], []),
    (r"t _ { \mathrm { s } } = K _ { \mathrm { t } } \big ( t _ { 1 } + t _ { 2 } + t _ { 3 } \big )\tag{6.2.8}", ["t_s", "K_t", "t_1", "t_2", "t_3"], []),
    ("D _ { 0 } = T + Z _ { 0 }", ["D_0", "T", "Z_0", "D", "Z_4"], []),
    (r"\sigma _ { m x B } = \frac { k _ { x } q \alpha ^ { 2 } } { \delta ^ { 2 } } \leqslant \eta _ { 3 } \alpha \lfloor \sigma \rfloor\tag{5.2.6-3}", [r"\sigma _ { m x B }", "k _ { x }", r"\eta _ { 3 }"], []),
    (r"\eta _ { 1 } + \alpha", [r"\eta _ { 2 }"], [("\\eta", r"\eta _ { 1 }", r"\eta_{ 2 }")]),
    ("Q_1 + Q_1", ["Q；"], [("Q", "Q_1", "Q")]),
    ("x_{a", ["x_b"], [("x", "x_{a", "x_b")]),
    (None, ["x"], []),
    ("", None, []),
]


def test_symbol_corrections(spark):
    rows = spark.createDataFrame([(i, f, p) for i, (f, p, _) in enumerate(FORMULAS)], "i int, f string, p array<string>")
    got = rows.withColumn("c", latex.symbol_corrections(F.col("f"), F.col("p"))).withColumn("fixed", latex.corrected(F.col("f"), F.col("c"))).orderBy("i").collect()
    assert [[tuple(c) for c in r["c"]] for r in got] == [want for *_, want in FORMULAS]
    assert got[6]["fixed"] == "Q + Q_1" and got[5]["fixed"] == r"\eta_{ 2 } + \alpha" and got[8]["fixed"] is None


def test_tokens():
    assert list(latex.tokens(r"\sqrt{a} + \mathrm{b} c_{d_{e}} Ω \beta_2 7")) == [("b", "b", "b"), ("c_{d_{e}}", "c", "cde"), ("Ω", "Ω", "Ω"), (r"\beta_2", r"\beta", r"\beta2")]
    assert list(latex.tokens("\\")) == [] and list(latex.tokens("x _ y")) == [("x _ y", "x", "xy")]


JSON = [
    ('say ```json\n{"a": 1}\n``` and more', {"a": 1}), ("```\njson {\"a\": [1, 2,],}\n```", {"a": [1, 2]}), ('x {"a": {"b": 2}} y', {"a": {"b": 2}}), ("{'a': 'it\\'s', 'b': \"q, }\"}", {"a": "it's", "b": "q, }"}),
    ("{'say': 'a \"word\"'}", {"say": 'a "word"'}), ('{"a": "x,}"  ,  }', {"a": "x,}"}), ("[1, 2]", [1, 2]), ('{"a": 1, "a": 2}', {"a": 2}), ("{broken}", None), ('{"a": 1', None), ("nothing", None), ("", None), (None, None), ("{]}", None),
]


def extract(spark, texts, **options):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", jsontext.extracted(F.col("t"), **options).alias("j")).orderBy("i").collect()
    return [None if r["j"] is None else json.loads(r["j"]) for r in got]


def test_json_in_text(spark):
    assert extract(spark, [t for t, _ in JSON]) == [want for _, want in JSON]
    assert extract(spark, [t for t, _ in JSON], strict=True) == [want if i in (0, 2, 6, 7) else None for i, (_, want) in enumerate(JSON)]


@pytest.mark.parametrize("text", ['{"a": [1, {"b": "c"}], "d": {"e": null, "f": "g\\"h"}}'])
def test_json_that_was_cut_off(spark, text):
    """Whatever is left of an object, what was whole before the cut is there."""
    got = extract(spark, [text[:i] for i in range(1, len(text) + 1)], complete=True)
    assert got[0] == {} and got[-1] == json.loads(text)
    assert sum(g is None for g in got) <= 6  # within a number's or a literal's letters
    assert all(g.get("a", [1])[0] == 1 for g in got if g and g.get("a"))
    assert [g for g in got if g and "d" in g][-2]["a"] == [1, {"b": "c"}]
