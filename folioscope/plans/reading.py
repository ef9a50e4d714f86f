"""What is read out of texts by scanners: dictionary terms, kinds of questions, symbols of formulas, JSON; and equations solved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import intents, jsontext, latex
from folioscope.functions.automaton import Dictionary
from folioscope.operators import lookup
from folioscope.plans.registry import Tables, query


def _quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


@query(
    "dictionary_tags",
    """WITH terms AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS term FROM benchmark)
       SELECT doc_id, count(term) AS n, md5(coalesce(string_agg(term, ',' ORDER BY term), '')) AS names FROM documents LEFT JOIN terms ON contains(text, term) GROUP BY doc_id""",
)
def dictionary_tags(t: Tables) -> DataFrame:
    """All documents tagged with the words of the benchmark, a small table, in one pass over each text."""
    words = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("w")).distinct().orderBy("w").collect()
    found = t.documents.select("doc_id", Dictionary(t.spark, [r["w"] for r in words]).found(F.col("text")).alias("names"))
    return found.select("doc_id", F.size("names").cast("long").alias("n"), F.md5(F.array_join("names", ",")).alias("names"))


#: Questions and the kinds that they have.
QUESTIONS = [
    ("你好", "casual_chat"), ("你是谁", "casual_chat"), ("什么是港口", "concept_resolution"), ("按 JTS 165-2025 计算 5m 与 3m (A) 1 (B) 2", "clause_then_calculation"), ("JGJ 162 讲了什么", "standard_lookup"),
    ("H=3.5，L＝20 求解", "standard_calculation"), ("第6.4.5条 的规定", "clause_application"), ("航标位于何处", "locate_navigation"), ("验算", "standard_calculation"), ("先做比选然后定", "complex_task"), ("限值呢", "clause_application"),
    ("风景", None), ("", None),
]


@query(
    "intent_classes",
    f"""WITH kinds AS (SELECT unnest([{", ".join(_quoted(k) for _, k in QUESTIONS)}]) AS kind, unnest(range({len(QUESTIONS)})) AS i),
        known AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{level}', '{mode}', '{','.join(capabilities)}', '{','.join(plan)}')" for k, (level, mode, capabilities, plan) in intents.KINDS.items())}) AS k(kind, level, mode, capabilities, plan))
        SELECT c_custkey, kind, level, mode, capabilities, plan, CASE i WHEN 6 THEN '6.4.5' END AS clause_id, CASE i WHEN 3 THEN 'JTS 165-2025' WHEN 4 THEN 'JGJ 162' END AS standard, CASE i WHEN 5 THEN 3.5 END AS h
        FROM customer JOIN kinds ON i = c_custkey % {len(QUESTIONS)} LEFT JOIN known USING (kind)""",
)
def intent_classes(t: Tables) -> DataFrame:
    asked = F.element_at(F.array(*(F.lit(q) for q, _ in QUESTIONS)), (F.col("c_custkey") % len(QUESTIONS) + 1).cast("int"))
    told = t.customer.select("c_custkey", intents.classified(t.spark, asked).alias("c"))
    joined = [F.array_join(f"c.{name}", ",").alias(name) for name in ("capabilities", "plan")]
    return told.select("c_custkey", "c.kind", "c.level", "c.mode", *joined, "c.clause_id", "c.standard", F.try_element_at("c.parameters", F.lit("H")).alias("h"))


@query(
    "formula_symbols",
    r"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'H_{' || p_size || '} = D - \sigma _ { 1 }' WHEN 1 THEN CASE WHEN p_size = 1 THEN 'H _ { \mathrm { n } } = D - \sigma _ { 1 }' ELSE 'H _ { \mathrm { n } } = D - \sigma_{' || p_size || '}' END ELSE 'H _ { \mathrm { n } } = D - \sigma _ { 1 }' END AS formula,
               CASE WHEN p_partkey % 3 = 0 OR p_partkey % 3 = 1 AND p_size <> 1 THEN 1 ELSE 0 END AS corrections, 'Hn,D,\sigma1' AS symbols FROM part""",
)
def formula_symbols(t: Tables) -> DataFrame:
    """Symbols of a formula, corrected where an explanation names one of the same base; two of a base decide nothing."""
    formula = F.lit(r"H _ { \mathrm { n } } = D - \sigma _ { 1 }")
    size = F.col("p_size").cast("string")
    named = F.when(F.col("p_partkey") % 3 == 0, F.array(F.concat(F.lit("H_{"), size, F.lit("}")), F.lit("D；"))).when(F.col("p_partkey") % 3 == 1, F.array(F.concat(F.lit("\\sigma_{"), size, F.lit("}")))).otherwise(F.array(F.lit("H_1"), F.lit("H_2")))
    rows = t.part.select("p_partkey", formula.alias("f"), named.alias("p")).withColumn("c", latex.symbol_corrections(F.col("f"), F.col("p")))
    forms = F.array_join(F.transform(latex.symbol_tokens(F.col("f")), lambda s: s["form"]), ",")
    return rows.select("p_partkey", latex.corrected(F.col("f"), F.col("c")).alias("formula"), F.size("c").alias("corrections"), forms.alias("symbols"))


@query(
    "json_extraction",
    """SELECT c_custkey, CASE WHEN c_custkey % 6 < 5 THEN c_name END AS name, CASE c_custkey % 6 WHEN 1 THEN c_custkey WHEN 2 THEN c_custkey END AS last FROM customer""",
)
def json_extraction(t: Tables) -> DataFrame:
    """Objects in marked and plain text, with commas too many, in single quotes, cut off, and none."""
    key, name = F.col("c_custkey").cast("string"), F.col("c_name")
    form = F.col("c_custkey") % 6
    text = (
        F.when(form == 0, F.concat(F.lit('so:\n```json\n{"name": "'), name, F.lit('"}\n``` done')))
        .when(form == 1, F.concat(F.lit('it is {"name": "'), name, F.lit('", "list": [1, '), key, F.lit(",],} or so")))
        .when(form == 2, F.concat(F.lit("{'name': '"), name, F.lit("', 'list': [1, "), key, F.lit("]}")))
        .when(form == 3, F.concat(F.lit('{"name": "'), name, F.lit('"}')))
        .when(form == 4, F.concat(F.lit('{"name": "'), name, F.lit('", "list": [1, {"a": "')))
        .otherwise(F.concat(F.lit("nothing of "), name))
    )
    told = t.customer.select("c_custkey", jsontext.extracted(text, complete=True).alias("j"))
    return told.select("c_custkey", F.get_json_object("j", "$.name").alias("name"), F.get_json_object("j", "$.list[1]").try_cast("long").alias("last"))


@query(
    "equation_roots",
    """SELECT p_partkey, [round(-sqrt(p_size), 6), round(sqrt(p_size), 6)] AS roots, p_size + p_retailprice AS total, round(p_retailprice / 3 - p_size / 3.0, 6) AS linear, 1 AS errors FROM part""",
)
def equation_roots(t: Tables) -> DataFrame:
    """Equations solved for each row's values, and a batch of expressions of which one is refused."""
    rows = t.part.select("p_partkey", F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").cast("double").alias("r"))
    batch = lookup.calculated_batch(["s + r", "3 * x + s = r", "s; r"], rows.columns, labels=["total"], solve_for="x")
    out = rows.withColumn("b", batch).withColumn("x", lookup.roots("x * x = s", "x", rows.columns))
    errors = F.size(F.filter("b", lambda e: e["error"].isNotNull()))
    return out.select("p_partkey", F.transform("x", lambda v: F.round(v, 6)).alias("roots"), F.col("b")[0]["result"].alias("total"), F.round(F.col("b")[1]["solutions"][0], 6).alias("linear"), errors.alias("errors"))
