from pyspark.sql import functions as F

from folioscope.functions import query as q
from folioscope.functions import text as fn


def one(spark, expression, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` string" for k in values)).select(expression).first()[0]


def test_match_form_equals_its_twin(spark):
    for text in ["ε_{t,r}＝\\mathrm{ab c}，（X-1）", "Hello, World! 12.5", "斜坡堤 稳定计算。", "", "\\mathrm{a\\mathrm{b}}", "\\mathrm{" * 7 + "x" + "}" * 7 + " ω"]:
        assert one(spark, fn.match_form(F.col("t")), t=text) == q.plain_form(text)


def test_clause_numbers(spark):
    assert one(spark, fn.clause_id(F.col("t")), t="6.2.8.1 港池水深") == "6.2.8.1"
    assert one(spark, fn.clause_id(F.col("t")), t="1.5m deep") is None
    assert one(spark, fn.contains_clause(F.col("t"), "6.2.1"), t="见6.2.1条") is True
    assert one(spark, fn.contains_clause(F.col("t"), "6.2.1"), t="见6.6.2.1条") is False
    assert one(spark, fn.clause_refs(F.col("t")), t="6.2.7 and 6 2 8 or 6-2-9, 6.2.7") == ["6.2.7", "6.2.8", "6.2.9"] == q.Question("6.2.7 and 6 2 8 or 6-2-9, 6.2.7").clauses


def test_levels_counts_and_paths(spark):
    assert [one(spark, fn.title_level(F.col("t"), F.lit(None).cast("int")), t=t) for t in ("1 总则", "1.2 x", "1.2.3 y", "z")] == [1, 2, 3, 1]
    assert [one(spark, fn.token_count(F.col("t")), t=t) for t in ("", "ab", "a" * 41)] == [0, 1, 10]
    assert one(spark, fn.section_form(F.col("t")), t=" 3 设计 / / 3.1 ") == "3 设计 / 3.1"
    assert one(spark, fn.chapter(F.col("t")), t="3 / 3.1 / ") == "3.1"
    assert one(spark, fn.block_type(F.col("t")), t="equation_interline") == "formula"


def test_numbers_and_names(spark):
    assert tuple(one(spark, fn.number_range(F.col("t")), t="10 ~ 20")) == (10.0, 20.0)
    assert tuple(one(spark, fn.number_range(F.col("t")), t="≤5")) == (None, 5.0)
    assert one(spark, fn.number_range(F.col("t")), t="x") is None
    assert one(spark, fn.first_number(F.col("t")), t="about -2.5 m") == -2.5
    assert one(spark, fn.entity_form(F.col("t")), t="ＡＢＣ 港") == "abc港"
    assert one(spark, fn.expression_form(F.col("t")), t="（1,000 × 2²）÷ 3") == "(1000*2**2)/3"
    assert one(spark, fn.year_of(F.col("t")), t="JTS 165-2013") == 2013


def test_question():
    question = q.Question("斜坡堤稳定计算方法和要求 6.2.7")
    assert question.clauses == ["6.2.7"] and question.keyword == "6.2.7"
    assert "斜坡堤" in question.tokens and dict(question.weighted)["计算"] == 0.04
    assert q.weight("计算") == 0.04 and q.weight("斜坡") == 0.4 and q.weight("eps_t") == 1.5
    assert q.Question("乘潮进港时间怎么计算").keyword == "乘潮"
    assert q.Question("LNG ship berth").keyword == "lng"
    assert q.Question("表3怎么查").kind == "locate_table" and q.Question("见图2").kind == "locate_figure"
    assert q.Question("").tokens == [] and q.Question("").phrases == []


def test_terms_equal_their_twins(spark):
    from folioscope.functions import terms

    for text in ["第 5-2 条与 6.2.8 款，1.5m", "表 A.0.1 和 12.3.4、12.3", "ε_{t,r} = \\varepsilon_1 σ + kN · x_a", "按六点二点七取", "公式 5.4", ""]:
        question = q.Question(text)
        assert one(spark, terms.strict_clause_refs(F.col("t")), t=text) == question.strict_clauses
        assert one(spark, fn.clause_refs(F.col("t")), t=text) == question.clauses
        assert one(spark, terms.formula_identifiers(F.col("t")), t=text) == question.symbols


def test_terms(spark):
    from folioscope.functions import terms

    assert one(spark, terms.eval_form(F.col("t")), t=" 约（１）， 5.0 ％！") == "约(１)5.0%"
    assert one(spark, terms.refuses(F.col("t")), t="请换一种问法") is True and one(spark, terms.refuses(F.col("t")), t=None) is False
    assert [one(spark, terms.elapsed(F.col("t").cast("double")), t=t) for t in ("5.26", "60", "3725.4")] == ["5.3秒", "1分0秒", "1小时2分5秒"]
    assert one(spark, terms.unsupported_reference(F.col("a"), F.col("e")), a="见 JTS 165-2013", e="第 5.2 节") is False
    assert one(spark, terms.unsupported_reference(F.col("a"), F.col("e")), a="见 XYZ 12", e="《规范》") is True
    assert one(spark, terms.unsupported_reference(F.col("a"), F.col("e")), a="见《规范》XYZ 12", e="《规范》") is False
    assert one(spark, terms.titles_fit(F.col("a"), F.col("b")), a="Code_2009", b="kode 2012") is False
    assert one(spark, terms.titles_fit(F.col("a"), F.col("b")), a="abc-2009", b="x abc-2012") is True
    assert one(spark, terms.parameter(F.col("t")), t="• 其中 \\alpha 系数") is None
    assert tuple(one(spark, terms.parameter(F.col("t")), t="K：系数，取0.8（%）；"))[:3] == ("K", "系数，取0.8（%）", "%")
    assert one(spark, terms.value_by_pattern(F.col("t"), ["z4取?\\s*([\\d.]+)"]), t="Z4取 0.4m") == "0.4"
    assert one(spark, terms.asked_clause(F.col("t")), t="第5.2m") is None


def test_upper_case_letter_by_letter_as_in_sql(spark):
    import duckdb

    texts = ["Straße été", "ßß", "ﬁn ŉ ᾳ ΐ և", "", "plain œuvre", "aßﬀb\nß"]
    got = [r["u"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(fn.upper_letters(F.col("t")).alias("u")).collect()]
    assert got == [duckdb.execute("SELECT upper(?)", [t]).fetchone()[0] for t in texts] and got[0] == "STRAẞE ÉTÉ"


def test_a_parameter_works_out_each_step_once(spark):
    from folioscope.functions import terms

    rows = spark.createDataFrame([("q——荷载（kN/m）",)], "t string").select(F.filter(F.transform(F.array("t"), terms.parameter), lambda p: p["unit"] == "kN/m").alias("p"))
    assert rows.first()["p"][0]["symbol"] == "q"
    # the marks before a line are taken off once: the plan had this many times
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("式中|其中|注") == 1
