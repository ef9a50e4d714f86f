"""What kind of answer a question asks for, by rules: small talk, concepts, clauses, calculations, complex tasks."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.automaton import Dictionary

# Fixed values that results depend on: words that tell the levels of questions, by level.
WORDS = {
    "chat": (
        "你好", "您好", "嗨", "hi", "hello", "早上好", "下午好", "晚上好", "早安", "晚安", "谢谢", "感谢", "辛苦了", "再见", "拜拜",
        "心情", "开心", "难过", "无聊", "累", "烦", "高兴", "生气", "焦虑", "今天天气", "吃了吗", "在吗", "聊聊天", "闲聊",
    ),
    "about": ("你是谁", "你叫什么", "能做什么", "有什么功能", "帮我", "怎么用"),
    "concept": (
        "什么是", "是什么", "哪些", "定义", "概念", "组成", "包括", "分为", "划分", "分类", "类型", "位于", "设置", "位置", "在哪里", "宜设置", "应设置",
        "如何确定", "怎么确定", "怎样确定", "如何定义", "怎么定义", "如何划分", "怎么划分", "简述", "说明", "列举", "阐述", "解释", "原理", "作用", "功能",
        "特点", "特征", "区别", "异同", "对比", "比较", "差异", "选用", "选型", "适用条件", "适用范围", "影响因素", "注意事项",
    ),
    "place": ("位于", "设置", "位置", "在哪里", "宜设置", "应设置"),
    "clause": (
        "取值", "范围", "规定", "条款", "要求", "标准值", "限值", "允许值", "应符合", "不应超过", "查表", "依据", "按照", "遵照", "应满足", "取值表",
        "参数表", "数据表", "条文",
    ),
    "calculation": ("计算", "求", "验算", "核算", "校核", "公式", "等于多少", "结果是多少", "求解", "算出", "推定", "是多少", "求值", "推算"),
    "complex": (
        "综合评价", "综合评估", "系统分析", "方案设计", "设计方案", "多方案比较", "优化设计", "比选", "技术经济比较", "可行性研究", "初步设计",
        "施工图设计",
    ),
    "steps": ("并", "且", "同时", "再", "然后", "最后", "分步", "步骤", "第一", "第二", "第三", "首先", "其次", "接着"),
}
# Forms of clause numbers, parameters, measures, codes of standards, answers to choose from.
CLAUSE = r"第\s*([A-Za-z]?\d+(?:\.\d+){1,4})\s*(?:条|款|节|章|式)?|([A-Za-z]?\d+(?:\.\d+){1,4})\s*(?:条|款|节|章|式)"
PARAMETER = r"([a-zA-Zα-ωΑ-Ω][a-zA-Zα-ωΑ-Ω_]*)\s*[=＝]\s*([\d.]+)"
MEASURE = r"[\d]+(?:\.\d+)?(?:\s*(?:m|t|吨|级|kn|°|%%|s|mm|cm|km|m/s|kg/m|万|亿))"
STANDARD = (
    r"(?i)(?:GB|GB/T|JGJ|JGJ/T|JTS|JTJ|JTG|JTG/T|JTSC|CJJ|CJJ/T|DL|DL/T|SL|SL/T|NB|NB/T|SY|SY/T|HJ|HJ/T|YB|YB/T|TB|TB/T|SH|SH/T|HG|HG/T|CECS|DB)"
    r"\s*[/\-]?\s*\d+(?:\s*[-—–]\s*\d+)?"
)
CHOICE = r"[(（][A-D][)）]"
# Capabilities and the ways to try, in their order, of each kind of question: (level, kind) -> (mode, capabilities, plan).
KINDS = {
    "casual_chat": ("L0", "casual_chat", [], ["casual_chat"]),
    "locate_navigation": ("L1", "semantic_retrieval", ["retrieval"], ["semantic_retrieval"]),
    "concept_resolution": ("L1", "semantic_retrieval", ["retrieval"], ["semantic_retrieval"]),
    "standard_lookup": ("L2", "structured_lookup", ["retrieval", "sql"], ["structured_lookup", "semantic_retrieval"]),
    "clause_application": ("L2", "structured_lookup", ["retrieval", "sql"], ["structured_lookup", "semantic_retrieval"]),
    "clause_then_calculation": ("L2", "structured_lookup", ["retrieval", "sql", "calculation", "sop", "orchestration"], ["structured_lookup", "standard_sop", "dynamic_orchestration"]),
    "standard_calculation": ("L3", "standard_sop", ["retrieval", "calculation", "sop"], ["standard_sop", "semantic_retrieval"]),
    "complex_task": ("L4", "dynamic_orchestration", ["retrieval", "calculation", "sop", "orchestration"], ["dynamic_orchestration"]),
}
#: Characters above which a question is more than small talk, and above which a complex one needs no step words.
SMALL_TALK, LONG = 15, 30


def _words(spark: SparkSession) -> Dictionary:
    """All words in one automaton; a word of several levels is named after all of them."""
    levels: dict[str, list[str]] = {}
    for level, words in WORDS.items():
        for word in words:
            levels.setdefault(word, []).append(level)
    return Dictionary(spark, {word: ",".join(of) for word, of in levels.items()})


def classified(spark: SparkSession, text: Column) -> Column:
    """Struct (level, kind, mode, capabilities, plan, clause_id, standard, measures, parameters) of a question; null where no rule fits,
    and for null and empty texts. The first rule that fits decides.

    parameters: names and values as a map; of a name that comes twice the last value, and none where it is no number.
    """
    plain = F.coalesce(text, F.lit(""))
    told = F.array_distinct(F.flatten(F.transform(_words(spark).found(plain), lambda names: F.split(names, ","))))
    pairs = F.transform(F.regexp_extract_all(plain, F.lit(PARAMETER), F.lit(0)), lambda p: F.struct(F.regexp_extract(p, PARAMETER, 1).alias("name"), F.regexp_extract(p, PARAMETER, 2).try_cast("double").alias("value")))
    facts = F.struct(
        told.alias("words"),
        F.regexp_count(plain, F.lit(MEASURE)).cast("long").alias("measures"),
        F.nullif(F.regexp_extract(plain, STANDARD, 0), F.lit("")).alias("standard"),
        F.nullif(F.concat(F.regexp_extract(plain, CLAUSE, 1), F.regexp_extract(plain, CLAUSE, 2)), F.lit("")).alias("clause_id"),
        pairs.alias("pairs"),
        plain.rlike(CHOICE).alias("choice"),
        F.char_length(plain).alias("size"),
    )
    # one struct in an array of its own, so that all rules read what was found once
    return F.get(F.transform(F.array(facts), _decided), F.lit(0))


def _decided(facts: Column) -> Column:
    has = lambda level: F.array_contains(facts["words"], level)
    standard, clause, measures, choice = facts["standard"].isNotNull(), facts["clause_id"].isNotNull(), facts["measures"], facts["choice"]
    parameters, calculation = F.size(facts["pairs"]) > 0, has("calculation")
    substance = standard | clause | parameters | (measures >= 2) | has("concept") | has("clause") | calculation | has("complex") | (facts["size"] > SMALL_TALK)
    kind = (
        F.when(facts["size"] == 0, F.lit(None))
        .when((has("chat") | has("about")) & ~substance, "casual_chat")
        .when(calculation & (standard | clause | has("clause")) & (measures >= 2) & choice, "clause_then_calculation")
        .when(standard, "standard_lookup")
        .when(calculation & ((choice & (measures >= 1)) | parameters | (measures >= 2)), "standard_calculation")
        .when(clause & has("clause"), "clause_application")
        .when(has("concept") & ~(calculation & (measures >= 1)), F.when(has("place"), "locate_navigation").otherwise("concept_resolution"))
        .when(calculation, "standard_calculation")
        .when(has("complex") & (has("steps") | (facts["size"] > LONG)), "complex_task")
        .when(has("clause"), "clause_application")
    )
    strings = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    known = F.create_map(*(x for name, (level, mode, capabilities, plan) in KINDS.items() for x in (F.lit(name), F.struct(F.lit(level).alias("level"), F.lit(mode).alias("mode"), strings(capabilities).alias("capabilities"), strings(plan).alias("plan")))))
    own = F.try_element_at(known, kind)
    names = F.array_distinct(F.transform(facts["pairs"], lambda p: p["name"]))
    last = F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(facts["pairs"], lambda p: p["name"] == n), -1)["value"]))
    row = F.struct(own["level"].alias("level"), kind.alias("kind"), own["mode"].alias("mode"), own["capabilities"].alias("capabilities"), own["plan"].alias("plan"), facts["clause_id"].alias("clause_id"), facts["standard"].alias("standard"), measures.alias("measures"), last.alias("parameters"))
    return F.when(kind.isNotNull(), row)
