"""Terms that texts hold, as columns: numbers of clauses, formulas and references, symbols, units, tags, forms of titles and answers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import GREEK, dotted, let, match_form, spelled

# Fixed values that results depend on: shapes of numbers and symbols.
_PARTS = r"[0-9]+(?:[.\s\-][0-9]+){0,4}"
STRICT_FORMS = (
    rf"第\s*({_PARTS})\s*条",
    rf"第\s*({_PARTS})\s*款",
    rf"(?:表|图|式|公式)\s*({_PARTS})",
    r"([0-9]+\.[0-9]+(?:\.[0-9]+){0,3})\s*条",
    r"附录\s*([A-Z](?:\.[0-9]+){0,3})",
    r"(?<![\d.])(\d+\.\d+\.\d+(?:\.\d+){0,2})(?![\d.\-])",
    r"(?<![\dA-Za-z.])([A-Z]\.\d+(?:\.\d+){0,3})(?![\d.])",
)
SYMBOL = r"\\?[A-Za-z]+(?:_\s*\{?\s*[A-Za-z0-9,\-\s]+\}?)?"
ROOTS = tuple(sorted({*GREEK.values(), "epsilon"}))
FORMULA_NUMBER = r"[（(](\d+(?:\.\d+)*(?:-\d+)?)[）)]|\\tag\{(\d+(?:\.\d+)*(?:-\d+)?)\}"
FORMULA_TAG = r"\\tag(?:\*)?\s*\{[^{}]*\}"
PARAMETER_SYMBOL = r"[A-Za-zΑ-Ωα-ω\\][A-Za-z0-9_{}^()\\/.\-']{0,20}"
PARAMETER = rf"^\s*({PARAMETER_SYMBOL})\s*(?:[—–\-一]{{1,3}}|:=|=|：|:)\s*(.+?)\s*$"
PARAMETER_SOFT = rf"^\s*({PARAMETER_SYMBOL})\s+(.+?)\s*$"
HINT = "(采用[^；。]*|按[^；。]*|取[^；。]*|见[^；。]*|按表[^；。]*)"
IN_BRACKETS = "[（(]([^()（）]{1,20})[）)]"
REFERENCES = (r"(表\s*\d+(?:[.\-]\d+)*)", r"(图\s*\d+(?:[.\-]\d+)*)", r"(公式\s*\d+(?:[.\-]\d+)*)", r"(式\s*\d+(?:[.\-]\d+)*)", r"(第\s*\d+(?:\.\d+)*(?:章|节|条|款|项))", r"^(\d+(?:\.\d+)*)")
LABELS = {"table": "表格条文", "formula": "公式条文", "figure": "图片条文", "content": "正文条文"}
ASKED_CLAUSE = r"第\s*([A-Za-z]?\d+(?:\.\d+){1,4})|([A-Za-z]?\d+(?:\.\d+){1,4})\s*(?:条|款|节|章|式)"
STANDARD = r"(?i)(?:GB|JGJ|JTS|JTJ|JTG|JTSC|CJJ|DL|SL|NB|SY|HJ|YB|TB|SH|HG|CECS|DB)(?:/T)?\s*[/\-]?\s*\d+(?:\s*[-—–]\s*\d+)?"
# Words by the tag that they give, by the layer of an entity, and of answers that decline.
TAGS = {"强制性条文": ("必须", "严禁", "不得", "应"), "抗震": ("抗震",), "换算": ("换算",), "公式": ("公式", "式中", "按式"), "表格": ("表", "表格")}
LAYERS = {"action": ("计算", "验算", "检查", "检测", "校验", "验证", "测试"), "condition": ("工况", "条件", "情况", "状态", "水位", "波浪", "流速", "风况", "地震")}
REFUSALS = ("没有检索到足够证据", "建议缩小文档范围", "换一种问法")
KNOWN_CODES = ("JTS", "JTJ", "JT", "GB", "GBJ", "GB/T", "SL", "DL", "SY", "SH", "HG", "NB", "CJJ", "CJ", "TB", "YB", "JGJ", "JG", "DB")


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """What a group of the first match holds; null without a match or with an empty group."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group), F.lit(""))


def has_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words), F.lit(False))


# ---------------------------------------------------------------- numbers and symbols


def strict_clause_refs(text: Column) -> Column:
    """Clause numbers that their surroundings tell from measures: a word before or after, three parts or more, or an appendix letter."""
    found = F.concat(*(_all(text, form, 1) for form in STRICT_FORMS))
    return F.array_distinct(F.filter(F.transform(found, dotted), lambda ref: F.contains(ref, F.lit("."))))


def formula_identifiers(text: Column) -> Column:
    """Formula symbols in match form: those with a subscript, and those that begin with the name of a Greek letter."""
    named = spelled(F.coalesce(text, F.lit("")))
    forms = F.transform(_all(named, SYMBOL), lambda s: F.struct(match_form(s).alias("form"), F.contains(s, F.lit("_")).alias("low")))
    kept = F.filter(forms, lambda s: (F.char_length(s["form"]) >= 2) & (s["low"] | s["form"].rlike(f"^(?:{'|'.join(ROOTS)})")))
    return F.array_distinct(F.transform(kept, lambda s: s["form"]))


def identifier_hits(asked: Sequence[str], text: Column) -> Column:
    """How many of the asked symbols a text has."""
    if not asked:
        return F.lit(0)
    return F.size(F.array_intersect(F.array(*map(F.lit, dict.fromkeys(asked))), formula_identifiers(text)))


def structure_number(text: Column) -> Column:
    """Leading dotted number, or the appendix and its letter."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    return F.coalesce(_first(plain, r"^(\d+(?:\.\d+)*)"), _first(plain, "^(附录[A-Z])"))


def structure_level(text: Column) -> Column:
    """Parts of the leading number; 1 for an appendix."""
    number = structure_number(text)
    return F.when(number.startswith("附录"), 1).otherwise(F.size(F.split(number, r"\.")))


def asked_clause(question: Column) -> Column:
    """The clause number that a question names as such, if no unit or digit follows it."""
    found = _first(question, f"({ASKED_CLAUSE})")
    number = F.coalesce(_first(question, ASKED_CLAUSE, 1), _first(question, ASKED_CLAUSE, 2))
    rest = F.ltrim(F.substr(question, F.instr(question, found) + F.char_length(found), F.lit(3)))
    return F.when(~rest.rlike("^[mkntsgMKNTSG%℃°数位0-9]"), number)


def standard_codes(text: Column) -> Column:
    return F.array_distinct(_all(text, STANDARD))


# ---------------------------------------------------------------- formulas


def formula_form(text: Column) -> Column:
    """White space runs become one blank, semicolons at either end go."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), "^[；;]+|[；;]+$", "")


def formula_number(formula: Column, lines: Column) -> Column:
    """The number of a formula, in brackets or as a tag, in its text or else in its explanation."""
    texts = F.transform(F.concat(F.array(formula), lines), formula_form)
    first = F.get(F.filter(texts, lambda t: t.rlike(FORMULA_NUMBER)), F.lit(0))
    return F.concat(F.regexp_extract(first, FORMULA_NUMBER, 1), F.regexp_extract(first, FORMULA_NUMBER, 2))  # one of the groups is empty


def without_tag(formula: Column) -> Column:
    return F.trim(F.regexp_replace(formula_form(formula), FORMULA_TAG, ""))


def unit_of(description: Column) -> Column:
    """The first unit in brackets: something with Latin letters, a percent or degree sign, or a slash."""
    units = F.filter(F.transform(_all(description, IN_BRACKETS, 1), formula_form), lambda u: u.rlike("(?i)[a-z%°/度]"))
    return F.get(units, F.lit(0))


def reference_hint(description: Column) -> Column:
    """Where a value comes from: what follows `by`, `take`, `see` and the like, up to the end of the clause."""
    return let(formula_form(F.regexp_extract(description, HINT, 1)), lambda hint: F.when(hint != "", hint))


def parameter(line: Column) -> Column:
    """Struct (symbol, description, unit, reference_hint) of a line that explains a symbol, else null.

    Symbol and description are parted by a dash, colon or equals sign; a blank will do where the
    description is in words and the symbol is no command.
    """
    def parted(plain: Column, form: str) -> Column:
        return F.struct(*(formula_form(F.regexp_extract(plain, form, i)).alias(name) for i, name in ((1, "symbol"), (2, "description"))))

    def in_words(s: Column) -> Column:
        text = s["description"]
        return F.when(text.rlike("[\u4e00-\u9fff(（]") & ~text.rlike(r"^[+\-*/=_{\\^~]") & ~s["symbol"].startswith("\\") & (s["symbol"] != ""), s)

    def told(s: Column) -> Column:
        parts = F.struct(s["symbol"].alias("symbol"), s["description"].alias("description"), unit_of(s["description"]).alias("unit"), reference_hint(s["description"]).alias("reference_hint"))
        return F.when((s["symbol"] != "") & (s["description"] != ""), parts)

    # each step is worked out once: within a lambda Spark shares nothing, and a column that names another twice would double all below it
    plain = F.regexp_replace(F.regexp_replace(formula_form(line), r"^[•·]\s*", ""), r"^(?:式中|其中|注)[:：]?\s*", "")
    return let(let(plain, lambda p: F.when(p.rlike(PARAMETER), parted(p, PARAMETER)).otherwise(let(parted(p, PARAMETER_SOFT), in_words))), told)


# ---------------------------------------------------------------- tags and kinds


def tags(text: Column, section: Column, rules: Mapping[str, Sequence[str]] = TAGS) -> Column:
    """Names of the rules of which any word occurs in the section path or the text."""
    both = F.concat_ws("\n", section, text)
    return F.array_compact(F.array(*(F.when(has_any(both, words), F.lit(tag)) for tag, words in rules.items())))


def conditions(text: Column, section: Column) -> Column:
    """The binding ones among the tags."""
    return F.filter(tags(text, section), lambda t: t == "强制性条文")


def found_terms(text: Column, terms: Sequence[str] | Mapping[str, str]) -> Column:
    """Terms of a dictionary that occur in a text, by the names that it gives them."""
    named = terms if isinstance(terms, Mapping) else dict(zip(terms, terms, strict=True))
    return F.array_compact(F.array(*(F.when(F.contains(text, F.lit(word)), F.lit(name)) for word, name in named.items())))


def entity_layer(name: Column) -> Column:
    """Layer of an entity by the words of its name: actions before conditions, concepts otherwise."""
    return F.when(has_any(name, LAYERS["action"]), "action").when(has_any(name, LAYERS["condition"]), "condition").otherwise("concept")


def level_confidence(text: Column, level: Column, post_processed: Column) -> Column:
    """Trust in a title's level: numbered titles more than plain ones, levels of the post-processor less; none without a level."""
    numbered = F.trim(F.coalesce(text, F.lit(""))).rlike(r"^\d")
    return F.when(level.isNull(), 0.0).when(post_processed, F.when(numbered, 0.8).otherwise(0.3)).otherwise(F.when(numbered, 0.95).otherwise(0.6))


# ---------------------------------------------------------------- references, titles, answers


def reference_identifier(text: Column) -> Column:
    """The first reference of a text: a table before a figure, a formula, a clause, a leading number; else empty."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.coalesce(*(F.replace(_first(plain, f"(?i){form}"), F.lit(" ")) for form in REFERENCES), F.lit(""))


def reference_label(section: Column, text: Column, kind: Column) -> Column:
    """What a reference is called: its identifier in the section or the text, else the last section, else its kind."""
    parts = F.filter(F.transform(F.split(F.coalesce(section, F.lit("")), "[/>]"), lambda p: F.trim(p)), lambda p: p != "")
    kinds = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    named = [F.nullif(reference_identifier(section), F.lit("")), F.nullif(reference_identifier(text), F.lit(""))]
    return F.coalesce(*named, F.substring(F.try_element_at(parts, F.lit(-1)), 1, 24), F.try_element_at(kinds, kind), F.lit("知识条文"))


def eval_form(text: Column) -> Column:
    """Answers for comparison: half-width marks, lower case, letters, digits and the marks of numbers and formulas."""
    half = F.translate(F.coalesce(text, F.lit("")), "（），。：；～％", "(),.:;~%")
    return F.regexp_replace(F.lower(half), r"[^\p{L}\p{N}.%~=+\-<>():/]", "")


def refuses(answer: Column) -> Column:
    return has_any(F.trim(F.coalesce(answer, F.lit(""))), REFUSALS)


def document_form(title: Column) -> Column:
    """A document's title without folder, extension and underscores."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(title, "^markdown/", ""), r"\.md$", ""), r"\.pdf$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(plain, "_—–", " --"), r"\s+", " "), r"\s+$", ""))


def titles_fit(asked: Column, title: Column) -> Column:
    """Whether a document may be the one asked for: one title holds the other, with or without its year, it begins with the
    first 15 characters, or both name one standard."""
    a, b = F.lower(asked), F.lower(title)
    bare = [F.trim(F.regexp_replace(x, r"[-_]\d{4}\s*$", "")) for x in (a, b)]
    code = [_first(x, r"(?:jts|jtj|gb|jgj)\s*\d+", 0) for x in (a, b)]
    within = F.contains(a, b) | F.contains(b, a) | ((bare[0] != "") & (F.contains(bare[0], bare[1]) | F.contains(bare[1], bare[0])))
    return within | ((a != "") & b.startswith(F.substring(a, 1, 15))) | F.coalesce(code[0] == code[1], F.lit(False))


def unsupported_reference(answer: Column, evidence: Column) -> Column:
    """Whether an answer names a standard or an examination that the evidence doesn't.

    Its number suffices, or its letters and first digits apart; well-known letters do where the evidence
    has numbered sections; and so does any title in brackets that both have.
    """
    corpus = F.coalesce(evidence, F.lit(""))
    shared = F.arrays_overlap(_all(answer, "《[^》]+》"), _all(corpus, "《[^》]+》"))
    sections = corpus.rlike(r"\d+\.\d+")

    def missing(token: Column) -> Column:
        number, letters, digits = _first(token, r"\d+(?:[-/]\d+)*", 0), _first(token, r"^([A-Z]{2,})"), _first(token, r"^[A-Z]{2,}\s*(\d+)")
        supported = F.contains(corpus, token) | F.contains(corpus, number) | (F.contains(corpus, letters) & F.contains(corpus, digits)) | (letters.isin(*KNOWN_CODES) & sections)
        return ~F.coalesce(supported, F.lit(False))

    named = F.transform(F.concat(_all(answer, r"[A-Z]{2,}\s*\d+(?:[-/]\d+)*"), _all(answer, r"20\d{2}年[^\n，。；]*真题")), lambda x: F.trim(x))
    return F.exists(named, missing) & ~F.coalesce(shared, F.lit(False))


def elapsed(seconds: Column) -> Column:
    """A duration in words: tenths of seconds below a minute, whole units from there on."""
    whole = F.bround(seconds).cast("long")
    hours, minutes, rest = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    long_ = F.concat(F.when(hours > 0, F.concat(hours, F.lit("小时"))).otherwise(""), minutes, F.lit("分"), rest, F.lit("秒"))
    return F.when(seconds < 60, F.format_string("%.1f秒", F.bround(seconds, 1).cast("double"))).otherwise(long_)


def given_conditions(text: Column) -> Column:
    """Conditions of a lookup as a map: a JSON object, or one `name = value` (or with a colon); empty otherwise."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    empty = F.create_map().cast("map<string,string>")
    pair = r"^\s*([^=:/]+)\s*[:=]\s*(\S+)\s*$"
    return (
        F.when(plain.rlike(r"(?s)^\{.*\}$"), F.coalesce(F.from_json(plain, "map<string,string>"), empty))
        .when(plain.rlike(pair), F.create_map(F.trim(F.regexp_extract(plain, pair, 1)), F.regexp_extract(plain, pair, 2)))
        .otherwise(empty)
    )


def value_after(text: Column, marks: Sequence[str]) -> Column:
    """What follows the first of the given names in a question, after `is`, `take` or a sign, up to the end of the clause."""
    found = [F.nullif(F.trim(_first(text, rf"\Q{mark}\E\s*[为取:：=]?\s*([^，。；;,\n]*)")), F.lit("")) for mark in marks]
    return F.coalesce(*found)


def value_by_pattern(text: Column, patterns: Sequence[str]) -> Column:
    """The first group of the first pattern that fits, whatever the case."""
    return F.coalesce(*(_first(text, f"(?i){p}") for p in patterns))
