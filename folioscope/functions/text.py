"""Text functions as Spark columns: normalising, clause numbers, levels, tags, tokens."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "varepsilon", "η": "eta", "θ": "theta", "κ": "kappa", "λ": "lambda", "μ": "mu",
    "ν": "nu", "ξ": "xi", "π": "pi", "ρ": "rho", "σ": "sigma", "τ": "tau", "φ": "phi", "ψ": "psi", "ω": "omega",
}
#: White space and punctuation that matching ignores, as a pattern: Latin-1 characters are one bit set for Java, wider ones a chain of tests that only wide characters meet.
IGNORED = "[ \\t\\n\\x0B\\f\\r()\\[\\]{}<>.,;:!?·\\-~$\\\\]+|(?![\\x00-\\xFF])[，。；：、“”‘’（）【】《》！？—]+"
BLOCK_TYPES = {
    "text": "paragraph", "para": "paragraph", "paragraph": "paragraph", "list": "list_item", "list_item": "list_item", "table": "table", "table_caption": "table_caption",
    "figure": "figure", "image": "figure", "figure_caption": "figure_caption", "header_footer": "header_footer", "page_header": "header_footer",
    "page_number": "header_footer", "page_footer": "header_footer", "footnote": "footnote", "equation": "formula", "equation_interline": "formula",
    "inline_formula": "formula", "formula": "formula", "title": "title", "index": "toc", "toc": "toc",
}
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
#: Shapes of clause numbers: dotted, parted by blanks, by hyphens, or spoken.
CLAUSE_FORMS = (r"\d+(?:\.\d+){1,4}", r"\d+(?:\s+\d+){1,4}", r"\d+(?:-\d+){1,4}", "[一二三四五六七八九十]+(?:点[一二三四五六七八九十]+){1,4}")
NUMERALS = {"一": "1", "二": "2", "三": "3", "四": "4", "五": "5", "六": "6", "七": "7", "八": "8", "九": "9"}


def let(value: Column, build: Callable[[Column], Column]) -> Column:
    """build(value) with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), lambda x: build(x)), 1)


def clean(text: Column) -> Column:
    """White space runs become one blank; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))


def spelled(text: Column) -> Column:
    """Greek letters by their names, \\mathrm{} wrappers taken off, from the inside out, however deep."""

    def unwrapped(named: Column) -> Column:
        wrappers = F.sequence(F.lit(1), F.regexp_count(named, F.lit("\\\\mathrm")))
        plain = F.aggregate(wrappers, named, lambda out, _: F.regexp_replace(out, "\\\\mathrm\\s*\\{([^{}]+)\\}", "$1"))
        return F.when(F.contains(named, F.lit("\\mathrm")), plain).otherwise(named)

    return let(reduce(lambda c, g: F.replace(c, F.lit(g[0]), F.lit(g[1])), GREEK.items(), text), unwrapped)


def match_form(text: Column) -> Column:
    """Form that texts are compared in: Greek letters spelled out, wrappers, blanks and punctuation gone, lower case."""
    plain = let(F.coalesce(text, F.lit("")), lambda raw: F.when(raw.rlike("[α-ω]") | F.contains(raw, F.lit("\\mathrm")), spelled(raw)).otherwise(raw))
    return F.lower(F.regexp_replace(plain, IGNORED, ""))


def token_count(text: Column) -> Column:
    """A quarter of the characters, at least one, none for an empty text."""
    plain = clean(text)
    return F.when(plain == "", 0).otherwise(F.greatest(F.lit(1), F.floor(F.char_length(plain) / 4).cast("int"))).cast("int")


def clause_id(text: Column) -> Column:
    """Leading dotted number of two to five parts, else null."""
    found = F.regexp_extract(clean(text), "^(\\d+(?:\\.\\d+){1,4})\\s", 1)
    return F.when(found != "", found)


def contains_clause(text: Column, clause: Column | str) -> Column:
    """Whether a text has exactly this clause number, not as a part of a longer one. Texts without its characters are told by a plain search."""
    ref = F.lit(clause) if isinstance(clause, str) else clause
    exact = F.regexp_like(text, F.concat(F.lit("(?<![\\d.])"), F.replace(ref, F.lit("."), F.lit("\\.")), F.lit("(?![\\d.])")))
    return F.contains(text, ref) & exact if isinstance(clause, str) and re.fullmatch(r"[\w.-]+", clause) else exact


def related_clause(own: Column, wanted: Column) -> Column:
    """Equal clause numbers, or one is below the other (6.2 and 6.2.1, either way; 6.2 and 6.2-1)."""
    return (own == wanted) | own.startswith(F.concat(wanted, F.lit("."))) | own.startswith(F.concat(wanted, F.lit("-"))) | wanted.startswith(F.concat(own, F.lit(".")))


def dotted(ref: Column) -> Column:
    """A clause number in dotted form; spoken numerals become digits."""
    digits = F.create_map(*(F.lit(x) for pair in NUMERALS.items() for x in pair))
    spoken = F.array_join(F.transform(F.split(ref, "点"), lambda part: F.coalesce(F.try_element_at(digits, part), part)), ".")
    return F.when(F.contains(ref, F.lit("点")), spoken).otherwise(F.trim(F.regexp_replace(ref, "[\\s\\-.]+", ".")))


def clause_refs(text: Column) -> Column:
    """Distinct clause numbers in dotted form: dotted, blank-separated, hyphenated or spoken ones."""
    found = F.concat(*(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(k), F.lit(0)) for k in CLAUSE_FORMS))
    return F.array_distinct(F.transform(found, dotted))


def chapter(path: Column) -> Column:
    """Last non-empty part of a section path, else null."""
    parts = F.filter(F.transform(F.split(path, "/"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.element_at(parts, -1))


def section_form(path: Column) -> Column:
    """Section path with each part trimmed and empty parts gone."""
    return F.array_join(F.filter(F.transform(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: F.trim(p)), lambda p: p != ""), " / ")


def title_level(text: Column, given: Column) -> Column:
    """The given level if positive, else one more than the dots of a leading number, 3 at most."""
    plain = clean(text)
    return F.when(given > 0, given).when(plain.rlike("^\\d+\\.\\d+\\.\\d+"), 3).when(plain.rlike("^\\d+\\.\\d+"), 2).otherwise(1).cast("int")


def block_type(raw: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in BLOCK_TYPES.items() for x in pair))
    return F.coalesce(F.element_at(names, F.trim(raw)), F.lit("unknown"))


def entity_form(name: Column) -> Column:
    """Name in half-width characters, without blanks, in lower case."""
    return F.lower(F.regexp_replace(F.translate(F.coalesce(name, F.lit("")), FULL_WIDTH, HALF_WIDTH), "\\s+", ""))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 0 for two empty names."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(0.0)


def word_tokens(text: Column) -> Column:
    """Ideographs one by one, letter runs, digit runs; lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\u4e00-\u9fff]|[a-z]+|\\d+"), F.lit(0))


def bigrams(text: Column) -> Column:
    """All pairs of neighbouring characters; texts of fewer than two have none."""
    n = F.char_length(text)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def first_number(text: Column) -> Column:
    """First decimal number in a text as double, else null."""
    return F.nullif(F.regexp_extract(text, "-?\\d+(?:\\.\\d+)?", 0), F.lit("")).try_cast("double")


def number_range(text: Column) -> Column:
    """Struct (lo, hi) of `a~b`, `a-b`, `<a`, `>a`, `≤a`, `≥a`; open ends are null, no range at all is null."""
    compact = F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", "")
    pair, bound = "^(\\d+(?:\\.\\d+)?)[~～\\-–](\\d+(?:\\.\\d+)?)", "^([<>≤≥])=?(\\d+(?:\\.\\d+)?)"
    sign, value = F.regexp_extract(compact, bound, 1), F.regexp_extract(compact, bound, 2).try_cast("double")
    whole = F.struct(F.regexp_extract(compact, pair, 1).try_cast("double").alias("lo"), F.regexp_extract(compact, pair, 2).try_cast("double").alias("hi"))
    open_ = F.struct(F.when(sign.isin(">", "≥"), value).alias("lo"), F.when(sign.isin("<", "≤"), value).alias("hi"))
    return F.when(compact.rlike(pair), whole).when(compact.rlike(bound), open_)


def year_of(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), "(19|20)\\d{2}", 0), F.lit("")).cast("int")


def expression_form(text: Column) -> Column:
    """Arithmetic in plain ASCII: superscripts as powers, full-width signs, no thousands separators, no blanks."""
    out = F.translate(F.coalesce(text, F.lit("")), "×÷（）＋－＊／，", "*/()+-*/,")
    for sign, power in (("²", "**2"), ("³", "**3"), ("^", "**")):
        out = F.replace(out, F.lit(sign), F.lit(power))
    return F.regexp_replace(F.regexp_replace(out, "(?<=\\d),(?=\\d{3})", ""), "\\s+", "")


#: Letters that upper-casing makes several of, and the single letters that take their place: ß gets ẞ, those with an iota below their title form, others stay.
_SEVERAL = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and len(c.upper()) > 1]
_SINGLE = ["ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _SEVERAL]


def upper_letters(text: Column) -> Column:
    """Upper case letter by letter, so that a text keeps its length (`upper` makes SS of ß)."""
    letters = "".join(_SEVERAL)
    parts = F.split(text, f"(?=[{letters}])|(?<=[{letters}])")
    each = F.transform(parts, lambda p: F.when(p.rlike(f"^[{letters}]"), F.translate(p, letters, "".join(_SINGLE))).otherwise(F.upper(p)))
    return F.when(text.rlike(f"[{letters}]"), F.array_join(each, "")).otherwise(F.upper(text))
