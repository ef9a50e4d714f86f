"""The five routes of retrieval: dense, sparse, clause, table and formula, and what follows their fusion.

Each route takes tables and a question and returns candidates with the same columns: route, item_id,
doc_id, kind, title, text, score, target_id, table_id, section_path, page_idx. Scores are columns over the
rows of a scan; what a route keeps is its best candidates, so that little is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.query import Question
from folioscope.functions.terms import has_any, identifier_hits
from folioscope.functions.text import clean, contains_clause, match_form
from folioscope.operators import search
from folioscope.operators.listing import any_token, by_clause
from folioscope.operators.textindex import TextIndex
from folioscope.session import written

CANDIDATE = ["route", "item_id", "doc_id", "kind", "title", "text", "score", "target_id", "table_id", "section_path", "page_idx"]
# Fixed values that scores depend on.
CALCULATION = ("怎么算", "怎么计算", "如何计算", "计算方法", "按什么计算", "如何确定", "如何取值")
EVIDENCE_OF_CALCULATION = ("按式", "式中", "统计", "频率", "取值", "计算", "确定")
CONTEXT_OF_CALCULATION = ("按式", "式中", "统计", "频率", "计算", "确定")
DEFINITION = ("什么是", "定义", "含义", "解释", "表示什么", "代表什么", "是什么意思")
LOOKUP = ("多少", "取多少", "什么值", "数值", "多大", "取值", "上限", "下限", "系数")
PRIORITY = {"table_row_key": 5, "table_schema": 4, "table_mapping_row": 4, "table_text_row": 3, "table_summary": 2, "formula_context": 5, "formula_clause": 4, "formula": 3}
CLAUSE_SCORE, EXACT_CLAUSE = 12.0, 2.0
#: Column of the match form in tables that are prepared for questions.
FORM = "match_form"
#: Keys that an index may find for them to be sent to all tasks; beyond, the texts are filtered where they lie.
MOST_KEYS = 200_000
BLOCK_FACTOR, FORMULA_FACTOR, CLAUSE_TEXT_FACTOR = 0.85, 0.95, 0.9


def _candidates(rows: DataFrame, route: str, **columns: Column) -> DataFrame:
    """Rows as candidates of a route; what isn't given is null.

    They leave a generator of one row each, so that a filter on the score reads the score, and doesn't work it out a second time below.
    """
    kinds = {"item_id": "string", "doc_id": "long", "kind": "string", "title": "string", "text": "string", "score": "double", "target_id": "string", "table_id": "string", "section_path": "string", "page_idx": "long"}
    one = F.struct(F.lit(route).alias("route"), *(columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))
    return rows.select(F.inline(F.array(one)))


def _clause_hit(raw: Column, question: Question) -> Column:
    return reduce(lambda a, b: a | b, (contains_clause(raw, ref) for ref in question.clauses), F.lit(False))


def _formed(rows: DataFrame, title: Column, text: Column, name: str = "_form") -> DataFrame:
    """Rows with the match form of a title and text in a column of its own, so that it is worked out once for all that a score asks of it.

    Tables that were prepared at load (with_forms) have it already.
    """
    return rows.withColumn(name, F.col(FORM) if FORM in rows.columns else match_form(search.raw_text(title, text)))


def with_forms(rows: DataFrame, title: str, text: str) -> DataFrame:
    """Rows with the match form of their title and text, to be written at load: a question then compares, and normalises nothing."""
    return rows.withColumn(FORM, match_form(search.raw_text(F.col(title), F.col(text))))


def best(candidates: DataFrame, *, top: int) -> DataFrame:
    """The best candidates of a route: by priority of their kind, score, shorter text, then id."""
    kinds = F.create_map(*(F.lit(x) for pair in PRIORITY.items() for x in pair))
    priority = F.coalesce(F.try_element_at(kinds, F.col("kind")), F.lit(1))
    return candidates.orderBy(F.desc(priority), F.desc("score"), F.char_length("text"), "item_id").limit(max(1, min(20, 3 * top)))


# ---------------------------------------------------------------- dense


def type_bonus(task: str, kind: Column, entity: Column) -> Column:
    """What a task adds to a vector hit for what it is."""
    if task == "table_qa":
        return F.when(entity.isin("table_schema", "table_row_key") | kind.startswith("table_"), 0.12).otherwise(0.0)
    if task == "definition_qa":
        return F.when(kind.isin("outline_anchor", "table_summary"), 0.08).when(entity == "formula", 0.04).otherwise(0.0)
    if task == "locate_qa":
        return F.when(kind == "outline_anchor", 0.10).otherwise(0.0)
    return F.lit(0.0)


def dense(vectors: DataFrame, texts: DataFrame, query: Sequence[float], question: Question, *, top: int, penalty: float = 0.0) -> DataFrame:
    """Candidates of the nearest vectors (item_id, vector), with the texts (item_id, doc_id, entity, kind, title, text, ...) they stand for.

    penalty: share of the score that vectors lose that are only hashed, unless a place is asked for.
    """
    near = search.vector_top(vectors, "item_id", "vector", query, top=search.dense_limit(top)).withColumnRenamed("key", "item_id").withColumnRenamed("score", "similarity")
    rows = _formed(texts.join(F.broadcast(near), "item_id"), F.col("title"), F.col("text"))  # at most 200 hits
    score = search.dense_score(F.col("similarity"), F.col("title"), F.col("text"), question, F.col("_form")) + type_bonus(question.task, F.col("kind"), F.col("entity"))
    if penalty and not question.task.startswith("locate_"):
        score = score * max(0.0, 1.0 - penalty)
    told = {c: F.col(c) for c in ("item_id", "doc_id", "kind", "title", "text", "section_path", "page_idx")}
    return _candidates(rows, "dense", score=F.round(score, 6), target_id=F.col("target_id"), **told).where("score > 0")


# ---------------------------------------------------------------- sparse


def having_tokens(chunks: DataFrame, key: str, text: str, asked: Sequence[str], index: TextIndex | None) -> DataFrame:
    """Chunks with any of the tokens: by an index of them (by key) where it finds few enough to broadcast, else by a scan. The rows are the same."""
    if index is not None:
        keys = index.hits(asked).select(F.col("key").alias(key)).distinct()
        if keys.limit(MOST_KEYS + 1).count() <= MOST_KEYS:
            return chunks.join(F.broadcast(keys), key, "left_semi")
    return chunks.where(search.has_token(F.col(text), asked))


def sparse(targets: DataFrame, chunks: DataFrame, blocks: DataFrame, question: Question, *, top: int, index: TextIndex | None = None) -> DataFrame:
    """Candidates by their words: citation targets, chunks that full-text search finds, and blocks with the question's keyword.

    targets: target_id, target_type, doc_id, display_title, snippet, page_idx. chunks: chunk_id, chunk_type,
    doc_id, section_path, text, page_idx. blocks: block_id, block_type, doc_id, section_path, text, page_idx.
    index: of the chunks' texts by chunk_id, if one is kept. The limits are those of the whole route; the best stay.
    """
    terms = [t for t in question.tokens if t]

    def scored(section: Column, text: Column) -> tuple[Column, Column]:
        """The score of the words alone, and with what a clause number in the section or text adds."""
        base = search.sparse_score(section, text, question, F.col("_form"))
        return base, base + F.when(_clause_hit(search.raw_text(section, text), question), 8.0).otherwise(0.0)

    def cut(rows: DataFrame, most: int) -> DataFrame:
        return rows.where("score > 0").orderBy(F.desc("score"), "item_id").limit(most)

    same_kind = {"locate_figure": "figure", "locate_table": "table", "locate_formula": "formula"}.get(question.kind)
    score = search.sparse_score(F.col("display_title"), F.col("snippet"), question, F.col("_form")) + 6.0
    if same_kind:
        score = score + F.when(F.col("target_type") == same_kind, 4.0).otherwise(0.0)
    named = _formed(any_token(targets, terms, "display_title", "snippet") if terms else targets.limit(0), F.col("display_title"), F.col("snippet"))
    told = {"item_id": F.col("target_id"), "doc_id": F.col("doc_id"), "kind": F.col("target_type"), "title": F.col("display_title"), "text": F.col("snippet"), "target_id": F.col("target_id"), "page_idx": F.col("page_idx")}
    parts = [cut(_candidates(named, "sparse", score=F.round(score, 6), **told), max(20, 4 * top))]

    hits = having_tokens(chunks, "chunk_id", "text", search.asked_tokens(question.text), index) if question.keyword else chunks
    hits = _formed(hits, F.col("section_path"), F.col("text"))
    base, score = scored(F.col("section_path"), F.col("text"))
    if question.task == "definition_qa":
        score = score + F.when((base > 0) & F.col("chunk_type").isin("outline_anchor", "table_summary"), 1.0).otherwise(0.0)
    told = {"item_id": F.col("chunk_id"), "doc_id": F.col("doc_id"), "kind": F.col("chunk_type"), "title": F.col("section_path"), "text": F.col("text"), "section_path": F.col("section_path"), "page_idx": F.col("page_idx")}
    parts.append(cut(_candidates(hits, "sparse", score=F.round(score, 6), **told), max(40, 10 * top)))

    body = blocks.where(~F.col("block_type").isin("header_footer", "toc"))
    if question.keyword:
        body = any_token(body, [question.keyword], "text")
    body = _formed(body, F.col("section_path"), F.col("text"))
    base, score = scored(F.col("section_path"), F.col("text"))
    if question.task == "locate_qa":
        score = score + F.when(F.col("block_type") == "title", 1.0).otherwise(0.0)
    if question.task == "definition_qa":
        score = score + F.when(F.col("block_type").isin("formula", "title"), 1.5).otherwise(0.0)
    told = {"item_id": F.col("block_id"), "doc_id": F.col("doc_id"), "kind": F.col("block_type"), "title": F.col("section_path"), "text": F.col("text"), "target_id": F.col("block_id"), "section_path": F.col("section_path"), "page_idx": F.col("page_idx")}
    score = F.when(base > 0, score * BLOCK_FACTOR).otherwise(0.0)
    parts.append(cut(_candidates(body, "sparse", score=F.round(score, 6), **told), max(20, 6 * top)))
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- clause


def clause(blocks: DataFrame, question: Question, *, top: int) -> DataFrame:
    """Blocks whose clause number a question names: 12, and 2 more for the very number; none without a number that is surely one."""
    refs = question.strict_clauses
    rows = by_clause(blocks, refs, then=["block_id"], limit=max(6, 2 * top)) if refs else blocks.limit(0)
    score = F.lit(CLAUSE_SCORE) + F.when(F.col("clause_id").isin(*refs), EXACT_CLAUSE).otherwise(0.0)
    told = {"item_id": F.col("block_id"), "doc_id": F.col("doc_id"), "kind": F.col("block_type"), "title": F.col("section_path"), "text": F.col("text"), "target_id": F.col("block_id"), "section_path": F.col("section_path"), "page_idx": F.col("page_idx")}
    return _candidates(rows, "clause", score=score, **told)


# ---------------------------------------------------------------- tables


def full_table_text(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """(table_id, full_text): caption, title, summary, header and rows of each table as lines. For the few tables that are shown."""
    line = lambda cells: F.array_join(F.filter(F.transform(cells, clean), lambda c: c != ""), " | ")
    body = rows.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("row_index", line(F.col("cells")).alias("line")))).alias("body"))
    head = F.array(F.col("caption"), F.when(~F.col("title").eqNullSafe(F.col("caption")), F.col("title")), F.col("summary"), line(F.col("headers")))
    lines = F.filter(F.concat(head, F.coalesce(F.transform("body", lambda b: b["line"]), F.array().cast("array<string>"))), lambda x: F.coalesce(x, F.lit("")) != "")
    return tables.join(body, "table_id", "left").select("table_id", F.array_join(lines, "\n").alias("full_text"))


def table(tables: DataFrame, rows: DataFrame, question: Question, *, top: int) -> DataFrame:
    """Candidates from tables (table_id, doc_id, table_type, title, caption, summary, headers, page_idx) and their rows
    (table_id, row_index, cells, text).

    Which candidates a table gives depends on its type: rows by their key for numbers, rows as text for
    words, the header, the summary. The text of a row's candidate is the row; table_text puts in the whole table
    once it is known which few are shown.
    """
    names = ["table_id", "doc_id", "table_type", "title", "caption", "summary", "headers", "page_idx"]
    whole = rows.join(tables.select(*names), "table_id")
    heads = F.array_join(F.filter(F.transform("headers", clean), lambda c: c != ""), " | ")
    hint = lambda text: has_any(text, question.hints) if question.hints else F.lit(False)
    numeric, words, mapping = F.col("table_type").isin("numeric_dense", "hybrid"), F.col("table_type").isin("text_dense", "hybrid"), F.col("table_type") == "mapping_enum"

    def told(rows: DataFrame, name: str, kind: Column, text: Column, score: Column) -> DataFrame:
        section = F.coalesce(F.nullif("caption", F.lit("")), F.col("title"))
        return _candidates(rows, "table", item_id=F.concat("table_id", F.lit(f":{name}")), doc_id=F.col("doc_id"), kind=kind, title=F.col("title"), text=text, score=F.round(score, 6), target_id=F.col("table_id"), table_id=F.col("table_id"), section_path=section, page_idx=F.col("page_idx")).where("score > 0")

    def scored(rows: DataFrame, text: Column) -> tuple[DataFrame, Column, Column]:
        """Rows with their text and its form; the score of the words, and the overlap."""
        formed = _formed(rows.withColumn("_text", text), F.col("title"), F.col("_text"))
        return formed, search.sparse_score(F.col("title"), F.col("_text"), question, F.col("_form")), search.lexical_overlap(F.col("_form"), question)

    cells = F.transform("cells", clean)
    key = F.coalesce(F.get(cells, F.lit(0)), F.lit(""))
    rows, score, _ = scored(whole.where(numeric & F.exists("cells", lambda c: F.trim(c) != "")), F.concat_ws(" | ", "title", heads, F.array_join(cells, " | ")))
    rows = _formed(rows, key, F.col("_text"), "_key_form")
    of_key = F.when(hint(key), 8.0).otherwise(0.0) + F.when(search.lexical_overlap(F.col("_key_form"), question) > 0, 1.6).otherwise(0.0)
    by_key = told(rows, "row-key", F.lit("table_row_key"), F.col("_text"), score + F.when(key != "", of_key).otherwise(0.0))

    rows, score, overlap = scored(tables.where(numeric | mapping), F.array_join(F.filter(F.array("title", "caption", "summary", heads), lambda x: F.coalesce(x, F.lit("")) != ""), "\n"))
    by_schema = told(rows, "schema", F.lit("table_schema"), F.col("_text"), score + F.when(overlap > 0, 1.2).otherwise(0.0) + F.when(hint(F.col("_text")), 6.0).otherwise(0.0))

    rows, score, overlap = scored(whole.where((words | mapping) & (clean(F.col("text")) != "")), clean(F.col("text")))
    score = score + 0.5 * overlap
    if question.says(*DEFINITION):
        score = score + F.when(mapping, 1.5).otherwise(0.0)
    by_text = told(rows, "text-row", F.when(mapping, "table_mapping_row").otherwise("table_text_row"), F.col("_text"), score)

    asked = ~mapping & (F.lit(not question.says(*LOOKUP)) | (F.col("table_type") != "numeric_dense"))
    rows, score, overlap = scored(tables.where(asked), F.array_join(F.filter(F.array("title", "caption", "summary"), lambda x: F.coalesce(x, F.lit("")) != ""), "\n"))
    by_summary = told(rows, "summary", F.lit("table_summary"), F.col("_text"), score + 0.3 * overlap + F.when(hint(F.col("_text")), 4.0).otherwise(0.0))
    return best(reduce(DataFrame.unionByName, [by_key, by_schema, by_text, by_summary]), top=top)


def table_text(items: DataFrame, texts: DataFrame) -> DataFrame:
    """Items with the full text of their table (table_id, full_text) where that is longer than their own."""
    full = texts.select("table_id", "full_text")
    longer = F.char_length("full_text") > F.char_length("text")
    return items.join(full, "table_id", "left").withColumn("text", F.when(longer, F.col("full_text")).otherwise(F.col("text"))).select(*items.columns)


# ---------------------------------------------------------------- formulas


def formula_windows(blocks: DataFrame, *, around: int = 4) -> DataFrame:
    """Formulas with `near`: the paragraphs, list items and formulas up to `around` blocks before and after them in the document,
    in order, of their section or a page away at most; `telling`: formulas and words of calculation. Nothing here depends on a question, so this shuffle of the blocks is made
    once, at load; a document's blocks are ordered together, and a row holds 2 * around + 1 of them."""
    order = Window.partitionBy("doc_id").orderBy("page_idx", "reading_order")
    rows = blocks.withColumn("plain", clean(F.col("text")))
    rows = _formed(rows, F.col("section_path"), F.col("plain"), "form")
    part = F.struct(F.coalesce("section_path", F.lit("")).alias("section"), F.col("page_idx").alias("page"), F.col("block_type").alias("kind"), F.col("plain").alias("text"), F.col("form"), has_any(F.col("plain"), EVIDENCE_OF_CALCULATION).alias("telling"))
    part = F.when(F.col("block_type").isin("paragraph", "list_item", "formula") & (F.col("plain") != ""), part)
    # texts and forms are sent in their part alone, also those of the formulas
    rows = rows.select("doc_id", "page_idx", "reading_order", "block_id", "section_path", part.alias("part"))
    rows = rows.withColumn("near", F.collect_list("part").over(order.rowsBetween(-around, around))).where(F.col("part.kind") == "formula")
    close = F.filter("near", lambda b: (b["section"] == F.coalesce("section_path", F.lit(""))) | (F.abs(b["page"] - F.col("page_idx")) <= 1))
    told = F.transform(close, lambda b: F.struct(((b["kind"] == "formula") | b["telling"]).alias("telling"), b["text"].alias("text"), b["form"].alias("form")))
    return rows.select("block_id", "doc_id", "section_path", "page_idx", F.col("part.text").alias("plain"), F.col("part.form").alias("form"), told.alias("near"))


def formula_contexts(windows: DataFrame, question: Question) -> DataFrame:
    """Windows with `raw` and `context`: of the blocks near a formula its formulas, and the others that name a clause, a calculation or a token of the question."""

    def telling(b: Column) -> Column:
        named = (F.contains(b["form"], F.lit(token)) for token, weight in question.weighted if weight > 0)
        return reduce(or_, named, b["telling"]) | _clause_hit(b["text"], question)

    told = F.transform(F.filter("near", telling), lambda b: b["text"])
    raw = search.raw_text(F.col("section_path"), F.col("plain"))
    rows = windows.select("block_id", "doc_id", "section_path", "page_idx", "plain", "form", raw.alias("raw"), F.inline(F.array(F.struct(F.array_join(F.array_distinct(told), "\n").alias("context")))))
    return rows.select("block_id", "doc_id", "section_path", "page_idx", "plain", "form", "raw", "context")


def formula(windows: DataFrame, chunks: DataFrame, question: Question, *, top: int) -> DataFrame:
    """Candidates for questions about calculations: formulas, formulas with their surroundings (windows: formula_windows of the
    blocks), and chunks that explain them."""
    calculation = question.says(*CALCULATION)
    named = windows.withColumn("raw", search.raw_text(F.col("section_path"), F.col("plain")))
    exact, hits = _clause_hit(F.col("raw"), question), identifier_hits(question.symbols, F.col("raw"))
    score = search.lexical_overlap(F.col("form"), question) + F.when(exact, 12.0).otherwise(0.0) + (4.0 if calculation else 0.0) + (2.0 if question.says("式") else 0.0) + 6.0 * hits
    told = {"doc_id": F.col("doc_id"), "title": F.col("section_path"), "target_id": F.col("block_id"), "section_path": F.col("section_path"), "page_idx": F.col("page_idx")}
    alone = _candidates(named, "formula", item_id=F.col("block_id"), kind=F.lit("formula"), text=F.col("plain"), score=F.round(score * FORMULA_FACTOR, 6), **told)
    rows = _formed(formula_contexts(windows, question), F.col("section_path"), F.col("context"), "context_form")
    score = search.lexical_overlap(F.col("context_form"), question) + F.when(exact, 10.0).otherwise(0.0) + (6.0 if calculation else 0.0) + F.when(has_any(F.col("context"), CONTEXT_OF_CALCULATION), 4.0).otherwise(0.0) + 4.0 * hits
    around = _candidates(rows, "formula", item_id=F.concat("block_id", F.lit(":context")), kind=F.lit("formula_context"), text=F.col("context"), score=F.round(score, 6), **told)

    # a text has a plain form if it has more than white space; asked of the text, so that no filter makes the form a second time
    rows = _formed(chunks.where(F.col("text").rlike("\\S")).withColumn("plain", clean(F.col("text"))), F.col("section_path"), F.col("plain"))
    raw = search.raw_text(F.col("section_path"), F.col("plain"))
    score = search.lexical_overlap(F.col("_form"), question) + F.when(_clause_hit(raw, question), 8.0).otherwise(0.0) + 4.0 * identifier_hits(question.symbols, raw)
    if calculation:
        score = score + F.when(has_any(F.col("plain"), EVIDENCE_OF_CALCULATION), 5.0).otherwise(0.0)
    told = {"doc_id": F.col("doc_id"), "title": F.col("section_path"), "target_id": F.col("chunk_id"), "section_path": F.col("section_path"), "page_idx": F.col("page_idx")}
    clauses = _candidates(rows, "formula", item_id=F.concat("chunk_id", F.lit(":formula-clause")), kind=F.lit("formula_clause"), text=F.col("plain"), score=F.round(score * CLAUSE_TEXT_FACTOR, 6), **told)
    return best(alone.unionByName(around).unionByName(clauses).where("score > 0"), top=top)


# ---------------------------------------------------------------- after fusion


def numbered_marks(items: DataFrame, prefix: str, order: Sequence[Column]) -> DataFrame:
    """Items with a mark to cite them by: the prefix and their number. For the few items of an answer."""
    return items.withColumn("mark", F.concat(F.lit(prefix), F.row_number().over(Window.orderBy(*order)).cast("string")))


def citations(items: DataFrame, question: Question, order: Sequence[Column], *, limit: int = 5) -> DataFrame:
    """The items to cite: those with a phrase of the question, or the first ones where none has any."""
    hit = search.has_phrase(F.concat_ws("\n", "title", "text"), question) if question.phrases else F.lit(False)
    rows = items.withColumn("_hit", hit)
    some = rows.agg(F.coalesce(F.max("_hit"), F.lit(False)).alias("_some"))  # one row
    return rows.join(F.broadcast(some)).where(F.col("_hit") | ~F.col("_some")).orderBy(*order).limit(limit).drop("_hit", "_some")


def titled(items: DataFrame, titles: DataFrame) -> DataFrame:
    """Items with the title of their document (doc_id, doc_title) before their text, once."""
    named = F.concat(F.lit("《"), F.col("doc_title"), F.lit("》"))
    text = F.when(F.col("doc_title").isNotNull() & (F.col("text") != "") & ~F.contains("text", named), F.concat(named, F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    return items.join(titles, "doc_id", "left").withColumn("text", text).select(*items.columns, "doc_title")


def entity_search(entities: DataFrame, query: str, *, limit: int = 20, library: str | None = None, status: str | None = None) -> DataFrame:
    """Entities (entity_id, name, aliases, ...) whose name or an alias contains a text."""
    hit = F.contains(F.lower("name"), F.lit(query.lower())) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(F.lower(a), F.lit(query.lower())))
    rows = entities.where(hit)
    if library is not None:
        rows = rows.where(F.col("library_id") == library)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    return rows.orderBy("name", "entity_id").limit(max(1, limit))


def or_else(found: DataFrame, fallback: DataFrame) -> DataFrame:
    """The rows found, or those of the fallback where there are none: both share their columns."""
    none = found.agg((F.count("*") == 0).alias("_none"))  # one row
    return found.unionByName(fallback.join(F.broadcast(none)).where("_none").drop("_none"))


def hybrid(sources: Mapping[str, DataFrame], question: Question, *, top: int, tables: tuple[DataFrame, DataFrame] | None = None, hashed: bool = False) -> DataFrame:
    """Candidates of all routes that a question calls for, fused and re-ranked by phrases.

    Formulas are asked for in questions about calculations, tables in those about tables and values. With
    tables (tables, rows), the few that are shown get their full text.
    """
    wanted = {k: v for k, v in sources.items() if k not in ("table", "formula")}
    if "formula" in sources and (question.says("式", "计算") or question.task in ("locate_formula", "formula_qa") or question.symbols):
        wanted["formula"] = sources["formula"]
    if "table" in sources and (question.task.startswith("table_") or question.task in ("locate_table", "locate_qa") or question.says("表", *LOOKUP)):
        wanted["table"] = sources["table"]
    few = written(reduce(DataFrame.unionByName, wanted.values()))  # some hundred rows, which fusion reads several times
    fused = search.phrase_rerank(search.fuse(few, task=question.task, top=top, hashed=hashed), question)
    if tables is None:
        return fused
    shown = F.broadcast(fused.select("table_id").where("table_id IS NOT NULL").distinct())  # at most 20
    return table_text(fused, full_table_text(*(t.join(shown, "table_id", "left_semi") for t in tables)))
