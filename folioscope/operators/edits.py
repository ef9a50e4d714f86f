"""Edits of block graphs and review of entities: each takes tables and returns tables, so that undoing is reading the version before."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.graph import near_names
from folioscope.session import written


def merged(blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """Blocks with each group (block_id, into_id) joined into one block, texts in order; parents that went point to what they became."""
    order = F.struct("page_idx", "reading_order", "text")
    own = blocks.join(groups, "block_id", "left").withColumn("into_id", F.coalesce("into_id", "block_id"))
    texts = own.groupBy("into_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["text"]), "\n").alias("text"))
    kept = own.where("into_id = block_id").drop("text", "into_id").join(texts.withColumnRenamed("into_id", "block_id"), "block_id")
    names = groups.select(F.col("block_id").alias("parent_id"), "into_id")
    return kept.join(names, "parent_id", "left").withColumn("parent_id", F.coalesce("into_id", "parent_id")).select(*blocks.columns)


def split(blocks: DataFrame, pieces: DataFrame) -> DataFrame:
    """Blocks with some replaced by pieces (block_id, texts); texts without two pieces that aren't empty stay whole."""
    cut = pieces.withColumn("texts", F.filter("texts", lambda x: F.trim(x) != "")).where(F.size("texts") >= 2)
    rows = blocks.join(cut, "block_id", "left")
    parts = rows.select(*(c for c in blocks.columns if c not in ("block_id", "text")), F.col("block_id").alias("_id"), F.col("text").alias("_text"), F.posexplode_outer("texts").alias("_n", "_piece"))
    name = F.when(F.coalesce("_n", F.lit(0)) > 0, F.concat_ws("-", "_id", F.col("_n") + 1)).otherwise(F.col("_id"))
    return parts.withColumn("block_id", name).withColumn("text", F.coalesce("_piece", "_text")).select(*blocks.columns)


def deleted(blocks: DataFrame, gone: DataFrame) -> DataFrame:
    """Blocks without those gone; children move up to the nearest ancestor that stays.

    Among those gone the way up doubles each round, so the rounds grow with the logarithm of the longest chain of them.
    """
    lost = gone.select("block_id").distinct()
    up = written(blocks.join(lost, "block_id", "left_semi").select("block_id", "parent_id"))
    while True:
        step = up.select(F.col("block_id").alias("parent_id"), F.col("parent_id").alias("above"), F.lit(True).alias("_gone"))
        ahead = up.join(step, "parent_id", "left")
        moved = ahead.where("_gone AND block_id <> parent_id")
        if moved.isEmpty():
            break
        up = written(ahead.select("block_id", F.when(F.col("_gone"), F.col("above")).otherwise(F.col("parent_id")).alias("parent_id")))
    names = up.select(F.col("block_id").alias("parent_id"), F.col("parent_id").alias("_above"), F.lit(True).alias("_gone"))
    out = blocks.join(lost, "block_id", "left_anti").join(names, "parent_id", "left")
    return out.withColumn("parent_id", F.when(F.col("_gone"), F.col("_above")).otherwise(F.col("parent_id"))).select(*blocks.columns)


def reparented(blocks: DataFrame, before: str, after: str | None) -> DataFrame:
    """Blocks with the children of one block given to another."""
    return blocks.withColumn("parent_id", F.when(F.col("parent_id") == before, F.lit(after)).otherwise(F.col("parent_id")))


def relevelled(blocks: DataFrame, ids: Sequence[str], *, by: int, most: int = 6) -> DataFrame:
    """Title levels of some blocks moved by a number, between 1 and the deepest."""
    moved = F.greatest(F.lit(1), F.least(F.lit(most), F.coalesce("title_level", F.lit(1)) + by))
    return blocks.withColumn("title_level", F.when(F.col("block_id").isin(*ids), moved).otherwise(F.col("title_level")))


def invalid_links(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """(source_id, target_id, problem) of continuation links: an end is missing, the target doesn't come later, or a title stands between."""
    place = Window.partitionBy("doc_id").orderBy("page_idx", "reading_order")
    rows = blocks.select("doc_id", "block_id", F.row_number().over(place).alias("at"), F.sum((F.col("block_type") == "title").cast("int")).over(place).alias("titles"), "block_type")
    side = lambda p: rows.select(*(F.col(c).alias(f"{p}_{c}") for c in rows.columns))
    both = links.join(side("s"), F.col("source_id") == F.col("s_block_id"), "left").join(side("t"), F.col("target_id") == F.col("t_block_id"), "left")
    between = F.col("t_titles") - F.col("s_titles") - (F.col("t_block_type") == "title").cast("int")
    problem = F.when(F.col("s_block_id").isNull() | F.col("t_block_id").isNull(), "missing").when((F.col("s_doc_id") != F.col("t_doc_id")) | (F.col("t_at") <= F.col("s_at")), "not later").when(between > 0, "title between")
    return both.select("source_id", "target_id", problem.alias("problem")).where("problem IS NOT NULL")


#: Types that may be continued by another block: fixed values.
CONTINUABLE = ("paragraph", "list_item")


def checked_instructions(blocks: DataFrame, instructions: DataFrame) -> DataFrame:
    """Instructions (kind, source_uid, target_uid) with accepted and the reason why not; the first rule that is broken counts.

    blocks: doc_id, block_id, block_type, page_idx, block_seq, columns (of a table). Both ends have to exist, in one document. A
    continuation (contd) ties paragraphs and list items, runs forward and crosses no title; a merge (table_merge) ties tables of as many columns;
    other kinds are unknown. Null columns equal null columns. Titles are counted up to each block, document by document.
    """
    up_to = Window.partitionBy("doc_id").orderBy("page_idx", "block_seq").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.struct(F.coalesce("page_idx", F.lit(0)).alias("page"), F.coalesce("block_seq", F.lit(0)).alias("seq"))
    is_title = (F.col("block_type") == "title").cast("int")
    rows = blocks.withColumn("at", place).withColumn("titles", F.sum(is_title).over(up_to)).select("doc_id", "block_id", "block_type", "at", "titles", is_title.alias("own"), "columns")
    side = lambda name, uid: rows.select(F.struct(*rows.columns).alias(name), F.col("block_id").alias(uid))
    both = instructions.join(side("s", "source_uid"), "source_uid", "left").join(side("t", "target_uid"), "target_uid", "left")
    between = F.col("t.titles") - F.coalesce("t.own", F.lit(0)) - F.col("s.titles")
    compatible = F.col("s.block_type").isin(*CONTINUABLE) & F.col("t.block_type").isin(*CONTINUABLE)
    of_text = F.when(~F.coalesce(compatible, F.lit(False)), "types").when(F.col("t.at") <= F.col("s.at"), "not later").when(between > 0, "title between")
    tables = (F.col("s.block_type") == "table") & (F.col("t.block_type") == "table")
    of_table = F.when(~F.coalesce(tables, F.lit(False)), "types").when(~F.col("s.columns").eqNullSafe(F.col("t.columns")), "columns")
    missing = F.col("s").isNull() | F.col("t").isNull() | (F.col("s.doc_id") != F.col("t.doc_id"))
    reason = F.when(missing, "missing").when(F.col("kind") == "contd", of_text).when(F.col("kind") == "table_merge", of_table).otherwise("unknown kind")
    return both.select("kind", "source_uid", "target_uid", reason.isNull().alias("accepted"), reason.alias("reason"))


def noted(entities: DataFrame, notes: DataFrame) -> DataFrame:
    """Entities with glossary notes (name, note, aliases) added to their description and aliases, by name in any library."""
    more = notes.groupBy("name").agg(F.array_join(F.sort_array(F.collect_list("note")), "\n").alias("_note"), F.array_distinct(F.flatten(F.collect_list("aliases"))).alias("_aliases"))
    none = F.array().cast("array<string>")
    rows = entities.join(more, "name", "left").withColumn("description", F.when(F.col("_note").isNotNull(), F.concat_ws("\n", F.nullif("description", F.lit("")), "_note")).otherwise(F.col("description")))
    return rows.withColumn("aliases", F.array_sort(F.array_union(F.coalesce("aliases", none), F.coalesce("_aliases", none)))).select(*entities.columns)


def conflicting(relations: DataFrame, marks: DataFrame) -> DataFrame:
    """Relations with those marked (relation_id, note) at a confidence of -1 and with the note."""
    rows = relations.join(marks.select("relation_id", F.col("note").alias("_note"), F.lit(True).alias("_marked")), "relation_id", "left")
    return rows.withColumn("confidence", F.when(F.col("_marked"), F.lit(-1.0)).otherwise(F.col("confidence"))).withColumn("conflict_note", F.coalesce("_note", "conflict_note")).select(*relations.columns)


def corrections_of(log: DataFrame, block: str | None = None) -> DataFrame:
    """The latest correction of each kind (doc_id, block_id, operation, payload, created_at) of all blocks or of one."""
    rows = log if block is None else log.where(F.col("block_id") == block)
    return rows.groupBy("doc_id", "block_id", "operation").agg(F.max_by("payload", "created_at").alias("payload"), F.max("created_at").alias("created_at"))


def cleared(log: DataFrame, docs: DataFrame) -> DataFrame:
    """The log of corrections without those of some documents (doc_id)."""
    return log.join(docs.select("doc_id"), "doc_id", "left_anti")


def link_instructions(blocks: DataFrame) -> DataFrame:
    """(kind, source_uid, target_uid) of blocks (id, source_uid, page, contd, table_merge) that point to another by its id.

    A block with both points by contd. Of two tables that point to each other the one on the earlier page is the source.
    """
    kind = F.when(F.col("contd") >= 0, "contd").when(F.col("table_merge") >= 0, "table_merge")
    rows = blocks.withColumn("kind", kind).withColumn("other", F.when(F.col("kind") == "contd", F.col("contd")).otherwise(F.col("table_merge"))).where("kind IS NOT NULL AND source_uid IS NOT NULL")
    ids = blocks.select(F.col("id").alias("other"), F.col("source_uid").alias("target_uid")).where("target_uid IS NOT NULL")
    both = rows.join(ids, "other").select("kind", "source_uid", "target_uid", "page", "id")
    pair = F.when(F.col("kind") == "table_merge", F.concat_ws("\u0001", F.array_sort(F.array("source_uid", "target_uid")))).otherwise(F.concat_ws("\u0001", F.lit("contd"), "id"))
    return both.groupBy("kind", pair.alias("pair")).agg(F.min_by(F.struct("source_uid", "target_uid"), F.struct("page", "id")).alias("x")).select("kind", "x.source_uid", "x.target_uid")


def signal_levels(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """(block_id, level): titles' levels by their source (titles: source_id, title, level), else by their text without blanks; first wins."""
    level = F.col("level").between(1, 9)
    by_source = titles.where(level & F.col("source_id").isNotNull()).groupBy("source_id").agg(F.min("level").alias("by_source"))
    form = lambda c: F.regexp_replace(c, "\\s+", "")
    by_text = titles.where(level).groupBy(form("title").alias("form")).agg(F.min_by("level", "place").alias("by_text"))
    rows = blocks.where("block_type = 'title'").join(by_source, "source_id", "left").withColumn("form", form("text")).join(by_text, "form", "left")
    return rows.select("block_id", F.coalesce("by_source", "by_text").alias("level")).where("level IS NOT NULL")


def reviewed(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """Entities with the status of their latest decision (entity_id, status, at)."""
    last = decisions.groupBy("entity_id").agg(F.max_by("status", "at").alias("_status"))
    return entities.join(last, "entity_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Twice the characters in common runs over all characters of two texts."""

    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(left, right, strict=True)])

    return F.pandas_udf(ratio, "double")(a, b)


def reuse(names: DataFrame, entities: DataFrame, form: Column, known_form: Column, *, least: float = 0.92) -> DataFrame:
    """(name, entity_id, method): a known entity for each new name: exact before alias before equal form before a similar one.

    Forms with a ratio of `least` differ by at most twice the rest in edits, so only pairs that near, which meet by
    shared pieces, are compared.
    """
    exact = names.join(entities.select("name", "entity_id"), "name").select("name", "entity_id", F.lit(1).alias("rank"), F.lit(1.0).alias("score"))
    alias = names.join(entities.select(F.explode("aliases").alias("name"), "entity_id"), "name").select("name", "entity_id", F.lit(2).alias("rank"), F.lit(1.0).alias("score"))
    own, known = names.select("name", form.alias("form")), entities.select("entity_id", known_form.alias("form"))
    forms = own.join(known, "form").select("name", "entity_id", F.lit(3).alias("rank"), F.lit(1.0).alias("score"))
    both = own.select("form", F.lit(False).alias("side")).unionByName(known.select("form", F.lit(True).alias("side"))).select(F.lit("all").alias("layer"), F.col("form").alias("name"), "side")
    pairs = near_names(both, least=1 - 2 * (1 - least))
    # Which of a pair is known isn't told by its length: a form may be both, so both ways are looked up.
    pairs = pairs.select(F.inline(F.array(F.struct(F.col("long_name").alias("known"), F.col("short_name").alias("form")), F.struct(F.col("short_name").alias("known"), F.col("long_name").alias("form")))))
    pairs = pairs.join(known.select(F.col("form").alias("known")), "known", "left_semi").join(own.select("form"), "form", "left_semi")
    near = pairs.withColumn("score", sequence_ratio(F.col("known"), F.col("form"))).where(F.col("score") >= least)
    near = near.join(own, "form").join(known.withColumnRenamed("form", "known"), "known").select("name", "entity_id", F.lit(4).alias("rank"), "score")
    best = exact.union(alias).union(forms).union(near).groupBy("name").agg(F.min(F.struct("rank", (-F.col("score")).alias("far"), "entity_id")).alias("b"))
    return best.select("name", "b.entity_id", F.element_at(F.array(F.lit("exact"), F.lit("alias"), F.lit("form"), F.lit("similar")), F.col("b.rank")).alias("method"))


def level_decision(parser_level: Column, rule: Column, confidence: Column, *, sure: float = 0.8) -> Column:
    """Struct (level, decision) of two opinions on a title's level: agreed ones are adopted, disputed ones kept by the surer."""
    decision = F.when(parser_level.isNull() & rule.isNull(), "review").when(parser_level.eqNullSafe(rule) | parser_level.isNull() | rule.isNull(), "adopt").when(confidence >= sure, "disputed").otherwise("review")
    return F.struct(F.when(parser_level.isNotNull() & (confidence < sure), parser_level).otherwise(F.coalesce(rule, parser_level)).alias("level"), decision.alias("decision"))
